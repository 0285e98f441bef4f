import json

import pytest

from pathloom.llm import answers, dedup, encode, overlap, packing, runs, splits, subjects, topn, variants

ACTION = "struct<action_type string, target string, text string, bbox array<double>, raw struct<ts timestamp_ntz>>"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def actions(spark, lists):
    import datetime

    t = lambda s: None if s is None else datetime.datetime(2030, 1, 1, 0, 0, s)
    data = [(i, None if own is None else [None if a is None else (a[0], a[1], a[2], a[3], (t(a[4]),)) for a in own], "x") for i, own in enumerate(lists)]
    return spark.createDataFrame(data, f"row_id bigint, actions array<{ACTION}>, _runs string")


def test_runs(spark):
    box, near, far = ([x, 0.0, 10.0, 10.0] for x in (0.0, 12.0, 13.0))
    df = actions(spark, [
        None, [], [None, None],
        [("click", "A b", None, box, 1), ("CLICK", "a-B", "", near, 3), ("click", "ab", None, None, None), ("tap", "ab", None, None, 5)],
        [("click", "a", None, box, 1), ("click", "a", None, far, 2), ("click", "a", None, far, 4)],
        [("click", "a", None, box, 1)],
        [("click", "a", None, box, 1)],
        [("type", "x", "1", None, 0)] * 3000,
    ])
    assert rows(runs.repeated_runs(df, "actions"), "row_id", "start_pos", "run_length") == [(2, 0, 2), (3, 0, 3), (4, 1, 2), (7, 0, 3000)]
    got = {r.row_id: r for r in runs.collapse(df, "actions").collect()}
    assert got[0].actions is None and got[1].actions == [] and got[0]["_runs"] == "x"
    assert [(a["count"], a["duration_ms"]) for a in got[3].actions] == [(3, None), (1, 0)]
    assert [(a["count"], a["duration_ms"]) for a in got[4].actions] == [(1, 0), (2, 2000)]
    assert runs.repeated_runs(df.limit(0), "actions").count() == 0


def test_components_follow_ties(spark):
    data = [(1, " Ann", "t1", None, "train"), (2, "ann ", None, "j1", "test"), (3, None, None, "j1", "validation"), (4, "unknown", None, None, "test"), (5, "", "t9", None, "test"), (6, "bob", "t9", None, None), (7, None, None, None, "train"), (2, "ann", None, None, "test")]
    df = spark.createDataFrame(data, "row_id int, user_id string, task string, traj string, split string").withColumn("user", splits.person_key("user_id"))
    found = splits.components(df, ["row_id", "split"], ["user", "task", "traj"])
    labels = {r.row_id: r.component for r in found.collect()}
    assert labels[1] == labels[2] == labels[3] and labels[5] == labels[6] and len({labels[i] for i in (1, 4, 5, 7)}) == 4
    assert rows(splits.crossing(found), "row_id") == [(2,), (2,), (3,)]
    assert splits.components(df.limit(0), ["row_id"], ["user", "task"]).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = spark.createDataFrame([(f"p{i:03}", f"p{i + 1:03}") for i in range(200)] + [("hub", f"s{i}") for i in range(200)] + [("z", "z")], "a string, b string")
    labels = {r.vertex: r.label for r in splits.contract(edges).collect()}
    of = lambda v: labels.get(v, v)
    assert len({of(f"p{i:03}") for i in range(201)}) == 1 and len({of("hub"), *(of(f"s{i}") for i in range(200))}) == 1 and of("p000") != of("hub")


def test_assignment_keeps_components_whole_and_shares(spark):
    labelled = spark.range(4000).selectExpr("id", "cast(id % 700 as string) AS component", "'old' AS new_split")
    out = splits.assign(labelled, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert out.select("component", "new_split").distinct().count() == 700
    n = {r.new_split: r["count"] for r in out.groupBy("new_split").count().collect()}
    assert abs(n["train"] - 3200) < 40 and abs(n["test"] - 400) < 40


def test_top_n_against_sorting(spark):
    import math
    import random

    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", f"g{i % 9}", None]), rng.choice([f"c{rng.randrange(40)}", None]), rng.choice([None, math.nan, round(rng.random(), 1)]), rng.choice([None, rng.randrange(3)]), "x") for i in range(3000)]
    df = spark.createDataFrame(data, "g string, c string, s double, r int, _g string").repartition(5)
    got = rows(topn.top_n(df, 3, "g", "c", "s", "r"), "g", "place", "c", "s")
    groups = {}
    for g, c, s, r, _ in data:
        if g is not None and s is not None and not math.isnan(s):
            groups.setdefault(g, []).append((-s, math.inf if r is None else r, c is None, c or "", c, s))
    exp = []
    for g, own in groups.items():
        seen = []
        for x in sorted(own, key=lambda x: x[:4]):
            if x[4] not in [y[4] for y in seen]:
                seen.append(x)
        exp += [(g, i + 1, x[4], x[5]) for i, x in enumerate(seen[:3])]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(got, key=key) == sorted(exp, key=key)
    assert topn.top_n(df.limit(0), 3, "g", "c", "s", "r").count() == 0


def test_answer_defects(spark):
    ask = "Profile: x.\n- an old line\nWhat now? Answer in one English sentence."
    sound = [f"Open Zorby and cook the {x} soup before 0{i}:10, {i} in all." for i, x in enumerate(["red", "big", "hot", "new"])]
    texts = [*sound, sound[0][:-1], "Open Zorby and cook the red so", "Open Zorby and cook the big soup before 02:10,", None, "", "​ ...", "> what now? ANSWER in one English sentence", "Profile: x. What now? Answer in one English sentence.",
             "I'm sorry, but I can't help with that.", "Tell Ann that I'm sorry I cannot come at 10:10.", "Quiero cocinar la sopa para la cena de las 10.", 'Write "no puedo ir a la cena" to Ann and set it for 02:10, 3 in all.', sound[0]]
    df = spark.createDataFrame([(i, t, ask, "z") for i, t in enumerate(texts)] + [(99, "Fine by me.", None, "z")], "row_id int, answer string, asked string, masked string")
    got = dict(rows(answers.defects(df, ["row_id"], "answer", "asked"), "row_id", "defect"))
    assert got == {5: "truncated", 6: "truncated", 7: "empty", 8: "empty", 9: "empty", 10: "copied", 11: "copied", 12: "refusal", 14: "other_language"}
    assert answers.defects(df.limit(0), ["row_id"], "answer", "asked").count() == 0


def test_overlaps_against_brute_force(spark):
    import random

    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("zo", "mi", "ka", "ru") for b in ("ta", "le", "so") for c in ("n", "rk", "p")]
    base = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(120)] + ["打开应用在" + "".join(rng.choice("山川河海风云雷雨春夏秋冬") for _ in range(25)) for _ in range(60)]
    data = []
    for i, text in enumerate(base):
        for j in range(3):
            t = list(text)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice("abcxyz")
            data.append((0, f"r{i}_{j}", "".join(t), rng.choice(["train", "test", "validation", None])))
    data += [(0, None, base[0], "train"), (0, "n1", None, "train"), (0, "n2", "?!", "test"), (0, "n3", "", "train"), (1, "o1", base[0], "test"), (0, "dup", base[0].upper(), "train"), (0, "dup", base[0], "train")]
    df = spark.createDataFrame(data, "grp int, id string, text string, split string")
    got = set(rows(overlap.overlaps(df), "grp", "train_id", "held_id"))

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(prev[j - 1] if x == y else 1 + min(prev[j - 1], prev[j], cur[-1]))
            prev = cur
        return prev[-1]

    import pyarrow as pa

    from pathloom.llm.charform import convert

    red = convert(pa.array([d[2] for d in data], pa.string()), "reduce").to_pylist()
    exp = set()
    for (g, i, _, s), a in zip(data, red):
        for (h, j, _, u), b in zip(data, red):
            if g == h and s == "train" and u in ("test", "validation") and i and j and i != j and a and b and abs(len(a) - len(b)) <= max(len(a), len(b)) // 10 and lev(a, b) <= max(len(a), len(b)) // 10:
                exp.add((g, i, j))
    assert not got - exp and len(exp - got) <= 0.01 * len(exp) and len(exp) > 50
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_variants_and_copies(spark):
    data = [(1, "Open it"), (2, "Ｏpen it"), (3, "Open it"), (4, "open it"), (5, "Open it"), (6, None), (7, ""), (8, "..."), (9, "…"), (10, "OPEN-IT!"), (11, "Other")]
    df = spark.createDataFrame([(*d, "k", 1) for d in data], "row_id bigint, intent string, _key string, n_copies int")
    assert rows(variants.variant_pairs(df, "intent"), "id_a", "id_b") == [(1, 2), (1, 3), (2, 3), (2, 5), (3, 5)]
    assert rows(dedup.copies(df, "intent", "row_id"), "keep_id", "copy_id") == [(1, i) for i in (2, 3, 4, 5, 10)]
    assert {r.row_id: r.n_copies for r in dedup.deduplicated(df, "intent", "row_id").collect()} == {1: 6, 6: 1, 7: 1, 8: 1, 9: 1, 11: 1}
    assert dedup.copies(df.limit(0), "intent", "row_id").count() == 0


def test_record_copies(spark):
    a = {"u": "Ann É", "n": 1, "d": {"x": [1, "b\tc"], "y": None}}
    texts = [json.dumps(a), json.dumps({"d": {"y": None, "x": [1.0, "B, c"]}, "n": 1, "u": "ann é"}, indent=2, ensure_ascii=False), json.dumps({**a, "n": 2}), json.dumps({**a, "n": "1"}), json.dumps({**a, "d": {"x": ["b\tc", 1], "y": None}}), "ERR " + json.dumps(a), None, "", "[" * 5000, json.dumps(a)]
    df = spark.createDataFrame(list(enumerate(texts)), "line_id bigint, payload string")
    assert rows(dedup.record_copies(df, "payload", "line_id"), "keep_id", "copy_id") == [(0, 1), (0, 9)]


def test_encoding_equals_the_tokenizer(spark):
    import random

    rng = random.Random(2)
    texts = [None, "", " ", "it's  fine!'s ok\n\n 'll", "中文，标点。　Ａb", "a" * 20000, "👩‍🔬 x"] + ["".join(rng.choice(" \n 　'ab1é中。!sll") for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    coder = encode.encoder(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken").coder
    got = {r.doc_id: (r.ids, r.n) for r in df.select("doc_id", encode.token_ids("text").alias("ids"), encode.token_count("text").alias("n")).collect()}
    assert got == {i: (ids := coder.encode_ordinary(t or ""), len(ids)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("window", [50, 100_000])
def test_packing(spark, window):
    import random

    rng = random.Random(4)
    sizes = {i: rng.choice([None, 0, 1, rng.randrange(1, 100), rng.randrange(1, 60), 250]) for i in range(600)}
    df = spark.createDataFrame([(i, n, 7) for i, n in sizes.items()], "doc_id bigint, n int, size int")
    out = packing.containers(df, "doc_id", "n", capacity=100, window=window).collect()
    by, of = {}, {}
    for r in out:
        by.setdefault(r.container, []).append((r.start, r.size))
        of.setdefault(r.item, []).append((r.part, r.size))
    assert {i: sum(n for _, n in v) for i, v in of.items()} == {i: n or 0 for i, n in sizes.items()}
    assert all(len(v) == (3 if sizes[i] == 250 else 1) for i, v in of.items())
    for own in by.values():
        end = 0
        for start, n in sorted(own):
            assert start == end
            end += n
        assert end <= 100
    total = sum(n or 0 for n in sizes.values())
    assert len([1 for own in by.values() if sum(n for _, n in own)]) <= total / 100 * 1.02 + 2
    assert packing.containers(df.limit(0), "doc_id", "n").count() == 0


def test_fill_finds_the_best_sum():
    assert sum(k * v for k, v in packing.fill({7: 3, 5: 2, 4: 1}, 23).items()) == 23
    assert sum(k * v for k, v in packing.fill({9: 1, 8: 5}, 30).items()) == 25
    assert packing.fill({}, 5) == {} and packing.fill({9: 2}, 5) == {}


def test_subjects(spark):
    things = {"food": ["soup", "noodle", "bread", "salad"], "sport": ["match", "goal", "coach", "race"], "health": ["pill", "clinic", "fever", "sleep"], "weather": ["rain", "wind", "storm", "fog"], "travel": ["train", "hotel", "ticket", "visa"]}
    shapes = ["We looked at the {} today.", "Nobody forgets a {}.", "The plan is about the {} now."]
    examples = [(s.format(x), k) for k, v in things.items() for x in v[:3] for s in shapes]
    neutral = "Then the user went back. The screen stayed grey."
    sample = [" ".join(shapes[j % 3].format(v[(i + j) % 4]) for j in range(4)) + " " + neutral for i in range(60) for v in things.values()]
    model = subjects.train(examples, sample)
    doc = " ".join(shapes[i % 3].format(x) for i, x in enumerate(["soup", "salad", "noodle", "bread", "goal"])) + " " + neutral
    data = [(1, doc), (2, None), (3, ""), (4, neutral), (5, '{"a": ["We looked at the goal today.", "Nobody forgets a pill."]}'), (6, " \n"), (7, "We looked at the race today. " * 3000)]
    df = spark.createDataFrame([(*d, "s") for d in data], "doc_id bigint, text string, subject string")
    assert rows(subjects.document_subjects(df, model, "doc_id", "text"), "doc_id", "subject") == [(1, "food"), (5, "health"), (5, "sport"), (7, "sport")]
    assert subjects.document_subjects(df.limit(0), model, "doc_id", "text").count() == 0
