import difflib
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import actions, scores, sequence, text, vectors
from pathloom.operators import causal, preference, quality, ranking, sampling, stats, training
from pathloom.sources import readers, screens, sinks


def value(spark, column, **cells):
    schema = T.StructType([T.StructField(k, t) for k, (_, t) in cells.items()])
    return spark.createDataFrame([tuple(v for v, _ in cells.values())], schema).select(column.alias("x")).first().x


S, A = T.StringType(), T.ArrayType(T.StringType())


def test_list_similarity_against_a_table(spark):
    rng = random.Random(1)
    data = [([rng.choice(["tap", "tap it", "go", "", None]) for _ in range(rng.randrange(6))], [rng.choice(["tap", "tap it", "go", "x"]) for _ in range(rng.randrange(6))]) for _ in range(120)] + [([], []), (["a"], [])]
    got = spark.createDataFrame(data, "a array<string>, b array<string>").select("a", "b", sequence.levenshtein_similarity(F.col("a"), F.col("b")).alias("s"), sequence.lcs_ratio(F.transform("a", lambda x: F.coalesce(x, F.lit(""))), F.col("b")).alias("l")).collect()
    for r in got:
        a, b = [x or "" for x in r.a], r.b
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        c = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                c[i][j] = c[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(c[i - 1][j], c[i][j - 1])
        exp = 1.0 if not a and not b else 0.0 if not a or not b else 1 - d[-1][-1] / max(len(a), len(b))
        assert math.isclose(r.s, exp) and math.isclose(r.l, c[-1][-1] / len(a) if a and b else 0.0)


def test_text_keys_and_ratios(spark):
    assert value(spark, text.key_compact(F.col("t")), t=("　A b\t", S)) == "ab"
    assert value(spark, text.key_alnum(F.col("t")), t=("Ａ-ß 1!", S)) == "ass1" and value(spark, text.key_alnum(F.col("t")), t=(None, S)) == ""
    for a, b in (("tide", "diet"), ("diet", "tide"), ("", ""), ("x" + "ab" * 150, "y" + "ab" * 150)):
        assert value(spark, text.matching_ratio("a", "b"), a=(a, S), b=(b, S)) == difflib.SequenceMatcher(None, a, b).ratio()
    assert value(spark, text.bigrams(F.col("t")), t=("abab", S)) == ["ab", "ba"] and value(spark, text.bigrams(F.col("t")), t=("a", S)) == ["a"] and value(spark, text.bigrams(F.col("t")), t=("", S)) == []
    assert value(spark, text.structural_defects(F.col("t")), t=("aaaaaaab�\x01", S)) == ["replacement_character", "control_character", "dominant_character"]
    assert value(spark, text.prompt_parts(F.col("t")), t=("[system] be kind\n[user] hi", S)).asDict() == {"system": "be kind", "user": "hi"}
    assert value(spark, text.merge_sources(F.col("a"), F.col("b")), a=("x+y", S), b=(" y + z", S)) == "x+y+z"
    assert value(spark, text.tail_ideographs(F.col("t"), 3), t=("打开a闹钟吧", S)) == "闹钟吧"
    assert value(spark, text.success_in(F.col("t"), F.array(F.lit("a")), F.array(F.lit("q"), F.lit("b")), F.array(F.lit("z"))), t=("ab", S)) is True
    assert value(spark, text.success_in(F.col("t"), *[F.array().cast("array<string>")] * 3), t=("ab", S)) is False


def test_scores(spark):
    assert value(spark, scores.hour_similarity(F.col("a"), F.col("b")), a=("20300101_230000", S), b=("20300101_010000", S)) == pytest.approx(1 - 2 / 12)
    assert value(spark, scores.hour_similarity(F.col("a"), F.col("b")), a=("bad", S), b=("20300101_010000", S)) == 0
    assert value(spark, scores.sigmoid(F.col("x")), x=(-800.0, T.DoubleType())) == 0 and value(spark, scores.sigmoid(F.col("x")), x=(0.0, T.DoubleType())) == 0.5
    with pytest.raises(ValueError):
        scores.evidence(F.lit(1.0), 0.2, "other")
    assert tuple(value(spark, scores.budget_split(F.lit(80), F.lit(60), 100))) == (58, 42)
    assert tuple(value(spark, scores.budget_split(F.lit(90), F.lit(20), 100))) == (80, 20) and tuple(value(spark, scores.budget_split(F.lit(10), F.lit(200), 100))) == (10, 90)
    d = T.ArrayType(T.DoubleType())
    assert value(spark, vectors.cosine(F.col("a"), F.col("b")), a=([1.0, 1.0], d), b=([0.0, 0.0], d)) == 0


def test_actions(spark):
    got = value(spark, actions.parse_action(F.col("t")), t=("Click(coordinates=(3, -4), content='Go')", S))
    assert (got.action_type, got.valid, got.x, got.y, got.content) == ("click", True, 3, -4, "Go")
    for call, error in (("click() wait()", "not_one_call"), ("type()", "nothing_to_type"), ("scroll(coordinates=(1, 2))", "no_direction"), ("click()", "no_place"), (None, "not_one_call")):
        got = value(spark, actions.parse_action(F.col("t")), t=(call, S))
        assert not got.valid and got.error == error
    tree = '<a><node text="Big" bounds="[0,0][100,100]" clickable="true"/><node class="x.Button" bounds="[10,10][20,20]" clickable="true"><node text=" O  K " bounds="[10,10][20,20]"/></node></a>'
    df = spark.createDataFrame([(tree,), ("<broken",), (None,)], "t string").select(screens.nodes("t").alias("n"))
    rows = df.select("n", actions.target_node(F.col("n"), F.lit(15), F.lit(15)).alias("hit"), actions.ui_signature(F.col("n")).alias("sig")).collect()
    assert [x.merged_text for x in rows[0].n] == ["Big", "", "O K"] and rows[0].hit["index"] == 1 and rows[0].sig.startswith("ui:") and rows[1].n == [] and rows[1].sig == "ui:empty" and rows[2].n is None
    assert value(spark, actions.region(F.lit(500), F.lit(1000))) == "center" and value(spark, actions.region(F.lit(None).cast("int"), F.lit(1))) == "unknown"
    assert [tuple(x) for x in value(spark, actions.affordances(F.col("t")), t=("search box\n\nplain\nbutton ok\nbutton ok", S))] == [("type", "search box"), ("click", "button ok")]


def test_causal_and_ranking(spark):
    rows = [("u", f"t{i:02}", i) for i in range(25)] + [("v", "t00", 99), (None, "t01", 100), (None, "t02", 101)]
    df = spark.createDataFrame(rows, "u string, t string, i int").repartition(5)
    got = {r.i: r["rank"] for r in ranking.ranked(df, ["u"], [F.col("t"), F.col("i")]).collect()}
    assert [got[i] for i in range(25)] == list(range(1, 26)) and got[99] == 1 and (got[100], got[101]) == (1, 2)
    part = {r.i: r.part for r in causal.latest_fraction_split(df, "u", [F.col("t"), F.col("i")], 0.1, 1).collect()}
    assert [i for i, p in part.items() if p == "eval" and i < 50] and sorted(i for i, p in part.items() if p == "eval") == [22, 23, 24, 101]
    pairs = causal.strict_past_pairs(df, df, ["u"], "t")
    assert pairs.where("t_ref >= t").count() == 0 and pairs.count() == 300
    assert "BroadcastNestedLoopJoin" not in pairs._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        causal.latest_fraction_split(df, "u", [F.col("t")], 1.5, 1)


def test_preference_invariants(spark):
    rows = [("g", f"c{i}", "oracle" if i == 0 else "model", 1.0 - i / 10, 0.1 * i) for i in range(5)] + [("h", "d0", "oracle", 0.5, 0.3), ("k", "e1", "model", 0.5, 0.0)]
    df = spark.createDataFrame(rows, "g string, c string, source string, r double, w double")
    pairs = preference.oracle_pairs(df, "g", "source", "c", "r", 0.1, 3, 0.1).collect()
    assert [(p.chosen, p.rejected) for p in sorted(pairs, key=lambda p: p.place)] == [("c0", "c2"), ("c0", "c3"), ("c0", "c4")]  # a gap equal to the margin is no pair
    new = preference.pro_rata_weights(df, "g", F.col("source") == "oracle", "w", 0.7).groupBy("g").agg(F.sum("new_weight").alias("s"))
    assert {r.g: round(r.s, 9) for r in new.collect()} == {"g": 1.0, "h": 1.0, "k": 0.3}
    wide = spark.createDataFrame([(1.0, 0.9, 0.95), (1.0, None, None), (1.0, -9.0, None)], "o double, s double, c double")
    for r in preference.clamped_policy(wide, "o", "s", "c", temperature=0.15, max_same=0.25, max_context=0.2, min_oracle=0.6, max_oracle=0.9).collect():
        assert sum(x or 0 for x in (r.o_probability, r.s_probability, r.c_probability)) == pytest.approx(1) and r.o_probability >= 0.6


def test_quality_gate(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, None, "Test"), (3, "", None)], "i int, t string, split string")
    found = quality.issues(df, ["i"], [("no_text", "block", F.coalesce(F.col("t"), F.lit("")) == ""), ("null_rule", "warn", F.col("t") == "zz")])
    assert sorted(tuple(r) for r in found.collect()) == [(2, "no_text", "block"), (3, "no_text", "block")]
    assert quality.verdict(found).first().passes is False and quality.verdict(found.limit(0)).first().passes is True
    with pytest.raises(Exception, match="test split"):
        quality.assert_no_test_split(df, "split").collect()


def test_statistics(spark):
    df = spark.createDataFrame([(float(i),) for i in [5, 1, 9, 3, 3, 7]], "v double").withColumn("k", F.lit(1))
    r = stats.lower_quantiles(df, ["k"], "v", [0.5, 0.9]).first()
    assert (r.q50, r.q90) == (3.0, 7.0)
    users = spark.range(400).selectExpr("id", "cast(id % 7 as double) v")
    b = stats.bootstrap_mean(users, "id", "v", 100).first()
    assert b.ci_low < b["mean"] < b.ci_high and b.ci_high - b.ci_low < 0.6
    a, c = users.withColumn("u", F.lit("x")), users.selectExpr("id", "v + 1 v", "'x' u").where("id < 300")
    p = stats.paired(a, c, "id", "v", "u").first()
    assert (p.n_paired, p.coverage_match, p.mean_improvement, p.win_rate) == (300, False, 1.0, 1.0)
    null = stats.null_space(spark.createDataFrame([(1, 1.0, 2.0, 1.0), (1, 2.0, 1.0, 1.0)], "s int, t double, p double, w double"), ["s"], "t", "p", "w").collect()
    assert sum(r.t * r.null_margin for r in null) == pytest.approx(0, abs=1e-6)


def test_training_rows(spark):
    chat = "array<struct<role string, content string>>"
    df = spark.createDataFrame([([("system", "s"), ("user", "q"), ("assistant", "a")],), ([("user", "q"), ("user", "r")],), ([],), (None,)], f"m {chat}")
    got = training.align_chat(df, "m").collect()
    assert [r.valid for r in got] == [True, False, False, False] and got[0].response == "a" and got[0].system == "s"
    sizes = [5, 9, 2, 4, 4, 30]
    packs = training.largest_first(sizes, 10)
    assert [[sizes[i] for i in p] for p in packs] == [[9], [5, 4], [4, 2]]
    assert value(spark, training.blocks(F.col("t"), 2), t=(["a", "b", "c"], A)) == [["a", "b"]]
    mixed = sampling.interleave({"a": spark.range(3), "b": spark.range(5)}, "id").orderBy("turn", "source").collect()
    assert [(r.source, r.turn) for r in mixed] == [(s, t) for t in (1, 2, 3) for s in "ab"]


def test_readers_and_sinks(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", A)])
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1, "b": ["x"]}\n\nbroken {\n{"a": 2}\n')
    got = readers.json_lines(spark, str(lines), schema).collect()
    assert [(r.a, r.json_error) for r in got] == [(1, False), (None, True), (2, False)]
    with pytest.raises(Exception):
        readers.json_lines_failfast(spark, str(lines), schema).collect()
    with pytest.raises(Exception, match="no JSON object"):
        readers.json_lines_strict(spark, str(lines), schema).collect()
    array = tmp_path / "y.json"
    array.write_text(json.dumps([{"a": 3}, {"a": 4}], indent=1))
    assert sorted(r.a for r in readers.json_any(spark, str(array), schema).collect()) == [3, 4]
    sheet = tmp_path / "z.csv"
    sheet.write_bytes('﻿user,n,l\nu,3.9,"[""p""]"\nv,bad,\n'.encode())
    rows = readers.typed(readers.csv_rows(spark, str(sheet)), integers=["n"], lists=["l"]).collect()
    assert [(r.user, r.n, r.l) for r in rows] == [("u", 3, ["p"]), ("v", 0, [])]
    assert readers.expanded({"p": ["${A:-x}/${B}"]}, {"B": "y"}) == {"p": ["x/y"]}
    out = str(tmp_path / "pred")
    assert sinks.append_new(spark.range(3), out, ["id"]) == 3 and sinks.append_new(spark.range(5), out, ["id"]) == 2 and spark.read.parquet(out).count() == 5
    tasks = spark.range(4).selectExpr("id", "10 - id AS o")
    merged = sinks.merge_shards(tasks, [spark.range(0, 2), spark.range(2, 4)], "id", "o")
    assert [r.id for r in merged.collect()] == [3, 2, 1, 0]
    with pytest.raises(ValueError, match="missing"):
        sinks.merge_shards(tasks, [spark.range(0, 2)], "id", "o")
    folder = str(tmp_path / "rel")
    sinks.release({"t": spark.range(3)}, folder, {"kind": "test"})
    sinks.verify_release(folder)
    with pytest.raises(FileExistsError):
        sinks.release({"t": spark.range(3)}, folder, {})
    name = next(iter(sinks.verify_release(folder)["files"]))
    with open(f"{folder}/{name}", "a") as f:
        f.write("x")
    with pytest.raises(ValueError):
        sinks.verify_release(folder)


def test_episode_folders(spark, tmp_path):
    for path in ("u1/20300101_000000/action.jsonl", "u1/20300101_000000/survey.json", "u1/20300101_000000/Screenshots_1/12.png", "u1/20300101_000000/Screenshots_1/tree_12.xml", "u1/20300102_000000/action.jsonl", "u2/20300101_000000/survey.json"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    files = screens.listing(spark, str(tmp_path))
    assert sorted((r.user_id, r.time) for r in screens.episodes(files).collect()) == [("u1", "20300101_000000"), ("u1", "20300102_000000")]
    assert [r.time for r in screens.episodes(files, complete=True).collect()] == ["20300101_000000"]
    seen = screens.observations(files).collect()
    assert len(seen) == 1 and seen[0].stamp == "12" and seen[0].screenshot and seen[0].tree


def test_streamed_predictions(spark, tmp_path):
    from pathloom.streaming import windows

    schema = T.StructType([T.StructField("task_id", S), T.StructField("at", T.TimestampType())])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"task_id": "a", "at": "2030-01-01T00:00:00"}\n{"task_id": "a", "at": "2030-01-01T00:00:00"}\n')
    for name in ("", "b"):
        if name:
            (tmp_path / "in/b.json").write_text('{"task_id": "b", "at": "2030-01-01T00:10:00"}\n')
        windows.append_once(windows.prediction_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"), ["task_id"], "at")
    assert sorted(r.task_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
