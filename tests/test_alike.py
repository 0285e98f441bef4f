import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pathloom.operators import alike, nearest


def texts(n):
    rng = random.Random(5)
    name = lambda k: "".join(rng.choice("bdgklmnprstz") + rng.choice("aeiou") for _ in range(k))
    forms = ["openthe{}settingsandtell{}before{}", "pleaseremind{}tobuy{}at{}oclock", "打开{}然后搜索{}并发送{}", "{}{}{}", ""]
    return [f.format(name(rng.randrange(1, 5)), name(rng.randrange(1, 5)), rng.randrange(60)) if (f := rng.choice(forms)) != "{}{}{}" else name(9) for _ in range(n)]


def test_searching_by_parts_finds_what_all_pairs_have(tmp_path, monkeypatch):
    monkeypatch.setattr(alike, "PART", 150)
    monkeypatch.setattr(alike, "PAIRS", 4000)
    monkeypatch.setattr(alike, "HEAVY", 20)
    n, rng = 1500, np.random.default_rng(2)
    keys = pa.array(texts(n))
    user, group, time = rng.integers(0, 40, n) ** 2 // 30, rng.integers(0, 3, n), np.zeros(n, np.int64)
    day = np.sort(rng.integers(-50, 400, n))  # rows of one day, undated ones first
    time[day >= 0] = np.searchsorted(day, day[day >= 0]) + 1
    folder = str(tmp_path)
    for name, values in (("row_id", np.arange(n)), ("u", user), ("a", group), ("time", time)):
        values.astype(np.int64).tofile(f"{folder}/{name}")
    data = [k.encode() for k in keys.to_pylist()]
    np.append(0, np.cumsum([len(k) for k in data])).astype(np.int64).tofile(f"{folder}/key.start")
    (tmp_path / "key").write_bytes(b"".join(data))
    np.zeros(n, np.int32).tofile(f"{folder}/centre")
    alike._centres(folder)
    alike._dealt(folder, 0, n)
    alike._parts(folder)
    parts = len(np.fromfile(f"{folder}/part", np.int64)) // 3
    assert parts > 5 and len(alike._Centres(folder).sets) > 3
    for p in range(parts):
        alike._indexed(folder, p)
    picked, looked = [], alike._picked
    monkeypatch.setattr(alike, "_picked", lambda some, *rest: (picked.append(len(some)), looked(some, *rest)))
    at, best, past = alike._found(folder, 0, n)
    assert sum(picked) > n / 4  # the way by candidates is taken
    owner, code = nearest.pair_sets(keys)
    rows = alike._dense(owner, code, n, np.unique(code)).astype(np.int64)
    size = rows.sum(axis=1)
    dice = 2.0 * (rows @ rows.T) / np.maximum(size[:, None] + size[None, :], 1)
    may = (user[:, None] != user[None, :]) & (group[:, None] != group[None, :])
    earlier = may & (time[None, :] > 0) & (time[None, :] < time[:, None])
    for found, mask in ((best, may), (past, earlier)):
        want = np.where(mask, dice, -1.0).max(axis=1)[at]
        assert np.allclose(found, want, atol=1e-12)


def test_other_group_shuffles_no_rows_to_blocks_and_an_empty_time_is_early(spark):
    rows = [(1, "u", "x", "", "opena"), (2, "v", "y", "t1", "openab"), (3, "w", "y", None, "openabc")]
    df = spark.createDataFrame(rows, "row_id bigint, user_id string, age string, time string, key string")
    found = nearest.best_of_other_group(df, "user_id", "age", "time", "key")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Aggregate" not in plan  # every row stood in as many blocks as there were
    got = {(r.row_id, r.mode): r.similarity for r in found.collect()}
    assert got == {(1, "any"): 0.888889, (2, "any"): 0.888889, (3, "any"): 0.8, (2, "past"): 0.888889}


def test_modes_are_put_together_from_sums_and_no_bigram_is_shuffled(spark):
    from pathloom.plans import task_queries

    found = task_queries.retrieval_modes_whole(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # of all modes at once, whose shuffles lay on disk together
    assert {r["mode"] for r in found.collect()} == {"same_user_top1", "same_user_no_same_intent", "cross_user_top1", "cross_user_strict_past", "random_same_user", "random_cross_user"}


def test_likeness_of_two_keys_is_that_of_their_bigrams(spark):
    from pathloom.functions import text

    rng = random.Random(3)
    keys = ["", "a", "ab", "aaaa", "打开", "打", *("".join(rng.choice("abc打") for _ in range(rng.randrange(9))) for _ in range(40))]
    pairs = spark.createDataFrame([(i * 100 + j, a, b) for i, a in enumerate(keys) for j, b in enumerate(keys)], "row_id bigint, key string, theirs string")
    want = pairs.select("row_id", F.round(text.dice(text.bigrams(F.col("key")), text.bigrams(F.col("theirs"))), 6).alias("similarity"))
    assert sorted(map(tuple, nearest.likeness(pairs, "row_id", "key", "theirs").collect())) == sorted(map(tuple, want.collect()))


def test_signatures_leave_few_references_to_be_scored():
    rng = np.random.default_rng(4)
    core, n = np.arange(1000, 1030), 600
    rows = [np.unique(np.append(core, rng.integers(0, 400, 25))) for _ in range(n)]
    outside = [r[r < 1000] for r in rows]
    owner = np.repeat(np.arange(n), [len(x) for x in outside])
    marks = alike._signatures(owner, np.concatenate(outside) % (64 * alike._words()), n)
    lost = sum(np.bitwise_count(has[None, :] & ~has[:, None]).astype(int) for has in marks)
    size = np.array([len(x) for x in outside])
    has = alike._dense(owner, np.concatenate(outside), n, np.arange(400))
    shared = (has @ has.T).astype(int)
    bound = size[None, :] - lost
    assert (bound >= shared).all()  # never left out wrongly
    assert (bound >= shared + 8).mean() < 0.02
