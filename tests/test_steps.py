from pyspark.sql import functions as F

from pathloom.operators import sampling, steps, training


def test_observations_match_by_time_then_by_place(spark):
    acts = spark.createDataFrame([("e", 0, "10"), ("e", 1, "99"), ("e", 5, "98")], "ep string, i int, ts string")
    seen = spark.createDataFrame([("e", "10", "a"), ("e", "20", "b"), ("f", "30", "c")], "ep string, ts string, shot string")
    got = {r.i: (r.shot, r.matched_by) for r in steps.matched_observations(acts, seen, "ep", "i", "ts", "shot").collect()}
    assert got == {0: ("a", "timestamp"), 1: ("b", "position"), 5: (None, "none")}


def test_flat_actions_and_metrics(spark):
    lines = spark.createDataFrame([("e", 2, '{"x": "c"}'), ("e", 1, '{"x": "a", "y": "b"}')], "ep string, i int, p string")
    assert steps.flat_actions(lines, "ep", "i", "p").first().actions == ["a", "b", "c"]
    assert steps.flattened_metrics({"a": {"b": 1, "c": {"d": 0.5}}, "e": "x", "f": True}) == [("a/b", 1.0), ("a/c/d", 0.5)]
    c = spark.range(1).select(steps.candidate_actions(F.array(F.lit("h1"), F.lit("h2")), F.array(F.lit("f")), F.array(F.lit("o"), F.lit("h2")), F.lit("x"), 5).alias("c")).first().c
    assert c == ["x", "f", "h2", "h1", "o"]


def test_resampling(spark):
    df = spark.range(10)
    for n in (0, 4, 10, 27):
        out = sampling.resampled(df, "id", n, 1)
        assert out.count() == n and (n == 0 or max(r["count"] for r in out.groupBy("id").count().collect()) <= -(-n // 10))
    assert sorted(r.id for r in sampling.at_positions(df, [F.col("id")], 2, 9, 3).collect()) == [2, 5, 8]


def test_token_batches(spark):
    sizes = {0: 5, 1: 5, 2: 9, 3: 30, 4: 1, 5: None}
    df = spark.createDataFrame(list(sizes.items()), "id bigint, n int")
    step = {r.id: r.step for r in training.token_batches(df, "id", "n", 12).collect()}
    assert step == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3}
    free = {r.id: r.step for r in training.token_batches(df, "id", "n", 12, padded=False).collect()}
    assert free == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3}
