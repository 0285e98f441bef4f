"""Candidate groups, neighbours, vectors and stored files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pathloom.functions import vectors
from pathloom.operators import causal, groups, stats, training, tree
from pathloom.sources import readers, sinks


def test_neighbours_cross_partitions_and_respect_keys(spark):
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'busy', concat('u', id % 7)) AS u", "id * 37 % 501 AS t", "cast(null as string) AS n")
    rows = df.collect()
    want = {}
    for user in {r.u for r in rows}:
        own = sorted((r.t, r.id) for r in rows if r.u == user)
        for k, (_, i) in enumerate(own):
            want[i] = (own[k - 1][1] if k else None, own[k + 2][1] if k + 2 < len(own) else None)
    before = {r.id: r.x for r in causal.beside(df, ["u"], [F.col("t"), F.col("id")], {"x": "id"}, -1).collect()}
    later = {r.id: r.x for r in causal.beside(df, ["u"], [F.col("t"), F.col("id")], {"x": "id"}, 2).collect()}
    assert {i: (before[i], later[i]) for i in want} == want
    assert causal.beside(df, ["n"], [F.col("id")], {"x": "id"}).where("x = id + 1").count() == 499
    assert causal.beside(df.limit(0), ["u"], [F.col("t")], {"x": "id"}).count() == 0


def test_quantiles_of_a_key_with_most_rows(spark):
    df = spark.range(999).selectExpr("if(id < 900, 'hot', 'cold') AS k", "cast(id * 7 % 901 as double) AS v").unionByName(spark.createDataFrame([("hot", None), ("none", None)], "k string, v double"))
    got = {r.k: r for r in stats.linear_quantiles(df, ["k"], "v", [0.5, 0.9]).collect()}
    for k in ("hot", "cold"):
        v = sorted(r.v for r in df.where(F.col("k") == k).collect() if r.v is not None)
        for q, p in (("q50", 0.5), ("q90", 0.9)):
            h = (len(v) - 1) * p
            assert math.isclose(got[k][q], v[math.floor(h)] + (v[math.ceil(h)] - v[math.floor(h)]) * (h - math.floor(h)))
    assert "none" not in got


def test_annotations_must_be_complete_and_single(spark):
    results = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "task string, ok double")
    notes = spark.createDataFrame([("a", 1.0, "Ann", "saw it")], "task string, ok double, annotator string, evidence string")
    assert sorted(map(tuple, groups.overridden(results, notes, "task", "ok", ["annotator", "evidence"]).select("task", "ok", "annotated").collect())) == [("a", 1.0, True), ("b", 1.0, False)]
    for bad in (notes.withColumn("evidence", F.lit(" ")), notes.unionByName(notes)):
        with pytest.raises(ValueError):
            groups.overridden(results, bad, "task", "ok", ["annotator", "evidence"])


def test_reject_reasons_in_order(spark):
    rows = [("abc", "p", "model", 1), ("ab\ufffdcd", "p", "model", 1), ("Open It", "please openit now", "model", 1), ("something", "p", "same_user", 1), ("something", "p", "model", 99), ("something", None, None, None), (None, "p", "model", 1)]
    df = spark.createDataFrame(rows, "a string, p string, s string, n int")
    got = [r.r for r in df.select(groups.reject_reason(F.col("a"), F.col("p"), F.col("s"), F.col("n"), history=("same_user",)).alias("r")).collect()]
    assert got == ["too_short", "replacement_character", "copied_from_prompt", "history_source", "too_frequent", None, "too_short"]


def test_resampling_and_null_actions(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 5 as double) / 2 AS w")
    drawn = groups.reweighted(df, "id", "w", 1)
    assert abs(drawn.count() - 4000) < 80 and drawn.where("w = 0").count() == 0 and drawn.where("w = 1 AND copy > 1").count() == 0
    pick = lambda a, k: spark.range(1).select(groups.null_actions(F.lit(a), ("tap:a", "wait", "tap:b"), F.lit(k), 2).alias("x")).first().x
    assert pick("tap:b", "tap") == ["tap:a", "wait"] and pick(None, "~") == ["tap:a", "wait"]


def test_pair_loss_is_finite_at_both_ends(spark):
    df = spark.createDataFrame([("k", 900.0, 1.0, 1.0), ("k", -900.0, 1.0, 1.0), ("k", None, 1.0, 1.0)], "k string, m double, t double, w double")
    r = training.pair_loss(df, ["k"], "m", "t", "w").first()
    assert r.n == 2 and r.accuracy == 0.5 and math.isclose(r.loss, -math.log(1e-12) / 2)


def test_vectors_without_a_driver(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0])], "id bigint, v array<double>")
    got = vectors.most_alike(df.where("id % 10 = 0"), df, "id", "v", 3, block=16).collect()
    rows = {r.id: r.v for r in df.collect()}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / max(1e-8, math.hypot(*a)) / max(1e-8, math.hypot(*b)), 5)
    for q in range(0, 60, 10):
        best = sorted(((-cos(rows[q], v), i) for i, v in rows.items() if i != q))[:3]
        assert [(i, -s) for s, i in best] == [(r.id, r.similarity) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
    words = spark.createDataFrame([("Ab ab!",), ("打开 应用",), (None,), ("  ",)], "t string").select(vectors.words(F.col("t")).alias("w"), vectors.hashed_embedding(vectors.words(F.col("t"))).alias("e")).collect()
    assert [r.w for r in words] == [["ab", "ab"], ["打开", "应用"], [], []] and [len(r.e) for r in words][:1] == [1] and words[2].e == []


def test_tree_meets_only_steps_that_go_on(spark):
    rows = [("a0", "u", "a", 0, "01", "", "s", "", ["x"], "tap"), ("a1", "u", "a", 1, "01", "", "z", "", None, "end"), ("b0", "v", "b", 0, "00", "", "s", "", ["x"], "type"), ("c0", "u", "c", 0, "02", "", "s", "", ["x"], "go"), ("c1", "u", "c", 1, "03", "", "y", "", [], None)]
    steps = spark.createDataFrame(rows, "step_id string, user_id string, episode_id string, step_index int, time string, app string, state_key string, intent_key string, tokens array<string>, action string")
    edges, leaves = tree.expand(steps.where("step_id = 'c0'"), steps)
    assert {(r.action, r.source) for r in edges.where("depth = 0").collect()} == {("go", "observed_path"), ("tap", "same_user")}
    assert sorted(tuple(r.actions) for r in leaves.collect()) == [("tap", "end")]


def test_stored_files(spark, tmp_path):
    folder = str(tmp_path / "release")
    with pytest.raises(ValueError, match="synthetic"):
        sinks.release({"t": spark.range(3)}, folder, {"synthetic": True})
    sinks.release({"t": spark.range(3)}, folder, {"synthetic": True}, synthetic=True)
    assert (tmp_path / "release/SHA256SUMS").read_text().count("\n") == len(sinks.verify_release(folder)["files"])
    (tmp_path / "conf.json").write_text(json.dumps({"a": "${NOT_SET_HERE:-x}"}))
    assert readers.load_config(str(tmp_path / "conf.json")) == {"a": "x"}
    assert readers.files(spark, folder + "/t").count() == 3
    sheet = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b")], "g string, id int, t string")
    sinks.write_review(sheet, str(tmp_path / "review"), "g", ["g", "id", "t"], ["g", "t"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "review/groups")).collect()] == [("g", "a", "2")]
    done = str(tmp_path / "done")
    spark.range(6).selectExpr("id", "id % 2 = 0 AS bad").write.parquet(done)
    assert sinks.evict_failed(spark, done, F.col("bad"), "id bigint, bad boolean") == 3 and spark.read.parquet(done).where("bad").count() == 0
