import pytest
from pyspark.sql import functions as F

from pathloom.operators import evaluation, exports, retrieval, tree


def test_pools_are_causal_and_capped(spark):
    rows = [(f"t{i}", f"u{i % 3}", f"203001{i + 1:02}_100000", "home", f"open mail number {i % 4} now", "mail" if i % 2 else "food", "App", ) for i in range(12)]
    df = spark.createDataFrame(rows, "task_id string, user_id string, time string, scenario string, intent string, intent_class string, app string")
    out = retrieval.retrieval_pools(df, df, cap=3).collect()
    time = {r[0]: r[2] for r in rows}
    user = {r[0]: r[1] for r in rows}
    assert out and all(r.source_time < time[r.task_id] for r in out)
    assert all((r.source_user_id == user[r.task_id]) == r.relation.startswith("same_user") for r in out)
    per, used = {}, {}
    for r in out:
        per[r.task_id, r.relation] = per.get((r.task_id, r.relation), 0) + 1
        used[r.relation, r.key] = used.get((r.relation, r.key), 0) + 1
    assert max(per.values()) <= 2 and max(used.values()) <= 3 and len({(r.task_id, r.key) for r in out}) == len(out)


def test_tree_expansion(spark):
    rows = [(f"{e}_{i}", u, e, i, t, "App", s, "mail", ["x"], a) for e, u, t in (("e1", "u", "01"), ("e2", "u", "02"), ("e3", "v", "02"), ("e4", "u", "03")) for i, (s, a) in enumerate([("s0", "tap"), ("s1", "type" if e == "e3" else "go"), ("s2", "end")])]
    steps = spark.createDataFrame(rows, "step_id string, user_id string, episode_id string, step_index int, time string, app string, state_key string, intent_key string, tokens array<string>, action string")
    roots = spark.createDataFrame([("e4_0",)], "step_id string")
    edges, leaves = tree.expand(roots, steps, depth=3)
    first = {r.action: r for r in edges.where("depth = 0").collect()}
    assert "tap" in first and "observed_path" in first["tap"].source and first["tap"].support >= 2
    got = {tuple(r.actions) for r in leaves.collect()}
    assert ("tap", "go", "end") in got and ("tap", "type", "end") in got and all(len(p) <= 3 for p in got)
    assert edges.where("example LIKE 'e4%' AND source NOT LIKE '%observed%'").count() == 0
    scored = tree.leaf_scores(spark.createDataFrame([(["a", "b"], ["a", "c"], {"a": 4, "b": 2}, ["observed_path", "cross_user"]), (["a"], ["a"], None, [])], "p array<string>, t array<string>, h map<string,int>, s array<string>"), "p", "t", "h", "s").collect()
    assert scored[0].score == pytest.approx(0.35 * 0.5 + 0.25 * 0.5 + 0.25 * 0.75 + 0.15 * 0.5) and scored[1].score == pytest.approx(0.35 + 0.25 + 0.125 + 0.15)


def test_review_history_and_classes(spark):
    df = spark.createDataFrame([("a", "g", 0.5), ("b", "g", 0.3), ("c", "g", 0.2)], "c string, g string, p double")
    yes = spark.createDataFrame([("b", "drop_x")], "c string, d string")
    assert {r.c: round(r.p, 6) for r in retrieval.apply_review(df, yes, "c", "g", "d", "p", ("drop_x",)).collect()} == {"a": round(5 / 7, 6), "c": round(2 / 7, 6)}
    with pytest.raises(ValueError):
        retrieval.apply_review(df, spark.createDataFrame([("zz", "keep")], "c string, d string"), "c", "g", "d", "p", ())
    h = spark.createDataFrame([([("2", "b"), ("1", "a"), ("3", "c")],)], "h array<struct<time string, x string>>")
    pick = lambda c: [y.x for y in h.select(retrieval.history_condition(F.col("h"), c).alias("r")).first().r]
    assert (pick("recent"), pick("stale"), pick("truncated"), pick("none"), pick("full")) == (["c"], ["a"], ["a", "b"], [], ["b", "a", "c"])
    lent = retrieval.donors(spark.range(100).selectExpr("id", "id % 5 u"), "id", "u", 1, 4).join(spark.range(100).selectExpr("id donor", "id % 5 du"), "donor").where("id % 5 = du")
    assert lent.count() == 0


def test_evaluation(spark):
    df = spark.createDataFrame([("m", ["a", "b"], ["a", "b"], ["c"], True), ("m", ["a"] * 6, ["a", "b"], [], True), ("m", [], ["a"], None, True)], "k string, a array<string>, g array<string>, o array<string>, s boolean")
    r = evaluation.execution_metrics(df, ["k"], "a", "g", "o", "s").first()
    assert (r.n_evaluated, r.success, r.step_ratio_of_successes) == (2, 0.5, 1.0)
    p = spark.createDataFrame([("l", "abc", "abc"), ("l", "", "x"), ("l", "ab", "cd")], "k string, t string, p string")
    r = evaluation.proactive_metrics(p, ["k"], "t", "p").first()
    assert (r.n_rows, r.n_evaluated, r.similarity) == (3, 2, 0.5)
    s = p.select(evaluation.generation_scores("p", "t").alias("s")).collect()
    assert s[0].s.rougel == 1.0 and s[2].s.rouge1 == 0.0 and s[1].s.bleu4 == 0.0 and s[0].s.bleu4 == pytest.approx(1.0)
    acc = spark.createDataFrame([("x", "A", "A"), ("y", "A", "B")], "c string, p string, l string")
    assert {r.c: r.accuracy for r in evaluation.accuracy_by_category(acc, "c", "p", "l").collect()} == {"x": 1.0, "y": 0.0, "average": 0.5}
    logs = spark.createDataFrame([("loss: nan",), ("CUDA out of memory",), ("fine information",)], "value string")
    assert sorted(r.kind for r in evaluation.log_anomalies(logs).collect()) == ["not_finite", "out_of_memory"]


def test_exports(spark):
    df = spark.createDataFrame([("g", f"c{i}", f"t{i}", "oracle" if i == 1 else "model", p) for i, p in enumerate([0.2, 0.5, None, 0.1, 0.05])] + [("h", "d", "t", "oracle", 1.0), ("k", "e", "t", "model", 0.5), ("k", "f", "t", "model", 0.5), (None, "x", "t", "oracle", 1.0)], "g string, c string, t string, s string, p double")
    rows = exports.grouped(df, "g", "c", "t", "s", "p").collect()
    assert len(rows) == 1 and rows[0].oracle_index == 0 and [c.candidate_id for c in rows[0].candidates] == ["c1", "c0", "c3", "c4"] and sum(rows[0].target_distribution) == pytest.approx(1)
    sft = exports.sft_rows(spark.createDataFrame([(1, "q", "a", ["/r/x.png"]), (2, "q", " ", [])], "i int, q string, a string, m array<string>"), "i", F.col("q"), F.col("a"), F.col("m"), "/r", "sys").collect()
    assert len(sft) == 1 and sft[0].images == ["x.png"] and [m.content for m in sft[0].messages] == ["sys", "<image>q", "a"]
