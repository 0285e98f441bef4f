import random

from pyspark.sql import functions as F

from pathloom.operators import tree


def test_trees_are_grown_without_a_row_per_pair_or_level(spark):
    rng = random.Random(11)
    pick = lambda *x: rng.choice(x)
    rows = [(f"s{i:02}", pick("u", "u", "v", "w", "", None), pick("e1", "e2", "e3", "e4", "e5", None), rng.randrange(6), pick("01", "02", "03", "", None), pick("App", "App", "", None), pick("p", "q", "", None), pick("k", "m", "n", "", None), pick(["x", "y", "x"], ["x"], ["z", "y"], [], None), pick("tap", "go", "type", "", None)) for i in range(60)]
    steps = spark.createDataFrame(rows, "step_id string, user_id string, episode_id string, step_index int, time string, app string, state_key string, intent_key string, tokens array<string>, action string")
    roots = steps.where("step_id < 's25'").select("step_id")
    edges, leaves = tree.expand(roots, steps, depth=2, same_k=2, cross_k=3)
    joined, ends = tree.expand(roots, steps, depth=2, same_k=2, cross_k=3, visible=F.lit(True))  # candidates as rows
    assert edges.dtypes == joined.dtypes and leaves.dtypes == ends.dtypes
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, joined.collect()))
    assert sorted((r[0], r[1], *r[2]) for r in leaves.collect()) == sorted((r[0], r[1], *r[2]) for r in ends.collect())
    assert edges.where("depth = 1").count() > 25
    for df in (edges, leaves):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_leaves_of_the_query_come_straight_from_the_index(spark, tmp_path):
    import datetime

    from pathloom.plans import tree_queries

    action = "struct<action_type string, target string, text string, bbox array<double>, raw struct<ts timestamp>>"
    rows = [(n, f"{e}{i}", u, e, [None] * i, datetime.datetime(2031, 1, 1 + day, i), f"s{i}", "Open the mail", "[button] mail", (f"{e}{i}", "x", None, None, None)) for n, (e, u, day, i) in enumerate((e, u, d, i) for e, u, d in (("a", "u", 0), ("b", "v", 1), ("c", "u", 2)) for i in range(3))]
    spark.createDataFrame(rows, f"row_id bigint, example_id string, user_id string, source_trajectory_id string, action_history array<{action}>, ingested_at timestamp, state_id string, instruction string, ui_tree string, current_action {action}").write.parquet(f"{tmp_path}/gui_step_examples.parquet")
    leaves = tree_queries.counterfactual_leaves(spark, str(tmp_path))
    assert "Join" not in leaves._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.leaf, r.path) for r in leaves.where("root_id = 'c0'").collect()}
    assert ("c0:1.1.1.", "c0:x>c1:x>c2:x") in got and any("a0:x>" in p for _, p in got) and any("b0:x>" in p for _, p in got)


def test_the_index_leaves_no_copies_of_the_steps_behind(spark):
    import os

    from pathloom.operators import treeindex

    folder = treeindex.local_folder(spark)
    steps = spark.createDataFrame([(f"s{i:04}", "u", f"e{i // 5}", i % 5, f"{i:04}", "", f"k{i % 50}", f"q{i % 90}", ["x", "y"], f"tap:{i % 7}", i) for i in range(2000)], "step_id string, user_id string, episode_id string, step_index int, time string, app string, state_key string, intent_key string, tokens array<string>, action string, rank int")
    before = set(os.listdir(folder))
    edges, _ = tree.expand(steps.select("step_id"), steps)
    made = sorted(x.split("-")[0] for x in set(os.listdir(folder)) - before)
    assert made == ["index", "roots"]  # cuts made on the way are gone
    index = next(x for x in set(os.listdir(folder)) - before if x.startswith("index"))
    files = [os.stat(f"{folder}/{index}/{x}") for x in os.listdir(f"{folder}/{index}")]
    assert sum(f.st_blocks * 512 for f in files) < 2000 * 120
    assert edges.where("depth = 0 AND source LIKE 'observed%'").count() == 2000


def test_a_shared_folder_named_without_a_scheme_is_mapped_too(spark, tmp_path, monkeypatch):
    from pathloom.operators import treeindex

    (tmp_path / "a b%20c").mkdir()
    monkeypatch.setattr(treeindex, "shared_dir", lambda _: f"{tmp_path}/a b%20c")
    assert treeindex.local_folder(spark) == f"{tmp_path}/a b%20c"
    steps = spark.createDataFrame([(f"s{i}", "u", "e", i, f"{i}", "", "k", "q", ["x"], f"tap:{i}") for i in range(6)], "step_id string, user_id string, episode_id string, step_index int, time string, app string, state_key string, intent_key string, tokens array<string>, action string")
    edges, _ = tree.expand(steps.select("step_id"), steps)
    assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert any(p.name.startswith("index") for p in (tmp_path / "a b%20c").iterdir())
    assert edges.where("depth = 0 AND source LIKE 'observed%'").count() == 6


def test_leaves_of_the_query_are_grown_from_an_index_in_a_folder_without_a_scheme(spark, tmp_path, monkeypatch):
    from pathloom import storage
    from pathloom.operators import treeindex
    from pathloom.plans import tree_queries

    shared = f"{tmp_path}/shared"
    for module in (storage, treeindex):
        monkeypatch.setattr(module, "shared_dir", lambda _: shared)
    action = "struct<action_type string, target string>"
    rows = [(i, f"a{i}", "u", "e", [None] * i, "s", "Open the mail", "[button] mail", ("TAP", f"x{i}")) for i in range(4)]
    steps = spark.createDataFrame(rows, f"row_id bigint, example_id string, user_id string, source_trajectory_id string, action_history array<{action}>, state_id string, instruction string, ui_tree string, current_action {action}")
    steps.withColumn("ingested_at", F.expr("timestamp'2031-01-01 00:00:00' + make_interval(0, 0, 0, row_id)")).write.parquet(f"{tmp_path}/gui_step_examples.parquet")
    leaves = tree_queries.counterfactual_leaves(spark, str(tmp_path))
    assert "Join" not in leaves._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "shared").iterdir()) == ["index", "logged", "roots"]
    assert ("a1:1.1.1.", "tap:x1>tap:x2>tap:x3") in {(r.leaf, r.path) for r in leaves.collect()}
