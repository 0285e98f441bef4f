import pytest

from pathloom.operators import components


def labels(spark, edges):
    return {r.run: r.component for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}


def test_chains_of_compared_runs_are_one_component(spark):
    chain = [(f"r{i:02}", f"r{i + 1:02}") for i in range(20)]
    scattered = [(f"s{7 * i % 23:02}", f"s{7 * (i + 1) % 23:02}") for i in range(22)]
    got = labels(spark, chain + scattered + [("x", "x"), ("y", None)])
    assert got == {f"r{i:02}": "r00" for i in range(21)} | {f"s{i:02}": "s00" for i in range(23)} | {"x": "x"}
    assert labels(spark, [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")]) == dict.fromkeys("ABCDE", "A")


def test_runs_of_a_component_keep_the_tasks_all_share(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "E")], "a string, b string")
    held = {"A": "1234", "B": "234", "C": "347", "D": "12", "E": "29", "F": "58"}
    tasks = spark.createDataFrame([(t, r) for r, ts in held.items() for t in ts] + [("3", "A")], "task string, run string")
    got = sorted({(r.run, r.task) for r in components.aligned(tasks, edges).collect()})
    assert got == [("A", "3"), ("A", "4"), ("B", "3"), ("B", "4"), ("C", "3"), ("C", "4"), ("D", "2"), ("E", "2"), ("F", "5"), ("F", "8")]
    with pytest.raises(ValueError):
        components.aligned(tasks.where("run <> 'B' OR task = '2'"), edges)
