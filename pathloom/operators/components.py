"""Connected components of the graph of compared runs, and the tasks that all runs of one share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.storage import cut

MAX_ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``run, component``: every run that is in an edge ``a, b``, with the least run of its component.

    Large and small stars by turns until the edges stay as they are: every run's greater neighbours
    move to its least neighbour, then so do the lesser ones, until each component is one star.
    """
    given = cut(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "compared")
    now = cut(given.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ends.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(low.select("a", F.col("m").alias("b")).unionByName(moved).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not converge in {MAX_ROUNDS} rounds")
    runs = given.select(F.explode(F.array("a", "b")).alias("run")).distinct()
    label = now.select(F.col("a").alias("run"), F.col("b").alias("component"))
    return runs.join(label, "run", "left").select("run", F.coalesce("component", "run").alias("component"))


def shared_tasks(found: DataFrame, tasks: DataFrame) -> DataFrame:
    """``component, task`` of the tasks that every run of a component has; ``found`` is of :func:`components`, ``tasks`` has ``run, task``."""
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    held = tasks.select("run", "task").distinct().join(found, "run").groupBy("component", "task").agg(F.count(F.lit(1)).alias("k"))
    return held.join(size, "component").where("k = n").select("component", "task")


def aligned(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """``tasks`` (with ``run, task``) of compared runs cut down to those their component shares; a run without comparison keeps all.

    A component whose runs share no task is an error.
    """
    found = cut(components(edges), "components")
    shared = cut(shared_tasks(found, tasks), "shared")
    bad = found.join(shared, "component", "left_anti").select("component").limit(1).collect()
    if bad:
        raise ValueError(f"runs compared share no task: component {bad[0][0]!r}")
    kept = tasks.join(found.join(shared, "component").select("run", "task"), ["run", "task"], "left_semi")
    return kept.select(*tasks.columns).unionByName(tasks.join(found.select("run"), "run", "left_anti").select(*tasks.columns))
