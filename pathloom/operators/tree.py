"""Bounded transition trees over logged steps, level by level.

Steps have ``step_id, user_id, episode_id, step_index, time, app, state_key, intent_key, tokens,
action``, and may have ``rank`` (their place in their user's history) and ``eligible`` (whether they
may be retrieved). Each level is three equi joins (on app, state and intent) whose union is
de-duplicated, a score, and a window that keeps a few steps per path; the depth is unrolled, as
every node's candidates are cut to a few before the next level, and each level is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.text import jaccard
from pathloom.operators import treeindex
from pathloom.operators.causal import beside, top_k
from pathloom.operators.ranking import ranked
from pathloom.storage import cut

_STEP = ["step_id", "user_id", "episode_id", "step_index", "time", "app", "state_key", "intent_key", "tokens", "action", "rank"]
#: Where an edge comes from, in the order in which sources are named and examples chosen.
SOURCES = ("observed_path", "same_user", "cross_user")


def step_similarity(a: str, b: str) -> Column:
    """Two points for the app, three for the state, one for the intent, and the overlap of tokens."""
    same = lambda c, w: F.when(F.coalesce(F.col(f"{a}.{c}"), F.lit("")) == F.coalesce(F.col(f"{b}.{c}"), F.lit("")), w).otherwise(0.0)
    intent = F.when((F.col(f"{a}.intent_key") != "") & (F.col(f"{a}.intent_key") == F.col(f"{b}.intent_key")), 1.0).otherwise(0.0)
    return same("app", 2.0) + same("state_key", 3.0) + F.coalesce(intent, F.lit(0.0)) + F.coalesce(jaccard(F.array_distinct(F.col(f"{a}.tokens")), F.array_distinct(F.col(f"{b}.tokens"))), F.lit(0.0))


def _retrieved(frontier: DataFrame, steps: DataFrame, same_k: int, cross_k: int, visible: Column | None) -> DataFrame:
    """Per path of the frontier the most similar earlier steps of the root's user and of others.

    The user's own steps are earlier by rank, those of others by time; only steps with a following one are met.
    """
    able = steps.where("eligible AND _next IS NOT NULL")
    met = None
    for block in ("app", "state_key", "intent_key"):
        part = frontier.select("path_id", F.col(f"proxy.{block}").alias("_k")).join(able.select(F.col(block).alias("_k"), "step_id"), "_k").where(F.coalesce(F.col("_k"), F.lit("")) != "").select("path_id", "step_id")
        met = part if met is None else met.unionByName(part)
    own = frontier.select("path_id", "root", "proxy")
    pairs = met.distinct().join(own, "path_id").join(able.select("step_id", F.struct(*_STEP).alias("cand")), "step_id")
    name = lambda s: F.coalesce(F.col(f"{s}.user_id"), F.lit(""))
    same = name("cand") == name("root")
    earlier = F.when(same, F.col("cand.rank") < F.col("root.rank")).otherwise((F.coalesce(F.col("root.time"), F.lit("")) == "") | (F.coalesce(F.col("cand.time"), F.lit("")) < F.col("root.time")))
    pairs = pairs.where(earlier & (F.col("cand.step_id") != F.col("proxy.step_id")))
    if visible is not None:
        pairs = pairs.where(visible)
    scored = pairs.select("path_id", "cand", F.when(same, SOURCES[1]).otherwise(SOURCES[2]).alias("source"), (step_similarity("proxy", "cand") + F.when(same, 0.25).otherwise(0.0)).alias("score"))
    order = [F.col("score").desc(), F.col("cand.rank").desc(), F.col("cand.step_id")]
    best = top_k(scored, ["path_id", "source"], order, max(same_k, cross_k), "_n")
    return best.where(F.col("_n") <= F.when(F.col("source") == SOURCES[1], same_k).otherwise(cross_k)).select("path_id", "source", "_n", "cand.step_id", "cand.action")


def _merged(frontier: DataFrame, retrieved: DataFrame, most: int) -> DataFrame:
    """One edge per path and action: support, sources, example step; the observed one first."""
    seen = frontier.select("path_id", F.lit(SOURCES[0]).alias("source"), F.lit(0).alias("_n"), "proxy.step_id", "proxy.action")
    place = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    edges = seen.unionByName(retrieved).where("action IS NOT NULL AND action <> ''").withColumn("_s", place).groupBy("path_id", "action").agg(
        F.count(F.lit(1)).alias("support"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_s", "source"))), lambda x: x.source), "+").alias("source"),
        F.min(F.struct("_s", "_n", "step_id")).alias("e"),
    )
    place = F.row_number().over(W.partitionBy("path_id").orderBy(F.col("e._s") > 1, F.col("support").desc(), "action"))
    return edges.withColumn("place", place).where(F.col("place") <= most).select("path_id", "action", "support", "source", F.col("e.step_id").alias("example"), "place")


def _followed(steps: DataFrame) -> DataFrame:
    """Steps with the id of the following one of their episode."""
    return beside(steps, ["episode_id"], [F.col("step_index"), F.col("step_id")], {"_after": "step_id"}).withColumn("_next", F.when(F.col("episode_id").isNotNull(), F.col("_after"))).drop("_after")


def expand(roots: DataFrame, steps: DataFrame, depth: int = 3, same_k: int = 2, cross_k: int = 2, most: int = 4, visible: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``edges(root_id, node, depth, action, support, source, example)`` and ``leaves(root_id, leaf, actions)``.

    A node is named by the places taken on the way to it, so names sort in depth-first order.
    ``visible`` is a condition on ``root`` and ``cand`` (for instance: train steps, or the root's own episode).
    Without one, and with a shared folder that workers can map, trees are grown from an index of the
    steps (:mod:`pathloom.operators.treeindex`); else candidates are joined level by level.
    """
    if "rank" not in steps.columns:
        steps = ranked(steps, ["user_id"], [F.col(c) for c in ("time", "episode_id", "step_index", "step_id")])
    if "eligible" not in steps.columns:
        steps = steps.withColumn("eligible", F.lit(True))
    folder = treeindex.local_folder(steps.sparkSession)
    if visible is None and folder:
        chosen, index = treeindex.built(treeindex.slim(steps), roots, folder)
        n = chosen.count()
        chosen = chosen.repartition(max(12, -(-n // treeindex.ROOTS)))
        return tuple(treeindex.grown(chosen, index, SOURCES, leaves, depth, same_k, cross_k, most) for leaves in (False, True))
    steps = cut(_followed(steps.select(*_STEP, "eligible")), "steps")
    record = F.struct(*_STEP)
    frontier = steps.join(roots.select("step_id"), "step_id", "left_semi").select(F.col("step_id").alias("root_id"), F.concat("step_id", F.lit(":")).alias("path_id"), record.alias("root"), record.alias("proxy"), F.array().cast("array<string>").alias("actions"))
    following = steps.select(F.col("step_id").alias("example"), "_next")
    proxies = steps.select(F.col("step_id").alias("_next"), record.alias("_proxy"))
    edges, leaves = None, None
    for level in range(depth):
        own = _merged(frontier, _retrieved(frontier, steps, same_k, cross_k, visible), most)
        level_edges = cut(own.join(frontier.select("path_id", "root_id", "root", "actions"), "path_id").join(following, "example", "left").join(proxies, "_next", "left"), "level")
        part = level_edges.select("root_id", F.col("path_id").alias("node"), F.lit(level).alias("depth"), "action", "support", "source", "example")
        edges = part if edges is None else edges.unionByName(part)
        moved = level_edges.select("root_id", F.concat("path_id", F.col("place").cast("string"), F.lit(".")).alias("path_id"), "root", F.col("_proxy").alias("proxy"), F.concat("actions", F.array("action")).alias("actions"))
        ends = moved if level + 1 == depth else moved.where("proxy IS NULL")
        done = ends.select("root_id", F.col("path_id").alias("leaf"), "actions")
        leaves = done if leaves is None else leaves.unionByName(done)
        frontier = moved.where("proxy IS NOT NULL")
    return edges, leaves


def leaf_scores(leaves: DataFrame, actions: str, target: str, habits: str, path_sources: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Verifier score of leaves: target and order match, the user's habits, few edges of others.

    ``habits`` maps actions to counts (null or empty: unknown, scored 0.5); ``path_sources`` is a list of source tags.
    """
    from pathloom.functions.sequence import lcs_ratio, positional_matches

    w = {"target": 0.35, "order": 0.25, "habit": 0.25, "avoid": 0.15} | (weights or {})
    a, n = F.col(actions), F.size(actions)
    goal = F.slice(F.col(target), 1, F.greatest(n, F.lit(1)))
    top = F.array_max(F.map_values(habits))
    habit = F.when((F.coalesce(top, F.lit(0)) > 0) & (n > 0), F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(F.col(habits), x).cast("double"), F.lit(0.0)) / top) / n).otherwise(0.5)
    crossed = F.size(F.filter(path_sources, lambda s: F.contains(s, F.lit("cross_user"))))
    out = leaves.withColumn("target_score", F.when(n > 0, positional_matches(a, goal) / n).otherwise(0.0)).withColumn("order_score", lcs_ratio(a, goal)).withColumn("habit_score", habit).withColumn("avoid_score", 1.0 - crossed / F.greatest(F.size(path_sources), F.lit(1)))
    return out.withColumn("score", sum((w[k] * F.col(f"{k}_score") for k in ("target", "order", "habit", "avoid")), F.lit(0.0)))
