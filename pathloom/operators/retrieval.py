"""Causal candidate pools, references, continuations and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import scores, text
from pathloom.operators.causal import frequency_cap, top_k
from pathloom.operators.pools import best_by_relation
from pathloom.operators.ranking import numbered
from pathloom.storage import cut

# Relations of a retrieved candidate to its task, in order of precedence.
RELATIONS = ("same_user_similar_intent", "same_user_similar_context_different_intent", "cross_user_similar_intent")
_FIELDS = ["task_id", "user_id", "time", "scenario", "intent", "intent_class", "app"]


def task_records(df: DataFrame) -> DataFrame:
    """Tasks with the key that pools compare and the hour of the day."""
    return df.select(*_FIELDS, text.key_alnum("intent").alias("key"), scores.hour(F.col("time")).alias("hour"))


def retrieval_pools(targets: DataFrame, references: DataFrame, *, generic_apps: tuple[str, ...] = (), most: int = 2, least: float = 0.20, positive: float = 0.35, context_most: float = 0.75, pseudo: float = 0.55, cap: int | None = None) -> DataFrame:
    """Earlier tasks of the same and of other users as candidates, per relation the best few.

    Candidates meet by user, class and app in blocks (:mod:`pathloom.operators.pools`), never as rows;
    within a task a text is kept at its first relation, and over all tasks a text is used at most
    ``cap`` times per relation (by default 10, or half a percent of the tasks if that is more).
    A ``task_id`` names one target and one reference.
    """
    named = F.coalesce((F.col("app") != "") & ~F.col("app").isin(*generic_apps), F.lit(False))
    t = cut(task_records(targets).drop("intent").withColumn("named", named), "targets")
    r = cut(numbered(task_records(references).where("key <> '' AND time <> ''"), [F.col("time"), F.col("task_id")], "place"), "references")
    n = t.count()
    pool = best_by_relation(t.where("time IS NOT NULL"), r.drop("intent"), n, r.count(), most=most, least=least, positive=positive, context_most=context_most)
    listwise = (F.col("relation") == 1) & (F.col("similarity") >= positive)
    few = top_k(pool, ["task_id", "relation"], [listwise.desc(), F.col("score").desc(), F.col("place").desc()], most)
    kept = few.join(r.select("place", "key", F.col("intent").alias("text"), F.col("task_id").alias("source_task_id"), F.col("user_id").alias("source_user_id"), F.col("time").alias("source_time")), "place")
    limit = cap if cap is not None else max(10, -(-n // 200))
    kept = frequency_cap(kept, ["relation", "key"], [F.col("score").desc(), F.col("task_id").desc()], limit)
    mass = F.when(F.col("relation") == 2, "contrast_only_zero_mass").when(listwise, "listwise").when(F.col("relation") == 1, "review_required_zero_mass").when(F.col("similarity") >= pseudo, "analysis_only_pseudo_negative_risk").otherwise("dpo_rejected_review_required")
    name = F.element_at(F.array(*[F.lit(x) for x in RELATIONS]), F.col("relation"))
    return kept.select("task_id", name.alias("relation"), mass.alias("eligibility"), "score", "similarity", "key", "text", "source_task_id", "source_user_id", "source_time", "rank")


def best_same_and_cross(df: DataFrame, intent: str, user: str, similarity_of: Column, order: str) -> DataFrame:
    """For every row the best similarity among rows of the same intent by the same user and by others."""
    a = df.alias("a")
    b = df.alias("b")
    pairs = a.join(b, (F.col(f"a.{intent}") == F.col(f"b.{intent}")) & (F.col(f"a.{order}") != F.col(f"b.{order}")))
    same = F.col(f"a.{user}") == F.col(f"b.{user}")
    return pairs.groupBy(F.col(f"a.{order}").alias(order)).agg(F.max(F.when(same, similarity_of)).alias("same"), F.max(F.when(~same, similarity_of)).alias("cross"))


def continuations(trajectories: DataFrame, key: str, actions: str, action_key) -> DataFrame:
    """Every action of every trajectory with what follows it: key, action, position, suffix."""
    at = trajectories.select(key, F.col(actions), F.posexplode(actions).alias("pos", "_a"))
    return at.select(key, action_key(F.col("_a")).alias("action"), "pos", F.slice(actions, F.col("pos") + 2, F.size(actions)).alias("suffix"))


def nearest_pair(left: DataFrame, right: DataFrame, keys: list[str], ids: tuple[str, str], distance: Column) -> DataFrame:
    """Per key the pair of continuations at least distance, the first on ties.

    Both sides hold the few continuations that were retrieved for the key.
    """
    return left.join(right, keys).groupBy(*keys).agg(F.min(F.struct(distance.alias("distance"), *ids)).alias("_m")).select(*keys, "_m.*")


def history_condition(history: Column, condition: str, donor: Column | None = None) -> Column:
    """A task's history (array of structs with ``time``) under an ablation condition."""
    ordered = F.array_sort(history, lambda a, b: F.when(a.time < b.time, -1).when(a.time > b.time, 1).otherwise(0))
    n = F.size(ordered)
    empty = F.slice(history, 1, 0)
    rules = {
        "full": history, "none": empty, "recent": F.slice(ordered, F.greatest(n, F.lit(1)), 1), "stale": F.slice(ordered, 1, 1),
        "truncated": F.slice(ordered, 1, F.ceil(n / 2).cast("int")), "shuffled": donor if donor is not None else empty, "last_half": F.slice(ordered, F.floor(n / 2).cast("int") + 1, n),
    }
    if condition not in rules:
        raise ValueError(f"no such condition: {condition!r}")
    return F.when(n > 0, rules[condition]).otherwise(history)


def donors(df: DataFrame, key: str, user: str, seed: int, buckets: int = 4096) -> DataFrame:
    """For every row another user's row by hash: rows of a bucket lend to each other in seeded order."""
    from pyspark.sql import Window as W

    h = F.xxhash64(F.lit(seed), key)
    over = W.partitionBy("_b").orderBy("_h", key)
    dealt = df.select(key, user).withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    lent = dealt.withColumn("donor", F.lead(key).over(over)).withColumn("_du", F.lead(user).over(over))
    return lent.select(key, F.when(~F.col("_du").eqNullSafe(F.col(user)), F.col("donor")).alias("donor"))


def apply_review(candidates: DataFrame, decisions: DataFrame, key: str, group: str, decision: str, probability: str, drop: tuple[str, ...]) -> DataFrame:
    """Candidates after review: dropped ones go and the rest of a group shares its mass anew.

    A decision about an unknown candidate, or two about one, is an error.
    """
    bad = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(candidates.select(key).distinct().withColumn("known", F.lit(True)), key, "left").where("n > 1 OR known IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"decision without, or beside, a candidate: {bad[0][0]}")
    kept = candidates.join(decisions.select(key, decision), key, "left").where(F.col(decision).isNull() | ~F.col(decision).isin(*drop))
    total = kept.groupBy(group).agg(F.sum(probability).alias("_t"))
    return kept.join(total, group).withColumn(probability, F.when(F.col("_t") > 0, F.col(probability) / F.col("_t")).otherwise(0.0)).drop("_t")


def negative_class(reasons: Column, task_match: Column, same_user: Column, pseudo: float = 0.92, easy: float = 0.20) -> Column:
    """Class of a negative candidate: invalid, pseudo, easy or hard."""
    return F.when(F.size(reasons) > 0, "invalid").when(task_match >= pseudo, "pseudo_negative").when((task_match <= easy) & (same_user <= easy), "easy_negative").otherwise("valid_hard_negative")

