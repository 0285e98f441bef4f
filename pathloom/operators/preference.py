"""Values, advantages, policies and preference pairs over scored trees and candidate groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.scores import sigmoid, soft_target


def merge_candidates(df: DataFrame, keys: Sequence[str], action: str, source: str, most: int) -> DataFrame:
    """One row per action with its support and sources; the ``most`` best by support, unknown actions last."""
    merged = df.groupBy(*keys, action).agg(F.count(F.lit(1)).alias("support"), F.array_join(F.array_sort(F.collect_set(source)), "+").alias("sources"))
    order = [(F.col(action) == "unknown"), F.col("support").desc(), "sources", action]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return merged.withColumn("place", place).where(F.col("place") <= most)


def propagated_values(edges: DataFrame, keys: Sequence[str], alpha: float, kappa: float) -> DataFrame:
    """Action values from leaf rewards: one row per traversal in (keys, support, weight, r_user, r_task, r_pref).

    Support and spread count every traversal, shared edges as often as leaves pass them.
    """
    w = F.greatest(F.when(F.col("weight") == 0, 1.0).otherwise(F.coalesce("weight", F.lit(1.0))), F.lit(1e-8))
    mean = lambda c: (F.sum(w * F.coalesce(c, F.lit(0.0))) / F.greatest(F.sum(w), F.lit(1e-8))).alias(c.replace("r_", "q_"))
    support = F.sum(F.when(F.col("support") == 0, 1.0).otherwise(F.coalesce(F.col("support").cast("double"), F.lit(1.0))))
    out = edges.groupBy(*keys).agg(support.alias("support"), mean("r_user"), mean("r_task"), mean("r_pref"), F.stddev_pop("r_user").alias("spread"), F.count(F.lit(1)).alias("n_paths"))
    out = out.withColumn("uncertainty", 1.0 / F.sqrt(F.col("support") + 1.0) + F.when(F.col("n_paths") > 1, F.col("spread")).otherwise(0.0))
    out = out.withColumn("q_user_conservative", F.col("q_user") - alpha * F.col("uncertainty"))
    return out.withColumn("a_delta", F.col("q_user_conservative") - F.col("q_task")).withColumn("coverage", 1.0 - F.exp(-F.col("support") / max(kappa, 1e-8)))


def residual_policy(values: DataFrame, node: Sequence[str], beta: float) -> DataFrame:
    """Base policy by support and the target policy tilted by the residual advantage."""
    over = W.partitionBy(*node)
    prior = F.greatest(F.col("support"), F.lit(1e-8))
    out = values.withColumn("base_probability", prior / F.sum(prior).over(over))
    logit = F.ln(F.greatest("base_probability", F.lit(1e-12))) + F.col("a_delta") / max(beta, 1e-8)
    out = out.withColumn("_logit", logit)
    e = F.exp(F.col("_logit") - F.max("_logit").over(over))
    return out.withColumn("target_probability", e / F.sum(e).over(over)).drop("_logit")


def node_advantages(rewards: DataFrame, node: Sequence[str], alpha: float) -> DataFrame:
    """Advantages over the mean of a node's actions, less a penalty for spread and little support."""
    over = W.partitionBy(*node)
    spread = F.when(F.count(F.lit(1)).over(over) > 1, F.stddev_pop("r_user").over(over)).otherwise(0.0)
    out = rewards.withColumn("a_user", F.col("r_user") - F.avg("r_user").over(over)).withColumn("a_task", F.col("r_task") - F.avg("r_task").over(over))
    out = out.withColumn("uncertainty", 1.0 / F.sqrt(F.when(F.col("support") == 0, 1.0).otherwise(F.col("support")) + 1.0) + spread)
    return out.withColumn("a_user_conservative", F.col("a_user") - alpha * F.col("uncertainty")).withColumn("a_delta", F.col("a_user_conservative") - F.col("a_task"))


def pairs_within(values: DataFrame, node: Sequence[str], action: str, score: str, margin: float, tau: float, most: float, beta: float) -> DataFrame:
    """All pairs of a node's actions whose scores differ by more than a margin, the better one first.

    A node holds at most the candidates that its expansion kept, so its pairs are bounded.
    """
    a = values.select(*node, F.col(action).alias("positive"), F.col(score).alias("_p"))
    b = values.select(*node, F.col(action).alias("negative"), F.col(score).alias("_n"))
    gap = F.col("_p") - F.col("_n")
    out = a.join(b, list(node)).where(gap > margin).withColumn("gap", gap)
    out = out.withColumn("target_probability", sigmoid(F.col("gap") / max(beta, 1e-8))).withColumn("weight", F.least(F.lit(most), F.col("gap") / max(tau, 1e-8)))
    return out.drop("_p", "_n")


def oracle_pairs(candidates: DataFrame, group: str, source: str, item: str, score: str, margin: float, limit: int, temperature: float, oracle: str = "oracle") -> DataFrame:
    """The group's oracle against its best negatives that it beats by more than a margin, at most ``limit``."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i")))
    chosen = candidates.where(F.col(source) == oracle).groupBy(group).agg(best.alias("_o")).select(group, F.col("_o.i").alias("chosen"), (-F.col("_o.s")).alias("_oracle"))
    rest = candidates.where(F.col(source) != oracle).groupBy(group, item).agg(F.max(score).alias("_score"))
    gap = F.col("_oracle") - F.col("_score")
    out = rest.join(chosen, group).where((gap > margin) & (F.col(item) != F.col("chosen"))).withColumn("gap", gap)
    place = F.row_number().over(W.partitionBy(group).orderBy(F.col("_score").desc(), item))
    out = out.withColumn("place", place).where(F.col("place") <= limit)
    return out.select(group, "chosen", F.col(item).alias("rejected"), "place", "gap", F.least(F.lit(5.0), F.greatest(F.lit(0.1), F.col("gap") / max(margin, 1e-8))).alias("weight"), soft_target(F.col("gap"), temperature, 0.0, 1.0).alias("target_probability"))


def pro_rata_weights(candidates: DataFrame, group: str, is_oracle: Column, weight: str, oracle_weight: float) -> DataFrame:
    """The oracle's fixed weight, and the rest shared by the negatives in proportion (evenly if all are 0).

    Totals are aggregated and joined back, so that a huge group isn't one window.
    """
    oracle_weight = min(max(oracle_weight, 0.5), 0.99)
    raw = F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))
    flagged = candidates.withColumn("_oracle", is_oracle).withColumn("_raw", F.when(F.col("_oracle"), 0.0).otherwise(raw))
    totals = flagged.groupBy(group).agg(F.sum("_raw").alias("_total"), F.sum(F.when(F.col("_oracle"), 0).otherwise(1)).alias("_n"))
    share = F.when(F.col("_total") > 0, F.col("_raw") / F.col("_total")).otherwise(1.0 / F.col("_n"))
    own = F.when(F.col("_oracle") & (F.col("_n") == 0), 1.0).when(F.col("_oracle"), oracle_weight).otherwise((1.0 - oracle_weight) * share)
    return flagged.join(totals, group).withColumn("new_weight", own).drop("_oracle", "_raw", "_total", "_n")


def clamped_policy(rewards: DataFrame, oracle: str, same: str, context: str, *, temperature: float, max_same: float, max_context: float, min_oracle: float, max_oracle: float) -> DataFrame:
    """Probabilities of oracle, same-user and context text, tempered and held within caps.

    ``rewards`` has one reward per column (null: the group has no such candidate).
    """
    top = F.greatest(*[F.coalesce(c, F.lit(-1e308)) for c in (oracle, same, context)])
    e = {c: F.coalesce(F.exp((F.col(c) - top) / temperature), F.lit(0.0)) for c in (oracle, same, context)}
    total = e[oracle] + e[same] + e[context]
    out = rewards.withColumn("_s", F.least(e[same] / total, F.lit(max_same))).withColumn("_c", F.least(e[context] / total, F.lit(max_context)))
    other = F.col("_s") + F.col("_c")
    low = (1.0 - other) < min_oracle
    scale = F.when(low & (other > 0), max(0.0, 1.0 - min_oracle) / other).otherwise(1.0)
    out = out.withColumn("_k", scale).withColumn("_o", F.when(low, min_oracle).otherwise(1.0 - other)).withColumn("_s", F.col("_s") * F.col("_k")).withColumn("_c", F.col("_c") * F.col("_k"))
    room_s = F.when(F.col(same).isNotNull(), F.greatest(F.lit(0.0), max_same - F.col("_s"))).otherwise(0.0)
    room_c = F.when(F.col(context).isNotNull(), F.greatest(F.lit(0.0), max_context - F.col("_c"))).otherwise(0.0)
    out = out.withColumn("_rs", room_s).withColumn("_rc", room_c).withColumn("_need", F.greatest(F.lit(0.0), F.col("_o") - max_oracle))
    room = F.col("_rs") + F.col("_rc")
    give = lambda r: F.when((F.col("_need") > 0) & (room > 0), F.col("_need") * F.col(r) / room).otherwise(0.0)
    out = out.withColumn("_gs", give("_rs")).withColumn("_gc", give("_rc"))
    out = out.withColumn("_s", F.least(F.col("_s") + F.col("_gs"), F.greatest(F.lit(max_same), F.col("_s")))).withColumn("_c", F.least(F.col("_c") + F.col("_gc"), F.greatest(F.lit(max_context), F.col("_c"))))
    out = out.withColumn("_o", F.when(F.col("_need") > 0, 1.0 - F.col("_s") - F.col("_c")).otherwise(F.col("_o")))
    have = F.when(F.col(oracle).isNotNull(), F.col("_o")).otherwise(0.0) + F.when(F.col(same).isNotNull(), F.col("_s")).otherwise(0.0) + F.when(F.col(context).isNotNull(), F.col("_c")).otherwise(0.0)
    keep = [c for c in rewards.columns]
    return out.select(*keep, *[F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.col(p)) / have).alias(f"{c}_probability") for c, p in ((oracle, "_o"), (same, "_s"), (context, "_c"))])
