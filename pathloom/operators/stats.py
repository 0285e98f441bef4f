"""Evaluation statistics: quantiles, paired comparison, bootstrap, projection, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.operators.ranking import ranked


def lower_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """``sorted[int((n - 1) p)]`` per key; values are ranked over the cluster, so a key may have any share of the rows."""
    placed = ranked(df.where(F.col(value).isNotNull()).select(*keys, value), keys, [F.col(value)], "_r", "_t")
    picks = [F.max(F.when(F.col("_r") - 1 == F.floor((F.col("_t") - 1) * p), F.col(value))).alias(f"q{round(p * 100)}") for p in probabilities]
    return placed.groupBy(*keys).agg(F.max("_t").alias("n"), *picks)


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Interpolated quantiles with count, mean, least and greatest value, from the same ranks."""
    placed = ranked(df.where(F.col(value).isNotNull()).select(*keys, value), keys, [F.col(value)], "_r", "_t")
    at = {f"q{round(p * 100)}": (F.col("_t") - 1) * p for p in probabilities}
    pick = lambda where, name: F.max(F.when(F.col("_r") - 1 == where, F.col(value).cast("double"))).alias(name)
    ends = [c for name, h in at.items() for c in (pick(F.floor(h), f"{name}_lo"), pick(F.ceil(h), f"{name}_hi"), F.max(h - F.floor(h)).alias(f"{name}_f"))]
    out = placed.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), *ends)
    return out.select(*keys, "n", "mean", "least", "most", *[(F.col(f"{q}_lo") + (F.col(f"{q}_hi") - F.col(f"{q}_lo")) * F.col(f"{q}_f")).alias(q) for q in at])


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of an md5; any engine gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def poisson_draw(u: Column) -> Column:
    """How often a row is drawn, Poisson with mean 1, from a uniform number."""
    rule, total, term = None, 0.0, 0.36787944117144233
    for k in range(7):
        total += term
        rule = (F.when if rule is None else rule.when)(u < total, k)
        term /= k + 1
    return rule.otherwise(7)


def bootstrap_mean(df: DataFrame, unit: str, value: str, draws: int, seed: int = 42) -> DataFrame:
    """Mean and 95 % interval by resampling units; Poisson weights need neither indexes nor a join.

    Rows are expanded by draws and summed map-side: what is shuffled is one partial per draw.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(unit).cast("string").alias("_u"), F.col(value).cast("double").alias("_v"))
    drawn = rows.select("_u", "_v", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_d"))
    weight = poisson_draw(hash_unit(F.lit(seed), F.col("_d"), F.col("_u")))
    means = drawn.select("_d", "_v", weight.alias("_w")).groupBy("_d").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("m"))
    interval = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = rows.agg(F.count(F.lit(1)).alias("n_units"), F.avg("_v").alias("mean"))
    return whole.crossJoin(F.broadcast(interval)).select("n_units", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def paired(reference: DataFrame, candidate: DataFrame, unit: str, value: str, user: str, higher: bool = True) -> DataFrame:
    """One row comparing two runs over their common units, and over users."""
    a = reference.where(F.col(value).isNotNull()).select(unit, F.col(value).alias("_a"), F.col(user).alias("_ua"))
    b = candidate.where(F.col(value).isNotNull()).select(unit, F.col(value).alias("_b"), F.col(user).alias("_ub"))
    both = a.join(b, unit, "full")
    gain = (F.col("_b") - F.col("_a")) * (1 if higher else -1)
    rows = both.select(F.col("_a").isNotNull().alias("in_a"), F.col("_b").isNotNull().alias("in_b"), gain.alias("gain"), F.coalesce("_ub", "_ua").alias("u"))
    per_user = rows.where("gain IS NOT NULL").groupBy("u").agg(F.avg("gain").alias("g"))
    total = rows.agg(
        F.sum(F.col("in_a").cast("bigint")).alias("n_reference"), F.sum(F.col("in_b").cast("bigint")).alias("n_candidate"), F.count("gain").alias("n_paired"),
        F.bool_and(F.col("in_a") & F.col("in_b")).alias("coverage_match"), F.avg("gain").alias("mean_improvement"), F.avg((F.col("gain") > 0).cast("double")).alias("win_rate"),
    )
    users = per_user.agg(F.count(F.lit(1)).alias("n_users"), F.avg("g").alias("macro_improvement"), F.min("g").alias("worst_user"), F.avg((F.col("g") > 0).cast("double")).alias("users_improved"))
    return total.crossJoin(F.broadcast(users))


def null_space(df: DataFrame, keys: Sequence[str], task: str, preference: str, weight: str, eps: float = 1e-8) -> DataFrame:
    """Preference margins without their part along the task margins, per key: rho, what is left, and its dot product."""
    sums = df.groupBy(*keys).agg(F.sum(F.col(weight) * F.col(preference) * F.col(task)).alias("_pt"), F.sum(F.col(weight) * F.col(task) * F.col(task)).alias("_tt"))
    rho = sums.select(*keys, (F.col("_pt") / (F.col("_tt") + eps)).alias("rho"))
    left = F.col(preference) - F.col("rho") * F.col(task)
    return df.join(rho, list(keys)).withColumn("null_margin", F.when(F.abs(left) < 1e-7, 0.0).otherwise(left))


def length_cdf(df: DataFrame, length: str, interval: int) -> DataFrame:
    """Rows per length interval with the running count and share (as many rows as there are intervals)."""
    bins = df.where(F.col(length).isNotNull()).groupBy((F.floor(F.col(length) / interval) * interval).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return bins.select("bin", "n", run.alias("running"), (100.0 * run / F.sum("n").over(W.partitionBy())).alias("percent"))
