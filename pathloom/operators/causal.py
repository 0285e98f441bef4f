"""Operators that only look at the strict past of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.operators.ranking import numbered, ranked


def latest_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, payload: Column, name: str) -> DataFrame:
    """The last ``n`` rows before each row of the same keys, oldest first, as an array (n = 0: all)."""
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(-n if n else W.unboundedPreceding, -1)
    return df.withColumn(name, F.collect_list(payload).over(window))


def strict_past_pairs(targets: DataFrame, references: DataFrame, keys: Sequence[str], time: str, suffix: str = "_ref") -> DataFrame:
    """Every target with the references of the same keys and an earlier time.

    The keys make it a hash or merge join with the order as a residual filter, never a nested loop.
    """
    other = references.select(*[F.col(c).alias(f"{c}{suffix}") for c in references.columns])
    on = [targets[k] == other[f"{k}{suffix}"] for k in keys] + [other[f"{time}{suffix}"] < targets[time]]
    return targets.join(other, on)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key; only k rows per key and partition are shuffled (window group limit)."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Ordered de-duplication: one row per key, the first."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def latest_fraction_split(df: DataFrame, user: str, order: Sequence[Column], fraction: float, least: int) -> DataFrame:
    """``part``: the latest share of each user's rows is held out, at least ``least``, never all of them."""
    if not 0 < fraction < 1 or least < 1:
        raise ValueError("fraction must lie between 0 and 1, least be 1 or more")
    placed = ranked(df, [user], order, "_place", "_n")
    held = F.least(F.greatest(F.lit(least), F.ceil(F.col("_n") * fraction)), F.col("_n") - 1)
    part = F.when((F.col("_n") >= 2) & (F.col("_place") > F.col("_n") - held), "eval").otherwise("train")
    return placed.withColumn("part", part).drop("_place", "_n")


def beside(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str], step: int = 1) -> DataFrame:
    """``df`` with columns of the row ``step`` places later among the same keys (earlier if negative), null where there is none.

    Rows are numbered over the whole cluster and met by their number, so that no key is one task's
    window, however many rows it has. ``columns`` maps new names to columns.
    """
    placed = numbered(df, [*[F.col(k) for k in keys], *order], "_rn")
    other = placed.select((F.col("_rn") - step).alias("_rn"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns.values())])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = placed.join(other, "_rn", "left").withColumns({name: F.when(same, F.col(f"_c{i}")) for i, name in enumerate(columns)})
    return met.drop("_rn", *[f"_k{i}" for i in range(len(keys))], *[f"_c{i}" for i in range(len(columns))])


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], state: str) -> DataFrame:
    """Each step with the next state, whether there is one, and whether it ends its episode."""
    out = beside(df, keys, order, {"next_state": state})
    return out.withColumn("has_next", F.col("next_state").isNotNull()).withColumn("terminal", ~F.col("has_next"))


def without_keys(df: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't among the excluded ones; null keys are kept."""
    return df.join(excluded.select(*keys).distinct(), list(keys), "left_anti")


def frequency_cap(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """At most ``cap`` uses of every key over the whole pool, the best ones."""
    return top_k(df, keys, order, cap, "_use").drop("_use")
