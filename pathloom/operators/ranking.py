"""Row numbers over data of any size and any skew.

A window sorts each key in one task, which a key with a third of all rows turns into one long
task. Here rows are range-partitioned by (keys, order), so that a large key spans partitions,
and numbers are put together from the partitions' counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.storage import cut


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """``df`` with its place in a total order, from 1; ``order`` must leave no ties."""
    laid = df.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(order)])
    keys = [F.col(f"_k{i}") for i in range(len(order))]
    laid = laid.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*[f"_k{i}" for i in range(len(order))])
    laid = cut(laid.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = laid.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))  # one row per partition
    out = laid.join(F.broadcast(offsets), part == F.col("_p"))
    return out.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_p", "_before")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank", count: str | None = None) -> DataFrame:
    """``df`` with each row's place within its keys, from 1, and optionally the rows of its keys.

    Rows with a null key are ranked like any other key.
    """
    placed = numbered(df, [*[F.col(k) for k in keys], *order], "_rn")
    first = placed.groupBy(*keys).agg(F.min("_rn").alias("_first"), F.count(F.lit(1)).alias(count or "_count"))
    named = first.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_first", count or "_count")
    on = None
    for i, k in enumerate(keys):
        same = placed[k].eqNullSafe(named[f"_key{i}"])
        on = same if on is None else on & same
    out = placed.join(named, on).withColumn(rank, F.col("_rn") - F.col("_first") + 1)
    return out.drop("_rn", "_first", *[f"_key{i}" for i in range(len(keys))], *([] if count else ["_count"]))
