"""Top N items of every group by lower bounds taken within partitions.

The N-th best of the distinct items that one partition holds of a group is a bound that the
group's true N-th best can't fall below. One pass finds these bounds inside the scan's own
partitions (no shuffle), the tightest bound per group is joined to the rows, and only rows that
reach it are shuffled and ranked: of a group with millions of rows, a few per partition. Bounds
compare the whole order, ties included, so equal scores prune as well as different ones. A bound
is only sent where it can drop several rows, and dropping fewer bounds never drops a row.

Defined cases: rows with a null group, or a null or NaN score, take no part; a null rank comes
after all ranks and a null item after all items; an item counts once, by its first row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pathloom.storage import cut, discard, stored_bytes

#: Bounds that are broadcast take at most this many bytes on disk; beyond, those that drop most rows.
BROADCAST_BYTES = 8 << 20
#: Rows that bounds are taken from at a time, and how many times N a group must have among them.
BUFFER, WORTH = 1 << 18, 4
_NO_RANK = 2147483647


def _order(score: str, rank: str, item: str) -> list[Column]:
    """Falling score, rising rank with null last, rising item with null last."""
    return [-F.col(score), F.coalesce(F.col(rank).cast("bigint"), F.lit(_NO_RANK + 1)), F.col(item).isNull(), F.coalesce(F.col(item), F.lit(""))]


_KEYS = ["_o0", "_o1", "_o2", "_o3"]


def _bounds_of(df: pd.DataFrame, n: int) -> pd.DataFrame:
    """Of each group with many rows here, its N-th best distinct item and the number of rows."""
    rows = df.groupby("_g", sort=False)["_o0"].transform("size")
    df = df.assign(rows=rows)[rows >= WORTH * n]
    df = df.sort_values(["_g", *_KEYS], kind="stable")
    df = df[~df.duplicated(["_g", "_o2", "_o3"])]
    return df[df.groupby("_g", sort=False).cumcount() == n - 1]


def _local_bounds(n: int):
    """Per partition, a bounded buffer of rows at a time: bounds of the groups that have many rows there.

    A bound of any part of a group's rows holds for the whole group, so buffers needn't be merged:
    time is linear in the rows and memory follows the buffer, however many groups there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BUFFER:
                yield made(held)
                held, size = [], 0
        if size:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = _bounds_of(pa.Table.from_batches(held).to_pandas(), n)
        return pa.RecordBatch.from_pandas(found[_BOUNDS.names], schema=_BOUNDS, preserve_index=False)

    return run


_BOUNDS = pa.schema([("rows", pa.int64()), ("_g", pa.string()), ("_o0", pa.float64()), ("_o1", pa.int64()), ("_o2", pa.bool_()), ("_o3", pa.string())])


def top_n(df: DataFrame, n: int, group: str, item: str, score: str, rank: str) -> DataFrame:
    """Columns ``group``, ``item``, ``score``, ``rank`` and ``place`` of the first ``n`` items per group."""
    rows = df.where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    rows = rows.select(F.col(group).cast("string").alias("_g"), *[c.alias(k) for k, c in zip(_KEYS, _order(score, rank, item))], F.col(score).alias("_s"), F.col(rank).alias("_r"), F.col(item).alias("_i"))
    kinds = T.StructType([T.StructField("rows", T.LongType()), T.StructField("_g", T.StringType()), T.StructField("_o0", T.DoubleType()), T.StructField("_o1", T.LongType()), T.StructField("_o2", T.BooleanType()), T.StructField("_o3", T.StringType())])
    local = rows.select("_g", *_KEYS).mapInArrow(_local_bounds(n), kinds)
    bounds = cut(local.groupBy("_g").agg(F.min(F.struct(*_KEYS)).alias("_bound"), F.sum("rows").alias("rows")), "bounds")
    size = stored_bytes(bounds)
    if size > BROADCAST_BYTES:
        # A bound only saves work: the ones that drop most go along, rows of other groups pass unfiltered.
        every = bounds
        bounds = cut(every.orderBy(F.col("rows").desc(), "_g").limit(max(1, every.count() * BROADCAST_BYTES // size)), "bounds")
        discard(every)
    held = rows.join(F.broadcast(bounds.drop("rows")), "_g", "left")
    held = held.where(F.col("_bound").isNull() | (F.struct(*_KEYS) <= F.col("_bound")))
    # Each item once, by its first row; then at most N * partitions rows of a hot group are ranked.
    first = held.groupBy("_g", "_o2", "_o3").agg(F.min(F.struct(*_KEYS, "_s", "_r", "_i")).alias("_x"))
    place = F.row_number().over(W.partitionBy("_g").orderBy("_x"))
    ranked = first.select("_g", "_x", place.alias("place")).where(F.col("place") <= n)
    return ranked.select(F.col("_g").alias(group), F.col("_x._i").alias(item), F.col("_x._s").alias(score), F.col("_x._r").alias(rank), F.col("place").cast("int").alias("place"))
