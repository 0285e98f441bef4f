"""Deterministic sampling, sharding and mixing by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.operators.ranking import ranked


def hash_shard(text: Column, shards: int) -> Column:
    """Shard by the first 64 bits of a sha256."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % shards).cast("int")


def seeded_order(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]))


def round_robin(df: DataFrame, strata: Sequence[str], key: str, limit: int, seed: int) -> DataFrame:
    """Sample that takes one row of every stratum in turn until ``limit``; ``turn`` from 1.

    The limit is pushed into every stratum before the global order, so that only as many rows
    as the sample needs are ever compared.
    """
    turn = F.row_number().over(W.partitionBy(*strata).orderBy(seeded_order(seed, F.col(key)), key))
    ranked = df.withColumn("turn", turn).where(F.col("turn") <= limit)
    return ranked.orderBy("turn", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata], key).limit(limit)


def largest_remainder(df: DataFrame, stratum: str, size: int) -> DataFrame:
    """How many rows of each stratum a proportional sample of ``size`` takes."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * F.lit(size) / F.sum("n").over(W.partitionBy())
    out = counts.withColumn("_share", share).withColumn("_base", F.floor("_share"))
    rest = F.lit(size) - F.sum("_base").over(W.partitionBy())
    place = F.row_number().over(W.orderBy((F.col("_share") - F.col("_base")).desc(), stratum))
    return out.select(stratum, "n", (F.col("_base") + F.when(place <= rest, 1).otherwise(0)).cast("bigint").alias("take"))


def interleave(sources: dict[str, DataFrame], key: str, until: str = "shortest") -> DataFrame:
    """Rows of several sources in turn: ``turn``, source, key; until the shortest ends, or the longest."""
    out = None
    for name, df in sources.items():
        part = df.select(F.lit(name).alias("source"), F.col(key).alias("key"))
        out = part if out is None else out.unionByName(part)
    out = ranked(out, ["source"], [F.col("key")], "turn")
    if until == "longest":
        return out
    ends = out.groupBy("source").agg(F.max("turn").alias("last")).agg(F.min("last").alias("last"))
    return out.join(F.broadcast(ends), out.turn <= ends["last"]).drop("last")


def resampled(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """``rows`` rows of ``df``: each as often as the ratio says, the remainder by the order of a hash.

    Whole copies are exploded; only the remainder is chosen, by a top-k over hashes.
    """
    total = df.count()
    if not total or rows <= 0:
        return df.limit(0).withColumn("copy", F.lit(0))
    whole, rest = divmod(rows, total)
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))) if whole else df.limit(0).withColumn("copy", F.lit(0))
    extra = df.orderBy(seeded_order(seed, F.col(key)), key).limit(rest).withColumn("copy", F.lit(whole + 1))
    return copies.unionByName(extra)


def at_positions(df: DataFrame, order: Sequence[Column], first: int, last: int, step: int = 1) -> DataFrame:
    """Rows at positions first, first + step, ... below last of a total order, from 0."""
    from pathloom.operators.ranking import numbered

    rows = numbered(df, order, "_pos").withColumn("_pos", F.col("_pos") - 1)
    return rows.where((F.col("_pos") >= first) & (F.col("_pos") < last) & ((F.col("_pos") - first) % step == 0)).drop("_pos")
