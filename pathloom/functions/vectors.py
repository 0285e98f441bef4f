"""Column builders over numeric arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = EPS) -> Column:
    """Cosine similarity; 0 where a vector vanishes."""
    n = norm(a) * norm(b)
    return F.when(n < eps, 0.0).otherwise(dot(a, b) / n)


def normalized(a: Column, eps: float = EPS) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def words(c: Column) -> Column:
    """Lower-case words of Latin letters, digits and underscores; a text without any gives its parts between blanks."""
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.split(low, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != ""))


def hashed_embedding(tokens: Column, dim: int = 256) -> Column:
    """``array<struct<idx, weight>>``: signed counts of a list of tokens by md5, scaled to length one, zero cells left out.

    The index is the little-endian number of the digest's first four bytes modulo ``dim``; the sign
    comes from the next byte's lowest bit. Digests are taken in the JVM, cells are summed over
    whole Arrow columns, and a row never leaves its place.
    """

    def cell(token: Column) -> Column:
        digest = F.md5(token)
        index = F.conv(F.concat(*[F.substring(digest, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint") % dim
        return (F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1) * (index + 1)).cast("int")

    @F.arrow_udf("array<struct<idx: int, weight: double>>")
    def summed(cells: pa.Array) -> pa.Array:
        n = len(cells)
        size = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
        flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place, back = np.unique(np.repeat(np.arange(n), size) * dim + np.abs(flat) - 1, return_inverse=True)
        value = np.bincount(back, np.sign(flat), len(place))
        place, value = place[value != 0], value[value != 0]
        row = place // dim
        length = np.sqrt(np.bincount(row, value * value, n))
        cell_ = pa.StructArray.from_arrays([pa.array((place % dim).astype(np.int32)), pa.array(value / length[row])], names=["idx", "weight"])
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32), cell_)

    return summed(F.transform(tokens, cell))


def most_alike(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """``query_id, <key>, similarity, rank``: the ``k`` rows most alike by cosine to every query, itself left out.

    Both sides are dealt to blocks; every pair of a block of queries and a block of rows is one
    matrix product, of which k rows per query go on. Similarities are rounded to five places and
    ties go to the lesser key. Neither side meets the driver, whatever its size.
    """
    blocks = lambda n: max(1, -(-n // block))
    nq, nr = blocks(queries.count()), blocks(rows.count())
    deal = lambda df, own, n, other, m: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    left, right = deal(queries, "q", nq, "r", nr), deal(rows, "r", nr, "q", nq)

    def unit(t: pa.Table) -> np.ndarray:
        x = np.stack(t.column("v").to_numpy()).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(a) and len(b):
            ia, ib, ub = a.column("id").to_numpy(), b.column("id").to_numpy(), unit(b)
            ua = unit(a)
            for at in range(0, len(ia), 256):
                s = np.round(ua[at : at + 256] @ ub.T, 5)
                s[ia[at : at + 256, None] == ib[None, :]] = -np.inf
                place = np.lexsort((np.broadcast_to(ib, s.shape), -s), axis=1)[:, :k]
                top = np.take_along_axis(s, place, 1)
                some = top > -np.inf
                for column, value in zip(out, (ia[at : at + 256][np.nonzero(some)[0]], ib[place[some]], top[some])):
                    column.append(value)
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"query_id": join(out[0], pa.int64()), key: join(out[1], pa.int64()), "similarity": join(out[2], pa.float64())})

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(best, f"query_id bigint, {key} bigint, similarity double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), key))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
