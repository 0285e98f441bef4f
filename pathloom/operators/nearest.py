"""The earlier or foreign text most alike, by Dice over character pairs, exact over all eligible rows.

Keys are letters and digits of any script; two blocks of them are 0/1 matrices over the character
pairs that both have, so what they share is one matrix product and no pair of rows is ever shuffled. Rows of
a busy user, and the two sides of a comparison across users, are cut into blocks of ``BLOCK`` rows
and every pair of blocks is a task of its own; what leaves it is one row per target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.operators.stats import hash_unit

BLOCK = 4096
#: Groups that the users are dealt to, and target rows scored in one product.
GROUPS, ROWS = 64, 256


def pair_sets(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner and code of every distinct character pair of every key; a key of one character has a code of its own."""
    keys = keys.cast(pa.large_string())
    codes = np.frombuffer("\x00".join(keys.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.cumsum(codes == 0)
    real = codes > 0
    size = np.bincount(owner[real], minlength=len(keys))
    joined = real[1:] & real[:-1]
    alone = real & (size[owner] == 1)
    pair = np.concatenate([codes[:-1][joined] << 21 | codes[1:][joined], codes[alone] << 21])
    owner = np.concatenate([owner[:-1][joined], owner[alone]])
    order = np.lexsort((pair, owner))
    pair, owner = pair[order], owner[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], pair[new]


def _matrices(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """0/1 rows of both sides over the pairs that both have, and how many pairs each row has in all."""
    (oa, ca), (ob, cb) = pair_sets(left), pair_sets(right)
    both = np.intersect1d(ca, cb)
    out = []
    for owner, code, n in ((oa, ca, len(left)), (ob, cb, len(right))):
        at = np.minimum(np.searchsorted(both, code), max(len(both) - 1, 0))
        some = both[at] == code if len(both) else np.zeros(len(code), bool)
        rows = np.zeros((n, len(both)), np.float32)
        rows[owner[some], at[some]] = 1
        out += [rows, np.bincount(owner, minlength=n).astype(np.float32)]
    return tuple(out)


def _best(left: pa.Array, right: pa.Array, rules) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per rule (rows -> mask over ``right``) the targets that have a reference, it, and the similarity; ties go to the first."""
    a, na, b, nb = _matrices(left, right)
    parts = [[] for _ in rules]
    for lo in range(0, len(a), ROWS):
        rows = slice(lo, min(lo + ROWS, len(a)))
        shared = a[rows] @ b.T
        total = na[rows, None] + nb[None, :]
        alike = np.floor(2e6 * shared.astype(np.float64) / np.maximum(total, 1) + 0.5)  # ties as after rounding to six places
        for part, rule in zip(parts, rules):
            masked = np.where(rule(rows), alike, -1.0)
            who = masked.argmax(axis=1)
            at = np.arange(len(who))
            some = masked[at, who] >= 0
            at, who = at[some], who[some]
            part.append((at + lo, who, 2.0 * shared[at, who].astype(np.float64) / np.maximum(total[at, who], 1)))
    return [tuple(np.concatenate(x) for x in zip(*part)) if part else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for part in parts]


_FOUND = "row_id bigint, mode string, reference bigint, similarity double"


def _table(found, names, ids_a, ids_b) -> pa.Table:
    rows = [(ids_a[i], np.full(len(i), name), ids_b[j], s) for name, (i, j, s) in zip(names, found)]
    columns = [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, np.int64), np.zeros(0, "U1"), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"row_id": pa.array(columns[0], pa.int64()), "mode": pa.array(columns[1].tolist(), pa.string()), "reference": pa.array(columns[2], pa.int64()), "similarity": pa.array(columns[3], pa.float64())})


def _again(df: DataFrame) -> DataFrame:
    """The same columns under new identities: a cogroup of one frame with itself mixes its sides up."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _ints(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def best_of_same_user(df: DataFrame, user: str, order: Column, key: str, other: str | None = None, block: int = BLOCK, late: bool = True) -> DataFrame:
    """``row_id, mode, reference, similarity``: of all of the user's rows of a lower order the most alike.

    ``order`` is a whole number within the user; ties go to the greater one (if ``late``), then to
    the greater row_id. With ``other`` a second mode, 'other', takes only references that differ in that column.
    """
    rows = df.where(F.col(user).isNotNull() & F.col(key).isNotNull() & order.isNotNull())
    rows = rows.select(F.col("row_id"), F.col(user).alias("u"), order.cast("bigint").alias("o"), F.col(key).alias("k"), (F.xxhash64(other) if other else F.lit(0).cast("bigint")).alias("t"))
    rows = rows.withColumn("c", F.floor((F.row_number().over(W.partitionBy("u").orderBy("o", "row_id")) - 1) / block).cast("int")).withColumn("last", F.max("c").over(W.partitionBy("u")))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("u"), F.lit(GROUPS)).cast("int"))
    targets = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("rc")).withColumnRenamed("c", "tc")
    references = _again(rows.select("*", F.explode(F.sequence(F.col("c"), F.col("last"))).alias("tc")).withColumnRenamed("c", "rc"))
    names = ["same", "other"] if other else ["same"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table([], [], None, None)
        a = left.sort_by("u").combine_chunks()
        b = right.sort_by([("u", "ascending"), *([("o", "descending")] if late else []), ("row_id", "descending")]).combine_chunks()
        users, first = np.unique(np.asarray(a.column("u").to_pylist(), object).astype(str), return_index=True)
        theirs, start = np.unique(np.asarray(b.column("u").to_pylist(), object).astype(str), return_index=True)
        ends, stops = np.append(first[1:], len(a)), np.append(start[1:], len(b))
        at = dict(zip(theirs.tolist(), zip(start.tolist(), stops.tolist())))
        tables = []
        for name, lo, hi in zip(users.tolist(), first.tolist(), ends.tolist()):
            if name not in at:
                continue
            x, y = a.slice(lo, hi - lo), b.slice(at[name][0], at[name][1] - at[name][0])
            ox, oy, tx, ty = _ints(x, "o"), _ints(y, "o"), _ints(x, "t"), _ints(y, "t")
            rules = [lambda r: oy[None, :] < ox[r, None]]
            if other:
                rules.append(lambda r: (oy[None, :] < ox[r, None]) & (ty[None, :] != tx[r, None]))
            found = _best(x.column("k").combine_chunks(), y.column("k").combine_chunks(), rules)
            tables.append(_table(found, names, _ints(x, "row_id"), _ints(y, "row_id")))
        return pa.concat_tables(tables) if tables else _table([], [], None, None)

    found = targets.groupBy("g", "tc", "rc").cogroup(references.groupBy("g", "tc", "rc")).applyInArrow(run, _FOUND)
    found = found.withColumn("similarity", F.round("similarity", 6))
    if not late:
        best = F.struct("similarity", "reference")
    else:
        found, best = found.join(rows.select(F.col("row_id").alias("reference"), "o"), "reference"), F.struct("similarity", "o", "reference")
    return found.groupBy("row_id", "mode").agg(F.max(best).alias("b")).select("row_id", "mode", "b.reference", "b.similarity")


def best_of_other_group(df: DataFrame, user: str, group: str, time: str, key: str, block: int = BLOCK) -> DataFrame:
    """``row_id, mode, similarity``: of all rows by other users of another group the most alike.

    Mode 'any' takes references of any time, 'past' only earlier ones. Rows without user or group take no part.
    With a shared folder that workers can map, references are searched in an index
    (:mod:`pathloom.operators.alike`); else all pairs of blocks are compared.
    """
    from pathloom.operators import alike, treeindex

    rows = df.where(F.col(user).isNotNull() & F.col(group).isNotNull() & F.col(key).isNotNull())
    folder = treeindex.local_folder(df.sparkSession)
    if folder:
        return alike.best_of_other_group(rows.select("row_id", F.xxhash64(user).alias("u"), F.xxhash64(group).alias("a"), F.col(time).alias("t"), F.col(key).alias("k")), folder)
    rows = rows.select("row_id", F.xxhash64(user).alias("u"), F.xxhash64(group).alias("a"), F.coalesce(time, F.lit("")).alias("t"), F.col(key).alias("k"))
    n = max(1, -(-rows.count() // block))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    targets = rows.withColumnRenamed("b", "tb").select("*", every.alias("rb"))
    references = _again(rows.withColumnRenamed("b", "rb").select("*", every.alias("tb")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table([], [], None, None)
        _, when = np.unique(np.asarray(left.column("t").to_pylist() + right.column("t").to_pylist()), return_inverse=True)
        dated = np.asarray(left.column("t").to_pylist() + right.column("t").to_pylist()) != ""
        tx, ty = when[: len(left)], when[len(left) :]
        dx, dy = dated[: len(left)], dated[len(left) :]
        ux, uy, ax, ay = _ints(left, "u"), _ints(right, "u"), _ints(left, "a"), _ints(right, "a")
        anyone = lambda r: (uy[None, :] != ux[r, None]) & (ay[None, :] != ax[r, None])
        rules = [anyone, lambda r: anyone(r) & (ty[None, :] < tx[r, None]) & dx[r, None] & dy[None, :]]
        found = _best(left.column("k").combine_chunks(), right.column("k").combine_chunks(), rules)
        return _table(found, ["any", "past"], _ints(left, "row_id"), _ints(right, "row_id"))

    found = targets.groupBy("tb", "rb").cogroup(references.groupBy("tb", "rb")).applyInArrow(run, _FOUND)
    return found.groupBy("row_id", "mode").agg(F.round(F.max("similarity"), 6).alias("similarity"))


def likeness(pairs: DataFrame, row: str, left: str, right: str) -> DataFrame:
    """``row`` and ``similarity`` of two keys in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (oa, ca), (ob, cb) = pair_sets(b.column(left)), pair_sets(b.column(right))
            owner, code = np.concatenate([oa, ob]), np.concatenate([ca, cb])
            order = np.lexsort((code, owner))
            owner, code = owner[order], code[order]
            both = owner[1:][(code[1:] == code[:-1]) & (owner[1:] == owner[:-1])]
            alike = 2.0 * np.bincount(both, minlength=len(b)) / np.maximum(np.bincount(owner, minlength=len(b)), 1)
            yield pa.RecordBatch.from_arrays([b.column(row), pa.array(alike)], [row, "similarity"])

    found = pairs.select(row, left, right).mapInArrow(run, f"{row} bigint, similarity double")
    return found.withColumn("similarity", F.round("similarity", 6))


def drawn_same_user(df: DataFrame, user: str, time: str, seed: int = 42) -> DataFrame:
    """``row_id, reference``: a strictly earlier row of the user by a seeded draw, all equally likely."""
    rows = df.where(F.col(user).isNotNull() & F.col(time).isNotNull()).select("row_id", user, time)
    by = W.partitionBy(user)
    placed = rows.select("row_id", user, (F.row_number().over(by.orderBy(time, "row_id")) - 1).alias("pos"), (F.rank().over(by.orderBy(time)) - 1).alias("n"))
    drawn = placed.where("n > 0").select("row_id", user, F.floor(hash_unit(F.lit(seed), F.lit("same"), F.col("row_id")) * F.col("n")).cast("int").alias("pos"))
    return drawn.join(placed.select(user, "pos", F.col("row_id").alias("reference")), [user, "pos"]).select("row_id", "reference")


def drawn_other_group(df: DataFrame, user: str, group: str, seed: int = 42) -> DataFrame:
    """``row_id, reference``: a row by another user of another group by a seeded draw, all equally likely.

    The rows outside a group stand in order of user, so those of the target's own user are one
    stretch, which the draw steps over; nothing is joined but the drawn place.
    """
    rows = df.where(F.col(user).isNotNull() & F.col(group).isNotNull()).select("row_id", user, group)
    groups = rows.select(F.col(group).alias("pool")).distinct()
    pool = rows.join(F.broadcast(groups), F.col(group) != F.col("pool")).select("pool", user, F.col("row_id").alias("reference"))
    pool = pool.select("pool", user, "reference", (F.row_number().over(W.partitionBy("pool").orderBy(user, "reference")) - 1).alias("pos"))
    whole = pool.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    own = pool.groupBy("pool", user).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("mine"))
    asked = rows.withColumnRenamed(group, "pool").join(F.broadcast(whole), "pool").join(own, ["pool", user], "left").na.fill(0, ["first", "mine"])
    place = F.floor(hash_unit(F.lit(seed), F.lit("cross"), F.col("row_id")) * (F.col("n") - F.col("mine"))).cast("int")
    asked = asked.where("n > mine").withColumn("k", place).select("row_id", "pool", F.when(F.col("k") < F.col("first"), F.col("k")).otherwise(F.col("k") + F.col("mine")).alias("pos"))
    return asked.join(pool.select("pool", "pos", "reference"), ["pool", "pos"]).select("row_id", "reference")
