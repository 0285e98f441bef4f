"""Equal and nearly equal texts across splits, by MinHash banding and edit distance.

A text, reduced to lower-case letters and digits, is a set of character n-grams. It has ``BLOCKS``
codes of 64 bits; under the permutations of the n-grams that belong to a block, its code combines
(bit by bit, by majority) the three n-grams that come first, or two and a fixed third code. Texts
with few edits keep most n-grams, so some code stays as it is; equal codes are joined across
splits, pairs that length or :func:`signature` rule out are dropped, and every other pair that
meets is verified by its edit distance. Before that, equal texts are collapsed, so copies meet
once; after it, members are joined to their text.

This stands in place of similarity-hash fingerprints joined within a Hamming radius, and no
Hamming distance between fingerprints is taken: edits of up to a tenth change so many bits that
the radius would be too wide for an equi join (README gives the measured recall per radius).
Candidates are found by hashing, so a near pair can be missed.

N-grams that more than ``COMMON`` of the texts contain carry no similarity and are left out of
the codes (counted over all texts, in a table of fixed size); texts left with few n-grams,
or with a small share of theirs, get further blocks over all of theirs. No bucket is capped; the
codes of a hot bucket are split over salts on one side and repeated for them on the other.

Defined cases: null texts, null ids and texts without letters or digits are never cases; a record
delivered twice counts once; one id on both sides isn't paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.charform import code_points, mix, reduced
from pathloom.storage import cut, discard

BLOCKS = 40
#: The first blocks take two n-grams (they survive more edits), the others three (fewer texts meet).
OF_TWO = 24
#: Share of the texts beyond which an n-gram is common, and a number that never is.
COMMON, NEVER_COMMON = 0.01, 8
#: With fewer rare n-grams than FEW the blocks over all n-grams are added; with fewer than LEAST they stand alone.
FEW, LEAST = 10, 5
#: The blocks over all n-grams are also added where fewer than this share are rare; they all take three.
RARE_SHARE = 0.4
BUCKETS = 1 << 16
#: Codes of one bucket that go through one task, and how many times the mean makes a bucket hot.
HOT, HOT_TIMES = 1 << 17, 16
NEAR = 0.1


_FACTORS = mix(np.arange(1, 1 + 3 * BLOCKS, dtype=np.uint64)) | np.uint64(1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of every text, and the n+1 offsets: pairs with an ideograph, else four characters."""
    codes, offsets = code_points(texts)
    n, size = len(texts), np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    rest = np.repeat(offsets[1:], size) - np.arange(len(codes))  # characters from here to the text's end
    c = np.concatenate([codes.astype(np.uint64), np.zeros(3, np.uint64)])
    with np.errstate(over="ignore"):
        pair = c[:-3] * np.uint64(0x9E3779B97F4A7C15) + c[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F)
        four = pair + c[2:-1] * np.uint64(0x165667B19E3779F9) + c[3:] * np.uint64(0x27D4EB2F165667C5) + np.uint64(1)
    broad = c >= 0x3400
    pairs = (rest >= 2) & (broad[:-3] | broad[1:-2])
    fours = (rest >= 4) & ~(broad[:-3] | broad[1:-2] | broad[2:-1] | broad[3:])
    short = (rest == size[owner]) & (size[owner] < 4) if n else rest > 0
    grams = mix(np.concatenate([pair[pairs], four[fours], four[short]]))
    owner = np.concatenate([owner[pairs], owner[fours], owner[short]])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def signature(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of every text, and 128 bits: whether the pairs of characters that fall on a bit are odd in number.

    An edit takes or adds four pairs at most, so texts ``d`` edits apart differ in at most ``4 d`` bits.
    """
    codes, offsets = code_points(texts)
    n, size = len(texts), np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    c = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        pair = mix(c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    inside = owner[1:] == owner[:-1]
    cells = owner[:-1][inside] * 128 + (pair[inside] >> np.uint64(57)).astype(np.int64)
    odd = (np.bincount(cells, minlength=128 * n) & 1).astype(np.uint8)
    return size.astype(np.int32), np.packbits(odd).view(np.int64).reshape(n, 2)


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(48)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        grams, _ = features(batch.column(0))
        total += np.bincount(_bucket(grams), minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def common_buckets(texts: DataFrame, text: str, total: int) -> np.ndarray:
    """Whether the n-grams of a bucket are common; at most ``BUCKETS`` numbers reach the driver."""
    counts = texts.select(text).mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > max(NEVER_COMMON, COMMON * total)).select("bucket").collect()
    common = np.zeros(BUCKETS, bool)
    common[[r[0] for r in found]] = True
    return common


def blocks(grams: np.ndarray, offsets: np.ndarray, salt: np.ndarray, of_two: int = OF_TWO) -> np.ndarray:
    """``BLOCKS`` codes per text (none of the texts is empty of n-grams)."""
    out = np.empty((len(offsets) - 1, BLOCKS), np.int64)
    starts = offsets[:-1]
    with np.errstate(over="ignore"):
        for t in range(BLOCKS):
            codes = [mix(np.minimum.reduceat(grams * f, starts)) for f in _FACTORS[3 * t : 3 * t + (2 if t < of_two else 3)]]
            a, b, c = codes if t >= of_two else (*codes, _FACTORS[t])
            sign = (a & b) | (b & c) | (a & c)
            out[:, t] = mix(sign + _FACTORS[t] + salt).view(np.int64)
    return out


def _subset(grams: np.ndarray, offsets: np.ndarray, kept: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the chosen texts that are kept, and their offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    use = kept & rows[owner]
    return grams[use], np.concatenate([[0], np.cumsum(np.bincount(owner[use], minlength=len(rows))[rows])])


def _codes(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, groups, trains, evals = (batch.column(i) for i in range(5))
            grams, offsets = features(texts)
            rare = ~common[_bucket(grams)]
            n_rare = np.diff(np.concatenate([[0], np.cumsum(rare)])[offsets])
            n_all = np.diff(offsets)
            size, bits = signature(texts)
            salt = mix(groups.to_numpy().astype(np.uint64) + np.uint64(0x51ED2701))
            for kept, rows, extra in ((rare, n_rare >= LEAST, 0), (np.ones(len(grams), bool), ((n_rare < FEW) | (n_rare < RARE_SHARE * n_all)) & (n_all > 0), 1)):
                at = np.flatnonzero(rows)
                if not len(at):
                    continue
                codes = blocks(*_subset(grams, offsets, kept, rows), salt[at] + np.uint64(extra), 0 if extra else OF_TWO)
                repeated = np.repeat(at, BLOCKS)
                take = pa.array(repeated)
                own = [pa.array(x[repeated]) for x in (size, bits[:, 0], bits[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(codes.reshape(-1)), ids.take(take), trains.take(take), evals.take(take), *own], ["code", "id", "train", "held", "n", "s", "z"])

    return run


def near_texts(texts: DataFrame, near: float = NEAR) -> DataFrame:
    """``a, b``: ids of a text with a train member and one with a held-out member that are near.

    ``texts`` has id, text (distinct within grp), grp (int), train and held (boolean).
    """
    total = texts.count()
    common = common_buckets(texts, "text", total)
    codes = texts.select("id", "text", "grp", "train", "held").mapInArrow(_codes(common), "code bigint, id bigint, train boolean, held boolean, n int, s bigint, z bigint")
    codes = cut(codes, "codes")
    bucket = F.expr(f"cast(code & {BUCKETS - 1} as int)")
    sizes = codes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes.where(F.col("n") > F.lit(max(HOT, HOT_TIMES * BLOCKS * total // BUCKETS))).select("bucket", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "hot")
    codes = codes.withColumn("bucket", bucket).join(F.broadcast(sizes), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = codes.where("train").select("code", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("z").alias("za"))
    right = codes.where("held").select("code", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("z").alias("zb"))
    bound = f"cast(floor(greatest(na, nb) * {near:g}D + 1e-9D) as int)"
    met = left.join(right, ["code", "salt"]).where("a <> b").where(F.expr(f"abs(na - nb) <= {bound} AND bit_count(sa ^ sb) + bit_count(za ^ zb) <= 4 * {bound}"))
    met = met.select("a", "b", F.expr(bound).alias("d")).distinct()
    sized = texts.select("id", "text")
    pairs = met.join(sized.toDF("a", "ta"), "a").join(sized.toDF("b", "tb"), "b")
    return pairs.where(F.expr("levenshtein(ta, tb, d) >= 0")).select("a", "b")


def _matched(records: DataFrame, near: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of the texts that have a match, on the train side (a) and the held-out side (b); the pairs a, b."""
    sides = records.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("split").isin("train", "validation", "test"))
    sides = sides.select("grp", "id", "split", "text").distinct().withColumn("text", reduced("text")).where("text <> ''")
    members = cut(sides.distinct(), "members")
    texts = members.groupBy("grp", "text").agg(F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(F.col("split") != "train").alias("held"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    same = texts.where("train AND held").select(F.col("id").alias("a"), F.col("id").alias("b"))
    pairs = cut(near_texts(texts, near).unionByName(same), "near")
    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = texts.join(used, "id", "left_semi").select("grp", "text", F.col("id").alias("t"))
    own = cut(members.join(named, ["grp", "text"]).select("grp", "t", "id", "split"), "own")
    discard(members, texts)
    train = own.where("split = 'train'").select("grp", F.col("t").alias("a"), F.col("id").alias("train_id"))
    held = own.where("split <> 'train'").select("grp", F.col("t").alias("b"), F.col("id").alias("held_id"), F.col("split").alias("held_split"))
    return train, held, pairs


def overlaps(records: DataFrame, near: float = NEAR) -> DataFrame:
    """``grp, train_id, held_id, held_split`` of all equal or near records across splits.

    ``records`` has grp (int), id, text, split; train against validation and test within a grp.
    """
    train, held, pairs = _matched(records, near)
    return train.join(pairs, "a").join(held.drop("grp"), "b").select("grp", "train_id", "held_id", "held_split").where("train_id <> held_id")


def overlap_counts(records: DataFrame, near: float = NEAR) -> DataFrame:
    """``grp, held_split, n_pairs, n_records``: the overlaps counted without making them.

    Ids with one text are counted per text, and texts that match multiply their counts. Only ids
    with several texts or on several sides, whose pairs could repeat, are paired one by one.
    """
    train, held, pairs = _matched(records, near)
    seen = train.select("grp", F.col("train_id").alias("id")).unionByName(held.select("grp", F.col("held_id").alias("id")))
    several = cut(seen.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", "id", F.lit(True).alias("multi")), "several")
    flagged = lambda df, key: df.join(several.withColumnRenamed("id", key), ["grp", key], "left").withColumn("multi", F.coalesce("multi", F.lit(False)))
    train, held = cut(flagged(train, "train_id"), "train"), cut(flagged(held, "held_id"), "held")
    n_train = train.where("NOT multi").groupBy("a").agg(F.count(F.lit(1)).alias("n_train"))
    n_held = held.where("NOT multi").groupBy("grp", "b", "held_split").agg(F.count(F.lit(1)).alias("n_held"))
    counted = pairs.join(n_train, "a").join(n_held, "b").groupBy("grp", "held_split").agg(F.sum(F.col("n_train") * F.col("n_held")).alias("n_pairs"))
    left, right = train.select("a", "train_id", F.col("multi").alias("m")), held.select("grp", "b", "held_id", "held_split", "multi")
    ones = left.where("m").join(pairs, "a").join(right, "b").unionByName(left.where("NOT m").join(pairs, "a").join(right.where("multi"), "b"))
    ones = cut(ones.where("train_id <> held_id").select("grp", "train_id", "held_id", "held_split", "multi").distinct(), "ones")
    records_ = held.where("NOT multi").select("grp", "held_split", "held_id").unionByName(ones.where("multi").select("grp", "held_split", "held_id")).distinct()
    pairs_ = counted.unionByName(ones.groupBy("grp", "held_split").agg(F.count(F.lit(1)).alias("n_pairs"))).groupBy("grp", "held_split").agg(F.sum("n_pairs").alias("n_pairs"))
    return pairs_.join(records_.groupBy("grp", "held_split").agg(F.count(F.lit(1)).alias("n_records")), ["grp", "held_split"])
