"""Splits that keep tied records together: components by random-mate contraction.

Records are tied through shared keys (a user, a task, a trajectory). The graph has one vertex
per key and an edge where one record holds two keys, so its size follows the distinct key pairs
and not the records of a busy user. Each round flips a coin per vertex by hashing; a tail with a
head among its neighbours is merged into the least such head (an aggregation with map-side
combine, so a hub costs no task more than others), edges are rewritten by two joins, and loops
and repeats go. About a quarter of the vertices leave per round, whatever the graph's diameter.
The merges of all rounds form a forest; pointer doubling unwinds it to the final labels.

Splits are cut from the components in the order of a hash, so that no split gets the small or the
large ones only.

Defined cases: a record without any key is a component of its own; keys that are null, empty or
named as nobody tie nothing; tables may be empty; repeated rows are records of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pathloom.storage import cut, discard

MAX_ROUNDS = 200
#: A component beyond this part of the smallest share is placed before the others.
HEAVY = 0.02


def person_key(column: str, nobody: Sequence[str] = ("", "unknown")) -> Column:
    """A user id apart from outer blanks and letter case; null where it names nobody."""
    plain = F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))
    return F.when(~plain.isin(*nobody), plain)


def _mates(edges: DataFrame) -> DataFrame:
    """Each tail with a head among its neighbours, and the least such head.

    The turn is a column, not a literal, so that every round runs the same generated code.
    """
    heads = lambda v: F.xxhash64(v, "turn").bitwiseAND(1) == 1
    ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "turn").select("e.a", "e.b", "turn")
    return ends.where(~heads("a") & heads("b")).groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("label"))


def _counted(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges, each once and from the lesser end, written out; and how many there are."""
    seen = Observation()
    each = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "turn").distinct()
    written = cut(each.observe(seen, F.count(F.lit(1)).alias("n")), "edges")
    return written, seen.get["n"]


def contract(edges: DataFrame) -> DataFrame:
    """``vertex, label`` of every vertex that was merged; ``edges`` has ``a``, ``b``.

    A vertex not in the result is the label of its own component. The edges of a round stay
    until the end: they shrink geometrically, and the merges are read from them once more.
    """
    now, left = _counted(edges.select("a", "b", F.lit(0).alias("turn")))
    rounds: list[DataFrame] = []
    while left:
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"contraction didn't end in {MAX_ROUNDS} rounds")
        rounds.append(now)
        mates = _mates(now)
        one = now.join(mates, now.a == mates.vertex, "left").select(F.coalesce("label", "a").alias("a"), "b", (F.col("turn") + 1).alias("turn"))
        mates = _mates(now)
        two = one.join(mates, one.b == mates.vertex, "left").select("a", F.coalesce("label", "b").alias("b"), "turn")
        now, left = _counted(two)
    discard(now)
    if not rounds:
        kind = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], T.StructType([T.StructField("vertex", kind), T.StructField("label", kind)]))
    merges = _mates(rounds[0])
    for r in rounds[1:]:
        merges = merges.unionByName(_mates(r))
    forest = cut(merges, "forest")
    for r in rounds:
        discard(r)
    # A path is at most as long as there were rounds; doubling halves it each time.
    for _ in range((len(rounds) - 1).bit_length()):
        up = forest.select(F.col("vertex").alias("label"), F.col("label").alias("above"))
        before, forest = forest, cut(forest.join(up, "label", "left").select("vertex", F.coalesce("above", "label").alias("label")), "forest")
        discard(before)
    return forest


def components(records: DataFrame, ids: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``ids`` and ``component`` of every record; records sharing a value in one of ``keys`` are tied.

    Values of different key columns are told apart by a prefix.
    """
    keyed = records.select(F.struct(*ids).alias("_ids"), F.array_compact(F.array(*[F.concat(F.lit(f"{i}:"), F.col(k).cast("string")) for i, k in enumerate(keys)])).alias("_keys"))
    keyed = cut(keyed, "keyed")
    pairs = keyed.where(F.size("_keys") > 1).select("_keys").distinct()
    edges = pairs.select(F.explode(F.transform(F.slice("_keys", 2, len(keys)), lambda k: F.struct(F.col("_keys")[0].alias("a"), k.alias("b")))).alias("e")).select("e.*")
    labels = contract(edges)
    # A record without keys gets a label of its own, which also keeps it out of the joins' hot null.
    own = F.concat(F.lit("row:"), F.to_json("_ids"))
    found = keyed.select("_ids", F.coalesce(F.get("_keys", F.lit(0)), own).alias("vertex"))
    return found.join(labels, "vertex", "left").select("_ids.*", F.coalesce("label", "vertex").alias("component"))


def _placed_large(large: list[tuple[str, int]], shares: dict[str, float], total: int, seed: int) -> tuple[list[tuple[str, str]], dict[str, float]]:
    """A split for each heavy component, drawn in proportion to the room left; and the room left over."""
    room = {name: share * total for name, share in shares.items()}
    placed = []
    for component, weight in large:
        fits = {n: r for n, r in room.items() if r >= weight} or {max(room, key=room.get): 1.0}
        at = int.from_bytes(hashlib.md5(f"{seed}:{component}".encode()).digest()[:8], "big") / 2**64 * sum(fits.values())
        for name, r in fits.items():
            at -= r
            if at < 0:
                break
        room[name] -= weight
        placed.append((component, name))
    return placed, {name: max(0.0, r) for name, r in room.items()}


def assign(labelled: DataFrame, shares: dict[str, float], seed: int = 0, bucket: int = 4096) -> DataFrame:
    """``labelled`` with ``new_split``: whole components, in the given shares of all rows.

    Components are laid end to end in the order of a hash, which depends on nothing else, and cut
    where the cumulative weight passes a share: every split holds small and large components alike.
    Components beyond ``HEAVY`` of the smallest share, of which there are at most 1 / that, would
    move a cut too far; they are drawn first, and what room they leave is cut for the others. The
    running sum goes over totals of hash buckets of about ``bucket`` components, then within each.
    """
    sized = cut(labelled.groupBy("component").agg(F.count("*").alias("weight")), "sized")
    count, total = sized.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    shares = {name: share / sum(shares.values()) for name, share in shares.items()}
    bound = HEAVY * min(shares.values()) * total
    large = sized.where(F.col("weight") > bound).orderBy(F.col("weight").desc(), "component").collect()
    placed, room = _placed_large([(r.component, r.weight) for r in large], shares, total, seed)
    left = max(1.0, sum(room.values()))
    n = max(1, -(-count // bucket))
    light = sized.where(F.col("weight") <= bound).select("*", F.xxhash64("component", F.lit(seed)).alias("hash")).select("*", F.pmod("hash", F.lit(n)).alias("bucket"))
    totals = light.groupBy("bucket").agg(F.sum("weight").alias("own"))
    totals = totals.select("bucket", F.coalesce(F.sum("own").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("bucket").orderBy("hash", "component").rowsBetween(W.unboundedPreceding, -1)
    at = (F.col("before") + F.coalesce(F.sum("weight").over(inside), F.lit(0)) + F.col("weight") / 2) / left
    names, upto, rule = list(shares), 0.0, None
    for name in names[:-1]:
        upto += room[name] / left
        rule = (rule.when if rule is not None else F.when)(at < upto, name)
    chosen = light.join(totals, "bucket").select("component", (rule.otherwise(names[-1]) if rule is not None else F.lit(names[-1])).alias("new_split"))
    if placed:
        kind = labelled.schema["component"].dataType.simpleString()
        chosen = chosen.unionByName(labelled.sparkSession.createDataFrame(placed, f"component {kind}, new_split string"))
    return labelled.drop("new_split").join(chosen, "component")


def crossing(labelled: DataFrame, split: str = "split", train: str = "train", held: Sequence[str] = ("validation", "test")) -> DataFrame:
    """Rows of a held-out split whose component has a row in train."""
    trained = labelled.where(F.col(split) == train).select("component").distinct()
    return labelled.where(F.col(split).isin(*held)).join(trained, "component", "left_semi")
