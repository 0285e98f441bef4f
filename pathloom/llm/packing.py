"""Fixed-capacity containers filled with items of varying length, by minimum bin slack.

Items are dealt to windows of bounded size by hash. Within a window each container begins with
the longest item left, and a subset-sum over the multiset of remaining lengths finds the filling
closest to the capacity: the reachable sums are the bits of one integer, a length that occurs
several times is added by doubling counts, and the counts taken of each length are read back
from the bitsets. What lies in containers with much space left is dealt again to fewer windows
until one window is left, so that unused space doesn't grow with the number of windows.

Only lengths and ids meet in a window, never texts. An item longer than the capacity becomes
full containers and one remainder; no other item is split. Items of length zero (empty and null
texts) take no space and stand at the end of a container of their window.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.storage import cut, discard

CAPACITY = 2048
#: Items of a window on average; the largest window of a hash deal exceeds it by a few percent.
WINDOW = 4096
#: A container with more than this share unused is dealt again, while several windows are left.
LOOSE = 0.005
#: Where more than this share of the items dealt lies in loose containers, dealing again is at its end.
SETTLED = 0.9
#: Levels of dealing, and partitions of one level; windows beyond the latter share partitions.
_LEVELS, MAX_TASKS = 40, 20_000

PLACED = T.StructType([
    T.StructField("item", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("size", T.IntegerType()),
    T.StructField("container", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("done", T.BooleanType()),
])


def fill(lengths: dict[int, int], room: int) -> dict[int, int]:
    """Counts per length, from the multiset ``lengths``, of the sum closest to ``room`` from below."""
    full = (1 << room + 1) - 1
    bits, steps = 1, []
    for length in sorted(lengths, reverse=True):
        if length > room or not lengths[length]:
            continue
        left, take = min(lengths[length], room // length), 1
        while left:
            n = min(take, left)
            steps.append((length, n, bits))
            bits |= (bits << length * n) & full
            left -= n
            take *= 2
        if bits >> room & 1:
            break
    best, taken = bits.bit_length() - 1, defaultdict(int)
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            best -= length * n
            taken[length] += n
    return taken


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` in each container; every size is from 1 to ``capacity``."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        by_length[sizes[i]].append(i)
    left = {length: len(v) for length, v in by_length.items()}
    out = []
    for longest in sorted(by_length, reverse=True):
        while left[longest]:
            left[longest] -= 1
            own = [by_length[longest].pop()]
            for length, n in fill(left, capacity - longest).items():
                left[length] -= n
                own += [by_length[length].pop() for _ in range(n)]
            out.append(own)
    return out


def _window(capacity: int, last: bool):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "item", "part"], ascending=[False, True, True], kind="stable")
        sized, empty = items[items["size"] > 0], items[items["size"] == 0]
        ids, parts, sizes = sized["item"].tolist(), sized["part"].tolist(), sized["size"].tolist()
        base = key[0] << 20
        rows, end = [], None
        for at, own in enumerate(pack(sizes, capacity)):
            space, start = capacity - sum(sizes[i] for i in own), 0
            done = last or space <= capacity * LOOSE
            for i in own:
                rows.append((ids[i], parts[i], sizes[i], base + at, start, done))
                start += sizes[i]
            if done:
                end = (base + at, start, True)
        # Items without length stand at the end of a container that stays; else they are dealt again.
        end = end or (base, 0, last)
        rows += [(i, p, 0, *end) for i, p in zip(empty["item"].tolist(), empty["part"].tolist())]
        return pd.DataFrame(rows, columns=PLACED.names)

    return run


def containers(df: DataFrame, item: str, size: str | Column, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """``item, part, size, container, start``: where each item, or each part of a long one, lies.

    Every level deals what is left to one partition per window (their few bytes would otherwise be
    merged into one task). The last level keeps all of its containers, whatever space they have.
    """
    length = F.col(size) if isinstance(size, str) else size
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity))).cast("array<int>")
    items = df.select(F.col(item).cast("bigint").alias("item"), F.coalesce(length.cast("bigint"), F.lit(0)).alias("n"))
    left = cut(items.select("item", F.explode(parts).alias("part"), "n").select("item", "part", F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("size")), "items")
    base, count = left, left.count()
    out, level = None, 0
    while True:
        windows = max(1, -(-count // window))
        last = windows == 1 or level == _LEVELS - 1
        dealt = left.select("item", "part", "size", (F.pmod(F.xxhash64("item", "part", F.lit(level)), F.lit(windows)) * _LEVELS + level).alias("w"))
        dealt = dealt.repartition(min(windows, MAX_TASKS), "w")
        placed = cut(dealt.groupBy("w").applyInPandas(_window(capacity, last), PLACED), "placed")
        loose = 0 if last else placed.where("NOT done").count()
        settled = not loose or loose > SETTLED * count  # dealing again gains nothing: these containers stay as they are
        done = placed if settled else placed.where("done")
        out = done if out is None else out.unionByName(done)
        if level == 0:
            discard(base)
        if settled:
            return out.drop("done")
        left, count, level = placed.where("NOT done").select("item", "part", "size"), loose, level + 1
