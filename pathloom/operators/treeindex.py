"""Trees grown from an index of all steps that every worker maps from the shared folder.

The index is a handful of flat files in order of step id. A portion of roots is expanded level by
level in numpy; nothing but the index is written or shuffled, however many paths there are.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.causal import beside
from pathloom.operators.ranking import numbered
from pathloom.storage import cut, passing, qualified, shared_dir

#: Roots expanded at once, candidates of a block from which it is one matrix, pairs scored at once, rows handed over at once.
ROOTS, DENSE, PAIRS, ROWS = 32768, 16, 1 << 20, 1 << 17
BLOCKS = ("app", "state_key", "intent_key")
_HASHES, _NUMBERS = ("user_id", *BLOCKS), ("rank", "time", "next", "action_no")


def local_folder(spark) -> str | None:
    """The shared folder as a path, or null where it isn't on a mounted file system.

    A folder named without a scheme is on the file system that the session takes for its own.
    """
    place = qualified(spark, shared_dir(spark))
    return place.getPath() if place.getScheme() == "file" else None


def _ordered(df: DataFrame, name: str, out: str) -> tuple[DataFrame, DataFrame]:
    """``i`` with a number from 1 for its value in the order of values, where it has one; and the values."""
    df = df.select("i", name).where(F.coalesce(F.col(name), F.lit("")) != "")
    values = numbered(df.select(F.col(name).alias("_v")).distinct(), [F.col("_v")], out)
    return df.join(values, F.col(name) == F.col("_v")).select("i", out), values


def slim(steps: DataFrame) -> DataFrame:
    """Steps with hashes for what is only compared; an absent or empty value is 0."""
    same = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(c)).alias(c)
    words = F.transform(F.array_distinct("tokens"), lambda w: F.xxhash64(w))
    return steps.select("step_id", same("user_id"), "episode_id", "step_index", "time", *[same(b) for b in BLOCKS], F.coalesce(words, F.array().cast("array<bigint>")).alias("tokens"), "action", F.col("rank").cast("bigint").alias("rank"), "eligible")


def _sized(path: str, n: int, kind) -> None:
    with open(path, "wb") as f:
        f.truncate(n * np.dtype(kind).itemsize)  # pages that stay 0 take no room


def _placed(folder: str, name: str, kind, at: np.ndarray, values: np.ndarray) -> None:
    some = np.flatnonzero(values)
    if len(some):
        file = np.memmap(f"{folder}/{name}", kind, "r+")
        file[at[some]] = values[some]


def _parts(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all rows of a column of strings or lists in one, and how many each row has."""
    x = b.column(name)
    if pa.types.is_list(x.type):
        return x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(x.offsets.to_numpy()).astype(np.int64)
    x = pa.concat_arrays([x.cast(pa.large_binary())])
    start = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] else np.zeros(0, np.uint8)
    return data[start[0] : start[-1]], np.diff(start)


def _kept(df: DataFrame, folder: str, n: int, flat: dict[str, type], long: dict[str, type]) -> None:
    """Write columns to files where each row has its place ``i`` below ``n``; every task writes its own rows.

    ``flat`` are numbers, 0 where there is no row; of ``long`` the sizes are written first and their sums
    are where each row starts.
    """
    for name, kind in flat.items():
        _sized(f"{folder}/{name}", n, kind)
    for name in long:
        _sized(f"{folder}/{name}.start", n + 1, np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("i").to_numpy().astype(np.int64)
            for name, kind in flat.items():
                _placed(folder, name, kind, at, b.column(name).to_numpy(zero_copy_only=False).astype(kind))
            for name in long:
                _placed(folder, f"{name}.start", np.int64, at + 1, b.column(f"{name}_size").to_numpy().astype(np.int64))
        yield from ()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("i").to_numpy().astype(np.int64)
            for name, kind in long.items():
                codes, size = _parts(b, name)
                start = np.memmap(f"{folder}/{name}.start", np.int64, "r")[at]
                if len(codes):
                    np.memmap(f"{folder}/{name}", kind, "r+")[_spread(start, start + size)[1]] = codes
        yield from ()

    sizes = [(F.octet_length(name) if kind is np.uint8 else F.size(name)).cast("bigint").alias(f"{name}_size") for name, kind in long.items()]
    df.select("i", *flat, *sizes).mapInArrow(first, "n bigint").collect()  # no rows
    if long:
        for name, kind in long.items():
            start = np.memmap(f"{folder}/{name}.start", np.int64, "r+")
            np.cumsum(start, out=start)
            start.flush()
            _sized(f"{folder}/{name}", int(start[-1]), kind)
        df.select("i", *long).mapInArrow(second, "n bigint").collect()  # no rows


def _blocks(folder: str) -> None:
    """Steps that may be met, by block and the latest first, and where each block's begin."""
    number = _number(folder)
    able = np.flatnonzero((np.asarray(_mapped(f"{folder}/able", np.int8)) > 0) & (np.asarray(_mapped(f"{folder}/next", number)) > 0))
    rank = _mapped(f"{folder}/rank", number)
    for k in BLOCKS:
        block = _mapped(f"{folder}/{k}")[able]
        some = block != 0
        member, block = able[some], block[some]
        order = np.lexsort((member, -rank[member].astype(np.int64), block))
        codes, first = np.unique(block[order], return_index=True)
        member[order].astype(number).tofile(f"{folder}/{k}.member")
        codes.tofile(f"{folder}/{k}.block")
        np.append(first, len(member)).astype(np.int64).tofile(f"{folder}/{k}.first")


def built(steps: DataFrame, roots: DataFrame, folder: str) -> tuple[DataFrame, str]:
    """Places (``i``, by step id) of the roots, and the folder of the index of ``steps`` (slim).

    Rows are shuffled whole once, into the order of step ids; what comes from other rows (the following step,
    the order of times and actions) is found over narrow columns, and every task writes its rows to their
    places in the files.
    """
    spark = steps.sparkSession
    with passing(spark) as cuts:
        placed = numbered(steps, [F.col("step_id")], "_i").withColumn("i", F.col("_i") - 1)
        n = placed.count()
        number = np.int32 if n < 1 << 31 else np.int64
        folder = f"{folder}/index-{uuid.uuid4().hex}-{np.dtype(number).itemsize}"
        os.makedirs(folder)
        chosen = cut(placed.select("step_id", "i").join(roots.select("step_id"), "step_id", "left_semi").select("i"), "roots")
        cuts.remove(chosen._cut_path)
        able = F.coalesce(F.col("eligible"), F.lit(False)).cast("tinyint").alias("able")
        _kept(placed.select("i", "user_id", *BLOCKS, "rank", able, "step_id", "tokens"), folder, n, {"user_id": np.int64, **dict.fromkeys(BLOCKS, np.int64), "rank": number, "able": np.int8}, {"step_id": np.uint8, "tokens": np.int64})
        with passing(spark):
            after = beside(placed.where("episode_id IS NOT NULL").select("i", "episode_id", "step_index"), ["episode_id"], [F.col("step_index"), F.col("i")], {"next": "i"})
            _kept(after.where("next IS NOT NULL").select("i", (F.col("next") + 1).alias("next")), folder, n, {"next": number}, {})
        with passing(spark):
            times, _ = _ordered(placed, "time", "time_no")
            _kept(times.withColumnRenamed("time_no", "time"), folder, n, {"time": number}, {})
        with passing(spark):
            actions, texts = _ordered(placed, "action", "action_no")
            _kept(actions, folder, n, {"action_no": number}, {})
            _kept(texts.select(F.col("action_no").alias("i"), F.col("_v").alias("action")), folder, texts.count() + 1, {}, {"action": np.uint8})
    spark.range(1).repartition(1).mapInArrow(lambda batches: [_blocks(folder) for b in batches if len(b)] and iter(()), "n bigint").collect()  # no rows
    return chosen, folder


def _number(folder: str):
    return np.int32 if folder.endswith("-4") else np.int64


def _mapped(path: str, kind=np.int64) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which]


def _nth(*keys: np.ndarray) -> np.ndarray:
    """Places from 0 within runs of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))


class _Index:
    def __init__(self, folder: str) -> None:
        for k in _HASHES:
            setattr(self, k, _mapped(f"{folder}/{k}"))
        for k in _NUMBERS:
            setattr(self, k, _mapped(f"{folder}/{k}", _number(folder)))
        self.member = {k: _mapped(f"{folder}/{k}.member", _number(folder)) for k in BLOCKS}
        self.block = {k: (_mapped(f"{folder}/{k}.block"), _mapped(f"{folder}/{k}.first")) for k in BLOCKS}
        self.token, self.start = _mapped(f"{folder}/tokens"), _mapped(f"{folder}/tokens.start")
        self.text = {k: (_mapped(f"{folder}/{k}.start"), _mapped(f"{folder}/{k}", np.uint8)) for k in ("step_id", "action")}

    def strings(self, kind: str, at: np.ndarray) -> pa.Array:
        start, data = self.text[kind]
        return pa.LargeStringArray.from_buffers(len(start) - 1, pa.py_buffer(start), pa.py_buffer(data)).take(pa.array(at)).cast(pa.string())

    def words(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner and code of every token, and how many each step has."""
        lo, hi = self.start[at], self.start[at + 1]
        who, place = _spread(lo, hi)
        return who, self.token[place], hi - lo

    def score(self, shared: np.ndarray, q: np.ndarray, c: np.ndarray, nq: np.ndarray, nc: np.ndarray) -> np.ndarray:
        """Similarity of steps q and c, broadcast, as in ``step_similarity``."""
        intent = (self.intent_key[q] == self.intent_key[c]) & (self.intent_key[q] != 0)
        out = np.where(self.app[q] == self.app[c], 2.0, 0.0) + np.where(self.state_key[q] == self.state_key[c], 3.0, 0.0) + np.where(intent, 1.0, 0.0)
        return out + np.where((nq > 0) & (nc > 0), shared / np.maximum(nq + nc - shared, 1), 0.0)

    def open(self, root: np.ndarray, proxy: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether candidates are of the root's user, and whether they may be met."""
        same = self.user_id[root] == self.user_id[c]
        earlier = np.where(same, self.rank[c] < self.rank[root], (self.time[root] == 0) | (self.time[c] < self.time[root]))
        return same, earlier & (c != proxy)

    def met(self, root: np.ndarray, proxy: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per node and side (its user's steps or others') the best of each block: node, candidate, same user, score."""
        out = []
        for name in BLOCKS:
            key = getattr(self, name)[proxy]
            codes, first = self.block[name]
            at = np.minimum(np.searchsorted(codes, key), max(len(codes) - 1, 0))
            found = (codes[at] == key) & (key != 0) if len(codes) else np.zeros(len(key), bool)
            lo = first[np.where(found, at, 0)]
            hi = np.where(found, first[np.where(found, at + 1, 0)], lo)
            small = np.flatnonzero((hi > lo) & (hi - lo <= DENSE))
            step = PAIRS // DENSE
            for part in range(0, len(small), step):
                out.append(self._listed(name, small[part : part + step], lo, hi, root, proxy))
            large = np.flatnonzero(hi - lo > DENSE)
            large = large[np.argsort(lo[large], kind="stable")]
            first = np.flatnonzero(np.append(True, np.diff(lo[large]) != 0)) if len(large) else []
            for a, b in zip(first, np.append(first[1:], len(large))):
                nodes = large[a:b]
                cand = np.asarray(self.member[name][lo[nodes[0]] : hi[nodes[0]]])
                out += self._dense(nodes, cand, root, proxy, most)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))

    def _listed(self, name, nodes, lo, hi, root, proxy):
        who, at = _spread(lo[nodes], hi[nodes])
        node, c = nodes[who], self.member[name][at]
        same, may = self.open(root[node], proxy[node], c)
        node, c, same = node[may], c[may], same[may]
        q = proxy[node]
        nq, nc = self.start[q + 1] - self.start[q], self.start[c + 1] - self.start[c]
        pair, left = _spread(self.start[q], np.where(nc > 0, self.start[q + 1], self.start[q]))
        code, other = self.token[left], c[pair]
        shared = np.zeros(len(q), np.int64)
        for k in range(int(nc.max(initial=0))):
            has = nc[pair] > k
            hit = self.token[np.minimum(self.start[other] + k, len(self.token) - 1)] == code
            shared += np.bincount(pair[has & hit], minlength=len(q))
        return node, c, same, self.score(shared, q, c, nq, nc) + np.where(same, 0.25, 0.0)

    def _dense(self, nodes, cand, root, proxy, most):
        wc, tc, nc = self.words(cand)
        vocabulary = np.unique(tc)
        right = np.zeros((len(cand), len(vocabulary)), np.float32)
        right[wc, np.searchsorted(vocabulary, tc)] = 1
        out, rows = [], max(1, PAIRS // len(cand))
        for lo in range(0, len(nodes), rows):
            node = nodes[lo : lo + rows]
            q = proxy[node]
            wq, tq, nq = self.words(q)
            left = np.zeros((len(q), len(vocabulary)), np.float32)
            if len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, tq), len(vocabulary) - 1)
                hit = vocabulary[at] == tq
                left[wq[hit], at[hit]] = 1
            shared = (left @ right.T).astype(np.float64)
            score = self.score(shared, q[:, None], cand[None, :], nq[:, None], nc[None, :])
            same, may = self.open(root[node][:, None], q[:, None], cand[None, :])
            at = np.arange(len(node))
            for own in (True, False):
                side = np.where(may & (same == own), score + 0.25 if own else score, -1.0)
                for _ in range(most):
                    best = side.argmax(axis=1)
                    value = side[at, best]
                    some = np.flatnonzero(value >= 0)
                    if not len(some):
                        break
                    out.append((node[some], cand[best[some]], np.full(len(some), own), value[some]))
                    side[at, best] = -1.0
        return out


_OPEN: dict[str, _Index] = {}


def _levels(index: _Index, roots: np.ndarray, depth: int, same_k: int, cross_k: int, most: int):
    """Per level: roots, name and actions of the path, and per edge action, support, sources, example, place, next step."""
    root, proxy, name, done = roots, roots, np.zeros(len(roots), np.int64), np.zeros((len(roots), 0), np.int64)
    for level in range(depth):
        node, c, same, score = index.met(root, proxy, max(same_k, cross_k))
        source = np.where(same, 2, 3)
        order = np.lexsort((c, -index.rank[c], -score, source, node))
        node, c, source = node[order], c[order].astype(np.int64), source[order]
        new = _nth(node, source, c) == 0  # a step met in two blocks has one score, so its rows are neighbours
        node, c, source = node[new], c[new], source[new]
        n = _nth(node, source) + 1
        few = n <= np.where(source == 2, same_k, cross_k)
        every = np.arange(len(root))
        node, c, source, n = (np.concatenate(x) for x in ((every, node[few]), (proxy, c[few]), (np.ones(len(every), np.int64), source[few]), (np.zeros(len(every), np.int64), n[few])))
        action = index.action_no[c]
        some = np.flatnonzero(action > 0)
        some = some[np.lexsort((c[some], n[some], source[some], action[some], node[some]))]
        node, c, source, action = node[some], c[some], source[some], action[some]
        first = np.flatnonzero(_nth(node, action) == 0)
        support = np.diff(np.append(first, len(node)))
        mask = np.bitwise_or.reduceat(1 << (source - 1), first) if len(first) else np.zeros(0, np.int64)
        node, example, action, lead = node[first], c[first], action[first], source[first] > 1
        order = np.lexsort((action, -support, lead, node))
        place = _nth(node[order])
        order, place = order[place < most], place[place < most]
        node, example, support, mask = node[order], example[order], support[order], mask[order]
        follow = index.next[example].astype(np.int64) - 1
        path = np.concatenate([done[node], example[:, None]], axis=1)
        to = name[node] * most + place
        yield level, root[node], name[node], path, support, mask, example, to, follow
        on = follow >= 0
        root, proxy, name, done = root[node][on], follow[on], to[on], path[on]


def _names(most: int, level: int) -> pa.Array:
    names = [":"]
    for _ in range(level):
        names = [f"{x}{p + 1}." for x in names for p in range(most)]
    return pa.array(names, pa.string())


def grown(roots: DataFrame, folder: str, sources: tuple[str, ...], leaves: bool, depth: int, same_k: int, cross_k: int, most: int) -> DataFrame:
    """Edges, or leaves, of the trees of ``roots`` (``i``)."""
    tags = pa.array(["+".join(s for k, s in enumerate(sources) if m >> k & 1) for m in range(1 << len(sources))], pa.string())

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(b.column("i").to_numpy().astype(np.int64))
            if sum(map(len, held)) >= ROOTS:
                yield np.concatenate(held)
                held = []
        if held:
            yield np.concatenate(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in portions(batches):
            if folder not in _OPEN:
                _OPEN.clear()
                _OPEN[folder] = _Index(folder)
            index = _OPEN[folder]
            for level, root, name, path, support, mask, example, to, follow in _levels(index, portion, depth, same_k, cross_k, most):
                chosen = np.flatnonzero((follow < 0) | (level + 1 == depth)) if leaves else np.arange(len(root))
                names = _names(most, level + leaves)
                for lo in range(0, len(chosen), ROWS):
                    at = chosen[lo : lo + ROWS]
                    ids = index.strings("step_id", root[at])
                    label = pc.binary_join_element_wise(ids, names.take(pa.array((to if leaves else name)[at])), "")
                    if leaves:
                        words = index.strings("action", index.action_no[path[at].ravel()])
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * path.shape[1]), words)
                        yield pa.RecordBatch.from_arrays([ids, label, lists], ["root_id", "leaf", "actions"])
                    else:
                        yield pa.RecordBatch.from_arrays([ids, label, pa.array(np.full(len(at), level, np.int32)), index.strings("action", index.action_no[example[at]]), pa.array(support[at].astype(np.int64)), tags.take(pa.array(mask[at])), index.strings("step_id", example[at])], ["root_id", "node", "depth", "action", "support", "source", "example"])

    form = "root_id string, leaf string, actions array<string>" if leaves else "root_id string, node string, depth int, action string, support bigint, source string, example string"
    return roots.mapInArrow(run, form)
