"""The best earlier references of every target per relation, without a row per pair.

Targets are dealt to blocks and references to buckets by key, so that what a text's first relation
is can be told within a block. Two blocks meet in one task, which compares targets and references
of one user, class or app as matrices over character pairs; what leaves it is a few rows per target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.nearest import pair_sets

#: Most targets of a block and references of a bucket, references of one matrix, and pairs scored at once.
TARGETS, REFERENCES, COLUMNS, PAIRS = 32768, 65536, 4096, 1 << 20
_FOUND = "task_id string, place bigint, relation int, score double, similarity double"


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers for the values of both sides, null as -1; in the order of the values if asked."""
    both = pa.concat_arrays([*left.chunks, *right.chunks]) if left.num_chunks + right.num_chunks else pa.array([], left.type)
    coded = both.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy().astype(np.int64)
    if ordered:
        place = np.empty(len(coded.dictionary) + 1, np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
        place[-1] = -1
        codes = place[codes]
    return codes[: len(left)], codes[len(left) :]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the stretches lo to hi, with the number of its stretch."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which]


class _Side:
    """The character pairs of a block's keys as stretches of one array."""

    def __init__(self, keys: pa.ChunkedArray) -> None:
        owner, self.code = pair_sets(keys.combine_chunks() if keys.num_chunks else pa.array([], pa.string()))
        self.size = np.bincount(owner, minlength=len(keys))
        self.end = np.cumsum(self.size)

    def stretch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who, at = _spread(self.end[rows] - self.size[rows], self.end[rows])
        return who, self.code[at]


def _dense(side: _Side, rows: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    who, code = side.stretch(rows)
    at = column[code]
    out = np.zeros((len(rows), width), np.float32)
    out[who[at >= 0], at[at >= 0]] = 1
    return out


class _Block:
    """A block of targets and a bucket of references, the latest and greatest id first."""

    def __init__(self, left: pa.Table, right: pa.Table, rules: dict) -> None:
        self.rules, self.left, self.right = rules, left, right
        self.a, self.b = _Side(left["key"]), _Side(right["key"])
        seen, code = np.unique(np.concatenate([self.a.code, self.b.code]), return_inverse=True)
        self.vocabulary, self.a.code, self.b.code = len(seen), code[: len(self.a.code)], code[len(self.a.code) :]
        for name in ("key", "user_id", "intent_class", "app", "scenario", "task_id"):
            setattr(self, name, _codes(left[name], right[name]))
        self.time = _codes(left["time"], right["time"], True)
        hours = [x["hour"].fill_null(-1).to_numpy() for x in (left, right)]
        known = [x["hour"].is_valid().to_numpy() for x in (left, right)]
        value, self.hour_at = np.unique(np.concatenate([np.where(k, h, -1000) for h, k in zip(hours, known)]), return_inverse=True)
        d = np.abs(value[:, None] - value[None, :])
        near = 1.0 - np.minimum(d, 24 - d) / 12.0
        near[(value[:, None] == -1000) | (value[None, :] == -1000)] = 0.0
        self.near, self.hour = near, (self.hour_at[: len(left)], self.hour_at[len(left) :])
        named = lambda x: pc.fill_null(pc.not_equal(x, ""), False).to_numpy()
        self.classed, self.set = named(left["intent_class"]), named(left["scenario"])
        self.app_named = left["named"].to_numpy()
        self.found: list[tuple] = []

    def groups(self, codes: tuple[np.ndarray, np.ndarray], some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Targets (those of ``some``) and references of one code; a key's references stay together, the order is kept."""
        x, y = codes
        rows = np.flatnonzero(some & (x >= 0))
        rows = rows[np.argsort(x[rows], kind="stable")]
        cols = np.argsort(y, kind="stable")
        for code in np.intersect1d(x[rows], y):
            ti = rows[slice(*np.searchsorted(x[rows], [code, code + 1]))]
            ri = cols[slice(*np.searchsorted(y[cols], [code, code + 1]))]
            parts = -(-len(ri) // self.rules["columns"])
            for p in range(parts):
                yield ti, ri[self.key[1][ri] % parts == p] if parts > 1 else ri

    def compared(self, ti: np.ndarray, ri: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By portions of targets: targets, references, which pairs may meet, similarity, same scenario, nearness of hours."""
        if not len(ri):
            return
        keys, first, which = np.unique(self.key[1][ri], return_index=True, return_inverse=True)
        in_a, in_b = np.zeros(self.vocabulary, bool), np.zeros(self.vocabulary, bool)
        in_a[self.a.stretch(ti)[1]] = True
        in_b[self.b.stretch(ri[first])[1]] = True
        both = in_a & in_b
        column = np.where(both, np.cumsum(both) - 1, -1)
        refs = _dense(self.b, ri[first], column, int(both.sum()))
        ti = ti[np.argsort(self.time[0][ti], kind="stable")]
        step = max(1, PAIRS // len(ri))
        late = -self.time[1][ri]
        for lo in range(0, len(ti), min(step, 512)):
            t = ti[lo : lo + min(step, 512)]
            start = int(np.searchsorted(late, -self.time[0][t[-1]], side="right"))  # all before are as late as the latest target, or later
            r = ri[start:]
            if not len(r):
                continue
            shared = _dense(self.a, t, column, refs.shape[1]) @ refs.T
            shared = shared[:, which[start:]].astype(np.float64)
            total = self.a.size[t][:, None] + self.b.size[r][None, :]
            similarity = 2.0 * shared / np.maximum(total, 1)
            may = (self.time[1][r][None, :] < self.time[0][t][:, None]) & (self.key[1][r][None, :] != self.key[0][t][:, None])
            scene = (self.scenario[0][t][:, None] == self.scenario[1][r][None, :]) & self.set[t][:, None]
            yield t, r, may, similarity, scene.astype(np.float64), self.near[self.hour[0][t]][:, self.hour[1][r]]

    def keep(self, relation: int, tier: int, t: np.ndarray, r: np.ndarray, may: np.ndarray, score: np.ndarray, similarity: np.ndarray) -> None:
        """The best references per target, each of another key; ties go to the first."""
        left = np.where(may, score, -np.inf)
        rows, key = np.arange(len(t)), self.key[1][r]
        for n in range(self.rules["most"]):
            at = left.argmax(axis=1)
            best = left[rows, at]
            some = np.flatnonzero(best > -np.inf)
            if not len(some):
                return
            self.found.append((t[some], np.full(len(some), relation), np.full(len(some), tier), best[some], r[at[some]], similarity[some, at[some]]))
            if n + 1 < self.rules["most"]:
                left[key[None, :] == key[at][:, None]] = -np.inf

    def own(self) -> None:
        """Relations 1 and 2, within a user; notes texts that so can't be of relation 3."""
        repeated = np.bincount(self.key[1][self.key[1] >= 0], minlength=1) > 1
        out = []
        rule = self.rules
        for ti, ri in self.groups(self.user_id, np.ones(len(self.left), bool)):
            for t, r, may, similarity, scene, near in self.compared(ti, ri):
                same_class = self.classed[t][:, None] & (self.intent_class[0][t][:, None] == self.intent_class[1][r][None, :])
                same_app = self.app_named[t][:, None] & (self.app[0][t][:, None] == self.app[1][r][None, :])
                may = may & (self.task_id[0][t][:, None] != self.task_id[1][r][None, :])
                alike = (same_class | same_app & (similarity >= 0.35)) & (similarity >= rule["least"])
                setting = may & ~alike & ~same_class & ~same_app & ((scene > 0) | (near >= 0.75)) & (similarity < rule["context_most"])
                alike = alike & may
                again = np.flatnonzero(repeated[self.key[1][r]])
                if len(again):
                    again = again[np.argsort(self.key[1][r[again]], kind="stable")]
                    keys, start, size = np.unique(self.key[1][r[again]], return_index=True, return_counts=True)
                    met = np.logical_or.reduceat(alike[:, again], start, axis=1)
                    setting[:, again] &= ~np.repeat(met, size, axis=1)
                    i, k = np.nonzero(met | np.logical_or.reduceat(setting[:, again], start, axis=1))
                    out.append((t[i], keys[k]))
                score = 0.65 * similarity + 0.20 * scene + 0.15 * near
                good = similarity >= rule["positive"]
                self.keep(1, 1, t, r, alike & good, score, similarity)
                self.keep(1, 0, t, r, alike & ~good, score, similarity)
                self.keep(2, 0, t, r, setting, 0.15 * similarity + 0.55 * scene + 0.30 * near, similarity)
        who, key = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(who, kind="stable")
        self.taken = who[order], key[order]

    def others(self) -> None:
        """Relation 3, of other users, through the class or the app."""
        for codes, some in ((self.intent_class, self.classed), (self.app, self.app_named)):
            for ti, ri in self.groups(codes, some):
                for t, r, may, similarity, scene, near in self.compared(ti, ri):
                    user, theirs = self.user_id[0][t][:, None], self.user_id[1][r][None, :]
                    may = may & ((user < 0) | (user != theirs))
                    who, at = _spread(np.searchsorted(self.taken[0], t), np.searchsorted(self.taken[0], t, side="right"))
                    if len(who):
                        order = np.argsort(self.key[1][r], kind="stable")
                        keys, key = self.key[1][r[order]], self.taken[1][at]
                        which, place = _spread(np.searchsorted(keys, key), np.searchsorted(keys, key, side="right"))
                        may[who[which], order[place]] = False
                    self.keep(3, 0, t, r, may, 0.75 * similarity + 0.15 * scene + 0.10 * near, similarity)

    def table(self) -> pa.Table:
        t, relation, tier, score, r, similarity = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((r, -score, -tier, relation, t))
        _, first = np.unique(t[order] * (len(self.right) + len(self.left)) + self.key[1][r[order]], return_index=True)
        order = order[np.sort(first)]
        group = t[order] * 4 + relation[order]
        new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        order = order[np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group)))) < self.rules["most"]]
        return pa.table({"task_id": self.left["task_id"].take(pa.array(t[order])), "place": self.right["place"].take(pa.array(r[order])), "relation": pa.array(relation[order], pa.int32()), "score": pa.array(score[order]), "similarity": pa.array(similarity[order])})


def best_by_relation(targets: DataFrame, references: DataFrame, n_targets: int, n_references: int, **rules) -> DataFrame:
    """``task_id, place, relation (1 to 3), score, similarity``: per bucket of keys the best few references of each target.

    Both sides have ``task_id, key, user_id, time, scenario, intent_class, app, hour``; targets, one row per
    ``task_id``, also ``named`` (whether the app counts), references their ``place`` by time and task_id.
    A text stands at its first relation, and in one bucket only.
    """
    rules = rules | {"columns": COLUMNS}
    blocks = max(1, -(-n_targets // TARGETS), min(4, -(-n_targets // 1024)))
    buckets = max(1, -(-n_references // REFERENCES), min(6, -(-n_references // 4096)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = targets.withColumn("tb", F.pmod(F.xxhash64("task_id"), F.lit(blocks)).cast("int")).withColumn("rb", spread(buckets))
    right = references.withColumn("rb", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).withColumn("tb", spread(blocks))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) and len(right):
            block = _Block(left, right.sort_by([("place", "descending")]), rules)
            block.own()
            block.others()
            if block.found:
                return block.table()
        return pa.table({"task_id": pa.array([], pa.string()), "place": pa.array([], pa.int64()), "relation": pa.array([], pa.int32()), "score": pa.array([], pa.float64()), "similarity": pa.array([], pa.float64())})

    return left.groupBy("tb", "rb").cogroup(right.groupBy("tb", "rb")).applyInArrow(run, _FOUND)
