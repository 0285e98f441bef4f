"""The most alike row of another group, searched in an index that every worker maps from the shared folder.

Rows are dealt to centres (sets of character pairs that texts of one form have in common) and a part of
a centre's rows is an inverted index of where they depart from the centre: what two rows share is the
centre's size, less what each lacks of it, plus the departures that they have in common. A part is only
looked into by rows that could be more alike to one of its rows than to what they have found: of every
row of a part the pairs in and out of the centre are counted, and no more of either can be shared. So
the search is exact whatever the centres are; they only decide what it costs.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.nearest import pair_sets
from pathloom.operators.ranking import numbered
from pathloom.operators.treeindex import _kept, _mapped, _spread
from pathloom.storage import passing

#: Rows that centres are drawn from, most centres, likeness of a centre's neighbours, rows of a part, targets of a task's portion.
SAMPLE, CENTRES, NEAR, PART, PORTION = 2048, 48, (0.5, 0.35, 0.2), 32768, 8192
#: Bits of a row's signature, to which the pairs of a part that are outside of its centre are dealt by how common they are.
HEAVY = 256
#: Departures that must at least be in common for a part to be searched by signatures, and pairs compared at once.
FEWEST, PAIRS = 4, 1 << 16
#: Quotients of whole numbers below this are told apart in single precision.
SINGLE = 2800


def _keys(folder: str, at: np.ndarray) -> pa.Array:
    start, data = _mapped(f"{folder}/key.start"), _mapped(f"{folder}/key", np.uint8)
    size = start[at + 1] - start[at]
    text = data[_spread(start[at], start[at + 1])[1]]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(np.ascontiguousarray(text)))


def _dense(owner: np.ndarray, code: np.ndarray, n: int, vocabulary: np.ndarray) -> np.ndarray:
    """0/1 rows over a sorted vocabulary."""
    out = np.zeros((n, len(vocabulary)), np.float32)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
        some = vocabulary[at] == code
        out[owner[some], at[some]] = 1
    return out


def _centres(folder: str) -> None:
    """Centres of a sample: again and again the row with most neighbours among those not yet near a centre, and the pairs that half of them have."""
    n = len(_mapped(f"{folder}/row_id"))
    at = np.unique(np.linspace(0, n - 1, min(n, SAMPLE)).astype(np.int64)) if n else np.zeros(0, np.int64)
    owner, code = pair_sets(_keys(folder, at))
    vocabulary, times = np.unique(code, return_counts=True)
    rows = _dense(owner, code, len(at), vocabulary[times > 1])
    size = np.bincount(owner, minlength=len(at)).astype(np.float32)
    shared = rows @ rows.T
    alike = 2 * shared / np.maximum(size[:, None] + size[None, :], 1)
    left, codes, starts = size > 0, [np.zeros(0, np.int64)], [0, 0]  # the first centre is empty
    for least in NEAR:
        near = alike >= least
        while left.any() and len(starts) <= CENTRES:
            count = (near[:, left] & left[:, None]).sum(axis=1)
            best = int(count.argmax())
            if count[best] <= len(at) // 100:
                break
            group = near[best] & left
            codes.append(vocabulary[times > 1][rows[group].mean(axis=0) >= 0.5])
            starts.append(starts[-1] + len(codes[-1]))
            left &= ~group
            left[best] = False
    np.concatenate(codes).tofile(f"{folder}/centre.codes")
    np.array(starts, np.int64).tofile(f"{folder}/centre.start")


class _Centres:
    def __init__(self, folder: str) -> None:
        codes, start = _mapped(f"{folder}/centre.codes"), _mapped(f"{folder}/centre.start")
        self.sets = [np.asarray(codes[a:b]) for a, b in zip(start[:-1], start[1:])]
        self.vocabulary = np.unique(codes)
        self.size = np.diff(start)
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        self.rows = _dense(owner, np.asarray(codes), len(self.sets), self.vocabulary)

    def inside(self, owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        """How many pairs of each row each centre has."""
        return (_dense(owner, code, n, self.vocabulary) @ self.rows.T).astype(np.int64)


def _dealt(folder: str, lo: int, hi: int) -> None:
    centres = _Centres(folder)
    for a in range(lo, hi, PORTION):
        b = min(a + PORTION, hi)
        owner, code = pair_sets(_keys(folder, np.arange(a, b)))
        apart = centres.size[None, :] - 2 * centres.inside(owner, code, b - a)  # departures from each centre, less the row's own size
        np.memmap(f"{folder}/centre", np.int32, "r+")[a:b] = apart.argmin(axis=1)


def _parts(folder: str) -> None:
    """Rows by centre in order of time, the bounds of the parts, and the first rows of each group by two users."""
    centre, user, group, time = (np.asarray(_mapped(f"{folder}/{k}", kind)) for k, kind in (("centre", np.int32), ("u", np.int64), ("a", np.int64), ("time", np.int64)))
    order = np.argsort(centre, kind="stable")
    order.tofile(f"{folder}/member")
    ends = np.append(np.flatnonzero(np.diff(centre[order])) + 1, len(order)) if len(order) else []
    bounds, lo = [], 0
    for hi in ends:
        bounds += [(a, min(a + PART, hi), centre[order[lo]]) for a in range(lo, hi, PART)]
        lo = hi
    np.array(bounds, np.int64).tofile(f"{folder}/part")
    firsts = []
    by = np.argsort(group, kind="stable")
    for rows in np.split(by, np.flatnonzero(np.diff(group[by])) + 1) if len(by) else []:
        for some in (rows[time[rows] > 0], rows):
            if len(some):
                other = np.flatnonzero(user[some] != user[some[0]])[:1]
                firsts += [(group[i], user[i], i, time[i]) for i in (some[0], *some[other])]
    np.array(firsts, np.int64).tofile(f"{folder}/first")


def _words() -> int:
    return max(2, -(-HEAVY // 64))


def _signatures(owner: np.ndarray, bit: np.ndarray, n: int) -> np.ndarray:
    """The bits of each of n rows, by word."""
    out = np.zeros((n, 64 * _words()), np.bool_)
    out[owner, bit] = True
    return np.ascontiguousarray(np.packbits(out, axis=1, bitorder="little").view(np.uint64).T)


def _folded(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of two words, of which every bit is one of several."""
    return np.bitwise_or.reduce(marks[::2]), np.bitwise_or.reduce(marks[1::2])


def _folded_not(without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bitwise_and.reduce(without[::2]), np.bitwise_and.reduce(without[1::2])


def _indexed(folder: str, p: int) -> None:
    lo, hi, c = _mapped(f"{folder}/part").reshape(-1, 3)[p]
    core = _Centres(folder).sets[c]
    at = np.asarray(_mapped(f"{folder}/member")[lo:hi])
    owner, code = pair_sets(_keys(folder, at))
    size = np.bincount(owner, minlength=len(at))
    inside = np.isin(code, core)
    has = _dense(owner[inside], code[inside], len(at), core)
    lacks, what = np.nonzero(has == 0)
    owner, code = np.concatenate([owner[~inside], lacks]), np.concatenate([code[~inside], core[what]])
    order = np.lexsort((owner, code))
    codes, start, named, times = np.unique(code[order], return_index=True, return_inverse=True, return_counts=True)
    bit = np.full(len(codes), -1)
    outside = np.flatnonzero(~_has(core, codes))
    bit[outside[np.argsort(-times[outside], kind="stable")]] = np.arange(len(outside)) % (64 * _words())
    row, name = owner[order], named.astype(np.uint16 if len(codes) < 1 << 16 else np.int64)
    marks = _signatures(row[bit[named] >= 0], bit[named][bit[named] >= 0], len(at))
    by_row = np.argsort(row, kind="stable")
    of = np.append(0, np.cumsum(np.bincount(row, minlength=len(at))))
    lacks = np.bincount(lacks, minlength=len(at))
    shapes, shape = np.unique(np.stack([len(core) - lacks, size - len(core) + lacks], axis=1), axis=0, return_inverse=True)  # pairs inside and outside of the centre
    dated = at[np.asarray(_mapped(f"{folder}/time")[at]) > 0]
    kind = np.uint16 if len(at) < 1 << 16 else np.int64
    np.savez(f"{folder}/part-{p}.npz", post=row.astype(kind), codes=codes, start=np.append(start, len(order)), size=size.astype(np.int32), lacks=lacks.astype(np.int32), shapes=shapes, earliest=dated[:1], bit=bit, marks=marks, name=name[by_row], of=of, shape=shape.ravel().astype(np.int32))


class _Part:
    def __init__(self, folder: str, p: int) -> None:
        lo, hi, self.centre = _mapped(f"{folder}/part").reshape(-1, 3)[p]
        at = np.asarray(_mapped(f"{folder}/member")[lo:hi])
        with np.load(f"{folder}/part-{p}.npz") as held:
            self.post, self.codes, self.start, size, lacks = (held[k] for k in ("post", "codes", "start", "size", "lacks"))
            self.bit, self.marks, self.name, self.of, self.shapes = (held[k] for k in ("bit", "marks", "name", "of", "shapes"))
            self.shape = held["shape"].astype(np.intp)
        self.folded = _folded(self.marks)
        self.inside, self.outside, self.whole = (x[None, :] for x in (*self.shapes.T, self.shapes.sum(axis=1)))
        self.room = *(np.empty(len(at), kind) for kind in (np.uint8, np.uint8, np.bool_, np.uint64)),
        self.at = at
        self.kind = np.float32 if size.max(initial=0) < SINGLE // 2 else np.float64
        self.size, self.lacks = size.astype(self.kind), lacks.astype(self.kind)
        self.undated = int(np.searchsorted(np.asarray(_mapped(f"{folder}/time")[at]) > 0, True))
        self.user, self.group = np.asarray(_mapped(f"{folder}/u")[at]), np.asarray(_mapped(f"{folder}/a")[at])
        self.apart: dict[int, np.ndarray] = {}

    def others(self, group: int) -> np.ndarray:
        if group not in self.apart:
            if len(self.apart) >= 64:
                self.apart.clear()
            self.apart[group] = (self.group != group).astype(self.kind)
        return self.apart[group]


def _has(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(codes):
        return np.zeros(len(of), bool)
    return codes[np.minimum(np.searchsorted(codes, of), len(codes) - 1)] == of


def _most(shapes: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The highest likeness to rows of such shapes of a row of n pairs that shares p at most inside of the centre and q outside."""
    both, back = np.unique(np.stack([p, q, n]), axis=1, return_inverse=True)
    p, q, n = both[:, :, None]
    h, o = shapes[None, :, 0], shapes[None, :, 1]
    return (2.0 * (np.minimum(p, h) + np.minimum(q, o)) / np.maximum(n + h + o, 1)).max(axis=1)[back.ravel()]


_LAST: list = [None, None]


def _held(folder: str) -> tuple[_Centres, list[tuple[np.ndarray, int]], np.ndarray]:
    """Centres, the shapes and the first dated row of every part, and their bounds, kept while a worker stays with one index."""
    if _LAST[0] != folder:
        centres = _Centres(folder)
        bounds = _mapped(f"{folder}/part").reshape(-1, 3)
        parts = []
        for p in range(len(bounds)):
            with np.load(f"{folder}/part-{p}.npz") as held:
                parts.append((held["shapes"], int(held["earliest"][0]) if len(held["earliest"]) else np.iinfo(np.int64).max))
        _LAST[:] = folder, (centres, parts, bounds)
    return _LAST[1]


def _found(folder: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``lo`` to ``hi`` in order of centre, and the likeness of their best reference of any time and of earlier ones; -1 for none."""
    centres, parts, bounds = _held(folder)
    at = np.asarray(_mapped(f"{folder}/member")[lo:hi])
    user, group, time = (np.asarray(_mapped(f"{folder}/{k}")[at]) for k in ("u", "a", "time"))
    before = np.where(time > 0, time - 1, 0)  # earlier rows stand before this place
    owner, code = pair_sets(_keys(folder, at))
    start = np.searchsorted(owner, np.arange(len(at) + 1))
    size = np.diff(start)
    inside = centres.inside(owner, code, len(at))
    most = np.zeros((len(at), len(parts)))
    for p, (shapes, _) in enumerate(parts):
        c = bounds[p, 2]
        most[:, p] = _most(shapes, inside[:, c], size - inside[:, c], size)
    best, past = np.zeros(len(at)), np.zeros(len(at))
    own = np.asarray(_mapped(f"{folder}/centre", np.int32)[at])
    order = sorted(range(len(parts)), key=lambda p: (-int((own == bounds[p, 2]).sum()), -float(most[:, p].mean())))
    for p in order:
        whole = most[:, p] > best
        some = np.flatnonzero((size > 0) & (whole | ((most[:, p] > past) & (parts[p][1] < before))))
        if len(some):
            _looked(_Part(folder, p), centres.sets[bounds[p, 2]], some, whole, most[:, p], user, group, before, code, start, size, best, past)
    first = _mapped(f"{folder}/first").reshape(-1, 4)
    for found, when in ((best, None), (past, before)):
        for i in np.flatnonzero(found == 0):
            may = (first[:, 0] != group[i]) & (first[:, 1] != user[i])
            if not (may if when is None else may & (first[:, 3] > 0) & (first[:, 2] < when[i])).any():
                found[i] = -1
    return at, best, past


def _looked(part: _Part, core: np.ndarray, some, whole, most, user, group, before, code, start, size, best, past) -> None:
    """Raise ``best`` and ``past`` of the rows ``some`` by their references in one part.

    A row is compared with the signatures of all; the few references that they leave are scored. Where next to
    nothing is found yet, all are scored.
    """
    shapes = part.shapes
    who, place = _spread(start[some], start[some + 1])
    codes = code[place]
    known, shared = _has(part.codes, codes), _has(core, codes)
    p, q = (np.bincount(who[x], minlength=len(some)) for x in (shared, known & ~shared))
    reach = _most(shapes, p, q, size[some])  # pairs that the part doesn't know can't be shared
    keep = (whole[some] & (reach > best[some])) | ((reach > past[some]) & (before[some] > part.at[min(part.undated, len(part.at) - 1)]) & (part.undated < len(part.at)))
    some, reach, p = some[keep], reach[keep], p[keep]
    if not len(some):
        return
    use = keep[who] & (known | shared)
    who, codes, inside = (np.cumsum(keep) - 1)[who[use]], codes[use], shared[use]
    lacked, what = np.nonzero(_dense(who[inside], codes[inside], len(some), core) == 0)
    base = p  # what it has of the centre
    who, codes = np.concatenate([who[~inside], lacked]), np.concatenate([codes[~inside], core[what]])
    hit = _has(part.codes, codes)
    who, at = who[hit], np.searchsorted(part.codes, codes[hit])
    order = np.argsort(who, kind="stable")
    who, at = who[order], at[order]
    bounds = np.searchsorted(who, np.arange(len(some) + 1))
    froms, tos = part.start[at], part.start[at + 1]
    until = np.maximum(np.searchsorted(part.at, before[some]), part.undated)
    back = (until > part.undated) & (reach > past[some])
    wide = whole[some] & (reach > best[some])
    lack, total = len(core) - shapes[:, 0], shapes.sum(axis=1)
    least = lambda s: np.concatenate([(lack[None, :] + s[a : a + 256, None] / 2 * total[None, :]).min(axis=1) for a in range(0, len(s), 256)]) + s * size[some] / 2 - base - 1e-6
    need, need_past = np.where(wide, least(best[some]), np.inf), np.where(back, least(past[some]), np.inf)
    want = np.minimum(need, need_past)
    hope = np.diff(bounds) > want
    mine = (some, size[some], user[some], group[some], until, back)
    low = np.minimum(np.where(wide, best[some], np.inf), np.where(back, past[some], np.inf))
    quick, rows = np.flatnonzero(hope & (want >= FEWEST)), max(1, 16 * PAIRS // max(len(part.at), len(part.codes) // 16))
    for lo in range(0, len(quick), rows):
        _picked(quick[lo : lo + rows], part, bounds, at, base, low, *mine, best, past)
    lists = (part, bounds, froms, tos, base)
    for j in np.flatnonzero(hope & (want < FEWEST)).tolist():
        _scored(j, *lists, *mine, wide, best, past)


def _picked(some, part, bounds, codes, base, low, target, size, user, group, until, back, best, past) -> None:
    """Score the references that could be better by their signatures.

    Of a reference's pairs outside of the centre one at least is lost for every bit that the row hasn't, and of those
    inside it shares no more than the row has.
    """
    rows, n = len(part.at), len(some)
    which, place = _spread(bounds[some], bounds[some + 1])
    own = np.zeros((n, len(part.codes)), np.bool_)
    own[which, codes[place]] = True
    bit = part.bit[codes[place]]
    without = ~_signatures(which[bit >= 0], bit[bit >= 0], n)
    most = np.minimum(base[some, None], part.inside) + part.outside - low[some, None] / 2 * (size[some, None] + part.whole)
    most = np.clip(most + (1 + 1e-6), 0, 255).astype(np.uint8)  # so many lost ones are too many
    (left, right), (a, b), (one, two, few, word) = part.folded, _folded_not(without), part.room
    found = []
    for k in range(n):
        np.bitwise_count(np.bitwise_and(left, a[k], out=word), out=one)
        np.bitwise_count(np.bitwise_and(right, b[k], out=word), out=two)
        np.less(np.add(one, two, out=one), np.take(most[k], part.shape, out=two, mode="clip"), out=few)
        found.append(np.flatnonzero(few) + k * rows)
    found = np.concatenate(found)
    for first in range(0, len(found), PAIRS):
        pair = found[first : first + PAIRS]
        row, c = pair // rows, pair % rows
        lost = np.minimum(sum(np.bitwise_count(of[c] & has[row]).astype(np.int16) for of, has in zip(part.marks, without)), 254)
        t = some[row]
        ok = (lost < most[row, part.shape[c]]) & (part.group[c] != group[t]) & (part.user[c] != user[t])
        row, c, t = row[ok], c[ok], t[ok]
        who, place = _spread(part.of[c], part.of[c + 1])
        hit = np.append(0, np.cumsum(own[row[who], part.name[place]]))
        ends = np.cumsum(part.of[c + 1] - part.of[c])
        common = hit[ends] - hit[ends - part.of[c + 1] + part.of[c]] + base[t] - part.lacks[c].astype(np.int64)
        alike = 2.0 * common / (part.size[c].astype(np.float64) + size[t])
        earlier = back[t] & (c >= part.undated) & (c < until[t])
        np.maximum.at(best, target[t], alike)
        np.maximum.at(past, target[t[earlier]], alike[earlier])


def _scored(j, part, bounds, froms, tos, base, target, size, user, group, until, back, wide, best, past) -> None:
    """Score all references of one row, or all earlier ones where no other can be better."""
    i, undated = target[j], part.undated
    n = len(part.at) if wide[j] else until[j]
    kind = np.float32 if part.kind is np.float32 and size[j] < SINGLE // 2 else np.float64
    held = [part.post[a:b] for a, b in zip(froms[bounds[j] : bounds[j + 1]].tolist(), tos[bounds[j] : bounds[j + 1]].tolist())]
    common = np.bincount(np.concatenate(held), minlength=len(part.at))[:n].astype(kind) if held else np.zeros(n, kind)
    common += base[j]
    common -= part.lacks[:n]
    alike = common / (part.size[:n] + kind(size[j]))
    alike *= part.others(int(group[j]))[:n]
    alike[part.user[:n] == user[j]] = 0
    for found, lo, hi in ((best, 0, n if wide[j] else 0), (past, undated, until[j] if back[j] else 0)):
        if hi > lo:
            k = lo + int(alike[lo:hi].argmax())
            if alike[k] > 0:
                found[i] = max(found[i], 2.0 * float(common[k]) / (float(part.size[k]) + size[j]))


def _each(spark, n: int, tasks: int, run) -> None:
    """``run`` for every whole number below n, spread over tasks."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                run(i)
        yield from ()

    spark.range(0, n, 1, max(1, min(n, tasks))).mapInArrow(do, "n bigint").collect()  # no rows


def best_of_other_group(rows: DataFrame, folder: str) -> DataFrame:
    """As ``nearest.best_of_other_group``, of rows ``row_id, u, a`` (hashes of user and group), ``t`` (time) and ``k`` (key)."""
    spark = rows.sparkSession
    with passing(spark):
        placed = numbered(rows, [F.col("t"), F.col("row_id")], "_i").withColumn("i", F.col("_i") - 1)
        n = placed.count()
        folder = f"{folder}/alike-{uuid.uuid4().hex}"
        os.makedirs(folder)
        _kept(placed.select("i", "row_id", "u", "a", F.col("k").alias("key")), folder, n, dict.fromkeys(("row_id", "u", "a"), np.int64), {"key": np.uint8})
        first = placed.where("t IS NOT NULL").groupBy("t").agg((F.min("i") + 1).alias("time")).withColumnRenamed("t", "_t")
        _kept(placed.select("i", "t").join(first, F.col("t") == F.col("_t")).select("i", "time"), folder, n, {"time": np.int64}, {})
    with open(f"{folder}/centre", "wb") as f:
        f.truncate(4 * n)
    tasks = max(12, -(-n // PORTION))
    _each(spark, 1, 1, lambda _: _centres(folder))
    _each(spark, -(-n // PORTION), tasks, lambda p: _dealt(folder, p * PORTION, min(n, (p + 1) * PORTION)))
    _each(spark, 1, 1, lambda _: _parts(folder))
    parts = os.path.getsize(f"{folder}/part") // 24
    _each(spark, parts, parts, lambda p: _indexed(folder, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("id").to_pylist():
                at, best, past = _found(folder, p * PORTION, min(n, (p + 1) * PORTION))
                ids = np.asarray(_mapped(f"{folder}/row_id")[at])
                for mode, value in (("any", best), ("past", past)):
                    some = value >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([mode] * int(some.sum()), pa.string()), pa.array(value[some])], ["row_id", "mode", "similarity"])

    portions = -(-n // PORTION)
    found = spark.range(0, portions, 1, max(1, portions)).mapInArrow(run, "row_id bigint, mode string, similarity double")
    return found.select("row_id", "mode", F.round("similarity", 6).alias("similarity"))
