"""Runs of repeated consecutive events, found by a backreference over a string of symbols.

Every event becomes one Unicode code point, so that neighbours carry the same symbol exactly
where the later event repeats the earlier one; the lists of a batch form one symbol string, a
single regular expression finds all maximal repetitions, and the spans are mapped back to list
positions and timestamps. Lists never leave their row: the operator needs no shuffle and its
memory follows the Arrow batch, not the longest list.

Defined cases: a null or empty list has no runs; a null event counts as one with all fields
null; null, empty and invisible texts are equal; a missing box, or a missing edge of a box, fits
any; a duration is null where either end of the run has no time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.charform import convert

TOLERANCE = 12.0
_BREAK = "\x00"
_REPEATED = re.compile(f"([^{_BREAK}])\\1+", re.DOTALL)
#: Symbols lie above the surrogates; codes beyond the range wrap, which _symbols makes safe.
_BASE, _RANGE = 0xE000, 500_000

RUNS = T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("run_length", T.IntegerType()), T.StructField("duration_ms", T.LongType())]))


def _codes(column: pa.Array) -> tuple[np.ndarray, int]:
    """A number per text, equal where the reduced texts are; null equals empty."""
    made = convert(column.fill_null(""), "reduce").dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(made.dictionary))


def _boxes(column: pa.Array) -> np.ndarray:
    """n x 4 edges; what is missing is NaN."""
    n, out = len(column), np.full((len(column), 4), np.nan)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), size)
    edge = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    some = edge < 4
    out[row[some], edge[some]] = values[some]
    return out


def _symbols(same: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Code points of which neighbours are equal exactly where ``same`` says so.

    A code has two symbols; the other one is taken from where neighbours would be equal
    although the later one doesn't repeat the earlier (a moved box, a code that wrapped).
    """
    base = code % _RANGE
    clash = np.concatenate([[False], ~same[1:] & (base[1:] == base[:-1])])
    return (_BASE + 2 * base + (np.cumsum(clash) & 1)).astype(np.uint32)


def find_runs(kinds: pa.Array, targets: pa.Array, texts: pa.Array, boxes: pa.Array, times: pa.Array, tolerance: float = TOLERANCE) -> pa.Array:
    """Per list, its maximal runs in order (single events are runs of length one)."""
    rows = len(kinds)
    size = pc.fill_null(pc.list_value_length(kinds), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    n = int(ends[-1]) if rows else 0
    if not n:
        return pa.array([None if v is None else [] for v in pc.list_value_length(kinds).to_pylist()], _RUNS_ARROW)
    code = np.zeros(n, np.int64)
    for column in (kinds, targets, texts):
        own, width = _codes(pc.list_flatten(column))
        code = np.unique(code * width + own, return_inverse=True)[1].astype(np.int64)
    box = _boxes(pc.list_flatten(boxes))
    opens = np.zeros(n, bool)
    opens[(ends - size)[size > 0]] = True
    with np.errstate(invalid="ignore"):
        moved = (np.abs(box[1:] - box[:-1]) > tolerance).any(axis=1)
    same = np.concatenate([[False], (code[1:] == code[:-1]) & ~moved]) & ~opens
    # One separator before each list keeps a run from crossing into the next one.
    symbols = np.zeros(n + rows, np.uint32)
    owner = np.repeat(np.arange(rows), size)
    symbols[np.arange(n) + owner + 1] = _symbols(same, code)
    text = symbols.astype("<u4").tobytes().decode("utf-32-le")
    spans = [m.span() for m in _REPEATED.finditer(text)]
    span = np.array(spans, np.int64).reshape(-1, 2)
    begin = span[:, 0] - owner_of(span[:, 0], ends, size) - 1
    length = span[:, 1] - span[:, 0]
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, begin + 1, 1)
    np.add.at(inside, begin + length, -1)
    start = np.flatnonzero(np.cumsum(inside[:n]) == 0)  # every event but the later ones of a run
    count = np.diff(np.concatenate([start, [n]]))
    # A run can't reach past its list, and the next start is at most the next list's first event.
    stamp = pc.list_flatten(times)
    known = np.asarray(stamp.is_valid())
    micros = stamp.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    last = start + count - 1
    valid = known[start] & known[last]
    duration = pa.array((micros[last] - micros[start]) // 1000, pa.int64(), mask=~valid)
    runs = np.bincount(owner[start], minlength=rows)
    values = pa.StructArray.from_arrays([pa.array((start - (ends - size)[owner[start]]).astype(np.int32)), pa.array(count.astype(np.int32)), duration], names=["start_pos", "run_length", "duration_ms"])
    offsets = np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)
    null = np.asarray(kinds.is_null())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.concatenate([null, [False]]) if null.any() else None), values)


def owner_of(position: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The list that holds a position of the symbol string (lists have one separator in front)."""
    first = (ends - size) + np.arange(len(size))
    return np.searchsorted(first, position, side="right") - 1


_RUNS_ARROW = pa.list_(pa.struct([("start_pos", pa.int32()), ("run_length", pa.int32()), ("duration_ms", pa.int64())]))


@F.arrow_udf(RUNS)
def _runs(kinds: pa.Array, targets: pa.Array, texts: pa.Array, boxes: pa.Array, times: pa.Array) -> pa.Array:
    return find_runs(kinds, targets, texts, boxes, times)


def runs(actions: str) -> Column:
    """``array<struct<start_pos, run_length, duration_ms>>`` of the events of a list column."""
    part = lambda path: F.col(f"{actions}.{path}")
    return _runs(part("action_type"), part("target"), part("text"), part("bbox"), part("raw.ts"))


def repeated_runs(df: DataFrame, actions: str, key: str = "row_id") -> DataFrame:
    """One row for each maximal run of two or more events: key, start_pos, run_length, duration_ms."""
    found = df.select(F.col(key), runs(actions).alias("_runs"))
    return found.select(key, F.inline(F.filter("_runs", lambda r: r.run_length > 1)))


def collapse(df: DataFrame, actions: str) -> DataFrame:
    """``df`` with each run of ``actions`` as its first event, its count and its duration."""
    name = "_runs"
    while name in df.columns:
        name += "_"
    found = df.withColumn(name, runs(actions))
    event = lambda r: F.struct(F.get(F.col(actions), r.start_pos).alias("action"), r.start_pos.alias("start_pos"), r.run_length.alias("count"), r.duration_ms.alias("duration_ms"))
    return found.withColumn(actions, F.transform(name, event)).drop(name)
