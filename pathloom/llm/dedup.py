"""Duplicates hidden by formatting: classes refined step by step, each by a costlier key.

1. cheap invariants of the text: number of letters and digits, and their histogram, summed from
   a lookup table without making the reduced text (for records without reading the JSON, so
   digits, which may be written in several ways, are left out);
2. inside classes with several members only, the reduced text itself (or, for records, the
   record with sorted fields and reduced strings) as a 128-bit digest. The ids of their members
   are broadcast where their size allows, so that the scan itself picks the texts.

Each step is an aggregation with map-side combine and a join back on its key, so a class that
holds a third of all rows is never one task's work: classes are counted, not collected, and the
join's large side splits. The result has one row per member with the smallest id of its class.

Defined cases: null texts and texts without a letter or digit are in no class; exact repeats are
members like others; payloads that aren't JSON objects or arrays (NaN is no JSON) are in no class;
numbers are compared by their exact value, however long.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.charform import convert, digests, invariants
from pathloom.storage import cut, discard, stored_bytes

#: Ids of members of classes with several are broadcast up to this many bytes on disk.
BROADCAST_BYTES = 8 << 20

_CHEAP = T.StructType([T.StructField("size", T.LongType()), T.StructField("hist", T.LongType())])


def _cheap(texts: pa.Array, letters_only: bool = False) -> pa.Array:
    size, hist = invariants(texts, letters_only)
    none = np.asarray(texts.is_null()) | ((size == 0) & (not letters_only))
    return pa.StructArray.from_arrays([pa.array(size, mask=none), pa.array(hist, mask=none)], names=["size", "hist"])


@F.arrow_udf(_CHEAP)
def text_invariants(texts: pa.Array) -> pa.Array:
    return _cheap(texts)


@F.arrow_udf(T.BinaryType())
def text_key(texts: pa.Array) -> pa.Array:
    return digests(convert(texts, "reduce"))


class _Number(str):
    """A number of JSON by its exact value: sign, digits without closing zeros, power of ten."""

    @classmethod
    def read(cls, text: str) -> _Number:
        mantissa, _, power = text.lower().partition("e")
        whole, _, part = mantissa.lstrip("-").partition(".")
        digits = (whole + part).lstrip("0")
        short = digits.rstrip("0")
        if not short:
            return cls("0")
        return cls(f"{'-' * mantissa.startswith('-')}{short}e{(int(power) if power else 0) - len(part) + len(digits) - len(short)}")


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_int=_Number.read, parse_float=_Number.read, parse_constant=_no_number)


def _parsed(payload: str | None):
    """The record of a payload, or None where it is broken or no record."""
    if payload is None:
        return None
    try:
        found = _DECODER.decode(payload)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, (dict, list)) else None


@F.arrow_udf(_CHEAP)
def record_invariants(payloads: pa.Array) -> pa.Array:
    """Invariants over the letters of a payload; only one with escapes is read as JSON for them.

    Broken payloads have invariants too; the record itself is what they fail at.
    """
    texts = payloads.cast(pa.large_string())
    escaped = pc.fill_null(pc.match_substring(texts, "\\"), False)
    if pc.any(escaped).as_py():
        read = iter([None if (r := _parsed(p)) is None else " ".join(_leaves(r)).encode("utf-8", "replace").decode() for p in texts.filter(escaped).to_pylist()])
        texts = pc.replace_with_mask(texts, escaped, pa.array(list(read), pa.large_string()))
    return _cheap(texts, letters_only=True)


def _leaves(value) -> Iterator[str]:
    """All words of a record as its payload would hold them without escapes."""
    if isinstance(value, dict):
        for name, v in value.items():
            yield name
            yield from _leaves(v)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v)
    else:
        yield value if isinstance(value, str) else json.dumps(value)


_quoted = lru_cache(maxsize=1 << 12)(json.dumps)
_WORDS = {True: "true", False: "false", None: "null"}


def _flat(value, out: list[str], strings: list[str]) -> None:
    """Write a record as tokens in field order; string values go to ``strings`` and leave a gap."""
    kind = type(value)
    if kind is str:
        out.append("\x00")
        strings.append(value if value.isascii() else value.encode("utf-8", "replace").decode())
    elif kind is _Number:
        out.append(value)
    elif kind is dict:
        out.append("{")
        for name in sorted(value):
            out.append(_quoted(name))
            _flat(value[name], out, strings)
        out.append("}")
    elif kind is list:
        out.append("[")
        for v in value:
            _flat(v, out, strings)
        out.append("]")
    else:
        out.append(_WORDS[value])


@F.arrow_udf(T.BinaryType())
def record_key(payloads: pa.Array) -> pa.Array:
    """Digest of the record: sorted fields at every depth, array order kept, string values reduced."""
    tokens, strings = [], []
    for payload in payloads.to_pylist():
        record, out = _parsed(payload), []
        if record is not None:
            _flat(record, out, strings)
        tokens.append(out)
    plain = iter(convert(pa.array(strings, pa.large_string()), "reduce").to_pylist())
    made = ["\x1f".join("\x00" + next(plain) if t == "\x00" else t for t in out) if out else None for out in tokens]
    return digests(pa.array(made, pa.large_string()))


def copies(df: DataFrame, text: str, key: str, cheap: Callable[[str], Column] = text_invariants, exact: Callable[[str], Column] = text_key) -> DataFrame:
    """``keep_id``, ``copy_id`` and ``n_copies``: every further member of a class under its smallest id."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    seen = cut(rows.select("_id", cheap("_text").alias("_c")).select("_id", "_c.*").where("size IS NOT NULL"), "cheap")
    several = seen.groupBy("size", "hist").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "hist")
    members = cut(seen.join(several, ["size", "hist"], "left_semi").select("_id"), "members")
    few = stored_bytes(members) <= BROADCAST_BYTES
    keyed = rows.join(F.broadcast(members) if few else members, "_id", "left_semi").select("_id", exact("_text").alias("_key"))
    keyed = cut(keyed.where(F.col("_key").isNotNull()), "keyed")
    discard(seen, members)
    classes = keyed.groupBy("_key").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return keyed.join(classes, "_key").where("_id <> keep_id").select("keep_id", F.col("_id").alias("copy_id"), "n_copies")


def record_copies(df: DataFrame, payload: str, key: str) -> DataFrame:
    """:func:`copies` for JSON records."""
    return copies(df, payload, key, record_invariants, record_key)


def deduplicated(df: DataFrame, text: str, key: str, **how) -> DataFrame:
    """``df`` with one row per class and ``n_copies`` (replacing a column of that name), the number of rows it stands for."""
    found = cut(copies(df, text, key, **how), "copies")
    counted = found.select(F.col("keep_id").alias(key), "n_copies").distinct()
    kept = df.drop("n_copies").join(found.select(F.col("copy_id").alias(key)), key, "left_anti")
    return kept.join(counted, key, "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(1)))
