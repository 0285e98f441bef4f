"""Column builders for text: keys, similarities, defects and prompt parts."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WS = r"(?U)\s+"


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, outer blanks removed."""
    return F.trim(F.regexp_replace(c, _WS, " "))


def key_compact(c: Column) -> Column:
    """Lower case without any white space; null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), _WS, ""))


def key_clean(c: Column) -> Column:
    """:func:`key_compact` without replacement characters."""
    return F.replace(key_compact(c), F.lit("�"), F.lit(""))


_NOT_ALNUM = re.compile(r"[^\w\x00]|_")


@F.arrow_udf(T.StringType())
def key_alnum(texts: pa.Array) -> pa.Array:
    """Compatibility form, case-folded, alphanumeric characters only; null as empty.

    A column is one string for these steps, with a character between its texts that none of them keeps.
    """
    if not len(texts):
        return pa.array([], pa.string())
    joined = "\x00".join(t.replace("\x00", " ") for t in texts.fill_null("").to_pylist())
    return pa.array(_NOT_ALNUM.sub("", unicodedata.normalize("NFKC", joined).casefold()).split("\x00"), pa.string())


def bigrams(key: Column) -> Column:
    """Distinct character pairs; a single character stands for itself, an empty key has none."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - 1))
    return F.when(F.length(key) > 0, F.array_distinct(F.transform(starts, lambda i: F.substring(key, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """2|A and B| / (|A| + |B|) of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """|A and B| / |A or B| of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.arrow_udf(T.DoubleType())
def matching_ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    """Matching-blocks ratio of the texts as they stand; null as empty, two empties are equal. Not symmetric."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip((x or "" for x in left.to_pylist()), (x or "" for x in right.to_pylist())):
        if pair not in seen:
            seen[pair] = 1.0 if pair[0] == pair[1] else _ratio(*pair)
        out.append(seen[pair])
    return pa.array(out, pa.float64())


def compact_ratio(a: Column, b: Column) -> Column:
    """Matching ratio of compact keys; 0 if either is empty."""
    ka, kb = key_compact(a), key_compact(b)
    return F.when((ka == "") | (kb == ""), F.lit(0.0)).otherwise(matching_ratio(ka, kb))


def alnum_ratio(a: Column, b: Column) -> Column:
    """Matching ratio of alphanumeric keys; two empties are equal."""
    return matching_ratio(key_alnum(a), key_alnum(b))


def actions_ratio(a: Column, b: Column) -> Column:
    """Matching ratio of whole action lists joined by a wide comma, to four digits."""
    return F.bround(matching_ratio(F.array_join(a, "，"), F.array_join(b, "，")), 4)


def percent_ratio(a: Column, b: Column) -> Column:
    """Matching ratio as a whole percentage over 100."""
    return F.rint(100 * matching_ratio(a, b)) / 100


def structural_defects(c: Column, least: int = 2, share: float = 0.6, long_enough: int = 8) -> Column:
    """Names of what is wrong with a text's make-up: too short, replacement or control characters, one character dominating."""
    key = key_compact(c)
    n = F.length(key)
    chars = F.filter(F.split(key, ""), lambda x: x != "")
    top = F.array_max(F.transform(F.array_distinct(chars), lambda x: n - F.length(F.replace(key, x, F.lit("")))))
    return F.array_compact(F.array(
        F.when(n < least, "too_short"),
        F.when(F.contains(c, F.lit("�")), "replacement_character"),
        F.when(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "control_character"),
        F.when((n >= long_enough) & (top >= share * n), "dominant_character"),
    ))


def tail_ideographs(c: Column, n: int = 8) -> Column:
    """The last n ideographs of a text."""
    return F.right(F.array_join(F.regexp_extract_all(c, F.lit("[一-鿿]"), F.lit(0)), ""), F.lit(n))


def slot_mismatch(a: Column, b: Column, similarity: Column) -> Column:
    """Alike texts that end differently."""
    return (similarity >= 0.70) & (similarity < 1.0) & (tail_ideographs(a) != tail_ideographs(b))


def prompt_parts(c: Column) -> Column:
    """``struct<system, user>`` of a text tagged [system] and [user]; untagged text is the user's."""
    pattern = r"(?is)^\s*\[system\](.*?)\[user\](.*)$"
    tagged = c.rlike(pattern)
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    rest = F.when(tagged, F.regexp_extract(c, pattern, 2)).otherwise(F.regexp_replace(c, r"(?i)^\s*\[(?:system|user)\]\s*", ""))
    return F.struct(F.when(tagged, strip(F.regexp_extract(c, pattern, 1))).alias("system"), strip(rest).alias("user"))


def relative_path(path: Column, root: str) -> Column:
    """A path relative to a root, with forward slashes; paths elsewhere stay."""
    plain, base = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(plain)


def merge_sources(a: Column, b: Column) -> Column:
    """Union of two +-joined tag lists in order of first appearance."""
    tags = F.transform(F.split(F.concat_ws("+", a, b), r"\+"), lambda x: F.trim(x))
    return F.array_join(F.array_distinct(F.filter(tags, lambda x: x != "")), "+")


def first_of(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns])


def copied_from(key: Column, history: Column) -> Column:
    """Whether a key holds, or is held by, one of the history's keys (empty keys don't count)."""
    return (key != "") & F.exists(history, lambda h: (h != "") & (F.contains(h, key) | F.contains(key, h)))


def success_in(text: Column, everything: Column, anything: Column, nothing: Column) -> Column:
    """Final-state rule: all of one list, any of another, none of a third; an empty rule never holds."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    some = F.greatest(size(everything), size(anything), size(nothing)) > 0
    ok = F.coalesce(F.forall(everything, lambda x: F.contains(text, x)), F.lit(True)) & ((size(anything) <= 0) | F.coalesce(F.exists(anything, lambda x: F.contains(text, x)), F.lit(True)))
    return some & ok & ~F.coalesce(F.exists(nothing, lambda x: F.contains(text, x)), F.lit(False))
