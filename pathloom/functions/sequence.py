"""Column builders over token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _symbols(tokens: Column, alphabet: Column) -> Column:
    """One character per token, by its place in the alphabet, above the surrogates."""
    return F.array_join(F.transform(tokens, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(alphabet, F.coalesce(t, F.lit("")))  + 0xE000), 8, "0")), "UTF-32")), "")


def _plain(tokens: Column) -> Column:
    return F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of two token lists; two empty lists are equal, one empty gives 0.

    Every distinct token of the two lists becomes one character, so that the built-in distance of
    strings is the distance of lists.
    """
    a, b = _plain(a), _plain(b)
    alphabet = F.array_distinct(F.concat(a, b))
    longer = F.greatest(F.size(a), F.size(b))
    distance = F.levenshtein(_symbols(a, alphabet), _symbols(b, alphabet))
    return F.when(longer == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(1.0 - distance / longer)


def text_levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of two texts by characters."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def best_similarity(tokens: Column, references: Column) -> Column:
    """Highest list similarity to any reference; 0 without references."""
    return F.coalesce(F.array_max(F.transform(references, lambda r: levenshtein_similarity(tokens, r))), F.lit(0.0))


def lcs_ratio(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence over the length of ``a``; 0 if either is empty."""

    def row(before: Column, token: Column) -> Column:
        cells = F.zip_with(b, F.zip_with(before, F.slice(before, 2, F.size(b)), lambda x, y: F.struct(x.alias("diag"), y.alias("up"))), lambda t, d: F.struct((t == token).alias("hit"), d["diag"].alias("diag"), d["up"].alias("up")))
        start = F.array(F.lit(0))
        return F.aggregate(F.slice(cells, 1, F.size(b)), start, lambda acc, c: F.concat(acc, F.array(F.when(c["hit"], c["diag"] + 1).otherwise(F.greatest(c["up"], F.element_at(acc, -1))))))

    last = F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.element_at(last, -1) / F.size(a))


def positional_matches(a: Column, b: Column) -> Column:
    """How many places hold the same token in both lists, up to the shorter one's end."""
    n = F.least(F.size(a), F.size(b))
    return F.size(F.filter(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y)), lambda x: x))
