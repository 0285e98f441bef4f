"""Pieces of SQL that several queries' SQL is put together from."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

GRAMS = "CASE WHEN length(k) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, length(k))), lambda i: substr(k, i, 2))) END"


@lru_cache(maxsize=1)
def _forms() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose compatibility form is one other letter or digit, those forms, and the longer forms."""
    one, many = [], []
    for cp in (*range(0xA0, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)):
        ch = chr(cp)
        new = unicodedata.normalize("NFKC", ch).casefold()
        if new == ch.lower() or 0x300 <= cp < 0x370 or not ch.isalnum() and not any(c.isalnum() for c in new):
            continue
        if len(new) == 1:
            one.append((ch, new))
        elif 0xFB00 <= cp < 0xFB07 or cp in (0xDF, 0xBC, 0xBD, 0xBE):
            many.append((ch, new))
    return "".join(a for a, _ in one), "".join(b for _, b in one), many


def key(x: str) -> str:
    """The alphanumeric key of a text expression: compatibility form, lower case, letters and digits."""
    source, target, many = _forms()
    inner = f"nfc_normalize(translate({x}, '{source}', '{target}'))"
    for a, b in many:
        inner = f"replace({inner}, '{a}', '{b}')"
    return f"regexp_replace(lower({inner}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def dice(a: str, b: str) -> str:
    """Dice coefficient of two lists of character pairs, to six digits."""
    return f"round(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2e0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0 END, 6)"
