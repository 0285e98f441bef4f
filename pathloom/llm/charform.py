"""One character form for texts that look the same, over whole Arrow columns.

The text of a batch is copied once into a numpy array of code points. Two lookup tables give,
for every code point, where its replacement begins in a pool and how long it is; gathers and
expansion offsets write all replacements at once, and marks are put in order and composed by
rank within their cluster. No Python string is touched per row.

Two forms exist:

``form``    compatibility forms (width, style, ligatures), split accents, look-alike letters and
            unusual blanks become the usual character; invisible characters go. Letter case,
            punctuation and ordinary blanks stay. A look-alike becomes Latin, unless its word has
            letters that only Cyrillic (or Greek) has and none that only Latin has: such a word
            is written wholly in that script, so Russian stays Russian. A word that could be
            either takes the script of the word before it, or else of the one after it.
``reduce``  the same, then lower case, and only letters, digits and their marks are kept.

Null stays null, an empty text stays empty, and a text of invisible characters becomes empty.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like Latin ones, as "other latin" pairs.
LOOK_ALIKES = (
    "А A  В B  Е E  К K  М M  Н H  О O  Р P  С C  Т T  У Y  Х X  І I  Ј J  Ѕ S  Ԛ Q  Ԝ W  "
    "а a  е e  о o  р p  с c  у y  х x  і i  ј j  ѕ s  ԛ q  ԝ w  һ h  ԁ d  "
    "Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  ο o  ϲ c  ϳ j  "
    "α a  ι i  κ k  ν v  ρ p  υ u  γ y  ѵ v  Ѵ V  ӏ l  Ӏ l  ү y  Ү Y  "
    "ı i  ɑ a  ɡ g  օ o  ո n  ս u  Օ O  ⅼ l  Ꭺ A  Ᏼ B  Ꮯ C  Ꭼ E  Ꮋ H  Ꭻ J  Ꮶ K  Ꮇ M  Ꮲ P  Ꭲ T  Ꮃ W  Ꮓ Z"
)
# Invisible characters outside Unicode's format category.
UNSEEN = "034F 115F 1160 17B4 17B5 180B 180C 180D 180F 3164 FFA0"
# Line and paragraph separators that stand for a line break.
BREAKS = "0085 2028 2029"

SIZE = 0x110000
#: Bytes of text converted at a time.
CHUNK_BYTES = 1 << 20
# Blocks that hold anything but characters which stand for themselves (ideographs, syllables, private use).
_SCANNED = (range(0x3400), range(0xA4D0, 0xAC00), range(0xD7B0, 0xD800), range(0xF900, 0x14000), range(0x16000, 0x17000), range(0x1BC00, 0x1F300), range(0x1FB00, 0x1FC00), range(0x2F800, 0x2FA20), range(0xE0000, 0xE1000))
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00


def _pairs(text: str) -> dict[str, str]:
    items = text.split()
    return dict(zip(items[::2], items[1::2]))


@lru_cache(maxsize=1)
def _look() -> dict[str, str]:
    return _pairs(LOOK_ALIKES)


def _unseen(cp: int, category: str) -> bool:
    return category == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0000 <= cp <= 0xE0FFF or cp in _unseen_extra()


@lru_cache(maxsize=1)
def _unseen_extra() -> frozenset[int]:
    return frozenset(int(x, 16) for x in UNSEEN.split())


def _formed(ch: str) -> str:
    """The usual, decomposed characters of one character."""
    cp = ord(ch)
    if cp < 0x7F:
        return ch
    category = unicodedata.category(ch)
    if _unseen(cp, category):
        return ""
    if category == "Zs":
        return " "
    if cp in _breaks():
        return "\n"
    if 0xAC00 <= cp <= 0xD7A3:
        return ch
    look = _look()
    out = []
    for c in unicodedata.normalize("NFKD", ch):
        if 0xAC00 <= ord(c) <= 0xD7A3 or not _unseen(ord(c), unicodedata.category(c)):
            out.append(look.get(c, " " if unicodedata.category(c) == "Zs" else c))
    return "".join(out)


@lru_cache(maxsize=1)
def _breaks() -> frozenset[int]:
    return frozenset(int(x, 16) for x in BREAKS.split())


def _folded(ch: str) -> str:
    """Lower case under look-alikes: a letter goes with its capital if that looks Latin."""
    upper = ch.upper()
    if len(upper) == 1 and upper in _look():
        return _look()[upper].lower()
    look = _look()
    return "".join(look.get(c, c) for c in unicodedata.normalize("NFD", ch.casefold()))


def _reduced(ch: str) -> str:
    return "".join(f for c in _formed(ch) for f in (_folded(c) if not 0xAC00 <= ord(c) <= 0xD7A3 else c) if unicodedata.category(f)[0] in "LNM")


class _Table:
    """Replacement of every code point: ``pool[start[cp] : start[cp] + length[cp]]``."""

    def __init__(self, rule):
        self.length = np.ones(SIZE, np.uint8)
        self.start = np.arange(SIZE, dtype=np.int32)
        pool, at = [], SIZE
        for cps in _SCANNED:
            for cp in cps:
                ch = chr(cp)
                new = rule(ch)
                if new != ch:
                    self.length[cp], self.start[cp] = len(new), at
                    pool.extend(map(ord, new))
                    at += len(new)
        if not rule("☺"):  # only letters and digits stay: pictographs and private use go too
            for gone in (range(0xE000, 0xF900), range(0x1F300, 0x1FB00), range(0xF0000, SIZE)):
                self.length[gone.start : gone.stop] = 0
        self.pool = np.concatenate([np.arange(SIZE, dtype=np.uint32), np.array(pool, np.uint32)])


@lru_cache(maxsize=2)
def _table(form: str) -> _Table:
    return _Table({"form": _formed, "reduce": _reduced}[form])


#: Scripts that a word may be written in as a whole, by their blocks of letters.
_SCRIPTS = ((range(0x400, 0x530), range(0xA640, 0xA6A0)), (range(0x370, 0x400), range(0x1F00, 0x2000)))
_LATIN_ONLY, _OWN, _EITHER = 1, 2, 4


@lru_cache(maxsize=1)
def _scripts() -> list[tuple[np.ndarray, np.ndarray]]:
    """Per script: the kind of every code point (0 outside words), and the letter that looks like a Latin one."""
    out = []
    for blocks in _SCRIPTS:
        kind, partner = np.zeros(SIZE, np.uint8), np.arange(SIZE, dtype=np.uint32)
        inside = {chr(cp) for cps in blocks for cp in cps}
        for other, latin in _look().items():
            if other in inside and partner[ord(latin)] == ord(latin):
                partner[ord(latin)] = ord(other)
        for cps in (range(0x41, 0x250), range(0x1E00, 0x1F00), *(b for other in _SCRIPTS for b in other)):
            for cp in cps:
                if unicodedata.category(chr(cp))[0] == "L":
                    kind[cp] = _OWN if chr(cp) in inside else _EITHER if partner[cp] != cp else _LATIN_ONLY
        kind[0x300:0x370] = 8  # a mark belongs to the word of its letter
        out.append((kind, partner))
    return out


def _filled(verdict: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words without a verdict take that of the nearest word before them in their text."""
    at = np.maximum.accumulate(np.where(verdict != 0, np.arange(len(verdict)), -1))
    known = (at >= 0) & (text[at] == text)
    return np.where(known, verdict[at], 0)


def _in_script(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whole words of another script back from the Latin letters that theirs look like.

    The letters go back one to one, so texts that agreed before agree after, and no others.
    """
    for (kinds, partner), blocks in zip(_scripts(), _SCRIPTS):
        near = np.zeros(len(codes), bool)
        for b in blocks:
            near |= (codes >= b.start) & (codes < b.stop)
        texts = np.unique(np.searchsorted(offsets, np.flatnonzero(near), side="right")) - 1
        if not len(texts):
            continue
        # Only the texts that hold such letters are looked at.
        size = offsets[texts + 1] - offsets[texts]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(offsets[texts] - ends[:-1], size)
        codes = codes.copy()
        codes[at] = _restored(codes[at], ends, kinds, partner)
    return codes


def _restored(codes: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """The texts' code points with the words of one script whole in it."""
    kind = kinds[codes]
    if (kind == _OWN).any():
        opens = kind > 0
        opens[1:] &= kind[:-1] == 0
        first = offsets[:-1][offsets[:-1] < len(codes)]
        opens[first] = kind[first] > 0
        word = np.cumsum(opens) - 1
        inside = np.flatnonzero(kind > 0)
        n = int(word[-1]) + 1
        has = [np.bincount(word[inside], kind[inside] == k, n) > 0 for k in (_OWN, _LATIN_ONLY, _EITHER)]
        text = np.searchsorted(offsets, np.flatnonzero(opens), side="right")
        verdict = np.where(has[0] & ~has[1], 1, np.where(has[0] | has[1], -1, 0))
        verdict = np.where(verdict == 0, _filled(verdict, text), verdict)
        verdict = np.where(verdict == 0, _filled(verdict[::-1], text[::-1])[::-1], verdict)
        back = inside[(verdict[word[inside]] == 1) & (kind[inside] == _EITHER)]
        codes[back] = partner[codes[back]]
    return codes


@lru_cache(maxsize=1)
def _marks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combining class of every code point; sorted (starter, mark) keys and their composites."""
    ccc, keys, made = np.zeros(SIZE, np.uint8), [], []
    for cps in _SCANNED:
        for cp in cps:
            ch = chr(cp)
            if c := unicodedata.combining(ch):
                ccc[cp] = c
            d = unicodedata.decomposition(ch)
            if d and d[0] != "<" and len(parts := d.split()) == 2:
                a, b = (int(x, 16) for x in parts)
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                    keys.append(a << 21 | b)
                    made.append(cp)
    order = np.argsort(np.array(keys, np.int64))
    return ccc, np.array(keys, np.int64)[order], np.array(made, np.uint32)[order]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the n+1 offsets of the texts in them."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = memoryview(data)[at[0] : at[-1]] if data is not None else b""
    codes = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return codes, lead[at - at[0]]


def to_arrow(codes: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Texts from code points and their offsets."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))])
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    out = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [mask, pa.py_buffer(width[offsets].astype(np.int64)), pa.py_buffer(data)])
    return out


def _expand(codes: np.ndarray, offsets: np.ndarray, table: _Table) -> tuple[np.ndarray, np.ndarray]:
    length = table.length[codes].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(length)])
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], length)
    return table.pool[np.repeat(table.start[codes].astype(np.int64), length) + within], ends[offsets]


def _keep(codes: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def _hangul(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for syllable in (False, True):
        if len(codes) < 2 or not ((codes >= _L) & (codes < 0x1200)).any():
            break
        a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
        if syllable:
            hit = (a >= _S) & (a <= 0xD7A3) & ((a - _S) % 28 == 0) & (b > _T) & (b < _T + 28)
            new = a + b - _T
        else:
            hit = (a >= _L) & (a < _L + 19) & (b >= _V) & (b < _V + 21)
            new = _S + ((a - _L) * 21 + b - _V) * 28
        first = np.zeros(len(codes), bool)
        first[offsets[:-1][offsets[:-1] < len(codes)]] = True
        hit &= ~first[1:]
        if hit.any():
            codes = codes.copy()
            codes[:-1][hit] = new[hit]
            codes, offsets = _keep(codes, offsets, np.concatenate([[True], ~hit]))
    return codes, offsets


def _compose(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of marks, cluster by cluster in parallel."""
    table, keys, made = _marks()
    codes, offsets = _hangul(codes, offsets)
    ccc = table[codes]
    marks = np.flatnonzero(ccc)
    if not len(marks):
        return codes, offsets
    opens = np.repeat(offsets[:-1], np.diff(offsets))[marks]
    of = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(codes)), -1))[marks]
    bare = of < opens  # marks that open a text have no starter: they are put in order only
    cluster = np.where(bare, 2 * opens - 1, 2 * of)
    codes = codes.copy()
    order = np.lexsort((ccc[marks], cluster))
    codes[marks] = codes[marks[order]]
    ccc[marks] = ccc[marks[order]]
    of = cluster
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(start, np.diff(np.concatenate([start, [len(of)]])))
    kept = np.ones(len(codes), bool)
    last = np.zeros(len(codes), np.uint8)  # class of the mark left standing before the next one
    for k in range(int(rank.max()) + 1 if len(rank) else 0):
        here = (rank == k) & ~bare
        m, s = marks[here], of[here] // 2
        able = (last[s] == 0) | (last[s] < ccc[m])
        key = codes[s].astype(np.int64) << 21 | codes[m]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        able &= keys[at] == key
        codes[s[able]] = made[at[able]]
        kept[m[able]] = False
        last[s[~able]] = ccc[m[~able]]
    return _keep(codes, offsets, kept)


def convert_codes(codes: np.ndarray, offsets: np.ndarray, form: str) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets = _expand(codes, offsets, _table(form))
    return _compose(_in_script(codes, offsets) if form == "form" else codes, offsets)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> list[pa.Array]:
    """Slices of about ``size`` bytes, so that temporary arrays stay small however long the texts are."""
    rows = max(1, len(texts) * size // max(1, texts.nbytes))
    return [texts.slice(at, rows) for at in range(0, len(texts), rows)] or [texts]


def convert(texts: pa.Array, form: str) -> pa.Array:
    """``texts`` in one consistent form; nulls stay null."""
    parts = chunks(texts)
    return _convert(texts, form) if len(parts) == 1 else pa.concat_arrays([_convert(part, form) for part in parts])


def _convert(texts: pa.Array, form: str) -> pa.Array:
    codes, offsets = code_points(texts)
    plain = len(codes) and codes.max() < 0x80
    if plain and form == "form":
        return texts.cast(pa.large_string())  # ASCII holds no two characters that look the same
    codes, offsets = _expand(codes, offsets, _table(form)) if plain else convert_codes(codes, offsets, form)
    return to_arrow(codes, offsets, np.asarray(texts.is_valid()))


def mix(x: np.ndarray) -> np.ndarray:
    """64 bits spread by multiplication and shifts."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def digests(texts: pa.Array, none: np.ndarray | None = None) -> pa.Array:
    """128-bit digest per text: two sums over its characters of a random number for character and place.

    Null where the text is null or ``none`` says so.
    """
    null = np.asarray(texts.is_null()) if none is None else none | np.asarray(texts.is_null())
    made = []
    for part in chunks(texts):
        codes, offsets = code_points(part)
        place = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
        at = codes.astype(np.uint64) << np.uint64(40) | place.astype(np.uint64)
        own = np.empty((len(part), 2), np.uint64)
        for k, salt in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(at + np.uint64(salt)), dtype=np.uint64)])
                own[:, k] = mix(total[offsets[1:]] - total[offsets[:-1]] + np.uint64(salt))
        made.append(own)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(16), len(texts), [valid, pa.py_buffer(np.concatenate(made).tobytes())]).cast(pa.binary())


@lru_cache(maxsize=2)
def _weights(letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per code point: sum of the random weights, and number, of the letters and digits it reduces to.

    With ``letters_only``, digits and the letter e, which numbers may be written with, weigh nothing.
    """
    table = _table("reduce")
    with np.errstate(over="ignore"):
        x = mix(np.arange(SIZE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        base = _marks()[0] == 0
        if letters_only:
            idle = np.array([cp for cps in _SCANNED for cp in cps if unicodedata.category(chr(cp))[0] == "N"] + [ord("e")])
            x[idle], base[idle] = 0, False
        weight = np.zeros(SIZE, np.uint64)
        count = np.zeros(SIZE, np.uint8)
        for k in range(int(table.length.max())):
            some = table.length > k
            new = table.pool[table.start[some].astype(np.int64) + k]
            weight[some] += x[new]
            count[some] += base[new]
    # Hangul: a syllable weighs as its jamo do.
    syllables = np.arange(_S, 0xD7A4)
    i = syllables - _S
    with np.errstate(over="ignore"):
        weight[syllables] = x[_L + i // 588] + x[_V + i % 588 // 28] + np.where(i % 28 > 0, x[_T + i % 28], 0).astype(np.uint64)
    count[syllables] = 1
    count[_V : _V + 21] = 0
    count[_T + 1 : _T + 28] = 0
    return weight, count


def invariants(texts: pa.Array, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Cheap invariants of the reduced text, without making it: its length and its letter histogram.

    The histogram is the sum of one random 64-bit weight per letter, so it doesn't depend on
    order and equals for texts with equal reduced forms; unequal texts may share it.
    """
    parts = [_invariants(part, letters_only) for part in chunks(texts)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _invariants(texts: pa.Array, letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets = code_points(texts)
    weight, count = _weights(letters_only)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight[codes], dtype=np.uint64)])
        hist = (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)
    size = np.concatenate([[0], np.cumsum(count[codes], dtype=np.int64)])
    return size[offsets[1:]] - size[offsets[:-1]], hist


def convert_text(text: str, form: str = "reduce") -> str:
    """One text in a form."""
    return convert(pa.array([text]), form)[0].as_py()


@F.arrow_udf(T.StringType())
def same_form(texts: pa.Array) -> pa.Array:
    """Column of texts in consistent character form."""
    return convert(texts, "form").cast(pa.string())


@F.arrow_udf(T.StringType())
def reduced(texts: pa.Array) -> pa.Array:
    """Column of texts reduced to lower-case letters and digits in consistent character form."""
    return convert(texts, "reduce").cast(pa.string())
