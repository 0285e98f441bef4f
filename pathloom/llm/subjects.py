"""Subject areas of documents, sentence by sentence, by one-versus-rest linear classifiers.

Sentences are bags of hashed word n-grams (words and word pairs; pairs and triples of ideographs).
One logistic classifier per subject is first fitted to the labelled examples. The corpus has no
address paths, so its weak labels come from the documents as sections: where most sentences that
a fitted model places agree, all sentences of the document take that subject, which teaches the
model words the examples don't have and that sentences found under every subject treat none.
Thresholds are calibrated per subject on labelled examples left out of the fit. Fitting sees a
bounded sample (``SAMPLE`` documents by the hash of their id, ``SAMPLE_BYTES`` of text);
classification sees every document whole.

A document has a subject if at least a quarter of its sentences that treat any subject treat it.
Null, blank and subject-free texts have no row; ties don't arise, as every share is judged alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.charform import convert, mix

#: Documents that the weak labels are taken from, and how many bytes they may have.
SAMPLE, SAMPLE_BYTES = 4000, 16 << 20
#: Sentences of the sample that a fit sees at most, and buckets of the hashed n-grams.
FIT_SENTENCES, _BITS = 24_000, 18
BUCKETS = 1 << _BITS
#: N-grams that fewer sentences of a fit hold (mostly names) get no weight.
LEAST_SEEN = 3
#: Share of a document's placed sentences that makes its subject a weak label, and how many it needs.
AGREEMENT, LEAST_PLACED = 0.8, 2
SHARE = 0.25
#: Documents scored at a time, which bounds a worker's memory whatever the Arrow batch holds.
CHUNK = 400
ROUNDS, STEPS, RATE, DECAY, FOLDS = 3, 40, 0.2, 1e-5, 2

_DOCUMENT, _SENTENCE = "\x00", "\x01"
_SPLIT = re.compile(r"(?<=[.!?])[\"”')]*\s+|(?<=[。！？])|\n+|(?<=[;；])\s*\n")
_LABEL = re.compile(r"(?:^|(?<=[\x00\x01]))\s*(?:\[[\w ]{1,20}\]|[-*#>•]+|\d+[.)])\s*")
_WORD = re.compile(r"[㐀-䶿一-鿿]+|[^\W\d_㐀-䶿一-鿿]+")
_HAN = re.compile(r"[㐀-䶿一-鿿]")
_TAG = re.compile(r"<[^<>\x00]{1,200}>")


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)


def _plain(text: str | None) -> str:
    """A text with its wrapping gone and without the two characters that :func:`bags` sets."""
    if not text:
        return ""
    if text.lstrip()[:1] in "{[" and text.rstrip()[-1:] in "}]":
        try:
            text = "\n".join(_strings(json.loads(text)))
        except (ValueError, RecursionError):
            pass
    return text.replace(_DOCUMENT, " ").replace(_SENTENCE, " ")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of every code point: 2 for ideographs, 1 for what else words are made of, 0 for the rest."""
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    kinds = np.zeros(0x110000, np.uint8)
    for m in _WORD.finditer(every):
        kinds[m.start() : m.end()] = 2 if m[0] >= "㐀" and _HAN.match(m[0]) else 1
    return kinds


def bags(texts: list[str | None]) -> Bags:
    """The n-gram buckets of all sentences (that have any) of all texts, by whole-buffer steps.

    The texts are one string in which patterns set the sentence marks; its code points are an
    array, words are runs in it, and a word's hash is a difference of cumulative sums.
    """
    joined = _DOCUMENT.join(map(_plain, texts))
    joined = _LABEL.sub("", _SPLIT.sub(_SENTENCE, _TAG.sub(" ", joined))).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[np.minimum(codes, 0x10FFFF)]
    new_text = codes == ord(_DOCUMENT)
    sentence = np.cumsum(new_text | (codes == ord(_SENTENCE)))
    count = int(sentence[-1]) + 1 if len(codes) else 1
    owner = np.zeros(count, np.int64)
    owner[sentence[new_text]] = 1
    owner = np.cumsum(owner)
    here = np.flatnonzero(kind == 1)
    first = np.ones(len(here), bool)
    first[1:] = here[1:] != here[:-1] + 1
    head = np.flatnonzero(first)
    place = np.arange(len(here)) - np.repeat(head, np.diff(np.append(head, len(here))))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes[here].astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)), dtype=np.uint64)])
        word = mix(total[np.append(head[1:], len(here))] - total[head]) if len(head) else np.empty(0, np.uint64)
        at = here[head]
        ideographs = np.cumsum(kind == 2)[at] if len(at) else at
        joint = (sentence[at[1:]] == sentence[at[:-1]]) & (ideographs[1:] == ideographs[:-1])
        couples = mix(word[:-1] * np.uint64(3) + word[1:])[joint]
        han = kind == 2
        c = codes.astype(np.uint64) << np.uint64(21)
        two = np.flatnonzero(han[:-1] & han[1:])
        three = np.flatnonzero(han[:-2] & han[1:-1] & han[2:]) if len(codes) > 2 else np.empty(0, np.int64)
        pairs = mix((c[two] | codes[two + 1]) + np.uint64(1))
        triples = mix(mix((c[three] | codes[three + 1]) + np.uint64(2)) + codes[three + 2])
    grams = np.concatenate([word, couples, pairs, triples]) >> np.uint64(64 - _BITS)
    where = np.concatenate([sentence[at], sentence[at[1:]][joint], sentence[two], sentence[three]])
    keys = np.sort(where << _BITS | grams.astype(np.int64))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    size = np.bincount(keys >> _BITS, minlength=count)
    return Bags(keys & (BUCKETS - 1), np.concatenate([[0], np.cumsum(size[size > 0])]), owner[size > 0])


@dataclass
class Bags:
    """Distinct n-gram buckets of sentences end to end, their offsets, and the text each sentence is from."""

    flat: np.ndarray
    offsets: np.ndarray
    owner: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, rows: np.ndarray) -> Bags:
        """The sentences that ``rows`` marks."""
        size = np.diff(self.offsets)
        return Bags(self.flat[np.repeat(rows, size)], np.concatenate([[0], np.cumsum(size[rows])]), self.owner[rows])

    def __add__(self, other: Bags) -> Bags:
        return Bags(np.concatenate([self.flat, other.flat]), np.concatenate([self.offsets, self.offsets[-1] + other.offsets[1:]]), np.concatenate([self.owner, other.owner]))


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray
    bias: np.ndarray
    threshold: np.ndarray

    def scores(self, found: Bags) -> np.ndarray:
        """Probability per sentence and subject."""
        total = np.tile(self.bias.astype(np.float64), (len(found), 1))
        if len(found):
            total += np.add.reduceat(self.weights[found.flat], found.offsets[:-1], axis=0)
        return 1 / (1 + np.exp(-total))


def fit(found: Bags, labels: np.ndarray, subjects: list[str]) -> Model:
    """One logistic classifier per subject, all at once, by full-batch steps with momentum."""
    flat = found.flat
    n, k = len(found), len(subjects)
    row = np.repeat(np.arange(n), np.diff(found.offsets))
    often = np.bincount(flat, minlength=BUCKETS) >= min(LEAST_SEEN, max(1, n // 1000))
    row, flat = row[often[flat]], flat[often[flat]]
    used, column = np.unique(flat, return_inverse=True)
    v = len(used)
    w, b = np.zeros((v, k), np.float32), np.full(k, -2.0, np.float32)
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    order = np.argsort(column, kind="stable")
    by_column, starts = row[order], np.searchsorted(column[order], np.arange(v))
    some, heads = np.unique(row, return_index=True)
    labels = labels.astype(np.float32)
    for step in range(1, STEPS + 1):
        score = np.tile(b, (n, 1))
        if v:
            score[some] += np.add.reduceat(w[column], heads, axis=0)
        g = (1 / (1 + np.exp(-score)) - labels) / n
        gw = np.add.reduceat(g[by_column], starts, axis=0) + DECAY * w if v else w
        for grad, mean, square, at in ((gw, m, s, w), (g.sum(axis=0), mb, sb, b)):
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            at -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[used] = w
    return Model(subjects, weights, b, np.full(k, 0.5))


def thresholds(p: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Per subject, the threshold between what its examples score and what the others' do."""
    out = np.full(p.shape[1], 0.5)
    for j in range(p.shape[1]):
        own, rest = p[labels[:, j] > 0, j], p[labels[:, j] == 0, j]
        if len(own) and len(rest):
            out[j] = np.clip((np.quantile(own, 0.05) + np.quantile(rest, 0.99)) / 2, 0.25, 0.6)
    return out


def _forms(texts: list[str]) -> list[str]:
    return convert(pa.array(texts, pa.large_string()), "form").to_pylist()


def _sections(model: Model, documents: Bags, room: int) -> tuple[Bags, np.ndarray]:
    """Sentences of the documents whose placed sentences agree, with the subject they agree on."""
    p = model.scores(documents)
    best = p.argmax(axis=1)
    placed = p.max(axis=1) >= model.threshold[best]
    n, k = int(documents.owner[-1]) + 1 if len(documents) else 0, len(model.subjects)
    votes = np.bincount(documents.owner[placed] * k + best[placed], minlength=n * k).reshape(n, k)
    agree = (votes.sum(axis=1) >= LEAST_PLACED) & (votes.max(axis=1) >= AGREEMENT * votes.sum(axis=1)) if n else np.zeros(0, bool)
    size = np.bincount(documents.owner, minlength=n) * agree
    agree &= np.cumsum(size) - size <= room
    rows = agree[documents.owner]
    return documents.take(rows), votes.argmax(axis=1)[documents.owner[rows]] if n else np.zeros(0, np.int64)


def train(examples: list[tuple[str, str]], sample: list[str]) -> Model:
    """A model from labelled (text, subject) examples and unlabelled texts.

    The last thresholds are calibrated on examples that the scoring model hasn't seen: of each of
    ``FOLDS`` models, fitted like the last one but without a fold of the examples.
    """
    subjects = sorted({s for _, s in examples})
    number = {s: j for j, s in enumerate(subjects)}
    seed = bags(_forms([t for t, _ in examples]))
    marks = np.array([number[s] for _, s in examples], np.int64)[seed.owner]
    eye = np.eye(len(subjects))
    model = fit(seed, eye[marks], subjects)
    model.threshold = thresholds(model.scores(seed), eye[marks])
    documents = bags(_forms(sample))
    weak, labels = documents.take(np.zeros(len(documents), bool)), marks[:0]
    for _ in range(ROUNDS):
        weak, labels = _sections(model, documents, FIT_SENTENCES - len(seed))
        model = fit(seed + weak, eye[np.concatenate([marks, labels])], subjects)
        model.threshold = thresholds(model.scores(seed), eye[marks])
    unseen = np.zeros((len(seed), len(subjects)))
    for k in range(FOLDS):
        out = seed.owner % FOLDS == k
        if out.any() and not out.all():
            unseen[out] = fit(seed.take(~out) + weak, eye[np.concatenate([marks[~out], labels])], subjects).scores(seed.take(out))
    model.threshold = thresholds(unseen, eye[marks])
    return model


def _classify(model: Model):
    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0), batch.column(1)
        found = bags(convert(texts, "form").to_pylist())
        hit = model.scores(found) >= model.threshold
        k = len(model.subjects)
        rows, kinds = np.nonzero(hit)
        n = np.bincount(found.owner[rows] * k + kinds, minlength=len(texts) * k).reshape(len(texts), k)
        placed = np.bincount(found.owner[hit.any(axis=1)], minlength=len(texts))
        rows, kinds = np.nonzero(n)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows, pa.int64())), pa.array([model.subjects[j] for j in kinds], pa.string()), pa.array(n[rows, kinds]), pa.array(placed[rows])],
            ["id", "subject", "n_sentences", "n_placed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                yield some(batch.slice(start, CHUNK))

    return run


def fitted(documents: DataFrame, examples: DataFrame, key: str, text: str, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model fitted to all ``examples`` (text, subject) and a sample of ``documents``.

    The sample is the first ``sample`` documents by the hash of their id, as many of them as
    ``sample_bytes`` hold; each of them whole.
    """
    labelled = [(r.text, r.subject) for r in examples.where("text IS NOT NULL AND subject IS NOT NULL").select("text", "subject").orderBy("subject", "text").collect()]
    drawn = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(key).alias("_hash"), F.octet_length(text).alias("_bytes"))
    drawn = drawn.orderBy("_hash", "_key").limit(sample).collect()
    upto = np.cumsum([r["_bytes"] for r in drawn])
    chosen = [(r["_key"],) for r, n in zip(drawn, upto) if n <= sample_bytes]
    if not chosen:
        return train(labelled, [])
    ids = documents.sparkSession.createDataFrame(chosen, T.StructType([T.StructField(key, documents.schema[key].dataType)])).distinct()
    texts = documents.where(F.col(text).isNotNull()).join(F.broadcast(ids), key, "left_semi").select(text, F.xxhash64(key).alias("_hash")).orderBy("_hash", text).limit(sample)
    return train(labelled, [r[0] for r in texts.collect()])


def subject_counts(documents: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """``key, subject, n_sentences, n_placed``: sentences per subject, and those of any subject."""
    kind = documents.schema[key].dataType.simpleString()
    found = documents.select(F.col(key), F.col(text)).mapInArrow(_classify(model), f"id {kind}, subject string, n_sentences bigint, n_placed bigint")
    return found.withColumnRenamed("id", key)


def document_subjects(documents: DataFrame, model: Model, key: str, text: str, share: float = SHARE) -> DataFrame:
    """``key, subject`` of every document and subject that holds the share."""
    return subject_counts(documents, model, key, text).where(F.col("n_sentences") >= share * F.col("n_placed")).select(key, "subject")
