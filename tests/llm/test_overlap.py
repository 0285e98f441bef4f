import random

import numpy as np
import pyarrow as pa

from pathloom.llm import overlap

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at, how = rng.randrange(len(t)), rng.randrange(3)
        if how == 0:
            t[at] = rng.choice(LETTERS)
        elif how == 1:
            t.insert(at, rng.choice(LETTERS))
        elif len(t) > 1:
            del t[at]
    return "".join(t)


def test_texts_a_tenth_apart_nearly_always_meet():
    rng = random.Random(11)
    base = ["".join(rng.choice(LETTERS) for _ in range(80)) for _ in range(3000)]
    near = ["".join(("a" if c != "a" else "b") if i % 10 == 5 else c for i, c in enumerate(t)) for t in base]
    codes = [overlap.blocks(*overlap.features(pa.array(x)), np.zeros(len(x), np.uint64)) for x in (base, near)]
    assert (codes[0] != codes[1]).all(axis=1).mean() < 0.01


def test_signature_never_parts_texts_within_the_bound():
    rng = random.Random(12)
    base = ["".join(rng.choice(LETTERS[: rng.choice((2, 26))]) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    edits = [rng.randrange(0, 7) for _ in base]
    near = [edited(rng, t, d) for t, d in zip(base, edits)]
    (n, a), (m, b) = overlap.signature(pa.array(base)), overlap.signature(pa.array(near))
    assert n.tolist() == [len(t) for t in base] and m.tolist() == [len(t) for t in near]
    assert (np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1) <= 4 * np.array(edits)).all()
    far = np.bitwise_count((a ^ np.roll(a, 1, axis=0)).view(np.uint64)).sum(axis=1)
    assert (far > 4 * 0.1 * np.maximum(n, np.roll(n, 1))).mean() > 0.5
    assert overlap.signature(pa.array([], pa.string()))[1].shape == (0, 2)
