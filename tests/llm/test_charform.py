import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm.charform import convert, invariants

SAME = [("Ａｆｔｅｒ", "After"), ("é", "é"), ("a b", "a b"), ("z​e­r﻿o", "zero"), ("Нello", "Hello"), ("ﬁne", "fine"), ("⽤", "用"), ("й", "й"), ("각", "각"), ("𝐀b", "Ab")]


def one(text, form):
    return convert(pa.array([text]), form)[0].as_py()


def test_forms_that_look_the_same_agree():
    for a, b in SAME:
        assert one(a, "form") == one(b, "form"), (a, b)


def test_case_punctuation_and_ordinary_blanks_stay():
    for text in ("Ab", "a, b", "a\tb\n", "a  b"):
        assert one(text, "form") == text
    assert one("A-b, C!", "reduce") == "abc"
    assert one("café", "reduce") != one("cafe", "reduce")


def test_nulls_empties_and_offsets():
    texts = pa.array(["x", None, "", "​", "é" * 3, None])
    assert convert(texts, "form").to_pylist() == ["x", None, "", "", "ééé", None]
    assert convert(texts.slice(1, 4), "reduce").to_pylist() == [None, "", "", "ééé"]
    assert convert(pa.array([], pa.string()), "form").to_pylist() == []


def test_letter_case_of_other_scripts():
    assert one("Вода", "reduce") == one("ВОДА", "reduce") == one("вода", "reduce")


def test_very_long_mark_clusters():
    text = "a" + "̣́" * 2000
    assert unicodedata.normalize("NFD", one(text, "form")) == unicodedata.normalize("NFD", unicodedata.normalize("NFC", text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeAnéüṇ̃́̈ ,。中文ййНο１ﬁ​ 각"), max_size=12), min_size=1, max_size=8))
def test_whole_batches_agree_with_single_texts_and_invariants_follow_the_reduced_text(texts):
    for form in ("form", "reduce"):
        whole = convert(pa.array(texts), form).to_pylist()
        assert whole == [one(t, form) for t in texts]
        assert whole == convert(pa.array(whole, pa.string()), form).to_pylist()
        assert all(unicodedata.is_normalized("NFC", t) for t in whole)
    reduced = convert(pa.array(texts), "reduce").to_pylist()
    size, hist = invariants(pa.array(texts))
    again = invariants(pa.array(reduced, pa.string()))
    assert (size == again[0]).all() and (hist == again[1]).all()
