import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import textarrays, uniform

ALIKE = ["село", "сeло", "ceлo", "се​ло", "с­ело", "се⁠ло", "село️"]


def test_skeletons_of_one_look():
    assert len(set(uniform.skeletons(ALIKE))) == 1
    assert uniform.skeletons(["ＡＢ１"]) == uniform.skeletons(["AB1"])
    assert uniform.skeletons(["ёж"]) == uniform.skeletons(["ёж"]) == uniform.skeletons(["ëж"])
    assert uniform.skeletons(["a b"]) == uniform.skeletons(["a b"]) == uniform.skeletons(["a b"])
    assert uniform.skeletons(["ạ̈"]) == uniform.skeletons(["ạ̈"])


def test_what_differs_stays_different():
    for a, b in [("село", "Село"), ("село", "сёло"), ("1", "2"), ("a b", "a  b"), ("a\nb", "a b"), ("№", "No"), ("А", "а"), ("👩‍👧", "👩👧"), ("x²", "x2")]:
        assert uniform.skeletons([a]) != uniform.skeletons([b])


def test_readable_keeps_scripts():
    assert uniform.readable(["Ha слушаниях в cелe", "A Malo report оn", "", None]) == ["На слушаниях в селе", "A Malo report on", "", ""]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("аaе­​ё̣̈ë ﬁ가Å１x\n")), max_size=12), max_size=6))
def test_skeleton_is_canonical_and_stable(texts):
    made = uniform.skeletons(texts)
    assert made == uniform.skeletons(made)
    assert made == [unicodedata.normalize("NFC", x) for x in made]
    assert made == [uniform.skeletons([t])[0] for t in texts]
    look, shown = uniform.looks(texts)
    assert [a == b for a in look for b in look] == [a == b for a in made for b in made]
    assert shown == [bool(x.strip()) for x in made]


def test_pairs(spark):
    rows = [(1, "село у реки", "x"), (2, "сeло у реки", "y"), (3, "село у реки", "z"), (4, None, "n"), (5, "", "e"), (6, " ​", "b"), (7, " ", "b"), (8, "Село у реки", "c"), (2, "сeло у реки", "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, look string")
    assert {(r.doc_a, r.doc_b) for r in uniform.same_look_pairs(d).collect()} == {(1, 2), (2, 3)}
    assert uniform.same_look_pairs(d).count() == 2
    assert uniform.same_look_pairs(d.limit(0)).count() == 0
    assert {tuple(r) for r in uniform.look_classes(d).collect()} == {(1, 1, 1, 2), (2, 1, 2, 2), (3, 1, 1, 2)}
    assert uniform.look_classes(d.limit(0)).count() == 0
    assert {r.doc_id: r.uniform_text for r in uniform.add_uniform(d, "text").collect()}[4] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab1 .,_я\n", max_size=20)), max_size=6), st.integers(1, 3))
def test_word_arrays_against_regex(texts, size):
    import re

    cp, offsets = textarrays.code_points(texts)
    h, per_text = textarrays.word_hashes(cp, offsets)
    words = [re.findall(r"[^\W_]+", t or "") for t in texts]
    assert np.diff(per_text).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) and len(dict(zip(h.tolist(), flat, strict=True))) == len(set(flat))
    s, o = textarrays.shingles(h, per_text, size)
    assert np.diff(o).tolist() == [len({tuple(w[i : i + size]) for i in range(len(w) - size + 1)}) for w in words]
