"""Visually identical text with different characters (problem 10).

Texts are exploded to positioned code points (flat arrays, a row per code point
with its text and position), joined with the broadcast mappings - canonical
and width decompositions, look-alike letters, invisible characters - then
combining marks are ordered by class within their base, recomposed, and the
strings are rebuilt. The tables are derived from the Unicode data by rule; they
hold some thousand entries whatever the corpus, and that bound is what makes
the broadcast safe. All passes run inside the scan's own partitions: positions
never cross the network, only fixed-size digests do.
"""

from __future__ import annotations

import functools
import hashlib
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.textarrays import code_points, gather, slices, word_table
from factloom.session import cut

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = (
    ("АВЕЅІЈКМНОРСТУХԌԚԜҺ", "ABESIJKMHOPCTYXGQWh"),
    ("аеѕіјорсухԛԝһԁ", "aesijopcyxqwhd"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("ονρα", "ovpa"),
    ("Ӏӏ", "Il"),
    ("օսհոցզՕՍ", "ouhngqOU"),
)
# Characters without a look of their own.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
ZERO_WIDTH_JOINER = 0x200D
# Compatibility tags whose characters look like what they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")


def mappings() -> dict[int, tuple[int, ...]]:
    """Code point to the code points that stand for it: full decomposition, then look-alikes; () removes it."""
    alike = {ord(a): ord(b) for x, y in LOOK_ALIKES for a, b in zip(x, y, strict=True) if a != b}

    def expand(i: int) -> tuple[int, ...]:
        d = unicodedata.decomposition(chr(i)).split()
        if d and (d[0][0] != "<" or d[0] in SAME_LOOK):
            return tuple(y for x in d[d[0][0] == "<" :] for y in expand(int(x, 16)))
        return (0x20,) if unicodedata.category(chr(i)) == "Zs" else (alike.get(i, i),)

    some = (i for i in range(sys.maxunicode + 1) if i in alike or unicodedata.decomposition(chr(i)) or unicodedata.category(chr(i)) == "Zs")
    out = {i: m for i in some if (m := expand(i)) != (i,)}
    out |= {ord(c): () for c in INVISIBLE} | {i: () for i in range(0xFE00, 0xFE10)} | {i: () for i in range(0xE0100, 0xE01F0)}
    return out


@functools.lru_cache(maxsize=1)
def _tables(key: int) -> tuple[np.ndarray, ...]:
    m = mappings()
    single = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    length = np.ones(sys.maxunicode + 1, np.int8)
    place = np.zeros(sys.maxunicode + 1, np.int32)
    flat: list[int] = []
    for i, to in m.items():
        length[i], place[i] = len(to), len(flat)
        flat.extend(to)
        if len(to) == 1:
            single[i] = to[0]
    classes = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(0x300, sys.maxunicode + 1):
        if c := unicodedata.combining(chr(i)):
            classes[i] = c
    symbol = np.zeros(sys.maxunicode + 1, bool)
    symbol[[i for i in range(0x203C, sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("So", "Sk")]] = True
    return single, length, place, np.array(flat, np.uint32), classes, symbol


def tables() -> tuple[np.ndarray, ...]:
    """The mappings as lookup arrays, made once in a process."""
    return _tables(0)


def uniform_points(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts in uniform form, not yet recomposed, and the new offsets."""
    single, length, place, flat, classes, symbol = tables()
    n = length[cp].astype(np.int64)
    joiner = np.flatnonzero(cp == ZERO_WIDTH_JOINER)
    if len(joiner):  # between two pictures a joiner makes another picture: it is seen
        text = np.searchsorted(offsets, joiner, side="right")
        inner = joiner[(joiner > offsets[text - 1]) & (joiner + 1 < offsets[text])]
        before = cp[inner - 1]
        picked = (before >= 0xFE00) & (before < 0xFE10) & (inner > 1)
        before = np.where(picked, cp[np.maximum(inner - 2, 0)], before)
        n[inner[symbol[before] & symbol[cp[inner + 1]]]] = 1
    if (n == 1).all():
        out = single[cp]
    else:
        out = np.repeat(single[cp], n)
        many = np.flatnonzero(n > 1)
        if len(many):
            first = np.cumsum(n) - n
            out[gather(first[many], n[many])] = flat[gather(place[cp[many]].astype(np.int64), n[many])]
    ends = np.concatenate([[0], np.cumsum(n)])
    offsets = ends[offsets]
    marks = classes[out]
    if (run := np.flatnonzero((marks[1:] > 0) & (marks[:-1] > marks[1:]))).size:
        base = np.cumsum(marks == 0)
        base[:] += np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        touched = np.isin(base, base[run])
        at = np.flatnonzero(touched)
        order = np.lexsort((np.where(marks[at] == 0, 0, marks[at]), base[at]))
        out = out.copy()
        out[at] = out[at][order]
    return out, offsets


def strings(cp: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts rebuilt and recomposed."""
    raw = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    parts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return [p if p.isascii() or unicodedata.is_normalized("NFC", p) else unicodedata.normalize("NFC", p) for p in parts]


def skeletons(texts: list[str | None]) -> list[str]:
    """One form for all texts of one look: look-alikes become Latin letters."""
    return strings(*uniform_points(*code_points(texts)))


@functools.lru_cache(maxsize=1)
def _scripts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    back = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for x, y in LOOK_ALIKES[:2]:
        for a, b in zip(x, y, strict=True):
            if "а" <= a.lower() <= "я":
                back[ord(b)] = ord(a)
    cyrillic, latin = np.zeros(sys.maxunicode + 1, bool), np.zeros(sys.maxunicode + 1, bool)
    cyrillic[0x400:0x530] = True
    latin[[i for i in (*range(0x41, 0x5B), *range(0x61, 0x7B)) if back[i] == i]] = True
    return back, cyrillic, latin


def readable(texts: list[str | None]) -> list[str]:
    """The uniform form for reading: words go back to Cyrillic where their other letters are Cyrillic.

    A word of look-alikes alone follows the script of most other letters of its
    text. The choice depends on the skeleton alone, so texts of one look still
    get one form.
    """
    cp, offsets = uniform_points(*code_points(texts))
    if not len(cp):
        return ["" for _ in texts]
    back, cyrillic, latin = _scripts()
    flags = word_table()[cp] | (tables()[4][cp] > 0)
    begins = flags.copy()
    begins[1:] &= ~flags[:-1]
    inner = offsets[:-1][offsets[:-1] < len(cp)]
    begins[inner] = flags[inner]
    word = np.cumsum(begins)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    is_c, is_l = cyrillic[cp], latin[cp]
    most = np.bincount(text, weights=is_c.astype(np.int8) - is_l.astype(np.int8), minlength=len(texts)) > 0
    of_word = np.zeros((2, int(word[-1]) + 1), bool)
    of_word[0, word[flags & is_c]] = True
    of_word[1, word[flags & is_l]] = True
    as_cyrillic = flags & (of_word[0, word] | (~of_word[1, word] & most[text]))
    return strings(np.where(as_cyrillic, back[cp], cp).astype(np.uint32), offsets)


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _writing(s: str) -> bytes:
    return _digest(s.encode("utf-8", "surrogatepass"))


@functools.cache
def _shown() -> np.ndarray:
    shown = np.ones(sys.maxunicode + 1, bool)
    shown[[i for i in range(0x3100) if chr(i).isspace()]] = False
    return shown


def looks(texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
    """A digest of each text's uniform form (decomposed, which is as unique as composed), and whether it shows anything."""
    cp, offsets = uniform_points(*code_points(texts))
    seen = np.concatenate([[0], np.cumsum(_shown()[cp])])
    raw, ends = memoryview(cp.astype("<u4").tobytes()), (4 * offsets).tolist()
    return [_digest(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], (seen[offsets[1:]] > seen[offsets[:-1]]).tolist()


def add_uniform(df: DataFrame, text: str, out: str = "uniform_text", form: str = "readable") -> DataFrame:
    """``df`` with the uniform form of column ``text`` (null stays null, empty stays empty)."""
    make = {"readable": readable, "skeleton": skeletons}[form]
    schema = df.drop(out).schema.add(out, "string")

    def each(batches):
        for b in batches:
            t = b.column(text).to_pylist()
            new = [y for lo, hi in slices(t) for y in make(t[lo:hi])]
            made = [None if x is None else y for x, y in zip(t, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out])

    return df.drop(out).mapInArrow(each, schema)


def look_digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look, writing): digests of the uniform form and of the string itself, for texts that show anything."""

    def each(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                look, shown = looks(texts[lo:hi])
                keep = [i for i, x in enumerate(shown) if x]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([lo + i for i in keep], pa.int64())),
                        pa.array([look[i] for i in keep], pa.binary()),
                        pa.array([_writing(texts[lo + i]) for i in keep], pa.binary()),
                    ],
                    names=["k", "look", "writing"],
                )

    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t is not null and k is not null")
    return rows.mapInArrow(each, "k long, look binary, writing binary")


def same_look_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b) of all documents that look the same but are not the same string, smaller key first.

    Equal strings are grouped first: only pairs of different writings of one
    look are formed, and documents are joined to those, so a string that a
    third of the corpus repeats costs nothing unless it has another writing.
    Null and blank texts are never a case; repeated rows count once; empty
    tables give no pairs.
    """
    d = cut(look_digests(documents, key, text))
    writings = d.select("look", "writing").distinct()
    several = writings.groupBy("look").agg(F.min("writing").alias("lo"), F.max("writing").alias("hi")).filter("lo != hi").select("look")
    w = writings.join(several, "look", "left_semi")
    pair = w.alias("a").join(w.alias("b"), (F.col("a.look") == F.col("b.look")) & (F.col("a.writing") < F.col("b.writing")))
    pair = pair.select(F.col("a.writing").alias("wa"), F.col("b.writing").alias("wb"))
    docs = d.join(several, "look", "left_semi").select("k", "writing").distinct()
    a, b = docs.toDF("ka", "wa"), docs.toDF("kb", "wb")
    out = pair.join(a, "wa").join(b, "wb")
    return out.select(F.least("ka", "kb").alias("doc_a"), F.greatest("ka", "kb").alias("doc_b"))


def look_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, look_id, writing_id, writings): every document of a look with several writings, with the least keys of its look and of its writing.

    One row a document, whatever the number of pairs: two documents are a pair
    if they have one look_id and different writing_ids. Null and blank texts are
    in no class; repeated rows count once.
    """
    d = cut(look_digests(documents, key, text).distinct())
    w = d.groupBy("look", "writing").agg(F.min("k").alias("writing_id"))
    n = w.groupBy("look").agg(F.min("writing_id").alias("look_id"), F.count(F.lit(1)).alias("writings")).filter("writings > 1")
    return d.join(n, "look").join(w, ["look", "writing"]).select("k", "look_id", "writing_id", "writings")


@functools.lru_cache(maxsize=4)
def uniform_sql(text: str) -> str:
    """SQL of the uniform form of a column, for the mappings of single composed characters."""
    m = mappings()
    single = {i: to[0] for i, to in m.items() if len(to) == 1 and not 0xD800 <= i < 0xE000}
    alike = {a: b for x, y in LOOK_ALIKES for a, b in zip(x, y, strict=True)}
    for i, to in m.items():  # composed letters whose base has a look-alike
        made = unicodedata.normalize("NFC", "".join(map(chr, to)))
        if 0x370 <= i < 0x530 and len(to) > 1 and len(made) == 1 and made != chr(i):
            single[i] = ord(made)
    single |= {ord(a): ord(b) for a, b in alike.items() if a != b}
    pairs = [(chr(i), chr(o)) for i, o in sorted(single.items()) if i != o and chr(o) != "'"]
    gone = "".join(chr(i) for i, to in m.items() if not to and i < 0xFFFF)
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"nfc_normalize(translate(nfc_normalize({text}), {q(''.join(a for a, _ in pairs) + gone)}, {q(''.join(b for _, b in pairs))}))"


def oracle() -> str:
    """The same pairs in SQL, for the mappings of single composed characters."""
    form = uniform_sql("text")
    return f"""
with t as (select distinct doc_id, text, {form} as look from documents where text is not null)
select distinct least(a.doc_id, b.doc_id) as doc_a, greatest(a.doc_id, b.doc_id) as doc_b
from t a join t b on a.look = b.look and a.doc_id < b.doc_id and a.text <> b.text
where regexp_matches(a.look, '\\S')"""
