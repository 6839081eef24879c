"""Evaluation passages inside training documents (problem 9).

A window of ``words`` consecutive words of a test item may occur in a document
with at most ``errors`` word edits. Items are cut into adjoining pieces, so
short that every window holds errors + 1 whole pieces: with at most that many
edits less one, some piece of the window is untouched (pigeonhole). Pieces
found exactly in a document name the places to look at; there the window is
compared by Myers' bit-parallel edit distance, for all places at once.

Words are compared without case, punctuation, white space, line breaks and the
differences of characters that look the same: hashes are taken of a caseless
form in which letters that look alike in either case are one.

The test items are the stated query set. They are broadcast as arrays of word
hashes: their size is checked against ``MOST_ITEM_WORDS``, and larger sets are
handled in several passes of that size. Documents are only mapped.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.textarrays import code_points, gather, slices, word_hashes
from factloom.llm.uniform import LOOK_ALIKES, uniform_points, uniform_sql

#: Words of test items in one pass over the documents (16 bytes each in the broadcast).
MOST_ITEM_WORDS = 2_000_000
#: Hits (a place of a document, a piece of an item) verified together.
MOST_PLACES = 1_000_000


@functools.lru_cache(maxsize=1)
def caseless() -> np.ndarray:
    """Code point to the smallest one it equals when case and look-alikes do not count."""
    root = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i).lower()
        if len(c) == 1 and c != chr(i):
            root[i] = ord(c)
    groups: dict[int, int] = {}

    def top(i: int) -> int:
        while groups.get(i, i) != i:
            i = groups[i]
        return i

    for x, y in LOOK_ALIKES:
        for a, b in zip(x, y, strict=True):
            p, q = sorted((top(int(root[ord(a)])), top(int(root[ord(b)]))))
            groups[q] = p
    for i in list(groups):
        root[root == i] = top(i)
    return root


def oracle_form(text: str) -> str:
    """SQL of a column's text with one letter for all that are equal here."""
    root, form = caseless(), uniform_sql(text)
    pairs = sorted({(c, chr(root[ord(c)])) for x, y in LOOK_ALIKES for c in (x + y).lower() if root[ord(c)] != ord(c)})
    return f"translate(lower({form}), '{''.join(a for a, _ in pairs)}', '{''.join(b for _, b in pairs)}')"


def compared_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words as they are compared, and the n+1 word offsets; a mark belongs to its letter's word."""
    cp, offsets = uniform_points(*code_points(texts))
    return word_hashes(caseless()[cp], offsets, marks=True)


class Items:
    """Test items as arrays: their words, and their pieces by hash."""

    def __init__(self, keys: list[int], texts: list[str | None], words: int, errors: int):
        self.size, self.errors = words, errors
        self.piece = (words + 1) // (errors + 2)
        if self.piece < 1:
            raise ValueError("more errors than a window of so few words can be searched with")
        self.keys = np.array(keys, np.int64)
        self.words, self.offsets = compared_words(texts)
        self.vocabulary, self.ids = np.unique(self.words, return_inverse=True)
        starts = [np.arange(a, b - self.piece + 1, self.piece) for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True) if b - a >= words]
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.item = np.searchsorted(self.offsets, self.starts, side="right") - 1
        h = self.rolled(self.ids.astype(np.uint64))
        order = np.argsort(h[self.starts], kind="stable") if len(self.starts) else np.zeros(0, np.int64)
        self.starts, self.item = self.starts[order], self.item[order]
        self.hashes = h[self.starts] if len(self.starts) else np.zeros(0, np.uint64)

    def rolled(self, ids: np.ndarray) -> np.ndarray:
        """Hash of the ``piece`` words from each place on."""
        n = max(0, len(ids) - self.piece + 1)
        h = np.zeros(n, np.uint64)
        for i in range(self.piece):
            h = (h + ids[i : i + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) numbers of all texts that hold a window of an item."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, per_text = compared_words(texts)
        if not len(self.hashes) or len(words) < self.size - self.errors:
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == words, at, len(self.vocabulary)).astype(np.int64)
        h = self.rolled(ids.astype(np.uint64))
        lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return none
        n = hi[hit] - lo[hit]
        ends, found = np.cumsum(n), []
        for done in range(0, int(ends[-1]), MOST_PLACES):  # a piece that many items share is met in parts
            upto = min(done + MOST_PLACES, int(ends[-1]))
            rows = slice(int(np.searchsorted(ends, done, side="right")), int(np.searchsorted(ends, upto)) + 1)
            begin = ends[rows] - n[rows]
            skip = np.maximum(done - begin, 0)
            take = np.minimum(upto - begin, n[rows]) - skip
            place = np.repeat(hit[rows], take)
            piece = gather(lo[hit[rows]] + skip, take)
            found.append(self._held(ids, per_text, place, piece))
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.keys), pairs % len(self.keys)

    def _held(self, ids: np.ndarray, per_text: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """text * items + item of the hits (a place of a document, a piece of an item) around which a window of the item stands."""
        text = np.searchsorted(per_text, place, side="right") - 1
        inside = place + self.piece <= per_text[text + 1]
        place, piece, text = place[inside], piece[inside], text[inside]
        found = np.zeros(len(place), bool)
        begin, end = self.offsets[self.item[piece]], self.offsets[self.item[piece] + 1]
        for shift in range(self.size - self.piece + 1):  # the windows that hold the piece
            window = self.starts[piece] - shift
            todo = np.flatnonzero(~found & (window >= begin) & (window + self.size <= end))
            if len(todo):
                near = self.myers(ids, window[todo], place[todo] - shift - self.errors, per_text[text[todo]], per_text[text[todo] + 1])
                found[todo[near <= self.errors]] = True
        return np.unique(text[found] * len(self.keys) + self.item[piece[found]])

    def myers(self, ids: np.ndarray, window: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least edit distance of each item window to any stretch of the document around ``at``."""
        m, one = self.size, np.uint64(1)
        full, top = np.uint64((1 << m) - 1), np.uint64(m - 1)
        pattern = np.stack([self.ids[window + i] for i in range(m)])
        vp, vn = np.full(len(window), full), np.zeros(len(window), np.uint64)
        score = np.full(len(window), m, np.int64)
        best = score.copy()
        for step in range(m + 2 * self.errors):
            here = at + step
            inside = (here >= lo) & (here < hi)
            word = np.where(inside, ids[np.clip(here, 0, len(ids) - 1)], -1)
            eq = np.zeros(len(window), np.uint64)
            for i in range(m):
                eq |= (pattern[i] == word).astype(np.uint64) << np.uint64(i)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
            score += ((hp >> top) & one).astype(np.int64) - ((hn >> top) & one).astype(np.int64)
            hp, hn = (hp << one) & full, (hn << one) & full
            vp, vn = (hn | ~(d0 | hp)) & full, hp & d0
            best = np.minimum(best, np.where(inside, score, best))
        return best


def leaked_items(
    documents: DataFrame, items: DataFrame, words: int = 12, errors: int = 0, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, doc_id) for every document with ``words`` consecutive words of an item, up to ``errors`` word edits.

    Items of fewer words, null and empty texts are no case; repeated rows count
    once; without items or documents the result is empty.
    """
    if not 1 <= words <= 62:
        raise ValueError("words: from 1 to 62")
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t is not null and k is not null")
    chosen = items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("t")).dropna().distinct()
    out, keys, texts, held = None, [], [], 0

    def one_pass(keys, texts):
        shared = spark.sparkContext.broadcast(Items(keys, texts, words, errors))

        def each(batches):
            it = shared.value
            for b in batches:
                ids, docs = b.column(0), b.column(1).to_pylist()
                for lo, hi in slices(docs):
                    t, i = it.search(docs[lo:hi])
                    if len(t):
                        yield pa.RecordBatch.from_arrays([pa.array(it.keys[i]), ids.take(pa.array(t + lo))], names=["item_id", "doc_id"])

        return rows.mapInArrow(each, "item_id long, doc_id long")

    for r in chosen.toLocalIterator():  # the stated query set, a bounded number of words at a time
        keys.append(r.k)
        texts.append(r.t)
        held += len(r.t) // 2 + 1
        if held >= MOST_ITEM_WORDS:
            out, keys, texts, held = (one_pass(keys, texts) if out is None else out.unionByName(one_pass(keys, texts))), [], [], 0
    if keys or out is None:
        last = one_pass(keys, texts)
        out = last if out is None else out.unionByName(last)
    return out.distinct()
