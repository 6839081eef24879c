"""Encoding of a corpus with a public byte-level BPE (problem 8).

In a byte-level BPE the encoding of a prefix ends in one certain token, and
the encoding is that of the prefix without that token, followed by it. So a
prefix needs only one state, its last token, found among the vocabulary's
tokens that end there: it is the one that can stand after the last token of
what precedes it, or that is the whole prefix. Two tokens can be neighbours if
the merges of their joined bytes give back the same two.

Distinct words are inserted into a trie; walking it depth first hands down the
last-token states, so a prefix that many words share is worked out once. The
walk goes over the sorted words: the common prefix of neighbours is the path
of the trie that stays on the stack. Ids of a whole batch are then gathered
from the words' ids in one array pass. Encoding is a map over the scan: no
shuffle, nothing collected.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.textarrays import code_points, gather, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this tokenizer splits texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts whose letters and digits Python's own module tells apart as well, twice as fast.
SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Words kept from batch to batch in a worker; beyond, it starts anew (results do not change).
MOST_WORDS = 1_000_000


@functools.lru_cache(maxsize=1)
def _splitters() -> tuple[np.ndarray, re.Pattern, regex.Pattern]:
    """Flags of the code points that the simple pattern must not meet, and both patterns.

    Blocks of many scripts are compared character by character; the rest,
    pictures and presentation forms apart, goes to the full pattern.
    """
    full = [regex.compile(x) for x in (r"\p{L}", r"\p{N}", r"\s")]
    own = [re.compile(x) for x in (r"[^\W\d_]", r"\d", r"\s")]
    odd = np.ones(0x110000, bool)
    for block in (range(0x3000), range(0xFE00, 0xFE10), range(0xFEFF, 0xFF60), range(0x1F300, 0x1F650), range(0x1F680, 0x1F6C0)):
        for i in block:
            odd[i] = [bool(p.match(chr(i))) for p in own] != [bool(p.match(chr(i))) for p in full]
    return odd, re.compile(SIMPLE), regex.compile(PATTERN)


def split_words(texts: list[str | None]) -> list[list[str]]:
    """Each text cut into the tokenizer's words; nothing is lost."""
    odd, simple, full = _splitters()
    cp, offsets = code_points(texts)
    before = np.concatenate([[0], np.cumsum(odd[cp])])
    strange = before[offsets[1:]] > before[offsets[:-1]]
    return [(full if o else simple).findall(t) if t else [] for t, o in zip(texts, strange.tolist(), strict=True)]


#: Pairs of tokens remembered by a process, some 100 bytes each.
MOST_NEIGHBOURS = 1_000_000


class TrieEncoder:
    """Ids of words by a walk over the trie of the words' bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.ends: dict[bytes, list[int]] = {}  # lengths of the tokens by their last two bytes, longest first
        for t in ranks:
            self.ends.setdefault(t[-2:], []).append(len(t))
        self.ends = {k: sorted(set(v), reverse=True) for k, v in self.ends.items()}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 12, np.int32)
        self.starts: list[int] = []
        self.lengths: list[int] = []
        self.used = 0

    def merged(self, word: bytes) -> list[int]:
        """The merges done one by one, lowest rank first, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a in an encoding (a < 0: can begin one)."""
        known = self.neighbours.get((a, b))
        if known is None:
            if len(self.neighbours) >= MOST_NEIGHBOURS:
                self.neighbours.clear()
            want = [b] if a < 0 else [a, b]
            known = self.neighbours[a, b] = self.merged(b"".join(self.tokens[t] for t in want)) == want
        return known

    def last_token(self, word: bytes, end: int, states: list[int]) -> int:
        """The last token of the encoding of word[:end], by the states of the shorter prefixes."""
        for length in (*self.ends.get(word[max(0, end - 2) : end], ()), 1):
            if length <= end:
                token = self.ranks.get(word[end - length : end])
                if token is not None and self.fits(states[end - length], token):
                    return token
        raise ValueError("the vocabulary has no token for a byte")

    def walk(self, words: list[bytes]):
        """(word, ids) for distinct words, depth first: states of common prefixes are kept."""
        states, before = [-1], b""
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                same += 1
            del states[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                states.append(self.last_token(word, end, states))
            before, ids, end = word, [], len(word)
            while end:
                ids.append(states[end])
                end -= len(self.tokens[states[end]])
            yield word, ids[::-1]

    def add(self, words: set[str]) -> None:
        """Works out words that are not known yet."""
        for raw, ids in self.walk([w.encode("utf-8", "surrogatepass") for w in words]):
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.index[raw.decode("utf-8", "surrogatepass")] = len(self.starts)
            self.starts.append(self.used)
            self.lengths.append(len(ids))
            self.used += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the n+1 offsets at which each text's begin."""
        if len(self.index) > MOST_WORDS:
            self.reset()
        split = split_words(texts)
        new = set().union(*split) - self.index.keys()
        if new:
            self.add(new)
        get = self.index.__getitem__
        words = np.array([i for ws in split for i in map(get, ws)], np.int64)
        lengths = np.array(self.lengths, np.int64)[words]
        ends = np.zeros(len(words) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        per_text = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(ws) for ws in split], out=per_text[1:])
        return self.flat[gather(np.array(self.starts, np.int64)[words], lengths)], ends[per_text]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One encoder a process; its words serve all batches and tasks of the worker."""
    return TrieEncoder(read_ranks(path))


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: the text as it stands, without special tokens.

    Null and empty texts give an empty list. Strings of special tokens are
    ordinary text. Repeated rows stay repeated; a null key stays null. The
    vocabulary file must be readable at the same path on every executor.
    """

    def each(batches):
        e = encoder(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, 1 << 19):
                ids, ends = e.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], names=["k", "ids"])

    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(each, "k long, ids array<int>").withColumnRenamed("k", key)
