"""Near-duplicate records with small edits (problem 7).

A text is the set of hashes of its runs of ``size`` words. Two sets of a and b
elements have a Jaccard similarity of at least t exactly if their Hamming
distance is at most (1 - t) / (1 + t) * (a + b). Nothing is approximate:

1. Texts with the same set form one class (identical copies cost nothing more).
2. Candidates: elements are ordered, rare ones first, by counts over all
   texts; similar sets share an element among their first ones (pigeonhole
   over single elements). Sets travel to the partitions of these elements, with
   a sketch each; there an element's sets stand in order of size, so that only
   sizes that can match meet, and a match is taken up if positions leave room
   for enough common elements. A hot element's sets are parted into blocks, and
   every two blocks meet in a partition of their own: no task holds them all.
3. Pigeonring: a sketch holds, for every bit, whether an odd number of elements
   fall on it, so bits that differ between two sketches bound the distance from
   below. Its words are a ring of ``SEGMENTS`` segments. If two sets are within
   budget, some segment begins a chain in which the first l segments differ by
   at most l / SEGMENTS of the budget, for every l; pairs without such a chain
   are pruned at the shortest length that shows it, inside the partition. Long
   lists of one element are compared by products of matrices instead: the
   product of two sketches, as signs, is their full-length chain.
4. The rest is compared by full sets.

Classes are pre-aggregated before elements travel, hot elements stand last in
the order, and the order needs only a table of ``BUCKETS`` counters, of one
size whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.textarrays import code_points, gather, mix, shingles, slices, word_hashes
from factloom.session import cut

SEGMENTS = 8
BUCKETS = 1 << 18
_BLOCK = 1 << 12
#: Pairs looked at together in a partition, first elements a partition is meant for, and sets of one element in a block.
CHUNK, PER_PARTITION, HOT = 500_000, 1_500_000, 250_000
#: Nanoseconds of a pair looked at by itself; of a pair, a set and a list where sketches are compared as products of matrices; sides of a product.
LOOKED, TILED, TILE = 300, (18, 1_200, 2_000_000), (192, 4096)
#: The eight bits of every byte as -1 and 1.
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1).view(np.dtype((np.void, 32))).ravel()
#: Ids of copies are broadcast up to this many rows (8 bytes each), else joined by shuffle.
MOST_BROADCAST = 200_000


def element_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``size`` lower-case words of each text, ascending, and n+1 offsets."""
    return shingles(*word_hashes(*code_points([t.lower() if t else t for t in texts])), size)


def _owner(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def set_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every set."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    np.add.at(out, _owner(offsets), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return mix(out + np.diff(offsets).astype(np.uint64)).view(np.int64)


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the sketch of a set of n elements: SEGMENTS, doubled until there are two bits an element."""
    return SEGMENTS << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / (32 * SEGMENTS)))).astype(np.int64)


def sketches(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of the sets, one after another, and each one's number of 64-bit words.

    Halves laid over each other give the sketch of half the size.
    """
    words = sketch_words(np.diff(offsets))
    first = np.cumsum(words) - words
    owner = _owner(offsets)
    word = ((h >> np.uint64(20)) & (words[owner] - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, first[owner] + word, np.uint64(1) << ((h >> np.uint64(54)) & np.uint64(63)))
    return out, words


def ring_chains(differ: np.ndarray, budget: np.ndarray, chain: int = SEGMENTS) -> np.ndarray:
    """Which rows of segment differences have a chain of ``chain`` segments within proportional budgets."""
    at, alive, total = np.arange(len(differ)), np.ones(differ.shape, bool), np.zeros(differ.shape)
    for length in range(1, chain + 1):
        total += np.roll(differ, 1 - length, axis=1)
        alive &= total * SEGMENTS <= length * budget[:, None] + 1e-6
        some = alive.any(axis=1)
        if not some.all():
            at, alive, total, differ, budget = at[some], alive[some], total[some], differ[some], budget[some]
    return at


class Entries:
    """First elements of some sets: ids, sizes and sketches by set; set, element, position and side by entry."""

    def __init__(self, ids, n, sketch, doc, element, pos, side=None):
        self.ids, self.n, self.sketch, self.doc, self.element, self.pos = ids, n, sketch, doc, element, pos
        self.side = np.full(len(doc), 2, np.uint8) if side is None else side  # 2: all meet; 0 and 1: blocks that meet each other

    @classmethod
    def of(cls, ids, h, offsets, ranks, num: int, den: int) -> Entries:
        """Of sets of hashes ascending: the least frequent elements first, as many as one of them must be common to two similar sets."""
        n, owner, e = np.diff(offsets), _owner(offsets), mix(h)
        order = np.lexsort((h, ranks[(e & np.uint64(BUCKETS - 1)).astype(np.int64)], owner))
        pos = np.arange(len(h)) - offsets[owner]
        keep = np.flatnonzero(pos <= (n - -(-n * num // den))[owner])
        return cls(ids, n, sketches(h, offsets)[0], owner[keep], e[order][keep], pos[keep])

    def only(self, keep: np.ndarray) -> Entries:
        """The entries at ``keep``; their sets stay as they are."""
        return Entries(self.ids, self.n, self.sketch, self.doc[keep], self.element[keep], self.pos[keep], self.side[keep])

    def spread(self, ranks: np.ndarray, partitions: int, most: int) -> tuple[np.ndarray, Entries]:
        """The partition of every entry, hot elements' entries once for every block they meet, and the entries."""
        blocks = np.maximum(np.ceil((np.exp2(ranks[(self.element & np.uint64(BUCKETS - 1)).astype(np.int64)] / 8.0) - 1) / most), 1).astype(np.int64)
        at = np.repeat(np.arange(len(self.doc)), blocks)
        e, b = self.element[at], blocks[at]
        other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        own = (mix(self.ids.view(np.uint64) ^ np.uint64(0x5A5A5A5A)) >> np.uint64(33)).astype(np.int64)[self.doc[at]] % b
        side = np.where(own == other, 2, own > other).astype(np.uint8)
        pair = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)
        e = np.where(b > 1, mix(e ^ mix(pair + np.uint64(1))), e)
        return ((e >> np.uint64(33)).astype(np.int64) % partitions), Entries(self.ids, self.n, self.sketch, self.doc[at], e, self.pos[at], side)

    def packed(self, cell: np.ndarray, old: bool, narrow: bool) -> tuple[list[int], list[bytes], list[int]]:
        """Cells and, for each, the bytes of its entries and their number; ``narrow`` keeps the 32 bits of elements that the cell does not tell."""
        order = np.argsort(cell, kind="stable")
        cell, doc = cell[order], self.doc[order]
        fresh = np.ones(len(cell), bool)
        fresh[1:] = (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])
        docs, number = doc[fresh], np.cumsum(fresh) - 1
        edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        edge = np.append(edge, len(cell))
        begin = np.append(number[edge[:-1]], len(docs))
        local = number - np.repeat(begin[:-1], np.diff(edge))
        words = sketch_words(self.n)
        sketch = self.sketch[gather((np.cumsum(words) - words)[docs], words[docs])]
        at = np.concatenate([[0], np.cumsum(words[docs])])
        element = (self.element[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32) if narrow else self.element[order]
        pos, side = np.minimum(self.pos[order], 65535).astype(np.uint16), self.side[order]
        ids, n, local = self.ids[docs].astype(np.int64), self.n[docs].astype(np.int32), local.astype(np.uint16)
        cells, blobs = [], []
        for k in range(len(edge) - 1):
            d, e = slice(begin[k], begin[k + 1]), slice(edge[k], edge[k + 1])
            s = sketch[at[d.start] : at[d.stop]]
            head = np.array([d.stop - d.start, len(s), e.stop - e.start, 2 * old + narrow], np.int64)
            cells.append(int(cell[edge[k]]))
            blobs.append(b"".join(x.tobytes() for x in (head, ids[d], n[d], s, element[e], pos[e], local[e], side[e])))
        return cells, blobs, np.diff(edge).tolist()

    @classmethod
    def unpacked(cls, blob: bytes) -> tuple[Entries, bool]:
        """The entries of some bytes, and whether they are of earlier sets."""
        d, k, e, flags = np.frombuffer(blob, np.int64, 4).tolist()
        out, at = [], 32
        for count, kind in ((d, np.int64), (d, np.int32), (k, np.uint64), (e, np.uint32 if flags & 1 else np.uint64), (e, np.uint16), (e, np.uint16), (e, np.uint8)):
            out.append(np.frombuffer(blob, kind, count, at))
            at += out[-1].nbytes
        ids, n, sketch, element, pos, doc, side = out
        return cls(ids, n.astype(np.int64), sketch, doc.astype(np.int64), element, pos.astype(np.int64), side), bool(flags & 2)


class Cell:
    """The sets and first elements that met in one partition."""

    def __init__(self, dense: int = LOOKED) -> None:
        self.parts: list[tuple[Entries, bool]] = []
        self.dense = dense

    def add(self, blob: bytes) -> None:
        self.parts.append(Entries.unpacked(blob))

    def pairs(self, num: int, den: int):
        """Chunks (a, b) of set ids that share an element here and pass the bounds; two old sets never meet."""
        if not self.parts:
            return
        p = [x for x, _ in self.parts]
        ids, n, sketch, element, pos, side = (np.concatenate([getattr(x, k) for x in p]) for k in ("ids", "n", "sketch", "element", "pos", "side"))
        sizes = [len(x.ids) for x in p]
        doc = np.concatenate([x.doc + first for x, first in zip(p, np.cumsum([0, *sizes[:-1]]).tolist(), strict=True)])
        old = np.repeat([o for _, o in self.parts], sizes)
        self.parts = []
        words = sketch_words(n)
        first = np.cumsum(words) - words
        # by element, new sets before old ones, by size: a set's partners are at most two ranges
        key = (np.unique(element, return_inverse=True)[1].astype(np.int64) << 1 | old[doc]) << 32 | n[doc]
        order = np.argsort(key, kind="stable")
        key, doc, pos, side = key[order], doc[order], pos[order], side[order]
        new = np.flatnonzero(~old[doc])
        size, base = n[doc[new]], key[new] >> 32 << 32
        room = n[doc] - pos
        # neither twice as large (at one half) nor so large that what is left of the set is not enough
        most = np.clip(np.minimum(size * den // num, room[new] * (num + den) // num - size), 0, (1 << 32) - 1)
        behind = np.searchsorted(key, base | most, side="right")
        lo, hi = np.searchsorted(key, (base + (1 << 32)) | -(-size * num // den)), np.searchsorted(key, (base + (1 << 32)) | most, side="right")
        alone = np.maximum(behind - new - 1, 0)
        edge = np.flatnonzero(np.r_[True, key[1:] >> 33 != key[:-1] >> 33]) if len(key) else new[:0]
        if len(edge) and self.dense:
            # lists without earlier sets where products of matrices cost less than looking at each pair that meets
            limit, met = room * (num + den) // num - n[doc], np.zeros(len(key), np.int64)
            met[new] = alone
            least = np.minimum.reduceat(np.where(met > 0, n[doc], 1 << 32), edge)
            listed = np.append(edge, len(key))
            usable = np.add.reduceat((limit >= np.repeat(least, np.diff(listed))).astype(np.int64), edge)
            begins = np.add.reduceat((met > 0).astype(np.int64), edge)
            dense = (TILED[0] * begins * usable + TILED[1] * (begins + usable) + TILED[2] < self.dense * np.add.reduceat(met, edge)) & ~np.logical_or.reduceat(old[doc], edge)
            for k in np.flatnonzero(dense).tolist():
                rows = slice(int(listed[k]), int(listed[k + 1]))
                reach = np.arange(rows.stop - rows.start) + 1 + met[rows]
                for x, y in _tiles(doc[rows], n, limit[rows], reach, sketch, first, words, num, den):
                    x, y = x + rows.start, y + rows.start
                    sides = side[x] + side[y]
                    i, j = ids[doc[x]], ids[doc[y]]
                    keep = (i != j) & ((sides == 4) | (sides == 1))
                    if keep.any():
                        yield np.minimum(i, j)[keep], np.maximum(i, j)[keep]
            alone[np.repeat(dense, np.diff(listed))[new]] = 0
        left, start, count = np.concatenate([new, new]), np.concatenate([new + 1, lo]), np.concatenate([alone, np.maximum(hi - lo, 0)])
        some = np.flatnonzero(count)
        left, start, count = left[some], start[some], count[some]
        ends = np.cumsum(count)
        for done in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
            upto = min(done + CHUNK, int(ends[-1]))
            rows = slice(int(np.searchsorted(ends, done, side="right")), int(np.searchsorted(ends, upto)) + 1)
            before = ends[rows] - count[rows]
            skip = np.maximum(done - before, 0)
            take = np.minimum(upto - before, count[rows]) - skip
            x, y = np.repeat(left[rows], take), gather(start[rows] + skip, take)
            na, nb = n[doc[x]], n[doc[y]]
            ok = np.flatnonzero(np.minimum(room[x], room[y]) * (num + den) >= num * (na + nb))
            x, y = x[ok], y[ok]
            met = side[x] + side[y]
            a, b = doc[x], doc[y]
            keep = (ids[a] != ids[b]) & ((met == 4) | (met == 1))
            a, b = a[keep], b[keep]
            least = np.minimum(words[a], words[b])
            for w in np.unique(least).tolist():
                at = np.flatnonzero(least == w)
                p, q = a[at], b[at]
                budget = (den - num) / (den + num) * (n[p].astype(np.float64) + n[q])
                differ = np.zeros((len(at), SEGMENTS), np.int32)
                for i in range(w):
                    u = _folded(sketch, first, words, p, i, w) ^ _folded(sketch, first, words, q, i, w)
                    differ[:, i % SEGMENTS] += np.bitwise_count(u)
                begin = np.flatnonzero(differ.min(axis=1) * SEGMENTS <= budget)  # chains of one segment
                p, q = p[begin], q[begin]
                near = ring_chains(differ[begin], budget[begin])
                if len(near):
                    i, j = ids[p[near]], ids[q[near]]
                    yield np.minimum(i, j), np.maximum(i, j)


def _signs(sketch: np.ndarray, first: np.ndarray, words: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """The bits of the sketches of ``doc``, folded to w words, as -1 and 1; two columns more are left for the sizes."""
    bits = np.empty((len(doc), w), np.uint64)
    for i in range(w):
        bits[:, i] = _folded(sketch, first, words, doc, i, w)
    out = np.empty((len(doc), 64 * w + 2), np.float32)
    out[:, :-2] = _SIGNS[bits.view(np.uint8)].view(np.float32).reshape(len(doc), 64 * w)
    return out


def _tiles(doc, n, limit, reach, sketch, first, words, num: int, den: int):
    """Chunks (x, y) of places in one element's list, in order of size, that pass all bounds.

    x before y, which stands before the ``reach`` of x and whose ``limit`` is x's size or more. The product of two
    sketches of signs is their bits less twice those that differ, and the budget is a sum of two numbers, each of
    one set: one product of matrices tells for every place of a tile whether it is within budget.
    """
    size, width = n[doc], words[doc]
    begins = np.flatnonzero(reach > np.arange(len(doc)) + 1)
    share = 2 * (den - num) / (den + num)
    high, wide = TILE
    for w in np.unique(width[begins]).tolist():
        mine = begins[width[begins] == w]  # the smaller set's sketch is the shorter
        ends = np.flatnonzero(limit >= size[mine[0]])
        ends = ends[slice(*np.searchsorted(ends, [mine[0] + 1, reach[mine].max()]))]
        # tiles of like sizes, and of those with like reach
        mine = mine[np.lexsort((reach[mine], np.arange(len(mine)) // (8 * high)))]
        for lo in range(0, len(ends), wide):
            y, right = ends[lo : lo + wide], None
            for at in range(0, len(mine), high):
                x = mine[at : at + high]
                x = x[(reach[x] > y[0]) & (x < y[-1])]
                if not len(x):
                    continue
                some = np.flatnonzero(limit[y] >= size[x.min()])
                some = some[slice(*np.searchsorted(y[some], [x.min() + 1, reach[x].max()]))]
                if not len(some):
                    continue
                if right is None:
                    right = _signs(sketch, first, words, doc[y], w)
                    right[:, -2], right[:, -1] = 1, share * size[y]
                left = _signs(sketch, first, words, doc[x], w)
                left[:, -2], left[:, -1] = share * size[x], 1
                hit = np.flatnonzero(left @ right[some].T >= 64 * w - 0.01)
                if len(hit):
                    i, j = x[hit // len(some)], y[some[hit % len(some)]]
                    ok = (i < j) & (j < reach[i]) & (limit[j] >= size[i])
                    yield i[ok], j[ok]


def _folded(sketch: np.ndarray, first: np.ndarray, words: np.ndarray, doc: np.ndarray, i: int, w: int) -> np.ndarray:
    """Word i of the sketches of ``doc``, folded to w words."""
    out = sketch[first[doc] + i]
    for step in range(w, int(words[doc].max(initial=0)), w):
        more = np.flatnonzero(words[doc] > step + i)
        out[more] ^= sketch[first[doc[more]] + step + i]
    return out


def _sum_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums the counter blocks of equal keys."""

    def each(key, table):
        total = np.sum([np.frombuffer(x, np.float32) for x in table.column("counts").to_pylist()], axis=0, dtype=np.float32)
        return pa.table([pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array([total.tobytes()], pa.binary())], names=[*keys, "counts"])

    return rows.groupBy(*keys).applyInArrow(each, ", ".join(f"{k} long" for k in keys) + ", counts binary")


def element_counts(h: np.ndarray) -> np.ndarray:
    return np.bincount((mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)


def counter_blocks(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The blocks of counters that are not all zero: their numbers and bytes."""
    blocks = [i for i in range(BUCKETS // _BLOCK) if counts[i * _BLOCK : (i + 1) * _BLOCK].any()]
    return blocks, [counts[i * _BLOCK : (i + 1) * _BLOCK].astype(np.float32).tobytes() for i in blocks]


def ranks_of(blocks: DataFrame) -> bytes:
    """One byte for every counter of (block, salt, counts), the logarithm of its sum; ``BUCKETS`` numbers reach the driver."""
    total = np.zeros(BUCKETS, np.float64)
    by_task = _sum_blocks(blocks.select("block", "salt", "counts"), ["block", "salt"])
    for r in _sum_blocks(by_task.select("block", "counts"), ["block"]).toLocalIterator():
        total[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.counts, np.float32)
    return np.minimum(np.log2(total + 1) * 8, 255).astype(np.uint8).tobytes()


def _rows(cells: list[int], blobs: list[bytes], sizes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int32())], names=["cell", "blob", "m"])


class NearDuplicates:
    """Similarity classes and links of the texts of one DataFrame.

    ``texts`` has a long key ``k`` (unique) and a string ``t``. Rows with null
    keys or texts, and texts of fewer than ``size`` words, belong to no class:
    they have no elements in common with anything. Similarity is
    ``num / den``, from just above 0 to 1.

    ``ranks`` fixes the order of elements (else the counts of these texts give
    it); with it, ``history`` of earlier texts may be given (the methods
    ``cells`` and ``vectors`` of ``history.AcceptedIndex``), and links to those
    are found as well. ``hot``: sets of one element that a block is meant for.
    """

    def __init__(self, texts: DataFrame, size: int = 3, num: int = 1, den: int = 2, ranks: bytes | None = None, history=None, hot: int = HOT):
        if not 0 < num <= den:
            raise ValueError("a similarity above 0, at most 1")
        self.texts = texts.select(F.col("k").cast("long").alias("k"), "t").filter("k is not null and t is not null")
        self.size, self.num, self.den = size, num, den
        self.spark = texts.sparkSession
        self._ranks, self.history, self.hot = ranks, history, hot
        first = cut(self._first_pass())
        self.sets = first.filter("k is not null").select("k", "set", "n")
        self._blocks = first.filter("k is null").select("block", "salt", "counts")
        #: one row a class: its set, size, least key and number of members
        self.classes = cut(self.sets.groupBy("set").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.count(F.lit(1)).alias("members")))

    def _first_pass(self) -> DataFrame:
        size = self.size

        def each(batches):
            counts, salt = np.zeros(BUCKETS, np.int64), TaskContext.get().partitionId() % 32
            for b in batches:
                keys, texts = b.column(0), b.column(1).to_pylist()
                for lo, hi in slices(texts):
                    h, offsets = element_sets(texts[lo:hi], size)
                    counts += element_counts(h)
                    some = np.flatnonzero(np.diff(offsets))
                    if len(some):
                        empty = pa.nulls(len(some), pa.int64())
                        n = pa.array(np.diff(offsets)[some].astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array(some + lo)), pa.array(set_ids(h, offsets)[some]), n, pa.nulls(len(some), pa.binary()), empty, empty], names=["k", "set", "n", "counts", "block", "salt"]
                        )
            blocks, data = counter_blocks(counts)
            if blocks:
                none = pa.nulls(len(blocks), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none.cast(pa.int32()), pa.array(data, pa.binary()), pa.array(blocks, pa.int64()), pa.array([salt] * len(blocks), pa.int64())], names=["k", "set", "n", "counts", "block", "salt"]
                )

        return self.texts.mapInArrow(each, "k long, set long, n int, counts binary, block long, salt long")

    def ranks(self) -> bytes:
        """The rank of every counter of all texts, one byte each: BUCKETS bytes, whatever the corpus."""
        if self._ranks is None:
            self._ranks = ranks_of(self._blocks)
        return self._ranks

    def _only(self, keys: DataFrame, keep: bool, rows: int) -> DataFrame:
        """The texts whose key is in ``keys`` (or is not), broadcast if they are few."""
        side = F.broadcast(keys) if rows <= MOST_BROADCAST else keys
        return self.texts.join(side, "k", "left_semi" if keep else "left_anti")

    def _one_each(self) -> DataFrame:
        """The text of the least key of every class."""
        more = self.sets.count() - self.classes.count()
        copies = self.sets.join(self.classes.select("k"), "k", "left_anti").select("k")
        return self._only(copies, False, more) if more else self.texts

    def partitions(self, more: int = 0) -> int:
        """Partitions for the elements (and ``more`` of them): by their number, at least eight."""
        first = self.classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * self.num / self.den) + 1).alias("x")).first().x or 0
        return max(8, (int(first) + more) // PER_PARTITION + 1)

    def cells(self, texts: DataFrame, partitions: int | None) -> DataFrame:
        """(cell, blob, m): the texts' first elements by partition, spread for a join; with None as entries of cell 0 with whole elements."""
        shared, size, num, den, hot = self.spark.sparkContext.broadcast(self.ranks()), self.size, self.num, self.den, self.hot

        def each(batches):
            ranks = np.frombuffer(shared.value, np.uint8)
            for b in batches:
                texts = b.column(1).to_pylist()
                for begin in range(0, len(texts), 50_000):
                    part = texts[begin : begin + 50_000]
                    for lo, hi in slices(part, 1 << 21):
                        h, offsets = element_sets(part[lo:hi], size)
                        if len(h):
                            entries = Entries.of(set_ids(h, offsets), h, offsets, ranks, num, den)
                            cell = np.zeros(len(entries.doc), np.int64)
                            if partitions is not None:
                                cell, entries = entries.spread(ranks, partitions, hot)
                            yield _rows(*entries.packed(cell, False, partitions is not None))

        return texts.mapInArrow(each, "cell int, blob binary, m int")

    def candidates(self) -> DataFrame:
        """(a, b), a < b, of different sets that share an early element and pass all bounds."""
        num, den, hot = self.num, self.den, self.hot
        if self.history is None:
            count = self.partitions()
            rows = self.cells(self._one_each(), count)
        else:
            new = cut(self.cells(self._one_each(), None))
            old = cut(self.history.cells(new))
            count = self.partitions(int(old.agg(F.sum("m").alias("m")).first().m or 0))
            shared = self.spark.sparkContext.broadcast(self.ranks())

            def spread(batches):
                ranks = np.frombuffer(shared.value, np.uint8)
                for b in batches:
                    for blob in b.column("blob").to_pylist():
                        entries, earlier = Entries.unpacked(blob)
                        cell, entries = entries.spread(ranks, count, hot)
                        yield _rows(*entries.packed(cell, earlier, True))

            rows = new.unionByName(old).select("blob").mapInArrow(spread, "cell int, blob binary, m int")

        def each(batches):
            cell = Cell()
            for b in batches:
                for blob in b.column("blob").to_pylist():
                    cell.add(blob)
            for a, b in cell.pairs(num, den):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        return rows.select("cell", "blob").repartitionById(count, "cell").select("blob").mapInArrow(each, "a long, b long").distinct()

    def vectors(self, texts: DataFrame) -> DataFrame:
        """(set, elements): the full sets of texts of this collection."""
        size = self.size

        def full(batches):
            for b in batches:
                t = b.column(1).to_pylist()
                for lo, hi in slices(t):
                    h, offsets = element_sets(t[lo:hi], size)
                    some = np.flatnonzero(np.diff(offsets))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(offsets[some], len(h)), pa.int32()), pa.array(h.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(set_ids(h, offsets)[some]), lists], names=["set", "elements"])

        return texts.mapInArrow(full, "set long, elements array<long>")

    def links(self) -> DataFrame:
        """(set_a, set_b, common, na, nb): all pairs of different sets of enough similarity."""
        num, den = self.num, self.den
        near = cut(self.candidates())
        used = near.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        keys = cut(self.classes.join(used, "set").select("k"))
        whole = self.vectors(self._only(keys, True, keys.count()))
        if self.history is not None:
            whole = whole.unionByName(self.history.vectors(used)).dropDuplicates(["set"])
        both = near.join(whole.toDF("a", "ea"), "a").join(whole.toDF("b", "eb"), "b")
        both = both.select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), F.size(F.array_intersect("ea", "eb")).alias("common"), F.size("ea").alias("na"), F.size("eb").alias("nb"))
        return both.filter(F.col("common") * (num + den) >= num * (F.col("na") + F.col("nb")))

    def pairs(self) -> DataFrame:
        """(id_a, id_b) of all alike texts, the smaller key first, copies expanded."""
        members = self.sets.select("set", "k")
        a, b = members.toDF("set_a", "ka"), members.toDF("set_b", "kb")
        different = self.links().select("set_a", "set_b").join(a, "set_a").join(b, "set_b").select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b"))
        several = self.sets.join(self.classes.filter("members > 1").select("set"), "set", "left_semi").select("set", "k")
        same = several.toDF("set", "id_a").join(several.toDF("set", "id_b"), "set").filter("id_a < id_b").select("id_a", "id_b")
        return different.unionByName(same)

    def membership(self) -> DataFrame:
        """(k, class_id, links): for every text its class's least key and the number of other classes it is alike to."""
        ends = self.links().select(F.explode(F.array("set_a", "set_b")).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("links"))
        named = self.classes.select("set", F.col("k").alias("class_id")).join(ends, "set", "left")
        return self.sets.select("set", "k").join(named, "set").select("k", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
