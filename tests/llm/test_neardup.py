import random
import re

import numpy as np
import pytest

from factloom.llm import neardup


def sets_of(rows, size):
    out = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        if k is not None and s:
            out[k] = s
    return out


def brute(rows, size, num, den):
    s = sets_of(rows, size)
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) * den >= num * len(s[a] | s[b])}


def corpus(seed, n=70):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 6)):
                i = rng.randrange(len(w)) if w else 0
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + [rng.choice(words)] + w[i:], w[i:] + w[:i]])
        else:
            w = [rng.choice(words) for _ in range(rng.choice([2, 5, 20, 60, 400]))]
        rows.append((k, " ".join(w)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 0) for k, t in rows], "k long, t string, set int")


@pytest.mark.parametrize(("size", "num", "den"), [(3, 1, 2), (5, 4, 5), (1, 1, 3)])
def test_pairs_against_brute_force(spark, size, num, den):
    rows = corpus(size) + [(900, None), (901, ""), (902, "!!"), (None, "w1 w2 w3 w4")]
    want = brute(rows, size, num, den)
    got = neardup.NearDuplicates(frame(spark, rows), size, num, den)
    pairs = [(r.id_a, r.id_b) for r in got.pairs().collect()]
    assert set(pairs) == want and len(pairs) == len(want) and want
    s = sets_of(rows, size)
    for r in got.membership().collect():
        same = [k for k in s if s[k] == s[r.k]]
        near = {frozenset(s[b if a == r.k else a]) for a, b in want if r.k in (a, b)} - {frozenset(s[r.k])}
        assert (r.class_id, r.links) == (min(same), len(near))


def test_copies_and_many_of_one_word_run(spark):
    rows = [(i, "один и тот же текст для всех") for i in range(40)] + [(50 + i, f"один и тот же текст для {i}") for i in range(5)]
    got = neardup.NearDuplicates(frame(spark, rows))
    assert {(r.id_a, r.id_b) for r in got.pairs().collect()} == brute(rows, 3, 1, 2)
    assert got.classes.count() == 6


def test_empty(spark):
    assert neardup.NearDuplicates(frame(spark, []).limit(0)).pairs().count() == 0


def test_sketch_distance_is_a_lower_bound_and_folds():
    rng = np.random.default_rng(2)
    for _ in range(60):
        common = rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64)
        a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 300)).astype(np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 300)).astype(np.uint64)]))
        sketch, words = neardup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        first, w, x, y = np.cumsum(words) - words, int(words.min()), np.array([0]), np.array([1])
        bits = sum(int(np.bitwise_count(neardup._folded(sketch, first, words, x, i, w) ^ neardup._folded(sketch, first, words, y, i, w))[0]) for i in range(w))
        assert bits <= len(np.setxor1d(a, b))


def test_chains_keep_all_within_budget():
    rng = np.random.default_rng(1)
    d = rng.integers(0, 12, (2000, neardup.SEGMENTS)).astype(np.float64)
    budget = rng.integers(10, 70, 2000).astype(np.float64)
    full = set(neardup.ring_chains(d, budget).tolist())
    assert full == set(np.flatnonzero(d.sum(axis=1) <= budget).tolist())
    assert full <= set(neardup.ring_chains(d, budget, 3).tolist())


def test_long_runs_of_one_element_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 7)
    ids = np.arange(1, 31)
    h = np.concatenate([[np.uint64(5), np.uint64(100 + i)] for i in ids]).astype(np.uint64)
    sketch, _ = neardup.sketches(h, np.arange(0, 61, 2))
    entries = neardup.Entries(ids, np.full(30, 2), sketch, np.arange(30), np.full(30, 5, np.uint64), np.zeros(30, np.int64))
    cell = neardup.Cell()
    cell.add(entries.packed(np.zeros(30, np.int64), False, True)[1][0])
    got = {(int(a), int(b)) for x, y in cell.pairs(1, 3) for a, b in zip(x, y, strict=True)}
    assert got == {(int(a), int(b)) for a in ids for b in ids if a < b}


def test_hot_elements_meet_in_blocks(spark):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(common[: rng.randint(8, 12)] + [rng.choice("xyz") + str(rng.randrange(4)) for _ in range(4)])) for i in range(90)]
    t = spark.createDataFrame(rows, "k long, t string")
    whole = {tuple(r) for r in neardup.NearDuplicates(t).pairs().collect()}
    assert len(whole) > 90
    for hot in (40, 7):
        got = [tuple(r) for r in neardup.NearDuplicates(t, hot=hot).pairs().collect()]
        assert set(got) == whole and len(got) == len(whole)


@pytest.mark.parametrize("tile", [(3, 7), (192, 4096)])
def test_products_of_sketches_find_what_single_looks_find(monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[:140], rng.integers(1, 90))) for _ in range(60)] + [np.unique(rng.choice(pool, rng.integers(180, 460), replace=False)) for _ in range(50)]
    h, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    ranks = np.minimum(np.log2(neardup.element_counts(h) + 1) * 8, 255).astype(np.uint8)
    entries = neardup.Entries.of(neardup.set_ids(h, offsets), h, offsets, ranks, 1, 2)
    calls, tiles = [], neardup._tiles
    monkeypatch.setattr(neardup, "_tiles", lambda *a: calls.append(len(a[0])) or tiles(*a))
    for hot in (1 << 30, 25):
        cells, blobs, _ = entries.spread(ranks, 2, hot)[1].packed(entries.spread(ranks, 2, hot)[0], False, True)
        found = []
        for looked in (0, 1 << 40):
            calls.clear()
            out = set()
            for blob in blobs:
                cell = neardup.Cell(looked)
                cell.add(blob)
                out |= {(int(a), int(b)) for x, y in cell.pairs(1, 2) for a, b in zip(x, y, strict=True)}
            found.append(out)
            assert bool(calls) == bool(looked)
        assert found[0] == found[1] and len(found[0]) > 20


def test_long_lists_are_not_looked_at_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(np.r_[np.uint64(11), rng.integers(12, 1 << 63, 99).astype(np.uint64)]) for _ in range(1500)]
    h, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    n = np.diff(offsets)
    entries = neardup.Entries(np.arange(1500), n, neardup.sketches(h, offsets)[0], np.arange(1500), np.full(1500, 5, np.uint64), np.zeros(1500, np.int64))
    monkeypatch.setattr(neardup, "ring_chains", lambda *a: pytest.fail("a long list pair by pair"))
    cell = neardup.Cell()
    cell.add(entries.packed(np.zeros(1500, np.int64), False, True)[1][0])
    assert not list(cell.pairs(1, 2))
