import random
import re

import numpy as np
import pytest

from factloom.llm import leaks


def distance(pattern, text):
    """Least edit distance of the pattern to any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


@pytest.mark.parametrize(("size", "errors"), [(6, 0), (6, 1), (9, 2), (12, 0)])
def test_search_against_brute_force(size, errors):
    rng = random.Random(size + errors)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 30))] for _ in range(8)]
    docs = []
    for _ in range(60):
        doc = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            it = rng.choice(items)
            a = rng.randrange(len(it))
            piece = it[a : a + rng.randint(3, 16)]
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(piece)) if piece else 0
                piece = rng.choice([piece[:k] + piece[k + 1 :], piece[:k] + ["new"] + piece[k:], piece[:k] + ["other"] + piece[k + 1 :]])
            doc[len(doc) // 2 : len(doc) // 2] = piece
        docs.append(doc)
    it = leaks.Items(list(range(len(items))), [" ".join(x) for x in items], size, errors)
    t, i = it.search([" ".join(x) for x in docs])
    want = {(d, n) for d, doc in enumerate(docs) for n, x in enumerate(items) if any(distance(x[s : s + size], doc) <= errors for s in range(len(x) - size + 1))}
    assert set(zip(t.tolist(), i.tolist(), strict=True)) == want


def test_differences_that_do_not_count(spark):
    item = "Один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать"
    docs = [
        (1, "начало. ОДИН, два\nтри — чeтырe пять шесть се­мь восемь де​вять десять одиннадцать двенадцать!"),
        (2, item.replace("семь", "сем")),
        (3, item.rsplit(" ", 1)[0]),
        (4, None),
        (5, ""),
        (6, "Boпpoc " + item.replace("восемь", "BOCEMЬ")),
        (1, "повтор " + item),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as item_id")
    b = spark.createDataFrame([(7, item), (8, "мало слов"), (9, None), (7, item)], "item_id long, text string")
    assert {(r.item_id, r.doc_id) for r in leaks.leaked_items(d, b).collect()} == {(7, 1), (7, 6)}
    assert leaks.leaked_items(d, b).count() == 2
    assert leaks.leaked_items(d, b.limit(0)).count() == 0
    assert leaks.leaked_items(d.limit(0), b).count() == 0


def test_several_passes_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    make = lambda: " ".join(f"w{i}" for i in rng.integers(0, 400, 30))
    items = [(i, make()) for i in range(12)]
    docs = [(i, make() + " " + items[i % 12][1] if i % 3 else make()) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = {(r.item_id, r.doc_id) for r in leaks.leaked_items(d, b).collect()}
    monkeypatch.setattr(leaks, "MOST_ITEM_WORDS", 200)
    assert {(r.item_id, r.doc_id) for r in leaks.leaked_items(d, b).collect()} == one and one


def test_a_piece_that_many_items_share_in_parts(spark, monkeypatch):
    words = [f"w{i}" for i in range(12)]
    items = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(["a", *words, "b"] * 3)) for k in range(4)], "doc_id long, text string")
    for most in (1_000_000, 7):
        monkeypatch.setattr(leaks, "MOST_PLACES", most)
        assert leaks.leaked_items(docs, items).count() == 120


def test_recall_of_planted_edits():
    """Windows of real test passages with up to two words changed, left out or put in, planted into real documents: all are found."""
    import pyarrow.parquet as pq

    rng = random.Random(11)
    folder = "/root/testdata/sf0.001"
    items = {r["item_id"]: re.findall(r"[^\W_]+", r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist() if r["text"]}
    docs = [r["text"].split() for r in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).to_pylist() if r["text"]]
    long = [k for k, w in items.items() if len(w) >= 16]
    planted, texts = [], []
    for n in range(300):
        k = rng.choice(long)
        at = rng.randrange(len(items[k]) - 15)
        w = items[k][at : at + 16]
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], [*w[:i], "вставка", *w[i:]], [*w[:i], "замена", *w[i + 1 :]]])
        d = list(rng.choice(docs))
        d[len(d) // 2 : len(d) // 2] = w
        texts.append(" ".join(d))
        planted.append((n, long.index(k)))
    it = leaks.Items(long, [" ".join(items[k]) for k in long], 16, 2)
    t, i = it.search(texts)
    assert set(planted) <= set(zip(t.tolist(), i.tolist(), strict=True))
