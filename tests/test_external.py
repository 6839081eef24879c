import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import external


@pytest.mark.parametrize("rare", [0, 14, 400])
def test_best_documents_in_parts_against_brute_force(spark, monkeypatch, rare):
    for name, n in (("CLAIMS", 7), ("DOCUMENTS", 5), ("ROWS", 3), ("RARE", rare)):
        monkeypatch.setattr(external, name, n)
    rng = random.Random(2)

    def text():
        return " ".join(rng.sample(["#1", "#2", "#3", "Anna", "Boris", "Vera", "bridge", "street", "school", "market"], rng.randint(1, 6)))

    claims = [(i, i, rng.choice([None, *[text()] * 9])) for i in range(40)]
    docs = [(i, rng.choice([None, *[text()] * 9]), rng.random() < 0.3) for i in range(60)]
    c, d = spark.createDataFrame(claims, "id long, content_item_id long, text string"), spark.createDataFrame(docs, "item long, text string, official boolean")
    result = external.best_documents(c, d, "#(\\d)", "([A-Z][a-z]+)", "\\b([a-z]{6,})", 4)
    plan = result._jdf.queryExecution().toString()
    got = sorted(tuple(r) for r in result.collect())
    parts = lambda t: tuple({w for w in (t or "").split() if f(w)} for f in (lambda w: w[0] == "#", str.istitle)) + ({w for w in (t or "").lower().split() if len(w) >= 6 and w[0] != "#"},)
    want = []
    for i, own, t in claims:
        rows = []
        for item, u, official in docs:
            n, m, w = (len(x & y) for x, y in zip(parts(t), parts(u), strict=True))
            if item != own and n + m:
                rows.append((not ((n and w) or (m and w >= 2)), -(5.0 * n + 2.0 * m + 2.5 * w + official), item))
        want += [(i, item, -s, not bad) for bad, s, item in sorted(rows)[:4]]
    assert got == sorted(want) and want
    assert "FlatMapCoGroupsInArrow" in plan  # pairs are not rows of a join
    assert external.best_documents(c, d.filter(F.lit(False)), "#(\\d)", "([A-Z][a-z]+)", "\\b([a-z]{6,})", 4).count() == 0
