import random

import __spark_entry__

from factloom.operators import blocks, similarity


def test_blocked_neighbours_are_those_of_the_join(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("мост река район дом лес снег год два три акт".split()) for _ in range(rng.randint(3, 9)))) for i in range(120)]
    d = spark.createDataFrame(rows + [(200, None), (201, ""), (202, "одно")], "id long, text string")
    monkeypatch.setattr(blocks, "DENSE", 4)
    kept = spark.createDataFrame(rows + [(200, ""), (201, ""), (202, "одно")], "id long, text string")
    want = {tuple(r) for r in similarity.neighbours(kept).select("id", "neighbour", "score", "rank").collect()}
    got = {tuple(r) for r in blocks.neighbours(d, most_queries=50, most_terms=40).select("id", "neighbour", "score", "rank").collect()}
    assert got == want and len(want) > 300
    asked = blocks.neighbours(d, d.filter("id % 20 = 0").select("id")).select("id", "neighbour", "score", "rank")
    assert {tuple(r) for r in asked.collect()} == {r for r in want if r[0] % 20 == 0}


def test_neighbours_of_items_and_entities_are_found(spark, tmp_path):
    items = [(20, "Мост", "построен через реку"), (21, "Мост", "построен через реку снова"), (22, None, "нечто другое"), (40, None, None)]
    spark.createDataFrame(items, "id long, title string, body_text string").write.parquet(f"{tmp_path}/content_items.parquet")
    spark.createDataFrame([(1, "Завод Восток", None), (2, "Завод Восток", "цех"), (3, "Иванов", None)], "id long, canonical_name string, description string").write.parquet(f"{tmp_path}/entities.parquet")
    got = __spark_entry__.queries()["tfidf_neighbors_items"](spark, str(tmp_path))
    assert {(r.kind, r.id, r.neighbour) for r in got.collect()} == {("content", 20, 21), ("entity", 1, 2), ("entity", 2, 1)}
