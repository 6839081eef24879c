import random

import __spark_entry__
from factloom.operators import blocks, search


def test_a_batch_of_searches_gives_what_each_gives(spark):
    rng = random.Random(3)
    words = "мост река район дом лес снег год".split()
    d = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(80)] + [(90, None), (91, "")], "id long, text string")
    asked = {1: "Мост река", 2: "дом", 3: "лес, лес снег год", 4: "мост нигде", 5: "..."}
    want = {(q, r.id, r.score) for q, t in asked.items() if q != 5 for r in search.bm25(d, t, 6).collect()}
    q = spark.createDataFrame([*asked.items(), (6, None)], "query_id long, text string")
    got = blocks.searches(d, q, 6, most_queries=2).collect()
    assert {(r.query_id, r.id, r.score) for r in got} == want and {r[0] for r in want} == {1, 2, 3}
    assert max(r.rank for r in got) == 6


def test_every_twentieth_item_is_a_search(spark, tmp_path):
    items = [(20, "Мост", "x"), (21, "Старый мост", "y"), (40, None, "лес"), (41, "Лес", None), (60, None, None)]
    spark.createDataFrame(items, "id long, title string, body_text string").write.parquet(f"{tmp_path}/content_items.parquet")
    got = __spark_entry__.queries()["bm25_search_all"](spark, str(tmp_path))
    assert {(r.query_id, r.id) for r in got.collect()} == {(20, 20), (20, 21), (40, 40), (40, 41)}
