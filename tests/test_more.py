from pyspark.sql import functions as F

from factloom.operators import external, search


def test_best_documents(spark):
    c = spark.createDataFrame([(1, 10, "Приказ № 5-А о реконструкции, Иван Петров"), (2, 11, None), (3, 12, "")], "id long, content_item_id long, text string")
    d = spark.createDataFrame([(10, "№ 5-А", True), (20, "№ 5-А о реконструкции", True), (21, "Иван Петров", False), (22, "реконструкции", True), (23, None, True)], "item long, text string, official boolean")
    got = [(r.id, r.item, r.score, r.reliable) for r in external.best_documents(c, d, r"№ (\d+-[А-Я])", r"([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+)", r"([а-яё]{9,})", 5).collect()]
    assert sorted(got) == [(1, 20, 8.5, True), (1, 21, 2.0, False)]
    assert external.best_documents(c, d.limit(0), "(a)", "(b)", "(c)", 5).count() == 0


def test_corroborating(spark):
    c = spark.createDataFrame([(1, 10, 1, "Да"), (2, 20, 2, "да"), (3, 30, 3, "нет"), (4, 40, 3, "иное"), (5, 50, 1, None)], "id long, content_item_id long, source_id long, claim_text string")
    m = spark.createDataFrame([(7, 10), (7, 30), (7, 40), (None, 50)], "entity_id long, content_item_id long")
    got = {(r.id, r.source_id): (r.way, r["item"]) for r in external.corroborating(c, m).collect()}
    assert got == {(1, 2): (1, 20), (2, 1): (1, 10), (1, 3): (2, 30), (3, 1): (2, 10), (4, 1): (2, 10)}


def test_by_variant(spark):
    o = spark.createDataFrame([(1, "Совет Лужского района"), (2, "Суд"), (3, "суд "), (4, None)], "id long, name string")
    r = spark.createDataFrame([(1, "СОВЕТ ЛУЖСКОГО Р-НА"), (2, "Суд"), (3, None)], "id long, name string")
    assert [tuple(x) for x in external.by_variant(r, o, [(" района$", " р-на")]).collect()] == [(1, 1)]


def test_search_page(spark):
    d = spark.createDataFrame([(i, f"мост {'река ' * i}") for i in range(1, 6)] + [(9, None), (10, "река")], "id long, text string")
    keep = d.filter("id != 5").select("id")
    got = search.page(d, keep, "Мост река", 2, 1, 3).orderBy("id").collect()
    assert len(got) == 2 and {r.total for r in got} == {4} and all(r.snippet.startswith("мост") for r in got)
    assert search.page(d, keep.limit(0), "мост").count() == 0
    assert search.bm25(d, "мост река", None).count() == 5 and [r.id for r in search.bm25(d, "мост река", 1).select("id").collect()] == [r.id for r in search.bm25(d, "мост река", None).orderBy(F.col("score").desc(), "id").limit(1).collect()]
