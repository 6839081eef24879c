import pytest
from pyspark.sql import functions as F

from factloom.operators import extraction, graph, relational


def test_sentences_and_identifiers(spark):
    d = spark.createDataFrame([(1, "За проект проголосовали 300 депутатов. Короткое. За проект проголосовали 300 депутатов."), (2, None), (3, "")], "id long, text string")
    got = extraction.typed_sentences(d, [("vote", "проголосовали"), ("other", "нет такого")])
    assert [(r.id, r.kind, r.sentence) for r in got.collect()] == [(1, "vote", "За проект проголосовали 300 депутатов.")]
    assert [(r.id, r.kind, r.value) for r in extraction.identifiers(d, [("n", r"(\d+)")]).collect()] == [(1, "n", "300")]


def test_json_members(spark):
    d = spark.createDataFrame([(1, "[1, 21]"), (2, "x"), (3, None), (4, "[]")], "id long, entity_ids string")
    assert [(r.id, r.member) for r in extraction.json_members(d, "id", "entity_ids").collect()] == [(1, 1), (1, 21)]


def test_event_groups_and_first_of(spark):
    d = spark.createDataFrame([("g", 1, True), ("g", 2, False), ("g", 3, None), ("h", 1, True)], "g string, t long, o boolean")
    got = {(r.g, r.t): (r.sort_order, r.role) for r in extraction.event_groups(d, "g", F.col("o"), ["t"]).collect()}
    assert got == {("g", 1): (0, "official_doc"), ("g", 2): (1, "origin"), ("g", 3): (2, "update"), ("h", 1): (0, "official_doc")}
    first = d.groupBy("g").agg(extraction.first_of(F.col("t"), ~F.coalesce("o", F.lit(False)), F.col("t")).alias("x"))
    assert {r.g: r.x for r in first.collect()} == {"g": 2, "h": None}


def test_sequence_ratio(spark):
    r = spark.createDataFrame([("abcd", "bcde"), (None, "")], "a string, b string").select(extraction.sequence_ratio("a", "b").alias("x")).collect()
    assert [round(x.x, 4) for x in r] == [0.75, 1.0]


def test_communities(spark):
    clique = lambda ids: [(i, j) for i in ids for j in ids if i < j]
    e = spark.createDataFrame(clique([1, 2, 3, 4]) + clique([11, 12, 13, 14]) + [(4, 11)], "a long, b long")
    assert {r.id: r.community for r in graph.communities(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 11: 11, 12: 11, 13: 11, 14: 11}
    assert {r.id: r.community for r in graph.greedy_communities(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 11: 11, 12: 11, 13: 11, 14: 11}
    with pytest.raises(ValueError):
        graph.greedy_communities(e, most_nodes=3)
    assert graph.communities(e.limit(0)).count() == 0


def test_numbered_over_parts(spark):
    rows = [("hot", i) for i in range(500)] + [("b", 3), ("b", 1), (None, 7), (None, 5)]
    d = spark.createDataFrame(rows, "g string, i long")
    got = {(r.g, r.i): r.position for r in relational.numbered(d, "g", ["i"]).collect()}
    assert got == {**{("hot", i): i for i in range(500)}, ("b", 1): 0, ("b", 3): 1, (None, 5): 0, (None, 7): 1}
