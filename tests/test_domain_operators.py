"""Scores, links, edges, candidates, rules and events on small hand-made tables, with nulls, repeats and empty tables."""

from pyspark.sql import functions as F

from factloom.operators import blocks, classify, edges, events, relations
from factloom.operators import verification as v

CLAIM = "id long, content_item_id long, source_id long, claim_text string, claim_type string, status string, published_at string"


def claims(spark, rows):
    return spark.createDataFrame([(i, c, s, t, k, st, p) for i, c, s, t, k, st, p in rows], CLAIM)


def world(spark):
    c = claims(spark, [
        (1, 10, 1, "Иванов Глеб подписал № 5-А", "vote", "unverified", "2024-03-10"), (2, 20, 2, "то же", "vote", "likely_false", "2024-03-01T10:00:00"),
        (3, 30, 3, None, "vote", "unverified", None), (4, 40, 1, "иное", "other", "confirmed", "вчера"),
    ])
    m = spark.createDataFrame([(7, 10), (7, 20), (7, 30), (8, 40), (9, 40)], "entity_id long, content_item_id long")
    s = spark.createDataFrame([(1, "media", "a", "A", 0), (2, "telegram", "b", "B", 0), (3, "official_site", None, "D", 1)], "id long, category string, political_alignment string, credibility_tier string, is_official int")
    i = spark.createDataFrame([(10, "article", 1, "2024-03-10", "t", "x № 5-А", "https://a.ex/1"), (20, "bill", 2, "2024-03-01", "t", "№ 5-А", "https://b.ex/1"), (30, "court_record", 3, None, None, None, None), (40, "article", 1, "2020", "", "", "bad")], "id long, content_type string, source_id long, published_at string, title string, body_text string, url string")
    return c, m, s, i


def by_id(df, *columns):
    return {r.id: (tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]) for r in df.collect()}


def test_claim_scores(spark):
    c, m, s, i = world(spark)
    assert by_id(v.corroboration(c, m, s), "score", "n_sources") == {1: (0.5, 2), 2: (0.5, 2), 3: (0.7, 2), 4: (0.0, 0)}
    k = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "id long, cluster long")
    assert by_id(v.corroboration(c, m, s, k), "score")[1] == 0.6
    links = spark.createDataFrame([(1, 20), (1, 30), (2, 10), (None, 10)], "claim_id long, evidence_item_id long")
    assert by_id(v.temporal_consistency(c, links, i), "score") == {1: 0.8, 2: 0.4, 3: 0.5, 4: 0.5}
    people = spark.createDataFrame([("Иванов Глеб Львович",), ("Иванов Глеб Львович",)], "name string")
    records = i.select("id", F.col("body_text").alias("text"))
    got = by_id(v.entity_verification(c, people, records, r"№ (\d+-[А-Я])"), "checks", "verified", "score")
    assert got[1] == (2, 2, 1.0) and got[3] == (0, 0, 0.3)
    q = spark.createDataFrame([(10, True)] * 5 + [(20, False)], "content_item_id long, flagged boolean")
    t = spark.createDataFrame([(10, "m"), (20, "f"), (10, None)], "content_item_id long, tag string")
    assert by_id(v.rhetoric_risk(c, s, q, t, ["a"], ["m"], ["f"]), "score") == {1: 0.7, 2: 0.15, 3: 0.0, 4: 0.2}
    r = spark.createDataFrame([(7, 8, "contradicts"), (8, 9, "other")], "a long, b long, relation_type string")
    assert by_id(v.contradiction_penalty(c, m, r), "score") == {1: 0.25, 2: 0.1, 3: 0.25, 4: 0.1}
    none = c.limit(0)
    assert v.corroboration(none, m, s).count() == v.temporal_consistency(none, links, i).count() == v.contradiction_penalty(none, m, r).count() == 0


def test_authenticity_and_override(spark):
    f = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 0.8, 1.0, 0.0, 0.0), (2, 0.1, 0.0, 0.19, 0.5, 0.3, 0.71, 0.0)], "id long, source double, document double, corroboration double, temporal double, entity double, rhetoric double, contradiction double")
    got = by_id(v.authenticity(f), "authenticity", "consistency", "status")
    assert got[1] == (0.83, 0.91, "confirmed") and got[2][2] == "manipulation"
    old = claims(spark, [(1, 1, 1, "", "", "confirmed", None), (2, 1, 1, "", "", None, None)])
    assert [tuple(r) for r in v.status_changes(old, v.authenticity(f)).collect()] == [(2, None, "manipulation")]


def test_links(spark):
    c, m, s, i = world(spark)
    known = spark.createDataFrame([(1, 30)], "claim_id long, evidence_item_id long")
    open_ = c.filter("status = 'unverified'")
    got = {(r.claim_id, r.evidence_item_id): (r.evidence_type, r.strength, r.score, r.rank) for r in v.autolinks(open_, m, i, s, known).collect()}
    assert got == {(1, 20): ("legislative_document", "moderate", 4.0, 2), (3, 20): ("legislative_document", "moderate", 4.0, 1), (3, 10): ("official_document", "weak", 1.5, 2)}
    official = {(r.claim_id, r.evidence_item_id): r.evidence_class for r in v.official_links(i, open_, m, known).collect()}
    assert official == {(1, 20): "hard", (3, 20): "hard"}
    l = spark.createDataFrame([(1, 1, 20, "co_entity", "hard", "weak"), (2, 1, 40, "article", None, "weak"), (3, 2, 99, None, "hard", None)], "id long, claim_id long, evidence_item_id long, evidence_type string, evidence_class string, strength string")
    assert by_id(v.backfilled_classes(l, i, s), "new_class", "changed") == {1: ("seed", True), 2: ("support", True), 3: ("support", True)}
    e = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (4, "a")], "claim_id long, evidence string")
    assert by_id(v.reverified(c, [e]), "links", "status") == {1: (3, "likely_true"), 2: (0, "likely_false"), 3: (0, "unverified"), 4: (1, "partially_confirmed")}


def test_a_hot_entity_costs_sets(spark):
    m = spark.createDataFrame([(1, i) for i in range(400)] + [(2, 5), (2, 6)], "entity_id long, content_item_id long")
    have = spark.createDataFrame([(i, "x") for i in range(400)], "content_item_id long, kind string")
    asked = spark.createDataFrame([(i, i) for i in range(400)], "id long, content_item_id long")
    got = v.best_sharing(asked, have, m, lambda: [F.col("shared").desc(), F.col("content_item_id")], 3).collect()
    best = {i: [r.content_item_id for r in sorted((r for r in got if r.id == i), key=lambda r: r["rank"])] for i in (0, 5, 399)}
    assert len(got) == 1200 and best == {0: [1, 2, 3], 5: [6, 0, 1], 399: [0, 1, 2]}


def test_alike_by_prefix_filter(spark):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("мост река район дом лес снег год два три акт".split()) for _ in range(rng.randint(2, 5))), "ab"[i % 2]) for i in range(90)] + [(200, None, "a"), (201, "", "a")]
    d = spark.createDataFrame(rows, "id long, text string, kind string")
    kind = {r[0]: r[2] for r in rows}
    n = blocks.neighbours(d.fillna("").select("id", "text"), threshold=0.7, k=1000)
    want = {(r.id, r.neighbour) for r in n.collect() if r.id < r.neighbour and kind[r.id] == kind[r.neighbour]}
    assert {(r.id, r.neighbour) for r in blocks.alike(d.fillna(""), 0.7).collect()} == want and want


def test_edges_and_investigation(spark):
    p = spark.createDataFrame([(501, 1, "11"), (501, 2, "1-1"), (501, 1, "11"), (502, None, "x"), (503, 3, None)], "contract_id long, entity_id long, inn string")
    e = edges.merged(edges.contract_edges(p))
    got = {(r.src, r.dst, r.relation_type): r.merged for r in e.collect()}
    assert got[("entity:1", "contract:501", "government_contract")] == 1 and ("entity:1", "entity:2", "same_inn") in got and ("entity:3", "contract:503", "government_contract") in got
    seed = spark.createDataFrame([("entity:1",)], "node string")
    found = edges.investigation(e, seed, 2)
    assert {(r.src, r.dst, r.hop) for r in found.collect()} >= {("entity:1", "contract:501", 1), ("entity:1", "entity:2", 1), ("contract:501", "entity:2", 2)}
    assert {(r.what, r.name): r.n for r in edges.statistics(found).collect()}[("node", "contract")] == 1
    assert edges.investigation(e, seed, 3, most_nodes=2, most_edges=1).count() == 1
    assert edges.investigation(e, seed.limit(0)).count() == 0


def test_candidates(spark):
    s = spark.createDataFrame([(1, "media", None), (2, "telegram", None)], "id long, category string, political_alignment string")
    i = spark.createDataFrame([(101, 1, "https://a.ex/1", "2024-01-01", "t", "b"), (102, 1, "https://a.ex/2", None, None, None), (103, 2, "https://b.ex/1", "2024-01-20", "t", "b")], "id long, source_id long, url string, published_at string, title string, body_text string")
    m = spark.createDataFrame([(x, d) for x in (1, 2) for d in (101, 102, 103)] + [(3, 101), (3, 102), (1, 101)], "entity_id long, content_item_id long")
    pairs = relations.wide_pairs({"contract": spark.createDataFrame([(2, 1, 1)], "a long, b long, shared long"), "mention": spark.createDataFrame([(1, 2, 3), (1, 3, 2)], "a long, b long, shared long"), "bill": spark.createDataFrame([], "a long, b long, shared long"), "restriction": spark.createDataFrame([], "a long, b long, shared long"), "vote": spark.createDataFrame([], "a long, b long, shared long")})
    got = {(r.a, r.b): r for r in relations.base_score(relations.support(pairs, m, i, s)).collect()}
    assert (got[1, 2]["items"], got[1, 2].sources, got[1, 2].domains, got[1, 2].contract) == (3, 2, 2, 1)
    assert (got[1, 3]["items"], got[1, 3].sources, got[1, 3].contract) == (2, 1, None) and got[1, 2].score > got[1, 3].score
    assert {(r.a, r.b): r.path for r in relations.explained(pairs, ["contract", "bill", "mention"]).collect()} == {(1, 2): "contract>mention", (1, 3): "mention"}
    known = spark.createDataFrame([(2, 1)], "a long, b long")
    assert [(r.a, r.b) for r in relations.without_known(pairs, known).collect()] == [(1, 3)]
    r = spark.createDataFrame([("e", 1, "issuer"), ("e", 2, "target"), ("e", 2, "issuer"), ("e", None, "target"), ("f", 3, "target")], "g string, m long, r string")
    assert [tuple(x) for x in relations.role_pairs(r, "g", "m", "r", ["issuer"], ["target"]).collect()] == [("e", 1, 2)]
    o = spark.createDataFrame([(1, "А", "7-7"), (2, "Б", "8"), (3, "Б", "9")], "id long, canonical_name string, inn string")
    p = spark.createDataFrame([(1, 5, "Б", None, "77"), (1, 5, "Б", None, "77"), (2, 5, "А", None, ""), (3, 5, "Б", None, None)], "id long, contract_id long, party_name string, party_role string, inn string")
    assert by_id(relations.normalized_parties(p, o), "entity_id", "by_what") == {1: (1, "inn"), 2: (1, "name"), 3: (None, "none")}


def test_rules(spark):
    d = spark.createDataFrame([(1, "Депутат не воровал, но воровал мост"), (2, "примостился"), (3, None), (4, "")], "id long, text string")
    got = {(r.id, r.tag): r.score for r in classify.context_scores(d, [("b", [("мост", 2.0)], 2.0)], ["депутат"], [("b", ["воровал"], 3.0, True), ("n", ["примос"], 1.0, False)]).collect()}
    assert got == {(1, "b"): 5.0, (2, "n"): 1.0}
    assert [tuple(r) for r in classify.granular_tags(d, [("k", "x", ["мост"]), ("k", "y", ["воровал"]), ("r", "z", ["депутат"])], {"k": 1, "r": 2}).collect()] == [(1, "k", "x"), (1, "r", "z")]
    assert by_id(classify.negations(d, "воровал", ["не "]), "hits", "negated") == {1: (2, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0)}
    votes = spark.createDataFrame([(1, "school", "bill", 0.8, False), (1, "school", None, 0.8, False), (1, "vote", "bill", 0.6, False)], "id long, tag string, kind string, confidence double, has_context boolean")
    final = {r.tag: r.votes for r in classify.final_tags(classify.guarded_votes(votes, ["bill"], ["school"])).collect()}
    assert final == {"school": 1, "vote": 1}
    assert by_id(classify.signals(d, [("theft", [("воровал", 4.0)]), ("x", [("мост", 1.0)])]), "total", "categories")[1] == (5.0, "theft")
    assert by_id(classify.search_terms(spark.createDataFrame([(1, "«Мост» и «мост», «Река долгая»"), (2, None)], "id long, text string"), ["«([^»]+)»"]), "terms") == {1: "Мост|Река долгая", 2: ""}
    refs = classify.references(spark.createDataFrame([(1, "в законе № 5-А и № 5-А сказано"), (2, None)], "id long, text string"), [("law", r"№ (\d+-[А-Я])")]).collect()
    assert [(r.id, r.number, r.context) for r in refs] == [(1, "5-А", "в законе № 5-А и № 5-А сказано")]


def test_events(spark):
    i = spark.createDataFrame([(11, "пост", "post", "2024-04-20"), (12, " Указ ", "bill", "2024-04-21"), (13, None, "post", None), (14, None, "post", None)], "id long, title string, content_type string, published_at string")
    members = spark.createDataFrame([(12, 11), (11, 11)], "id long, canonical_id long")
    g = events.groups(members, i, [spark.createDataFrame([(13,), (11,)], "id long")])
    assert {(r.event, r.id) for r in g.collect()} == {(11, 11), (11, 12), (13, 13)}
    c = claims(spark, [(1, 12, 1, "x", "vote", "u", None)])
    got = {r.event: tuple(r)[1:] for r in events.summary(g, i, c, ["bill"]).collect()}
    assert got == {11: (2, 1, "2024-04-20", "2024-04-21", "пост", "vote"), 13: (1, 0, None, None, "", "event")}
    tags = spark.createDataFrame([(11, "a", 0.2), (12, "a", 0.3), (13, "b", 0.99)], "id long, tag string, confidence double")
    assert {(r.event, r.fact): r.confidence for r in events.facts(g, tags, i, ["bill"]).collect()} == {(11, "a"): 0.82, (13, "b"): 0.95}
    old, new = events.derivations(i, "s", ["title"]), events.derivations(i.withColumn("title", F.when(F.col("id") == 13, "x").otherwise(F.col("title"))), "s", ["title"])
    assert [tuple(r) for r in events.stale(old, new).collect()] == [(13, "s")]
