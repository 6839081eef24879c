import datetime as dt

from pyspark.sql import functions as F

from factloom.functions import scores, text
from factloom.operators import graph, quality, relational, search, similarity
from factloom.sources import files
from factloom.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalar_functions(spark):
    lit = F.lit
    assert one(spark, text.normalize_text(lit("  Ёлка https://a.b/c  и лес! "))) == "елка и лес"
    assert one(spark, text.normalize_text(lit(None).cast("string"))) == ""
    assert one(spark, text.slugify(lit("!!!"))) == "item"
    assert one(spark, text.parse_money(lit("1.234,50 руб"))) == 1234.5
    assert one(spark, text.parse_money(lit("1,234.50"))) == 1234.5
    assert one(spark, text.parse_money(lit("12,5 млн"))) == 12.5
    assert one(spark, text.parse_money(lit("нет"))) is None
    assert one(spark, text.normalized_domain(lit("www.A.example/x"))) == "a.example"
    assert one(spark, text.normalized_domain(lit("source:5"))) is None
    assert one(spark, text.source_host(lit("HTTP://A.B:80/c"))) == "a.b:80"
    assert one(spark, text.parse_date(lit("2024-05-01"))) == dt.datetime(2024, 5, 1)
    assert one(spark, text.parse_date(lit("май"))) is None
    assert one(spark, text.normalized_tag(lit("a/b:c"))) == "b:c"
    assert one(spark, text.canonical_claim(lit("«Мост построен» вовремя!"))) == "мост построен вовремя"
    assert one(spark, text.canonical_claim(lit("два слова"))) is None
    assert one(spark, text.first_sentence(lit("Раз. Два."))) == "Раз."
    assert one(spark, text.negated(lit("он никогда не воровал"), "воровал", ("не ",))) is True
    assert one(spark, text.negated(lit("не он и никто другой точно воровал"), "воровал", ("не ",))) is False
    assert one(spark, text.nfkc(lit("ﬁ"))) == "fi"
    assert one(spark, text.normalize_text(lit("Ｆｕｌｌ ﬁ № 5\u00a0½"))) == "full fi no 5 1 2"
    assert one(spark, text.normalized_domain(lit("http://[::1]:80/x"))) == "[::1]:80"
    assert one(spark, text.normalized_domain(lit("10.0.0.1/x"))) == "10.0.0.1"


def test_scores(spark):
    lit = F.lit
    for days, n, want in [(0, 0, 0.4), (0, 1, 0.7), (30, 2, 1.0), (31, 2, 0.85), (180, 2, 0.7), (365, 2, 0.5), (366, 2, 0.25)]:
        assert one(spark, scores.temporal_spread(lit(days), lit(n))) == want
    assert one(spark, scores.calibrated(lit(0.55), lit(1))) == 0.5
    assert one(spark, scores.calibrated(lit(0.55), lit(2))) == 0.55
    assert one(spark, scores.source_credibility(lit("B"), lit(True), lit(True))) == 0.9
    assert one(spark, scores.source_credibility(lit("A"), lit(True), lit(True))) == 1.0
    assert [one(spark, scores.banded(lit(x), scores.STATUS, "disproved")) for x in (0.8, 0.79, 0.2, 0.19, 0.09)] == ["confirmed", "likely_true", "unverified", "likely_false", "disproved"]
    assert one(spark, scores.jaccard(F.array(lit(1), lit(2)), F.array(lit(2), lit(3)))) == 0.3333


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k long, v string")
    assert {(r.k, r.v) for r in relational.upsert(old, new, ["k"], [F.col("v").desc()]).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert sorted(r.k for r in relational.insert_missing(old, new, ["k"]).collect()) == [1, 2, 3]
    assert relational.replace_derived(old, new, F.col("v") == "b").count() == 4
    e = spark.createDataFrame([(1, "А"), (2, "Б"), (3, None)], "id long, canonical_name string")
    m = spark.createDataFrame([(2, 1), (3, 1)], "from_id long, to_id long")
    assert [tuple(r) for r in relational.merged_aliases(e, m).collect()] == [(1, "Б")]


def test_vote_agreement_limits(spark):
    def rows(shared, same):
        return [(s, 1, "y") for s in range(shared)] + [(s, 2, "y" if s < same else "n") for s in range(shared)]

    for shared, same, want in [(20, 20, 1), (19, 19, 0), (20, 19, 0), (27, 20, 0), (26, 20, 1)]:
        v = spark.createDataFrame(rows(shared, same), "session long, voter long, vote string")
        assert relational.agreement(v, "session", "voter", "vote").count() == want


def test_pairs_leave_out_large_groups_and_nulls(spark):
    m = spark.createDataFrame([("g", 1), ("g", 1), ("g", 2), ("h", 1), ("h", 2), ("h", 3), (None, 4), ("g", None)], "g string, m long")
    assert {(r.g, r.a, r.b) for r in relational.member_pairs(m, "g", "m", 2).collect()} == {("g", 1, 2)}
    assert {(r.a, r.b, r.shared) for r in relational.shared_groups(m, "g", "m", 2).collect()} == {(1, 2, 2)}


def test_samples_and_drift(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2] if i < 8 else None) for i in range(10)], "i long, g string")
    assert [(r.g, r.i) for r in relational.round_robin(d, "g", [F.col("i")], 4).collect()] == [("a", 0), ("b", 1), (None, 8), ("a", 2)]
    got = relational.quota_sample(d, "g", "i", {"a": 2}, 5, "s").collect()
    assert len(got) == 5 and sum(r.by_quota for r in got) == 2
    n = lambda rows: spark.createDataFrame(rows, "l string, n long")
    assert relational.total_variation(n([("a", 3)]), n([("b", 3)]), "l", "n").first().distance == 1.0
    assert relational.total_variation(n([("a", 2), ("b", 2)]), n([("a", 3), ("b", 1)]), "l", "n").first().distance == 0.25
    assert relational.total_variation(n([]), n([]), "l", "n").first().distance == 0.0


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.5), (7, 8, 1.0), (8, 9, 1.0), (9, 7, 1.0), (5, 5, 1.0)], "a long, b long, w double")
    got = {r.id: r.component for r in graph.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in graph.components(path).collect()} == {0}
    seed = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.hop for r in graph.hops(e, seed, "a", "b", 2).collect()} == {1: 0, 2: 1, 3: 2}
    assert graph.hops(e, seed, "a", "b", 3, max_nodes=2).count() == 2
    best = graph.chains(e, seed, "a", "b", "w").orderBy("rank").collect()
    assert [list(r.path) for r in best] == [[1, 2], [1, 2, 3], [1, 2, 3, 4]]


def test_similarity_search_and_quality(spark):
    d = spark.createDataFrame([(1, "мост через реку построен"), (2, "мост через реку построен снова"), (3, "совсем другой текст"), (4, None), (5, "")], "id long, text string")
    assert {(r.id, r.neighbour) for r in similarity.neighbours(d.filter("text is not null")).collect()} == {(1, 2), (2, 1)}
    assert [r.id for r in search.bm25(d, "мост снова").collect()] == [2]
    p = spark.createDataFrame([(1, "Через реку"), (2, "нет такого")], "term_id long, phrase string")
    assert {(r.term_id, r.id) for r in search.containing(p, d.filter("text is not null")).collect()} == {(1, 1), (1, 2)}
    tags = quality.rule_scores(d, [("bridge", [("мост", 2.0)], 2.0), ("text", [("текст", 1.0)], 2.0)])
    assert {(r.id, r.tag) for r in tags.collect()} == {(1, "bridge"), (2, "bridge")}
    stem = quality.rule_scores(spark.createDataFrame([(1, "примост"), (2, "мостик")], "id long, text string"), [("b", [("мост", 1.0)], 1.0)])
    assert [r.id for r in stem.collect()] == [2]
    v = spark.createDataFrame([(1, "a", "support", 0.5), (1, "a", "support", 0.7), (1, "a", "abstain", 0.1)], "id long, tag string, vote string, confidence double")
    r = quality.voted(v).first()
    assert (round(r.confidence, 6), r.votes) == (0.6, 2)
    g = {r.check: r.ok for r in quality.gate(d, {"empty": (F.count_if(F.coalesce(F.col("text"), F.lit("")) == ""), 1)}).collect()}
    assert g == {"empty": False}


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", None), (2, 'b"; c', "x")], "id long, note string, verdict string")
    files.export_review_pack(d, f"{tmp_path}/pack", ["id", "note", "verdict"])
    back = files.import_review_pack(spark, f"{tmp_path}/pack", d.withColumn("verdict", F.lit("old")), "id", ["verdict"])
    assert {r.id: (r.note, r.verdict) for r in back.collect()} == {1: ("a", "old"), 2: ('b"; c', "x")}
    files.write_notes(files.notes(d, "note", "verdict"), f"{tmp_path}/vault")
    assert len(list((tmp_path / "vault").glob("*.md"))) == 2
    path = files.write_snapshot({"t": d}, f"{tmp_path}/snapshots", "v1")
    assert '\\"t\\": 2' in "".join(p.read_text() for p in (tmp_path / "snapshots/v1/_manifest").glob("*.json")) and path.endswith("v1")
    (tmp_path / "in").mkdir()
    for name, body in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        (tmp_path / "in" / name).write_bytes(body)
    known = spark.createDataFrame([], "sha256 string")
    assert files.new_files(files.binary_files(spark, f"{tmp_path}/in"), known).count() == 2
    (tmp_path / "j.json").write_text('{"a": 1}\n{broken\n')
    good, bad = files.split_dead_letters(files.landed_json(spark, f"{tmp_path}/j.json", "a int").cache())
    assert (good.count(), bad.count()) == (1, 1)
    assert one(spark, files.html_text(F.lit("<p>a<script>x</script> b</p>"))) == "a b"
    (tmp_path / "f.xml").write_text("<rss><item><guid>g</guid><title>t</title><link>l</link><pubDate>p</pubDate></item></rss>")
    (tmp_path / "g.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title>u</title><link href="m"/><updated></updated><created>c</created></entry></feed>')
    assert files.feed_items(spark, f"{tmp_path}/f.xml").first().published == "p"
    assert [(r.link, r.published) for r in files.feed_items(spark, f"{tmp_path}/g.xml").collect()] == [("m", "c")]
    (tmp_path / "v.json").write_text('{"bill_number": "1", "vote_date": "2024-02-01", "deputy_name": "a", "vote_result": "за"}\n{"bill_number": "1", "vote_date": "2024-02-01", "deputy_name": "a", "vote_result": "за"}\n{"bill_number": "0", "vote_date": "2023-01-01", "deputy_name": "b"}\nbad\n')
    rows, dead = files.landed(spark, f"{tmp_path}/v.json", "votes", "2024-01-01", "vote_date")
    assert [(r.bill_number, r.vote_result) for r in rows.collect()] == [("1", "за")] and dead.count() == 1
    new, counts = files.scan_inbox(spark, f"{tmp_path}/in", known, {"pdf": "document"})
    assert new.count() == 0 and {r.route: (r.seen, r.new) for r in counts.collect()} == {"other": (3, 0)}
    pages = spark.createDataFrame([("c", '<div class="post"><time>t1</time><p>a <b>b</b></p></div><div class="post"><p>c</p></div>'), ("d", None)], "channel string, html string")
    got = files.html_rows(pages, '<div class="post">.*?</div>', {"at": "<time>(.*?)</time>", "text": "<p>(.*?)</p>"})
    assert [tuple(r) for r in got.collect()] == [("c", "t1", "a b"), ("c", "", "c")]


def test_streams(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string").write.parquet(src)
    read = lambda: spark.readStream.schema("k long, v string").parquet(src)
    windows.ingest(read(), out, ["k"], f"{tmp_path}/check").awaitTermination()
    spark.createDataFrame([(2, "d"), (3, "e")], "k long, v string").write.mode("append").parquet(src)
    windows.ingest(read(), out, ["k"], f"{tmp_path}/check").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, t, "a", 1.0), (1, t + dt.timedelta(minutes=10), "a", 2.0), (1, t + dt.timedelta(hours=2), "a", 3.0)], "user_id long, ts timestamp, event_type string, value double")
    assert sorted(r.n for r in windows.sessions(ev, "30 minutes").collect()) == [1, 2]
    assert sorted(r.n for r in windows.tumbling(ev, "1 hour").collect()) == [1, 2]
    ev.write.parquet(f"{tmp_path}/ev")
    q = windows.once(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev"), ["user_id", "event_type"], "ts", "1 day").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 1
