from factloom.operators import extraction


def test_long_sentences_differ_by_their_ends_and_show_the_match(spark):
    head, gap = "слово " * 130, "иное " * 100
    d = spark.createDataFrame([(1, f"{head}проголосовали {gap}за. {head}проголосовали {gap}против. {head}проголосовали {gap}ЗА.")], "id long, text string")
    got = extraction.typed_sentences(d, [("vote", "проголосовал(и|о)"), ("start", "^слово")]).collect()
    assert sorted(r.kind for r in got) == ["start", "start", "vote", "vote"]
    s = f"{head}проголосовали {gap}"
    at, n = len(head), len("проголосовали")
    assert {r.sentence for r in got if r.kind == "vote"} == {s[at - 260 : at + n + 360].strip()}
    assert {r.sentence for r in got if r.kind == "start"} == {s[: 5 + 360].strip()}
