import random

import pytest

from factloom.llm import ocr

WORDS = {"проект": 50, "решения": 40, "о": 200, "района": 80, "строительстве": 40, "северо-западный": 9, "северо": 9, "западный": 9, "из-за": 20, "из": 90, "за": 90, "северозапад": 1, "принят": 30, "мостов": 20, "один": 30}
PAGE = ["Протокол заседания № 4", "[{n}]", "Проект ре-", "шения о строи-", "тельстве принят из-", "за северо-", "западный района.", "Приложение", "2014", "Итого 85"]
MISREAD = ["рaйона", "райо6на", "райопа", "пpоект", "решенйя0", "решепия", "пр0ект", "l4"]
RIGHT = ["района", "GosPult", "743-К", "2014", "неизвестное", "Covid-19", "12а", "Ясеневулин"]
PAGES = [x.format(n=n) for n in (6, 7, 8) for x in PAGE]
ACROSS = ["МАЛЫЙ РАЙ0Н", "проект ре¬", "Экз. № 1", "стр. 7", "\x0c", "МАЛЫЙ РАЙОН", "шения принят", "Эк3. № 1", "стp. 8"]
BODY = ["проект решения о строительстве"] * 9
COUNTED = ["24", *BODY, "2006", "25", *BODY, "2007", "26", *BODY]
TEXT = "\n".join(x.format(n=n) for n in (6, 7) for x in PAGE[:7])
SCHEMA = "id long, ocr_text string, k string"


def library():
    """Scans that make the vocabulary, and some whose running lines the others learn from."""
    words = [w for w, n in WORDS.items() for _ in range(n)]
    out = ["\n".join(f"и {w} и." for w in words)]
    for head in ("Экз. № {}", "МАЛЫЙ РАЙОН", "Протокол заседания № {}"):
        out += ["\n".join(f"{head.format(i)}\nстр. {n}\nпроект решения принят.\nНовая Строка Текста\nИтого {n}\nПриложение\nпроект решения." for n in (3, 4, 5)) for i in range(1, 8)]
    return out


@pytest.fixture(scope="module")
def found(spark):
    texts = {"pages": PAGES, "across": ACROSS, "counted": COUNTED, "cut": ["проект ре-", "шепия принят"], "cut2": ["проект рe-", "шения принят"]}
    texts |= {w: [f"один {w} мостов"] for w in MISREAD + RIGHT}
    rows = [(i, "\n".join(t), "x") for i, t in enumerate(texts.values())] + [(1000 + i, t, "x") for i, t in enumerate(library())]
    names = dict(enumerate(texts))
    out = {n: [] for n in texts}
    for r in ocr.scan_noise(spark.createDataFrame(rows, SCHEMA)).collect():
        if r.attachment_id in names:
            out[names[r.attachment_id]].append((r.line_no, r.kind))
    return {n: sorted(x) for n, x in out.items()}


def lines(found, name, kind):
    return [x for x, k in found[name] if k == kind]


def test_pages(found):
    assert lines(found, "pages", "drop") == [1, 2, 11, 12, 21, 22]
    assert lines(found, "pages", "join") == [3, 4, 13, 14, 23, 24]
    assert lines(found, "pages", "char") == []


def test_join_across_pages_and_misread_furniture(found):
    assert lines(found, "across", "drop") == [1, 3, 4, 6, 8, 9]
    assert lines(found, "across", "join") == [2]


def test_bare_page_numbers_count_up(found):
    assert lines(found, "counted", "drop") == [1, 12, 23]


def test_misread_and_right_words(found):
    assert {w: found[w] for w in MISREAD} == {w: [(1, "char")] for w in MISREAD}
    assert {w: found[w] for w in RIGHT} == {w: [] for w in RIGHT}


def test_cut_word_counts_for_the_line_of_the_wrong_character(found):
    assert found["cut"] == [(1, "join"), (2, "char")]
    assert found["cut2"] == [(1, "char"), (1, "join")]


def test_headers_that_count_pages():
    pages = [x for n in (7, 8, 9) for x in [f"Вестник · том 3 {n}", *["строка текста и ещё"] * 20]]
    assert ocr.furniture(pages, {}) == {0, 21, 42}
    sections = [x for n, k in ((1, 9), (2, 40), (3, 15)) for x in [f"Статья {n}", *["строка текста и ещё"] * k]]
    assert ocr.furniture(sections, {}) == set()


def test_running_text(spark):
    rows = [(1, TEXT, "x")] + [(1000 + i, t, "x") for i, t in enumerate(library())]
    text = {r.attachment_id: r.text for r in ocr.running_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = "Проект решения о строительстве принят из-за северо-западный района."
    assert text[1] == f"{one} {one}"
    assert len(text) == len(rows)


def test_automaton_against_brute_force():
    rng = random.Random(6)
    words = {"".join(rng.choices("абв", k=rng.randint(1, 6))) for _ in range(120)}
    v = ocr.Trie(words)
    for _ in range(60):
        q = "".join(rng.choices("абвг", k=rng.randint(1, 6)))
        for most in (0, 1, 2):
            assert sorted(v.within(q, most)) == sorted(w for w in words if ocr.edit_distance(q, w, 9) <= most)


def test_neighbours_by_shards_are_complete(spark, monkeypatch):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("абв", k=rng.randint(3, 9))) for _ in range(150)})
    asked = sorted({"".join(rng.choices("абвг", k=rng.randint(3, 9))) for _ in range(60)} | set(words[:20]))
    want = {(s, c) for s in asked for c in words if s != c and ocr.edit_distance(s, c, 9) <= (1 if len(s) < 6 else 2)}
    for shard, block in ((100_000, 10_000), (40, 25)):
        monkeypatch.setattr(ocr, "SHARD", shard)
        monkeypatch.setattr(ocr, "ASKED", block)
        got = ocr.neighbours(spark.createDataFrame([(s, 1) for s in asked], "s string, n long"), spark.createDataFrame([(w, 9) for w in words], "entry string, n long")).collect()
        assert {(r.s, r.c) for r in got} == want and len(got) == len(want)


def test_rates_scale_with_counts():
    assert ocr.likely(2, 60, 1) and ocr.likely(20, 1200, 1)
    assert not ocr.likely(20, 100, 1) and not ocr.likely(200, 1000, 1)
    assert ocr.likely(1, 500, 2) and not ocr.likely(4, 500, 2)
    assert not ocr.too_many(3, 5.0) and ocr.too_many(10_000, 600.0)


def test_confusions_are_learned(spark):
    words = ["дорога", "города", "огород", "ограда", "опора", "просьба"]
    counts = [(w, 3000) for w in words] + [(w.replace("о", "ы", 1), 9) for w in words] + [("дорага", 2)]
    v = spark.createDataFrame(counts, "entry string, n long")
    near = ocr.neighbours(v.withColumnRenamed("entry", "s"), v)
    learned = ocr.learned_confusions(near, v) - set(ocr.MISREAD)
    assert learned == {("о", "ы")}


def test_tables(spark):
    text = "\n".join(["проект решения о строительстве района"] * 6 + ["райопа проект"])
    d = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "  \n", "x"), (None, text, "x"), (5, "слово " * 40_000, "x")], "id long, ocr_text string, kind string")
    assert {(r.attachment_id, r.line_no, r.kind) for r in ocr.scan_noise(d).collect()} == {(1, 7, "char")}
    assert {r.attachment_id for r in ocr.running_text(d).collect()} == {1, 4, 5}
    assert ocr.scan_noise(d.limit(0)).count() == 0
    assert ocr.running_text(d.limit(0)).count() == 0
