import pytest

from factloom.llm import names

ENTITIES = [
    (1, True, "Жимолостенский-Грушевцев Леонид Юрьевич", "депутат, фракция «Новый уклад»"),
    (2, True, "Журавенков Владимир Михайлович", "депутат, фракция «Созидание»"),
    (3, True, "Журавенков Виктор Михайлович", "депутат, фракция «Земский союз»"),
    (4, True, "Журавенкова Тамара Игоревна", "депутат, фракция «Созидание»"),
    (5, True, "Хвощянов Пётр Фёдорович", "депутат, фракция «Созидание»"),
    (11, False, "ООО «Полевой ковчег»", "0012345678"),
    (12, False, "ЗАО «Полевой ковчег»", "0087654321"),
    (13, False, "Управление капитального строительства Верхнелужского района", "0019005285"),
    (14, False, "МБОУ «Школа № 8 Среднепесчанского района»", None),
    (15, False, "МБОУ «Школа № 9 Среднепесчанского района»", None),
    (16, False, "Администрация Белоковыльского района", None),
    (None, False, "ООО «Никто»", None),
    (17, None, "ООО «Никто»", None),
]
CASES = [
    (True, "ХВОЩЯНОВ П.Ф.", None, 5), (True, "Petr Fedorovich Khvoshchyanov", None, 5), (True, "Петя Хвощянов", "Созидание", 5), (True, "Хвошянов Петр Федорович", None, 5),
    (True, "деп. Хвощянов Пет. Фёд. (Созидание)", "Созидание", 5), (True, "Хвощянов Павел Фёдорович", None, None), (True, "Хвощянов И. Ф.", None, None),
    (True, "Журавенков В. М.", "Земский союз", 3), (True, "В.М. Журавенков", "Созидание", 2), (True, "Журавенков В.М.", None, None), (True, "Журавенкова Т.", "Созидание", 4),
    (True, "Журавенков Т. И.", "Созидание", None), (True, "Жимолостенский – Грушевцев Л.Ю.", None, 1), (True, "Жимолостенский Леонид Юрьевич", None, 1), (True, "Жимолостенский Грушевцев Леонид Юрьевич", None, 1),
    (True, "", None, None), (True, None, None, None), (True, "()", None, None), (True, "Журавенков " * 3000, None, None),
    (False, "Общество  с ограниченной ответственностью “Полевой Ковчег”", None, 11), (False, "«Плоевой ковчег» (ЗАО)", None, 12), (False, "Полевой ковчег", None, None),
    (False, "Полевой ковчег", "87654321", 12), (False, "З.А.О. Полевой ковчег", "0012345678", None), (False, "OOO Polevoy kovcheg", "ИНН 0012345678.0", 11), (False, "ПАО Полевой ковчег", None, None),
    (False, "УКС Верхнелужского р-на", None, 13), (False, "Верхнелужского района управление капитального строительства", None, 13), (False, "Управление капитального строительства", None, None),
    (False, "Школа № 8 Среднепесчанского района, МБОУ", None, 14), (False, "МБОУ Школа № 7 Среднепесчанского района", None, None), (False, "  Адм.  Белоковыльского района", None, 16),
    (False, "ИП Пётр Хвощянов", None, None),
]


def test_cases(spark):
    e = spark.createDataFrame([(*x, 1) for x in ENTITIES], "id long, person boolean, name string, hint string, entity_id int")
    n = spark.createDataFrame([(*x[:3], "k") for x in CASES] + [(*CASES[0][:3], "k")], "person boolean, name string, hint string, key string")
    got = {(r.person, r.name, r.hint): r.entity_id for r in names.link(n, e).collect()}
    assert {c[:3]: got.get(c[:3]) for c in CASES} == {c[:3]: c[3] for c in CASES}


def test_empty(spark):
    e = spark.createDataFrame([x for x in ENTITIES if x[1] is not None], "id long, person boolean, name string, hint string")
    n = spark.createDataFrame([(True, "Хвощянов П.Ф.", None)], "person boolean, name string, hint string")
    assert names.link(n.limit(0), e).count() == 0
    assert names.link(n, e.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("", "аб", 2), ("мост", "мсот", 1), ("мост", "мотс", 1), ("мост", "мосты", 1), ("кот", "кит", 1), ("аб", "ба", 1)])
def test_edit_distance(a, b, d):
    assert names.edit_distance(a, b) == d


def test_token_join_loses_no_similar_token(spark):
    import itertools
    import random

    rng = random.Random(4)
    own = ["".join(rng.choices("абвгд", k=rng.randint(3, 9))) for _ in range(40)]
    typed = list({"".join(t[:i] + [rng.choice("абвгд")] + t[i + 1 :]) for t in map(list, own) for i in (rng.randrange(len(t)),)} | set(own))
    pairs = names.similar_tokens(spark.createDataFrame([(t,) for t in typed], "token string"), spark.createDataFrame([(t, t) for t in own], "token string, form string"))
    got = {(r.typed, r.own) for r in pairs.collect()}

    def grams(t):
        t = f"^{t}$"
        return {t[i : i + 2] for i in range(len(t) - 1)}

    want = {(a, b) for a, b in itertools.product(typed, set(own)) if names.same_token(a, b) > 0 and len(grams(a) & grams(b)) >= names.GRAMS * len(grams(a) | grams(b))}
    assert want <= got and all(names.same_token(a, b) > 0 for a, b in got)


def test_another_lexicon(spark):
    n = spark.createDataFrame([(True, "Капитан Бобби Смит", None), (True, "Бобби Смит", None)], "person boolean, name string, hint string")
    e = spark.createDataFrame([(1, True, "Смит Роберт", None), (2, True, "Джонс Роберт", None)], "id long, person boolean, name string, hint string")
    assert names.link(n, e).count() == 0
    own = names.Lexicon(titles=frozenset({"капитан"}), nicknames={"роберт": "бобби боб"})
    assert {(r.name, r.entity_id) for r in names.link(n, e, own).collect()} == {("Капитан Бобби Смит", 1), ("Бобби Смит", 1)}
