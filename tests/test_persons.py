from pyspark.sql import functions as F

from factloom.operators import persons


def test_case_forms(spark):
    rows = spark.createDataFrame([("иванов",), ("иванова",), ("заречный",), ("лужский",), ("мария",), ("анна",), ("глеб",), ("сергей",), ("дюма",)], "n string")
    got = {r.n: r.f for r in rows.select("n", persons.case_forms(F.col("n")).alias("f")).collect()}
    assert got["иванов"] == ["иванов", "иванова", "иванову", "ивановым", "иванове"]
    assert got["иванова"] == ["иванова", "ивановой", "иванову"]
    assert got["лужский"][1] == "лужского" and "глебом" in got["глеб"] and "марию" in got["мария"] and "сергея" in got["сергей"]


def test_found_in_texts(spark):
    p = spark.createDataFrame([(1, "Иванов Глеб Петрович"), (2, "Лужская Анна"), (3, "Лужская Анна Львовна"), (4, "Один"), (5, None)], "id long, name string")
    d = spark.createDataFrame([(10, "Слово Глеба Иванова и Глеба Иванова. Анну Лужскую"), (11, None), (12, "")], "id long, text string")
    assert [tuple(r) for r in persons.found_in_texts(d, p).collect()] == [(10, "Глеба Иванова", 1)]


def test_can_merge():
    for a, b, want in [
        ("Иванов Глеб", "Иванов Г.", True), ("Иванов Глеб", "Иванов Олег", False), ("Иванова Анна", "Иванов Анна", True), ("Иванов Глеб Петрович", "Иванов Глеб", True),
        ("Иванов Глеб Петрович", "Иванов Глеб Олегович", False), ("Ив Г", "Ивин Г", False), ("", "Иванов", False), ("Семёнов Пётр", "Семенов Петр", True),
    ]:
        assert persons.can_merge(a, b) is want and persons.can_merge(b, a) is want, (a, b)


def test_resolved(spark):
    rows = [(1, "Иванов Г.", 9, False), (2, "Иванов Глеб", 3, True), (3, "иванов  глеб", 1, None), (4, "Иванов Олег", 1, False), (5, "Иванов", 50, True), (6, None, 1, True)]
    d = spark.createDataFrame(rows, "id long, name string, mentions long, has_profile boolean")
    assert {r.id: r.primary_id for r in persons.resolved(d).collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5}
    assert persons.resolved(d.limit(0)).count() == 0
