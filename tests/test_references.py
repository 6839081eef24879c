import pytest

from factloom.operators.references import orphan_report, orphans


def ids(df):
    return sorted(r.id for r in df.collect())


def frames(spark):
    child = spark.createDataFrame(
        [(1, 10, "a"), (2, 10, None), (3, None, "b"), (4, None, None), (5, 99, "a"), (6, 10, "z"), (6, 10, "z"), (7, 99, None), (8, None, "z")], "id long, x long, y string"
    )
    parent = spark.createDataFrame([(10, "a", 1), (10, "a", 1), (20, "b", 2), (None, "c", 3)], "x long, y string, id long")
    return child, parent


@pytest.mark.parametrize(("match", "want"), [("simple", [5, 6, 6]), ("partial", [5, 6, 6, 7, 8]), ("full", [2, 3, 5, 6, 6, 7, 8])])
def test_match_semantics(spark, match, want):
    child, parent = frames(spark)
    assert ids(orphans(child, parent, ["x", "y"], ["x", "y"], match)) == want


def test_empty_tables_and_errors(spark):
    child, parent = frames(spark)
    assert ids(orphans(child, parent.limit(0), ["x"], ["x"])) == [1, 2, 5, 6, 6, 7]
    assert ids(orphans(child.limit(0), parent, ["x"], ["x"])) == []
    with pytest.raises(ValueError):
        orphans(child, parent, ["x"], ["x"], "loose")
    with pytest.raises(ValueError):
        orphans(child, parent, [], [])


def test_report_counts_rows_and_keys(spark):
    d = spark.createDataFrame([("t", "2024-01", 5), ("t", "2024-01", 5), ("t", None, 6)], "src_table string, month string, missing_id long")
    got = {(r.src_table, r.month): (r.orphan_rows, r.missing_keys) for r in orphan_report(d, ["src_table", "month"]).collect()}
    assert got == {("t", "2024-01"): (2, 1), ("t", None): (1, 1)}
