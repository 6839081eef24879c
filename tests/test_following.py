from pyspark.sql import functions as F

import __spark_entry__
from factloom.operators import relational


def test_every_row_meets_the_next_ones(spark):
    d = spark.createDataFrame([("hot", i) for i in range(130)] + [("cold", 1), ("cold", 2), ("one", 1), (None, 1), (None, 2)], "g string, i long")
    want = {("hot", i, j) for i in range(130) for j in range(i + 1, min(i + 10, 130))} | {("cold", 1, 2)}
    got = relational.following(d, "g", [F.col("i")], 9)
    assert got.columns == ["g", "i", "rank", "n_g", "n_i", "n_rank"]
    assert {(r.g, r.i, r.n_i) for r in got.collect()} == want and got.count() == len(want)
    capped = relational.following(d, "g", [F.col("i")], 9, 50)
    assert {(r.g, r.i, r.n_i) for r in capped.collect()} == {x for x in want if x[2] < 50}


def test_contradictions_beyond_the_newest_fifty(spark, tmp_path):
    rows = [(i, 7, "view") for i in range(100)]
    rows[0], rows[3] = (0, 7, "purchase"), (3, 7, "refund")
    d = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id"))
    d.write.parquet(f"{tmp_path}/events.parquet")
    got = __spark_entry__.queries()["sliding_contradictions_all"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(7, 3, 0)]
