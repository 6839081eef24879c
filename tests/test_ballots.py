import random

from pyspark.sql import functions as F

from factloom.operators import ballots, relational


def test_blocks_of_voters_agree_with_the_join(spark, monkeypatch):
    monkeypatch.setattr(ballots, "BLOCK", 9)
    monkeypatch.setattr(ballots, "COLUMNS", 5)
    monkeypatch.setattr(ballots, "ROWS", 4)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(-20, 20)]), rng.choice(["y", "n", "-", None])) for _ in range(900)]
    v = spark.createDataFrame(rows, "session long, voter int, vote string")
    for df in (v, v.withColumn("voter", F.concat(F.lit("v"), "voter"))):
        for limits in ((3, 2, 0.4), (5, 0, 0.0), (2, 2, 0.6667)):
            want = relational.agreement(df, "session", "voter", "vote", *limits, most_met=1 << 60)
            got = relational.agreement(df, "session", "voter", "vote", *limits, most_met=10)
            assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
            rows = [tuple(r) for r in got.collect()]
            assert rows and sorted(rows) == sorted(tuple(r) for r in want.collect())


def test_a_day_of_all_voters_is_not_joined(spark):
    v = spark.range(2500).select((F.col("id") % 2500).alias("voter"), F.lit(1).alias("session"), F.col("id").cast("string").alias("vote"))
    v = v.unionByName(v.withColumn("session", F.lit(2)))
    got = relational.agreement(v, "session", "voter", "vote", 2, 0, 0.0, most_met=10)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert got.count() == 2500 * 2499 // 2
