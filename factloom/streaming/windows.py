"""Windows, stateful deduplication and idempotent ingest; the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(hour, event_type, n, total) by windows of ``ts``; ``late`` is the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, first_ts, n) of each user's runs of events less than ``gap`` apart."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "first_ts", "n")


def once(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """A stream without rows whose keys came before within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def ingest(stream: DataFrame, target: str, keys: list[str], checkpoint: str):
    """Writes a stream of landed rows to ``target``, each key once over all batches; runs until what is there is done.

    A batch is anti-joined with the keys already there and written to a
    directory named by its number, so a batch that is run again after a crash
    replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.option("basePath", target).parquet(target)
            if "batch" in old.columns:
                old = old.filter(F.col("batch") != number)
            fresh = fresh.join(old.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
