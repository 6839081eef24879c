"""Session helpers: shared checkpoint folder, table loading, lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster whose Python path does not have it."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or spark.sparkContext.master.startswith("local[") or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='factloom-')}/factloom", "zip", root, "factloom")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_or_empty(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty DataFrame of ``schema`` where it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return table(spark, sf_dir, name)
    return spark.createDataFrame([], schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the session has no such setting (tests, a single machine) a folder of
    the driver's machine is set once for the session.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True).toDF(*df.columns)  # columns of their own, for joins with what it came from


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder for a table that a job writes and reads again."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def parallelism(spark: SparkSession) -> int:
    """Tasks for a stage with heavy work per row: three a core, at least the shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
