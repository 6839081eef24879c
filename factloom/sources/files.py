"""Sources and sinks: landed files, review packs, note vaults, versioned snapshots."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, sha256, content) of files; the hash is what duplicates are told by."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash is not known, one a hash (the least path)."""
    fresh = files.join(known.select("sha256"), "sha256", "left_anti")
    return fresh.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in files.columns if c != "sha256"]), "path").alias("f")).select("sha256", "f.*")


def landed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON lines under a declared schema; unreadable lines stand in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def split_dead_letters(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, (payload) of unreadable ones)."""
    return rows.filter("_corrupt is null").drop("_corrupt"), rows.filter("_corrupt is not null").select(F.col("_corrupt").alias("payload"))


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, title, link, published, description) of RSS and Atom files: the key hashes the entry's id, else its link.

    The time is the first there is of published, updated and created.
    """
    read = lambda tag, schema: spark.read.format("xml").schema(schema).option("rowTag", tag).load(path)
    rss = read("item", "guid string, id string, link string, title string, pubDate string, updated string, created string, description string")
    atom = read("entry", "id string, title string, link struct<_href:string>, published string, updated string, created string, summary string")
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    key = lambda *c: F.sha2(F.coalesce(*[full(x) for x in c]).cast("binary"), 256).alias("external_id")
    a = rss.select(key("guid", "id", "link"), "title", "link", F.coalesce(full("pubDate"), full("updated"), full("created")).alias("published"), "description")
    b = atom.select(key("id", F.col("link._href")), "title", F.col("link._href").alias("link"), F.coalesce(full("published"), full("updated"), full("created")).alias("published"), F.col("summary").alias("description"))
    return a.unionByName(b).filter("external_id is not null")


#: What collectors land, by kind, as the fields that are kept.
LANDINGS = {
    "channel_posts": "channel string, post_id long, posted_at string, text string, views long, url string",
    "video_channel": "channel_id string, video_id string, title string, description string, published_at string, url string",
    "bills": "number string, title string, status string, registered_at string, url string, sponsors array<string>",
    "votes": "bill_number string, vote_date string, vote_stage string, deputy_name string, faction string, vote_result string, source_url string",
    "registry": "registry string, record_id string, name string, inn string, included_at string, excluded_at string, url string",
    "acts": "number string, title string, signed_at string, text string, url string",
    "people": "full_name string, position string, organization string, region string, biography string, url string",
}
#: The fields that make a landed row the same as one before.
LANDING_KEYS = {
    "channel_posts": ["channel", "post_id"], "video_channel": ["video_id"], "bills": ["number"], "votes": ["bill_number", "vote_date", "deputy_name"],
    "registry": ["registry", "record_id"], "acts": ["number"], "people": ["full_name", "organization"],
}


def landed(spark: SparkSession, path: str, kind: str, since: str | None = None, time: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of landed JSON of a kind: each key once, the last by all fields; rows before ``since`` by the text ``time`` are left out."""
    good, bad = split_dead_letters(landed_json(spark, path, LANDINGS[kind]).cache())
    if since is not None:
        good = good.filter(F.col(time) >= since)
    keys, fields = LANDING_KEYS[kind], [x.split()[0] for x in LANDINGS[kind].split(", ")]
    rest = [c for c in fields if c not in keys]
    return good.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*fields), bad


def scan_inbox(spark: SparkSession, path: str, known: DataFrame, routes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(files to process with ``route``, counts by route): files of a watched folder by suffix, those known by hash or without a route left out of the first."""
    f = binary_files(spark, path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    route = F.lit("other")
    for s, r in routes.items():
        route = F.when(suffix == s, r).otherwise(route)
    f = f.withColumn("route", route)
    new = new_files(f.filter("route != 'other'"), known)
    n = f.groupBy("route").agg(F.count(F.lit(1)).alias("seen")).join(new.groupBy("route").agg(F.count(F.lit(1)).alias("new")), "route", "left")
    return new, n.select("route", "seen", F.coalesce("new", F.lit(0).cast("long")).alias("new"))


def html_rows(pages: DataFrame, block: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """Repeated blocks of landed pages as rows: ``block`` finds each one, a field's pattern (one group) what it holds; tags in it are dropped.

    Pages without blocks give nothing; a field that a block lacks is ''.
    """
    others = [c for c in pages.columns if c != html]
    x = pages.select(*others, F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f"(?s)({block})"), 1)).alias("_b"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    return x.select(*others, *[plain(F.regexp_extract("_b", f"(?s){p}", 1)).alias(name) for name, p in fields.items()])


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Text of HTML without tags, scripts and styles, white space collapsed; null stays null."""

    def one(x):
        if x is None:
            return None
        p = _Text()
        p.feed(x)
        p.close()
        return re.sub(r"\s+", " ", "".join(p.parts)).strip()

    return s.map(one)


def export_review_pack(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*[F.col(c).cast("string").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)


def import_review_pack(spark: SparkSession, path: str, target: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``target`` with the pack's values where it has any; keys the target lacks are left out."""
    pack = spark.read.csv(path, header=True, escape='"', multiLine=True).dropDuplicates([key])
    kinds = dict(target.dtypes)
    side = pack.select(F.col(key).try_cast(kinds[key]).alias(key), *[F.nullif(F.col(c), F.lit("")).try_cast(kinds[c]).alias(f"_{c}") for c in columns])
    return target.join(side, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def notes(df: DataFrame, title: str, body: str, folder: str | None = None) -> DataFrame:
    """(file_name, content): a note a row, names made safe and unique by a hash of the whole row's title and body."""
    safe = F.trim(F.regexp_replace(F.coalesce(title, F.lit("note")), r'[\\/:*?"<>|#^\[\]\s]+', " "))
    name = F.concat(F.substring(safe, 1, 80), F.lit("-"), F.substring(F.sha2(F.concat_ws("\u0000", title, body), 256), 1, 8), F.lit(".md"))
    where = F.concat_ws("/", F.col(folder), name) if folder else name
    return df.select(where.alias("file_name"), F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit(""))).alias("content"))


def write_notes(vault: DataFrame, path: str) -> None:
    """Writes the notes below ``path``, a note a file, through Spark's text sink and the file system that the path names."""
    spark = vault.sparkSession
    rows = vault.select(F.regexp_replace("file_name", "/", "\u2044").alias("note"), F.col("content").alias("value"))
    draft = f"{path.rstrip('/')}-draft"
    rows.repartition("note").write.mode("overwrite").partitionBy("note").option("lineSep", "\n").text(draft)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(hadoop.Path(draft)):  # names only; the contents stay where they are
        name = folder.getPath().getName()
        if name.startswith("note="):
            target = hadoop.Path(f"{path}/{_unescaped(name[5:])}")
            fs.mkdirs(target.getParent())
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), target)
    fs.delete(hadoop.Path(draft), True)


def _unescaped(name: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), name).replace("\u2044", "/")


def write_snapshot(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Tables written under a version's own folder; a manifest with row counts is written last and makes it valid."""
    path, counts = f"{root.rstrip('/')}/{version}", {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        counts[name] = df.sparkSession.read.parquet(f"{path}/{name}.parquet").count()
    spark = next(iter(tables.values())).sparkSession
    body = json.dumps({"version": version, "rows": counts}, sort_keys=True)
    row = spark.createDataFrame([(body, hashlib.sha256(body.encode()).hexdigest())], "manifest string, sha256 string")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return path
