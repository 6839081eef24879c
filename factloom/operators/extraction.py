"""Extraction from texts and assembly of events: sentences, identifiers, groups with roles and timelines."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.relational import numbered


def typed_sentences(docs: DataFrame, patterns: Sequence[tuple[str, str]], least: int = 25, most: int = 700) -> DataFrame:
    """(id, kind, sentence): sentences of (id, text) that a kind's pattern matches, each once a kind and whole text.

    Of sentences longer than ``most`` characters 260 before to 360 after the first match are shown; null and empty texts give nothing.
    """
    s = docs.select("id", F.explode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n+")).alias("s"))
    s = s.select("id", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("s")).filter(F.length("s") >= least)

    def shown(p: str) -> Column:
        before = F.length(F.get(F.split("s", p, 2), 0))
        start = F.greatest(F.lit(0), before - 260)
        part = F.trim(F.substr("s", start + 1, before + F.length(F.regexp_substr("s", F.lit(p))) + 360 - start))
        return F.when(F.length("s") > most, part).otherwise(F.col("s"))

    kinds = F.array_compact(F.array(*[F.when(F.col("s").rlike(p), F.struct(F.lit(k).alias("kind"), shown(p).alias("sentence"))) for k, p in patterns]))
    x = s.select("id", F.lower("s").alias("_l"), F.inline(kinds))
    return x.dropDuplicates(["id", "kind", "_l"]).drop("_l")


def identifiers(docs: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, kind, value): what the first group of each pattern finds in (id, text), each value once a text."""
    def found(kind: str, pattern: str) -> Column:
        values = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), 1))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return docs.select("id", F.inline(F.flatten(F.array(*[found(k, p) for k, p in patterns]))))


def json_members(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, member) of a JSON array of numbers kept as text; what is no array gives nothing."""
    return df.select(key, F.explode(F.from_json(column, "array<bigint>")).alias("member"))


def first_of(value: Column, when: Column, *order: Column) -> Column:
    """The value of the first row, by ``order``, for which ``when`` holds: an aggregate."""
    return F.min_by(F.when(when, value), F.when(when, F.struct(*order)))


def event_groups(items: DataFrame, group: str, official: Column, order: Sequence[str]) -> DataFrame:
    """(group, item, sort_order, role): timelines of groups; the first item that is not official is the origin, official ones are documents, the rest updates."""
    d = numbered(items.withColumn("_o", F.coalesce(official, F.lit(False))), group, order, "sort_order")
    first = d.filter(~F.col("_o")).groupBy(F.col(group).alias("_g")).agg(F.min("sort_order").alias("_first"))
    d = d.join(first, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("sort_order", F.col("sort_order").cast("int"))
    role = F.when(F.col("_o"), "official_doc").when(F.col("sort_order") == F.col("_first"), "origin").otherwise("update")
    return d.withColumn("role", role).drop("_o", "_first", "_g")


def sync_state(items: DataFrame, source: str, key: str, ts: str) -> DataFrame:
    """(source, cursor, last_at, items): how far each source has been read."""
    return items.groupBy(source).agg(F.max(key).alias("cursor"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("items"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts (nulls count as empty)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def signature_similarity(groups: DataFrame, items: DataFrame) -> DataFrame:
    """(id, canonical_id, similarity) of members of signature groups to the group's least item: .7 title, .3 body."""
    c = items.select(F.col("id").alias("canonical_id"), F.col("title").alias("_t"), F.col("body_text").alias("_b"))
    x = groups.filter("id != canonical_id").select("id", "canonical_id").join(items.select("id", "title", "body_text"), "id").join(c, "canonical_id")
    return x.select("id", "canonical_id", F.round(0.7 * sequence_ratio("title", "_t") + 0.3 * sequence_ratio("body_text", "_b"), 4).alias("similarity"))
