"""Events made of groups of items: types, titles, spans, roles, facts and derivations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.relational import top_per
from factloom.operators.verification import day
from factloom.session import cut


def groups(members: DataFrame, items: DataFrame, eligible: Sequence[DataFrame]) -> DataFrame:
    """(event, id): the groups of ``members`` (id, canonical_id), and every other item that stands in one of ``eligible`` (id) as an event of its own.

    Where nothing is eligible all other items are. Disjoint conditions are
    semi-joins on one distinct set of ids.
    """
    members = cut(members.select("id", "canonical_id"))
    clustered = members.select(F.col("canonical_id").alias("event"), "id")
    rest = items.select("id").distinct().join(members.select("id"), "id", "left_anti")
    ids = None
    for e in eligible:
        ids = e.select("id") if ids is None else ids.unionByName(e.select("id"))
    single = rest.join(ids.distinct(), "id", "left_semi") if ids is not None else rest
    return clustered.unionByName(single.select(F.col("id").alias("event"), "id"))


def summary(grouped: DataFrame, items: DataFrame, claims: DataFrame, official: Sequence[str]) -> DataFrame:
    """(event, items, official_items, starts, ends, title, event_type) of events.

    The title is the first item's that has one; the type the first claim's,
    else the first official item's kind, else ``event``.
    """
    c = items.select("id", "title", "content_type", day("published_at").alias("day"))
    first = claims.groupBy(F.col("content_item_id").alias("id")).agg(F.min_by("claim_type", "id").alias("claim_type"))
    x = grouped.join(c, "id").join(first, "id", "left")
    known = lambda v: F.when(v, F.col("id"))
    title = F.min_by(F.trim("title"), known(F.coalesce(F.trim("title"), F.lit("")) != ""))
    off = F.coalesce(F.col("content_type").isin(*official), F.lit(False))
    kind = F.coalesce(F.min_by("claim_type", known(F.col("claim_type").isNotNull())), F.min_by("content_type", known(off)), F.lit("event"))
    return x.groupBy("event").agg(F.count(F.lit(1)).alias("items"), F.count_if(off).alias("official_items"), F.min("day").cast("string").alias("starts"), F.max("day").cast("string").alias("ends"), F.coalesce(title, F.lit("")).alias("title"), kind.alias("event_type"))


def entity_roles(grouped: DataFrame, mentions: DataFrame, entities: DataFrame, role: Column) -> DataFrame:
    """(event, entity_id, role, confidence): the role of each entity of an event in which it is surest; of equal ones the first by name.

    ``role`` is an expression over (entity_type, canonical_name, confidence).
    """
    e = entities.select(F.col("id").alias("entity_id"), "entity_type", "canonical_name")
    m = grouped.join(mentions.withColumnRenamed("content_item_id", "id"), "id").join(e, "entity_id").select("event", "entity_id", role.alias("role"), "confidence")
    g = m.groupBy("event", "entity_id", "role").agg(F.max("confidence").alias("confidence"))
    return top_per(g, ["event", "entity_id"], [F.col("confidence").desc(), F.col("role")], 1).drop("rank")


def facts(grouped: DataFrame, tags: DataFrame, items: DataFrame, documents: Sequence[str], base: float = 0.72, document: float = 0.82) -> DataFrame:
    """(event, fact, confidence): tags of an event's items as facts; the surest vote, at least ``document`` where a document has it, within .55 and .95."""
    kind = items.select("id", F.coalesce(F.col("content_type").isin(*documents), F.lit(False)).alias("document"))
    x = grouped.join(tags, "id").join(kind, "id").groupBy("event", F.col("tag").alias("fact")).agg(F.max("confidence").alias("c"), F.max("document").alias("d"))
    c = F.coalesce("c", F.lit(base))
    c = F.when(F.col("d"), F.greatest(c, F.lit(document))).otherwise(c)
    return x.select("event", "fact", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.55), c)), 4).alias("confidence"))


def derivations(rows: DataFrame, kind: str, inputs: Sequence[str]) -> DataFrame:
    """(id, kind, input_hash): the key of what is derived from a row: the hash of its inputs, nulls being empty."""
    return rows.select("id", F.lit(kind).alias("kind"), F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in inputs]).cast("binary"), 256).alias("input_hash"))


def stale(derived: DataFrame, now: DataFrame) -> DataFrame:
    """(id, kind) whose input hash is not what was derived before, or that were never derived."""
    old = derived.select("id", "kind", F.col("input_hash").alias("_old"))
    return now.join(old, ["id", "kind"], "left").filter(~F.col("input_hash").eqNullSafe(F.col("_old"))).select("id", "kind")


def factual_text(title: Column, body: Column, least: int = 220) -> Column:
    """The body without what follows a call to subscribe, read on or see also; the title before it, if it is short and lacks it."""
    space = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    text, name = space(body), space(title)
    for p in (r"(?:подписывайтесь|подпишитесь).*$", r"(?:подробнее|источник|ссылка).*$", r"(?:читайте также|см\. также).*$"):  # fixed values
        text = F.regexp_replace(text, "(?iu)" + p, "")
    text = F.trim(text)
    lacks = (name != "") & ~F.contains(F.lower(text), F.lower(name)) & (F.length(text) < least)
    return F.when(text == "", name).when(lacks, F.concat(name, F.lit(". "), text)).otherwise(text)
