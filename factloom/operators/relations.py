"""Candidate relations: pairs from many tables in one wide row, their support, scores and explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scores, text
from factloom.operators.relational import either_end
from factloom.operators.verification import day


def wide_pairs(pairs: dict[str, DataFrame]) -> DataFrame:
    """(a, b, one column a seed) of pair tables (a, b, shared): how often each seed relates the pair, null where it does not.

    Pairs are unioned and aggregated once, so as many seeds as there may be cost one shuffle.
    """
    out = None
    for name, p in pairs.items():
        p = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(name).alias("seed"), F.col("shared").cast("long").alias("n"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("a", "b").agg(*[F.max(F.when(F.col("seed") == s, F.col("n"))).alias(s) for s in pairs])


def support_rows(pairs: DataFrame, mentions: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """(a, b, unit, source_id, host, category, day, size): the items that mention both ends of a pair."""
    m = mentions.select("entity_id", "content_item_id").distinct()
    x = pairs.select("a", "b").join(m.toDF("a", "unit"), "a").join(m.toDF("b", "unit"), ["b", "unit"])
    size = F.length(F.trim(F.coalesce("title", F.lit("")))) + F.length(F.trim(F.coalesce("body_text", F.lit(""))))
    c = items.select(F.col("id").alias("unit"), "source_id", F.nullif(text.source_host(F.col("url")), F.lit("")).alias("host"), day("published_at").alias("day"), size.alias("size"))
    return x.join(c, "unit").join(sources.select(F.col("id").alias("source_id"), "category"), "source_id", "left").select("a", "b", "unit", "source_id", "host", "category", "day", "size")


def support(pairs: DataFrame, mentions: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """``pairs`` with items, sources, domains, categories, days (how many bear one), span (days between first and last) and the mean size of their support."""
    g = support_rows(pairs, mentions, items, sources).groupBy("a", "b").agg(
        F.count_distinct("unit").alias("items"), F.count_distinct("source_id").alias("sources"), F.count_distinct("host").alias("domains"), F.count_distinct("category").alias("categories"),
        F.count("day").alias("days"), F.date_diff(F.max("day"), F.min("day")).alias("span"), F.avg("size").alias("size"),
    )
    zero = F.lit(0).cast("long")
    s = pairs.join(g, ["a", "b"], "left")
    return s.select(*pairs.columns, *[F.coalesce(c, zero).alias(c) for c in ("items", "sources", "domains", "categories", "days")], "span", F.coalesce("size", F.lit(0.0)).alias("size"))


def base_score(supported: DataFrame, role: float = 0.5) -> DataFrame:
    """Adds ``score``: independence of sources .30, overlap of evidence .25, time .15, roles .15, tags .10, specific text .05 (fixed values)."""
    part = lambda c, most, each: F.least(F.lit(most), F.coalesce(c, F.lit(0)) * each)
    has = lambda c, v: F.when(F.col(c).isNotNull(), v).otherwise(0.0)
    one = F.lit(1.0)
    independence = F.least(one, F.least(one, F.col("sources") / 4.0) * 0.45 + F.least(one, F.col("domains") / 3.0) * 0.55)
    evidence = F.least(one, part("bill", 0.20, 0.07) + has("contract", 0.25) + has("restriction", 0.20) + F.when(F.coalesce("vote", F.lit(0)) >= 5, 0.15).otherwise(0.0))
    specific = F.least(one, F.col("size") / 600.0) * 0.5
    total = independence * 0.30 + evidence * 0.25 + scores.temporal_spread(F.col("span"), F.col("days")) * 0.15 + F.lit(role) * 0.15 + specific * 0.05
    return supported.withColumn("score", F.round(total + 1e-9, 4))


def merged_support(rows: DataFrame) -> DataFrame:
    """Support of one pair, unit, source and host as one row: most copies, official if any is."""
    return rows.groupBy("a", "b", "unit", "source_id", "host").agg(F.max("copies").alias("copies"), F.max("official").alias("official"))


def explained(pairs: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """Adds ``path``: the seeds that relate the pair, in order, and ``strongest``, how often each does."""
    names = F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in seeds]))
    return pairs.withColumn("path", F.array_join(names, ">")).withColumn("strongest", F.greatest(*[F.coalesce(s, F.lit(0).cast("long")) for s in seeds]))


def symmetric_best(neighbours: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(a, b, score): the greatest score of each unordered pair."""
    return neighbours.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(score).alias(score))


def role_pairs(members: DataFrame, group: str, member: str, role: str, actors: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(group, actor, target) of a group's members whose roles relate them directly."""
    m = members.select(group, member, role).dropna().distinct()
    a = m.filter(F.col(role).isin(*actors)).select(group, F.col(member).alias("actor"))
    return a.join(m.filter(F.col(role).isin(*targets)).select(group, F.col(member).alias("target")), group).filter("actor != target").distinct()


def normalized_parties(parties: DataFrame, organisations: DataFrame) -> DataFrame:
    """(id, contract_id, entity_id, by_what): each party's organisation by INN (digits), else by exact name; only where one alone has it."""
    p = parties.select("id", "contract_id", "party_name", "party_role", text.normalize_inn(F.col("inn")).alias("inn")).distinct()
    o = organisations.select("id", "canonical_name", text.normalize_inn(F.col("inn")).alias("inn"))
    one = lambda key, name: o.filter(F.col(key) != "").groupBy(key).agg(F.min("id").alias(name), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    x = p.join(one("inn", "by_inn"), "inn", "left").join(one("canonical_name", "by_name").withColumnRenamed("canonical_name", "party_name"), "party_name", "left")
    how = F.when(F.col("by_inn").isNotNull(), "inn").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return x.select("id", "contract_id", F.coalesce("by_inn", "by_name").alias("entity_id"), how.alias("by_what"))


def stated_edges(entities: DataFrame, patterns: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(src, dst, relation_type) that texts of entities state; a pattern is (type, column, pattern with one group, prefix of the other end)."""
    found = [F.struct(F.concat(F.lit(prefix), F.regexp_extract(column, p, 1)).alias("dst"), F.lit(kind).alias("relation_type"), (F.coalesce(F.regexp_extract(column, p, 1), F.lit("")) != "").alias("ok")) for kind, column, p, prefix in patterns]
    return entities.select(F.col("id").alias("src"), F.inline(F.array(*found))).filter("ok").drop("ok").distinct()


def without_known(new: DataFrame, known: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of ``new`` that no known edge joins, in either direction."""
    k = either_end(known, a, b).distinct()
    return new.join(k, (new[a] == k["this"]) & (new[b] == k["other"]), "left_anti")
