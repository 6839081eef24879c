"""Scores of claims: corroboration, time, entities, rhetoric, contradictions, and the evidence linked to them.

Claims are (id, content_item_id, source_id, claim_text, claim_type, status,
published_at), mentions (entity_id, content_item_id), one row for each pair.
What claims share by an entity is aggregated by entity before it meets the
claims, so an entity that a third of all items mention is a few rows, never
pairs of items. Numbers are fixed values of the data model. A claim without
what a score reads has the score's stated default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scores
from factloom.operators.relational import top_per

# Kinds of items, sources and links that count as official, as mere hints, and what a kind's link is called.
OFFICIAL_TYPES = ("registry_record", "court_record", "enforcement", "procurement", "bill", "transcript", "deputy_profile")
OFFICIAL_CATEGORIES = ("official_registry", "official_site")
SEED_TYPES = ("co_entity", "co_mention", "content_similarity", "mentioned_together")
HARD_TYPES = (
    "official_registry", "court_document", "enforcement_record", "procurement_record", "legislative_document", "official_transcript", "official_profile",
    "registry_record", "court_record", "enforcement", "procurement", "bill", "transcript", "vote_record",
)
LINK_TYPES = {
    "registry_record": "official_registry", "court_record": "court_document", "enforcement": "enforcement_record", "procurement": "procurement_record",
    "bill": "legislative_document", "transcript": "official_transcript", "deputy_profile": "official_profile",
}
STRENGTHS = {"registry_record": "strong", "court_record": "strong", "enforcement": "strong", "procurement": "moderate", "bill": "moderate", "transcript": "strong", "deputy_profile": "strong"}


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _named(values: dict[str, str], key: str, other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(key) == k, v).otherwise(out)
    return out


def corroboration(claims: DataFrame, mentions: DataFrame, sources: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(id, score, n_sources) by the other sources whose items share an entity and hold a claim of the same type.

    ``clusters`` (id, cluster): .8 where three sources or more have a claim of
    the same cluster in another item, .6 where two have. 0 for claims without any.
    """
    typed = claims.select("content_item_id", "claim_type", "source_id").dropna().distinct()
    seen = mentions.select("entity_id", "content_item_id").join(typed, "content_item_id").groupBy("entity_id", "claim_type", "source_id")
    seen = seen.agg(F.min("content_item_id").alias("lo"), F.max("content_item_id").alias("hi"))
    asked = claims.select("id", "content_item_id", "claim_type").join(mentions.select("entity_id", "content_item_id"), "content_item_id")
    met = asked.join(seen, ["entity_id", "claim_type"]).filter("lo != content_item_id or hi != content_item_id").select("id", "source_id").distinct()
    s = sources.select(F.col("id").alias("source_id"), "category", "political_alignment")
    g = met.join(s, "source_id").groupBy("id").agg(F.count(F.lit(1)).alias("n_sources"), F.count_distinct("category").alias("c"), F.count_distinct("political_alignment").alias("p"))
    n = F.col("n_sources")
    score = F.when(n >= 3, 0.3).when(n >= 2, 0.2).otherwise(0.0) + F.when(F.col("c") >= 2, 0.3).otherwise(0.0) + F.when(F.col("p") >= 2, 0.2).otherwise(0.0) + F.when(n >= 5, 0.2).otherwise(0.0)
    out = claims.select("id").join(g.select("id", "n_sources", F.round(F.least(F.lit(1.0), score), 4).alias("score")), "id", "left")
    if clusters is not None:
        x = claims.select("id", "content_item_id", "source_id").join(clusters, "id")
        by = x.groupBy("cluster", "source_id").agg(F.min("content_item_id").alias("lo"), F.max("content_item_id").alias("hi"))
        k = x.select("id", "content_item_id", "cluster").join(by, "cluster").filter("lo != content_item_id or hi != content_item_id").groupBy("id").agg(F.count("source_id").alias("k"))
        out = out.join(k, "id", "left").withColumn("score", F.when(F.col("k") >= 3, 0.8).when(F.col("k") >= 2, 0.6).otherwise(F.col("score"))).drop("k")
    return out.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_sources", F.lit(0).cast("long")).alias("n_sources"))


def day(text: str) -> Column:
    """The day that a text begins with, in ISO form; null where it does not."""
    return F.when(F.col(text).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10)))


def temporal_consistency(claims: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """(id, score): the best of the evidence by its day against the claim's; .5 for claims without a day, .3 without evidence that bears one."""
    e = links.select("claim_id", "evidence_item_id").join(items.select(F.col("id").alias("evidence_item_id"), day("published_at").alias("e")), "evidence_item_id").filter("e is not null")
    c = claims.select("id", day("published_at").alias("c"))
    after = F.date_diff("c", "e")
    one = F.when(after >= 0, F.when(after <= 30, 0.8).when(after <= 365, 0.5).otherwise(0.2)).otherwise(F.when(after >= -7, 0.6).when(after >= -30, 0.4).otherwise(0.1))
    best = c.join(e, c.id == e.claim_id).groupBy("id").agg(F.max(one).alias("best"))
    return c.join(best, "id", "left").select("id", F.when(F.col("c").isNull(), 0.5).otherwise(F.coalesce("best", F.lit(0.3))).alias("score"))


def entity_verification(claims: DataFrame, persons: DataFrame, records: DataFrame, number: str, name: str = r"([А-ЯЁ][а-яё]+(?:\s[А-ЯЁ][а-яё]+){1,2})", numbers: int = 2, names: int = 2) -> DataFrame:
    """(id, checks, verified, score): of a claim's first numbers and names, the share that is known; .3 without any.

    A number (first group of ``number``) is known if a record (id, text) other
    than the claim's item has it; a name if its first 15 characters begin some
    word of a person's name (name). Equality joins on numbers and on words; no
    text is compared with every other.
    """
    take = lambda p, n: F.slice(F.array_distinct(F.regexp_extract_all("claim_text", F.lit(p), 1)), 1, n)
    asked = claims.select("id", "content_item_id", take(number, numbers).alias("numbers"), take(name, names).alias("names"))
    have = records.select(F.col("id").alias("record"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(number), 1))).alias("number"))
    have = have.groupBy("number").agg(F.min("record").alias("lo"), F.max("record").alias("hi"))
    a = asked.select("id", "content_item_id", F.explode("numbers").alias("number")).join(have, "number", "left")
    a = a.select("id", _known((F.col("lo") != F.col("content_item_id")) | (F.col("hi") != F.col("content_item_id"))).alias("ok"))
    n = asked.select("id", F.explode("names").alias("name")).select("id", F.substring("name", 1, 15).alias("name"))
    n = n.withColumn("key", F.get(F.split("name", r"\s"), 0))
    words = persons.select("name").distinct().select(F.col("name").alias("whole"), F.explode(F.split("name", r"\s")).alias("w")).select("whole", F.substring("w", 1, 15).alias("key"))
    hit = n.select("name", "key").distinct().join(words, "key").filter(F.contains(F.concat(F.lit(" "), "whole"), F.concat(F.lit(" "), "name"))).select("name").distinct()
    b = n.join(hit.withColumn("ok", F.lit(True)), "name", "left").select("id", _known(F.col("ok")).alias("ok"))
    g = a.unionByName(b).groupBy("id").agg(F.count(F.lit(1)).alias("checks"), F.count_if("ok").alias("verified"))
    zero = F.lit(0).cast("long")
    return claims.select("id").join(g, "id", "left").select("id", F.coalesce("checks", zero).alias("checks"), F.coalesce("verified", zero).alias("verified"), F.coalesce(F.round(F.col("verified") / F.col("checks"), 4), F.lit(0.3)).alias("score"))


def rhetoric_risk(claims: DataFrame, sources: DataFrame, quotes: DataFrame, tags: DataFrame, aligned: Sequence[str], manipulation: Sequence[str], filters: Sequence[str]) -> DataFrame:
    """(id, score): the source's alignment .2, flagged quotes .1 each up to .3, tags of manipulation .2, of filters .15."""
    q = quotes.filter("flagged").groupBy("content_item_id").agg(F.count(F.lit(1)).alias("q"))
    t = tags.groupBy("content_item_id").agg(F.max(F.col("tag").isin(*manipulation)).alias("m"), F.max(F.col("tag").isin(*filters)).alias("f"))
    s = sources.select(F.col("id").alias("source_id"), F.col("political_alignment").isin(*aligned).alias("a"))
    x = claims.select("id", "content_item_id", "source_id").join(s, "source_id", "left").join(q, "content_item_id", "left").join(t, "content_item_id", "left")
    flag = lambda c, v: F.when(_known(F.col(c)), v).otherwise(0.0)
    score = flag("a", 0.2) + F.least(F.lit(0.3), F.coalesce("q", F.lit(0)) * 0.1) + flag("m", 0.2) + flag("f", 0.15)
    return x.select("id", F.round(F.least(F.lit(1.0), score), 4).alias("score"))


def contradiction_penalty(claims: DataFrame, mentions: DataFrame, relations: DataFrame, bad: Sequence[str] = ("likely_false", "disproved", "manipulation"), entities: int = 5) -> DataFrame:
    """(id, score): contradicting relations (.1 each up to .3) and refuted claims (.15 each up to .5) of the item's first entities."""
    first = mentions.groupBy("content_item_id").agg(F.slice(F.sort_array(F.collect_set("entity_id")), 1, entities).alias("e"))
    ends = relations.filter("relation_type = 'contradicts'").select(F.explode(F.array("a", "b")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("r"))
    wrong = claims.filter(F.col("status").isin(*bad)).select("content_item_id").join(mentions.select("entity_id", "content_item_id"), "content_item_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("w"))
    x = claims.select("id", "content_item_id", F.col("status").isin(*bad).alias("own")).join(first, "content_item_id")
    x = x.select("id", "own", F.explode("e").alias("entity_id")).join(ends, "entity_id", "left").join(wrong, "entity_id", "left")
    zero = F.lit(0)
    g = x.groupBy("id").agg(F.sum(F.coalesce("r", zero)).alias("r"), F.sum(F.coalesce("w", zero) - F.coalesce(F.col("own").cast("int"), zero)).alias("w"))
    score = F.round(F.least(F.lit(1.0), F.least(F.lit(0.3), F.col("r") * 0.1) + F.least(F.lit(0.5), F.col("w") * 0.15)), 4)
    return claims.select("id").join(g.select("id", score.alias("score")), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


# The factors' weights; the last two count against a claim.
WEIGHTS = {"source": 0.15, "document": 0.25, "corroboration": 0.20, "temporal": 0.10, "entity": 0.15, "rhetoric": -0.10, "contradiction": -0.05}


def authenticity(factors: DataFrame) -> DataFrame:
    """(id, authenticity, consistency, status) of (id, and a column for each of ``WEIGHTS``)."""
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) + 1e-9, 4)  # ties of binary fractions go up
    consistency = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("temporal") * 0.45 + F.col("entity") * 0.35 + (F.lit(1.0) - F.col("contradiction")) * 0.20)), 4)
    status = F.when((F.col("rhetoric") > 0.7) & (F.col("corroboration") < 0.2), "manipulation").otherwise(scores.banded(F.col("authenticity"), scores.STATUS, "disproved"))
    return factors.select("*", score.alias("authenticity")).select("id", "authenticity", consistency.alias("consistency"), status.alias("status"))


def status_changes(claims: DataFrame, scored: DataFrame) -> DataFrame:
    """(claim_id, old_status, new_status): the audit rows of claims whose status a batch changed."""
    new = scored.select("id", F.col("status").alias("new_status"))
    x = claims.select("id", F.col("status").alias("old_status")).join(new, "id").filter(~F.col("old_status").eqNullSafe(F.col("new_status")))
    return x.select(F.col("id").alias("claim_id"), "old_status", "new_status")


def evidence_class(kind: str, content_type: str, category: str, strength: str) -> Column:
    """seed, hard or support."""
    hard = _known(F.col(kind).isin(*HARD_TYPES)) | _known(F.col(content_type).isin(*OFFICIAL_TYPES)) | _known(F.col(category).isin(*OFFICIAL_CATEGORIES)) | _known(F.col(strength) == "strong")
    return F.when(_known(F.col(kind).isin(*SEED_TYPES)), "seed").when(hard, "hard").otherwise("support")


def backfilled_classes(links: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Links (id, ...) with ``new_class``, and whether it differs from the one they have."""
    s = sources.select(F.col("id").alias("source_id"), "category")
    c = items.select(F.col("id").alias("evidence_item_id"), "content_type", "source_id").join(s, "source_id", "left").drop("source_id")
    x = links.join(c, "evidence_item_id", "left").withColumn("new_class", evidence_class("evidence_type", "content_type", "category", "strength"))
    return x.select(*links.columns, "new_class", (~F.coalesce("evidence_class", F.lit("")).eqNullSafe(F.col("new_class"))).alias("changed"))


def evidence_score(content_type: str, category: str, tier: str, shared: str) -> Column:
    """3 for an official item, 2 for an official source, 1 or .5 for its tier, .5 for each shared entity up to five."""
    tiers = F.when(F.col(tier) == "A", 1.0).when(F.col(tier) == "B", 0.5).otherwise(0.0)
    return F.when(_known(F.col(content_type).isin(*OFFICIAL_TYPES)), 3.0).otherwise(0.0) + F.when(_known(F.col(category).isin(*OFFICIAL_CATEGORIES)), 2.0).otherwise(0.0) + tiers + F.least(F.col(shared), F.lit(5)) * 0.5


def best_sharing(asked: DataFrame, have: DataFrame, mentions: DataFrame, order, k: int) -> DataFrame:
    """For each of ``asked`` (id, content_item_id) the ``k`` best rows of ``have`` (content_item_id, ...) on other items that share entities with its item, with ``shared`` and ``rank``.

    ``order`` makes the sort columns from the row's columns and ``shared``; it
    must be total. Items with the same entities are one set: only distinct sets
    meet, and of a set's rows only the first of each make-up travel, so an
    entity that a third of all items mention costs its sets, not its pairs.
    """
    m = mentions.select("content_item_id", "entity_id").distinct()
    sets = m.groupBy("content_item_id").agg(F.sort_array(F.collect_set("entity_id")).alias("e")).select("content_item_id", "e", F.xxhash64("e").alias("set"))
    members = sets.select("set", "e").dropDuplicates(["set"]).select("set", F.explode("e").alias("entity_id"))
    of = sets.select("content_item_id", "set")
    a = asked.select("id", F.col("content_item_id").alias("_own")).join(of.withColumnRenamed("content_item_id", "_own"), "_own")
    mine = members.join(a.select("set").distinct(), "set", "left_semi").select(F.col("set").alias("_a"), "entity_id")
    met = mine.join(members.select(F.col("set").alias("_b"), "entity_id"), "entity_id").groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("shared"))
    rows = have.join(of.withColumnRenamed("set", "_b"), "content_item_id")
    others = [c for c in have.columns if c != "content_item_id"]
    kinds = [c for c in others if dict(have.dtypes)[c] in ("string", "int", "boolean")]
    first = top_per(rows, ["_b", *kinds], [F.col(c) for c in have.columns if c not in kinds], k + 1).drop("rank")
    best = top_per(met.join(first, "_b"), ["_a"], order(), k + 1).drop("rank")
    out = a.withColumnRenamed("set", "_a").join(best, "_a").filter("content_item_id != _own")
    return top_per(out, ["id"], order(), k).drop("_a", "_b", "_own")


def autolinks(claims: DataFrame, mentions: DataFrame, items: DataFrame, sources: DataFrame, known: DataFrame, k: int = 5) -> DataFrame:
    """(claim_id, evidence_item_id, evidence_type, strength, score, shared, rank): the ``k`` best other items that share entities with a claim's, of score 1 or more.

    By score, then id. Links in ``known`` stay out, after the ranking.
    """
    s = sources.select(F.col("id").alias("source_id"), "category", "credibility_tier")
    have = items.select(F.col("id").alias("content_item_id"), "content_type", "source_id").join(s, "source_id").select("content_item_id", "content_type", "category", "credibility_tier")
    score = evidence_score("content_type", "category", "credibility_tier", "shared")
    top = best_sharing(claims, have, mentions, lambda: [score.desc(), F.col("content_item_id")], k)
    top = top.withColumnRenamed("id", "claim_id").withColumnRenamed("content_item_id", "evidence_item_id").withColumn("score", score).filter("score >= 1")
    strength = _named(STRENGTHS, "content_type", "weak")
    strength = F.when((strength == "weak") & ~_known(F.col("content_type").isin(*STRENGTHS)) & _known(F.col("category").isin(*OFFICIAL_CATEGORIES)), "moderate").otherwise(strength)
    strength = F.when(F.col("score") >= 5, "strong").when((F.col("score") >= 3) & (strength == "weak"), "moderate").otherwise(strength)
    top = top.join(known.select("claim_id", "evidence_item_id").distinct(), ["claim_id", "evidence_item_id"], "left_anti")
    return top.select("claim_id", "evidence_item_id", _named(LINK_TYPES, "content_type", "official_document").alias("evidence_type"), strength.alias("strength"), "score", "shared", "rank")


def official_links(items: DataFrame, claims: DataFrame, mentions: DataFrame, known: DataFrame, k: int = 20) -> DataFrame:
    """(claim_id, evidence_item_id, evidence_type, evidence_class, strength): official items as evidence of the first ``k`` open claims that share an entity."""
    official = items.filter(F.col("content_type").isin(*OFFICIAL_TYPES)).select("id", F.col("id").alias("content_item_id"), "content_type")
    have = claims.select("content_item_id", F.col("id").alias("claim_id"))
    x = best_sharing(official, have, mentions, lambda: [F.col("claim_id"), F.col("content_item_id")], k)
    x = x.select(F.col("id").alias("evidence_item_id"), "claim_id").join(official.select(F.col("id").alias("evidence_item_id"), "content_type"), "evidence_item_id")
    x = x.join(known.select("claim_id", "evidence_item_id").distinct(), ["claim_id", "evidence_item_id"], "left_anti")
    hard = F.when(F.col("content_type") == "deputy_profile", "support").otherwise("hard")
    return x.select("claim_id", "evidence_item_id", _named(LINK_TYPES, "content_type", "official_document").alias("evidence_type"), hard.alias("evidence_class"), _named(STRENGTHS, "content_type", "moderate").alias("strength"))


def reverified(claims: DataFrame, evidence: Sequence[DataFrame]) -> DataFrame:
    """(id, links, status) of claims by what independent tables (claim_id, evidence) say: three pieces or more likely_true, one partially_confirmed, else as it was."""
    e = evidence[0]
    for x in evidence[1:]:
        e = e.unionByName(x)
    n = e.distinct().groupBy(F.col("claim_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    c = claims.select("id", "status").join(n, "id", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    return c.select("id", "links", F.when(F.col("links") >= 3, "likely_true").when(F.col("links") >= 1, "partially_confirmed").otherwise(F.col("status")).alias("status"))


def first_status(sources: DataFrame, claims: DataFrame, items: DataFrame) -> DataFrame:
    """(id, confidence): a new claim's bucket by its item's kind and its source."""
    s = sources.select(F.col("id").alias("source_id"), "credibility_tier", "is_official")
    c = items.select(F.col("id").alias("content_item_id"), "content_type")
    x = claims.select("id", "content_item_id", "source_id").join(s, "source_id", "left").join(c, "content_item_id", "left")
    high = _known(F.col("is_official") == 1) | _known(F.col("content_type").isin(*OFFICIAL_TYPES))
    return x.select("id", F.when(high, "high").when(_known(F.col("credibility_tier").isin("A", "B")), "medium").otherwise("low").alias("confidence"))


def vote_contradictions(claims: DataFrame, mentions: DataFrame, votes: DataFrame, patterns: Sequence[tuple[str, str]], newest: int = 50) -> DataFrame:
    """(entity_id, claim_id, session, stated, result, score): what an entity's newest claims say it voted against its newest votes.

    ``patterns``: (pattern, vote), the first that matches counts; ``votes``
    (entity_id, session, result, at). Claims and votes of an entity are bounded
    by ``newest``, the asked report, before they meet.
    """
    stated = F.lit(None).cast("string")
    for p, v in reversed(list(patterns)):
        stated = F.when(F.col("claim_text").rlike(p), v).otherwise(stated)
    c = claims.join(mentions.select("content_item_id", "entity_id"), "content_item_id").select("entity_id", F.col("id").alias("claim_id"), stated.alias("stated"))
    c = top_per(c, ["entity_id"], [F.col("claim_id").desc()], newest).filter("stated is not null").drop("rank")
    v = top_per(votes, ["entity_id"], [F.col("at").desc_nulls_last(), F.col("session").desc()], newest).drop("rank", "at")
    x = c.join(v, "entity_id").filter((F.col("stated") != F.col("result")) & F.col("result").isin("за", "против"))
    return x.select("entity_id", "claim_id", "session", "stated", "result", F.when((F.col("stated") == "за") & (F.col("result") == "против"), 0.7).otherwise(0.5).alias("score"))


def amount_contradictions(claims: DataFrame, mentions: DataFrame, declared: DataFrame, pattern: str) -> DataFrame:
    """(entity_id, claim_id, declared, claimed): amounts (first group of ``pattern``) in claims on entities with a declared one (entity_id, declared)."""
    c = claims.select(F.col("id").alias("claim_id"), "content_item_id", F.regexp_extract("claim_text", pattern, 1).alias("claimed")).filter("claimed != ''")
    return c.join(mentions.select("content_item_id", "entity_id"), "content_item_id").join(declared, "entity_id").select("entity_id", "claim_id", "declared", "claimed")


def canonical_by(values: DataFrame, by: str, text: str) -> DataFrame:
    """(by, canonical, members): the shortest text of each group, the least of equal ones."""
    return values.groupBy(by).agg(F.min(F.struct(F.length(text), F.col(text).alias("t")))["t"].alias("canonical"), F.count(F.lit(1)).alias("members"))
