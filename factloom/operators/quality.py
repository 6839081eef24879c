"""Quality checks as rows, tag rules and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.relational import top_per


def gate(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """(check, value, limit, ok): each check's aggregate over ``df`` against its largest allowed value, in one pass."""
    aggregated = df.agg(*[v.cast("double").alias(k) for k, (v, _) in checks.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(F.col(k), F.lit(0.0)).alias("value"), F.lit(float(m)).alias("limit")) for k, (_, m) in checks.items()])
    return aggregated.select(F.inline(rows)).withColumn("ok", F.col("value") <= F.col("limit"))


def rule_scores(docs: DataFrame, rules: list[tuple[str, list[tuple[str, float]], float]], k: int = 4) -> DataFrame:
    """(id, tag, score) of (id, text): the points of a tag's patterns found, if they reach its threshold; best ``k`` a document.

    A pattern of a phrase or with digits may stand anywhere, one of two letters
    must be a word, one of up to four must begin one.
    """
    docs = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("_t"))
    text = F.col("_t")  # in lower case once, not in every pattern

    def found(p: str) -> Column:
        if " " in p or any(c.isdigit() for c in p) or len(p) > 4:
            return text.contains(p)
        return text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){p}" + (r"(?![\p{L}\p{N}_])" if len(p) <= 2 else ""))

    tags = []
    for tag, patterns, threshold in rules:
        score = sum((F.when(found(p), points).otherwise(0.0) for p, points in patterns), F.lit(0.0))
        tags.append(F.struct(F.lit(tag).alias("tag"), score.alias("score"), F.lit(float(threshold)).alias("threshold")))
    s = docs.select("id", F.inline(F.array(*tags))).filter("score > 0 and score >= threshold").drop("threshold")
    return top_per(s, ["id"], [F.col("score").desc(), F.col("tag")], k).drop("rank")


def voted(votes: DataFrame) -> DataFrame:
    """(id, tag, confidence, votes): the mean confidence of supporting votes and their number."""
    v = votes.filter("vote = 'support'")
    return v.groupBy("id", "tag").agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("votes"))


def derived_tags(tags: DataFrame, patterns: list[dict]) -> DataFrame:
    """(id, tag, confidence) where enough of a pattern's tags are there and one of each required list."""
    have = tags.groupBy("id").agg(F.collect_set("tag").alias("have"))
    out = []
    for p in patterns:
        n = F.size(F.array_intersect("have", F.array(*map(F.lit, p["any"]))))
        ok = n >= p["least"]
        for required in p.get("required", []):
            ok = ok & F.arrays_overlap("have", F.array(*map(F.lit, required)))
        out.append(F.struct(F.lit(p["tag"]).alias("tag"), F.round(F.least(F.lit(1.0), n / (len(p["any"]) * 0.5)), 2).alias("confidence"), ok.alias("ok")))
    return have.select("id", F.inline(F.array(*out))).filter("ok").drop("ok")


def precision(reviews: DataFrame) -> DataFrame:
    """(kind, reviewed, precision): right counts one, partly right a half."""
    r = reviews.filter(F.col("verdict").isin("correct", "partially", "wrong"))
    points = F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "partially", 0.5).otherwise(0.0)
    return r.groupBy("kind").agg(F.count(F.lit(1)).alias("reviewed"), F.round(F.avg(points), 4).alias("precision"))
