"""TF-IDF neighbours and groups by signature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import TITLE_TOKENS, first_tokens
from factloom.operators.relational import top_per
from factloom.session import cut


def terms(docs: DataFrame) -> DataFrame:
    """(id, term, tf): one and two word terms of (id, text); words have two characters or more."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    d = docs.select("id", words.alias("w")).filter("size(w) > 0")
    two = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).otherwise(F.array().cast("array<string>"))
    t = d.select("id", F.explode(F.concat("w", two)).alias("term"))
    return t.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame) -> DataFrame:
    """(id, term, w): raw counts times ln((1 + n) / (1 + df)) + 1, each document scaled to length 1."""
    t = terms(docs)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = t.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    w = t.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return w.join(norm, "id").select("id", "term", (F.col("x") / F.col("norm")).alias("w"))


def neighbours(docs: DataFrame, threshold: float = 0.22, k: int = 5) -> DataFrame:
    """(id, neighbour, score, rank): the ``k`` most similar documents at or above ``threshold`` (cosine, four places).

    Terms of a single document meet nothing and are dropped before the join.
    """
    w = tfidf(docs)
    shared = w.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("term")
    w = cut(w.join(shared, "term", "left_semi").select("id", "term", "w"))
    a, b = w.toDF("id", "term", "wa"), w.toDF("neighbour", "term", "wb")
    dot = a.join(b, "term").filter("id != neighbour").groupBy("id", "neighbour").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 4).alias("score"))
    return top_per(dot.filter(F.col("score") >= threshold), ["id"], [F.col("score").desc(), F.col("neighbour").desc()], k)


def signatures(items: DataFrame) -> DataFrame:
    """(id, signature) of items (id, title, body_text): ``title_signature``, the body being read only where the title may have no word."""
    titled = items.select("id", first_tokens(F.col("title"), TITLE_TOKENS).alias("signature")).filter("signature != ''")
    title = F.coalesce("title", F.lit(""))
    bare = items.filter(~title.rlike(r"[\p{L}\p{N}_]") | title.rlike("(?i)https?://"))
    t = first_tokens(F.col("title"), TITLE_TOKENS)
    rest = bare.select("id", F.when(t == "", first_tokens(F.col("body_text"), TITLE_TOKENS)).alias("signature")).filter("signature != ''")
    return titled.unionByName(rest)


def signature_groups(items: DataFrame) -> DataFrame:
    """(id, signature, canonical_id, group_size) of items whose title signature occurs twice or more."""
    s = cut(signatures(items))
    g = s.groupBy("signature").agg(F.min("id").alias("canonical_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return s.join(g, "signature").select("id", "signature", "canonical_id", "group_size")
