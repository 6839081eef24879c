"""Full-text search: a postings table, BM25 and filters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, len) of (id, text)."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    d = docs.select("id", words.alias("w")).filter("size(w) > 0").select("id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return d.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(query: str) -> list[str]:
    return sorted(set(re.findall(r"\w+", query.lower())))


def bm25(docs: DataFrame, query: str, k: int | None = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): documents with all terms of the query, best first; score to six places, ties by id; None gives all of them, in no order.

    Only postings of the query's terms leave the scan of the postings.
    """
    terms = query_terms(query)
    p = postings(docs)
    stats = docs.select(F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("len")).filter("len > 0")
    stats = stats.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    hit = p.filter(F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = hit.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    s = x.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched")).filter(F.col("matched") == len(terms))
    s = s.select("id", "score")
    return s if k is None else s.orderBy(F.col("score").desc(), "id").limit(k)


def page(docs: DataFrame, keep: DataFrame, query: str, limit: int = 100, offset: int = 0, around: int = 20) -> DataFrame:
    """(id, score, total, snippet): a page of the documents (id, text) in ``keep`` (id) that have all terms, scored over all documents.

    ``total`` is the number of hits; the snippet is what stands around the first term.
    """
    hits = bm25(docs, query, None).join(keep, "id", "left_semi")
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    shown = hits.orderBy(F.col("score").desc(), "id").offset(offset).limit(limit)
    words = "|".join(re.escape(t) for t in re.findall(r"\w+", query.lower()))
    snippet = F.regexp_extract("text", f"(?isu)(.{{0,{around}}}(?:{words}).{{0,{around}}})", 1)
    return shown.join(docs, "id").join(F.broadcast(total)).select("id", "score", "total", snippet.alias("snippet"))


def filtered(docs: DataFrame, **conditions) -> DataFrame:
    """Rows that meet all conditions given: column=value, column_from=value, column_until=value, column_has=text."""
    for name, value in conditions.items():
        if value is None:
            continue
        for suffix, test in (("_from", lambda c: F.col(c) >= value), ("_until", lambda c: F.col(c) <= value), ("_has", lambda c: F.lower(c).contains(str(value).lower()))):
            if name.endswith(suffix):
                docs = docs.filter(test(name[: -len(suffix)]))
                break
        else:
            docs = docs.filter(F.col(name) == value)
    return docs


def containing(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(term_id, id) of documents (id, text) that contain a phrase (term_id, phrase), case aside.

    Not a nested loop: a phrase meets the documents that have its rarest word, then the text is checked.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    t = terms.select("term_id", F.lower("phrase").alias("phrase"), F.explode(words(F.col("phrase"))).alias("word"))
    d = docs.select("id", F.explode(words(F.col("text"))).alias("word"))
    df = d.join(t.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rare = t.join(df, "word", "left").groupBy("term_id", "phrase").agg(F.min(F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), "word")).alias("m"))
    met = rare.select("term_id", "phrase", F.col("m.word").alias("word")).join(d, "word").join(docs.select("id", "text"), "id")
    return met.filter(F.lower("text").contains(F.col("phrase"))).select("term_id", "id")
