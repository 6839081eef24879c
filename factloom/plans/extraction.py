"""Queries of extraction and event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.functions.scores import jaccard
from factloom.operators import extraction, graph, relational, similarity
from factloom.plans.reference import contract_pairs
from factloom.plans.registry import Registry
from factloom.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


CLAIMS = (("vote", "проголосовали [0-9]+"), ("money", "[0-9]+ (?:млн|тысяч) рублей"), ("statement", "» ?,? — "), ("document", "Документ № "))
_SQL_KINDS = "list_filter([" + ", ".join(f"case when regexp_matches(s, '{p}') then '{k}' end" for k, p in CLAIMS) + "], lambda x : x is not null)"


@query(f"""
with s as (select id, trim(regexp_replace(x, '\\s+', ' ', 'g')) as s from (select id, unnest(string_split_regex(regexp_replace(coalesce(body_text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+')) as x from content_items)),
k as (select id, unnest({_SQL_KINDS}) as kind, substr(s, 1, 700) as sentence from s where length(s) >= 25)
select kind, count(*) as claims, count(distinct id) as items from (select distinct id, kind, lower(sentence) as l from k) group by 1""")
def sentence_claims(spark: SparkSession, d: str) -> DataFrame:
    """Typed sentences of all items, counted by kind."""
    c = extraction.typed_sentences(table(spark, d, "content_items").select("id", F.col("body_text").alias("text")), CLAIMS)
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("claims"), F.count_distinct("id").alias("items"))


IDENTIFIERS = (("document", r"№ (\d+-[А-Я])"), ("year", r"\b((?:19|20)\d{2})\b"), ("amount", r"(\d+(?:,\d+)?) млн"))


@query("with t as (select doc_id, coalesce(text, '') as t from documents) " + " union all ".join(f"select doc_id, '{k}' as kind, unnest(list_distinct(regexp_extract_all(t, '{p}', 1))) as value from t" for k, p in IDENTIFIERS))
def regex_entities(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers in documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return extraction.identifiers(docs, IDENTIFIERS).withColumnRenamed("id", "doc_id")


@query("""
with g as (select id, regexp_extract(lower(coalesce(body_text, '')), '^(.*?)выполнил', 1, 's') as p, contains(lower(coalesce(body_text, '')), 'выполнил') as has from content_items)
select id, has and contains(right(p, 12), 'не ') as negated from (select id, has, case when has then right(p, 40) else '' end as p from g)""")
def negation_window(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first "выполнил" of an item is negated."""
    n = text.negated(F.coalesce("body_text", F.lit("")), "выполнил", ("не ",), 40, 9)
    return table(spark, d, "content_items").select("id", n.alias("negated"))


@query("""
with o as (select c.source_id, c.id, coalesce(c.collected_at, '') as seen, c.content_type = 'bill_note' as official from content_items c where c.source_id is not null),
r as (select *, row_number() over (partition by source_id order by seen, id) - 1 as sort_order from o), f as (select *, min(case when not official then sort_order end) over (partition by source_id) as first from r)
select source_id, id, sort_order::int as sort_order, case when official then 'official_doc' when sort_order = first then 'origin' else 'update' end as role from f""")
def event_roles(spark: SparkSession, d: str) -> DataFrame:
    """Every source's items in order of their collection text, with roles."""
    c = table(spark, d, "content_items").filter("source_id is not null").select("source_id", "id", F.coalesce("collected_at", F.lit("")).alias("at"), F.coalesce(F.col("content_type") == "bill_note", F.lit(False)).alias("official"))
    return extraction.event_groups(c, "source_id", F.col("official"), ["at", "id"]).select("source_id", "id", "sort_order", "role")


@query("select source_id, max(id) as cursor, max(collected_at) as last_at, count(*) as items from raw_source_items where source_id is not null group by 1")
def source_cursors(spark: SparkSession, d: str) -> DataFrame:
    """How far each source has been read."""
    return extraction.sync_state(table(spark, d, "raw_source_items").filter("source_id is not null"), "source_id", "id", "collected_at")


@query("""
with r as (select *, row_number() over (partition by bill_id, vote_stage order by updated_at desc, id desc) as n from bill_vote_sessions)
select bill_id, vote_stage, id, result from r where n = 1""")
def latest_session(spark: SparkSession, d: str) -> DataFrame:
    """The session of each bill and stage that was updated last."""
    s = table(spark, d, "bill_vote_sessions").select("bill_id", "vote_stage", "id", "result", "updated_at")
    return relational.latest(s, ["bill_id", "vote_stage"], [F.col("updated_at").desc_nulls_last(), F.col("id").desc()]).drop("updated_at")


@query("""
with m as (select entity_id as e, list_sort(list(distinct contract_id)) as c from contract_parties where entity_id is not null and contract_id is not null group by 1),
p as (select distinct x.entity_id as a, y.entity_id as b from contract_parties x join contract_parties y on x.contract_id = y.contract_id and x.entity_id < y.entity_id)
select a, b, round(len(list_intersect(x.c, y.c)) / len(list_distinct(list_concat(x.c, y.c))), 4)::double as similarity from p join m x on x.e = a join m y on y.e = b""")
def jaccard_sets(spark: SparkSession, d: str) -> DataFrame:
    """How far the contracts of two partners are the same."""
    p = table(spark, d, "contract_parties").filter("entity_id is not null and contract_id is not null")
    m = p.groupBy(F.col("entity_id").alias("e")).agg(F.collect_set("contract_id").alias("c"))
    pairs = contract_pairs(spark, d).select("a", "b").distinct()
    x = pairs.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b")
    return x.select("a", "b", jaccard(F.col("ca"), F.col("cb")).alias("similarity"))


@query("""
with e as (select entity_id as this, bill_id as other from bill_sponsors where entity_id is not null and bill_id is not null union select bill_id, entity_id from bill_sponsors where entity_id is not null and bill_id is not null)
select this, count(*) as others from e group by 1""")
def or_join(spark: SparkSession, d: str) -> DataFrame:
    """Edges seen from either end, each once."""
    e = table(spark, d, "bill_sponsors").filter("entity_id is not null and bill_id is not null")
    return relational.either_end(e, "entity_id", "bill_id").distinct().groupBy("this").agg(F.count(F.lit(1)).alias("others"))


@query("""
select source_id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) as domain, min(title) as least_title, max(length(coalesce(body_text, '')))::int as longest, approx from
 (select source_id, url, title, body_text, 0 as approx from content_items where url is not null and source_id is not null) group by source_id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)), approx""")
def domain_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per source and host: least title and longest body."""
    c = table(spark, d, "content_items").filter("url is not null and source_id is not null")
    g = c.groupBy("source_id", text.source_host(F.col("url")).alias("domain"))
    return g.agg(F.min("title").alias("least_title"), F.max(F.length(F.coalesce("body_text", F.lit("")))).alias("longest"), F.lit(0).alias("approx"))


@query()
def signature_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Members of signature groups against the group's least item."""
    c = table(spark, d, "content_items")
    return extraction.signature_similarity(similarity.signature_groups(c), c)


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of contract partners."""
    return graph.communities(contract_pairs(spark, d).select("a", "b").distinct())
