"""Tables of the data model that the test set lacks, derived from those it has, each with the same in SQL.

* claims: the first sentence of every item with a body; the claim's id is the item's, as ``evidence_links.claim_id`` counts them;
* mentions: parties on the item of their contract, voters and sponsors on the items numbered like their session and bill;
* quotes: what stands in guillemets before a dash; those with ``прямо`` count as flagged;
* relations: parties of one contract, by their roles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import table

KINDS = (("vote_record", "проголосовали"), ("corruption_claim", "рублей"), ("public_statement", "»"))
STATUS = {"raw_signal": "unverified", "archived": "likely_false", "processed": "confirmed"}

CLAIMS = """claims as (select id, id as content_item_id, source_id, sentence as claim_text,
 case when contains(sentence, 'проголосовали') then 'vote_record' when contains(sentence, 'рублей') then 'corruption_claim' when contains(sentence, '»') then 'public_statement' else 'event_claim' end as claim_type,
 case status when 'raw_signal' then 'unverified' when 'archived' then 'likely_false' else 'confirmed' end as status, published_at
 from (select *, trim(regexp_replace(string_split_regex(body_text, '[.!?]\\s')[1], '\\s+', ' ', 'g')) as sentence from content_items where body_text <> '' ) where sentence <> '')"""
MENTIONS = """mentions as (select entity_id, content_item_id, max(c) as confidence from (
 select p.entity_id, k.content_item_id, 0.9 as c from contract_parties p join contracts k on k.id = p.contract_id
 union all select entity_id, vote_session_id, 0.8 from bill_votes union all select entity_id, bill_id, 0.7 from bill_sponsors) where entity_id in (select id from entities) and content_item_id in (select id from content_items) group by 1, 2)"""
LINKS = "links as (select distinct id, claim_id, evidence_item_id, evidence_type, evidence_class, strength from evidence_links where claim_id is not null)"
QUOTES = "quotes as (select id as content_item_id, quote, contains(quote, 'прямо') as flagged from (select id, unnest(regexp_extract_all(coalesce(body_text, ''), '«([^»]{11,})»,? — [а-яё]+', 1)) as quote from content_items))"
RELATIONS = """relations as (select distinct least(x.entity_id, y.entity_id) as a, greatest(x.entity_id, y.entity_id) as b, case when x.party_role = y.party_role then 'contradicts' else 'government_contract' end as relation_type
 from contract_parties x join contract_parties y on x.contract_id = y.contract_id and x.entity_id < y.entity_id where x.party_role is not null and y.party_role is not null)"""


def sentences(column: str) -> F.Column:
    return F.trim(F.regexp_replace(F.get(F.split(column, r"[.!?]\s"), 0), r"\s+", " "))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """(id, content_item_id, source_id, claim_text, claim_type, status, published_at)."""
    c = table(spark, d, "content_items").filter("body_text != ''").select("id", F.col("id").alias("content_item_id"), "source_id", sentences("body_text").alias("claim_text"), "status", "published_at").filter("claim_text != ''")
    kind = F.lit("event_claim")
    for name, sign in reversed(KINDS):
        kind = F.when(F.contains("claim_text", F.lit(sign)), name).otherwise(kind)
    status = F.when(F.col("status") == "raw_signal", "unverified").when(F.col("status") == "archived", "likely_false").otherwise("confirmed")
    return c.select("id", "content_item_id", "source_id", "claim_text", kind.alias("claim_type"), status.alias("status"), "published_at")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, content_item_id, confidence), one row for each entity and item, both known."""
    k = table(spark, d, "contracts").select(F.col("id").alias("contract_id"), "content_item_id")
    m = table(spark, d, "contract_parties").select("contract_id", "entity_id").join(k, "contract_id").select("entity_id", "content_item_id", F.lit(0.9).alias("c"))
    m = m.unionByName(table(spark, d, "bill_votes").select("entity_id", F.col("vote_session_id").alias("content_item_id"), F.lit(0.8).alias("c")))
    m = m.unionByName(table(spark, d, "bill_sponsors").select("entity_id", F.col("bill_id").alias("content_item_id"), F.lit(0.7).alias("c")))
    m = m.dropna().groupBy("entity_id", "content_item_id").agg(F.max("c").alias("confidence"))
    m = m.join(table(spark, d, "entities").select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return m.join(table(spark, d, "content_items").select(F.col("id").alias("content_item_id")), "content_item_id", "left_semi")


def links(spark: SparkSession, d: str) -> DataFrame:
    """Evidence links, repeated rows once."""
    return table(spark, d, "evidence_links").select("id", "claim_id", "evidence_item_id", "evidence_type", "evidence_class", "strength").filter("claim_id is not null").distinct()


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """(content_item_id, quote, flagged)."""
    q = F.explode(F.regexp_extract_all(F.coalesce("body_text", F.lit("")), F.lit("«([^»]{11,})»,? — [а-яё]+"), 1))
    return table(spark, d, "content_items").select(F.col("id").alias("content_item_id"), q.alias("quote")).withColumn("flagged", F.contains("quote", F.lit("прямо")))


def relations(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, relation_type) with a < b of parties of one contract."""
    p = table(spark, d, "contract_parties").select("contract_id", "entity_id", "party_role").dropna().distinct()
    x, y = p.toDF("c", "a", "ra"), p.toDF("c", "b", "rb")
    kind = F.when(F.col("ra") == F.col("rb"), "contradicts").otherwise("government_contract")
    return x.join(y, "c").filter("a < b").select("a", "b", kind.alias("relation_type")).distinct()
