"""Queries of the reference's data-processing operators, each with the same in DuckDB's SQL.

They run over whole tables. Sums of floats are rounded before they are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scores, text
from factloom.operators import blocks, graph, quality, relational, search, similarity
from factloom.plans.registry import Registry
from factloom.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


# ---- scans, joins, pairs ----------------------------------------------------
_SUPPLIED = "select distinct l_orderkey, l_suppkey from lineitem"
_PAIRS = f"""
with m as ({_SUPPLIED}),
p as (select a.l_suppkey as a, b.l_suppkey as b, o.o_orderkey, o.o_custkey % 20 as source, c.c_nationkey as domain, o.o_orderdate as seen
      from m a join m b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey join orders o on o.o_orderkey = a.l_orderkey join customer c on c.c_custkey = o.o_custkey)"""


def _supplier_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = relational.member_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("seen"))
    nation = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("domain"))
    p = pairs.join(orders, pairs.l_orderkey == orders.o_orderkey).join(nation, F.col("o_custkey") == F.col("c_custkey"))
    return p.select("a", "b", "o_orderkey", (F.col("o_custkey") % 20).alias("source"), "domain", "seen")


@query(f"""{_PAIRS}
select a, b, count(distinct o_orderkey) as support_items, count(distinct source) as support_sources, count(distinct domain) as support_domains,
 (case when datediff('day', min(seen)::date, max(seen)::date) <= 30 then 1.0 when datediff('day', min(seen)::date, max(seen)::date) <= 90 then 0.85
      when datediff('day', min(seen)::date, max(seen)::date) <= 180 then 0.7 when datediff('day', min(seen)::date, max(seen)::date) <= 365 then 0.5 else 0.25 end)::double as spread
from p group by a, b having count(distinct o_orderkey) >= 3 and count(distinct source) >= 2 and count(distinct domain) >= 2""")
def co_mention_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share enough items, sources and domains, with their support."""
    g = _supplier_pairs(spark, d).groupBy("a", "b").agg(
        F.count_distinct("o_orderkey").alias("support_items"), F.count_distinct("source").alias("support_sources"), F.count_distinct("domain").alias("support_domains"),
        F.datediff(F.max("seen"), F.min("seen")).alias("days"),
    )
    g = g.filter("support_items >= 3 and support_sources >= 2 and support_domains >= 2")
    return g.withColumn("spread", scores.temporal_spread(F.col("days"), F.lit(2))).drop("days")


@query("""
with v as (select user_id, date_trunc('day', ts) as s, min(event_type) as v from events where user_id is not null and ts is not null and event_type is not null group by 1, 2),
act as (select user_id from v group by 1 having count(*) >= 10),
p as (select x.user_id as a, y.user_id as b, count(*) as shared, count(*) filter (where x.v = y.v) as same
      from v x join v y on x.s = y.s and x.user_id < y.user_id where x.user_id in (select user_id from act) and y.user_id in (select user_id from act) group by 1, 2)
select a, b, shared, same, round(same / shared, 4) as ratio from p where shared >= 10 and same >= 3 and round(same / shared, 4) >= 0.4""")
def vote_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Users whose daily votes agree."""
    e = table(spark, d, "events").select(F.date_trunc("day", "ts").alias("s"), "user_id", "event_type")
    return relational.agreement(e, "s", "user_id", "event_type", 10, 3, 0.4)


@query("""
with v as (select distinct vote_session_id as s, entity_id as e, min(vote_result) as v from bill_votes where vote_session_id is not null and entity_id is not null and vote_result is not null group by 1, 2),
p as (select x.e as a, y.e as b, count(*) as shared, count(*) filter (where x.v = y.v) as same from v x join v y on x.s = y.s and x.e < y.e group by 1, 2)
select a, b, shared, same, round(same / shared, 4) as ratio from p where shared >= 2 and same >= 2""")
def deputy_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Deputies who vote the same way in at least two sessions."""
    return relational.agreement(table(spark, d, "bill_votes"), "vote_session_id", "entity_id", "vote_result", 2, 2, 0.0)


@query("""
with m as (select distinct contract_id as g, entity_id as e from contract_parties where contract_id is not null and entity_id is not null)
select least(x.e, y.e) as a, greatest(x.e, y.e) as b, x.g as contract_id from m x join m y on x.g = y.g and x.e < y.e""")
def contract_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parties of one contract, as pairs."""
    return relational.member_pairs(table(spark, d, "contract_parties"), "contract_id", "entity_id").select("a", "b", "contract_id")


@query("""
with m as (select distinct bill_id as g, sponsor_name as e from bill_sponsors where bill_id is not null and sponsor_name is not null),
fit as (select g from m group by 1 having count(*) between 2 and 12)
select x.e as a, y.e as b, count(*) as shared from m x join m y on x.g = y.g and x.e < y.e where x.g in (select g from fit) group by 1, 2 having count(*) >= 1""")
def co_sponsors(spark: SparkSession, d: str) -> DataFrame:
    """Names under the same bills of at most twelve sponsors."""
    return relational.shared_groups(table(spark, d, "bill_sponsors"), "bill_id", "sponsor_name", 1, 12)


@query("""
select s.id as source_id, s.name, count(c.id) as items, count(distinct c.content_type) as kinds, count(c.id) filter (where c.title is null) as untitled
from sources s left join content_items c on c.source_id = s.id group by 1, 2""")
def source_activity(spark: SparkSession, d: str) -> DataFrame:
    """Items of every source, also of those without any: pre-aggregated, then joined."""
    c = table(spark, d, "content_items").groupBy(F.col("source_id").alias("_s")).agg(F.count("id").alias("items"), F.count_distinct("content_type").alias("kinds"), F.count_if(F.col("title").isNull()).alias("untitled"))
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "name")
    zero = F.lit(0).cast("long")
    return s.join(c, s.source_id == c._s, "left").select("source_id", "name", *[F.coalesce(x, zero).alias(x) for x in ("items", "kinds", "untitled")])


@query("select e.id, e.canonical_name, count(distinct v.vote_session_id) as sessions from entities e join bill_votes v on v.entity_id = e.id where exists (select 1 from bill_vote_sessions s where s.id = v.vote_session_id) group by 1, 2")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the known sessions they voted in."""
    v = table(spark, d, "bill_votes").join(table(spark, d, "bill_vote_sessions").select(F.col("id").alias("vote_session_id")), "vote_session_id", "left_semi")
    n = v.groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("vote_session_id").alias("sessions"))
    return table(spark, d, "entities").select("id", "canonical_name").join(n, "id")


@query("select c.id, c.source_id from content_items c where not exists (select 1 from evidence_links l where l.evidence_item_id = c.id)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Items that are evidence of nothing."""
    links = table(spark, d, "evidence_links").select(F.col("evidence_item_id").alias("id"))
    return table(spark, d, "content_items").select("id", "source_id").join(links, "id", "left_anti")


@query("""
with b as (select user_id, ts, event_id from events where event_type = 'purchase'), a as (select user_id, ts, event_id from events where event_type = 'click')
select a.event_id, b.event_id as r_event_id from a join b on a.user_id = b.user_id and abs(epoch(a.ts)::bigint - epoch(b.ts)::bigint) <= 3 * 86400""")
def proximity_join(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and purchases of one user at most three days apart."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    kind = lambda k: e.filter(F.col("event_type") == k).drop("event_type")
    return relational.near_in_time(kind("click"), kind("purchase"), "user_id").select("event_id", "r_event_id")


# ---- writes -----------------------------------------------------------------
@query("""
with m as (select max(id) / 2 as half from raw_source_items), n as (select id, external_id, source_id, collected_at, id > half as late, row_number() over (partition by source_id, external_id, id > half order by collected_at desc, id desc) as r from raw_source_items, m where external_id is not null and source_id is not null),
k as (select *, row_number() over (partition by source_id, external_id order by late desc) as p from n where r = 1)
select source_id, external_id, id, collected_at from k where p = 1""")
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the raw items put into a table of the earlier half by source and external id: present keys are updated, others added."""
    t = table(spark, d, "raw_source_items").filter("external_id is not null and source_id is not null").select("source_id", "external_id", "id", "collected_at")
    half, order = table(spark, d, "raw_source_items").agg(F.max("id")).first()[0] / 2, [F.col("collected_at").desc_nulls_last(), F.col("id").desc()]
    old = relational.latest(t.filter(F.col("id") <= half), ["source_id", "external_id"], order)
    return relational.upsert(old, t.filter(F.col("id") > half), ["source_id", "external_id"], order)


@query("""
with g as (select id, min(id) over (partition by description) as t from entities where entity_type = 'organization' and description is not null),
m as (select coalesce(g.t, p.entity_id) as e, coalesce(g.t <> p.entity_id, false) as moved, p.contract_id as c, 0.9 as conf from contract_parties p left join g on g.id = p.entity_id where p.entity_id is not null and p.contract_id is not null),
r as (select e, c, case when moved then 0.85 else conf end as conf, row_number() over (partition by e, c order by moved, case when moved then 0.85 else conf end desc) as n from m)
select e as entity_id, c as content_item_id, round(conf, 4)::double as confidence from r where n = 1""")
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of organisations moved to the first one of the same description."""
    p = table(spark, d, "contract_parties").filter("entity_id is not null and contract_id is not null")
    m = p.select("entity_id", F.col("contract_id").alias("content_item_id"), F.lit(0.9).alias("confidence"))
    o = table(spark, d, "entities").filter("entity_type = 'organization' and description is not null").select("id", "description")
    merges = o.join(o.groupBy("description").agg(F.min("id").alias("to_id")), "description").filter("id != to_id").select(F.col("id").alias("from_id"), "to_id")
    return relational.merge_entities(m, merges).withColumn("confidence", F.round("confidence", 4))


@query("""
with g as (select id, canonical_name, min(id) over (partition by description) as t from entities where entity_type = 'organization' and description is not null) select distinct t as entity_id, canonical_name as alias from g where t <> id and canonical_name is not null""")
def merged_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The names of merged organisations as aliases of the one that stays."""
    o = table(spark, d, "entities").filter("entity_type = 'organization' and description is not null")
    merges = o.join(o.groupBy("description").agg(F.min("id").alias("to_id")), "description").filter("id != to_id").select(F.col("id").alias("from_id"), "to_id")
    return relational.merged_aliases(o, merges)


# ---- text and scalar functions ----------------------------------------------
_NORM = r"array_to_string(regexp_extract_all(regexp_replace(replace(lower(trim(regexp_replace(replace(coalesce({}, ''), '№', 'No'), '[\s\x{{A0}}]+', ' ', 'g'))), 'ё', 'е'), 'https?://\S+', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'), ' ')"
_FIRST = r"array_to_string(list_slice(string_split({}, ' '), 1, {}), ' ')"
_TITLE, _BODY = _NORM.format("title"), _NORM.format("body_text")


@query(f"select id, {_TITLE} as normalized, case when {_TITLE} = '' then 'item' else substr(replace({_TITLE}, ' ', '-'), 1, 80) end as slug from content_items")
def normalized_titles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "content_items")
    return c.select("id", text.normalize_text(F.col("title")).alias("normalized"), text.slugify(F.col("title")).alias("slug"))


_SIG = f"case when {_TITLE} <> '' then {_FIRST.format(_TITLE, 14)} else {_FIRST.format(_BODY, 14)} end"


@query(f"""
with s as (select id, {_SIG} as signature from content_items), g as (select signature, min(id) as canonical_id, count(*) as group_size from s where signature <> '' group by 1 having count(*) > 1)
select s.id, s.signature, g.canonical_id, g.group_size from s join g using (signature)""")
def title_signature_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Items of one title signature, with the least id of the group."""
    return similarity.signature_groups(table(spark, d, "content_items"))


@query(r"""
select id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) as host,
 case when url is null or trim(url) = '' then null else regexp_replace(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), '^www\.', '') end as domain from content_items""")
def domain_normalize(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "content_items")
    return c.select("id", text.source_host(F.col("url")).alias("host"), text.normalized_domain(F.col("url")).alias("domain"))


@query(r"""
with s as (select id, unnest(string_split_regex(coalesce(body_text, ''), '[.!?]\s+')) as sentence from content_items),
c as (select id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(sentence), 'ё', 'е'), '\s+', ' ', 'g')), '[«»"“”„]', '', 'g'), '[.,;:!?…]+$', ''), '\s+', ' ', 'g')) as t from s)
select sha256(t) as hash, count(*) as occurrences, count(distinct id) as items from c where len(regexp_extract_all(t, '[\p{L}\p{N}_-]+')) >= 4 group by t having count(distinct id) >= 2""")
def claim_clusters_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the same canonical form in two items or more."""
    # the form is made inside the generator, once a sentence; groups go by its hash
    parts = F.transform(F.split(F.coalesce("body_text", F.lit("")), r"[.!?]\s+"), lambda s: text.canonical_form(s))
    c = table(spark, d, "content_items").select("id", F.explode(parts).alias("t"))
    c = c.filter(text.claim_words(F.col("t")) >= 4).select("id", F.unhex(text.canonical_hash(F.col("t"))).alias("h"))
    g = c.groupBy("h").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("id").alias("items")).filter("items >= 2")
    return g.select(F.lower(F.hex("h")).alias("hash"), "occurrences", "items")


@query(r"""
with t as (select id, regexp_replace(coalesce(body_text, ''), '\s+', ' ', 'g') as x from content_items)
select id, unnest(list_distinct(regexp_extract_all(x, '№ ?(\d+(?:-[А-Я])?)', 1))) as number from t""")
def document_references(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of documents that a text refers to."""
    t = F.regexp_replace(F.coalesce("body_text", F.lit("")), r"\s+", " ")
    return table(spark, d, "content_items").select("id", F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(r"№ ?(\d+(?:-[А-Я])?)"), 1))).alias("number"))


@query(r"""
select id, try_cast(replace(x, ',', '.') as double) as amount from
 (select id, unnest(regexp_extract_all(coalesce(body_text, ''), '(\d+(?:,\d+)?) (?:млн|тысяч) рублей', 1)) as x from content_items)""")
def money_parse(spark: SparkSession, d: str) -> DataFrame:
    x = F.explode(F.regexp_extract_all(F.coalesce("body_text", F.lit("")), F.lit(r"(\d+(?:,\d+)?) (?:млн|тысяч) рублей"), 1))
    return table(spark, d, "content_items").select("id", x.alias("x")).select("id", text.parse_money(F.col("x")).alias("amount"))


@query(r"""
select id, s as quote from (select id, unnest(regexp_extract_all(coalesce(body_text, ''), '«([^»]{11,300})»,? — [а-яё]+', 1)) as s from content_items)""")
def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quoted statements followed by a dash and a verb."""
    return table(spark, d, "content_items").select("id", F.explode(F.regexp_extract_all(F.coalesce("body_text", F.lit("")), F.lit("«([^»]{11,300})»,? — [а-яё]+"), 1)).alias("quote"))


_INN = r"regexp_replace(coalesce(inn, ''), '\D', '', 'g')"


@query(f"""
with p as (select distinct contract_id, party_name, {_INN} as k from contract_parties where {_INN} <> '')
select k as inn, count(distinct party_name) as spellings, count(distinct contract_id) as contracts from p group by 1 having count(distinct party_name) > 1""")
def same_inn(spark: SparkSession, d: str) -> DataFrame:
    """INNs under which several spellings stand."""
    p = table(spark, d, "contract_parties").select("contract_id", "party_name", text.normalize_inn(F.col("inn")).alias("inn")).filter("inn != ''")
    return p.groupBy("inn").agg(F.count_distinct("party_name").alias("spellings"), F.count_distinct("contract_id").alias("contracts")).filter("spellings > 1")


# ---- scores -----------------------------------------------------------------
_CRED = """round(least(1.0, case credibility_tier when 'A' then 0.9 when 'B' then 0.6 when 'C' then 0.3 when 'D' then 0.1 else 0.15 end
 + case when category like 'official%' then 0.2 else 0.0 end + case when is_official = 1 then 0.1 else 0.0 end), 4)::double"""


@query(f"select id, {_CRED} as credibility from sources")
def source_credibility(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.select("id", scores.source_credibility(F.col("credibility_tier"), F.coalesce(F.col("category").startswith("official"), F.lit(False)), F.coalesce(F.col("is_official") == 1, F.lit(False))).alias("credibility"))


@query("""
with l as (select distinct id, claim_id, evidence_item_id, evidence_class, strength, evidence_type from evidence_links),
w as (select l.claim_id, case l.evidence_class when 'hard' then 0.75 when 'support' then 0.35 when 'seed' then 0.12 else 0.35 end
 * case l.strength when 'strong' then 1.0 when 'moderate' then 0.7 when 'weak' then 0.4 else 0.7 end
 * case when l.evidence_type in ('registry_record', 'official_document') then 1.35 else 1.0 end * case when s.is_official = 1 then 1.2 else 1.0 end as w
 from l join content_items c on c.id = l.evidence_item_id join sources s on s.id = c.source_id)
select claim_id, round(least(1.0::decimal(18,6), sum(round(w, 6)::decimal(18,6))), 4)::double as score, count(*) as links from w where claim_id is not null group by 1""")
def document_evidence_score(spark: SparkSession, d: str) -> DataFrame:
    """Weight of a claim's evidence, repeated link rows counted once."""
    keep = ["id", "claim_id", "evidence_item_id", "evidence_class", "strength", "evidence_type"]
    links = table(spark, d, "evidence_links").select(*keep).distinct().filter("claim_id is not null")
    c = table(spark, d, "content_items").select(F.col("id").alias("evidence_item_id"), "source_id")
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "is_official")
    x = links.join(c, "evidence_item_id").join(s, "source_id")
    official = F.coalesce(F.col("evidence_type").isin("registry_record", "official_document"), F.lit(False))
    w = scores.evidence_weight(F.col("evidence_class"), F.col("strength"), official, F.coalesce(F.col("is_official") == 1, F.lit(False)))
    return x.groupBy("claim_id").agg(F.round(F.least(F.lit(1).cast("decimal(18,6)"), F.sum(F.round(w, 6).cast("decimal(18,6)"))), 4).cast("double").alias("score"), F.count(F.lit(1)).alias("links"))


@query("""
select event_id, round(least(0.99, greatest(0.05, 1 / (1 + exp(-(value / 1000 - 0.55) * 6)) + least(0.15, (user_id % 5) * 0.05))), 4)::double as confidence from events""")
def tag_calibration(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", scores.calibrated(F.col("value") / 1000, F.col("user_id") % 5 + 1).alias("confidence"))


@query("""
select event_id, case when v >= 0.8 then 'confirmed' when v >= 0.6 then 'likely_true' when v >= 0.4 then 'partially_confirmed' when v >= 0.2 then 'unverified' when v >= 0.1 then 'likely_false' else 'disproved' end as status
from (select event_id, value / 100 as v from events)""")
def status_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scores.banded(F.col("value") / 100, scores.STATUS, "disproved").alias("status"))


# ---- windows and samples ----------------------------------------------------
@query("""
with s as (select a.id, b.id as evidence_id, a.source_id = b.source_id as same, row_number() over (partition by a.id order by b.published_at desc nulls last, b.id) as rank
 from contracts k join content_items a on a.id = k.content_item_id join content_items b on b.source_id = a.source_id and b.id <> a.id and b.content_type <> a.content_type)
select id, evidence_id, rank::int as rank from s where rank <= 5""")
def evidence_top5(spark: SparkSession, d: str) -> DataFrame:
    """For the item of each contract, five items of the same source and another kind, newest text of time first."""
    c = table(spark, d, "content_items").select("id", "source_id", "content_type", "published_at")
    k = table(spark, d, "contracts").select(F.col("content_item_id").alias("id"))
    a = c.join(k, "id").select("id", "source_id", F.col("content_type").alias("kind"))
    b = c.select(F.col("id").alias("evidence_id"), "source_id", "content_type", "published_at")
    # of a source's kind only the first six can be among an item's five (one may be itself)
    b = relational.top_per(b, ["source_id", "content_type"], [F.col("published_at").desc_nulls_last(), F.col("evidence_id")], 6).drop("rank")
    x = a.join(b, "source_id").filter("evidence_id != id and content_type != kind")
    return relational.top_per(x, ["id"], [F.col("published_at").desc_nulls_last(), F.col("evidence_id")], 5).select("id", "evidence_id", "rank")


@query("""
select user_id, event_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as sort_order, first_value(event_id) over (partition by user_id order by ts, event_id) as origin from events""")
def event_timeline(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("sort_order"), F.first("event_id").over(w).alias("origin"))


@query("""
with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id) as rank from events)
select a.user_id, a.event_id, b.event_id as n_event_id from r a join r b on a.user_id = b.user_id and b.rank between a.rank + 1 and a.rank + 9 and b.rank <= 50 and a.rank <= 50 where a.event_type = 'refund' and b.event_type = 'purchase' or a.event_type = 'error' and b.event_type = 'click'""")
def sliding_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Each of a user's fifty newest events against the next nine, where their kinds contradict."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    x = relational.following(e, "user_id", [F.col("ts").desc(), F.col("event_id")], 9, 50)
    bad = "event_type = 'refund' and n_event_type = 'purchase' or event_type = 'error' and n_event_type = 'click'"
    return x.filter(bad).select("user_id", "event_id", "n_event_id")


@query("""
with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id) as rank from events)
select a.user_id, a.event_id, b.event_id as n_event_id from r a join r b on a.user_id = b.user_id and b.rank between a.rank + 1 and a.rank + 9 where a.event_type = 'refund' and b.event_type = 'purchase' or a.event_type = 'error' and b.event_type = 'click'""")
def sliding_contradictions_all(spark: SparkSession, d: str) -> DataFrame:
    """Each of a user's events against the next nine, where their kinds contradict."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    x = relational.following(e, "user_id", [F.col("ts").desc(), F.col("event_id")], 9)
    bad = "event_type = 'refund' and n_event_type = 'purchase' or event_type = 'error' and n_event_type = 'click'"
    return x.filter(bad).select("user_id", "event_id", "n_event_id")


@query("""
with r as (select doc_id, coalesce(lang, 'unknown') as lang, row_number() over (partition by coalesce(lang, 'unknown') order by doc_id) as turn from documents)
select doc_id, lang, turn::int as turn from r order by r.turn, lang limit 60""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of sixty documents that takes languages in turn."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"))
    return relational.round_robin(docs, "lang", [F.col("doc_id")], 60).select("doc_id", "lang", "turn")


@query("""
with r as (select doc_id, source, sha256('s1:' || doc_id::varchar) as h from documents), q as (select *, row_number() over (partition by source order by h, doc_id) <= 3 as by_quota from r)
select doc_id, by_quota from q order by by_quota desc, h, doc_id limit 100""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three documents a source by a stable hash, filled up to a hundred."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return relational.quota_sample(docs, "source", "doc_id", 3, 100, "s1").select("doc_id", "by_quota")


@query("""
with a as (select coalesce(content_type, 'unknown') as l, count(*) as n from documents group by 1), b as (select coalesce(content_type, 'unknown') as l, count(*) as n from content_items group by 1)
select round(0.5 * sum(abs(coalesce(a.n, 0) / (select sum(n) from a) - coalesce(b.n, 0) / (select sum(n) from b))), 4) as distance from a full join b using (l)""")
def drift_tvd(spark: SparkSession, d: str) -> DataFrame:
    """How far the kinds of documents are from those of content items."""
    n = lambda t: table(spark, d, t).groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))
    return relational.total_variation(n("documents"), n("content_items"), "content_type", "n")


# ---- graph ------------------------------------------------------------------
_EDGES = "(select distinct contract_id as c, entity_id as e from contract_parties where contract_id is not null and entity_id is not null)"


def _entity_edges(spark: SparkSession, d: str) -> DataFrame:
    return contract_pairs(spark, d).select("a", "b").distinct()


_PAIR_SQL = f"(select distinct x.e as a, y.e as b from {_EDGES} x join {_EDGES} y on x.c = y.c and x.e < y.e)"


@query(f"""
with e as {_PAIR_SQL}, u as (select a as id from e union all select b from e), g as (select id, count(*) as degree from u group by 1)
select id, degree from g order by degree desc, id limit 20""")
def top_hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_entity_edges(spark, d), "a", "b").orderBy(F.col("degree").desc(), "id").limit(20)


@query(f"select id, entity_type from entities where id not in (select a from {_PAIR_SQL} union select b from {_PAIR_SQL})")
def isolated_entities(spark: SparkSession, d: str) -> DataFrame:
    ends = _entity_edges(spark, d).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return table(spark, d, "entities").select("id", "entity_type").join(ends, "id", "left_anti")


@query(f"""
with recursive e as {_PAIR_SQL}, l as (select a as x, b as y from e union select b, a from e), r as (select x as id, x as m from l union select l.y, r.m from r join l on l.x = r.id)
select id, min(m) as component from r group by 1""")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_entity_edges(spark, d))


@query(f"""
with recursive e as {_PAIR_SQL}, l as (select a as x, b as y from e union select b, a from e),
s as (select min(entity_id) as id from contract_parties where entity_id is not null and contract_id is not null), r as (select id, 0 as hop from s union select l.y, hop + 1 from r join l on l.x = r.id where hop < 3)
select id, min(hop)::int as hop from r group by 1""")
def bfs_hops(spark: SparkSession, d: str) -> DataFrame:
    """Entities within three hops of the least one that is a party."""
    p = table(spark, d, "contract_parties").filter("entity_id is not null and contract_id is not null")
    return graph.hops(_entity_edges(spark, d), p.agg(F.min("entity_id").alias("id")), "a", "b")


@query()
def evidence_chains(spark: SparkSession, d: str) -> DataFrame:
    """The best chains of contract partners from the least party that has one."""
    edges = contract_pairs(spark, d).groupBy("a", "b").agg((F.lit(1.0) - F.lit(1.0) / (F.count(F.lit(1)) + 1)).alias("w"))
    return graph.chains(edges, edges.agg(F.min("a").alias("id")), "a", "b", "w")


@query(f"""
with m as {_EDGES}, n as (select c, count(*)::double as cost from m group by 1),
p as {_PAIR_SQL}, b as (select p.a, p.b, x.c as via, n.cost * 2 as cost, row_number() over (partition by p.a, p.b order by n.cost * 2, x.c) as r from p join m x on x.e = p.a join m y on y.e = p.b and y.c = x.c join n on n.c = x.c)
select a, b, via, cost from b where r = 1""")
def best_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The contract with fewest parties that joins each pair."""
    m = table(spark, d, "contract_parties").select(F.col("contract_id").alias("c"), F.col("entity_id").alias("e")).dropna().distinct()
    cost = m.groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("cost"))
    return graph.best_bridge(_entity_edges(spark, d), m.join(cost, "c"), "c", "e", "cost")


# ---- similarity and search --------------------------------------------------
@query(r"""
with d as (select item_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as w from benchmark), n as (select count(*) as n from benchmark),
t as (select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]))) as term from d), tf as (select id, term, count(*) as tf from t group by 1, 2),
idf as (select term, ln((1 + n) / (1 + count(*))) + 1 as idf, count(*) as df from tf, n group by term, n),
x as (select id, term, tf * idf as x, df from tf join idf using (term)), l as (select id, sqrt(sum(x * x)) as l from x group by 1), w as (select x.id, term, x / l as w from x join l using (id) where df > 1),
s as (select a.id, b.id as neighbour, round(sum(a.w * b.w), 4) as score from w a join w b on a.term = b.term and a.id <> b.id group by 1, 2),
r as (select *, row_number() over (partition by id order by score desc, neighbour desc) as rank from s where score >= 0.22)
select id, neighbour, score, rank::int as rank from r where rank <= 5""")
def tfidf_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest test passages of each, by TF-IDF."""
    return blocks.neighbours(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


def _near_sql(kind: str, docs: str, asked: str, least: float) -> str:
    return rf"""
select '{kind}' as kind, id, neighbour, score, rank::int as rank from (
with t0 as ({docs}), d as (select id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') as w from t0), n as (select count(*) as n from t0),
t as (select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]))) as term from d), tf as (select id, term, count(*) as tf from t group by 1, 2),
idf as (select term, ln((1 + n) / (1 + count(*))) + 1 as idf from tf, n group by term, n),
x as (select id, term, tf * idf as x from tf join idf using (term)), l as (select id, sqrt(sum(x * x)) as l from x group by 1), w as (select x.id, term, x / l as w from x join l using (id)),
s as (select a.id, b.id as neighbour, round(sum(a.w * b.w), 4) as score from w a join w b on a.term = b.term and a.id <> b.id where {asked} group by 1, 2)
select *, row_number() over (partition by id order by score desc, neighbour desc) as rank from s where score >= {least}) where rank <= 5"""


_ITEM_TEXT = "select id, coalesce(title, '') || ' ' || coalesce(body_text, '') as text from content_items"
_ENTITY_TEXT = "select id, coalesce(canonical_name, '') || ' ' || coalesce(description, '') as text from entities"


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("id", F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]).alias("text"))


@query(_near_sql("content", _ITEM_TEXT, "a.id % 20 = 0", 0.22) + " union all " + _near_sql("entity", _ENTITY_TEXT, "true", 0.4))
def tfidf_neighbors_items(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest content items of every twentieth among all, and the five nearest entities of each, by TF-IDF."""
    items = _joined(table(spark, d, "content_items"), "title", "body_text")
    near = blocks.neighbours(items, items.filter("id % 20 = 0").select("id")).select(F.lit("content").alias("kind"), "*")
    entities = blocks.neighbours(_joined(table(spark, d, "entities"), "canonical_name", "description"), threshold=0.4)
    return near.unionByName(entities.select(F.lit("entity").alias("kind"), "*"))


@query(r"""
with d as (select id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body_text, '')), '[\p{L}\p{N}_]+') as w from content_items), s as (select count(*) as n, avg(len(w)) as a from d where len(w) > 0),
p as (select id, len(w) as l, term, count(*) as tf from (select id, w, unnest(w) as term from d) group by 1, 2, 3), h as (select * from p where term in ('ремонте', 'больниц')), f as (select term, count(*) as df from h group by 1),
x as (select id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) as score, count(*) as c from h join f using (term), s group by 1)
select id, score from x where c = 2 order by score desc, id limit 20""")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best items for two words."""
    c = table(spark, d, "content_items")
    return search.bm25(c.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body_text", F.lit(""))).alias("text")), "больниц ремонте")


@query(r"""
with d as (select id, title, body_text, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body_text, '')), '[\p{L}\p{N}_]+') as w from content_items), s as (select count(*) as n, avg(len(w)) as a from d where len(w) > 0),
p as (select id, len(w) as l, term, count(*) as tf from (select id, w, unnest(w) as term from d) group by 1, 2, 3), f as (select term, count(*) as df from p group by 1),
q as (select distinct id as query_id, unnest(regexp_extract_all(lower(case when regexp_matches(coalesce(title, ''), '[\p{L}\p{N}_]') then title else body_text end), '[\p{L}\p{N}_]+')) as term from d where id % 20 = 0), c as (select query_id, count(*) as terms from q group by 1),
x as (select query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) as score, count(*) as c from q join p using (term) join f using (term), s group by 1, 2),
r as (select x.query_id, id, score, row_number() over (partition by x.query_id order by score desc, id) as rank from x join c on c.query_id = x.query_id and c.terms = x.c)
select query_id, id, score, rank::int as rank from r where rank <= 20""")
def bm25_search_all(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best items for the title (where it has no word, the body) of every twentieth item."""
    c = table(spark, d, "content_items")
    asked = c.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.when(F.coalesce("title", F.lit("")).rlike(r"[\p{L}\p{N}_]"), F.col("title")).otherwise(F.col("body_text")).alias("text"))
    return blocks.searches(_joined(c, "title", "body_text"), asked).select("query_id", "id", "score", "rank")


@query("select id, source_id, content_type from content_items where content_type = 'article' and status = 'archived' and lower(title) like '%район%' order by id limit 50 offset 5")
def filtered_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of items under three conditions."""
    c = search.filtered(table(spark, d, "content_items"), content_type="article", status="archived", title_has="район")
    return c.select("id", "source_id", "content_type").orderBy("id").offset(5).limit(50)


@query("select s.id as term_id, c.id from sources s join content_items c on contains(lower(c.body_text), lower(s.name)) where regexp_matches(s.name, '\\S')")
def phrase_in_items(spark: SparkSession, d: str) -> DataFrame:
    """Items whose body names a source."""
    s = table(spark, d, "sources").select(F.col("id").alias("term_id"), F.col("name").alias("phrase")).filter(F.col("phrase").rlike(r"\S"))
    return search.containing(s, table(spark, d, "content_items").filter("body_text is not null").select("id", F.col("body_text").alias("text")))


@query("""
with m as (select entity_id as id, count(*) as mentions from (select entity_id from bill_votes union all select entity_id from bill_sponsors union all select entity_id from contract_parties) where entity_id is not null group by 1)
select e.id, e.canonical_name, coalesce(m.mentions, 0) as mentions from entities e left join m using (id) where e.canonical_name like '%Озёрн%'""")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Entities by a part of the name, with their mentions counted beforehand."""
    ids = [table(spark, d, t).select(F.col("entity_id").alias("id")) for t in ("bill_votes", "bill_sponsors", "contract_parties")]
    n = ids[0].unionByName(ids[1]).unionByName(ids[2]).groupBy("id").agg(F.count(F.lit(1)).alias("mentions"))
    e = table(spark, d, "entities").filter(F.col("canonical_name").contains("Озёрн")).select("id", "canonical_name")
    return e.join(n, "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0).cast("long")))


# ---- tags and quality -------------------------------------------------------
RULES = [
    ("budget", [("бюджет", 2.0), ("рублей", 1.5), ("смет", 1.0)], 2.0),
    ("vote", [("голосовал", 3.0), ("депутат", 1.0)], 3.0),
    ("works", [("ремонт", 2.0), ("реконструкци", 2.0), ("мост", 0.5)], 2.0),
    ("health", [("больниц", 2.0)], 2.0),
    ("road", [("дорог", 2.0), ("теплотрасс", 2.0)], 2.0),
]


def _rule_sql(rules) -> str:
    parts = []
    for tag, patterns, least in rules:
        score = " + ".join(
            f"case when {f'contains(t, {p!r})' if len(p) > 4 else f'regexp_matches(t, {chr(39)}(^|[^\\p{{L}}\\p{{N}}_]){p}{chr(39)})'} then {points} else 0.0 end" for p, points in patterns
        )
        parts.append(f"select id, '{tag}' as tag, ({score})::double as score, {least} as least from d")
    return "with d as (select id, lower(coalesce(body_text, '')) as t from content_items), s as (" + " union all ".join(parts) + ")"


_RULES = _rule_sql(RULES)


@query(f"{_RULES}, r as (select id, tag, score, row_number() over (partition by id order by score desc, tag) as n from s where score > 0 and score >= least) select id, tag, score from r where n <= 4")
def rule_tagger(spark: SparkSession, d: str) -> DataFrame:
    return quality.rule_scores(table(spark, d, "content_items").select("id", F.col("body_text").alias("text")), RULES)


@query(f"""{_RULES}, r as (select id, tag, score, row_number() over (partition by id order by score desc, tag) as n from s where score > 0 and score >= least),
h as (select id, list(tag) as h from r where n <= 4 group by 1), x as (select id, (list_contains(h, 'works')::int + list_contains(h, 'budget')::int + list_contains(h, 'road')::int) as n, list_contains(h, 'vote') or list_contains(h, 'budget') as ok from h)
select id, 'public_works' as tag, round(least(1.0, n / 1.5), 2)::double as confidence from x where n >= 2 and ok""")
def derived_tags(spark: SparkSession, d: str) -> DataFrame:
    patterns = [{"tag": "public_works", "any": ["works", "budget", "road"], "least": 2, "required": [["vote", "budget"]]}]
    return quality.derived_tags(rule_tagger(spark, d), patterns)


@query("""
select 'no_body' as "check", (count(*) filter (where body_text is null or body_text = '') / count(*))::double as value, 0.2::double as "limit", (count(*) filter (where body_text is null or body_text = '') / count(*)) <= 0.2 as ok from content_items
union all select 'no_title', (count(*) filter (where title is null) / count(*))::double, 0.02::double, (count(*) filter (where title is null) / count(*)) <= 0.02 from content_items
union all select 'sources', count(distinct source_id)::double, 30.0::double, count(distinct source_id) <= 30 from content_items""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    body = F.col("body_text")
    return quality.gate(table(spark, d, "content_items"), {"no_body": (share(body.isNull() | (body == "")), 0.2), "no_title": (share(F.col("title").isNull()), 0.02), "sources": (F.count_distinct("source_id"), 30)})


@query("""
select result as kind, count(*) as reviewed, round(avg(case vote_result when 'за' then 1.0 when 'воздержался' then 0.5 else 0.0 end), 4) as precision
from bill_votes v join bill_vote_sessions s on s.id = v.vote_session_id where vote_result in ('за', 'воздержался', 'против') and result is not null group by 1""")
def review_precision(spark: SparkSession, d: str) -> DataFrame:
    """Votes as verdicts, by the session's result."""
    v = table(spark, d, "bill_votes").join(table(spark, d, "bill_vote_sessions").select(F.col("id").alias("vote_session_id"), F.col("result").alias("kind")), "vote_session_id")
    verdict = F.element_at(F.create_map(*map(F.lit, ("за", "correct", "воздержался", "partially", "против", "wrong", "не голосовал", "none"))), F.col("vote_result"))
    return quality.precision(v.filter("kind is not null and vote_result in ('за', 'воздержался', 'против')").select("kind", verdict.alias("verdict")))


@query("""
select duma_session, vote_stage, grouping(duma_session, vote_stage)::bigint as level, count(*) as sessions, sum(total_for)::bigint as total_for
from bill_vote_sessions group by rollup (duma_session, vote_stage)""")
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "bill_vote_sessions")
    return s.rollup("duma_session", "vote_stage").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("sessions"), F.sum("total_for").alias("total_for"))


@query("""
select entity_id, count(distinct vote_session_id) as votes, count(*) filter (where vote_result = 'за') as agreed, string_agg(distinct faction, ', ' order by faction) as factions
from (select distinct id, entity_id, vote_session_id, vote_result, faction from bill_votes) where entity_id is not null group by 1""")
def deputy_scorecard(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "bill_votes").select("id", "entity_id", "vote_session_id", "vote_result", "faction").distinct().filter("entity_id is not null")
    factions = F.array_join(F.sort_array(F.collect_set("faction")), ", ")
    return v.groupBy("entity_id").agg(F.count_distinct("vote_session_id").alias("votes"), F.count_if(F.col("vote_result") == "за").alias("agreed"), F.nullif(factions, F.lit("")).alias("factions"))


@query("""
select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    from factloom.streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "1 hour")


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events where ts is not null and user_id is not null),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as first_ts, count(*) as n from s group by user_id, k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    from factloom.streaming.windows import sessions

    return sessions(table(spark, d, "events").filter("user_id is not null and ts is not null"), "30 minutes")
