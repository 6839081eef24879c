"""Queries of the edge table, walks over it, and candidate relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import edges as x
from factloom.operators import relations as r
from factloom.plans import domain
from factloom.plans.reference import deputy_agreement
from factloom.plans.registry import Registry
from factloom.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _both(select: str) -> str:
    return f"(select src, dst, relation_type, context, strength from ({select}) union all select dst, src, relation_type, context, strength from ({select}))"


_EDGE_PARTS = f"""
e1 as {_both("select 'entity:' || a as src, 'entity:' || b as dst, relation_type, 'relation' as context, 0.9 as strength from relations")},
sp as (select distinct bill_id, entity_id from bill_sponsors where bill_id is not null and entity_id is not null), fit as (select bill_id from sp group by 1 having count(*) between 2 and 12),
e2 as {_both("select 'entity:' || entity_id as src, 'bill:' || bill_id as dst, 'sponsored_bill' as relation_type, 'sponsor' as context, 0.9 as strength from sp")},
e3 as {_both("select 'entity:' || p.entity_id as src, 'entity:' || q.entity_id as dst, 'co_sponsor' as relation_type, count(*)::varchar as context, 0.6 as strength from sp p join sp q on p.bill_id = q.bill_id and p.entity_id < q.entity_id where p.bill_id in (select bill_id from fit) group by 1, 2")},
vo as (select entity_id, vote_session_id, min(vote_result) as r from bill_votes where entity_id is not null and vote_session_id is not null and vote_result is not null group by 1, 2),
e4 as (select 'entity:' || entity_id as src, 'session:' || vote_session_id as dst, 'voted_' || r as relation_type, 'vote' as context, 0.8 as strength from (select *, row_number() over (partition by entity_id order by vote_session_id desc) as n from vo) where n <= 200),
e5 as {_both("select distinct 'session:' || id as src, 'bill:' || bill_id as dst, 'about_bill' as relation_type, 'session' as context, 1.0 as strength from bill_vote_sessions where bill_id is not null")},
av as (select p.entity_id as a, q.entity_id as b, count(*) filter (where p.r = q.r) as same, count(*) as shared from vo p join vo q on p.vote_session_id = q.vote_session_id and p.entity_id <> q.entity_id group by 1, 2),
e6 as (select 'entity:' || a as src, 'entity:' || b as dst, 'co_voter' as relation_type, same::varchar as context, 0.5 as strength from (select *, row_number() over (partition by a order by same desc, b) as n from av where same >= 3 and shared >= 2) where n <= 50),
mt as (select p.entity_id as a, q.entity_id as b, count(*) as shared from mentions p join mentions q on p.content_item_id = q.content_item_id and p.entity_id <> q.entity_id group by 1, 2 having count(*) >= 2),
e7 as (select 'entity:' || a as src, 'entity:' || b as dst, 'mentioned_together' as relation_type, shared::varchar as context, 0.3 as strength from (select *, row_number() over (partition by a order by shared desc, b) as n from mt) where n <= 50),
e8 as (select 'item:' || content_item_id as src, 'entity:' || entity_id as dst, 'mentions_entity' as relation_type, 'mention' as context, confidence as strength from (select *, row_number() over (partition by content_item_id order by confidence desc, entity_id) as n from mentions) where n <= 80),
cp as (select distinct contract_id, entity_id from contract_parties where contract_id is not null and entity_id is not null),
e9 as {_both("select 'entity:' || entity_id as src, 'contract:' || contract_id as dst, 'government_contract' as relation_type, 'party' as context, 0.9 as strength from cp")},
ci as (select distinct entity_id, regexp_replace(inn, '\\D', '', 'g') as inn from contract_parties where entity_id is not null and regexp_replace(inn, '\\D', '', 'g') <> ''),
e10 as {_both("select distinct 'entity:' || p.entity_id as src, 'entity:' || q.entity_id as dst, 'same_inn' as relation_type, 'inn' as context, 0.95 as strength from ci p join ci q on p.inn = q.inn and p.entity_id < q.entity_id")},
lc as (select claim_id, count(distinct evidence_item_id) as n from links group by 1),
hc as (select m.entity_id, c.id, coalesce(lc.n, 0) as n from claims c join mentions m on m.content_item_id = c.content_item_id left join lc on lc.claim_id = c.id),
e11 as (select 'entity:' || entity_id as src, 'claim:' || id as dst, 'has_claim' as relation_type, n::varchar as context, 0.7 as strength from (select *, row_number() over (partition by entity_id order by n desc, id) as k from hc) where k <= 150),
e12 as (select 'claim:' || id as src, 'item:' || content_item_id as dst, 'reported_in' as relation_type, 'claim' as context, 1.0 as strength from claims),
e13 as (select distinct 'claim:' || claim_id as src, 'item:' || evidence_item_id as dst, 'has_evidence' as relation_type, 'link' as context, 0.8 as strength from links where claim_id in (select id from claims) and evidence_item_id is not null),
edges as ({" union all ".join(f"select src, dst, relation_type, context, strength::double as strength from e{i}" for i in range(1, 14))})"""
_DOMAIN = ", ".join((domain.CLAIMS, domain.MENTIONS, domain.LINKS, domain.RELATIONS))
_MERGED = f"""{_DOMAIN}, {_EDGE_PARTS},
merged as (select src, dst, relation_type, max(strength) as strength, count(*) as merged, coalesce(array_to_string(list_slice(list_sort(list(distinct context) filter (where context <> '')), 1, 20), ','), '') as contexts from edges group by 1, 2, 3)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    m, c = domain.mentions(spark, d), domain.claims(spark, d)
    parts = [
        x.stored_relations(domain.relations(spark, d)), x.sponsor_edges(t("bill_sponsors")), x.vote_edges(t("bill_votes"), t("bill_vote_sessions")), x.co_voters(deputy_agreement(spark, d)),
        x.mention_edges(m), x.contract_edges(t("contract_parties")), x.claim_edges(c, m, domain.links(spark, d)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"with {_MERGED} select * from merged")
def unified_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges, one for each pair of nodes and type."""
    return x.merged(_edges(spark, d))


@query(f"""
with recursive {_MERGED}, s as (select 'entity:' || min(entity_id) as node from contract_parties where entity_id is not null and contract_id is not null),
f as (select * from merged where strength >= 0.6), w as (select node, 0 as hop from s union select f.dst, w.hop + 1 from w join f on f.src = w.node where w.hop < 3), n as (select node, min(hop) as hop from w group by 1)
select src, dst, relation_type, strength, (hop + 1)::int as hop from n join f on f.src = n.node where hop < 3""")
def investigate(spark: SparkSession, d: str) -> DataFrame:
    """All edges within three hops of the least party, of strength .6 or more (no cap on nodes and edges here)."""
    return _investigated(spark, d, None, None)


def _investigated(spark: SparkSession, d: str, nodes: int | None, edges: int | None) -> DataFrame:
    p = table(spark, d, "contract_parties").filter("entity_id is not null and contract_id is not null").agg(F.min("entity_id").alias("id"))
    return x.investigation(unified_edges(spark, d), p.select(x.node("entity", "id").alias("node")), least=0.6, most_nodes=nodes, most_edges=edges)


@query(f"""
with recursive {_MERGED}, s as (select 'entity:' || min(entity_id) as node from contract_parties where entity_id is not null and contract_id is not null),
f as (select * from merged where strength >= 0.6), w as (select node, 0 as hop from s union select f.dst, w.hop + 1 from w join f on f.src = w.node where w.hop < 3), n as (select node, min(hop) as hop from w group by 1),
g as (select src, dst, relation_type, hop + 1 as hop from n join f on f.src = n.node where hop < 3)
select 'relation' as what, relation_type as name, count(*) as n from g group by 2 union all select 'hop', hop::varchar, count(*) from g group by 2
union all select 'node', split_part(node, ':', 1), count(*) from (select src as node from g union select dst from g) group by 2""")
def investigation_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What an investigation met, counted."""
    return x.statistics(investigate(spark, d))


# ---- candidate relations ----------------------------------------------------
_SEEDS = f"""{_DOMAIN}, cp as (select distinct contract_id as g, entity_id as e from contract_parties where contract_id is not null and entity_id is not null), sp as (select distinct bill_id as g, entity_id as e from bill_sponsors where bill_id is not null and entity_id is not null),
sfit as (select g from sp group by 1 having count(*) between 2 and 60), vo as (select vote_session_id as g, entity_id as e, min(vote_result) as r from bill_votes where entity_id is not null and vote_session_id is not null and vote_result is not null group by 1, 2),
cm as (select distinct content_item_id as g, entity_id as e from mentions),
seeds as (
 select 'contract' as seed, x.e as a, y.e as b, count(*) as n from cp x join cp y on x.g = y.g and x.e < y.e group by 2, 3
 union all select 'bill', x.e, y.e, count(*) from sp x join sp y on x.g = y.g and x.e < y.e where x.g in (select g from sfit) group by 2, 3 having count(*) >= 2
 union all select 'vote', x.e, y.e, count(*) filter (where x.r = y.r) from vo x join vo y on x.g = y.g and x.e < y.e group by 2, 3 having count(*) >= 2 and count(*) filter (where x.r = y.r) >= 2
 union all select 'mention', x.e, y.e, count(*) from cm x join cm y on x.g = y.g and x.e < y.e group by 2, 3 having count(*) >= 2
 union all select 'restriction', a, b, 1 from relations where relation_type = 'contradicts'),
wide as (select a, b, max(case when seed = 'contract' then n end) as contract, max(case when seed = 'bill' then n end) as bill, max(case when seed = 'vote' then n end) as vote, max(case when seed = 'mention' then n end) as mention, max(case when seed = 'restriction' then n end) as restriction from seeds group by 1, 2)"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.relational import shared_groups

    t = lambda name: table(spark, d, name)
    pairs = {
        "contract": shared_groups(t("contract_parties"), "contract_id", "entity_id", 1),
        "bill": shared_groups(t("bill_sponsors"), "bill_id", "entity_id", 2, 60),
        "vote": deputy_agreement(spark, d).select("a", "b", F.col("same").alias("shared")),
        "mention": shared_groups(domain.mentions(spark, d), "content_item_id", "entity_id", 2),
        "restriction": domain.relations(spark, d).filter("relation_type = 'contradicts'").select("a", "b", F.lit(1).cast("long").alias("shared")),
    }
    return r.wide_pairs(pairs)


@query(f"with {_SEEDS} select a, b, coalesce(contract, 0) as contract, coalesce(bill, 0) as bill, coalesce(vote, 0) as vote, coalesce(mention, 0) as mention, coalesce(restriction, 0) as restriction from wide")
def relation_seeds(spark: SparkSession, d: str) -> DataFrame:
    """One wide row for every pair that some table relates (0: the seed does not)."""
    return _seeds(spark, d).fillna(0)


_SUPPORT = f"""{_SEEDS}, cl as (select content_item_id, arg_min(claim_type, claim_type) as k from claims group by 1),
sup as (select w.a, w.b, m.content_item_id as unit, i.source_id, lower(regexp_extract(i.url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) as host, s.category, {r"case when regexp_matches(i.published_at, '^\d{4}-\d{2}-\d{2}') then try_cast(substr(i.published_at, 1, 10) as date) end"} as day,
  length(trim(coalesce(i.title, ''))) + length(trim(coalesce(i.body_text, ''))) as size
 from wide w join mentions m on m.entity_id = w.a join mentions n on n.entity_id = w.b and n.content_item_id = m.content_item_id join content_items i on i.id = m.content_item_id left join sources s on s.id = i.source_id),
g as (select a, b, count(distinct unit) as items, count(distinct source_id) as sources, count(distinct nullif(host, '')) as domains, count(distinct category) as categories, min(day) as lo, max(day) as hi, count(day) as days, avg(size) as size from sup group by 1, 2)"""


@query(f"""with {_SUPPORT}
select w.a, w.b, coalesce(items, 0) as items, coalesce(sources, 0) as sources, coalesce(domains, 0) as domains, coalesce(categories, 0) as categories,
 round(0.30 * least(1.0, 0.45 * least(1.0, coalesce(sources, 0) / 4.0) + 0.55 * least(1.0, coalesce(domains, 0) / 3.0))
  + 0.25 * least(1.0, least(0.20, coalesce(bill, 0) * 0.07) + case when contract is not null then 0.25 else 0 end + case when restriction is not null then 0.20 else 0 end + case when coalesce(vote, 0) >= 5 then 0.15 else 0 end)
  + 0.15 * case when coalesce(days, 0) = 0 then 0.4 when days = 1 then 0.7 when hi - lo <= 30 then 1.0 when hi - lo <= 90 then 0.85 when hi - lo <= 180 then 0.7 when hi - lo <= 365 then 0.5 else 0.25 end
  + 0.15 * 0.5 + 0.05 * 0.5 * least(1.0, coalesce(size, 0) / 600.0) + 1e-9, 4)::double as score
from wide w left join g on g.a = w.a and g.b = w.b""")
def relation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with their support in items and the base score."""
    s = r.support(_seeds(spark, d), domain.mentions(spark, d), table(spark, d, "content_items"), table(spark, d, "sources"))
    return r.base_score(s).select("a", "b", "items", "sources", "domains", "categories", "score")


_BRIDGES = """array_to_string(list_filter([case when contract is not null then 'contract' end, case when bill is not null then 'bill' end, case when vote is not null then 'vote' end, case when mention is not null then 'mention' end, case when restriction is not null then 'restriction' end], lambda v : v is not null), '>')"""


@query(f"with {_SEEDS} select a, b, {_BRIDGES} as path from wide")
def explained_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The bridges between the ends of each pair, in order."""
    return r.explained(_seeds(spark, d), ["contract", "bill", "vote", "mention", "restriction"]).select("a", "b", "path")


@query(f"""with {_SUPPORT}, k as (select a, b, source_id, nullif(host, '') as host, unit, 1 as copies, false as official from sup
 union all select w.a, w.b, null, null, c.g, 2, true from wide w join cp c on c.e = w.a join cp c2 on c2.e = w.b and c2.g = c.g)
select a, b, unit, coalesce(source_id, 0) as source_id, host, max(copies)::int as copies, bool_or(official) as official from k group by a, b, unit, source_id, host""")
def support_rows(spark: SparkSession, d: str) -> DataFrame:
    """Support of pairs by shared items and by official bridges (contracts), merged by unit, source and host."""
    seeds = _seeds(spark, d)
    shared = r.support_rows(seeds, domain.mentions(spark, d), table(spark, d, "content_items"), table(spark, d, "sources"))
    shared = shared.select("a", "b", "unit", "source_id", "host", F.lit(1).alias("copies"), F.lit(False).alias("official"))
    p = table(spark, d, "contract_parties").select("contract_id", "entity_id").dropna().distinct()
    c = seeds.select("a", "b").join(p.toDF("unit", "a"), "a").join(p.toDF("unit", "b"), ["b", "unit"])
    official = c.select("a", "b", "unit", F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("string").alias("host"), F.lit(2).alias("copies"), F.lit(True).alias("official"))
    return r.merged_support(shared.unionByName(official)).fillna(0, ["source_id"])


@query(f"""with {_SUPPORT} select a, b, count(*) filter (where host is not null and host <> '' and (not contains(host, '.'))) as fake, count(distinct case when contains(host, '.') then host end) as real from sup group by 1, 2 having fake > 0 or real = 0 or real < 2""")
def fake_domain_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose support comes from fewer than two real hosts."""
    s = r.support_rows(_seeds(spark, d), domain.mentions(spark, d), table(spark, d, "content_items"), table(spark, d, "sources"))
    real = F.count_distinct(F.when(F.contains("host", F.lit(".")), F.col("host")))
    return s.groupBy("a", "b").agg(F.count_if(~F.contains("host", F.lit("."))).alias("fake"), real.alias("real")).filter("fake > 0 or real < 2")


@query("""
with n as (select id, neighbour, score from (select event_id as id, event_id + 1 as neighbour, value as score from events union all select event_id + 1, event_id, value / 2 from events))
select least(id, neighbour) as a, greatest(id, neighbour) as b, max(score) as score from n group by 1, 2""")
def symmetric_best(spark: SparkSession, d: str) -> DataFrame:
    """The greatest score of each unordered pair."""
    e = table(spark, d, "events")
    n = e.select(F.col("event_id").alias("id"), (F.col("event_id") + 1).alias("neighbour"), F.col("value").alias("score"))
    n = n.unionByName(e.select((F.col("event_id") + 1).alias("id"), F.col("event_id").alias("neighbour"), (F.col("value") / 2).alias("score")))
    return r.symmetric_best(n, "id", "neighbour", "score")


@query(r"""
with p as (select distinct id, contract_id, party_name, party_role, regexp_replace(coalesce(inn, ''), '\D', '', 'g') as inn from contract_parties),
o as (select regexp_replace(inn, '\D', '', 'g') as inn, min(id) as e, count(*) as n from entities where entity_type = 'organization' and regexp_replace(coalesce(inn, ''), '\D', '', 'g') <> '' group by 1),
w as (select canonical_name, min(id) as e, count(*) as n from entities where entity_type = 'organization' group by 1)
select p.id, p.contract_id, coalesce(case when o.n = 1 then o.e end, case when w.n = 1 then w.e end, 0) as entity_id, case when o.n = 1 then 'inn' when w.n = 1 then 'name' else 'none' end as by_what
from p left join o on o.inn = p.inn left join w on w.canonical_name = p.party_name""")
def normalized_parties(spark: SparkSession, d: str) -> DataFrame:
    """The organisation of each party by INN, else by its exact name, where only one has it (0: none)."""
    return r.normalized_parties(table(spark, d, "contract_parties"), table(spark, d, "entities").filter("entity_type = 'organization'")).fillna(0, ["entity_id"])


@query(r"""
with v as (select distinct e.id as src, 'фракция ' || regexp_extract(e.description, 'фракция «([^»]+)»', 1) as dst from entities e where regexp_extract(e.description, 'фракция «([^»]+)»', 1) <> ''),
l as (select e.id as src, 'регион ' || regexp_extract(e.canonical_name, '([А-ЯЁ][а-яё]+ого) района', 1) as dst from entities e where regexp_extract(e.canonical_name, '([А-ЯЁ][а-яё]+ого) района', 1) <> '')
select src, dst, 'member_of' as relation_type from v union select src, dst, 'located_in' from l""")
def structural_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that names and descriptions of entities state: factions and districts."""
    e = table(spark, d, "entities")
    return r.stated_edges(e, (("member_of", "description", "фракция «([^»]+)»", "фракция "), ("located_in", "canonical_name", "([А-ЯЁ][а-яё]+ого) района", "регион ")))
