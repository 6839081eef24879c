"""Queries of claim scores, evidence links and claim clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import blocks, graph
from factloom.operators import verification as v
from factloom.plans import domain
from factloom.plans.reference import document_evidence_score, source_credibility
from factloom.plans.registry import Registry
from factloom.session import cut, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _in(values) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


_OFFICIAL, _CATEGORIES = _in(v.OFFICIAL_TYPES), _in(v.OFFICIAL_CATEGORIES)
_CORROBORATION = f"""
with {domain.CLAIMS}, {domain.MENTIONS},
x as (select distinct c.id, o.source_id from claims c join mentions m on m.content_item_id = c.content_item_id join mentions m2 on m2.entity_id = m.entity_id and m2.content_item_id <> c.content_item_id
 join claims o on o.content_item_id = m2.content_item_id and o.claim_type = c.claim_type and o.source_id is not null),
g as (select x.id, count(*) as n, count(distinct category) as k, count(distinct political_alignment) as p from x join sources s on s.id = x.source_id group by 1)
select c.id, coalesce(round(least(1.0, case when n >= 3 then 0.3 when n >= 2 then 0.2 else 0 end + case when k >= 2 then 0.3 else 0 end + case when p >= 2 then 0.2 else 0 end + case when n >= 5 then 0.2 else 0 end), 4), 0)::double as score, coalesce(n, 0) as n_sources
from claims c left join g on g.id = c.id"""


@query(_CORROBORATION)
def cross_source_corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Claims by the sources that hold claims of the type on the same entities."""
    return v.corroboration(domain.claims(spark, d), domain.mentions(spark, d), table(spark, d, "sources"))


_DAY = r"case when regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}') then try_cast(substr({0}, 1, 10) as date) end"
_TEMPORAL = f"""
with {domain.CLAIMS}, {domain.LINKS}, c as (select id, {_DAY.format('published_at')} as c from claims), e as (select l.claim_id, {_DAY.format('i.published_at')} as e from links l join content_items i on i.id = l.evidence_item_id),
b as (select c.id, max(case when c - e >= 0 then case when c - e <= 30 then 0.8 when c - e <= 365 then 0.5 else 0.2 end when c - e >= -7 then 0.6 when c - e >= -30 then 0.4 else 0.1 end) as best from c join e on e.claim_id = c.id where e is not null and c is not null group by 1)
select c.id, (case when c is null then 0.5 else coalesce(best, 0.3) end)::double as score from c left join b on b.id = c.id"""


@query(_TEMPORAL)
def temporal_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Claims by the days of their evidence."""
    return v.temporal_consistency(domain.claims(spark, d), domain.links(spark, d), table(spark, d, "content_items"))


_ENTITY = rf"""
with {domain.CLAIMS}, a as (select id, content_item_id, list_distinct(regexp_extract_all(claim_text, '№ (\d+-[А-Я])', 1)) as numbers, list_distinct(regexp_extract_all(claim_text, '([А-ЯЁ][а-яё]+(?:\s[А-ЯЁ][а-яё]+){{1,2}})', 1)) as names from claims),
r as (select id, unnest(list_distinct(regexp_extract_all(coalesce(body_text, ''), '№ (\d+-[А-Я])', 1))) as number from content_items where content_type = 'official_document'), w as (select number, min(id) as lo, max(id) as hi from r group by 1),
n as (select id, content_item_id, unnest(list_slice(numbers, 1, 2)) as number from a), x as (select n.id, coalesce(lo <> content_item_id or hi <> content_item_id, false) as ok from n left join w using (number)),
p as (select id, substr(unnest(list_slice(names, 1, 2)), 1, 15) as name from a), y as (select p.id, exists (select 1 from entities e where e.entity_type = 'person' and contains(' ' || e.canonical_name, ' ' || p.name)) as ok from p),
g as (select id, count(*) as checks, count(*) filter (where ok) as verified from (select * from x union all select * from y) group by 1)
select c.id, coalesce(checks, 0) as checks, coalesce(verified, 0) as verified, coalesce(round(verified / checks, 4), 0.3)::double as score from claims c left join g on g.id = c.id"""


@query(_ENTITY)
def entity_verification(spark: SparkSession, d: str) -> DataFrame:
    """Claims by the share of their numbers and names that are known."""
    records = table(spark, d, "content_items").filter("content_type = 'official_document'").select("id", F.col("body_text").alias("text"))
    persons = table(spark, d, "entities").filter("entity_type = 'person'").select(F.col("canonical_name").alias("name"))
    return v.entity_verification(domain.claims(spark, d), persons, records, r"№ (\d+-[А-Я])")


_RHETORIC = f"""
with {domain.CLAIMS}, {domain.QUOTES}, q as (select content_item_id, count(*) as q from quotes where flagged group by 1)
select c.id, round(least(1.0, case when s.political_alignment in ('провластная') then 0.2 else 0 end + least(0.3, coalesce(q, 0) * 0.1) + case when c.status = 'likely_false' then 0.2 else 0 end + case when c.claim_type = 'corruption_claim' then 0.15 else 0 end), 4)::double as score
from claims c left join sources s on s.id = c.source_id left join q on q.content_item_id = c.content_item_id"""


def _tags(claims: DataFrame) -> DataFrame:
    t = F.array_compact(F.array(F.when(F.col("status") == "likely_false", "manipulation_risk"), F.when(F.col("claim_type") == "corruption_claim", "negative:money")))
    return claims.select("content_item_id", F.explode(t).alias("tag"))


@query(_RHETORIC)
def rhetoric_risk(spark: SparkSession, d: str) -> DataFrame:
    """Claims by alignment, flagged quotes and tags."""
    c = domain.claims(spark, d)
    return v.rhetoric_risk(c, table(spark, d, "sources"), domain.quotes(spark, d), _tags(c), ["провластная"], ["manipulation_risk"], ["negative:money"])


_CONTRADICTION = f"""
with {domain.CLAIMS}, {domain.MENTIONS}, {domain.RELATIONS}, f as (select content_item_id, entity_id, row_number() over (partition by content_item_id order by entity_id) as n from mentions),
r as (select e, count(*) as r from (select a as e from relations where relation_type = 'contradicts' union all select b from relations where relation_type = 'contradicts') group by 1),
w as (select m.entity_id as e, count(*) as w from claims c join mentions m on m.content_item_id = c.content_item_id where c.status in ('likely_false', 'disproved', 'manipulation') group by 1),
g as (select c.id, sum(coalesce(r, 0)) as r, sum(coalesce(w, 0) - case when c.status in ('likely_false', 'disproved', 'manipulation') then 1 else 0 end) as w from claims c join f on f.content_item_id = c.content_item_id and f.n <= 5 left join r on r.e = f.entity_id left join w on w.e = f.entity_id group by 1)
select c.id, case when g.id is null then 0.0 else round(least(1.0, least(0.3, r * 0.1) + least(0.5, w * 0.15)), 4) end::double as score from claims c left join g on g.id = c.id"""


@query(_CONTRADICTION)
def contradiction_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Claims by contradicting relations and refuted claims of their entities."""
    return v.contradiction_penalty(domain.claims(spark, d), domain.mentions(spark, d), domain.relations(spark, d))


def _factors(spark: SparkSession, d: str) -> DataFrame:
    c = domain.claims(spark, d)
    cred = source_credibility(spark, d).select(F.col("id").alias("source_id"), F.col("credibility").alias("source"))
    doc = document_evidence_score(spark, d).select(F.col("claim_id").alias("id"), F.col("score").alias("document"))
    x = c.select("id", "source_id").join(cred, "source_id", "left").drop("source_id").join(doc, "id", "left")
    for name, f in (("corroboration", cross_source_corroboration), ("temporal", temporal_consistency), ("entity", entity_verification), ("rhetoric", rhetoric_risk), ("contradiction", contradiction_penalty)):
        x = x.join(f(spark, d).select("id", F.col("score").alias(name)), "id", "left")
    return x.select("id", F.coalesce("source", F.lit(0.1)).alias("source"), F.coalesce("document", F.lit(0.0)).alias("document"), "corroboration", "temporal", "entity", "rhetoric", "contradiction")


def _authentic_sql() -> str:
    from factloom.plans import reference

    return f"""
with co as ({_CORROBORATION}), te as ({_TEMPORAL}), en as ({_ENTITY}), rh as ({_RHETORIC}), cn as ({_CONTRADICTION}), so as ({reference.ORACLE['source_credibility']}), dc as ({reference.ORACLE['document_evidence_score']}),
x as (select co.id, coalesce(so.credibility, 0.1) * 0.15 + coalesce(dc.score, 0) * 0.25 + co.score * 0.20 + te.score * 0.10 + en.score * 0.15 - rh.score * 0.10 - cn.score * 0.05 as t, co.score as c, te.score as te, en.score as en, rh.score as rh, cn.score as cn
 from co join te using (id) join en using (id) join rh using (id) join cn using (id) join content_items i on i.id = co.id left join so on so.id = i.source_id left join dc on dc.claim_id = co.id),
y as (select id, round(greatest(0.0, least(1.0, t)) + 1e-9, 4)::double as authenticity, round(greatest(0.0, least(1.0, 0.45 * te + 0.35 * en + 0.20 * (1.0 - cn))), 4)::double as consistency, rh, c from x),
z as (select id, authenticity, consistency, case when rh > 0.7 and c < 0.2 then 'manipulation' when authenticity >= 0.8 then 'confirmed' when authenticity >= 0.6 then 'likely_true' when authenticity >= 0.4 then 'partially_confirmed' when authenticity >= 0.2 then 'unverified' when authenticity >= 0.1 then 'likely_false' else 'disproved' end as status from y)"""


@query(f"{_authentic_sql()} select * from z")
def authenticity_scores(spark: SparkSession, d: str) -> DataFrame:
    """The seven factors of every claim as one score, with its status."""
    return v.authenticity(_factors(spark, d))


@query(f"{_authentic_sql()} select z.id as claim_id, case i.status when 'raw_signal' then 'unverified' when 'archived' then 'likely_false' else 'confirmed' end as old_status, z.status as new_status from z join content_items i on i.id = z.id where new_status <> old_status")
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose status the scores change."""
    return v.status_changes(domain.claims(spark, d), authenticity_scores(spark, d))


_CLASS = f"case when evidence_type in {_in(v.SEED_TYPES)} then 'seed' when evidence_type in {_in(v.HARD_TYPES)} or content_type in {_OFFICIAL} or category in {_CATEGORIES} or strength = 'strong' then 'hard' else 'support' end"


@query(f"with {domain.LINKS} select l.id, {_CLASS} as new_class, coalesce(evidence_class, '') <> {_CLASS} as changed from links l left join content_items i on i.id = l.evidence_item_id left join sources s on s.id = i.source_id")
def evidence_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of every link, and whether it differs from the one it has."""
    return v.backfilled_classes(domain.links(spark, d), table(spark, d, "content_items"), table(spark, d, "sources")).select("id", "new_class", "changed")


def _case(values: dict[str, str], other: str) -> str:
    return "case content_type " + " ".join(f"when '{a}' then '{b}'" for a, b in values.items()) + f" else '{other}' end"


_OPEN = "o as (select * from claims where status = 'unverified')"


@query(f"""
with {domain.CLAIMS}, {domain.MENTIONS}, {domain.LINKS}, {_OPEN},
g as (select o.id as claim_id, m2.content_item_id as evidence_item_id, count(distinct m2.entity_id) as shared from o join mentions m on m.content_item_id = o.content_item_id join mentions m2 on m2.entity_id = m.entity_id and m2.content_item_id <> o.content_item_id group by 1, 2),
s as (select g.*, content_type, category, (case when content_type in {_OFFICIAL} then 3.0 else 0 end + case when category in {_CATEGORIES} then 2.0 else 0 end + case credibility_tier when 'A' then 1.0 when 'B' then 0.5 else 0 end + least(shared, 5) * 0.5)::double as score
 from g join content_items i on i.id = g.evidence_item_id join sources s on s.id = i.source_id),
r as (select *, row_number() over (partition by claim_id order by score desc, evidence_item_id) as rank from s where score >= 1)
select claim_id, evidence_item_id, {_case(v.LINK_TYPES, 'official_document')} as evidence_type,
 case when score >= 5 then 'strong' when st = 'weak' and score >= 3 then 'moderate' else st end as strength, score, shared, rank::int as rank
from (select *, case when content_type in {_in(v.STRENGTHS)} then {_case(v.STRENGTHS, 'weak')} when category in {_CATEGORIES} then 'moderate' else 'weak' end as st from r where rank <= 5) x where not exists (select 1 from links l where l.claim_id = x.claim_id and l.evidence_item_id = x.evidence_item_id)""")
def evidence_autolinks(spark: SparkSession, d: str) -> DataFrame:
    """The five best items that share entities with each open claim's."""
    c = domain.claims(spark, d).filter("status = 'unverified'")
    return v.autolinks(c, domain.mentions(spark, d), table(spark, d, "content_items"), table(spark, d, "sources"), domain.links(spark, d))


@query(f"""
with {domain.CLAIMS}, {domain.MENTIONS}, {domain.LINKS}, {_OPEN},
x as (select distinct i.id as evidence_item_id, o.id as claim_id, content_type from content_items i join mentions m on m.content_item_id = i.id join mentions m2 on m2.entity_id = m.entity_id and m2.content_item_id <> i.id join o on o.content_item_id = m2.content_item_id where content_type in {_OFFICIAL}),
r as (select *, row_number() over (partition by evidence_item_id order by claim_id) as n from x)
select claim_id, evidence_item_id, {_case(v.LINK_TYPES, 'official_document')} as evidence_type, case when content_type = 'deputy_profile' then 'support' else 'hard' end as evidence_class, {_case(v.STRENGTHS, 'moderate')} as strength
from r where n <= 20 and not exists (select 1 from links l where l.claim_id = r.claim_id and l.evidence_item_id = r.evidence_item_id)""")
def official_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Official items as evidence of open claims on the same entities."""
    c = domain.claims(spark, d).filter("status = 'unverified'")
    return v.official_links(table(spark, d, "content_items"), c, domain.mentions(spark, d), domain.links(spark, d))


@query(rf"""
with {domain.CLAIMS}, {domain.MENTIONS},
n as (select id, content_item_id, unnest(regexp_extract_all(claim_text, '№ (\d+-[А-Я])', 1)) as k from claims), o as (select id, unnest(regexp_extract_all(coalesce(body_text, ''), '№ (\d+-[А-Я])', 1)) as k from content_items where content_type in ('official_document', 'bill')),
e as (select n.id as claim_id, 'document:' || o.id as evidence from n join o on o.k = n.k and o.id <> n.content_item_id union select c.id, 'session:' || b.vote_session_id from claims c join mentions m on m.content_item_id = c.content_item_id join bill_votes b on b.entity_id = m.entity_id where c.claim_type = 'vote_record' and b.vote_session_id is not null),
g as (select claim_id, count(*) as links from e group by 1)
select c.id, coalesce(links, 0) as links, case when links >= 3 then 'likely_true' when links >= 1 then 'partially_confirmed' else status end as status from claims c left join g on g.claim_id = c.id""")
def reverified_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims by the official documents with the same number and the votes of their entities."""
    c, number = domain.claims(spark, d), F.lit(r"№ (\d+-[А-Я])")
    n = c.select(F.col("id").alias("claim_id"), "content_item_id", F.explode(F.regexp_extract_all("claim_text", number, 1)).alias("k"))
    o = table(spark, d, "content_items").filter("content_type in ('official_document', 'bill')").select(F.col("id").alias("o"), F.explode(F.regexp_extract_all(F.coalesce("body_text", F.lit("")), number, 1)).alias("k")).distinct()
    documents = n.join(o, "k").filter("o != content_item_id").select("claim_id", F.concat(F.lit("document:"), "o").alias("evidence"))
    b = table(spark, d, "bill_votes").select("entity_id", "vote_session_id").dropna().distinct()
    m = domain.mentions(spark, d).select("content_item_id", "entity_id")
    sessions = c.filter("claim_type = 'vote_record'").select(F.col("id").alias("claim_id"), "content_item_id").join(m, "content_item_id").join(b, "entity_id")
    return v.reverified(c, [documents, sessions.select("claim_id", F.concat(F.lit("session:"), "vote_session_id").alias("evidence"))])


@query(f"with {domain.CLAIMS} select c.id, case when s.is_official = 1 or i.content_type in {_OFFICIAL} then 'high' when s.credibility_tier in ('A', 'B') then 'medium' else 'low' end as confidence from claims c left join sources s on s.id = c.source_id left join content_items i on i.id = c.content_item_id")
def first_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The bucket that a new claim begins in."""
    return v.first_status(table(spark, d, "sources"), domain.claims(spark, d), table(spark, d, "content_items"))


VOTED = (("за [^.]*проголосовали [2-9]", "за"), ("против [0-9]", "против"))


@query(f"""
with {domain.CLAIMS}, {domain.MENTIONS},
c as (select *, row_number() over (partition by entity_id order by claim_id desc) as n from (select m.entity_id, c.id as claim_id, case when regexp_matches(lower(claim_text), '{VOTED[0][0]}') then 'за' when regexp_matches(lower(claim_text), '{VOTED[1][0]}') then 'против' end as stated from claims c join mentions m on m.content_item_id = c.content_item_id)),
v as (select *, row_number() over (partition by entity_id order by seen desc nulls last, session desc) as n from (select b.entity_id, b.vote_session_id as session, min(b.vote_result) as result, max(s.updated_at) as seen from bill_votes b join bill_vote_sessions s on s.id = b.vote_session_id where b.entity_id is not null group by 1, 2))
select entity_id, claim_id, session, stated, result, (case when stated = 'за' and result = 'против' then 0.7 else 0.5 end)::double as score from c join v using (entity_id) where c.n <= 50 and v.n <= 50 and stated is not null and stated <> result and result in ('за', 'против')""")
def vote_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """What entities' claims say of votes against their votes."""
    s = table(spark, d, "bill_vote_sessions").groupBy(F.col("id").alias("session")).agg(F.max("updated_at").alias("at"))
    b = table(spark, d, "bill_votes").filter("entity_id is not null").groupBy("entity_id", F.col("vote_session_id").alias("session")).agg(F.min("vote_result").alias("result"))
    c = domain.claims(spark, d).withColumn("claim_text", F.lower("claim_text"))
    return v.vote_contradictions(c, domain.mentions(spark, d), b.join(s, "session").select("entity_id", "session", "result", "at"), VOTED)


@query(rf"""
with {domain.CLAIMS}, {domain.MENTIONS}, k as (select entity_id, count(distinct contract_id)::double as declared from contract_parties where entity_id is not null group by 1)
select m.entity_id, c.id as claim_id, k.declared, regexp_extract(claim_text, '([0-9,]+) (?:млн|тысяч) рублей', 1) as claimed from claims c join mentions m on m.content_item_id = c.content_item_id join k on k.entity_id = m.entity_id where regexp_extract(claim_text, '([0-9,]+) (?:млн|тысяч) рублей', 1) <> ''""")
def amount_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Amounts that claims name on entities with declared figures."""
    k = table(spark, d, "contract_parties").filter("entity_id is not null").groupBy("entity_id").agg(F.count_distinct("contract_id").cast("double").alias("declared"))
    return v.amount_contradictions(domain.claims(spark, d), domain.mentions(spark, d), k, "([0-9,]+) (?:млн|тысяч) рублей")


# ---- claim clusters ---------------------------------------------------------
_CANON = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(claim_text), 'ё', 'е'), '\s+', ' ', 'g')), '[«»\"“”„]', '', 'g'), '[.,;:!?…]+$', ''), '\s+', ' ', 'g'))"
_CLUSTERS = rf"""
with recursive {domain.CLAIMS}, k as (select id, claim_type, {_CANON} as canonical from claims), ok as (select * from k where len(regexp_extract_all(canonical, '[\p{{L}}\p{{N}}_-]+')) >= case when claim_type = 'public_statement' then 4 else 3 end),
u as (select claim_type, canonical, min(id) as id from ok group by 1, 2), d as (select id, claim_type, regexp_extract_all(lower(canonical), '[\p{{L}}\p{{N}}_]{{2,}}') as w from u), nn as (select count(*) as n from u),
t as (select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]))) as term from d), tf as (select id, term, count(*) as tf from t group by 1, 2),
idf as (select term, ln((1 + n) / (1 + count(*))) + 1 as idf, count(*) as df from tf, nn group by term, n), x as (select id, term, tf * idf as x, df from tf join idf using (term)), l as (select id, sqrt(sum(x * x)) as l from x group by 1), w as (select x.id, term, x / l as w, claim_type from x join l using (id) join u using (id) where df > 1),
e as materialized (select a.id as a, b.id as b from w a join w b on a.term = b.term and a.claim_type = b.claim_type and a.id <> b.id group by 1, 2 having round(sum(a.w * b.w), 4) >= 0.82),
r as (select id, id as m from u union select e.b, r.m from r join e on e.a = r.id), c as (select id, min(m) as cluster from r group by 1),
g as (select cluster, u.canonical, u.claim_type, ok.id as claim from c join u on u.id = c.id join ok on ok.canonical = u.canonical and ok.claim_type = u.claim_type)"""


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = domain.claims(spark, d)
    k = c.select("id", "claim_type", text.canonical_claim(F.col("claim_text"), F.col("claim_type")).alias("canonical"))
    ok = k.filter("canonical is not null")
    u = cut(ok.groupBy("claim_type", "canonical").agg(F.min("id").alias("id")))
    near = blocks.alike(u.select("id", F.col("canonical").alias("text"), F.col("claim_type").alias("kind")), 0.82)
    named = graph.components(near, "id", "neighbour")
    u = u.join(named, "id", "left").withColumn("cluster", F.coalesce("component", "id")).select("claim_type", "canonical", "cluster")
    return k, ok.join(u, ["claim_type", "canonical"])


@query(f"{_CLUSTERS} select claim_type, min(claim) as cluster, count(*) as claims, count(distinct canonical) as forms, arg_min(canonical, (length(canonical), canonical)) as canonical from g group by claim_type, g.cluster having count(*) > 1")
def claim_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Claims of one type alike at .82 (TF-IDF), joined over chains: each cluster with its shortest form."""
    _, g = _clusters(spark, d)
    g = g.groupBy("claim_type", F.col("cluster").alias("_c")).agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("claims"), F.count_distinct("canonical").alias("forms"), F.min(F.struct(F.length("canonical"), F.col("canonical").alias("t")))["t"].alias("canonical"))
    return g.filter("claims > 1").drop("_c")

