"""Queries of events, audits, checks, read-side reports and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import events as e
from factloom.operators import quality, relational, relations, similarity
from factloom.operators.verification import OFFICIAL_TYPES
from factloom.plans import domain, reference
from factloom.plans.classification import final_tags
from factloom.plans.classification import _VOTES as _TAG_VOTES
from factloom.plans.registry import Registry
from factloom.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_OFFICIAL = "('" + "', '".join((*OFFICIAL_TYPES, "official_document")) + "')"
_GROUPS = f"""{domain.CLAIMS}, {domain.MENTIONS}, {domain.LINKS}, sg as ({reference.ORACLE['title_signature_dedupe']}),
elig as (select id from content_items where content_type in {_OFFICIAL} union select content_item_id from mentions union select claim_id from links),
groups as (select canonical_id as event, id from sg union all select id, id from content_items where id not in (select id from sg) and id in (select id from elig))"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "content_items")
    official = c.filter(F.col("content_type").isin(*OFFICIAL_TYPES, "official_document")).select("id")
    eligible = [official, domain.mentions(spark, d).select(F.col("content_item_id").alias("id")), domain.links(spark, d).select(F.col("claim_id").alias("id"))]
    return e.groups(similarity.signature_groups(c).select("id", "canonical_id"), c, eligible)


@query(f"with {_GROUPS} select * from groups")
def event_groups(spark: SparkSession, d: str) -> DataFrame:
    """Items by event: groups of one title, and eligible single items."""
    return _groups(spark, d)


@query(rf"""with {_GROUPS}, f as (select content_item_id, arg_min(claim_type, id) as claim_type from claims group by 1),
x as (select g.event, i.id, trim(i.title) as title, i.content_type, f.claim_type, case when regexp_matches(i.published_at, '^\d{{4}}-\d{{2}}-\d{{2}}') then try_cast(substr(i.published_at, 1, 10) as date) end as day from groups g join content_items i on i.id = g.id left join f on f.content_item_id = i.id)
select event, count(*) as items, count(*) filter (where content_type in {_OFFICIAL}) as official_items, min(day)::varchar as starts, max(day)::varchar as ends, coalesce(arg_min(title, id) filter (where coalesce(title, '') <> ''), '') as title,
 coalesce(arg_min(claim_type, id) filter (where claim_type is not null), arg_min(content_type, id) filter (where content_type in {_OFFICIAL}), 'event') as event_type from x group by 1""")
def event_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its span, title and type."""
    return e.summary(_groups(spark, d), table(spark, d, "content_items"), domain.claims(spark, d), (*OFFICIAL_TYPES, "official_document"))


@query(f"""with {_GROUPS}, r as (select g.event, m.entity_id, case when regexp_matches(n.canonical_name, 'комисси|Комисси|надзор|служба|Служба') then 'regulator' when n.entity_type = 'location' then 'location' when n.entity_type = 'person' then case when m.confidence >= 0.8 then 'affected' else 'commentator' end else 'target' end as role, max(m.confidence) as confidence
 from groups g join mentions m on m.content_item_id = g.id join entities n on n.id = m.entity_id group by 1, 2, 3)
select event, entity_id, role, confidence::double as confidence from (select *, row_number() over (partition by event, entity_id order by confidence desc, role) as k from r) where k = 1""")
def event_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of every event in the role they are surest in."""
    kind, name = F.col("entity_type"), F.col("canonical_name")
    role = F.when(name.rlike("комисси|Комисси|надзор|служба|Служба"), "regulator").when(kind == "location", "location")
    role = role.when(kind == "person", F.when(F.col("confidence") >= 0.8, "affected").otherwise("commentator")).otherwise("target")
    return e.entity_roles(_groups(spark, d), domain.mentions(spark, d), table(spark, d, "entities"), role)


@query(f"""with {_GROUPS}, r as (select g.event, m.entity_id, case when starts_with(n.canonical_name, 'ООО') or starts_with(n.canonical_name, 'АО') then 'actor' else 'target' end as role from groups g join mentions m on m.content_item_id = g.id join entities n on n.id = m.entity_id)
select distinct a.event, a.entity_id as actor, b.entity_id as target from r a join r b on a.event = b.event and a.role = 'actor' and b.role = 'target' and a.entity_id <> b.entity_id""")
def event_role_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an event's actors and targets."""
    role = F.when(F.startswith("canonical_name", F.lit("ООО")) | F.startswith("canonical_name", F.lit("АО")), "actor").otherwise("target")
    r = e.entity_roles(_groups(spark, d), domain.mentions(spark, d), table(spark, d, "entities"), role)
    return relations.role_pairs(r, "event", "entity_id", "role", ("actor",), ("target",))


@query(f"""with {_GROUPS}, {_TAG_VOTES}, x as (select g.event, f.tag as fact, max(f.confidence) as c, bool_or(coalesce(i.content_type in {_OFFICIAL}, false)) as d from groups g join final f on f.id = g.id join content_items i on i.id = g.id group by 1, 2)
select event, fact, round(least(0.95, greatest(0.55, case when d then greatest(c, 0.82) else c end)), 4)::double as confidence from x""")
def event_facts(spark: SparkSession, d: str) -> DataFrame:
    """Tags of every event's items as facts."""
    return e.facts(_groups(spark, d), final_tags(spark, d).select("id", "tag", "confidence"), table(spark, d, "content_items"), (*OFFICIAL_TYPES, "official_document"))


_HASH = "sha256(concat(coalesce({0}title, ''), chr(31), coalesce({0}body_text, ''), chr(31), coalesce({0}url, '')))"


@query(f"select id, 'summary' as kind, {_HASH.format('')} as input_hash from content_items")
def derivation_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of what is derived from every item."""
    return e.derivations(table(spark, d, "content_items"), "summary", ("title", "body_text", "url"))


@query("select id, 'summary' as kind from content_items where title is not null and title <> trim(title) || '' or id % 3 = 0 and coalesce(body_text, '') <> ''")
def stale_derivations(spark: SparkSession, d: str) -> DataFrame:
    """Items to derive again, had every third been derived without its body and the titles been trimmed."""
    c = table(spark, d, "content_items")
    old = c.select("id", F.trim("title").alias("title"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("body_text")).alias("body_text"), "url")
    keys = ("title", "body_text", "url")
    return e.stale(e.derivations(old, "summary", keys), e.derivations(c, "summary", keys))


_FACT = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(body_text, ''), '\s+', ' ', 'g')), '(?i)(?:подписывайтесь|подпишитесь).*$', ''), '(?i)(?:подробнее|источник|ссылка).*$', ''), '(?i)(?:читайте также|см\. также).*$', ''))"


@query(rf"""with x as (select id, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) as n, {_FACT} as t from content_items)
select id, case when t = '' then n when n <> '' and not contains(lower(t), lower(n)) and length(t) < 220 then n || '. ' || t else t end as factual from x""")
def factual_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every item's text without calls to subscribe or read on."""
    return table(spark, d, "content_items").select("id", e.factual_text(F.col("title"), F.col("body_text")).alias("factual"))


# ---- audit and checks -------------------------------------------------------
@query("""
with h as (select kind, lang, count(*) as n from (select 'now' as kind, coalesce(lang, 'unknown') as lang from documents where doc_id % 2 = 0 union all select 'before', coalesce(lang, 'unknown') from documents where doc_id % 2 = 1) group by 1, 2),
d as (select 'lang' as what, round(0.5 * sum(abs(coalesce(a.n, 0) / (select sum(n) from h where kind = 'now') - coalesce(b.n, 0) / (select sum(n) from h where kind = 'before'))), 4)::double as value from (select * from h where kind = 'now') a full join (select * from h where kind = 'before') b on a.lang = b.lang),
p as (select 'precision' as what, round(avg(case vote_result when 'за' then 1.0 when 'воздержался' then 0.5 else 0.0 end), 4)::double as value from bill_votes where vote_result in ('за', 'воздержался', 'против'))
select what as "check", value, "limit", ok from (select what, value, 0.35::double as "limit", value <= 0.35 as ok from d union all select what, value, 0.45::double, value >= 0.45 from p)""")
def classifier_audit(spark: SparkSession, d: str) -> DataFrame:
    """Drift of languages between two halves of the documents, and precision of reviewed votes, against their limits."""
    docs = table(spark, d, "documents").select((F.col("doc_id") % 2).alias("half"), F.coalesce("lang", F.lit("unknown")).alias("lang"))
    n = lambda h: docs.filter(F.col("half") == h).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    drift = relational.total_variation(n(0), n(1), "lang", "n").select(F.lit("lang").alias("check"), F.col("distance").cast("double").alias("value"))
    verdict = F.when(F.col("vote_result") == "за", "correct").when(F.col("vote_result") == "воздержался", "partially").when(F.col("vote_result") == "против", "wrong")
    p = quality.precision(table(spark, d, "bill_votes").select(F.lit("all").alias("kind"), verdict.alias("verdict")))
    both = drift.unionByName(p.select(F.lit("precision").alias("check"), F.col("precision").alias("value")))
    limit = F.when(F.col("check") == "precision", 0.45).otherwise(0.35)
    ok = F.when(F.col("check") == "precision", F.col("value") >= 0.45).otherwise(F.col("value") <= 0.35)
    return both.select("check", "value", limit.alias("limit"), ok.alias("ok"))


@query(f"with {domain.CLAIMS}, sg as ({reference.ORACLE['title_signature_dedupe']}) select count(*) as leaked, count(distinct c.content_item_id) as items from claims c join sg on sg.id = c.content_item_id and sg.id <> sg.canonical_id")
def duplicate_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Claims on items that repeat another."""
    s = similarity.signature_groups(table(spark, d, "content_items")).filter("id != canonical_id").select(F.col("id").alias("content_item_id"))
    return domain.claims(spark, d).join(s, "content_item_id", "left_semi").agg(F.count(F.lit(1)).alias("leaked"), F.count_distinct("content_item_id").alias("items"))


@query(f"with {domain.CLAIMS}, k as (select lower(claim_text) as t, min(id) as id, count(*) as support, count(distinct source_id) as sources from claims group by 1) select id, support, sources from k where support > 1")
def claims_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Claims of one text as one, with how many support it."""
    k = domain.claims(spark, d).groupBy(F.lower("claim_text").alias("t")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("support"), F.count_distinct("source_id").alias("sources"))
    return k.filter("support > 1").select("id", "support", "sources")


_RUNS = "runs as (select source_id, id, collected_at, is_processed, row_number() over (partition by source_id order by id desc) as n from raw_source_items where source_id is not null)"


@query(f"with {_RUNS} select s.id as source_id, case when s.is_active = 0 then 'off' when r.id is null then 'silent' when r.is_processed = 1 then 'ok' else 'pending' end as state, case when s.is_official = 1 then 'required' else 'optional' end as need from sources s left join runs r on r.source_id = s.id and r.n = 1")
def source_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """The state of every source by its latest item."""
    last = table(spark, d, "raw_source_items").filter("source_id is not null").groupBy("source_id").agg(F.max(F.struct("id", "is_processed")).alias("r"))
    s = table(spark, d, "sources").join(last, F.col("id") == F.col("source_id"), "left")
    state = F.when(F.col("is_active") == 0, "off").when(F.col("r").isNull(), "silent").when(F.col("r.is_processed") == 1, "ok").otherwise("pending")
    return s.select(F.col("id").alias("source_id"), state.alias("state"), F.when(F.col("is_official") == 1, "required").otherwise("optional").alias("need"))


_FAIL = "case when status = 'archived' then 'gone' when url is null then 'no_address' when published_at is null then 'no_time' when coalesce(body_text, '') = '' then 'empty' else 'fine' end"


@query(f"select {_FAIL} as class, count(*) as n, {_FAIL} in ('no_time', 'empty') as retry from content_items group by 1, 3")
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    """Items by the first thing that is wrong with them, and whether to fetch them again."""
    kind = F.when(F.col("status") == "archived", "gone").when(F.col("url").isNull(), "no_address").when(F.col("published_at").isNull(), "no_time").when(F.coalesce("body_text", F.lit("")) == "", "empty").otherwise("fine")
    x = table(spark, d, "content_items").select(kind.alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("retry", F.col("class").isin("no_time", "empty"))


@query("""
with f as (select user_id, event_type, count(*) filter (where event_type = 'error') as failures from events group by 1, 2), t as (select user_id, sum(failures) as failures, count(*) as kinds from f group by 1)
select user_id, failures::bigint as failures, failures >= 12 as open from t""")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Users whose errors open the breaker."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    return g.withColumn("open", F.col("failures") >= 12)


@query("""
with q as (select event_id, user_id, ts, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('click', 'view')),
d as (select distinct user_id, event_id from events where event_type = 'purchase')
select user_id, event_id, n::int as position from q where n <= 3""")
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    """The three oldest pieces of work of each user, those to lease next."""
    q = table(spark, d, "events").filter("event_type in ('click', 'view')").select("user_id", "event_id", "ts")
    return relational.top_per(q, ["user_id"], [F.col("ts"), F.col("event_id")], 3).select("user_id", "event_id", F.col("rank").alias("position"))


@query("""
with r as (select user_id, max(ts) filter (where event_type = 'purchase') as ok, max(ts) as last from events group by 1), m as (select max(ts) as now from events)
select user_id, coalesce(greatest(ok, now - interval 14 day), now - interval 14 day) as window_start from r, m""")
def catchup_window(spark: SparkSession, d: str) -> DataFrame:
    """From when to catch up: the last success, or fourteen days before the latest event."""
    ev = table(spark, d, "events")
    now = ev.agg(F.max("ts").alias("now")).first().now
    start = F.lit(now) - F.expr("interval 14 days")
    g = ev.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("ok"))
    return g.select("user_id", F.coalesce(F.greatest("ok", start), start).alias("window_start"))


# ---- read side --------------------------------------------------------------
@query("""
select c.id, c.title, c.content_type, coalesce(s.name, '') as source, coalesce(a.n, 0) as attachments from content_items c left join sources s on s.id = c.source_id left join (select content_item_id, count(*) as n from attachments group by 1) a on a.content_item_id = c.id
where c.status = 'raw_signal' and contains(lower(coalesce(c.title, '')), 'област') order by c.id desc limit 120""")
def content_screen(spark: SparkSession, d: str) -> DataFrame:
    """The newest items with a word in the title, with their source and attachments; the text is looked for before the limit."""
    c = table(spark, d, "content_items").filter(F.col("status") == "raw_signal").filter(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("област"))).orderBy(F.col("id").desc()).limit(120)
    a = table(spark, d, "attachments").groupBy("content_item_id").agg(F.count(F.lit(1)).alias("attachments"))
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    x = c.select("id", "title", "content_type", "source_id").join(s, "source_id", "left").join(a, F.col("id") == F.col("content_item_id"), "left")
    return x.select("id", "title", "content_type", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("attachments", F.lit(0).cast("long")).alias("attachments"))


@query(f"""with {domain.CLAIMS}, {domain.LINKS}, n as (select claim_id, count(*) as evidence, count(*) filter (where evidence_class = 'hard') as hard from links group by 1)
select c.id, c.claim_type, c.status, coalesce(evidence, 0) as evidence, coalesce(hard, 0) as hard from claims c left join n on n.claim_id = c.id order by evidence desc, c.id limit 120""")
def claims_screen(spark: SparkSession, d: str) -> DataFrame:
    """The claims with most evidence."""
    n = domain.links(spark, d).groupBy("claim_id").agg(F.count(F.lit(1)).alias("evidence"), F.count_if(F.col("evidence_class") == "hard").alias("hard"))
    c = domain.claims(spark, d).join(n, F.col("id") == F.col("claim_id"), "left").select("id", "claim_type", "status", "evidence", "hard").fillna(0, ["evidence", "hard"])
    return c.orderBy(F.col("evidence").desc(), "id").limit(120)


@query(f"""with {_GROUPS}, n as (select event, count(*) as items from groups group by 1) select event, items from n order by items desc, event limit 160""")
def events_screen(spark: SparkSession, d: str) -> DataFrame:
    """The events of most items."""
    return _groups(spark, d).groupBy("event").agg(F.count(F.lit(1)).alias("items")).orderBy(F.col("items").desc(), "event").limit(160)


@query(f"""with {domain.MENTIONS}, m as (select entity_id, count(*) as mentions from mentions group by 1), v as (select entity_id, count(distinct vote_session_id) as votes from bill_votes where entity_id is not null group by 1), p as (select entity_id, count(distinct contract_id) as contracts from contract_parties where entity_id is not null group by 1)
select e.id, e.entity_type, e.canonical_name, coalesce(mentions, 0) as mentions, coalesce(votes, 0) as votes, coalesce(contracts, 0) as contracts from entities e left join m on m.entity_id = e.id left join v on v.entity_id = e.id left join p on p.entity_id = e.id""")
def entity_details(spark: SparkSession, d: str) -> DataFrame:
    """Every entity with what is known of it, each count made before the join."""
    out = table(spark, d, "entities").select("id", "entity_type", "canonical_name")
    counts = (("mentions", domain.mentions(spark, d), "content_item_id"), ("votes", table(spark, d, "bill_votes"), "vote_session_id"), ("contracts", table(spark, d, "contract_parties"), "contract_id"))
    for name, t, what in counts:
        n = t.filter("entity_id is not null").groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct(what).alias(name))
        out = out.join(n, "id", "left")
    return out.fillna(0, [c[0] for c in counts])


@query("select (select count(*) from content_items) as items, (select count(*) from content_items where status = 'archived') as archived, (select count(distinct source_id) from content_items) as sources, (select count(*) from entities where entity_type = 'person') as people, (select count(distinct id) from contracts) as contracts, (select count(distinct id) from bill_votes) as votes")
def overview(spark: SparkSession, d: str) -> DataFrame:
    """The counters of all tables in one row."""
    t = lambda n: table(spark, d, n)
    parts = [
        t("content_items").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "archived").alias("archived"), F.count_distinct("source_id").alias("sources")),
        t("entities").agg(F.count_if(F.col("entity_type") == "person").alias("people")), t("contracts").agg(F.count_distinct("id").alias("contracts")), t("bill_votes").agg(F.count_distinct("id").alias("votes")),
    ]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


@query("select id, name, category, is_official from sources where category in ('media', 'telegram') and contains(lower(name), 'област') order by name, id")
def source_list(spark: SparkSession, d: str) -> DataFrame:
    """Sources of two kinds with a word in the name."""
    s = table(spark, d, "sources").filter(F.col("category").isin("media", "telegram") & F.contains(F.lower("name"), F.lit("област")))
    return s.select("id", "name", "category", "is_official").orderBy("name", "id")


@query(f"""with {domain.CLAIMS}, {domain.MENTIONS}, s as (select entity_id from mentions group by 1 order by count(*) desc, entity_id limit 20), n as (select m.content_item_id as id, count(*) as entities from mentions m join s using (entity_id) group by 1 having count(*) >= 2)
select c.id, c.claim_type, entities from n join claims c on c.content_item_id = n.id order by entities desc, c.id limit 36""")
def shared_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that two or more of the twenty most mentioned entities share (a report of 36)."""
    m = domain.mentions(spark, d)
    s = m.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "entity_id").limit(20).select("entity_id")
    n = m.join(s, "entity_id", "left_semi").groupBy("content_item_id").agg(F.count(F.lit(1)).alias("entities")).filter("entities >= 2")
    c = domain.claims(spark, d).select("id", "content_item_id", "claim_type")
    return c.join(n, "content_item_id").select("id", "claim_type", "entities").orderBy(F.col("entities").desc(), "id").limit(36)


@query("select coalesce(faction, 'unknown') as faction, count(*) filter (where vote_result = 'за') as yes, count(*) filter (where vote_result = 'против') as no, count(*) filter (where vote_result = 'воздержался') as abstained, count(*) as votes from (select distinct id, faction, vote_result from bill_votes) group by 1")
def vote_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Votes by faction and result."""
    v = table(spark, d, "bill_votes").select("id", F.coalesce("faction", F.lit("unknown")).alias("faction"), "vote_result").distinct()
    r = lambda x: F.count_if(F.col("vote_result") == x)
    return v.groupBy("faction").agg(r("за").alias("yes"), r("против").alias("no"), r("воздержался").alias("abstained"), F.count(F.lit(1)).alias("votes"))


@query("select 'content_type' as field, content_type as value from content_items where content_type is not null union select 'status', status from content_items where status is not null union select 'faction', faction from bill_votes where faction is not null")
def filter_values(spark: SparkSession, d: str) -> DataFrame:
    """The values that the filters of the screens offer."""
    c = table(spark, d, "content_items")
    one = lambda df, x: df.filter(F.col(x).isNotNull()).select(F.lit(x).alias("field"), F.col(x).alias("value"))
    return one(c, "content_type").unionByName(one(c, "status")).unionByName(one(table(spark, d, "bill_votes"), "faction")).distinct()


@query("select id, evidence_class, strength, case strength when 'strong' then 0 when 'moderate' then 1 when 'weak' then 2 else 3 end as priority from (select distinct id, evidence_class, strength from evidence_links) order by priority, evidence_class nulls last, id limit 180")
def ordered_links(spark: SparkSession, d: str) -> DataFrame:
    """Links by strength in the order of a list of values (a report of 180)."""
    p = F.when(F.col("strength") == "strong", 0).when(F.col("strength") == "moderate", 1).when(F.col("strength") == "weak", 2).otherwise(3)
    x = table(spark, d, "evidence_links").select("id", "evidence_class", "strength").distinct().withColumn("priority", p)
    return x.orderBy("priority", F.col("evidence_class").asc_nulls_last(), "id").limit(180)


@query(f"with {domain.QUOTES} select q.content_item_id, q.quote, q.flagged, coalesce(s.name, '') as source from quotes q join content_items c on c.id = q.content_item_id left join sources s on s.id = c.source_id where contains(lower(q.quote), 'ремонт') order by q.content_item_id desc, q.quote limit 100")
def quote_search(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with a word, newest items first (a page of a hundred)."""
    c = table(spark, d, "content_items").select(F.col("id").alias("content_item_id"), "source_id")
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    q = domain.quotes(spark, d).filter(F.contains(F.lower("quote"), F.lit("ремонт")))
    return q.join(c, "content_item_id").join(s, "source_id", "left").select("content_item_id", "quote", "flagged", F.coalesce("source", F.lit("")).alias("source")).orderBy(F.col("content_item_id").desc(), "quote").limit(100)


# ---- upkeep -----------------------------------------------------------------
@query("select e.id as entity_id, 'депутат' as position from entities e where e.entity_type = 'person' and e.id in (select entity_id from bill_votes where entity_id is not null) and e.id not in (select entity_id from bill_sponsors where entity_id is not null)")
def missing_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions for voters that stand under no bill."""
    v = table(spark, d, "bill_votes").select(F.col("entity_id").alias("id")).dropna().distinct()
    s = table(spark, d, "bill_sponsors").select(F.col("entity_id").alias("id")).dropna().distinct()
    x = table(spark, d, "entities").filter("entity_type = 'person'").join(v, "id", "left_semi").join(s, "id", "left_anti")
    return x.select(F.col("id").alias("entity_id"), F.lit("депутат").alias("position"))


@query(r"""with h as (select id as source_id, regexp_replace(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), '^www\.', '') as host from sources where url is not null), o as (select host, min(source_id) as found from h group by 1)
select c.id, o.found as source_id, o.found = c.source_id as agrees from content_items c join o on o.host = regexp_replace(lower(regexp_extract(c.url, '^[^:]*://([^/?#]*)', 1)), '^www\.', '') where c.url is not null and c.source_id is not null""")
def source_by_host(spark: SparkSession, d: str) -> DataFrame:
    """The source whose host an item's address has, and whether it is the one given."""
    o = table(spark, d, "sources").filter("url is not null").groupBy(text.normalized_domain(F.col("url")).alias("host")).agg(F.min("id").alias("found"))
    c = table(spark, d, "content_items").filter("url is not null and source_id is not null").select("id", F.col("source_id").alias("given"), text.normalized_domain(F.col("url")).alias("host"))
    return c.join(o, "host").select("id", F.col("found").alias("source_id"), (F.col("found") == F.col("given")).alias("agrees"))


@query(r"""with e as (select array_to_string(list_sort(string_split_regex(replace(lower(canonical_name), 'ё', 'е'), '\s+')), ' ') as k, min(id) as entity_id from entities where entity_type = 'person' group by 1 having count(*) = 1)
select v.id, v.deputy_name, e.entity_id from (select distinct id, deputy_name from bill_votes where entity_id is null) v join e on e.k = array_to_string(list_sort(string_split_regex(replace(lower(trim(deputy_name)), 'ё', 'е'), '\s+')), ' ')""")
def votes_by_exact_name(spark: SparkSession, d: str) -> DataFrame:
    """The person of votes without one whose name is written in full, whatever the order of its words."""
    key = lambda c: F.array_join(F.array_sort(F.split(F.translate(F.lower(c), "ё", "е"), r"\s+")), " ")
    p = table(spark, d, "entities").filter("entity_type = 'person'").groupBy(key(F.col("canonical_name")).alias("k")).agg(F.min("id").alias("entity_id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    v = table(spark, d, "bill_votes").filter("entity_id is null").select("id", "deputy_name").distinct()
    return v.join(p, key(F.trim("deputy_name")) == F.col("k")).select("id", "deputy_name", "entity_id")


@query("with n as (select faction, deputy_name, count(*) over (partition by lower(deputy_name)) as copies, id from (select distinct id, faction, deputy_name from bill_votes where deputy_name is not null)) select id, case when copies > 1 and faction is not null then deputy_name || ' (' || faction || ')' else deputy_name end as title from n")
def unambiguous_titles(spark: SparkSession, d: str) -> DataFrame:
    """Names of votes, told apart by faction where several bear them: counted, then joined, so a name that a third of the rows bear is no window."""
    v = table(spark, d, "bill_votes").filter("deputy_name is not null").select("id", "faction", "deputy_name").distinct()
    n = v.groupBy(F.lower("deputy_name").alias("k")).agg(F.count(F.lit(1)).alias("copies"))
    x = v.join(n, F.lower("deputy_name") == F.col("k"))
    return x.select("id", F.when((F.col("copies") > 1) & F.col("faction").isNotNull(), F.concat("deputy_name", F.lit(" ("), "faction", F.lit(")"))).otherwise(F.col("deputy_name")).alias("title"))
