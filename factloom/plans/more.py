"""Queries of search pages, external evidence, organisations' names, gates, imports and reports on candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import external, quality, relational, relations, search
from factloom.plans import domain
from factloom.plans.network import _MERGED, _SUPPORT, _seeds, relation_scores, unified_edges
from factloom.plans.registry import Registry
from factloom.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_W = r"regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body_text, '')), '[\p{L}\p{N}_]+')"


@query(rf"""
with d as (select id, content_type, status, coalesce(title, '') || ' ' || coalesce(body_text, '') as text, {_W} as w from content_items), s as (select count(*) as n, avg(len(w)) as a from d where len(w) > 0),
p as (select id, len(w) as l, term, count(*) as tf from (select id, w, unnest(w) as term from d) group by 1, 2, 3), h as (select * from p where term in ('ремонте', 'мостов')), f as (select term, count(*) as df from h group by 1),
x as (select id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) as score, count(*) as c from h join f using (term), s group by 1),
r as (select x.id, score, count(*) over () as total, regexp_extract(text, '(?i)(.{{0,20}}(?:ремонте|мостов).{{0,20}})', 1, 's') as snippet from x join d using (id) where c = 2 and content_type = 'article' and status <> 'archived')
select id, score, total, snippet from r order by score desc, id limit 20 offset 2""")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the items with two words under two conditions, with the number of all and what stands around the first word."""
    c = table(spark, d, "content_items").select("id", "content_type", "status", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body_text", F.lit(""))).alias("text"))
    keep = c.filter((F.col("content_type") == "article") & (F.col("status") != "archived"))
    return search.page(c.select("id", "text"), keep.select("id"), "ремонте мостов", 20, 2)


@query(rf"""
with d as (select id, {_W} as w from content_items), p as (select id, len(w)::int as len, term, count(*) as tf from (select id, w, unnest(w) as term from d) group by 1, 2, 3)
select term, count(*) as df, sum(tf)::bigint as places from p group by 1""")
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms of the index with the items and places they stand in."""
    c = table(spark, d, "content_items").select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body_text", F.lit(""))).alias("text"))
    return search.postings(c).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("places"))


_NUM, _NAME, _LONG = r"№ (\d+-[А-Я])", r"([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+)", r"([а-яё]{9,})"


def _features(t: str) -> str:
    return f"list_distinct(regexp_extract_all({t}, '{_NUM}', 1)) as numbers, list_distinct(regexp_extract_all({t}, '{_NAME}', 1)) as names, list_distinct(regexp_extract_all(lower({t}), '{_LONG}', 1)) as words"


@query(rf"""
with {domain.CLAIMS}, a as (select id, content_item_id, {_features('claim_text')} from claims), b as (select id as item, source_id, {_features("coalesce(body_text, '')")} from content_items where content_type in ('official_document', 'bill')),
ka as (select id, content_item_id, unnest(list_concat(numbers, names)) as k from a), kb as (select item, unnest(list_concat(numbers, names)) as k from b), c as (select distinct id, item from ka join kb using (k) where item <> content_item_id),
x as (select c.id, c.item, len(list_intersect(a.numbers, b.numbers)) as n, len(list_intersect(a.names, b.names)) as m, len(list_intersect(a.words, b.words)) as w, coalesce(s.is_official, 0) as o from c join a on a.id = c.id join b on b.item = c.item left join sources s on s.id = b.source_id),
y as (select id, item, (5.0 * n + 2.0 * m + 2.5 * w + case when o = 1 then 1.0 else 0 end)::double as score, (n > 0 and w > 0) or (m > 0 and w >= 2) as reliable from x)
select id, item, score, reliable from (select *, row_number() over (partition by id order by reliable desc, score desc, item) as k from y) where k <= 10""")
def external_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The ten best official documents for each claim by numbers, names and long words in common."""
    docs = table(spark, d, "content_items").filter("content_type in ('official_document', 'bill')").select(F.col("id").alias("item"), "source_id", F.coalesce("body_text", F.lit("")).alias("text"))
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), (F.coalesce("is_official", F.lit(0)) == 1).alias("official"))
    docs = docs.join(s, "source_id", "left").withColumn("official", F.coalesce("official", F.lit(False)))
    return external.best_documents(domain.claims(spark, d).select("id", "content_item_id", F.col("claim_text").alias("text")), docs, _NUM, _NAME, _LONG, 10)


@query(f"""
with {domain.CLAIMS}, {domain.MENTIONS}, k as (select id, content_item_id, source_id, lower(claim_text) as t from claims where source_id is not null),
x as (select a.id, b.source_id, 1 as way, b.content_item_id as item from k a join k b on a.t = b.t and a.source_id <> b.source_id
 union all select a.id, b.source_id, 2, b.content_item_id from k a join mentions m on m.content_item_id = a.content_item_id join mentions n on n.entity_id = m.entity_id and n.content_item_id <> m.content_item_id join k b on b.content_item_id = n.content_item_id where a.source_id <> b.source_id)
select id, source_id, way, item from (select *, row_number() over (partition by id, source_id order by way, item) as r from x) where r = 1""")
def corroborating_sources(spark: SparkSession, d: str) -> DataFrame:
    """For each claim the first item of every other source that says the same, else that shares an entity."""
    return external.corroborating(domain.claims(spark, d).filter("source_id is not null"), domain.mentions(spark, d))


_VARIANT = "unnest(list_distinct([{0}, regexp_replace({0}, ' района$', ' р-на'), regexp_replace({0}, ' области$', ' обл.')]))"


@query(f"""
with n as (select id, lower(trim(canonical_name)) as k from entities where entity_type = 'organization'), v as (select id, {_VARIANT.format('k')} as k from n), u as (select k, min(id) as e from v group by 1 having count(distinct id) = 1),
p as (select distinct id, lower(trim(party_name)) as name from contract_parties where entity_id is null)
select p.id, u.e as entity_id from p join u on u.k = p.name""")
def organisations_by_variant(spark: SparkSession, d: str) -> DataFrame:
    """Parties whose name is a set variant of one organisation's alone."""
    o = table(spark, d, "entities").filter("entity_type = 'organization'").select("id", F.col("canonical_name").alias("name"))
    p = table(spark, d, "contract_parties").filter("entity_id is null").select("id", F.col("party_name").alias("name")).distinct()
    return external.by_variant(p, o, ((" района$", " р-на"), (" области$", " обл.")))


@query("""
with d as (select id, lower(coalesce(body_text, '')) as t from content_items), r as (select id, contains(t, 'рублей') or contains(t, 'проголосовали') as news, contains(t, 'оспорил') or contains(t, 'пожаловались') as bad, length(t) < 40 as short from d),
m as (select unnest(['all', 'filtered', 'news_only', 'negative_only']) as mode)
select mode, count(*) filter (where case mode when 'all' then true when 'filtered' then not short when 'news_only' then news and not short else bad end) as kept, count(*) as items from r, m group by 1""")
def relevance_modes(spark: SparkSession, d: str) -> DataFrame:
    """How many items each mode of the gate keeps."""
    t = table(spark, d, "content_items").select(F.lower(F.coalesce("body_text", F.lit(""))).alias("t"))
    has = lambda *w: F.contains("t", F.lit(w[0])) | F.contains("t", F.lit(w[1]))
    r = t.select(has("рублей", "проголосовали").alias("news"), has("оспорил", "пожаловались").alias("bad"), (F.length("t") < 40).alias("short"))
    modes = {"all": F.lit(True), "filtered": ~F.col("short"), "news_only": F.col("news") & ~F.col("short"), "negative_only": F.col("bad")}
    g = r.agg(F.count(F.lit(1)).alias("items"), *[F.count_if(c).alias(m) for m, c in modes.items()])
    return g.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("kept")) for m in modes])), "items")


@query("""
with j as (select id, metadata_json, row_number() over (partition by id) as n from contract_parties), m as (select id, json_extract_string(try_cast(metadata_json as json), '$.signed') as signed from j where n = 1)
select substr(signed, 1, 7) as month, count(*) as parties from m where signed is not null group by 1""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Parties by the month that their JSON bears."""
    p = table(spark, d, "contract_parties").select("id", "metadata_json").dropDuplicates(["id"])
    s = p.select(F.try_variant_get(F.try_parse_json("metadata_json"), "$.signed", "string").alias("s")).filter("s is not null")
    return s.groupBy(F.substring("s", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("parties"))


@query("with a as (select coalesce(content_type, 'unknown') as what, count(*) as n from content_items where id % 2 = 0 group by 1), b as (select coalesce(content_type, 'unknown') as what, count(*) as n from content_items group by 1) select b.what, coalesce(a.n, 0) as before, b.n as after, b.n - coalesce(a.n, 0) as delta from b left join a using (what)")
def before_and_after(spark: SparkSession, d: str) -> DataFrame:
    """Counts of kinds in a half of the items and in all, and their difference."""
    c = table(spark, d, "content_items").select("id", F.coalesce("content_type", F.lit("unknown")).alias("what"))
    g = c.groupBy("what").agg(F.count_if(F.col("id") % 2 == 0).alias("before"), F.count(F.lit(1)).alias("after"))
    return g.withColumn("delta", F.col("after") - F.col("before"))


@query("with r as (select id, category, row_number() over (partition by category order by is_official desc, credibility_tier, id) as rank from sources where is_active = 1) select id, category, rank::int as rank from r where rank <= 3")
def ranked_sources(spark: SparkSession, d: str) -> DataFrame:
    """The three sources to ask first in every category."""
    s = table(spark, d, "sources").filter("is_active = 1").select("id", "category", "is_official", "credibility_tier")
    return relational.top_per(s, ["category"], [F.col("is_official").desc(), F.col("credibility_tier").asc_nulls_last(), F.col("id")], 3).select("id", "category", "rank")


@query("""
with o as (select distinct source_id, external_id from raw_source_items where source_id is not null and external_id is not null), n as (select source_id, external_id, min(id) as id from content_items where source_id is not null and external_id is not null group by 1, 2)
select source_id, external_id, 'old' as origin from o union all select n.source_id, n.external_id, 'new' from n where not exists (select 1 from o where o.source_id = n.source_id and o.external_id = n.external_id)""")
def legacy_import(spark: SparkSession, d: str) -> DataFrame:
    """Items of an older store and those of the newer that it lacks, by source and external id."""
    k = ["source_id", "external_id"]
    old = table(spark, d, "raw_source_items").select(*k).dropna().distinct().withColumn("origin", F.lit("old"))
    return relational.insert_missing(old, table(spark, d, "content_items").select(*k).dropna().distinct().withColumn("origin", F.lit("new")), k)


_KEY = r"array_to_string(list_sort(string_split_regex(lower(trim({0})), '\s+')), ' ')"


@query(f"with e as (select distinct {_KEY.format('canonical_name')} as k from entities where entity_type = 'person') select {_KEY.format('sponsor_name')} as name_key, min(sponsor_name) as name, count(distinct bill_id) as bills from bill_sponsors where sponsor_name is not null and coalesce(is_collective, 0) = 0 and {_KEY.format('sponsor_name')} not in (select k from e) group by 1")
def sponsors_to_import(spark: SparkSession, d: str) -> DataFrame:
    """Sponsors that no person's full name matches, each once, whatever the order of its words."""
    key = lambda c: F.array_join(F.array_sort(F.split(F.lower(F.trim(c)), r"\s+")), " ")
    e = table(spark, d, "entities").filter("entity_type = 'person'").select(key(F.col("canonical_name")).alias("name_key")).distinct()
    s = table(spark, d, "bill_sponsors").filter("sponsor_name is not null and coalesce(is_collective, 0) = 0").withColumn("name_key", key(F.col("sponsor_name")))
    return s.join(e, "name_key", "left_anti").groupBy("name_key").agg(F.min("sponsor_name").alias("name"), F.count_distinct("bill_id").alias("bills"))


@query("""with s as (select id as source_id, case when is_active = 0 then 1 else 0 end as off from sources), i as (select source_id, count(*) as items, count(*) filter (where coalesce(body_text, '') = '') as empty from content_items where source_id is not null group by 1)
select s.source_id, coalesce(items, 0) as items, coalesce(empty, 0) as empty, coalesce(empty, 0) * 10 > coalesce(items, 0) or coalesce(items, 0) = 0 as degraded from s left join i using (source_id)""")
def degraded_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources without items, or of whose items a tenth is empty."""
    i = table(spark, d, "content_items").filter("source_id is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.coalesce("body_text", F.lit("")) == "").alias("empty"))
    x = table(spark, d, "sources").select(F.col("id").alias("source_id")).join(i, "source_id", "left").fillna(0, ["items", "empty"])
    return x.withColumn("degraded", (F.col("empty") * 10 > F.col("items")) | (F.col("items") == 0))


@query(f"""with {_SUPPORT}, z as (select w.a, w.b, coalesce(g.items, 0) as items, w.contract is not null as hard from wide w left join g on g.a = w.a and g.b = w.b)
select 'zero_support' as "check", count(*) filter (where items = 0)::double as value, (count(*) / 2.0)::double as "limit", count(*) filter (where items = 0) <= count(*) / 2.0 as ok from z union all select 'hard_share', round(avg(case when hard then 1.0 else 0.0 end), 6)::double, 0.5::double, avg(case when hard then 1.0 else 0.0 end) <= 0.5 from z""")
def candidate_checks(spark: SparkSession, d: str) -> DataFrame:
    """Pairs without support, and the share of those that a contract relates, against their limits."""
    s = relations.support(_seeds(spark, d), domain.mentions(spark, d), table(spark, d, "content_items"), table(spark, d, "sources"))
    n = s.agg(F.count_if(F.col("items") == 0).cast("double").alias("zero"), (F.count(F.lit(1)) / 2.0).alias("half"), F.round(F.avg(F.when(F.col("contract").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hard"))
    rows = F.array(F.struct(F.lit("zero_support").alias("check"), F.col("zero").alias("value"), F.col("half").cast("double").alias("limit")), F.struct(F.lit("hard_share").alias("check"), F.col("hard").alias("value"), F.lit(0.5).alias("limit")))
    return n.select(F.inline(rows)).withColumn("ok", F.col("value") <= F.col("limit"))


def _scores_sql() -> str:
    from factloom.plans import network

    return network.ORACLE["relation_scores"]


@query(f"with s as ({_scores_sql()}) select a, b, items, score from s where items > 0 order by score desc, a, b limit 180")
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best pairs with support (a report of 180)."""
    return relation_scores(spark, d).filter("items > 0").select("a", "b", "items", "score").orderBy(F.col("score").desc(), "a", "b").limit(180)


@query(f"""with {_MERGED}, n as (select src, relation_type, count(*) as n from merged where starts_with(src, 'entity:') group by 1, 2)
select src as node, string_agg(relation_type || ':' || n, ', ' order by relation_type) as links, sum(n)::bigint as degree from n group by 1""")
def graph_notes(spark: SparkSession, d: str) -> DataFrame:
    """What a note of every entity lists: its links by type."""
    n = unified_edges(spark, d).filter(F.startswith("src", F.lit("entity:"))).groupBy("src", "relation_type").agg(F.count(F.lit(1)).alias("n"))
    links = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relation_type", "n"))), lambda x: F.concat(x["relation_type"], F.lit(":"), x["n"])), ", ")
    return n.groupBy(F.col("src").alias("node")).agg(links.alias("links"), F.sum("n").alias("degree"))


@query("select id, canonical_name, regexp_extract(description, 'фракция «([^»]+)»', 1) as faction from entities where entity_type = 'person' and regexp_extract(description, 'фракция «([^»]+)»', 1) <> '' order by canonical_name, id limit 200")
def officials_screen(spark: SparkSession, d: str) -> DataFrame:
    """Officials by name with their faction (a page of 200)."""
    e = table(spark, d, "entities").filter("entity_type = 'person'").select("id", "canonical_name", F.regexp_extract("description", "фракция «([^»]+)»", 1).alias("faction")).filter("faction != ''")
    return e.orderBy("canonical_name", "id").limit(200)


@query(f"with {domain.CLAIMS} select claim_type as queue, count(*) as waiting, min(id) as first from claims where status = 'unverified' group by 1")
def review_queues(spark: SparkSession, d: str) -> DataFrame:
    """Claims that wait for review by queue."""
    return domain.claims(spark, d).filter("status = 'unverified'").groupBy(F.col("claim_type").alias("queue")).agg(F.count(F.lit(1)).alias("waiting"), F.min("id").alias("first"))


@query(f"with {domain.RELATIONS} select e.id, e.canonical_name, count(*) as rivals from relations r join entities e on e.id = r.a or e.id = r.b where r.relation_type = 'contradicts' group by 1, 2")
def rivals(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the parties in the same role of their contracts."""
    ends = relational.either_end(domain.relations(spark, d).filter("relation_type = 'contradicts'"), "a", "b").groupBy(F.col("this").alias("id")).agg(F.count(F.lit(1)).alias("rivals"))
    return table(spark, d, "entities").select("id", "canonical_name").join(ends, "id")


@query("""with x as (select coalesce(nullif(trim(title), ''), nullif(trim(url), ''), '') as label from content_items) select label, count(*) as items from x group by 1""")
def labels(spark: SparkSession, d: str) -> DataFrame:
    """Items by the first of title and address that is not blank."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "content_items").groupBy(F.coalesce(full("title"), full("url"), F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("items"))


@query(r"""with n as (select id, list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '[^\p{L}\p{N}]+'), lambda x : length(x) >= 5)) as t from content_items) select id, len(t)::int as tokens, length(array_to_string(t, ''))::int as letters from n""")
def long_title_tokens(spark: SparkSession, d: str) -> DataFrame:
    """How many different words of five letters or more every title has."""
    c = table(spark, d, "content_items").select("id", text.long_tokens(F.col("title")).alias("t"))
    return c.select("id", F.size("t").alias("tokens"), F.length(F.array_join("t", "")).alias("letters"))


@query(r"""with b as (select id, regexp_extract_all(replace(lower(trim(regexp_replace(replace(coalesce(body_text, ''), '№', 'No'), '[\s\xA0]+', ' ', 'g'))), 'ё', 'е'), '[\p{L}\p{N}_]+') as w from content_items), s as (select id, array_to_string(list_slice(w, 1, 32), ' ') as s from b), g as (select s, min(id) as canonical_id, count(*) as n from s where s <> '' group by 1 having count(*) > 1)
select s.id, g.canonical_id, g.n as copies, sha1(s.s) as signature from s join g using (s)""")
def body_copies(spark: SparkSession, d: str) -> DataFrame:
    """Items whose first 32 words another item has too, with the hash of those."""
    s = table(spark, d, "content_items").select("id", text.body_signature(F.col("body_text")).alias("s")).filter("s != ''")
    g = s.groupBy("s").agg(F.min("id").alias("canonical_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return s.join(g, "s").select("id", "canonical_id", "copies", F.sha1(F.col("s").cast("binary")).alias("signature"))


@query("""select 'no_source' as "check", (count(*) filter (where source_id is null))::double as value, 10.0::double as "limit", count(*) filter (where source_id is null) <= 10 as ok from content_items
union all select 'no_language', round(count(*) filter (where language is null) / count(*), 6)::double, 0.5::double, round(count(*) filter (where language is null) / count(*), 6) <= 0.5 from content_items
union all select 'no_time', round(count(*) filter (where published_at is null) / count(*), 6)::double, 0.2::double, round(count(*) filter (where published_at is null) / count(*), 6) <= 0.2 from content_items
union all select 'no_address', round(count(*) filter (where url is null) / count(*), 6)::double, 0.1::double, round(count(*) filter (where url is null) / count(*), 6) <= 0.1 from content_items
union all select 'archived', round(count(*) filter (where status = 'archived') / count(*), 6)::double, 0.5::double, round(count(*) filter (where status = 'archived') / count(*), 6) <= 0.5 from content_items""")
def item_gate(spark: SparkSession, d: str) -> DataFrame:
    """Shares of items that lack something, against their limits, in one pass."""
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 6)
    null = lambda c: F.col(c).isNull()
    checks = {"no_source": (F.count_if(null("source_id")), 10), "no_language": (share(null("language")), 0.5), "no_time": (share(null("published_at")), 0.2), "no_address": (share(null("url")), 0.1), "archived": (share(F.col("status") == "archived"), 0.5)}
    return quality.gate(table(spark, d, "content_items"), checks)
