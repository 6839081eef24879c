"""Queries of rules over texts: tags, votes, signals, rhetoric, negation, references, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import classify as c
from factloom.operators import similarity
from factloom.plans import domain
from factloom.plans.registry import Registry
from factloom.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

RULES = (
    ("budget", (("бюджет", 2.0), ("рублей", 1.5), ("смет", 1.0), ("млн", 0.5)), 1.5),
    ("vote", (("проголосовали", 3.0), ("депутат", 1.0)), 3.0),
    ("works", (("ремонт", 2.0), ("реконструкци", 2.0), ("мост", 0.5)), 2.0),
    ("health", (("больниц", 2.0),), 2.0),
)
CONTEXT = ("комисси", "собрание")
BOOSTS = (("vote", ("воздержались", "против"), 3.0, True), ("regional", ("ского района", "ской области"), 1.0, False))
REGISTRY = (
    ("keyword", "hospital", ("больниц", "поликлиник")), ("keyword", "bridge", ("мост", "переправ")), ("keyword", "archive", ("архив",)), ("keyword", "school", ("школ",)), ("keyword", "forest", ("лесн", "лес ")),
    ("region", "озёрский", ("озерского",)), ("region", "ольховский", ("ольховского",)), ("region", "лужский", ("лужского",)), ("region", "мостовский", ("мостовского",)),
)
MOST = {"keyword": 3, "region": 2}
STRICT, GENERIC = ("official_document", "bill"), ("archive", "school")
SIGNALS = (("money", (("рублей", 2.0), ("млн", 1.5), ("стоимость", 1.0))), ("delay", (("перенесли", 3.5), ("отложил", 3.5))), ("dispute", (("оспорил", 2.0), ("раскритиковал", 2.5), ("пожаловались", 3.0))))
RHETORIC = (("plain_talk", "нужно говорить прямо"), ("closed", "закрытом режиме|при пустом зале"), ("numbers", r"на [0-9]+ процент"))
LAWS = (("document", r"№ ?(\d+-[А-Я])"), ("protocol", r"[Пп]ротокол[а-я]* № ?(\d+)"), ("percent", r"на (\d+) процент"), ("points", r"(\d+) пункт"))

_D = "d as (select id, content_type, source_id, ' ' || lower(coalesce(body_text, '')) || ' ' as t from content_items)"


def _docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "content_items").select("id", *more, F.col("body_text").alias("text"))


def _points(patterns) -> str:
    return "(" + " + ".join(f"case when {c.pattern_sql(p)} then {x} else 0.0 end" for p, x in patterns) + ")::double"


_HAS = "(" + " or ".join(c.pattern_sql(p) for p in CONTEXT) + ")"
_SCORED = " union all ".join(
    [f"select id, '{t}' as tag, case when {_points(ps)} >= {least} then {_points(ps)} else 0 end as score from d" for t, ps, least in RULES]
    + [f"select id, '{t}', {f'case when {_HAS} then 1.0 else 0.0 end * ' if needs else ''}{_points([(p, x) for p in ps])} from d" for t, ps, x, needs in BOOSTS]
)


@query(f"with {_D}, s as ({_SCORED}) select id, tag, sum(score)::double as score from s where score > 0 group by 1, 2")
def context_tags(spark: SparkSession, d: str) -> DataFrame:
    """Rule scores of every item, raised by context."""
    return c.context_scores(_docs(spark, d), RULES, CONTEXT, BOOSTS)


_GRANULAR = " union all ".join(f"select id, '{k}' as kind, '{t}' as tag, {i} as n from d where {' or '.join(c.pattern_sql(p) for p in ps)}" for i, (k, t, ps) in enumerate(REGISTRY))
_GRANULAR = f"{_D}, g0 as ({_GRANULAR}), g as (select *, row_number() over (partition by id, kind order by n) as k from g0), granular as (select id, kind, tag from g where (kind = 'keyword' and k <= 3) or (kind = 'region' and k <= 2))"


@query(f"with {_GRANULAR} select * from granular")
def granular_tags(spark: SparkSession, d: str) -> DataFrame:
    """Keywords and regions of every item."""
    return c.granular_tags(_docs(spark, d), REGISTRY, MOST)


_VOTES = f"""{_GRANULAR}, s as ({_SCORED}), rules as (select id, tag, sum(score)::double as score from s where score > 0 group by 1, 2),
v as (select r.id, tag, least(score / 20.0, 1.0) as confidence from rules r union all select id, tag, case kind when 'keyword' then 0.78 else 0.84 end from granular),
w as (select v.id, v.tag, v.confidence, case when v.tag in ('archive', 'school') and d.content_type in ('official_document', 'bill') and not ({_HAS}) then 'abstain' else 'support' end as vote from v join d using (id)),
final as (select id, tag, round(least(0.99, greatest(0.05, 1 / (1 + exp(-(avg(confidence) - 0.55) * 6)) + least(0.15, (count(*) - 1) * 0.05))), 4)::double as confidence, count(*) as votes from w where vote = 'support' group by 1, 2)"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "content_type")
    rules = context_tags(spark, d).select("id", "tag", F.least(F.col("score") / 20.0, F.lit(1.0)).alias("confidence"))
    fine = granular_tags(spark, d).select("id", "tag", F.when(F.col("kind") == "keyword", 0.78).otherwise(0.84).alias("confidence"))
    has = F.lit(False)
    for p in CONTEXT:
        has = has | c.pattern_found(p)
    kind = c.lowered(docs).select("id", F.col("content_type").alias("kind"), has.alias("has_context"))
    return c.guarded_votes(rules.unionByName(fine).join(kind, "id"), STRICT, GENERIC)


@query(f"with {_VOTES} select tag, vote, count(*) as n, round(sum(confidence), 4)::double as confidence from w group by 1, 2")
def tag_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of rules and keywords by tag, those that abstain too."""
    return _votes(spark, d).groupBy("tag", "vote").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query(f"with {_VOTES} select * from final")
def final_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tags that every item ends with."""
    return c.final_tags(_votes(spark, d))


@query(f"with {_GRANULAR} select g.id, g.kind, g.tag from granular g join d using (id) where not (coalesce(d.content_type in ('official_document', 'bill'), false) and g.tag in ('archive', 'school'))")
def tags_without_generic(spark: SparkSession, d: str) -> DataFrame:
    """Keywords without generic ones on strict kinds of items."""
    return c.without_generic(granular_tags(spark, d), table(spark, d, "content_items"), STRICT, GENERIC).select("id", "kind", "tag")


@query(f"with {_GRANULAR} select d.content_type, g.tag, count(*) as n from granular g join d using (id) where d.content_type in ('official_document', 'bill') and g.tag in ('archive', 'school') group by 1, 2 order by n desc, 1, 2 limit 30")
def generic_on_strict(spark: SparkSession, d: str) -> DataFrame:
    """The commonest generic tags on strict kinds (a report of thirty)."""
    i = table(spark, d, "content_items").filter(F.col("content_type").isin(*STRICT)).select("id", "content_type")
    g = granular_tags(spark, d).filter(F.col("tag").isin(*GENERIC)).join(i, "id").groupBy("content_type", "tag").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "content_type", "tag").limit(30)


_SIGNALS = f"""{_D}, sg as (select id, source_id, {", ".join(f"{_points(ps)} as {n}" for n, ps in SIGNALS)} from d),
st as (select id, source_id, round({" + ".join(n for n, _ in SIGNALS)}, 2)::double as total, array_to_string(list_sort(list_filter([{", ".join(f"case when {n} >= 3.5 then '{n}' end" for n, _ in SIGNALS)}], lambda x : x is not null)), ',') as categories from sg)"""


@query(f"with {_SIGNALS} select id, total, categories from st")
def negative_signals(spark: SparkSession, d: str) -> DataFrame:
    """Points of every item by categories of bad news."""
    return c.signals(_docs(spark, d), SIGNALS)


@query(f"with {_SIGNALS} select st.id, total, categories, total >= case when s.is_official = 1 then 7.0 when s.category = 'telegram' then 5.0 else 4.0 end and categories <> '' as flagged from st join sources s on s.id = st.source_id")
def negative_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Items whose points reach the threshold of their source."""
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.when(F.col("is_official") == 1, 7.0).when(F.col("category") == "telegram", 5.0).otherwise(4.0).alias("least"))
    x = negative_signals(spark, d).join(table(spark, d, "content_items").select("id", "source_id"), "id").join(s, "source_id")
    return c.profile(x, F.col("least")).select("id", "total", "categories", "flagged")


@query(f"with {_SIGNALS} select coalesce(s.category, 'unknown') as category, count(*) as items, count(*) filter (where total > 0) as signalled, round(avg(total), 4)::double as mean from st left join sources s on s.id = st.source_id group by 1")
def negative_audit(spark: SparkSession, d: str) -> DataFrame:
    """Signals by kind of source."""
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "category")
    x = negative_signals(spark, d).join(table(spark, d, "content_items").select("id", "source_id"), "id").join(s, "source_id", "left")
    return x.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("total") > 0).alias("signalled"), F.round(F.avg("total"), 4).alias("mean"))


@query(rf"""with {domain.CLAIMS}, t as (select id, claim_type, trim(regexp_replace(claim_text, '\s+', ' ', 'g')) as t from claims)
select id, claim_type from t where length(t) >= 18 and len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_-]+')) >= 3 and not regexp_matches(lower(t), '^(?:ранее|при этом)') and (claim_type not in ('public_statement', 'corruption_claim') or regexp_matches(t, '[0-9]|района|области'))""")
def informative_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that tell something."""
    return c.informative(domain.claims(spark, d), "[0-9]|района|области", ("public_statement", "corruption_claim"), "^(?:ранее|при этом)").select("id", "claim_type")


@query(f"with {_D} " + " union all ".join(f"select id, '{n}' as class from d where regexp_matches(t, '{p}')" for n, p in RHETORIC))
def rhetoric_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of rhetoric in every item."""
    return c.rhetoric_classes(_docs(spark, d), RHETORIC)


@query(rf"with {_D} select id, len(regexp_extract_all(t, 'выполнил|сообщает'))::int as hits, len(regexp_extract_all(t, '(?s)(не |без ).{{0,8}}?(?:выполнил|сообщает)'))::int as negated from d")
def negated_places(spark: SparkSession, d: str) -> DataFrame:
    """How often "выполнил" or "сообщает" stands in every item, and how often negated."""
    return c.negations(_docs(spark, d), "выполнил|сообщает", ("не ", "без "))


@query(f"""with {domain.CLAIMS}, {_D}, x as (select c.id, c.status, case when (c.claim_type = 'vote_record' and regexp_matches(t, 'отклонил')) or (c.claim_type = 'corruption_claim' and regexp_matches(t, 'не сообщает')) then 'negated' when regexp_matches(t, 'опроверг|оспорил') then 'rebutted' end as outcome from claims c join d on d.id = c.content_item_id)
select id, outcome, case when outcome = 'negated' and status in ('unverified', 'likely_false') then 'likely_false' else status end as status, (case when outcome = 'negated' then 0.3 else 0.2 end)::double as risk from x where outcome is not null""")
def negated_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that their item's text negates or rebuts."""
    return c.negated_claims(domain.claims(spark, d), _docs(spark, d), {"vote_record": "отклонил", "corruption_claim": "не сообщает"}, "опроверг|оспорил")


_REFS = " union all ".join(f"select id, t, '{k}' as kind, unnest(list_distinct(regexp_extract_all(t, '{p}', 1))) as number from x" for k, p in LAWS)


@query(rf"with x as (select id, regexp_replace(coalesce(body_text, ''), '\s+', ' ', 'g') as t from content_items), r as ({_REFS}) select id, kind, number, substr(t, greatest(1, instr(t, number) - 60), instr(t, number) - greatest(1, instr(t, number) - 60) + length(number) + 40) as context from r")
def law_references(spark: SparkSession, d: str) -> DataFrame:
    """Documents, protocols and figures that items refer to, with what stands around them."""
    return c.references(_docs(spark, d), LAWS)


TERMS = (r"№ ?(\d+-[А-Я])", r"([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+)", "«([^»]{4,80})»", "([А-ЯЁ][а-яё-]{4,})")
_TERMS = ", ".join(f"regexp_extract_all(t, '{p}', 1)" for p in TERMS)


@query(rf"""with x as (select id, list_filter(list_transform(flatten([{_TERMS}]), lambda v : trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v : length(v) >= 4 and lower(v) not in ('ранее', 'документ')) as c from (select id, coalesce(body_text, '') as t from content_items))
select id, array_to_string(list_slice(list_filter(c, lambda v, i : list_position(list_transform(c, lambda y : lower(y)), lower(v)) = i), 1, 8), '|') as terms from x""")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """What to search for to check every item."""
    return c.search_terms(_docs(spark, d), TERMS, ("ранее", "документ"))


ROLES = (("said", r"(?:подчеркнул[а]?|уточнил[а]?|напомнил[а]?|признал[а]?|заявил[а]?|отметил[а]?) ([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+)"), ("told", r"([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+) (?:подчеркнул|уточнил|напомнил|признал|заявил|отметил)"))


@query(rf"""with r as ({" union all ".join(f"select id, '{k}' as role, unnest(list_distinct(regexp_extract_all(coalesce(body_text, ''), '{p}', 1))) as name from content_items" for k, p in ROLES)}),
e as (select array_to_string(list_sort(list_slice(string_split_regex(lower(canonical_name), '\s+'), 1, 2)), ' ') as k, min(id) as entity_id from entities where entity_type = 'person' group by 1 having count(*) = 1)
select id, role, name, coalesce(entity_id, 0) as entity_id from r left join e on e.k = array_to_string(list_sort(list_slice(string_split_regex(lower(name), '\s+'), 1, 2)), ' ')""")
def stated_roles(spark: SparkSession, d: str) -> DataFrame:
    """Who says something in an item, and which person that is (0: none or several)."""
    e = table(spark, d, "entities").filter("entity_type = 'person'").select("id", F.col("canonical_name").alias("name"))
    return c.roles_stated(_docs(spark, d), ROLES, e).fillna(0, ["entity_id"])


KINDS = (("vote", "проголосовали"), ("money", "рублей"), ("complaint", "пожаловались|оспорил"))


@query(rf"""with x as (select id, trim(regexp_replace(coalesce(body_text, ''), '\s+', ' ', 'g')) as t from content_items), s as (select id, t, case when regexp_extract(t, '^(.*?[.!?])(?:\s|$)', 1) = '' then t else regexp_extract(t, '^(.*?[.!?])(?:\s|$)', 1) end as s from x)
select id, case {" ".join(f"when regexp_matches(lower(t), '{p}') then '{k}'" for k, p in KINDS)} else 'other' end as kind, case when length(s) > 220 then rtrim(substr(s, 1, 219)) || '…' else s end as summary, array_to_string(list_distinct_ordered, '|') as names
from (select *, list_filter(w, lambda v, i : list_position(w, v) = i) as list_distinct_ordered from (select *, regexp_extract_all(t, '([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+)', 1) as w from s))""")
def structured_items(spark: SparkSession, d: str) -> DataFrame:
    """A kind, a summary and the names of every item."""
    return c.structured(_docs(spark, d), KINDS, "([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+)")


def _with_signature() -> str:
    from factloom.plans import reference

    return reference.ORACLE["title_signature_dedupe"]


@query(f"""with {_D}, m as ({_with_signature()}), g as (select canonical_id, count(*) as group_size from m group by 1 having count(*) >= 3)
select canonical_id, group_size, 'repeated template' as reason from g join d on d.id = g.canonical_id where contains(t, 'района') or contains(t, 'опубликовал')""")
def template_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one title that repeat a template."""
    return c.template_groups(similarity.signature_groups(table(spark, d, "content_items")), _docs(spark, d), ("района", "опубликовал"))


@query("""with n as (select count(*) as total from content_items) select coalesce(status, 'unknown') as label, count(*) as n, round(count(*) / max(total), 6)::double as share from content_items, n group by 1""")
def status_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Items by status with their shares."""
    return c.distribution(table(spark, d, "content_items"), "status")


@query(f"""with {_VOTES}, t as (select id, list(tag) as h from final where confidence >= 0.2 group by 1)
select case when list_contains(h, 'vote') then 'vote' when list_contains(h, 'works') then 'works' when list_contains(h, 'budget') then 'budget' else 'other' end as topic, count(*) as items from t group by 1 having count(*) >= 5""")
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Items by the first of a list of topics that they bear, topics of five or more."""
    t = final_tags(spark, d).filter("confidence >= 0.2").groupBy("id").agg(F.collect_set("tag").alias("h"))
    topic = F.when(F.array_contains("h", "vote"), "vote").when(F.array_contains("h", "works"), "works").when(F.array_contains("h", "budget"), "budget").otherwise("other")
    return t.groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("items")).filter("items >= 5")
