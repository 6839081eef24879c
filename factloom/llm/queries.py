"""Queries of the llm problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import boilerplate, bpe, history, leaks, names, neardup, ocr, uniform
from factloom.session import table


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look the same but are written with different characters."""
    return uniform.same_look_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document of a look with several writings, by look and writing."""
    return uniform.look_classes(table(spark, d, "documents")).withColumnRenamed("k", "doc_id")


def p10_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Every document in uniform form."""
    return uniform.add_uniform(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "uniform_text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """All lines to remove: those in blocks (of one line or more) that a source repeats."""
    return boilerplate.repeated_lines(table(spark, d, "content_items")).withColumnRenamed("item", "content_item_id")


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The repeated blocks of each source, of every length: those that are not always followed by one same line."""
    return boilerplate.Blocks(table(spark, d, "content_items")).report()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every item's body without the repeated lines."""
    items = table(spark, d, "content_items").select("id", "source_id", "body_text")
    return boilerplate.without_repeated_lines(items).select(F.col("id").alias("content_item_id"), "clean_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that repeat an accepted one, judged in loads of four weeks, each against the persisted index that the ones before left."""
    items = table(spark, d, "raw_source_items")
    return history.judge_in_batches(items, table(spark, d, "raw_blobs"), history.loads_by_days(items, 28))


def p3_bulk(spark: SparkSession, d: str) -> DataFrame:
    """The same as one load against an empty index."""
    return history.judge_in_batches(table(spark, d, "raw_source_items"), table(spark, d, "raw_blobs"))


def _typed_names(spark: SparkSession, d: str) -> DataFrame:
    """(src_table, row_id, entity_id, person, name, hint) of all typed names that are no collective."""
    votes = table(spark, d, "bill_votes").select(F.lit("bill_votes").alias("src_table"), F.col("id").alias("row_id"), "entity_id", F.lit(True).alias("person"), F.col("deputy_name").alias("name"), F.col("faction").alias("hint"))
    sponsors = table(spark, d, "bill_sponsors").filter("coalesce(is_collective, 0) = 0")
    sponsors = sponsors.select(F.lit("bill_sponsors").alias("src_table"), F.col("id").alias("row_id"), "entity_id", F.lit(True).alias("person"), F.col("sponsor_name").alias("name"), F.col("faction").alias("hint"))
    parties = table(spark, d, "contract_parties")
    parties = parties.select(F.lit("contract_parties").alias("src_table"), F.col("id").alias("row_id"), "entity_id", F.lit(False).alias("person"), F.col("party_name").alias("name"), F.col("inn").alias("hint"))
    return votes.unionByName(sponsors).unionByName(parties)


def _named_entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").filter("entity_type in ('person', 'organization')")
    person = F.col("entity_type") == "person"
    return e.select("id", person.alias("person"), F.col("canonical_name").alias("name"), F.when(person, F.col("description")).otherwise(F.col("inn")).alias("hint"))


def _linked(rows: DataFrame, entities: DataFrame) -> DataFrame:
    rows = rows.withColumnRenamed("entity_id", "given")
    linked = names.link(rows, entities)
    linked = linked.toDF("_person", "_name", "_hint", "entity_id")
    same = (F.col("person") == F.col("_person")) & (F.col("name") == F.col("_name")) & F.col("hint").eqNullSafe(F.col("_hint"))
    return rows.join(linked, same).select("src_table", "row_id", "person", "name", "hint", "given", "entity_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every typed name without one."""
    rows = _typed_names(spark, d).filter("entity_id is null")
    return _linked(rows, _named_entities(spark, d)).select("src_table", "row_id", "entity_id")


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Names that already bear an entity of the table: how many come out as that one, as another, as none."""
    entities = _named_entities(spark, d)
    rows = _typed_names(spark, d).join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").distinct()
    out = rows.select("src_table", "row_id", F.col("entity_id").alias("given")).join(_linked(rows, entities).select("src_table", "row_id", "entity_id"), ["src_table", "row_id"], "left")
    kind = F.when(F.col("entity_id").isNull(), "none").when(F.col("entity_id") == F.col("given"), "same").otherwise("other")
    return out.groupBy("src_table", kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned texts to drop, to join with the next, or with a misread character."""
    return ocr.scan_noise(table(spark, d, "attachments"))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """The scanned texts as running text."""
    return ocr.running_text(table(spark, d, "attachments"))


def _stories(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    items = table(spark, d, "content_items").filter("body_text != ''").select("id", "title", "body_text")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("body_text"))
    return neardup.NearDuplicates(items.select(F.col("id").alias("k"), text.alias("t")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of items that are alike in half of their three-word sequences."""
    return _stories(spark, d).pairs()


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every item with its class of equal sequence sets and the classes it is alike to."""
    return _stories(spark, d).membership().withColumnRenamed("k", "content_item_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The test items that each document gives away: 12 consecutive words in common."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of 16 consecutive words with up to 2 words changed, left out or put in."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"), words=16, errors=2)


QUERIES = {"p6_found": p6_found, "p6_text": p6_text, "p5_found": p5_found, "p5_agreement": p5_agreement, "p3_found": p3_found, "p3_bulk": p3_bulk, "p7_found": p7_found, "p7_classes": p7_classes, "p1_found": p1_found, "p1_blocks": p1_blocks, "p1_clean": p1_clean, "p8_ids": p8_ids, "p9_found": p9_found, "p9_edited": p9_edited, "p10_found": p10_found, "p10_uniform": p10_uniform, "p10_classes": p10_classes}
_LINE = r"trim(regexp_replace(regexp_replace(lower(line), '[\s\p{Z}]+', ' ', 'g'), '\p{Nd}+', '0', 'g'))"
_HOT = f"""
with items as (select distinct id, source_id, body_text from content_items where body_text <> '' and source_id is not null),
cut as (select id, source_id, unnest(string_split(body_text, chr(10))) as line, generate_subscripts(string_split(body_text, chr(10)), 1) as line_no from items),
keyed as (select id, source_id, line_no, {_LINE} as k from cut),
n as (select source_id, count(distinct id) as n from items group by 1),
hot as (select source_id, k from keyed join n using (source_id) where k <> '' group by source_id, k, n having count(distinct id) >= 3 and count(distinct id) * 40 >= n)"""
_P1 = f"{_HOT} select distinct id as content_item_id, line_no from keyed join hot using (source_id, k)"
_P1_BLOCKS = f"""{_HOT}, seq as (select source_id, id, k, row_number() over (partition by source_id, id order by line_no) as pos from keyed where k <> ''),
g as (select source_id, id, k, pos, pos - row_number() over (partition by source_id, id order by pos) as r from seq join hot using (source_id, k)),
runs as (select source_id, id, r, list(k order by pos) as ks from g group by 1, 2, 3), a as (select *, unnest(range(1, len(ks) + 1)) as i from runs), b as (select *, unnest(range(1, len(ks) - i + 2)) as l from a),
sub as (select source_id, id, l, md5(array_to_string(list_slice(ks, i, i + l - 1), chr(10))) as b, ks[i + l] as following from b),
ahead as (select source_id, l, b, max(c) as c from (select source_id, l, b, following, count(*) as c from sub where following is not null group by 1, 2, 3, 4) group by 1, 2, 3),
blocks as (select source_id, l, b, count(distinct id) as n_items, count(*) as n_places from sub group by 1, 2, 3)
select source_id, l as n_lines, n_items, n_places from blocks join n using (source_id) left join ahead using (source_id, l, b) where n_items >= 3 and n_items * 40 >= n and coalesce(c, 0) < n_places"""
_P1_CLEAN = f"""{_HOT}, gone as (select distinct id, line_no from keyed join hot using (source_id, k)), body as (select distinct id, body_text from content_items),
kept as (select id, string_agg(line, chr(10) order by line_no) as t from (select distinct id, line, line_no from cut) where (id, line_no) not in (select (id, line_no) from gone) group by 1)
select b.id as content_item_id, case when b.body_text is null or b.id not in (select id from gone) then b.body_text else coalesce(kept.t, '') end as clean_text from body b left join kept using (id)"""

_P7 = r"""
with t as (select id, regexp_extract_all(lower(coalesce(title, '') || ' ' || body_text), '[\p{L}\p{N}]+') as w from content_items where body_text <> ''),
g as (select distinct id, hash(w[i] || ' ' || w[i+1] || ' ' || w[i+2]) as s from (select id, w, unnest(range(1, len(w) - 1)) as i from t)),
n as (select id, count(*) as n from g group by 1),
c as (select a.id as x, b.id as y, count(*) as c from g a join g b on a.s = b.s and a.id < b.id group by 1, 2)
select x as id_a, y as id_b from c join n p on p.id = x join n q on q.id = y where c * 3 >= p.n + q.n"""

_P7_CLASSES = rf"""
with t as (select id, regexp_extract_all(lower(coalesce(title, '') || ' ' || body_text), '[\p{{L}}\p{{N}}]+') as w from content_items where body_text <> ''),
g as (select distinct id, hash(w[i] || ' ' || w[i+1] || ' ' || w[i+2]) as s from (select id, w, unnest(range(1, len(w) - 1)) as i from t)),
k as (select id, md5(list_sort(list(s))::varchar) as k, count(*) as n from g group by 1), m as (select k, min(id) as class_id, any_value(n) as n from k group by 1), r as (select g.id, g.s from g join m on m.class_id = g.id),
c as (select a.id as x, b.id as y, count(*) as c from r a join r b on a.s = b.s and a.id <> b.id group by 1, 2), l as (select x, count(*) as links from c join m p on p.class_id = x join m q on q.class_id = y where c * 3 >= p.n + q.n group by 1)
select k.id as content_item_id, m.class_id, coalesce(l.links, 0) as links from k join m using (k) left join l on l.x = m.class_id"""
_P10_CLASSES = f"""
with t as (select distinct doc_id, text, {uniform.uniform_sql("text")} as look from documents where text is not null), s as (select * from t where regexp_matches(look, '\\S')),
w as (select look, text, min(doc_id) as writing_id from s group by 1, 2), n as (select look, min(writing_id) as look_id, count(*) as writings from w group by 1 having count(*) > 1)
select s.doc_id, n.look_id, w.writing_id, n.writings from s join n using (look) join w using (look, text)"""
_WORDS = f"regexp_extract_all({leaks.oracle_form('text')}, '[\\p{{L}}\\p{{N}}]+')"
_P9 = rf"""
with i as (select distinct item_id, {_WORDS} as w from benchmark where text is not null), d as (select distinct doc_id, {_WORDS} as w from documents where text is not null),
a as (select distinct item_id, md5(array_to_string(list_slice(w, k, k + 11), ' ')) as h from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i)),
b as (select doc_id, md5(array_to_string(list_slice(w, k, k + 11), ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d))
select distinct item_id, doc_id from a join b using (h)"""

ORACLE = {"p7_found": _P7, "p1_found": _P1, "p1_blocks": _P1_BLOCKS, "p1_clean": _P1_CLEAN, "p10_found": uniform.oracle(), "p10_classes": _P10_CLASSES, "p9_found": _P9, "p7_classes": _P7_CLASSES}
