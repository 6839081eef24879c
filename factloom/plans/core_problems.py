"""Queries of the general problems 2 and 4 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.references import SEMANTICS, orphan_report, orphans
from factloom.operators.timestamps import timestamp_values, to_utc, utc_text
from factloom.session import table


def _timestamps(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    values = timestamp_values(spark, t("content_items"), t("bill_vote_sessions"), t("contracts"), t("sources"))
    return to_utc(values, "value", "zone")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One UTC instant for every value of the four fields that denotes one."""
    found = _timestamps(spark, d).filter("utc is not null")
    return found.select("src_table", "row_id", "field_name", utc_text(F.col("utc")).alias("utc_ts")).distinct()


def p2_status(spark: SparkSession, d: str) -> DataFrame:
    """How the values of each field came out."""
    return _timestamps(spark, d).groupBy("src_table", "field_name", "utc_status").agg(F.count(F.lit(1)).alias("n"))


#: table, referencing column, parent table, expression of the row's date text
REFERENCES = (
    ("bill_votes", "vote_session_id", "bill_vote_sessions", "try_variant_get(try_parse_json(raw_data), '$.date', 'string')"),
    ("bill_sponsors", "entity_id", "entities", "cast(null as string)"),
    ("evidence_links", "evidence_item_id", "content_items", "linked_at"),
    ("contract_parties", "contract_id", "contracts", "try_variant_get(try_parse_json(metadata_json), '$.signed', 'string')"),
)


def missing_references(spark: SparkSession, d: str) -> DataFrame:
    """(src_table, row_id, missing_id, month) of every orphan reference, each once."""
    out = None
    for name, column, parent, when in REFERENCES:
        child = table(spark, d, name).select(
            F.lit(name).alias("src_table"), F.col("id").alias("row_id"), F.col(column).alias("missing_id"), F.expr(when).alias("_when")
        )
        found = orphans(child, table(spark, d, parent).select("id"), ["missing_id"], ["id"])
        out = found if out is None else out.unionByName(found)
    out = to_utc(out.distinct().withColumn("_zone", F.lit("UTC")), "_when", "_zone")  # dates in any form
    return out.select("src_table", "row_id", "missing_id", F.substring(utc_text(F.col("utc")), 1, 7).alias("month")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose reference is not null and names no parent row."""
    return missing_references(spark, d).select("src_table", "row_id", "missing_id").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month (null: the row bears no date)."""
    return orphan_report(missing_references(spark, d), ["src_table", "month"])


def p4_composite(spark: SparkSession, d: str) -> DataFrame:
    """Items whose reference (raw_item_id, source_id), either of which may be null, names no raw item of that source, under each match semantics."""
    child = table(spark, d, "content_items").select(F.col("id").alias("row_id"), "raw_item_id", "source_id")
    parent = table(spark, d, "raw_source_items").select("id", "source_id")
    out = None
    for match in SEMANTICS:
        found = orphans(child, parent, ["raw_item_id", "source_id"], ["id", "source_id"], match).select(F.lit(match).alias("semantics"), "row_id").distinct()
        out = found if out is None else out.unionByName(found)
    return out


QUERIES = {"p4_composite": p4_composite, "p2_found": p2_found, "p2_status": p2_status, "p4_found": p4_found, "p4_report": p4_report}

_P4 = """
select 'bill_votes' as src_table, id as row_id, vote_session_id as missing_id, {v} as month from bill_votes c
 where vote_session_id is not null and not exists (select 1 from bill_vote_sessions p where p.id = c.vote_session_id)
union select 'bill_sponsors', id, entity_id, null from bill_sponsors c
 where entity_id is not null and not exists (select 1 from entities p where p.id = c.entity_id)
union select 'evidence_links', id, evidence_item_id, {l} from evidence_links c
 where evidence_item_id is not null and not exists (select 1 from content_items p where p.id = c.evidence_item_id)
union select 'contract_parties', id, contract_id, {s} from contract_parties c
 where contract_id is not null and not exists (select 1 from contracts p where p.id = c.contract_id)
"""
_MONTH = "nullif(regexp_extract({}, '^(\\d{{4}}-(?:0[1-9]|1[0-2]))-\\d{{2}}', 1), '')"
_FULL = _P4.format(
    v=_MONTH.format("json_extract_string(try_cast(raw_data as json), '$.date')"),
    l=_MONTH.format("linked_at"),
    s=_MONTH.format("json_extract_string(try_cast(metadata_json as json), '$.signed')"),
)
_NONE = "not exists (select 1 from raw_source_items p where (c.raw_item_id is null or p.id = c.raw_item_id) and (c.source_id is null or p.source_id = c.source_id))"
ORACLE = {
    "p4_composite": f"""select 'simple' as semantics, id as row_id from content_items c where raw_item_id is not null and source_id is not null and {_NONE}
 union select 'partial', id from content_items c where (raw_item_id is not null or source_id is not null) and {_NONE}
 union select 'full', id from content_items c where (raw_item_id is null) <> (source_id is null) or (raw_item_id is not null and source_id is not null and {_NONE})""",
    "p4_found": f"select distinct src_table, row_id, missing_id from ({_FULL}) x",
    "p4_report": f"select src_table, month, count(*) as orphan_rows, count(distinct missing_id) as missing_keys from ({_FULL}) x group by all",
}
