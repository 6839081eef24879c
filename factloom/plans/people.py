"""Queries of persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import persons
from factloom.plans.registry import Registry
from factloom.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_FORMS = f"""p as (select id, string_split_regex(lower(canonical_name), '\\s+') as p from entities where entity_type = 'person'), s as (select id, unnest({persons.case_forms_sql('p[1]')}) as s, p[2] as g from p where len(p) >= 2),
f as (select id, s, unnest({persons.case_forms_sql('g')}) as g from s)"""


@query(f"with {_FORMS} select distinct id, s as surname, g as given from f")
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    """Surname and given name of every person in the cases."""
    p = table(spark, d, "entities").filter("entity_type = 'person'").select("id", F.split(F.lower("canonical_name"), r"\s+").alias("p")).filter("size(p) >= 2")
    s = p.select("id", F.explode(persons.case_forms(F.get("p", F.lit(0)))).alias("surname"), F.get("p", F.lit(1)).alias("g"))
    return s.select("id", "surname", F.explode(persons.case_forms(F.col("g"))).alias("given")).distinct()


@query(f"""with {_FORMS}, k as (select g || ' ' || s as k, min(id) as e from f group by 1 having min(id) = max(id)),
n as (select id, unnest(list_distinct(regexp_extract_all(coalesce(body_text, ''), '([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+)', 1))) as name from content_items)
select n.id, n.name, k.e as entity_id from n join k on k.k = lower(n.name)""")
def people_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Persons that items name in any case."""
    p = table(spark, d, "entities").filter("entity_type = 'person'").select("id", F.col("canonical_name").alias("name"))
    return persons.found_in_texts(table(spark, d, "content_items").select("id", F.col("body_text").alias("text")), p)


@query()
def resolved_persons(spark: SparkSession, d: str) -> DataFrame:
    """Typed names of voters merged into persons, by their votes."""
    v = table(spark, d, "bill_votes").filter("deputy_name is not null").groupBy(F.col("deputy_name").alias("name")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mentions"), F.max(F.col("entity_id").isNotNull()).alias("has_profile"))
    return persons.resolved(v)
