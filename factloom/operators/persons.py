"""Persons by their names: case forms, names in texts, and the merging of records of one person.

Names stand surname first (surname, given name, patronymic).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of names in the nominative, what of them is dropped, and the endings of their case forms.
ENDINGS = (
    ("ский", 2, "ий ого ому им ом"), ("ской", 2, "ой ого ому им ом"), ("ская", 2, "ая ой ую"), ("ова", 1, "а ой у"), ("ева", 1, "а ой у"), ("ина", 1, "а ой у"), ("ына", 1, "а ой у"),
    ("ов", 0, " а у ым е"), ("ев", 0, " а у ым е"), ("ин", 0, " а у ым е"), ("ын", 0, " а у ым е"), ("ий", 1, "й я ю ем и"), ("ей", 1, "й я ю ем е"), ("ь", 1, "ь я ю ем е"), ("ия", 1, "я и ю ей"), ("я", 1, "я и е ю ей"), ("а", 1, "а ы е у ой"),
)
CONSONANT = ("[бвгджзклмнпрстфхцчшщ]$", " а у ом е")


def case_forms(name: Column) -> Column:
    """The forms that a surname or given name takes in the cases, the nominative among them; other names are their own one form."""
    made = lambda drop, ends: F.array(*[F.concat(F.substr(name, F.lit(1), F.length(name) - drop), F.lit(e)) for e in ends.split(" ")])
    out = None
    for end, drop, ends in ENDINGS:
        test = F.endswith(name, F.lit(end))
        out = F.when(test, made(drop, ends)) if out is None else out.when(test, made(drop, ends))
    return out.when(name.rlike(CONSONANT[0]), made(0, CONSONANT[1])).otherwise(F.array(name))


def case_forms_sql(name: str) -> str:
    """The same for DuckDB."""
    made = lambda drop, ends: "[" + ", ".join(f"substr({name}, 1, length({name}) - {drop}) || '{e}'" for e in ends.split(" ")) + "]"
    parts = [f"when ends_with({name}, '{end}') then {made(drop, ends)}" for end, drop, ends in ENDINGS]
    return f"case {' '.join(parts)} when regexp_matches({name}, '{CONSONANT[0]}') then {made(0, CONSONANT[1])} else [{name}] end"


def found_in_texts(docs: DataFrame, persons: DataFrame) -> DataFrame:
    """(id, name, entity_id): two capitalised words of a text (id, text) that are a form of the given name and surname of one person (id, name) alone, each once a text.

    An equality join on all forms; persons of equal forms are left out.
    """
    n = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+)"), 1))).alias("name"))
    p = persons.select(F.col("id").alias("entity_id"), F.split(F.lower("name"), r"\s+").alias("p")).filter("size(p) >= 2")
    f = p.select("entity_id", F.explode(case_forms(F.get("p", F.lit(0)))).alias("s"), F.get("p", F.lit(1)).alias("g")).select("entity_id", "s", F.explode(case_forms(F.col("g"))).alias("g"))
    f = f.groupBy(F.concat_ws(" ", "g", "s").alias("k")).agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_hi")).filter("entity_id = _hi").drop("_hi")
    return n.join(f, F.lower("name") == F.col("k")).select("id", "name", "entity_id")


def can_merge(a: str, b: str) -> bool:
    """Whether two names may be one person's: surnames of one root, further parts equal, initials of each other, or missing."""
    x, y = ([t.strip(".") for t in s.lower().replace("ё", "е").split()] for s in (a, b))
    if not x or not y:
        return False
    short, long = sorted((x[0], y[0]), key=len)
    if short != long and not (len(short) >= 4 and long.startswith(short[: max(4, len(short) - 2)]) and len(long) - len(short) <= 2):
        return False
    for p, q in zip(x[1:], y[1:]):  # noqa: B905
        if p != q and not (len(p) == 1 and q.startswith(p)) and not (len(q) == 1 and p.startswith(q)):
            return False
    return True


def resolved(persons: DataFrame) -> DataFrame:
    """(id, primary_id) of persons (id, name, mentions, has_profile): records that may be one person's get the id of the best of them.

    Blocks are the first four letters of the surname and the first letter of
    the given name. Within a block distinct names stand by profile, mentions
    and id, and each joins the first before it that it may be merged with; rows
    of one name are one. Names of one word stay as they are: nothing tells them apart.
    """
    p = persons.filter("name is not null").withColumn("_n", F.trim(F.regexp_replace(F.translate(F.lower("name"), "ё", "е"), r"\s+", " ")))
    rank = F.struct(F.coalesce("has_profile", F.lit(False)).alias("p"), F.coalesce("mentions", F.lit(0)).alias("m"), (-F.col("id")).alias("i"))
    names = p.groupBy("_n").agg(F.max(rank).alias("r")).select("_n", "r.*").withColumn("_block", F.regexp_extract("_n", r"^(\S{1,4})\S* (\S)", 0))
    names = names.withColumn("_block", F.concat(F.substring("_n", 1, 4), F.regexp_extract("_n", r"^\S+ (\S)", 1)))

    def each(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["p", "m", "i"], ascending=False)
        heads: list[tuple[str, int]] = []
        out = []
        for n, i in zip(block["_n"], -block["i"], strict=True):
            head = next((h for h in heads if " " in n and " " in h[0] and can_merge(h[0], n)), None)
            if head is None:
                heads.append((n, int(i)))
            out.append((n, head[1] if head else int(i)))
        return pd.DataFrame(out, columns=["_n", "primary_id"])

    merged = names.groupBy("_block").applyInPandas(each, "_n string, primary_id long")
    return p.join(merged, "_n").select("id", "primary_id")
