"""Scalar text functions as column expressions (JVM side, null in - defined value out)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
# Hosts that stand for none; tokens of a title's and a body's signature; the longest slug.
PLACEHOLDERS, TITLE_TOKENS, BODY_TOKENS, SLUG = ("telegram-export", "unknown"), 14, 32, 80


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation, which Spark lacks."""
    return s.str.normalize("NFKC")


# Fixed value: what compatibility normalisation leaves as it is, or what is mapped here without Python.
_PLAIN = r"\x{00}-\x{7F}\x{A0}\x{A7}\x{AB}\x{B0}\x{B7}\x{BB}\x{0400}-\x{04FF}\x{2012}-\x{2015}\x{2018}-\x{201E}\x{2116}"


def spaced(c: Column) -> Column:
    """White space collapsed and trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{A0}]+", " "))


def clean_text(c: Column) -> Column:
    """NFKC, white space collapsed and trimmed; null gives ''. Only texts with rare signs go through Python."""
    rare = nfkc(F.when(c.rlike(f"[^{_PLAIN}]"), c))
    return spaced(F.coalesce(rare, F.regexp_replace(c, "№", "No")))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)


def normalize_text(c: Column) -> Column:
    """Lower case, yo folded, addresses dropped, word tokens joined by a space."""
    low = F.translate(F.lower(clean_text(c)), "ё", "е")
    return F.array_join(tokens(F.regexp_replace(low, r"https?://\S+", " ")), " ")


def slugify(c: Column, fallback: str = "item", max_len: int = SLUG) -> Column:
    s = F.substring(F.regexp_replace(normalize_text(c), " ", "-"), 1, max_len)
    return F.when(s == "", fallback).otherwise(s)


def first_tokens(c: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(normalize_text(c)), 1, n), " ")


def title_signature(title: Column, body: Column, n: int = TITLE_TOKENS) -> Column:
    t = first_tokens(title, n)
    return F.when(t != "", t).otherwise(first_tokens(body, n))


def body_signature(body: Column, n: int = BODY_TOKENS) -> Column:
    return first_tokens(body, n)


def stable_hash(*parts: Column, prefix: str = "") -> Column:
    """SHA-1 of the parts that are not empty, joined by two bars."""
    kept = F.filter(F.array(*[clean_text(p) for p in parts]), lambda x: x != "")
    return F.concat(F.lit(prefix), F.sha1(F.array_join(kept, "||").cast("binary")))


def parse_money(c: Column) -> Column:
    """An amount written with either decimal sign; null where it is none."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\d,.\-]", "")
    comma, dot = F.length(t) - F.locate(",", F.reverse(t)), F.length(t) - F.locate(".", F.reverse(t))
    plain = (
        F.when(t.contains(",") & t.contains("."), F.when(comma > dot, F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", "")))
        .when(t.contains(","), F.translate(F.translate(t, ".", ""), ",", "."))
        .otherwise(t)
    )
    return plain.try_cast("double")


def source_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(spaced(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def normalized_domain(url: Column) -> Column:
    """Host with a scheme supplied, ``www.`` stripped; null for placeholders and names without a dot that are no address (an IPv6 one stands in brackets)."""
    raw = F.trim(url)
    full = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = F.regexp_replace(F.lower(F.trim(F.regexp_extract(full, r"^[^:]*://([^/?#]*)", 1))), r"^www\.", "")
    bad = (host == "") | host.startswith("source:") | host.isin(*PLACEHOLDERS) | ~(host.contains(".") | host.rlike(r"^\[[0-9a-f:.]+\](?::\d+)?$"))
    return F.when(~bad, host)


def parse_date(c: Column) -> Column:
    """ISO text to a timestamp: ten characters are midnight, only the first nineteen are read, else null."""
    raw = F.regexp_replace(F.trim(c), "Z+$", "")
    iso = F.when(F.length(raw) == 10, F.concat(raw, F.lit("T00:00:00"))).otherwise(F.substring(raw, 1, 19))
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?$"), F.try_to_timestamp(F.translate(iso, "T", " ")))


def first_sentence(c: Column, limit: int = 180) -> Column:
    s = F.element_at(F.split(spaced(c), r"(?<=[.!?])\s+", 2), 1)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…")))


def long_tokens(c: Column, least: int = 5) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= least))


def normalized_tag(c: Column) -> Column:
    """What follows the first slash, else what follows the first colon, else the tag."""
    return F.when(F.locate("/", c) > 0, F.substr(c, F.locate("/", c) + 1)).when(F.locate(":", c) > 0, F.substr(c, F.locate(":", c) + 1)).otherwise(c)


def canonical_form(c: Column) -> Column:
    """A sentence in lower case, without quotes and closing marks."""
    t = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"), r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(t, "[«»\"“”„]", ""), "[.,;:!?…]+$", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def claim_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_-]+)"), 1))


def canonical_claim(c: Column, kind: Column | None = None, stop: tuple[str, ...] = ()) -> Column:
    """One form of a sentence; null under three words (four for statements) or in ``stop``."""
    t = canonical_form(c)
    least = F.lit(3) if kind is None else F.when(kind == "public_statement", 4).otherwise(3)
    ok = claim_words(t) >= least
    return F.when(ok & ~t.isin(*stop) if stop else ok, t)


def canonical_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def normalize_inn(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")


def negated(text: Column, keyword: str, words: tuple[str, ...], window: int = 40, gap: int = 8) -> Column:
    """Whether one of ``words`` stands up to ``gap`` characters before the keyword's first place."""
    at = F.locate(keyword, F.lower(text))
    prefix = F.substr(F.lower(text), F.greatest(F.lit(1), at - window), F.least(F.lit(window), at - 1))
    near = F.lit(False)
    for w in words:
        rest = F.length(prefix) - F.length(F.substring_index(prefix, w, -1))
        near = near | (prefix.contains(w) & (F.length(prefix) - rest <= gap))
    return (at > 0) & near
