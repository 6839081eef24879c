"""Mixed timestamp texts to UTC instants (problem 2).

An ordered cascade of anchored patterns is tried on the cleaned text; the first
that matches rewrites it to one canonical form, whose fields are then checked
strictly. Everything is a built-in column expression, so a scan is mapped in
place without a shuffle and without Python.

Local times without a zone take the default zone given for the row. A wall
time is compared with the two instants that the zone's offsets a day before and
a day after would give: exactly one of them must show that wall time. None
(the clock jumps over it) and two (the clock shows it twice) give the status
``nonexistent`` and ``ambiguous`` and no instant, unless ``on_ambiguous`` asks
for the earlier or the later instant, and ``on_nonexistent`` for the instant
that the offset before the jump gives (``forward``: the clock then shows a time
as much later as it jumped) or the one after it (``back``: as much earlier).
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and their numbers, as written in Russian and English.
MONTHS = {
    "января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6,
    "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12,
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "июн": 6,
    "июл": 7, "авг": 8, "сен": 9, "сент": 9, "окт": 10, "ноя": 11, "нояб": 11, "дек": 12, "февр": 2,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7,
    "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
# Zone abbreviations with one meaning here, in minutes east of UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "мск": 180, "msk": 180, "cet": 60, "cest": 120, "bst": 60,
    "west": 60, "eet": 120, "eest": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
WEEKDAYS = {"mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6}

_BLANK = r"[\s\u00a0\u1680\u2000-\u200d\u202f\u205f\u2060\u3000\ufeff]+"
_NAMES = "|".join(sorted(ABBREVIATIONS, key=len, reverse=True))
_ZONE = rf"(?:utc|gmt|мск|msk)[+-]\d{{1,2}}(?::?\d{{2}})?|{_NAMES}|[+-]\d{{2}}(?::?\d{{2}})?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?"
_MONTH = r"([a-zа-яё]{3,9})\.?"
_YEAR_END = r"(?: ?г\.?| года?)?"
_SUFFIX = rf"(?: ?\(?({_ZONE})\)?)?"

#: Order matters. Each pattern is anchored; the template gives
#: year|month|day|hour|minute|second|am or pm|zone|weekday, or @epoch seconds.
PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]{_CLOCK}{_SUFFIX}$", "$1|$2|$3|$4|$5|$6||$7|"),
    ("iso_date", r"^(\d{4})-(\d{2})-(\d{2})$", "$1|$2|$3||||||"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),? {_CLOCK}{_SUFFIX}$", "$3|$2|$1|$4|$5|$6||$7|"),
    ("dotted_date", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}){_YEAR_END}$", "$3|$2|$1||||||"),
    ("epoch_s", r"^(\d{10})(?:\.\d{1,9})?$", "@$1"),
    ("epoch_ms", r"^(\d{10})\d{3}$", "@$1"),
    ("epoch_us", r"^(\d{10})\d{6}$", "@$1"),
    ("epoch_ns", r"^(\d{10})\d{9}$", "@$1"),
    ("clock_dotted", rf"^{_CLOCK},? (\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}){_SUFFIX}$", "$6|$5|$4|$1|$2|$3||$7|"),
    ("compact_date", r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3||||||"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[t ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,]\d{{1,9}})?{_SUFFIX}$", "$1|$2|$3|$4|$5|$6||$7|"),
    ("named_date", rf"^(\d{{1,2}}) {_MONTH} (\d{{4}}){_YEAR_END}$", "$3|$2|$1||||||"),
    ("named", rf"^(\d{{1,2}}) {_MONTH} (\d{{4}}){_YEAR_END},?(?: в)? {_CLOCK}{_SUFFIX}$", "$3|$2|$1|$4|$5|$6||$7|"),
    ("clock_named", rf"^{_CLOCK},? (\d{{1,2}}) {_MONTH} (\d{{4}}){_YEAR_END}{_SUFFIX}$", "$6|$5|$4|$1|$2|$3||$7|"),
    ("mail", rf"^(mon|tue|wed|thu|fri|sat|sun), (\d{{1,2}}) {_MONTH} (\d{{4}}) {_CLOCK}{_SUFFIX}$", "$4|$3|$2|$5|$6|$7||$8|$1"),
    ("english", rf"^{_MONTH} (\d{{1,2}}), (\d{{4}}),? {_CLOCK} ?(am|pm)?{_SUFFIX}$", "$3|$1|$2|$4|$5|$6|$7|$8|"),
    ("english_date", rf"^{_MONTH} (\d{{1,2}}), (\d{{4}})$", "$3|$1|$2||||||"),
)


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def canonical(text: Column) -> Column:
    """The cleaned text in the canonical form of the first pattern that matches, else null."""
    out = None
    for _, pattern, template in PATTERNS:
        then = F.regexp_replace(text, pattern, template)
        out = F.when(text.rlike(pattern), then) if out is None else out.when(text.rlike(pattern), then)
    return out


def _let(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns computed once: a generator, unlike a projection, is never merged into what uses it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def known_zones(spark: SparkSession, zones: DataFrame, zone: str) -> DataFrame:
    """``zones`` with names that are no IANA zone set to null (Spark fails on those)."""
    names = F.array(*[F.lit(z) for z in sorted(available_timezones())])
    return zones.withColumn(zone, F.when(F.array_contains(names, F.col(zone)), F.col(zone)))


def to_utc(df: DataFrame, value: str, zone: str, on_ambiguous: str = "reject", on_nonexistent: str = "reject") -> DataFrame:
    """``df`` with ``utc`` (timestamp) and ``utc_status`` for the texts in ``value``.

    ``zone`` names a column with the zone of values that state none (null: such
    values are ``no_zone``). Status: ``ok``, ``null``, ``unreadable`` (no
    pattern), ``impossible`` (no such date or clock time, or a weekday that is
    not the date's), ``ambiguous``, ``nonexistent``, ``no_zone``. Fractions of a
    second are cut off, a missing clock is 00:00:00, two-digit years are 20yy.
    Works row by row: repeated rows, ties and extra columns are untouched, empty
    tables give empty results. Helper columns begin with ``_ts_``.
    """
    if on_ambiguous not in ("reject", "earlier", "later"):
        raise ValueError("on_ambiguous: reject, earlier or later")
    if on_nonexistent not in ("reject", "forward", "back"):
        raise ValueError("on_nonexistent: reject, forward or back")
    d = _let(df, _ts_t=F.trim(F.regexp_replace(F.lower(F.col(value)), _BLANK, " ")))
    d = _let(d, _ts_c=canonical(F.col("_ts_t")))
    d = _let(d, _ts_f=F.split("_ts_c", r"\|"))
    part = lambda i: F.when(F.get("_ts_f", F.lit(i)) != "", F.get("_ts_f", F.lit(i)))
    shift = r"([+-])(\d{1,2}):?(\d{2})?$"
    d = _let(
        d,
        _ts_y=part(0), _ts_mo=part(1), _ts_d=part(2).try_cast("int"), _ts_h=F.coalesce(part(3).try_cast("int"), F.lit(0)),
        _ts_mi=F.coalesce(part(4).try_cast("int"), F.lit(0)), _ts_s=F.coalesce(part(5).try_cast("int"), F.lit(0)), _ts_ap=part(6), _ts_z=part(7), _ts_day=part(8),
        _ts_e=F.when(F.substring("_ts_c", 1, 1) == "@", F.expr("try_cast(substring(_ts_c, 2) as bigint)")),
        _ts_name=F.regexp_extract(part(7), r"^([^\d+-]*)", 1), _ts_sign=F.regexp_extract(part(7), shift, 1),
        _ts_zh=F.regexp_extract(part(7), shift, 2).try_cast("int"), _ts_zm=F.coalesce(F.regexp_extract(part(7), shift, 3).try_cast("int"), F.lit(0)),
    )
    year = F.col("_ts_y").try_cast("int") + F.when(F.length("_ts_y") == 2, 2000).otherwise(0)
    month = F.coalesce(F.col("_ts_mo").try_cast("int"), F.try_element_at(_map(MONTHS), F.col("_ts_mo")))
    hour = F.col("_ts_h")
    hour = F.when(F.col("_ts_ap").isNull(), hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(F.col("_ts_ap") == "pm", 12).otherwise(0))
    d = _let(d, _ts_year=year, _ts_month=month, _ts_hour=hour)
    wall = F.when(
        (F.col("_ts_s") < 60) & (F.col("_ts_hour") < 24) & (F.col("_ts_mi") < 60),
        F.try_make_timestamp("_ts_year", "_ts_month", "_ts_d", "_ts_hour", "_ts_mi", F.col("_ts_s").cast("decimal(16,6)"), F.lit("UTC")),
    )
    offset = F.when(F.col("_ts_name") == "", 0).otherwise(F.try_element_at(_map(ABBREVIATIONS), F.col("_ts_name")))
    offset = offset + F.when(F.col("_ts_sign") == "", 0).otherwise(F.when(F.col("_ts_sign") == "-", -1).otherwise(1) * (F.col("_ts_zh") * 60 + F.col("_ts_zm")))
    offset = F.when((F.col("_ts_zh") > 18) | (F.col("_ts_zm") > 59), None).otherwise(offset)
    d = _let(d, _ts_wall=wall, _ts_offset=offset)
    # the wall time is kept as if it were UTC; its weekday must be the stated one
    wrong_day = F.col("_ts_day").isNotNull() & (
        F.pmod(F.floor(F.unix_micros("_ts_wall") / 86_400_000_000) + 3, F.lit(7)) != F.try_element_at(_map(WEEKDAYS), F.col("_ts_day"))
    )
    day_us = 86_400_000_000
    micros = lambda c: F.unix_micros(c)
    z, w = F.col(zone), F.col("_ts_wall")
    at = lambda us: F.timestamp_micros(2 * micros(w) + us - micros(F.from_utc_timestamp(F.timestamp_micros(micros(w) + us), z)))
    d = _let(d, _ts_fixed=F.timestamp_micros(micros(w) - F.col("_ts_offset").cast("long") * F.lit(60_000_000)), _ts_a=at(-day_us), _ts_b=at(day_us))
    ok = lambda c: F.coalesce(F.from_utc_timestamp(F.col(c), z) == w, F.lit(False))
    d = _let(d, _ts_ok_a=ok("_ts_a"), _ts_ok_b=ok("_ts_b"))
    two = F.col("_ts_ok_a") & F.col("_ts_ok_b") & (F.col("_ts_a") != F.col("_ts_b"))
    status = (
        F.when(F.col(value).isNull(), "null")
        .when(F.col("_ts_c").isNull(), "unreadable")
        .when(F.col("_ts_e").isNotNull(), "ok")
        .when(F.col("_ts_wall").isNull() | wrong_day, "impossible")
        .when(F.col("_ts_z").isNotNull(), F.when(F.col("_ts_fixed").isNull(), "unreadable").otherwise("ok"))
        .when(z.isNull(), "no_zone")
        .when(two, "ambiguous" if on_ambiguous == "reject" else "ok")
        .when(F.col("_ts_ok_a") | F.col("_ts_ok_b"), "ok")
        .otherwise("nonexistent" if on_nonexistent == "reject" else "ok")
    )
    pick = {"reject": F.lit(None).cast("timestamp"), "earlier": F.least("_ts_a", "_ts_b"), "later": F.greatest("_ts_a", "_ts_b")}[on_ambiguous]
    utc = (
        F.when(F.col("_ts_e").isNotNull(), F.timestamp_seconds("_ts_e"))
        .when(F.col("_ts_z").isNotNull(), F.col("_ts_fixed"))
        .when(two, pick)
        .when(F.col("_ts_ok_a"), F.col("_ts_a"))
        .when(F.col("_ts_ok_b"), F.col("_ts_b"))
        .otherwise({"reject": F.lit(None).cast("timestamp"), "forward": F.greatest("_ts_a", "_ts_b"), "back": F.least("_ts_a", "_ts_b")}[on_nonexistent])
    )
    d = _let(d, utc_status=status)
    d = d.withColumn("utc", F.when(F.col("utc_status") == "ok", utc))
    return d.drop(*[c for c in d.columns if c.startswith("_ts_")])


def utc_text(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def timestamp_values(spark: SparkSession, content_items: DataFrame, sessions: DataFrame, contracts: DataFrame, sources: DataFrame) -> DataFrame:
    """The four timestamp fields as rows (src_table, row_id, field_name, value, zone).

    ``content_items`` is scanned once for both of its fields. The zone lookup is
    deduplicated by id (least zone) so that repeated source rows multiply nothing.
    """
    zones = known_zones(spark, sources.select(F.col("id").alias("_sid"), F.col("time_zone").alias("_tz")), "_tz")
    zones = zones.groupBy("_sid").agg(F.min("_tz").alias("_tz"))
    field = lambda name, value, zone: F.struct(F.lit(name).alias("field_name"), value.alias("value"), zone.alias("zone"))
    c = content_items.select("id", "source_id", "published_at", "collected_at")
    items = c.join(zones, c.source_id == zones._sid, "left").select(
        F.lit("content_items").alias("src_table"),
        c.id.alias("row_id"),
        F.inline(F.array(field("published_at", c.published_at, F.col("_tz")), field("collected_at", c.collected_at, F.lit("UTC")))),
    )
    one = lambda df, name, col: df.select(
        F.lit(name).alias("src_table"), F.col("id").alias("row_id"), F.lit(col).alias("field_name"), F.col(col).alias("value"), F.lit("Europe/Moscow").alias("zone")
    )
    return items.unionByName(one(sessions, "bill_vote_sessions", "vote_date")).unionByName(one(contracts, "contracts", "publication_date"))
