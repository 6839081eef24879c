import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from factloom.operators.timestamps import timestamp_values, to_utc, utc_text
from pyspark.sql import functions as F

CASES = [
    ("2025-06-11T05:43:04+00:00", "Europe/Riga", "ok", "2025-06-11T05:43:04Z"),
    ("2025-06-11T05:43:04.999Z", None, "ok", "2025-06-11T05:43:04Z"),
    (" 2024-10-27T01:30:00 UTC ", "Europe/Berlin", "ok", "2024-10-27T01:30:00Z"),
    ("17 августа 2025 в 15:33", "Asia/Vladivostok", "ok", "2025-08-17T05:33:00Z"),
    ("23 ФЕВРАЛЯ 2026 г. 11:31", "Europe/Moscow", "ok", "2026-02-23T08:31:00Z"),
    ("11 дек 2025 в 16:54", "Europe/Moscow", "ok", "2025-12-11T13:54:00Z"),
    ("08.02.2024 05:27 (МСК+2)", "America/New_York", "ok", "2024-02-08T00:27:00Z"),
    ("Mar 28, 2024 1:40 AM MSK", None, "ok", "2024-03-27T22:40:00Z"),
    ("Mar 28, 2024 12:05 PM EEST", None, "ok", "2024-03-28T09:05:00Z"),
    ("Tue, 10 Mar 2026 02:20:08 +0300", None, "ok", "2026-03-09T23:20:08Z"),
    ("Mon, 10 Mar 2026 02:20:08 +0300", None, "impossible", None),
    ("1743451209", "Europe/Riga", "ok", "2025-03-31T20:00:09Z"),
    ("1730521907821", None, "ok", "2024-11-02T04:31:47Z"),
    ("20230204T003040Z", None, "ok", "2023-02-04T00:30:40Z"),
    ("20240628", "Europe/Moscow", "ok", "2024-06-27T21:00:00Z"),
    ("02.03.24 23:26", "Europe/Moscow", "ok", "2024-03-02T20:26:00Z"),
    ("31.04.2025 11:06", "Europe/Moscow", "impossible", None),
    ("12.10.2025 25:37", "Europe/Moscow", "impossible", None),
    ("2024-13-02", "Europe/Moscow", "impossible", None),
    ("27.10.2024 02:30", "Europe/Berlin", "ambiguous", None),
    ("2024-10-27T02:30:00+01:00", "Europe/Berlin", "ok", "2024-10-27T01:30:00Z"),
    ("31.03.2024 02:30", "Europe/Berlin", "nonexistent", None),
    ("31.03.2024 03:00", "Europe/Berlin", "ok", "2024-03-31T01:00:00Z"),
    ("2024-05-01 10:00", None, "no_zone", None),
    ("2024-05-01 10:00", "Nowhere/City", "no_zone", None),
    ("сегодня", "Europe/Moscow", "unreadable", None),
    ("апреля 2023", "Europe/Moscow", "unreadable", None),
    ("", "Europe/Moscow", "unreadable", None),
    (None, "Europe/Moscow", "null", None),
    ("x" * 100_000, "Europe/Moscow", "unreadable", None),
]


def run(spark, rows, **kw):
    from factloom.operators.timestamps import known_zones

    d = known_zones(spark, spark.createDataFrame(rows, "i int, value string, zone string"), "zone")
    return {r.i: (r.utc_status, r.t) for r in to_utc(d, "value", "zone", **kw).select("i", "utc_status", utc_text(F.col("utc")).alias("t")).collect()}


def test_cases(spark):
    got = run(spark, [(i, v, z) for i, (v, z, _, _) in enumerate(CASES)])
    assert {i: (CASES[i][0], got[i]) for i in got} == {i: (v, (s, t)) for i, (v, _, s, t) in enumerate(CASES)}


def test_policies_for_ambiguous_times(spark):
    row = [(0, "27.10.2024 02:30", "Europe/Berlin")]
    assert run(spark, row, on_ambiguous="earlier")[0] == ("ok", "2024-10-27T00:30:00Z")
    assert run(spark, row, on_ambiguous="later")[0] == ("ok", "2024-10-27T01:30:00Z")
    with pytest.raises(ValueError):
        run(spark, row, on_ambiguous="both")


def test_session_time_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run(spark, [(0, "10.03.2024 09:30", "Europe/Moscow")])[0] == ("ok", "2024-03-10T06:30:00Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.datetimes(dt.datetime(2000, 1, 1), dt.datetime(2030, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Europe/Moscow", "Australia/Lord_Howe"])), min_size=40, max_size=40))
def test_against_python(spark, values):
    from zoneinfo import ZoneInfo

    rows, want = [], {}
    for i, (t, z) in enumerate(values):
        t = t.replace(microsecond=0)
        rows.append((i, t.strftime("%d.%m.%Y, %H:%M:%S"), z))
        instants = {u for f in (0, 1) if (u := t.replace(tzinfo=ZoneInfo(z), fold=f).astimezone(dt.UTC)).astimezone(ZoneInfo(z)).replace(tzinfo=None) == t}
        want[i] = instants.pop().strftime("%Y-%m-%dT%H:%M:%SZ") if len(instants) == 1 else None
    assert {i: t for i, (_, t) in run(spark, rows).items()} == want


def test_tables_with_repeated_sources_and_nulls(spark):
    c = spark.createDataFrame([(1, 7, "2024-01-01", None, "x"), (2, None, None, "2024-01-01", "y")], "id long, source_id long, published_at string, collected_at string, value string")
    s = spark.createDataFrame([(7, "Europe/Moscow"), (7, "Europe/Moscow"), (None, None)], "id long, time_zone string")
    v = spark.createDataFrame([], "id long, vote_date string")
    k = spark.createDataFrame([(5, "1 мая 2024 года")], "id long, publication_date string")
    rows = timestamp_values(spark, c, v, k, s)
    assert rows.count() == 5
    assert to_utc(rows, "value", "zone").filter("utc is not null").count() == 3


def test_times_that_the_clock_jumps_over(spark):
    d = spark.createDataFrame([("2024-03-31 02:30", "Europe/Berlin"), ("2024-03-31 03:30", "Europe/Berlin")], "v string, z string")
    want = {"reject": None, "forward": "2024-03-31T01:30:00Z", "back": "2024-03-31T00:30:00Z"}
    for policy, utc in want.items():
        r = to_utc(d, "v", "z", on_nonexistent=policy).select("utc_status", utc_text(F.col("utc")).alias("u")).collect()
        assert (r[0].utc_status, r[0].u) == ("nonexistent" if utc is None else "ok", utc)
        assert (r[1].utc_status, r[1].u) == ("ok", "2024-03-31T01:30:00Z")
    with pytest.raises(ValueError):
        to_utc(d, "v", "z", on_nonexistent="guess")
