import pytest
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.operators.timestamps import TimestampDictionary, normalise, parse, utc_text

IN, LON, NY, SYD, DXB = "Asia/Kolkata", "Europe/London", "America/New_York", "Australia/Sydney", "Asia/Dubai"


@pytest.mark.parametrize(
    ("raw", "tz", "instant"),
    [
        ("2026-01-31T09:05:00Z", IN, "2026-01-31T09:05:00.000000Z"),
        ("2026-03-19T11:54:36.161497999Z", IN, "2026-03-19T11:54:36.161497Z"),
        ("31/01/2026 02:35 PM", IN, "2026-01-31T09:05:00.000000Z"),
        ("31-01-26 14:35", IN, "2026-01-31T09:05:00.000000Z"),
        ("12/01/2026 12:00 AM", DXB, "2026-01-11T20:00:00.000000Z"),
        ("20260131T090500Z", NY, "2026-01-31T09:05:00.000000Z"),
        ("Sat, 31 Jan 2026 09:05:00 GMT", SYD, "2026-01-31T09:05:00.000000Z"),
        ("Jan 31, 2026 04:05:00 AM", NY, "2026-01-31T09:05:00.000000Z"),
        ("2024-06-05 07:28:37 America/New_York", DXB, "2024-06-05T11:28:37.000000Z"),
        ("15-07-2025 01:02:53 AEST", SYD, "2025-07-14T15:02:53.000000Z"),
        ("03-11-2024 01:42:35 EST", NY, "2024-11-03T06:42:35.000000Z"),
        ("2024-11-03 01:42:35", NY, "2024-11-03T05:42:35.000000Z"),  # twice: the first
        ("2026-03-08T02:52:36", NY, "2026-03-08T07:52:36.000000Z"),  # skipped: the offset before
        ("2025-03-30 01:30:00", LON, "2025-03-30T01:30:00.000000Z"),
        ("1730506074", IN, "2024-11-02T00:07:54.000000Z"),
        ("1727336839780", IN, "2024-09-26T07:47:19.780000Z"),
        ("45902.718183", IN, "2025-09-02T11:44:11.000000Z"),
        ("2025-06-17 25:61:00", IN, None),
        ("31-02-2026 10:15", IN, None),
        ("15-10-2025 07:05:00 EST", IN, None),  # not an abbreviation of that zone
        ("04-2026", IN, None),
        ("", IN, None),
        ("x" * 100_000, IN, None),
        ("2026-01-31 09:05", None, None),
    ],
)
def test_instants(raw, tz, instant):
    assert utc_text(parse(raw, tz)[0]) == instant


@pytest.mark.parametrize(
    ("raw", "tz", "day"),
    [
        (" 20-10-2025  ", IN, "2025-10-20"), ("9.7.2026", IN, "2026-07-09"), ("2024/9/6", IN, "2024-09-06"), ("06/03/26", IN, "2026-03-06"), ("10-JUN-25", IN, "2025-06-10"), ("2 September 2025", IN, "2025-09-02"),
        ("45898", IN, "2025-08-29"), ("20251121", IN, "2025-11-21"), ("2025-04-20T20:28:04-05:00", IN, "2025-04-21"), ("2025-03-24T22:32:03Z", SYD, "2025-03-25"), ("29-02-2025", IN, None), ("2025-13-45", IN, None), ("00-00-0000", IN, None),
        ("20251345", IN, None), ("31-01-2026", None, "2026-01-31"),
    ],
)
def test_days(raw, tz, day):
    assert parse(raw, tz)[1] == day


def run(spark, rows, dictionary=None, **more):
    schema = "id long, bid_date string, created_at string, counter_id string, raw string, tz string, field string"
    zones = spark.createDataFrame([("C1", IN, "a"), ("C2", NY, "b")], "counter_id string, tz string, raw string")
    d = dictionary or TimestampDictionary(spark, storage.scratch(spark, "t"))
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], schema)
    return sorted(map(tuple, normalise(df, zones, {"bid_date": "day", "created_at": "instant"}, d, **more).collect()), key=str)


def test_rows_hot_strings_and_unknown_places(spark):
    rows = [(i, "01-02-2025", "2025-01-01 00:00:00", "C1") for i in range(1500)] + [(2000, None, None, "C1"), (2001, "2-2-2025", "na", None), (2002, "2025-01-01T00:00:00Z", "2025-01-01 00:00", "C2")]
    out = run(spark, rows)
    assert len(out) == 3000 + 3
    assert (7, "bid_date", "2025-02-01") in out and (7, "created_at", "2024-12-31T18:30:00.000000Z") in out
    assert [r for r in out if r[0] >= 2000] == [(2001, "bid_date", "2025-02-02"), (2002, "bid_date", "2024-12-31"), (2002, "created_at", "2025-01-01T05:00:00.000000Z")]
    assert run(spark, []) == []


def test_dictionary_grows_by_new_strings_only(spark):
    d = TimestampDictionary(spark, storage.scratch(spark, "t"))
    run(spark, [(1, "01-01-2025", "x", "C1")], d)
    run(spark, [(1, "01-01-2025", "x", "C1"), (2, "02-01-2025", "x", "C1")], d)
    assert d.entries().count() == 3 and len(d.runs()) == 2
    assert d.entries().groupBy("raw", "tz").count().filter(F.col("count") > 1).isEmpty()


def test_long_texts_are_read_by_the_same_grammar():
    long = "Wednesday, 31 December 2025 at 10:05:33.123456789 PM (America/New_York)"
    assert len(long) > 64 and parse(long, "Asia/Kolkata") == parse("2026-01-01T03:05:33.123456Z", "Asia/Kolkata") != (None, None)
    for junk in ("9" * 5000, "1" * 200, "x" * 100_000, "2025-12-31 10:05 " + "A/" * 50_000, "Mon" * 50_000):
        assert parse(junk, "Asia/Kolkata") == (None, None)


@pytest.mark.parametrize(
    ("raw", "tz", "instant"),
    [
        ("2025-07-01 10:00 CEST", "Europe/Paris", "2025-07-01T08:00:00.000000Z"), ("2025-01-01 10:00 CET", "Europe/Paris", "2025-01-01T09:00:00.000000Z"), ("2025-07-01 10:00 CEST", "Asia/Kolkata", None), ("2025-07-01 10:00 gst", "Asia/Dubai", "2025-07-01T06:00:00.000000Z"),
        ("2025-07-01T10:00:00+05:30[Asia/Kolkata]", "Asia/Dubai", "2025-07-01T04:30:00.000000Z"), ("2025-07-01T10:00:00[Asia/Kolkata]", "Asia/Dubai", "2025-07-01T04:30:00.000000Z"),
        ("Tue Jul  1 10:00:00 IST 2025", "Asia/Kolkata", "2025-07-01T04:30:00.000000Z"), ("Tue Jul  1 10:00:00 2025", "UTC", "2025-07-01T10:00:00.000000Z"), ("Jul 1 10:00:00 2025 x", "UTC", None),
    ],
)
def test_zones_own_abbreviations_and_printed_times(raw, tz, instant):
    assert utc_text(parse(raw, tz)[0]) == instant


def test_a_second_call_parses_nothing(spark):
    d = TimestampDictionary(spark, storage.scratch(spark, "t"))
    rows = spark.createDataFrame([(1, "2026-01-31", "x"), (2, "31/01/2026", "x")], "id long, raw string, counter_id string")
    zones = spark.createDataFrame([("x", "Asia/Kolkata")], "counter_id string, tz string")
    more = rows.unionByName(spark.createDataFrame([(3, "1 Feb 2026", "x")], rows.schema))
    for table, runs in ((rows, 1), (rows, 1), (more, 2), (more, 2)):
        assert normalise(table, zones, {"raw": "day"}, d).count() == table.count() and len(d.runs()) == runs
    assert d.entries().count() == 3
