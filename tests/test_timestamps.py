import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from quillgraph.operators.timestamps import InstantDictionary, normalise_instants, parse_keys
from quillgraph.session import scratch_path

UTC = timezone.utc


def us(*a, zone=UTC, fold=0):
    return round((datetime(*a, tzinfo=zone, fold=fold).astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


BERLIN, YORK = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
CASES = [
    ("2024-05-06", None, False, us(2024, 5, 6)),
    ("20240506", "Europe/Berlin", False, us(2024, 5, 6, zone=BERLIN)),
    ("2024/05/06", "", False, us(2024, 5, 6)),
    ("06.05.2024 07:08", None, True, us(2024, 5, 6, 7, 8)),
    ("06/05/2024", None, False, us(2024, 5, 6)),
    ("06/05/2024", None, True, us(2024, 6, 5)),
    ("25/12/2024", None, True, None),
    ("8/23/2025 15:07:46", None, True, us(2025, 8, 23, 15, 7, 46)),
    ("09/25/2022 2:11 am", None, True, us(2022, 9, 25, 2, 11)),
    ("May 6, 2024 at 12:30 PM", None, False, us(2024, 5, 6, 12, 30)),
    ("May 6, 2024 at 12:30 am", None, False, us(2024, 5, 6, 0, 30)),
    ("Jan 18 2022 04:49:25", None, False, us(2022, 1, 18, 4, 49, 25)),
    ("3. März 2025, 16:03 Uhr", "Europe/Berlin", False, us(2025, 3, 3, 16, 3, zone=BERLIN)),
    ("13 août 2024 05h03", None, False, us(2024, 8, 13, 5, 3)),
    ("Sun, 26 Mar 2023 02:45:38 +0100", "Asia/Tokyo", False, us(2023, 3, 26, 1, 45, 38)),
    ("2023-01-06 12:22:58 EST", None, False, us(2023, 1, 6, 17, 22, 58)),
    ("2022-04-03 16:44 UTC-7", None, False, us(2022, 4, 3, 23, 44)),
    ("2024-09-04T02:30:22−03:30", None, False, us(2024, 9, 4, 6, 0, 22)),
    ("2024-01-01T00:00:00+05", None, False, us(2023, 12, 31, 19)),
    ("20251219T061932+0530", None, False, us(2025, 12, 19, 0, 49, 32)),
    ("2023-01-31T17:52:55-08:00[America/Los_Angeles]", None, False, us(2023, 2, 1, 1, 52, 55)),
    ("2023-02-05T20:33:15.452636933", None, False, us(2023, 2, 5, 20, 33, 15, 452636)),
    ("2024-11-07 15:47:49,789", None, False, us(2024, 11, 7, 15, 47, 49, 789000)),
    ("1707834615743", "Asia/Tokyo", False, 1707834615743000),
    ("1644982691", None, False, 1644982691000000),
    # repeated wall time: the earlier instant; skipped: forward by the gap
    ("2024-10-27 02:30:00", "Europe/Berlin", False, us(2024, 10, 27, 0, 30)),
    ("2024-03-31 02:30:00", "Europe/Berlin", False, us(2024, 3, 31, 1, 30)),
    ("2024-11-03 01:30", "America/New_York", False, us(2024, 11, 3, 5, 30)),
    ("2024-02-30", None, False, None),
    ("2024-05-06T25:00:00Z", None, False, None),
    ("2024-05-06 10:00 XYZ", None, False, None),
    ("Q2 2024", None, False, None),
    ("14:30", None, False, None),
    ("yesterday", None, False, None),
    ("x" * 5000, None, False, None),
]


def test_cases(spark):
    rows = [(raw, zone, mf) for raw, zone, mf, _ in CASES]
    got = {(r["raw"], r["zone"], r["month_first"]): r["epoch_us"] for r in parse_keys(spark.createDataFrame(rows, "raw string, zone string, month_first boolean")).collect()}
    assert {k: got[k] for k in got} == {(raw, zone, mf): e for raw, zone, mf, e in CASES}


def test_iso_against_python(spark):
    import random

    r = random.Random(4)
    zones = ["Europe/London", "America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu", "Pacific/Auckland"]
    rows, want = [], {}
    for _ in range(400):
        z = r.choice(zones)
        d = datetime(2022, 1, 1) + timedelta(seconds=r.randrange(4 * 365 * 86400))
        raw = d.strftime("%Y-%m-%dT%H:%M:%S")
        rows.append((raw, z, False))
        aware = d.replace(tzinfo=ZoneInfo(z))
        want[raw, z] = round((aware.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
    got = {(x["raw"], x["zone"]): x["epoch_us"] for x in parse_keys(spark.createDataFrame(rows, "raw string, zone string, month_first boolean")).collect()}
    assert got == want


def test_rows_dictionary_and_edges(spark):
    schema = "k bigint, a string, b string, tz string, loc string, raw string"
    df = spark.createDataFrame([(1, "01/02/2024", None, None, "en_US", "x"), (2, "01/02/2024", " ", None, "en_GB", "x"), (2, "01/02/2024", " ", None, "en_GB", "x"), (3, None, "never", "UTC", None, "x")], schema)
    book = InstantDictionary(spark, scratch_path(spark, "book"))
    got = normalise_instants(df, "k", ["a", "b"], "tz", "loc", book).distinct().collect()
    assert {(r["k"], r["field"], r["epoch_us"]) for r in got} == {(1, "a", us(2024, 1, 2)), (2, "a", us(2024, 2, 1)), (3, "b", None)}
    assert book.read().count() == 3
    more = spark.createDataFrame([(9, "2024-07-08", "never", "UTC", None, "x")], schema)
    normalise_instants(more, "k", ["a", "b"], "tz", "loc", book).collect()
    assert book.read().count() == 4  # only what was new was parsed
    assert normalise_instants(df.limit(0), "k", ["a"], "tz", "loc", InstantDictionary(spark, scratch_path(spark, "book"))).count() == 0


def test_a_second_run_parses_nothing(spark, tmp_path, monkeypatch):
    from quillgraph.operators import timestamps

    seen = []
    parse = timestamps.parse_keys
    monkeypatch.setattr(timestamps, "parse_keys", lambda keys: seen.append(keys.count()) or parse(keys))
    rows = [(1, "2024-01-02", None, None), (2, "2024-01-02", "Asia/Tokyo", None), (3, "odd", None, None), (4, "2024-01-02", None, None)]
    df = spark.createDataFrame(rows, "k int, t string, tz string, locale string")
    book = timestamps.InstantDictionary(spark, str(tmp_path / "book"))
    first = timestamps.normalise_instants(df, "k", ["t"], "tz", "locale", book).collect()
    again = timestamps.normalise_instants(df, "k", ["t"], "tz", "locale", book).collect()
    assert seen == [3] and sorted(first) == sorted(again)
    more = df.unionByName(spark.createDataFrame([(5, "2024-01-03", None, None)], df.schema))
    assert timestamps.normalise_instants(more, "k", ["t"], "tz", "locale", book).count() == 5 and seen == [3, 1]
