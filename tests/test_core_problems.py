"""References and instants: brute force, hard cases, empty tables, clashing columns."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from brindle.functions.timestamps import MISSING, to_utc_us, wall_to_utc
from brindle.operators.instants import instants
from brindle.operators.orphans import Bitmap, orphan_report, orphans

REFS = "ref_table string, ref_field string, record_id string, target string, `key` string, `at` double"
RECORDS = "target string, `key` string, `at` double"
VALUES = "ref_table string, record_id string, msg_index int, channel string, value string"
CLOCK = "channel string, zone string, date_order string, owner_id string, owner_name string"
CLOCKS = [("gmail", "America/New_York", "mdy", "a@b.c", "Noa Verel"), ("outlook", "Europe/Berlin", "dmy", "n@b.c", "Noa Verel")]


def us(*parts, **kw):
    return int(datetime(*parts, tzinfo=timezone.utc, **kw).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("value", "zone", "order", "expected"),
    [
        ("2024-01-11T21:38:11Z", None, None, us(2024, 1, 11, 21, 38, 11)),
        ("20240118T054342Z", None, None, us(2024, 1, 18, 5, 43, 42)),
        ("1704724977", None, None, 1704724977_000000),
        ("1705954600381", None, None, 1705954600381_000),
        ("1706088862329489", None, None, 1706088862329489),
        ("1704631385.106", None, None, 1704631385_106000),
        ("1.707240297E9", None, None, 1707240297_000000),
        ("2024-01-12T02:54:26.654157839Z", None, None, us(2024, 1, 12, 2, 54, 26) + 654157),
        ("  2024-02-28T08:01:46,409+00:00 ", None, None, us(2024, 2, 28, 8, 1, 46) + 409000),
        ("Mon, 22 Jan 2024 06:19:38 -0500", None, None, us(2024, 1, 22, 11, 19, 38)),
        ("03 Feb 2024 06:03 GMT+5:30", None, None, us(2024, 2, 3, 0, 33)),
        ("2024-03-18 20:37:04 EDT", None, None, us(2024, 3, 19, 0, 37, 4)),
        ("2024-04-07T23:57:05-04:00[America/New_York]", None, None, us(2024, 4, 8, 3, 57, 5)),
        ("Mar 11, 2024 9:47 AM", "Europe/Berlin", "dmy", us(2024, 3, 11, 8, 47)),
        ("02/08/2024 4:41 PM", "America/New_York", "mdy", us(2024, 2, 8, 21, 41)),
        ("06.02.24 14:16:34", "Europe/Berlin", "dmy", us(2024, 2, 6, 13, 16, 34)),
        ("2024/01/01 12:00 AM", "UTC", "mdy", us(2024, 1, 1)),
        # A repeated hour is its earlier instant, a skipped time takes the offset before the change.
        ("2024-11-03 01:30:00", "America/New_York", "mdy", us(2024, 11, 3, 5, 30)),
        ("2024-03-10 02:30:00", "America/New_York", "mdy", us(2024, 3, 10, 7, 30)),
        ("2024-03-31 02:30:00", "Europe/Berlin", "dmy", us(2024, 3, 31, 1, 30)),
        *((v, "Europe/Berlin", "dmy", MISSING) for v in (None, "", "   ", "0", "pending", "n/a", "0000-00-00 00:00:00", "31/02/2024 10:00", "2024-01-15", "2024-01-15 25:00:00", "yesterday", "٣", "x" * 5000)),
        ("2024-01-15 10:00:00", None, None, MISSING),
        ("2024-01-15 10:00:00", "No/Where", "dmy", MISSING),
    ],
)
def test_values(value, zone, order, expected):
    assert to_utc_us([value, value], [zone] * 2, [order] * 2).tolist() == [expected] * 2


def test_walls_against_zoneinfo():
    rng = random.Random(1)
    for zone in ("America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kathmandu", "Africa/Casablanca"):
        walls = [datetime(2000, 1, 1) + timedelta(minutes=rng.randrange(35 * 365 * 24 * 60)) for _ in range(3000)]
        got = wall_to_utc(np.array([int(w.replace(tzinfo=timezone.utc).timestamp()) for w in walls]), zone)
        info = ZoneInfo(zone)
        assert got.tolist() == [int(w.replace(tzinfo=info, fold=0).timestamp()) for w in walls]


def test_instants(spark):
    rows = [("t", "1", 0, "gmail", "01/02/2024 4:00 PM"), ("t", "1", 0, "gmail", "01/02/2024 4:00 PM"), ("t", "2", 0, "GMAIL ", "01/02/2024 4:00 PM"), ("t", "3", 0, None, "2024-01-01T00:00:00Z"), ("t", "4", 0, "slack", "2024-01-01 00:00"), ("t", "5", 1, "outlook", None)]
    values = spark.createDataFrame(rows, VALUES).selectExpr("*", "'x' AS zone", "'y' AS utc_us")
    clock = spark.createDataFrame([*CLOCKS, CLOCKS[0]], CLOCK)
    found = sorted(map(tuple, instants(values, clock).collect()))
    assert found == [("t", "1", 0, us(2024, 1, 2, 21)), ("t", "2", 0, us(2024, 1, 2, 21)), ("t", "3", 0, us(2024, 1, 1))]
    assert instants(spark.createDataFrame([], VALUES), clock).count() == 0
    assert {r.record_id for r in instants(values, spark.createDataFrame([], CLOCK)).collect()} == {"3"}


def test_bitmaps():
    rng = np.random.default_rng(3)
    for density in (5, 3000, 60_000, 190_000):
        a, b = (np.unique(rng.integers(0, 200_000, density)) for _ in range(2))
        assert Bitmap(a).and_not(Bitmap(b)).tolist() == sorted(set(a.tolist()) - set(b.tolist()))


def brute(refs, records):
    clean = lambda k: (k or "").strip(" \t\n ​﻿").lower()
    first = {}
    for target, key, at in records:
        if clean(key):
            at = float("-inf") if at is None else at
            first[target, clean(key)] = min(at, first.get((target, clean(key)), at))
    out = set()
    for table, field, record, target, key, at in refs:
        if clean(key):
            stored = first.get((target, clean(key)))
            if stored is None or (at is not None and stored > at):
                out.add((table, field, record))
    return out


def test_orphans(spark):
    rng = random.Random(2)
    day = 86_400.0
    keys = [f"k{i}" for i in range(60)]
    spell = lambda k: rng.choice([k, k.upper(), f" {k}\t", f" {k}"])
    records = [("p", spell(k), rng.choice([None, rng.random() * 200 * day])) for k in keys[:40] for _ in range(rng.choice([1, 2]))]
    records += [("p", None, 1.0), ("p", " ", 1.0), ("q", "k50", 0.0)]
    # A third of all rows name one missing key.
    refs = [("a", "f", str(i), "p", "k55" if i % 3 == 0 else rng.choice([None, "", " ", spell(rng.choice(keys))]), rng.choice([None, rng.random() * 200 * day])) for i in range(900)]
    refs += refs[:50]
    left = spark.createDataFrame(refs, REFS).selectExpr("*", "1 AS month", "'x' AS salt")
    right = spark.createDataFrame(records, RECORDS).selectExpr("*", "'x' AS record_id")
    found = orphans(left, right)
    rows = [(r.ref_table, r.ref_field, r.record_id) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(refs, records)
    report = orphan_report(found).collect()
    assert sum(r.n_orphans for r in report) == len(rows)


def test_orphans_of_empty_tables(spark):
    refs, records = spark.createDataFrame([("a", "f", "1", "p", "k", float("nan"))], REFS), spark.createDataFrame([], RECORDS)
    assert orphans(spark.createDataFrame([], REFS), records).count() == 0
    assert orphans(refs, records).collect()[0].month is None
    assert orphans(refs, spark.createDataFrame([("p", "K" + "", 5.0)], RECORDS)).count() == 0
    long = "k" * 100_000
    assert orphans(spark.createDataFrame([("a", "f", "1", "p", long, 1.0)], REFS), spark.createDataFrame([("p", long, 2.0)], RECORDS)).count() == 1


def test_orphans_over_many_months_and_long_keys(spark, monkeypatch):
    """Against the definition; months are accumulated, keys may be very long, ranges many."""
    from brindle.operators import orphans

    rng = random.Random(21)
    monkeypatch.setattr(orphans, "RANGE_BYTES", 2000)
    keys = [f"k{i}" for i in range(120)] + ["long" * 3000]
    day = 86400.0
    records = [("t", rng.choice(keys), rng.choice([None, *(rng.randrange(900) * day for _ in range(9))])) for _ in range(150)]
    refs = [("a", "f", f"r{i}", "t", rng.choice([*keys, " ", None]), rng.choice([None, *(rng.randrange(900) * day for _ in range(9))])) for i in range(600)]
    got = {r.record_id for r in orphans.orphans(spark.createDataFrame(refs, "ref_table string, ref_field string, record_id string, target string, key string, at double"), spark.createDataFrame(records, "target string, key string, at double")).collect()}
    first = {}
    for _, k, at in records:
        first[k] = min(first.get(k, float("inf")), float("-inf") if at is None else at)
    expected = {r for _, _, r, _, k, at in refs if k and k.strip() and (k not in first or (at is not None and first[k] > at))}
    assert got == expected and len(expected) > 100


@pytest.mark.parametrize(
    "value",
    ["2026\u201103\u201101 10:00", "2026\u201303\u201301\u00a010:00", "\uff12\uff10\uff12\uff16-03-01 10:00", "\u200e2026-03-01 10:00", "2026-03-01 10:00 (Mitteleurop\u00e4ische Zeit)", "2026-03-01 10:00 (" + "very long comment " * 50 + ")", "1772355600" + "." + "0" * 500],
)
def test_values_of_other_scripts_and_lengths(value):
    assert to_utc_us([value], ["Europe/Berlin"], ["dmy"])[0] == 1_772_355_600_000_000


def test_no_instant_in_long_texts():
    assert (to_utc_us(["x" * 100_000, "9" * 100_000, "2026-03-01 10:00 " + "y" * 200, "\u00e9t\u00e9", "(only a comment)"], ["UTC"] * 5, ["dmy"] * 5) == MISSING).all()


def test_zone_tables_have_a_version_and_reach_back(spark):
    from brindle.functions.timestamps import utc_us, zone_data_version

    at = datetime(1943, 7, 1, 12, tzinfo=ZoneInfo("America/New_York"))
    assert wall_to_utc(np.array([int(datetime(1943, 7, 1, 12, tzinfo=timezone.utc).timestamp())]), "America/New_York")[0] == int(at.timestamp())
    assert wall_to_utc(np.array([0]), "Europe/Berlin", zone_data_version())[0] == -3600
    with pytest.raises(RuntimeError, match="zone data"):
        wall_to_utc(np.array([0]), "Europe/Berlin", "1999z")
    rows = spark.createDataFrame([("2026-03-01 10:00", "Europe/Berlin", "dmy"), (None, None, None)], "v string, z string, o string")
    assert [r.us for r in rows.select(utc_us("v", "z", "o").alias("us")).collect()] == [1_772_355_600_000_000, None]
