from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillon.operators.timestamps import estimate_zones, published_norm

SCHEMA = "raw_id bigint, source_id string, published_date string, fetched_at timestamp"


def norm(spark, rows, sources=(("ny", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy"), ("none", None, None))):
    books = spark.createDataFrame([(i, s, t, datetime(2025, 1, 1)) for i, (s, t) in enumerate(rows)], SCHEMA)
    meta = spark.createDataFrame(list(sources), "id string, time_zone string, date_order string")
    found = {r["raw_id"]: r["published_norm"] for r in published_norm(books, meta).collect()}
    return [found[i] for i in range(len(rows))]


CASES = [
    ("de", "2024", "2024"), ("de", "c. 1999", "1999"), ("de", "Spring 2025", "2025"), ("de", "©2021", "2021"), ("de", "2009 (reissue)", "2009"),
    ("de", "mayo de 2014", "2014-05"), ("de", "May. 2026", "2026-05"), ("de", "05/2017", "2017-05"), ("de", "2019年11月", "2019-11"),
    ("de", "04/05/2020", "2020-05-04"), ("ny", "04/05/2020", "2020-04-05"), ("none", "04/05/2020", "2020-05-04"), ("none", "04/25/2020", "2020-04-25"), ("de", "04/25/2020", None),
    ("de", "2020.04.05", "2020-04-05"), ("ny", "2020/04/05", "2020-04-05"), ("de", "15/01/11", "2011-01-15"), ("de", "15/01/52", "1952-01-15"), ("de", "15/01/40", None),
    ("de", "1er avril 2024", "2024-04-01"), ("de", "14. Februar 2024", "2024-02-14"), ("de", "17 de agosto de 2011", "2011-08-17"), ("de", "4. März 2020", "2020-03-04"), ("de", "On sale 2 July 2024!", "2024-07-02"), ("de", "Oct 20th, 2025", "2025-10-20"),
    ("de", "2016-117", "2016-04-26"), ("de", "2015-366", None), ("de", "2016-366", "2016-12-31"), ("de", "2005-W15-6", "2005-04-16"), ("de", "2020-W53-5", "2021-01-01"), ("de", "2021-W53-1", None),
    ("de", "2023-02-31", None), ("de", "31 November 2006", None), ("de", "1949-01-01", None), ("de", "forthcoming", None), ("de", "", None), ("de", None, None), ("de", "0000-00-00", None),
    ("de", "2024-03-01T10:00:00", "2024-03-01T09:00:00Z"), ("de", "2024-07-01 10:00", "2024-07-01T08:00:00Z"), ("de", "2024-07-01T10:00:00+05:30", "2024-07-01T04:30:00Z"), ("de", "2024-07-01T10:00:00.999Z", "2024-07-01T10:00:00Z"),
    ("de", "2022-12-01 13:48:49 JST", "2022-12-01T04:48:49Z"), ("de", "2016-08-12 21:03:55 GMT-5", "2016-08-13T02:03:55Z"), ("de", "2022-09-21 23:31:08 GMT+5:30", "2022-09-21T18:01:08Z"), ("de", "2026-11-07T14:44:18[Europe/Athens]", "2026-11-07T12:44:18Z"),
    ("de", "2017-04-08T16:56:45 (America/New_York)", "2017-04-08T20:56:45Z"), ("de", "Tue, 24 Aug 2010 15:48:48 +0900", "2010-08-24T06:48:48Z"), ("ny", "04/10/2026 3:55 PM", "2026-04-10T19:55:00Z"), ("ny", "04/10/2026 12:05 AM", "2026-04-10T04:05:00Z"), ("ny", "04/10/2026 13:05 PM", None),
    ("de", "1761444548", "2025-10-26T02:09:08Z"), ("de", "1654672051308", "2022-06-08T07:07:31Z"), ("de", "1824943185671055", "2027-10-31T00:39:45Z"), ("de", "20130109", "2013-01-09"), ("ny", "20231110194726", "2023-11-11T00:47:26Z"),
    # an hour that occurs twice is its first occurrence, unless the text says otherwise; a skipped one moves forward
    ("de", "2024-10-27T02:30:00", "2024-10-27T00:30:00Z"), ("de", "2024-10-27 02:30:00 CET", "2024-10-27T01:30:00Z"), ("de", "2024-03-31T02:30:00", "2024-03-31T01:30:00Z"), ("de", "2024-01-01T25:00:00", None),
]


def test_forms(spark):
    found = norm(spark, [(s, t) for s, t, _ in CASES])
    assert [(s, t, f) for (s, t, _), f in zip(CASES, found)] == CASES


def test_unknown_source_and_clashing_names(spark):
    books = spark.createDataFrame([(1, "new", "2024-01-01T10:00:00", datetime(2025, 1, 1), "x")], SCHEMA + ", _zone string")
    meta = spark.createDataFrame([("de", "Europe/Berlin", "dmy")], "id string, time_zone string, date_order string")
    row = published_norm(books, meta).first()
    assert row["published_norm"] == "2024-01-01T10:00:00Z" and row["_zone"] == "x"
    assert published_norm(books.limit(0), meta).collect() == []


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(datetime(1952, 1, 1), datetime(2027, 12, 31)), min_size=1, max_size=20))
def test_round_trip_of_local_times(spark, times):
    """Against Python's own zone rules: fold 0 for repeated hours, the earlier offset for skipped ones."""
    times = [t.replace(microsecond=0) for t in times]
    want = [t.replace(tzinfo=ZoneInfo("America/New_York")).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") for t in times]
    assert norm(spark, [("ny", t.isoformat()) for t in times]) == want


def test_missing_zone_is_estimated(spark):
    """Texts with the source's own offsets tell its zone, which then applies to those without one."""
    zone = ZoneInfo("Asia/Tokyo")
    rows = [("none", datetime(2024, m, 3, 9, tzinfo=zone).isoformat()) for m in range(1, 12)] + [("none", "2024-06-01T09:00:00")]
    assert norm(spark, rows)[-1] == "2024-06-01T00:00:00Z"


def test_zone_from_ingestion_times(spark):
    """Without any offset, a wall time just before its ingestion rules out histories in which it lies after it."""
    at = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(20)]
    rows = [("s", int((t - datetime(1970, 1, 1)).total_seconds()) + 9 * 3600 - 60, None, t) for t in at]
    df = spark.createDataFrame(rows, "source string, l bigint, o bigint, i timestamp")
    best = estimate_zones(df, "source", "l", "o", "i", ["UTC", "Europe/Berlin", "Asia/Tokyo"]).first()
    assert (best["zone"], best["violations"], best["evidence"]) == ("Asia/Tokyo", 0, 20)


@pytest.mark.parametrize("zone", ["America/New_York", "America/Los_Angeles", "Asia/Kolkata", "Pacific/Auckland", "Europe/Berlin", "UTC", "America/Phoenix", "America/St_Johns"])
def test_zone_without_any_offset_from_delays_on_both_sides(spark, zone):
    """Rows ingested minutes after they were written, all year round, name the history: no zone further east will do."""
    at = [datetime(2024, 1, 3, 12) + timedelta(days=6 * i, hours=i % 7) for i in range(60)]
    local = [int((t.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds()) - 300 for t in at]
    df = spark.createDataFrame([("s", x, None, t) for x, t in zip(local, at)], "source string, l bigint, o bigint, i timestamp")
    best = estimate_zones(df, "source", "l", "o", "i").collect()
    assert [(r["zone"], r["violations"], r["evidence"]) for r in best] == [(zone, 0, 60)]


def test_few_or_contradictory_rows_name_no_zone(spark):
    rows = [("few", 1_700_000_000, None, datetime(2023, 11, 14, 22, 13)), ("mixed", 1_700_000_000, 3600, None), ("mixed", 1_700_000_000, -18000, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "source string, l bigint, o bigint, i timestamp")
    assert estimate_zones(df, "source", "l", "o", "i").count() == 0 and estimate_zones(df.limit(0), "source", "l", "o", "i").count() == 0


@pytest.mark.parametrize("kind", ["one source with a third of all rows"])
def test_hot_source(spark, kind):
    rows = [("de", "2024-03-01T10:00:00")] * 200 + [("ny", "2024")] * 50
    found = norm(spark, rows)
    assert found.count("2024-03-01T09:00:00Z") == 200 and found.count("2024") == 50
