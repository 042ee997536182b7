import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest

from graphloom.functions.timestamps import instants, mask, recipe
from graphloom.functions.zones import tables
from graphloom.operators.instants import converted_times, normalised_times, with_instants
from tests.conftest import tuples

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ZONES = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kathmandu", "Europe/London"]


def micros(moment):
    return (moment - EPOCH) // timedelta(microseconds=1)


def one(text, zone=None, first=None):
    out = instants(pd.Series([text], dtype=object), pd.Series([zone], dtype=object), pd.Series([first], dtype=object), tables(ZONES))
    return None if pd.isna(out[0]) else int(out[0])


def at(text):
    return micros(datetime.fromisoformat(text))


@pytest.mark.parametrize(
    "text, zone, first, expected",
    [
        ("2025-09-15T00:13:15Z", None, None, "2025-09-15T00:13:15+00:00"),
        (" 2025-09-16t04:34:05z\t", None, None, "2025-09-16T04:34:05+00:00"),
        ("2025-09-15T10:00:36.299398999+0530", None, None, "2025-09-15T10:00:36.299398+05:30"),
        ("2025-09-15 23:35:28.9 -03", None, None, "2025-09-15T23:35:28.900000-03:00"),
        ("2025-09-20T03:26:33+05:30[Asia/Kolkata]", None, None, "2025-09-20T03:26:33+05:30"),
        ("20250915T004718Z", None, None, "2025-09-15T00:47:18+00:00"),
        ("2025-09-15 02:50:03,774", "Europe/Berlin", True, "2025-09-15T02:50:03.774000+02:00"),
        ("15.09.2025 08:43", "Europe/Berlin", True, "2025-09-15T08:43:00+02:00"),
        ("09/15/2025 17:17", "America/New_York", False, "2025-09-15T17:17:00-04:00"),
        ("03/04/2026 01:02:03 PM", "America/New_York", False, "2026-03-04T13:02:03-05:00"),
        ("03/04/2026 12:02:03 AM", "Europe/Berlin", True, "2026-04-03T00:02:03+02:00"),
        ("Sep 16, 2025 2:48:48 PM", "Asia/Kolkata", True, "2025-09-16T14:48:48+05:30"),
        ("15/Sep/2025:17:06:59 +0900", None, None, "2025-09-15T17:06:59+09:00"),
        ("Mon, 15 Sep 2025 13:32:13 +0545", None, None, "2025-09-15T13:32:13+05:45"),
        ("Wed, 17 Sep 2025 05:35:09 GMT", None, None, "2025-09-17T05:35:09+00:00"),
        ("2025-11-02 03:05:27 EST", None, None, "2025-11-02T03:05:27-05:00"),
        ("2025-09-16 11:41:41 CEST", "Asia/Kolkata", True, "2025-09-16T11:41:41+02:00"),
        ("1757899699", None, None, "2025-09-15T01:28:19+00:00"),
        ("1757931832.344", None, None, "2025-09-15T10:23:52.344000+00:00"),
        ("1757935221098", None, None, "2025-09-15T11:20:21.098000+00:00"),
        ("1757968198139425", None, None, "2025-09-15T20:29:58.139425+00:00"),
        ("1757914526788827254", None, None, "2025-09-15T05:35:26.788827+00:00"),
        # twice: the first; skipped: with the offset before the change
        ("2025-11-02 01:30:00", "America/New_York", False, "2025-11-02T01:30:00-04:00"),
        ("2026-03-29 02:30", "Europe/Berlin", True, "2026-03-29T02:30:00+01:00"),
        ("2026-03-29 03:00", "Europe/Berlin", True, "2026-03-29T03:00:00+02:00"),
        ("2025-10-26 03:00", "Europe/Berlin", True, "2025-10-26T03:00:00+01:00"),
    ],
)
def test_notations(text, zone, first, expected):
    assert one(text, zone, first) == at(expected)


@pytest.mark.parametrize(
    "text",
    [None, "", " ", "-", "n/a", "null", "NaT", "unknown", "25:61", "yesterday 14:10", "2026-01-1", "2025-09-18", "2025-02-29 10:00:00Z", "2025-13-01T00:00:00Z", "2025-01-01T24:00:00Z",
     "2025-01-01T10:60:00Z", "2025-01-01T10:00:61Z", "2025-01-01X10:00:00Z", "2025-01-01 10:00:00 QQQ", "Foo 16, 2025 2:48:48 PM", "13/13/2025 10:00:00 Z", "175789969", "9" * 25, "x" * 5000, "２０２５-09-15T00:13:15Z"],
)
def test_no_instant(text):
    assert one(text, "Europe/Berlin", True) is None


def test_local_times_need_a_service():
    assert one("2025-09-15 09:30:37") is None
    assert one("2025-09-15 09:30:37", "Nowhere/Land", True) is None
    assert one("15/09/2025 09:30:37", "Europe/Berlin", None) is None


def test_random_local_times_equal_zoneinfo():
    draw = random.Random(5)
    texts, zones, expected = [], [], []
    for _ in range(4000):
        zone = draw.choice(ZONES)
        moment = datetime(2024, 1, 1) + timedelta(seconds=draw.randrange(3 * 365 * 86_400))
        if draw.random() < 0.3:
            moment = draw.choice([datetime(2025, 10, 26), datetime(2026, 3, 29), datetime(2025, 11, 2), datetime(2026, 3, 8), datetime(2026, 4, 5), datetime(2025, 10, 5)]) + timedelta(seconds=draw.randrange(6 * 3600))
        texts.append(moment.strftime("%Y-%m-%d %H:%M:%S"))
        zones.append(zone)
        expected.append(micros(moment.replace(tzinfo=ZoneInfo(zone))))
    out = instants(pd.Series(texts), pd.Series(zones), pd.Series([True] * len(texts)), tables(ZONES))
    assert out.tolist() == expected


def test_long_decimals_and_far_years():
    assert one("2026-01-31T12:00:00." + "1" * 70 + "Z") == micros(datetime(2026, 1, 31, 12, tzinfo=timezone.utc)) + 111_111
    for moment in (datetime(2150, 7, 1, 9), datetime(2150, 1, 1, 9), datetime(1950, 7, 1, 9), datetime(1890, 1, 1, 9), datetime(2099, 12, 31, 23, 30)):
        for zone in ("Europe/Berlin", "America/New_York", "Asia/Kolkata"):
            assert one(moment.strftime("%Y-%m-%d %H:%M:%S"), zone) == micros(moment.replace(tzinfo=ZoneInfo(zone)))


def test_masks_are_parsed_once():
    assert mask("2025-09-15T00:13:15Z") == "dddd-dd-ddadd:dd:dda"
    assert recipe("dddd-dd-ddadd:dd:dda") is recipe("dddd-dd-ddadd:dd:dda")


SERVICES = "id string, name string, tz_name string, day_first boolean"
EVENTS = "event_id string, timestamp string, service string, service_name string, _k string, instant_us string"
INCIDENTS = "id string, detected_at string, service_name string"


def test_records(frame):
    services = frame(SERVICES, ("1", "a", "Europe/Berlin", True), ("2", "b", None, None), ("3", None, "UTC", True), ("4", "a", "Europe/Berlin", True))
    events = frame(
        EVENTS,
        ("e1", "2025-09-15T00:13:15Z", "a", None, "x", "y"),
        ("e2", "2025-09-15 09:30:37", None, "a", None, None),
        ("e2", "2025-09-15 09:30:37", None, "a", None, None),
        ("e3", "2025-09-15 09:30:37", "b", None, None, None),
        ("e4", "2025-09-15 09:30:37", None, None, None, None),
        ("e5", None, "a", None, None, None),
        ("e6", "2025-09-15t00:13:15z", "", "", None, None),
    )
    incidents = frame(INCIDENTS, ("i1", "1757899699", None), ("i2", "never", "a"))
    assert tuples(converted_times(events, incidents, services)) == sorted([("e2", at("2025-09-15T09:30:37+02:00")), ("e6", at("2025-09-15T00:13:15+00:00")), ("i1", 1757899699000000)], key=repr)
    status = {(s, r): x for s, r, _, x in tuples(normalised_times(events, incidents, services), "source", "record_id", "instant_us", "status")}
    assert status == {("runtime_events", "e1"): "canonical", ("runtime_events", "e2"): "converted", ("runtime_events", "e3"): "unresolved", ("runtime_events", "e4"): "unresolved", ("runtime_events", "e5"): "unresolved", ("runtime_events", "e6"): "converted", ("incidents", "i1"): "converted", ("incidents", "i2"): "unresolved"}


def test_empty_and_clashing_columns(frame):
    import pyspark.sql.functions as F

    services, events, incidents = frame(SERVICES), frame(EVENTS), frame(INCIDENTS)
    assert tuples(converted_times(events, incidents, services)) == []
    kept = with_instants(frame(EVENTS, ("e", "1757899699", None, None, "k", "old")), services, "timestamp", F.col("service"))
    assert tuples(kept, "_k", "instant_us") == [("k", 1757899699000000)]
