from datetime import date, datetime, timedelta
from decimal import Decimal

from graphloom.operators.entity_features import cumulative_state, distinct_events, entity_features, extended_state, stored_state, type_counts, write_state
from tests.conftest import tuples

EVENTS = "event_id string, timestamp string, event_type string, service string, service_name string, severity string, attributes map<string,string>, ingested_at timestamp, symbol int, arrival string"
SERVICES = "name string, tz_name string, day_first boolean"
DAY = datetime(2026, 1, 1)


def event(i, days, kind="log", service="a", symbol="f", severity="info", ms="10", text=True, late=0):
    moment = DAY + timedelta(days=days)
    attributes = None if symbol is None and ms is None else {k: v for k, v in (("symbol", symbol), ("duration_ms", ms)) if v is not None}
    return (i, moment.strftime("%Y-%m-%dT%H:%M:%SZ") if text else "never", kind, service, None, severity, attributes, moment + timedelta(days=late), 1, "x")


def once(frame, *rows):
    return distinct_events(frame(EVENTS, *rows), frame(SERVICES, ("a", "UTC", True)))


def test_each_event_counts_once(frame):
    df = once(frame, event("1", 0), event("1", 0, late=3), event("2", 0, severity="Warning"), event("3", 0, ms=""), event("4", 1, text=False), event(None, 1), event(None, 1))
    assert df.count() == 6
    assert tuples(type_counts(df)) == [("a", "f", "LOG", "INFO", 5, 40.0), ("a", "f", "LOG", "WARN", 1, 10.0)]


def test_windows_by_endpoint_subtraction(frame):
    rows = [event(str(d), d, kind="LOG" if d % 2 else "Span", ms=str(d)) for d in range(60)]
    row = entity_features(cumulative_state(once(frame, *rows)), date(2026, 2, 19), (7, 30)).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.n_events, r.n_7d, r.n_30d) == (50, 7, 30)
    assert (r.duration_total_ms, r.duration_7d) == (sum(range(50)), sum(range(43, 50)))
    assert r.n_by_event_type == {"LOG": 25, "SPAN": 25} and r.n7_by_event_type == {"LOG": 4, "SPAN": 3}
    assert r.total_by_event_type["LOG"] == Decimal(sum(range(1, 50, 2)))
    assert r.seconds_since_last == 86_400 and r.since_by_event_type == {"LOG": 86_400, "SPAN": 172_800}
    assert r.n_by_severity == {"INFO": 50}


def test_nulls_and_empty(frame):
    df = once(frame, event("1", 0, service=None, symbol=None, ms=None, severity=None, kind=None), event("2", 0, service="", symbol="", ms="x"))
    rows = entity_features(cumulative_state(df), date(2026, 1, 5)).collect()
    assert [(r.service, r.symbol, r.n_events, r.n_by_severity) for r in rows] == [(None, None, 2, {"INFO": 1})]
    assert entity_features(cumulative_state(once(frame)), date(2026, 1, 5)).collect() == []
    assert entity_features(cumulative_state(once(frame, event("1", 9))), date(2026, 1, 5)).collect() == []


def test_negative_durations(frame):
    r = entity_features(cumulative_state(once(frame, event("1", 0, ms="10"), event("2", 20, ms="-30"), event("3", 25, ms="5"))), date(2026, 1, 31), (7,)).collect()[0]
    assert (r.duration_total_ms, r.duration_7d, r.n_7d) == (-15, 5, 1)


def test_stored_state_grows_by_days(spark, frame, tmp_path):
    """A kept state, extended by later (and by late) events, reads like one made of all events at once."""
    rows = [event(str(d), d, kind=("LOG", "Span", "ERROR")[d % 3], symbol="fg"[d % 2], ms=str(d)) for d in range(40)]
    first, late = rows[:25] + rows[30:], rows[25:30]
    write_state(cumulative_state(once(frame, *first)), str(tmp_path / "state"))
    grown = extended_state(stored_state(spark, str(tmp_path / "state")), once(frame, *late))
    for day in (date(2026, 1, 20), date(2026, 2, 6), date(2026, 3, 1)):
        read = lambda state: tuples(entity_features(state, day).drop("n_by_event_type", "total_by_event_type", "last_by_event_type", "since_by_event_type", "n7_by_event_type", "n30_by_event_type", "n_by_severity"))  # noqa: E731, B023
        assert read(grown) == read(cumulative_state(once(frame, *rows))) != []
