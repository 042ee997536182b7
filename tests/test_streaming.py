from datetime import datetime, timedelta

import pytest

from graphloom.streaming import state
from tests.conftest import tuples


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a stream over batches of rows and gives what it wrote."""

    def run(schema, batches, build, name):
        folder = tmp_path / name
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{i}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
        query = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        finally:
            query.stop()
        return spark.table(name)

    return run


def test_lockout(streamed):
    fails = [("u", t, False) for t in (0, 10, 20, 30, 40)]
    out = streamed("user string, at_s bigint, success boolean", [fails, [("u", 50, True), ("u", 301, True), ("v", 1, True)]], state.lockouts, "lockouts")
    assert tuples(out) == sorted([("u", t, False) for t in (0, 10, 20, 30, 40)] + [("u", 50, True), ("u", 301, False), ("v", 1, False)], key=repr)


def test_rate_limit(streamed):
    out = streamed("user string, at_s bigint", [[("u", 0), ("u", 1), ("u", 2)], [("u", 3), ("u", 10), ("u", 11)]], lambda d: state.rate_limited(d, 2, 10), "limited")
    assert tuples(out) == sorted([("u", 0, True), ("u", 1, True), ("u", 2, False), ("u", 3, False), ("u", 10, True), ("u", 11, True)], key=repr)


def test_replay_guard(streamed):
    t = datetime(2026, 1, 1)
    out = streamed("delivery_id string, at timestamp", [[("a", t), ("a", t), ("b", t)], [("a", t + timedelta(minutes=1)), ("c", t)]], state.first_deliveries, "deliveries")
    assert tuples(out, "delivery_id") == [("a",), ("b",), ("c",)]


def test_windows(streamed):
    t = datetime(2026, 1, 1)
    rows = [[("LOG", t), ("LOG", t + timedelta(minutes=1))], [("LOG", t + timedelta(minutes=30))], [("LOG", t + timedelta(minutes=31))], [("LOG", t + timedelta(minutes=2)), ("LOG", t + timedelta(minutes=60))]]
    out = streamed("event_type string, at timestamp", rows, state.windowed_counts, "counts")
    assert tuples(out)[0] == (t, "LOG", 2)


def test_clean_and_expiry(frame):
    events = frame("event_id string, event_type string, severity string, message string, attributes map<string,string>", ("1", "log", "info", "mail a@b.example", {"token": "x"}))
    row = state.clean_stream(events).first()
    assert (row.event_type, row.message, row.attributes, row.was_redacted) == ("LOG", "mail [REDACTED_EMAIL]", {"token": "[REDACTED]"}, True)
    t = datetime(2026, 1, 1)
    assert tuples(state.unexpired(frame("k string, at timestamp, until timestamp", ("a", t, t), ("b", t, None), ("c", t, t + timedelta(1))), "until"), "k") == [("b",), ("c",)]
