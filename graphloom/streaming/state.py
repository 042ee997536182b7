"""Structured Streaming operators: ingest, windows, replay guard, lockout and rate limit (STR family)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators.runtime import sanitised, valid_events


def clean_stream(events: DataFrame) -> DataFrame:
    """STR-05: the stateless part of ingest on a stream: size check, redaction, upper-case types."""
    return sanitised(valid_events(events)).withColumn("event_type", F.upper("event_type")).withColumn("severity", F.upper("severity"))


def windowed_counts(events: DataFrame, time: str = "at", window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window and type; events later than ``late`` behind the watermark are dropped by the stream."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_deliveries(deliveries: DataFrame, key: str = "delivery_id", time: str = "at", fresh: str = "10 minutes") -> DataFrame:
    """STR-03, DED-04: each delivery id once within the freshness window."""
    return deliveries.withWatermark(time, fresh).dropDuplicatesWithinWatermark([key])


def _keyed(rows: DataFrame, key: str, step, output: str, state: str) -> DataFrame:
    return rows.groupBy(key).applyInPandasWithState(step, output, state, "append", GroupStateTimeout.NoTimeout)


def lockouts(attempts: DataFrame, failures: int = 5, seconds: int = 300) -> DataFrame:
    """STR-02: ``user, at_s, locked`` per attempt (``user, at_s, success``): locked after ``failures`` failures in a rolling window; a success clears them.

    The state per user holds at most ``failures`` times. Attempts of one batch are taken in order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at_s", kind="stable")
        out = []
        for at, success in zip(rows["at_s"], rows["success"], strict=True):
            times = [t for t in times if at - t < seconds]
            locked = len(times) >= failures
            if not locked:
                times = [] if success else [*times, int(at)]
            out.append((key[0], int(at), locked))
        state.update((times[-failures:],))
        yield pd.DataFrame(out, columns=["user", "at_s", "locked"])

    return _keyed(attempts, "user", step, "user string, at_s bigint, locked boolean", "times array<bigint>")


def rate_limited(calls: DataFrame, limit: int, seconds: int) -> DataFrame:
    """STR-01: ``user, at_s, accepted``: at most ``limit`` accepted calls in any ``seconds``; only accepted calls are remembered."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at_s", kind="stable")
        out = []
        for at in rows["at_s"]:
            times = [t for t in times if at - t < seconds]
            accepted = len(times) < limit
            if accepted:
                times.append(int(at))
            out.append((key[0], int(at), accepted))
        state.update((times,))
        yield pd.DataFrame(out, columns=["user", "at_s", "accepted"])

    return _keyed(calls, "user", step, "user string, at_s bigint, accepted boolean", "times array<bigint>")


def unexpired(rows: DataFrame, expires: str, now: str = "at") -> DataFrame:
    """STR-04: rows whose expiry lies after their event time, or that have none."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > F.col(now)))
