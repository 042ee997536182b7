"""Problem 2: one feature row per entity from events of hundreds of types.

Stored state: cumulative counts and totals by entity, type and day (``write_state``, ``stored_state``); new events are added to it day by
day (``extended_state``) without reading the old ones again. A window feature is the cumulative value at the window's end minus the one at its start, so any as-of date
and window length is read from the same state without touching events again; recency comes from the
largest instant. An entity's group holds at most days x types rows whatever its share of events.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import some
from graphloom.operators.instants import service_of, with_instants

ENTITY = ["service", "symbol"]


def distinct_events(events: DataFrame, services: DataFrame) -> DataFrame:
    """Each event once (its first arrival): ``service, symbol, event_type, severity, at_us, duration_ms``.

    Types and severities are upper case (``WARNING`` is ``WARN``), empty texts are null, a duration that is
    no number is null. ``at_us`` is the event's own time, or its arrival where that cannot be fixed.
    Events without an id cannot be known again and count one by one.
    """
    arrival = F.unix_micros("ingested_at")
    fields = F.struct(arrival.alias("arrival"), F.col("timestamp").alias("text"), service_of(events).alias("service"), some(F.element_at("attributes", "symbol")).alias("symbol"), F.upper(some("event_type")).alias("event_type"), F.upper(some("severity")).alias("severity"), F.expr("try_cast(attributes['duration_ms'] as decimal(18,6))").alias("duration_ms"))
    rows = events.select("event_id", fields.alias("e"))
    named = rows.where("event_id is not null").groupBy("event_id").agg(F.min("e").alias("e"))
    once = named.select("e.*").unionByName(rows.where("event_id is null").select("e.*"))
    timed = with_instants(once, services, "text", F.col("service"), "own_us")
    severity = F.when(F.col("severity") == "WARNING", "WARN").otherwise(F.col("severity"))
    return timed.select("service", "symbol", "event_type", severity.alias("severity"), F.coalesce("own_us", "arrival").alias("at_us"), "duration_ms")


SERIES = [*ENTITY, "event_type", "severity"]


def daily_counts(events: DataFrame) -> DataFrame:
    """``service, symbol, event_type, severity, day, n, total, last_us`` from distinct events."""
    day = F.to_date(F.timestamp_micros("at_us"))
    return events.groupBy(*SERIES, day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total"), F.max("at_us").alias("last_us"))


def _cumulated(daily: DataFrame) -> DataFrame:
    running = W.partitionBy(*SERIES).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumns({"cum_n": F.sum("n").over(running), "cum_total": F.sum(F.coalesce("total", F.lit(0))).over(running)})


def cumulative_state(events: DataFrame) -> DataFrame:
    """``service, symbol, event_type, severity, day, n, total, last_us, cum_n, cum_total`` from distinct events."""
    return _cumulated(daily_counts(events))


def extended_state(state: DataFrame, new_events: DataFrame) -> DataFrame:
    """The state with distinct events that it does not hold yet, of any day: days add up, and only their sums are cumulated again.

    Events must be distinct against what the state holds too; late ones of an old day raise the later cumulative values with it.
    """
    columns = [*SERIES, "day", "n", "total", "last_us"]
    parts = state.select(*columns).unionByName(daily_counts(new_events).select(*columns))
    return _cumulated(parts.groupBy(*SERIES, "day").agg(F.sum("n").alias("n"), F.sum("total").cast(state.schema["total"].dataType).alias("total"), F.max("last_us").alias("last_us")))


def write_state(state: DataFrame, folder: str) -> None:
    """Keep a state under a new folder, by day, so that a reader of an as-of date prunes later days."""
    state.repartition("day").sortWithinPartitions(*SERIES).write.partitionBy("day").parquet(folder)


def stored_state(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _as_of(value: str, day: Column) -> Column:
    """Cumulative value at the end of ``day``: the one of the last day up to it, 0 before the first."""
    reached = F.col("day") <= day
    return F.coalesce(F.max_by(F.when(reached, F.col(value)), F.when(reached, F.col("day"))), F.lit(0))


def _by(wanted: Column, value: str, name: str) -> Column:
    entry = F.when(wanted & F.col("name").isNotNull() & F.col(value).isNotNull(), F.struct("name", value))
    return F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(f"{value}_by_{name}")


def entity_features(state: DataFrame, as_of: date, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per service and symbol as of the end of a day.

    ``n_events``, ``duration_total_ms``, ``last_us``, ``seconds_since_last`` (to the end of the day), for each window
    of days ``n_<w>d`` and ``duration_<w>d``, and maps by event type (count, total, last instant, seconds since, count in
    each window) and by severity (count). A null service or symbol is an entity of its own; null types and severities count in
    ``n_events`` but enter no map. Events after the day do not count; entities with no others get no row. Empty input gives none.
    """
    end = F.lit(as_of.isoformat()).cast("date")
    end_us = F.unix_micros(F.date_add(end, 1).cast("timestamp"))
    known = state.where(F.col("day") <= end)
    series = known.groupBy(*ENTITY, "event_type", "severity").agg(
        _as_of("cum_n", end).alias("n"),
        _as_of("cum_total", end).alias("total"),
        F.max("last_us").alias("last"),
        *(_as_of("cum_n", F.date_sub(end, w)).alias(f"_n{w}") for w in windows),
        *(_as_of("cum_total", F.date_sub(end, w)).alias(f"_t{w}") for w in windows),
    )
    window_columns = [c for w in windows for c in ((F.col("n") - F.col(f"_n{w}")).alias(f"n{w}"), (F.col("total") - F.col(f"_t{w}")).alias(f"t{w}"))]
    series = series.select(*ENTITY, "event_type", "severity", "n", "total", "last", *window_columns)
    measures = ["n", "total", *(f"{k}{w}" for w in windows for k in "nt")]
    tagged = series.select(*ENTITY, F.explode(F.array(F.struct(F.lit(True).alias("typed"), F.col("event_type").alias("name"), *measures, "last"), F.struct(F.lit(False).alias("typed"), F.col("severity").alias("name"), *measures, "last"))).alias("m")).select(*ENTITY, "m.*")
    named = tagged.groupBy(*ENTITY, "typed", "name").agg(*(F.sum(c).alias(c) for c in measures), F.max("last").alias("last")).withColumn("since", ((end_us - F.col("last")) / 1e6).cast("bigint"))
    typed = F.col("typed")
    rows = named.groupBy(*ENTITY).agg(
        *(F.sum(F.when(typed, F.col(c))).alias(c) for c in measures),
        F.max("last").alias("last"),
        *(_by(typed, v, "event_type") for v in ("n", "total", "last", "since", *(f"n{w}" for w in windows))),
        _by(~typed, "n", "severity"),
    )
    return rows.select(
        "service",
        "symbol",
        F.col("n").alias("n_events"),
        F.col("total").cast("double").alias("duration_total_ms"),
        F.col("last").alias("last_us"),
        ((end_us - F.col("last")) / 1e6).cast("bigint").alias("seconds_since_last"),
        *(F.col(f"n{w}").alias(f"n_{w}d") for w in windows),
        *(F.col(f"t{w}").cast("double").alias(f"duration_{w}d") for w in windows),
        F.col("n_by_event_type"),
        F.col("total_by_event_type"),
        F.col("last_by_event_type"),
        F.col("since_by_event_type"),
        *(F.col(f"n{w}_by_event_type") for w in windows),
        F.col("n_by_severity"),
    )


def type_counts(events: DataFrame) -> DataFrame:
    """Long form: distinct events per service, symbol, type and severity."""
    return events.groupBy(*ENTITY, "event_type", "severity").agg(F.count(F.lit(1)).alias("n_events"), F.sum("duration_ms").cast("double").alias("duration_total_ms"))
