"""Problem 4: mixed timestamp notations and zones to one UTC instant."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from graphloom.functions.text import some
from graphloom.functions.timestamps import instants
from graphloom.functions.zones import tables, version
from graphloom.session import bounded_broadcast

#: The form that needs no work: exactly this, in upper case and without blanks.
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?Z$"


def zone_tables(services: DataFrame) -> dict:
    """Transition tables of the zones that services name.

    The distinct zone names go to the driver; there are at most as many as the zone
    database has (some 600), however many services there are.
    """
    return tables([r[0] for r in services.select("tz_name").where("tz_name is not null").distinct().collect()])


def instant_column(zones: dict):
    """The vectorised parser: ``f(text, tz_name, day_first) -> bigint microseconds``."""

    @F.pandas_udf(LongType())
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, zone, first in batches:
            yield instants(text, zone, first, zones)

    return parsed


def with_instants(rows: DataFrame, services: DataFrame, text: str, service: Column, name: str = "instant_us") -> DataFrame:
    """``rows`` with the instant of column ``text`` in microseconds since 1970 UTC, null where it cannot be fixed.

    Texts without a zone are read in the zone of the row's service, numeric dates in its order;
    without a known service such texts stay null, as do dates that do not exist, times that are none,
    dates without a time, unknown zone abbreviations, null and empty texts. Digits finer
    than microseconds are cut off. Repeated rows stay repeated; columns of other names stay as they are.
    """
    taken = {c.lower() for c in rows.columns}
    key, zone, first = ("_" * (1 + max(map(len, rows.columns))) + c for c in "ktf")
    known = services.groupBy(some("name").alias(key)).agg(F.min("tz_name").alias(zone), F.min("day_first").alias(first)).where(F.col(key).isNotNull())
    joined = rows.withColumn(key, some(service)).join(bounded_broadcast(known), key, "left")
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() != name.lower() or name.lower() not in taken]
    return joined.select(*kept, instant_column(zone_tables(services))(F.col(text), F.col(zone), F.col(first)).alias(name))


def service_of(rows: DataFrame) -> Column:
    """The service that wrote a row: ``service``, else ``service_name``."""
    found = [some(c) for c in ("service", "service_name") if c in rows.columns]
    return reduce(lambda a, b: F.coalesce(a, b), found)


def _records(rows: DataFrame, record_id: str, text: str) -> DataFrame:
    return rows.select(F.col(record_id).alias("record_id"), F.col(text).alias("text"), service_of(rows).alias("service"))


def normalised_times(events: DataFrame, incidents: DataFrame, services: DataFrame) -> DataFrame:
    """Every event and incident: ``source, record_id, instant_us, status, zone_version``.

    Status is ``canonical``, ``converted`` or ``unresolved``; one row per distinct record and text.
    """
    rows = _records(events, "event_id", "timestamp").withColumn("source", F.lit("runtime_events")).unionByName(_records(incidents, "id", "detected_at").withColumn("source", F.lit("incidents")))
    timed = with_instants(rows, services, "text", F.col("service"))
    status = F.when(F.col("instant_us").isNull(), "unresolved").when(F.col("text").rlike(CANONICAL), "canonical").otherwise("converted")
    return timed.select("source", "record_id", "instant_us", status.alias("status"), F.lit(version()).alias("zone_version")).distinct()


def converted_times(events: DataFrame, incidents: DataFrame, services: DataFrame) -> DataFrame:
    """``record_id, instant_us`` of the records that needed conversion and could be fixed in time."""
    rows = _records(events, "event_id", "timestamp").unionByName(_records(incidents, "id", "detected_at"))
    rows = rows.where(F.col("text").isNotNull() & ~F.col("text").rlike(CANONICAL))
    timed = with_instants(rows, services, "text", F.col("service"))
    return timed.where("instant_us is not null").select("record_id", "instant_us").distinct()
