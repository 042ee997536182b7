"""Runtime events and incidents (RUN, INC, JN-09, STR-05)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.redaction import redacted_map, redacted_text
from graphloom.functions.text import some
from graphloom.operators.graph import once
from graphloom.operators.instants import service_of

MAX_ATTRIBUTES = 102_400


def first_arrivals(events: DataFrame) -> DataFrame:
    """Each event once, as it arrived first."""
    others = [c for c in events.columns if c not in ("event_id", "attributes")]
    entry = F.struct("ingested_at", *(c for c in others if c != "ingested_at"), F.array_sort(F.map_entries("attributes")).alias("a"))
    rows = events.groupBy("event_id").agg(F.min(entry).alias("e"))
    return rows.select("event_id", *(F.col(f"e.{c}").alias(c) for c in others), F.map_from_entries("e.a").alias("attributes"))


def valid_events(events: DataFrame) -> DataFrame:
    """SRC-06: events whose attributes and message keep within the size limit; the others go to ``oversized``."""
    return events.where(~_oversized())


def oversized_events(events: DataFrame) -> DataFrame:
    return events.where(_oversized())


def _oversized():
    size = F.coalesce(F.octet_length(F.to_json("attributes")), F.lit(0))
    return (size > MAX_ATTRIBUTES) | (F.coalesce(F.octet_length("message"), F.lit(0)) > MAX_ATTRIBUTES)


def correlations(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """JN-09: ``snapshot_id, symbol, route, service, artifact_id, confidence, method`` for every distinct combination in the events.

    In order: symbol is the name or a dotted end of the qualified name (.95), an endpoint's location holds the route (.90), the
    service is the name or qualified name whatever the case (.75), or part of the name (.70). Ties take the smallest id; without a
    match the method is UNMATCHED. Events are reduced to distinct keys first; every join has the snapshot as an equality.
    """
    keys = events.select("snapshot_id", some(F.element_at("attributes", "symbol")).alias("symbol"), some(F.element_at("attributes", "route")).alias("route"), service_of(events).alias("service")).where("snapshot_id is not null").distinct()
    rows = once(artifacts).select("snapshot_id", "id", "artifact_type", "name", "qualified_name", "location")
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    hit = lambda rank, frame, column: frame.select("snapshot_id", F.col(column).alias("key"), F.struct(F.lit(rank).alias("rank"), "id").alias("m"))
    symbols = keys.select("snapshot_id", "symbol").where("symbol is not null").distinct().withColumn("tail", last(F.col("symbol")))
    by_symbol = symbols.join(rows.select("snapshot_id", "id", "name", "qualified_name", F.explode(F.array_distinct(F.array(last(F.coalesce("qualified_name", F.lit(""))), last(F.coalesce("name", F.lit(""))), F.coalesce("name", F.lit(""))))).alias("tail")), ["snapshot_id", "tail"]).where((F.col("name") == F.col("symbol")) | F.col("qualified_name").endswith(F.concat(F.lit("."), "symbol")))
    routes = keys.select("snapshot_id", "route").where("route is not null").distinct()
    by_route = routes.join(rows.where(F.col("artifact_type").isin("API_ENDPOINT", "ENDPOINT", "ROUTE")), "snapshot_id").where(F.lower("location").contains(F.lower("route")))
    services = keys.select("snapshot_id", "service").where("service is not null").distinct()
    by_service = services.join(rows, "snapshot_id").where((F.lower("name") == F.lower("service")) | (F.lower("qualified_name") == F.lower("service")) | F.lower("name").contains(F.lower("service")))
    exact = (F.lower("name") == F.lower("service")) | (F.lower("qualified_name") == F.lower("service"))
    served = by_service.select("snapshot_id", F.col("service").alias("key"), F.struct(F.when(exact, 4).otherwise(5).alias("rank"), "id").alias("m"))
    out = keys
    for name, found in (("symbol", hit(1, by_symbol, "symbol")), ("route", hit(2, by_route, "route")), ("service", served)):
        best = found.groupBy("snapshot_id", "key").agg(F.min("m").alias(f"m_{name}")).withColumnRenamed("key", name)
        out = out.join(best, ["snapshot_id", name], "left")
    best = F.coalesce("m_symbol", "m_route", "m_service")
    rank = best["rank"]
    method = F.when(rank == 1, "SYMBOL_EXACT").when(rank == 2, "API_ROUTE").when(rank == 4, "SERVICE_NAME").when(rank == 5, "SERVICE_PARTIAL").otherwise("UNMATCHED")
    confidence = F.when(rank == 1, 0.95).when(rank == 2, 0.90).when(rank == 4, 0.75).when(rank == 5, 0.70).otherwise(0.0)
    return out.select("snapshot_id", "symbol", "route", "service", best["id"].alias("artifact_id"), confidence.alias("confidence"), method.alias("method"))


def sanitised(events: DataFrame) -> DataFrame:
    """Events with message and attributes redacted and a flag where anything was."""
    hidden, text = redacted_map(F.col("attributes")), redacted_text(F.col("message"))
    changed = (F.to_json(hidden) != F.to_json("attributes")) | (text != F.col("message"))
    return events.withColumn("was_redacted", F.coalesce(changed, F.lit(False))).withColumn("attributes", hidden).withColumn("message", text)


def ingested(events: DataFrame, artifacts: DataFrame, environment: str = "production") -> DataFrame:
    """RUN-03, STR-05: redacted, correlated events with defaults: the stateless core of batch and streaming ingest."""
    rows = sanitised(valid_events(events)).withColumn("_symbol", some(F.element_at("attributes", "symbol"))).withColumn("_route", some(F.element_at("attributes", "route"))).withColumn("_service", service_of(events))
    known = correlations(events, artifacts).alias("c")
    same = (F.col("e.snapshot_id") == F.col("c.snapshot_id")) & F.col("e._symbol").eqNullSafe(F.col("c.symbol")) & F.col("e._route").eqNullSafe(F.col("c.route")) & F.col("e._service").eqNullSafe(F.col("c.service"))
    joined = rows.alias("e").join(known, same, "left")
    return joined.select(
        "e.event_id", "e.repository_id", "e.snapshot_id", F.coalesce("e._service", "e.component_name").alias("service_name"), F.upper("e.event_type").alias("event_type"), F.upper("e.severity").alias("severity"),
        F.coalesce(some(F.col("e.environment")), F.lit(environment)).alias("environment"), "e.message", "e.attributes", "e.was_redacted", F.col("c.artifact_id").alias("artifact_id"), F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("c.method", F.lit("NO_SNAPSHOT")).alias("method"),
    )


def incident_evidence(incidents: DataFrame, links: DataFrame, events: DataFrame, fallback: int = 10) -> DataFrame:
    """INC-02: ``incident_id, event_id, source``: linked events, or the last ERROR or CRITICAL ones of the repository where none is linked.

    The fallback takes the ``fallback`` newest by arrival, ties by id, found once per repository and then joined.
    """
    named = once(incidents).select(F.col("id").alias("incident_id"), F.explode("evidence_ids").alias("e")).select("incident_id", F.lower(some("e")).alias("event_id"))
    linked = once(links).where("target_type = 'runtime_event'").select("incident_id", F.lower(some("target_id")).alias("event_id"))
    known = events.select(F.lower(some("event_id")).alias("event_id")).distinct()
    direct = named.unionByName(linked).where("event_id is not null").distinct().join(known, "event_id", "left_semi")
    bad = events.where(F.upper("severity").isin("ERROR", "CRITICAL")).groupBy("repository_id", "event_id").agg(F.min("ingested_at").alias("at"))
    newest = bad.withColumn("k", F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc("at"), "event_id"))).where(F.col("k") <= fallback)
    without = once(incidents).select(F.col("id").alias("incident_id"), "repository_id").join(direct.select("incident_id"), "incident_id", "left_anti")
    recent = without.join(newest.select("repository_id", "event_id"), "repository_id").select("incident_id", "event_id")
    return direct.select("incident_id", "event_id", F.lit("LINKED").alias("source")).unionByName(recent.withColumn("source", F.lit("RECENT")))


def affected_components(incidents: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """INC-02: each incident's component: its own, else that of its first event (smallest id) that has one."""
    parts = events.where("component_artifact_id is not null").groupBy(F.lower(some("event_id")).alias("event_id")).agg(F.min("component_artifact_id").alias("component"))
    first = evidence.join(parts, "event_id").groupBy("incident_id").agg(F.min_by("component", "event_id").alias("found"))
    rows = once(incidents).select(F.col("id").alias("incident_id"), some("affected_component_id").alias("own"))
    return rows.join(first, "incident_id", "left").select("incident_id", F.coalesce("own", "found").alias("component_id"), F.when(F.col("own").isNotNull(), "OWN").when(F.col("found").isNotNull(), "EVENT").otherwise("UNKNOWN").alias("source"))


def component_health(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """RSK-06, RSK-07 inputs: per component: events, errors, production events, incidents, critical ones."""
    e = events.where("component_artifact_id is not null").groupBy(F.col("component_artifact_id").alias("component_id")).agg(F.count_distinct("event_id").alias("events"), F.count_distinct(F.when(F.upper("severity").isin("ERROR", "CRITICAL"), F.col("event_id"))).alias("errors"), F.count_distinct(F.when(F.col("environment") == "production", F.col("event_id"))).alias("production"))
    i = once(incidents).where("affected_component_id is not null").groupBy(F.col("affected_component_id").alias("component_id")).agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.lower("severity") == "critical").alias("critical"))
    parts = [e.select("component_id", "events", "errors", "production", F.lit(0).alias("incidents"), F.lit(0).alias("critical")), i.select("component_id", F.lit(0).alias("events"), F.lit(0).alias("errors"), F.lit(0).alias("production"), "incidents", "critical")]
    return reduce(DataFrame.unionByName, parts).groupBy("component_id").agg(*(F.sum(c).alias(c) for c in ("events", "errors", "production", "incidents", "critical")))
