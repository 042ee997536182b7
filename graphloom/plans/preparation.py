"""Queries of the general data-preparation problems and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import entity_features, hot_keys, instants, references, schema_drift, snapshot_changes
from graphloom.plans import instant_sql
from graphloom.session import checkpointed
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    _, scripts = schema_drift.drift(table(spark, folder, "event_lines"))
    return schema_drift.schema_changes(scripts).select("feed_id", "file_no", "field_name", "change").distinct()


def p1_table(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "event_lines")
    schemas, scripts = schema_drift.drift(lines)
    plan = checkpointed(schema_drift.projections(schemas, checkpointed(scripts)))
    return schema_drift.consistent_table(lines, plan)


def _events_once(spark: SparkSession, folder: str) -> DataFrame:
    return entity_features.distinct_events(table(spark, folder, "runtime_events"), table(spark, folder, "services"))


def p2_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features as of the end of the day of the latest arrival."""
    latest = table(spark, folder, "runtime_events").agg(F.max(F.to_date("ingested_at"))).first()[0]
    state = entity_features.cumulative_state(_events_once(spark, folder))
    return entity_features.entity_features(state, latest or date(1970, 1, 1))


def p2_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The scalar part of the features."""
    return p2_features(spark, folder).select("service", "symbol", "n_events", "duration_total_ms", "last_us", "seconds_since_last", "n_7d", "n_30d", "duration_7d", "duration_30d")


def p2_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return entity_features.type_counts(_events_once(spark, folder))


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    return hot_keys.hot_key_profile(table(spark, folder, "edges"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hot_keys.hot_keys(hot_keys.key_counts(table(spark, folder, "edges"))).select("target_artifact_id", "relationship_type")


def _time_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("runtime_events", "incidents", "services")]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return instants.converted_times(*_time_tables(spark, folder))


def p4_times(spark: SparkSession, folder: str) -> DataFrame:
    return instants.normalised_times(*_time_tables(spark, folder)).drop("zone_version")


def _dangling(spark: SparkSession, folder: str) -> DataFrame:
    names = ("edges", "incident_links", "incidents", "artifacts", "external_nodes", "snapshots", "runtime_events")
    return references.dangling_references(*(table(spark, folder, t) for t in names))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _dangling(spark, folder).select(*references.COLUMNS)


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_report(_dangling(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes.snapshot_changes(table(spark, folder, "snapshots"), table(spark, folder, "artifacts"))


def p6_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """How far the digests of matching chunks spare rows the join. Borders of the sort's places differ from run to run, so it has no SQL."""
    return snapshot_changes.chunk_statistics(table(spark, folder, "snapshots"), table(spark, folder, "artifacts"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes.change_counts(p6_found(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_table, p2_features, p2_windows, p2_type_counts, p3_found, p3_profile, p4_found, p4_times, p5_found, p5_report, p6_found, p6_counts, p6_chunks)}

_PAIRS = """
WITH edge AS (SELECT DISTINCT id, target_artifact_id, relationship_type, source_artifact_id, confidence FROM edges WHERE id IS NOT NULL),
profile AS (
  SELECT target_artifact_id, relationship_type, count(DISTINCT id) AS n_edges, count(DISTINCT source_artifact_id) AS n_sources,
         CAST(sum(CAST(confidence AS DECIMAL(18,9))) AS DOUBLE) / nullif(count(confidence), 0) AS mean_confidence
  FROM edge GROUP BY ALL)
"""
_STRIP = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))), '')"
_K = _STRIP.format
_DANGLING = f"""
WITH art AS (SELECT DISTINCT {_K('id')} AS k, coalesce(snapshot_id, '') AS s FROM artifacts WHERE {_K('id')} IS NOT NULL),
ext AS (SELECT DISTINCT {_K('id')} AS k FROM external_nodes),
snap AS (SELECT id AS s, min(created_at) AS ts FROM snapshots GROUP BY id),
edge AS (SELECT DISTINCT id, {_K('target_artifact_id')} AS k, coalesce(snapshot_id, '') AS s FROM edges WHERE {_K('target_artifact_id')} IS NOT NULL),
open_edge AS (SELECT e.*, es.ts FROM edge e LEFT JOIN snap es ON es.s = e.s
  WHERE NOT EXISTS (SELECT 1 FROM ext x WHERE x.k = e.k) AND NOT EXISTS (SELECT 1 FROM art a WHERE a.k = e.k AND a.s = e.s)),
edge_found AS (
  SELECT o.id, o.k, o.ts, CASE WHEN count(a.k) = 0 THEN 'missing'
    WHEN coalesce(bool_or(sa.ts > o.ts), false) AND NOT coalesce(bool_or(sa.ts < o.ts), false) THEN 'late' ELSE 'deleted' END AS kind
  FROM open_edge o LEFT JOIN art a ON a.k = o.k LEFT JOIN snap sa ON sa.s = a.s
  GROUP BY ALL HAVING NOT coalesce(bool_or(sa.ts = o.ts), false)),
seen AS (SELECT {_K('event_id')} AS k, min(ingested_at) AS first_at FROM runtime_events GROUP BY 1),
event_ref AS (
  SELECT 'incident_links' AS ref_table, id, {_K('target_id')} AS k, created_at AS ts FROM incident_links WHERE lower(target_type) = 'runtime_event'
  UNION ALL SELECT 'incidents', id, {_K('e')}, created_at FROM (SELECT id, unnest(evidence_ids) AS e, created_at FROM incidents)),
found AS (
  SELECT 'edges' AS ref_table, id AS ref_id, k AS missing_key, kind, ts FROM edge_found
  UNION ALL SELECT 'incident_links', l.id, l.k, 'missing', l.ts FROM (SELECT id, {_K('target_id')} AS k, created_at AS ts FROM incident_links WHERE lower(target_type) = 'artifact') l
    WHERE l.k IS NOT NULL AND l.k NOT IN (SELECT k FROM art) AND l.k NOT IN (SELECT k FROM ext WHERE k IS NOT NULL)
  UNION ALL SELECT r.ref_table, r.id, r.k, CASE WHEN s.k IS NULL THEN 'missing' ELSE 'late' END, r.ts
    FROM event_ref r LEFT JOIN seen s ON s.k = r.k WHERE r.k IS NOT NULL AND (s.k IS NULL OR s.first_at > r.ts)),
dangling AS (SELECT ref_table, ref_id, missing_key, kind, min(ts) AS ts FROM found GROUP BY ALL)
"""
_CHANGES = """
WITH ready AS (SELECT DISTINCT id, repository_id, branch_name, created_at FROM snapshots WHERE snapshot_metadata['status'] = 'READY'),
pair AS (SELECT * FROM (SELECT id, lag(id) OVER (PARTITION BY repository_id, branch_name ORDER BY created_at, id) AS prev FROM ready) WHERE prev IS NOT NULL),
art AS (
  SELECT snapshot_id, trim(qualified_name) AS name, artifact_type, coalesce(signature, '') AS signature, replace(location, '\\', '/') AS location, line_end,
         nullif(trim(source_hash), '') AS source_hash
  FROM artifacts WHERE trim(qualified_name) <> '' QUALIFY row_number() OVER (PARTITION BY snapshot_id, trim(qualified_name) ORDER BY id) = 1),
side AS (
  SELECT p.id AS snapshot_id, coalesce(a.name, b.name) AS qualified_name,
    CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed'
         WHEN a.artifact_type IS DISTINCT FROM b.artifact_type OR a.signature <> b.signature OR a.location IS DISTINCT FROM b.location
           OR a.line_end IS DISTINCT FROM b.line_end OR a.source_hash <> b.source_hash THEN 'changed' END AS change
  FROM (SELECT p.id, p.prev, n.name FROM pair p JOIN (SELECT snapshot_id, name FROM art) n ON n.snapshot_id IN (p.id, p.prev) GROUP BY ALL) p
  LEFT JOIN art a ON a.snapshot_id = p.id AND a.name = p.name LEFT JOIN art b ON b.snapshot_id = p.prev AND b.name = p.name),
changes AS (SELECT * FROM side WHERE change IS NOT NULL)
"""
_WINDOWS = f"""
WITH {instant_sql.TIMES},
own AS (SELECT record_id, any_value(instant_us) AS us FROM times WHERE source = 'runtime_events' GROUP BY 1),
once AS (SELECT event_id, coalesce(service, service_name) AS service, nullif(trim(attributes['symbol']), '') AS symbol, try_cast(attributes['duration_ms'] AS DECIMAL(18,6)) AS d, epoch_us(ingested_at) AS arrival FROM runtime_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at) = 1),
e AS (SELECT service, symbol, d, coalesce(own.us, arrival) AS us, (make_timestamp(coalesce(own.us, arrival)))::DATE AS day FROM once LEFT JOIN own ON own.record_id = event_id),
p AS (SELECT max((ingested_at AT TIME ZONE 'UTC')::DATE) AS day FROM runtime_events)
SELECT service, symbol, count(*) AS n_events, CAST(coalesce(sum(d), 0) AS DOUBLE) AS duration_total_ms, max(us) AS last_us, (epoch_us((any_value(p.day) + 1)::TIMESTAMP) - max(us)) // 1000000 AS seconds_since_last,
  count(*) FILTER (e.day > p.day - 7) AS n_7d, count(*) FILTER (e.day > p.day - 30) AS n_30d, CAST(coalesce(sum(d) FILTER (e.day > p.day - 7), 0) AS DOUBLE) AS duration_7d, CAST(coalesce(sum(d) FILTER (e.day > p.day - 30), 0) AS DOUBLE) AS duration_30d
FROM e JOIN p ON e.day <= p.day GROUP BY service, symbol
"""
SQL = {
    "p2_windows": _WINDOWS,
    "p2_type_counts": """
        WITH once AS (SELECT DISTINCT event_id, coalesce(service, service_name) AS service, attributes['symbol'] AS symbol, upper(event_type) AS event_type,
          CASE upper(severity) WHEN 'WARNING' THEN 'WARN' ELSE upper(severity) END AS severity, try_cast(attributes['duration_ms'] AS DECIMAL(18,6)) AS d FROM runtime_events)
        SELECT service, symbol, event_type, severity, count(*) AS n_events, CAST(sum(d) AS DOUBLE) AS duration_total_ms FROM once GROUP BY ALL""",
    "p3_found": _PAIRS + "SELECT target_artifact_id, relationship_type FROM profile WHERE n_edges >= 0.01 * (SELECT sum(n_edges) FROM profile)",
    "p3_profile": _PAIRS + "SELECT * FROM profile",
    "p4_found": instant_sql.FOUND,
    "p4_times": instant_sql.ALL,
    "p5_found": _DANGLING + "SELECT ref_table, ref_id, missing_key, kind FROM dangling",
    "p5_report": _DANGLING + "SELECT ref_table, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS month, kind, count(*) AS n_references, count(DISTINCT missing_key) AS n_keys FROM dangling GROUP BY ALL",
    "p6_found": _CHANGES + "SELECT snapshot_id, qualified_name, change FROM changes",
    "p6_counts": _CHANGES + "SELECT snapshot_id, change, count(*) AS n_symbols FROM changes GROUP BY ALL",
}
