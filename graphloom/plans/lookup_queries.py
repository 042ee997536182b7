"""Filters, lookups and joins over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.graph import is_test, layer_of_path, level_of_type, path_of
from graphloom.operators import lookup
from graphloom.operators.graph import once
from graphloom.plans.catalog import Catalog
from graphloom.plans.impact_queries import node_table

CATALOG = Catalog()
add = CATALOG.add
_FILE = "split_part(replace(location, '\\', '/'), ':', 1)"

add("flt01_artifact_scan", lambda t: lookup.artifact_scan(t.artifacts, "method", "Python").select("id", "snapshot_id", "qualified_name"), "art", "+++ SELECT id, snapshot_id, qualified_name FROM art WHERE artifact_type = 'METHOD' AND lower(language) = 'python'")
add("flt02_edge_scan", lambda t: lookup.edge_scan(t.edges, "CALLS").select("id", "source_artifact_id", "target_artifact_id"), "edge", "+++ SELECT id, source_artifact_id, target_artifact_id FROM edge WHERE relationship_type = 'CALLS'")
add("flt03_dependencies", lambda t: lookup.dependencies(t.edges, node_table(t)), "edge node", "+++ SELECT e.id, e.snapshot_id, e.relationship_type, coalesce(s.name, 'unknown') AS source_name, coalesce(d.name, 'unknown') AS target_name FROM edge e LEFT JOIN node s ON s.id = e.source_artifact_id LEFT JOIN node d ON d.id = e.target_artifact_id")
add(
    "flt04_event_page",
    lambda t: lookup.page(lookup.event_filter(t.runtime_events.groupBy("event_id", "environment", "severity", "event_type", "service", "service_name").agg(F.min("ingested_at").alias("at")), "production", "error", service="worker"), [F.desc("at"), F.col("event_id")], 1, 100).select("event_id", "event_type"),
    "ev",
    "+++ SELECT event_id, event_type FROM ev WHERE environment = 'production' AND upper(severity) = 'ERROR' AND contains(lower(coalesce(service, service_name)), 'worker') ORDER BY ingested_at DESC, event_id LIMIT 100 OFFSET 100",
)
add("flt05_incidents", lambda t: once(t.incidents).where((F.col("status") == "open") & (F.lower("severity") == "high")).select("id", "title", "created_at"), "inc", "+++ SELECT id, title, created_at FROM inc WHERE status = 'open' AND lower(severity) = 'high'")
add("flt06_api_surface", lambda t: lookup.api_surface(t.artifacts), "art", "+++ SELECT id, snapshot_id, qualified_name, coalesce(metadata['http_method'], 'GET') AS http_method FROM art WHERE artifact_type = 'API_ENDPOINT'")
add("flt07_candidates", lambda t: lookup.candidates(t.artifacts, "Journal").select("id", "qualified_name"), "art", "+++ SELECT id, qualified_name FROM art WHERE contains(lower(name), 'journal') OR contains(lower(qualified_name), 'journal') OR contains(lower(location), 'journal')")
add("flt08_components", lambda t: once(t.artifacts).where(F.col("artifact_type").isin("MODULE", "CLASS", "INTERFACE")).select("id", "snapshot_id", "artifact_type", "name"), "art", "+++ SELECT id, snapshot_id, artifact_type, name FROM art WHERE artifact_type IN ('MODULE', 'CLASS', 'INTERFACE')")
add("flt11_latest_snapshots", lambda t: lookup.latest_snapshots(t.snapshots), "snap", "+++ SELECT repository_id, id AS snapshot_id FROM snap QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) = 1")
add("flt12_preceding_snapshots", lambda t: lookup.preceding_snapshots(t.snapshots), "snap", "+++ SELECT id AS snapshot_id, lag(id) OVER (PARTITION BY repository_id ORDER BY created_at, id) AS preceding_id FROM snap")
add(
    "flt13_revisions",
    lambda t: lookup.resolved_revisions(t.snapshots, t.snapshots.select(F.substring("commit_hash", 1, 9).alias("revision")).union(t.snapshots.select("commit_hash")).union(t.snapshots.select("id")).union(t.runtime_events.select("commit_sha"))),
    "snap",
    """want AS (SELECT substr(commit_hash, 1, 9) AS revision FROM snap UNION SELECT commit_hash FROM snap UNION SELECT id FROM snap UNION SELECT commit_sha FROM runtime_events WHERE commit_sha IS NOT NULL),
    hit AS (SELECT revision, id, created_at, CASE WHEN revision = id THEN 1 WHEN revision = commit_hash THEN 2 ELSE 3 END AS rank FROM want JOIN snap ON revision = id OR revision = commit_hash OR (length(revision) >= 7 AND starts_with(commit_hash, revision)))
    +++ SELECT revision, id AS snapshot_id, ['id', 'commit', 'prefix'][rank] AS matched_by FROM hit QUALIFY row_number() OVER (PARTITION BY revision ORDER BY rank, created_at DESC, id DESC) = 1""",
)
add(
    "flt14_entities",
    lambda t: lookup.resolved_entities(t.artifacts, t.runtime_events.select("snapshot_id", F.col("component_name").alias("ident")).union(t.runtime_events.select("snapshot_id", "component_artifact_id")).union(t.runtime_events.select("snapshot_id", F.element_at("attributes", "symbol")))),
    "art",
    f"""want AS (SELECT snapshot_id, component_name AS ident FROM runtime_events UNION SELECT snapshot_id, component_artifact_id FROM runtime_events UNION SELECT snapshot_id, attributes['symbol'] FROM runtime_events),
    hit AS (
      SELECT w.snapshot_id, ident, 1 AS rank, 'id' AS matched_by, a.id FROM want w JOIN art a ON a.snapshot_id = w.snapshot_id AND a.id = ident
      UNION SELECT w.snapshot_id, ident, 2, 'qualified_name', a.id FROM want w JOIN art a ON a.snapshot_id = w.snapshot_id AND a.qualified_name = ident
      UNION SELECT w.snapshot_id, ident, 3, 'name', a.id FROM want w JOIN art a ON a.snapshot_id = w.snapshot_id AND a.name = ident
      UNION SELECT w.snapshot_id, ident, 4, 'any_case', a.id FROM want w JOIN art a ON a.snapshot_id = w.snapshot_id AND lower(a.qualified_name) = lower(ident)
      UNION SELECT w.snapshot_id, ident, 4, 'any_case', a.id FROM want w JOIN art a ON a.snapshot_id = w.snapshot_id AND lower(a.name) = lower(ident)
      UNION SELECT w.snapshot_id, ident, 5, 'file', a.id FROM want w JOIN art a ON a.snapshot_id = w.snapshot_id AND {_FILE} = ident),
    ranked AS (SELECT snapshot_id, ident, rank, matched_by, min(id) AS id, count(DISTINCT id) AS n FROM hit GROUP BY ALL), best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY snapshot_id, ident ORDER BY rank) = 1)
    +++ SELECT snapshot_id, ident, id AS artifact_id, matched_by, n > 1 AS ambiguous FROM best""",
)
_LAYERS = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce({_FILE}, '')), '{w}') THEN '{n}'" for n, w in (("presentation", "api|controller|presentation|routes|web|endpoint"), ("application", "service|application|usecase|handler|manager"), ("domain", "domain|model|entity|schema"), ("infrastructure", "db|database|repository|infrastructure|client|adapter"), ("test", "test"))) + " ELSE 'core' END"
add("flt16_layers", lambda t: once(t.artifacts).select("id", layer_of_path(path_of("location")).alias("layer")), "art", f"+++ SELECT id, {_LAYERS} AS layer FROM art")
add("flt17_levels", lambda t: once(t.artifacts).select("id", level_of_type(F.col("artifact_type")).alias("level")), "art", "+++ SELECT id, CASE WHEN artifact_type IN ('PACKAGE','DIRECTORY','SERVICE','DATABASE','API_ENDPOINT','DOCKER_STAGE','SQL_TABLE','DATABASE_TABLE') THEN 1 WHEN artifact_type IN ('MODULE','CLASS','INTERFACE','COMPONENT','TEST_CASE','TEST_SUITE') THEN 2 WHEN artifact_type IN ('METHOD','FUNCTION','CONSTRUCTOR') THEN 3 ELSE 4 END AS level FROM art")
add("flt19_tests", lambda t: once(t.artifacts).where(is_test(F.col("artifact_type"), F.col("location"), F.col("name"))).select("id", "snapshot_id"), "art", "+++ SELECT id, snapshot_id FROM art WHERE artifact_type IN ('TEST_CASE','TEST_SUITE') OR ((contains(lower(location), '/test') OR starts_with(lower(location), 'test')) AND (starts_with(name, 'test_') OR ends_with(name, 'Test') OR ends_with(name, 'Tests')))")
add("jn03_edges_per_repository", lambda t: once(t.edges).select(F.col("source_artifact_id").alias("aid")).join(once(t.artifacts).select(F.col("id").alias("aid"), "repository_id"), "aid").groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_edges")), "edge art", "+++ SELECT a.repository_id, count(*) AS n_edges FROM edge e JOIN art a ON a.id = e.source_artifact_id GROUP BY ALL")


def _named_edges(t):
    named = once(t.artifacts).select("id", F.trim("qualified_name").alias("q"))
    rows = once(t.edges).select("snapshot_id", "source_artifact_id", "target_artifact_id", "relationship_type")
    outside = once(t.external_nodes).select("id", F.col("qualified_name").alias("q"))
    ends = named.unionByName(outside)
    rows = rows.join(named.select(F.col("id").alias("source_artifact_id"), F.col("q").alias("s")), "source_artifact_id").join(ends.select(F.col("id").alias("target_artifact_id"), F.col("q").alias("d")), "target_artifact_id")
    return rows.select("snapshot_id", "s", "d", F.col("relationship_type").alias("rel")).distinct()


def _edge_changes(t):
    """JN-06: edges (by the names of their ends) added and removed between consecutive snapshots."""
    from graphloom.operators.snapshot_changes import snapshot_pairs

    pairs = snapshot_pairs(t.snapshots)
    roles = pairs.select(F.col("snapshot_id").alias("pair"), F.explode(F.array(F.struct(F.col("snapshot_id").alias("sid"), F.lit(1).alias("now")), F.struct(F.col("previous_id").alias("sid"), F.lit(0).alias("now")))).alias("r")).select("pair", F.col("r.sid").alias("snapshot_id"), "r.now")
    sides = _named_edges(t).join(roles, "snapshot_id").groupBy("pair", "s", "d", "rel").agg(F.min("now").alias("low"), F.max("now").alias("high"))
    change = F.when(F.col("low") == 1, "added").when(F.col("high") == 0, "removed")
    return sides.select("pair", "s", "d", "rel", change.alias("change")).where("change is not null").groupBy("pair", "rel", "change").agg(F.count(F.lit(1)).alias("n_edges"))


add(
    "jn06_edge_changes",
    _edge_changes,
    "edge art node pair",
    """named AS (SELECT DISTINCT e.snapshot_id, trim(a.qualified_name) AS s, CASE WHEN n.snapshot_id IS NULL THEN n.qualified_name ELSE trim(n.qualified_name) END AS d, relationship_type AS rel FROM edge e JOIN art a ON a.id = e.source_artifact_id JOIN node n ON n.id = e.target_artifact_id),
    diff AS (SELECT p.id AS pair, x.s, x.d, x.rel, 'added' AS change FROM pair p JOIN named x ON x.snapshot_id = p.id WHERE NOT EXISTS (SELECT 1 FROM named y WHERE y.snapshot_id = p.prev AND y.s = x.s AND y.d = x.d AND y.rel = x.rel)
      UNION ALL SELECT p.id, x.s, x.d, x.rel, 'removed' FROM pair p JOIN named x ON x.snapshot_id = p.prev WHERE NOT EXISTS (SELECT 1 FROM named y WHERE y.snapshot_id = p.id AND y.s = x.s AND y.d = x.d AND y.rel = x.rel))
    +++ SELECT pair, rel, change, count(*) AS n_edges FROM diff GROUP BY ALL""",
)
add(
    "jn07_symbols_at_lines",
    lambda t: lookup.symbols_at(once(t.edges).where("source_location is not null").select("snapshot_id", path_of("source_location").alias("file"), F.expr("try_cast(element_at(split(source_location, ':'), -1) as int)").alias("first_line")).where("first_line is not null").withColumn("last_line", F.col("first_line") + 5).distinct(), t.artifacts),
    "edge art",
    f"""hunk AS (SELECT DISTINCT snapshot_id, split_part(replace(source_location, '\\', '/'), ':', 1) AS file, try_cast(split_part(source_location, ':', -1) AS INT) AS low FROM edge WHERE source_location IS NOT NULL)
    +++ SELECT DISTINCT h.snapshot_id, h.file, a.id AS artifact_id FROM hunk h JOIN art a ON a.snapshot_id = h.snapshot_id AND {_FILE} = h.file AND a.line_start <= h.low + 5 AND coalesce(a.line_end, a.line_start) >= h.low""",
)
add("jn08_events_of_artifacts", lambda t: t.runtime_events.select("event_id", F.col("component_artifact_id").alias("id")).distinct().join(once(t.artifacts).where("artifact_type = 'CLASS'").select("id"), "id", "left_semi"), "art", "+++ SELECT DISTINCT event_id, component_artifact_id AS id FROM runtime_events WHERE component_artifact_id IN (SELECT id FROM art WHERE artifact_type = 'CLASS')")
add("jn13_commits", lambda t: lookup.commit_overview(t.snapshots, t.runtime_events), "snap", "s AS (SELECT substr(commit_hash, 1, 7) AS c, count(*) AS n FROM snap GROUP BY 1), e AS (SELECT substr(commit_sha, 1, 7) AS c, count(DISTINCT event_id) AS n FROM runtime_events WHERE commit_sha IS NOT NULL GROUP BY 1) +++ SELECT coalesce(s.c, e.c) AS commit, coalesce(s.n, 0) AS n_snapshots, coalesce(e.n, 0) AS n_events FROM s FULL JOIN e ON e.c = s.c")
add("jn14_observed", lambda t: lookup.observed_artifacts(t.artifacts, t.runtime_events), "art", "+++ SELECT id, snapshot_id FROM art WHERE id IN (SELECT component_artifact_id FROM runtime_events WHERE component_artifact_id IS NOT NULL) OR lower(name) IN (SELECT lower(component_name) FROM runtime_events WHERE component_name IS NOT NULL)")
add("jn15_untested", lambda t: lookup.untested(t.artifacts, t.edges, ["FUNCTION", "METHOD", "CLASS"]), "art edge", "+++ SELECT id, snapshot_id, qualified_name FROM art WHERE artifact_type IN ('FUNCTION', 'METHOD', 'CLASS') AND id NOT IN (SELECT target_artifact_id FROM edge WHERE upper(relationship_type) = 'TESTS' AND target_artifact_id IS NOT NULL)")
add("jn16_mutual_edges", lambda t: lookup.mutual_edges(t.edges), "edge", "+++ SELECT DISTINCT x.snapshot_id, x.source_artifact_id AS a, x.target_artifact_id AS b FROM edge x JOIN edge y ON y.snapshot_id = x.snapshot_id AND y.source_artifact_id = x.target_artifact_id AND y.target_artifact_id = x.source_artifact_id WHERE x.source_artifact_id < x.target_artifact_id")
add("jn19_test_catalog", lambda t: lookup.test_catalog(t.artifacts, t.edges, node_table(t)), "art edge node", "u AS (SELECT DISTINCT e.source_artifact_id AS tid, n.qualified_name AS q FROM edge e JOIN node n ON n.id = e.target_artifact_id WHERE upper(relationship_type) IN ('TESTS', 'CALLS', 'IMPORTS')) +++ SELECT a.id AS test_id, a.snapshot_id, a.qualified_name AS test_name, coalesce(string_agg(u.q, ',' ORDER BY u.q), '') AS targets FROM art a LEFT JOIN u ON u.tid = a.id WHERE a.artifact_type = 'TEST_CASE' GROUP BY ALL")
QUERIES, SQL = CATALOG.queries, CATALOG.sql
