"""Composed operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import composites
from graphloom.operators.graph import once
from graphloom.operators.snapshot_changes import snapshot_pairs
from graphloom.plans.catalog import Catalog
from graphloom.plans.conformance_queries import _USES, _drift
from graphloom.plans.impact_queries import _CHANGES, _DEGREES, _REVERSED, _ROOTS, _reach_sql, _selection, changes, node_table
from graphloom.plans.impact_queries import SQL as IMPACT_SQL
from graphloom.plans.view_queries import SQL as VIEW_SQL
from graphloom.plans.view_queries import _processes

CATALOG = Catalog()
add = CATALOG.add
_FILE = "split_part(replace(location, '\\', '/'), ':', 1)"
_STEPS = f"WITH st AS ({VIEW_SQL['prc02_process_steps']}) "

add("trv08_blast_nodes", lambda t: composites.blast_nodes(changes(t).select("graph", F.col("artifact_id").alias("root")), t.edges), "art edge pair", _CHANGES + _REVERSED + _reach_sql(_ROOTS, 4) + "+++ SELECT graph, root, node, depth, greatest(0.6::DOUBLE, 1 - 0.12::DOUBLE * (depth - 1)) AS confidence FROM reach WHERE depth > 0")
add("jn02_processes_of_incidents", lambda t: composites.processes_through(_processes(t), once(t.incidents).select(F.col("snapshot_id").alias("graph"), F.col("affected_component_id").alias("node"))), "", _STEPS + "SELECT graph, root, node, min(step) AS step FROM st WHERE EXISTS (SELECT 1 FROM incidents i WHERE i.snapshot_id = st.graph AND i.affected_component_id = st.node) GROUP BY ALL")
add("msc12_process_lists", lambda t: composites.process_lists(_processes(t)), "", _STEPS + "SELECT graph, root, count(*) AS steps, string_agg(node, '>' ORDER BY step) AS nodes FROM st GROUP BY ALL")
add("jn12_flagged_edges", lambda t: composites.flagged_edges(t.edges, node_table(t), _drift(t)), "edge node", _USES + """, m AS (SELECT DISTINCT snapshot_id, source_name, target_name FROM drift)
  +++ SELECT e.snapshot_id, relationship_type, count(*) AS edges, count(m.snapshot_id) AS flagged FROM edge e JOIN lay s ON s.id = e.source_artifact_id JOIN lay d ON d.id = e.target_artifact_id LEFT JOIN m ON m.snapshot_id = e.snapshot_id AND m.source_name = s.q AND m.target_name = d.q GROUP BY ALL""")
add("agg16_glance", lambda t: composites.glance(t.artifacts, t.edges), "art edge", _DEGREES + r""", p AS (SELECT a.snapshot_id, a.name, coalesce(edges_in + edges_out, 0)::BIGINT AS degree, CASE WHEN artifact_type IN ('SQL_TABLE', 'SQL_VIEW', 'DATABASE_ENTITY') OR regexp_matches(lower(coalesce(location, '')), 'store|database|/db') THEN 'storage'
  WHEN artifact_type = 'API_ENDPOINT' OR regexp_matches(lower(coalesce(location, '')), '/api/|route|controller|gateway') THEN 'api' WHEN regexp_matches(lower(coalesce(location, '')), '\.(tsx|jsx|vue)(:|$)') THEN 'frontend' WHEN artifact_type IN ('CLASS', 'INTERFACE', 'SERVICE') THEN 'service' END AS part FROM art a LEFT JOIN deg d ON d.snapshot_id = a.snapshot_id AND d.id = a.id),
  g AS (SELECT snapshot_id, part, name, max(degree) AS degree FROM p WHERE part IS NOT NULL GROUP BY ALL) +++ SELECT *, (row_number() OVER (PARTITION BY snapshot_id, part ORDER BY degree DESC, name))::INT AS rank FROM g QUALIFY rank <= 6""")
add("agg24_completeness", lambda t: composites.completeness(t.artifacts), "art", f"f AS (SELECT snapshot_id, {_FILE} AS file, max(CASE WHEN language <> '' THEN 1 ELSE 0 END) AS known FROM art GROUP BY ALL), s AS (SELECT snapshot_id, count(*) AS files, sum(known)::BIGINT AS analysed FROM f GROUP BY 1), r AS (SELECT *, 100 * analysed / files AS share FROM s) +++ SELECT *, CASE WHEN share >= 95 THEN 'COMPLETE' WHEN share >= 50 THEN 'PARTIAL' ELSE 'LIMITED' END AS status FROM r")
add("rsk11_confidence", lambda t: composites.confidence(snapshot_pairs(t.snapshots), _selection(t), t.runtime_events), "pair", f"sel AS ({IMPACT_SQL['tst09_test_selection']}), c AS (SELECT p.id AS pair, round(greatest(0.1::DOUBLE, 1.0::DOUBLE - CASE WHEN coalesce(to_run + to_skip, 0) = 0 THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN p.id NOT IN (SELECT snapshot_id FROM runtime_events WHERE snapshot_id IS NOT NULL) THEN 0.2::DOUBLE ELSE 0 END), 6) AS confidence FROM pair p LEFT JOIN sel ON sel.pair = p.id) +++ SELECT *, CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c")


def _outage(t):
    gone = once(t.incidents).select("snapshot_id", F.col("affected_component_id").alias("id")).where("id is not null and snapshot_id is not null").distinct()
    return composites.simulated_outage(t.artifacts, t.edges, node_table(t), gone)


add(
    "sim08_simulated_outage",
    _outage,
    "art edge node inc",
    "gone AS (SELECT DISTINCT snapshot_id, affected_component_id AS id FROM inc WHERE affected_component_id IS NOT NULL AND snapshot_id IS NOT NULL), " + _REVERSED + " " + _reach_sql("SELECT snapshot_id AS graph, id AS root FROM gone", 4)
    + """, k AS (SELECT r.graph, r.root, r.depth, upper(artifact_type) = 'API_ENDPOINT' OR contains(lower(coalesce(location, '')), 'route') AS api, contains(upper(artifact_type), 'TEST') OR contains(lower(coalesce(location, '')), 'test') AS test FROM reach r JOIN node n ON n.id = r.node),
    c AS (SELECT graph, root, count(*) FILTER (depth > 0 AND NOT api AND NOT test) AS components, count(*) FILTER (depth > 0 AND api) AS apis, count(*) FILTER (depth > 0 AND test AND NOT api) AS tests FROM k GROUP BY ALL), s AS (SELECT *, least(100, 8 * components + 20 * apis + 5 * tests) AS score FROM c),
    ln AS (SELECT snapshot_id, count(*) AS n FROM art a WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.snapshot_id = a.snapshot_id AND g.id = a.id) GROUP BY 1), le AS (SELECT snapshot_id, count(*) AS n FROM edge e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.snapshot_id = e.snapshot_id AND g.id IN (e.source_artifact_id, e.target_artifact_id)) GROUP BY 1)
    +++ SELECT s.graph, s.root, components, apis, tests, score, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk, coalesce(ln.n, 0) AS nodes_left, coalesce(le.n, 0) AS edges_left FROM s LEFT JOIN ln ON ln.snapshot_id = s.graph LEFT JOIN le ON le.snapshot_id = s.graph""",
)
add("set02_common_symbols", lambda t: composites.common_symbols(snapshot_pairs(t.snapshots), t.artifacts), "art pair", "n AS (SELECT DISTINCT snapshot_id AS s, trim(qualified_name) AS q FROM art WHERE qualified_name IS NOT NULL), x AS (SELECT p.id AS pair, q, bool_or(s = p.id) AS a, bool_or(s = p.prev) AS b FROM pair p JOIN n ON s IN (p.id, p.prev) GROUP BY ALL) +++ SELECT pair, count(*) FILTER (a AND b) AS \"both\", count(*) FILTER (a AND NOT b) AS later, count(*) FILTER (b AND NOT a) AS earlier FROM x GROUP BY 1")
QUERIES, SQL = CATALOG.queries, CATALOG.sql
