"""Architecture conformance over all snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import conformance
from graphloom.operators.snapshot_changes import snapshot_pairs
from graphloom.plans.catalog import Catalog
from graphloom.plans.impact_queries import _DEGREES, node_table
from graphloom.plans.sample_baseline import ROLES, sample_baseline

CATALOG = Catalog()
add = CATALOG.add


def _drift(t):
    return conformance.full_drift(t.edges, node_table(t), sample_baseline(t._spark))


def _values(rows, columns):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows) + f") AS v({columns})"


_MODULES = _values([(m, n) for n, v in ROLES["layers"].items() for m in v["modules"]], "prefix, layer")
_POLICY = _values([(n, o, "HIGH" if o in v["forbidden"] else "MEDIUM") for n, v in ROLES["layers"].items() for o in ROLES["layers"] if o in v["forbidden"] or v["allowed"] and o != n and o not in v["allowed"]], "a, b, severity")
_IMPORTS = _values([(n, p) for n, ps in ROLES["forbidden_imports"].items() for p in ps], "layer, prefix")
_LINKS = ", ".join(f"'{k}'" for k in conformance.LINKS)
#: Every simple cycle, each once from its smallest id on: paths within cyclic components that pass larger ids only.
_CYCLES = f"""(WITH RECURSIVE l AS (SELECT DISTINCT snapshot_id AS graph, source_artifact_id AS src, target_artifact_id AS dst FROM edges WHERE upper(relationship_type) IN ({_LINKS}) AND source_artifact_id <> target_artifact_id),
  ahead AS (SELECT graph, src, dst FROM l UNION SELECT a.graph, a.src, l.dst FROM ahead a JOIN l ON l.graph = a.graph AND l.src = a.dst),
  ring AS (SELECT l.* FROM l JOIN ahead a ON a.graph = l.graph AND a.src = l.dst AND a.dst = l.src),
  p AS (SELECT graph, src AS head, dst AS tail, [src, dst] AS path FROM ring WHERE dst > src UNION ALL SELECT p.graph, head, r.dst, list_append(path, r.dst) FROM p JOIN ring r ON r.graph = p.graph AND r.src = p.tail WHERE r.dst > head AND NOT list_contains(path, r.dst))
  SELECT p.graph, p.path[1] AS a, p.path[2] AS b FROM p JOIN ring r ON r.graph = p.graph AND r.src = p.tail AND r.dst = p.head)"""
_USES = f"""lay AS (SELECT n.id, trim(n.qualified_name) AS q, (SELECT v.layer FROM {_MODULES} WHERE regexp_replace(replace(trim(n.qualified_name), '/', '.'), '^(backend\\.|src\\.|services\\.)', '') = v.prefix OR starts_with(regexp_replace(replace(trim(n.qualified_name), '/', '.'), '^(backend\\.|src\\.|services\\.)', ''), v.prefix || '.') ORDER BY length(v.prefix) DESC LIMIT 1) AS layer FROM node n),
uses AS (SELECT e.snapshot_id, s.q AS source_name, d.q AS target_name, s.layer AS a, d.layer AS b FROM edge e JOIN lay s ON s.id = e.source_artifact_id JOIN lay d ON d.id = e.target_artifact_id WHERE upper(relationship_type) IN ('IMPORTS', 'CALLS', 'DEPENDS_ON')),
drift AS (SELECT * FROM (SELECT DISTINCT snapshot_id, 'LAYER_BOUNDARY' AS category, v.severity, source_name, target_name FROM uses u JOIN {_POLICY} ON v.a = u.a AND v.b = u.b
  UNION SELECT DISTINCT snapshot_id, 'FORBIDDEN_IMPORT', 'HIGH', source_name, target_name FROM uses u JOIN {_IMPORTS} ON v.layer = u.a AND (u.target_name = v.prefix OR starts_with(u.target_name, v.prefix || '.')))
  UNION ALL SELECT c.graph, 'CIRCULAR_DEPENDENCY', 'CRITICAL', s.q, d.q FROM {_CYCLES} c JOIN lay s ON s.id = c.a JOIN lay d ON d.id = c.b)"""

add("arc01_drift", _drift, "edge node", _USES + "+++ SELECT * FROM drift")
add("agg21_conformance", lambda t: conformance.conformance(t.edges, node_table(t), _drift(t), sample_baseline(t._spark)), "edge node", _USES + """, n AS (SELECT snapshot_id, count(*) AS uses FROM edge WHERE upper(relationship_type) IN ('IMPORTS', 'CALLS', 'DEPENDS_ON') AND source_artifact_id IN (SELECT id FROM node) GROUP BY 1), b AS (SELECT snapshot_id, count(*) AS violations FROM drift GROUP BY 1)
  +++ SELECT n.snapshot_id, uses, coalesce(violations, 0) AS violations, greatest(0::DOUBLE, 100 - 100 * coalesce(violations, 0) / greatest(uses, 15)) AS conformance FROM n LEFT JOIN b USING (snapshot_id)""")
add("dif07_drift_changes", lambda t: conformance.drift_changes(_drift(t), snapshot_pairs(t.snapshots)), "edge node pair", _USES + """, k AS (SELECT p.id AS pair, category, source_name, target_name, bool_or(d.snapshot_id = p.id) AS a, bool_or(d.snapshot_id = p.prev) AS b FROM pair p JOIN drift d ON d.snapshot_id IN (p.id, p.prev) GROUP BY ALL)
  +++ SELECT pair, category, CASE WHEN a AND b THEN 'persistent' WHEN a THEN 'new' ELSE 'resolved' END AS state, count(*) AS n FROM k GROUP BY ALL""")
add("arc05_boundaries", lambda t: conformance.boundary_evidence(_drift(t), conformance.layered_uses(t.edges, node_table(t), sample_baseline(t._spark))), "edge node", _USES + """, e AS (SELECT DISTINCT d.snapshot_id, u.a AS source_layer, u.b AS target_layer, d.source_name || ' -> ' || d.target_name AS e FROM drift d JOIN uses u ON u.snapshot_id = d.snapshot_id AND u.source_name = d.source_name AND u.target_name = d.target_name WHERE category = 'LAYER_BOUNDARY'),
  r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, source_layer, target_layer ORDER BY e) AS k FROM e) +++ SELECT snapshot_id, source_layer, target_layer, count(*) AS n, string_agg(e, ', ' ORDER BY e) FILTER (k <= 10) AS evidence FROM r GROUP BY ALL""")
add("arc07_test_debt", lambda t: conformance.test_debt(t.artifacts, t.edges), "art edge", """tested AS (SELECT DISTINCT target_artifact_id AS id FROM edge WHERE upper(relationship_type) IN ('TESTS', 'TESTED_BY', 'COVERS')),
  s AS (SELECT snapshot_id, count(*) FILTER (artifact_type = 'TEST_CASE') AS tests, count(*) FILTER (artifact_type IN ('MODULE', 'CLASS')) AS modules, count(*) FILTER (artifact_type IN ('MODULE', 'CLASS') AND x.id IS NULL) AS untested FROM art a LEFT JOIN tested x ON x.id = a.id GROUP BY 1), r AS (SELECT *, tests / greatest(modules, 1) AS ratio FROM s)
  +++ SELECT *, CASE WHEN ratio < 0.05 THEN 'VIOLATION' WHEN ratio < 0.2 OR untested > 5 THEN 'WARN' ELSE 'PASS' END AS verdict FROM r""")
add("arc08_inversions", lambda t: conformance.inversions(t.edges, node_table(t)), "edge node", "+++ SELECT DISTINCT e.snapshot_id, s.qualified_name AS source_name, d.qualified_name AS target_name FROM edge e JOIN node s ON s.id = e.source_artifact_id JOIN node d ON d.id = e.target_artifact_id WHERE upper(relationship_type) IN ('IMPORTS', 'CALLS') AND regexp_matches(lower(coalesce(nullif(s.location, ''), s.qualified_name, '')), 'model|entities|database|db|schema') AND regexp_matches(lower(coalesce(nullif(d.location, ''), d.qualified_name, '')), 'controller|router|route|view|api')")
add("arc09_assessment", lambda t: conformance.assessment(t.artifacts, t.edges), "art edge", _DEGREES + """, c AS (SELECT snapshot_id, count(*) AS cycles FROM (SELECT DISTINCT x.snapshot_id, x.source_artifact_id AS a, x.target_artifact_id AS b FROM edge x JOIN edge y ON y.snapshot_id = x.snapshot_id AND y.source_artifact_id = x.target_artifact_id AND y.target_artifact_id = x.source_artifact_id WHERE x.source_artifact_id < x.target_artifact_id) GROUP BY 1),
  h AS (SELECT snapshot_id, count(*) AS hubs FROM deg WHERE (edges_out >= 12 OR (edges_in >= 15 AND edges_out >= 8)) AND id IN (SELECT id FROM art) GROUP BY 1),
  o AS (SELECT snapshot_id, count(*) AS orphans FROM art WHERE artifact_type = 'API_ENDPOINT' AND id NOT IN (SELECT id FROM deg WHERE edges_in > 0) GROUP BY 1),
  x AS (SELECT snapshot_id, count(DISTINCT target_artifact_id) AS tested FROM edge WHERE upper(relationship_type) = 'TESTS' GROUP BY 1),
  b AS (SELECT snapshot_id, count(*) FILTER (artifact_type = 'API_ENDPOINT') AS endpoints, count(*) FILTER (artifact_type IN ('SERVICE', 'CONTROLLER', 'COMPONENT', 'CLASS')) AS core, count(*) FILTER (artifact_type = 'TEST_CASE') AS tests FROM art GROUP BY 1),
  w AS (SELECT b.*, coalesce(cycles, 0) AS cycles, coalesce(hubs, 0) AS hubs, coalesce(orphans, 0) AS orphans, coalesce(tested, 0) AS tested FROM b LEFT JOIN c USING (snapshot_id) LEFT JOIN h USING (snapshot_id) LEFT JOIN o USING (snapshot_id) LEFT JOIN x USING (snapshot_id))
  +++ SELECT snapshot_id, 'architecture' AS dimension, greatest(100.0 - 15 * cycles, 30)::DOUBLE AS score FROM w UNION ALL SELECT snapshot_id, 'coupling', greatest(100.0 - 12 * hubs, 40)::DOUBLE FROM w
  UNION ALL SELECT snapshot_id, 'interface', (CASE WHEN endpoints = 0 THEN 70 ELSE greatest(100.0 - 5 * orphans, 60) END)::DOUBLE FROM w UNION ALL SELECT snapshot_id, 'testing', CASE WHEN tests = 0 THEN 0::DOUBLE WHEN core = 0 THEN 50::DOUBLE ELSE least(100.0::DOUBLE * tested / core, 100::DOUBLE) END FROM w""")
add("flt18_layers_by_prefix", lambda t: conformance.longest_prefix(node_table(t).select("id", F.trim("qualified_name").alias("q")), "q", sample_baseline(t._spark).modules, "layer").select("id", "layer"), "edge node", _USES.split("uses AS")[0].rstrip().rstrip(",") + "+++ SELECT id, layer FROM lay")
QUERIES, SQL = CATALOG.queries, CATALOG.sql
