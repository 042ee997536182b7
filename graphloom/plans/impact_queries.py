"""Change sets, traversals and test selection over all snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.graph import IMPACT_RULES, TEST_RULES
from graphloom.operators import impact, traversal
from graphloom.operators.graph import adjacency, degrees, edges_with_ends, nodes, once, placeholder_map
from graphloom.operators.snapshot_changes import snapshot_pairs
from graphloom.plans.catalog import VIEWS, Catalog, Tables
from graphloom.session import checkpointed

CATALOG = Catalog()


def changes(t: Tables) -> DataFrame:
    return checkpointed(impact.change_set(t.snapshots, t.artifacts))


def node_table(t: Tables) -> DataFrame:
    return nodes(t.artifacts, t.external_nodes)


def findings(t: Tables, changed: DataFrame | None = None) -> DataFrame:
    return impact.impact_findings(changed if changed is not None else changes(t), t.edges, placeholder_map(t.artifacts, t.external_nodes))


_FILE = "split_part(replace({}, '\\', '/'), ':', 1)"
_CHANGES = f"""
sym AS (SELECT snapshot_id AS sid, trim(qualified_name) AS q, id, artifact_type, coalesce(signature, '') AS sig, line_start, line_end, nullif(source_hash, '') AS h, {_FILE.format('location')} AS file
  FROM art WHERE artifact_type <> 'EXTERNAL_DEPENDENCY' QUALIFY row_number() OVER (PARTITION BY snapshot_id, trim(qualified_name) ORDER BY id DESC) = 1),
ch AS (
  SELECT p.id AS pair, p.prev AS previous_id, a.q AS qualified_name, CASE WHEN b.id IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS change_type, a.id AS artifact_id, p.id AS graph, a.artifact_type, a.file AS source_file,
    CASE WHEN b.id IS NULL THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS confidence
  FROM pair p JOIN sym a ON a.sid = p.id LEFT JOIN sym b ON b.sid = p.prev AND b.q = a.q
  WHERE b.id IS NULL OR coalesce(a.h <> b.h, false) OR a.sig <> b.sig OR a.line_start IS DISTINCT FROM b.line_start OR a.line_end IS DISTINCT FROM b.line_end
  UNION ALL
  SELECT p.id, p.prev, b.q, 'REMOVED', b.id, p.prev, b.artifact_type, b.file, 1.0::DOUBLE FROM pair p JOIN sym b ON b.sid = p.prev WHERE NOT EXISTS (SELECT 1 FROM sym a WHERE a.sid = p.id AND a.q = b.q)),
"""


def _rule_sql(rules: dict) -> str:
    return "(VALUES " + ", ".join(f"('{n}', '{w}', {f}::DOUBLE)" for n, (w, f, on) in rules.items() if on) + ") AS rule(rel, way, factor)"


def _adjacency_sql(rules: dict) -> str:
    return f"""
adj AS (SELECT graph, src, dst, rel, max(weight) AS weight FROM (
  SELECT e.snapshot_id AS graph, CASE way WHEN 'forward' THEN source_artifact_id ELSE target_artifact_id END AS src, CASE way WHEN 'forward' THEN target_artifact_id ELSE source_artifact_id END AS dst,
    rule.rel, coalesce(confidence, 1.0) * factor AS weight FROM edge e JOIN {_rule_sql(rules)} ON rule.rel = upper(e.relationship_type) WHERE source_artifact_id <> target_artifact_id) GROUP BY ALL),
"""


def _reach_sql(roots: str, depth: int, adj: str = "adj") -> str:
    """Level by level; the smallest path per (graph, root, node), nodes of earlier levels left out."""
    parts = [f"r0 AS (SELECT DISTINCT graph, root, root AS node, 0 AS depth, [root] AS path, NULL::VARCHAR AS rel, 1.0::DOUBLE AS confidence FROM ({roots}))"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT graph, root, node FROM r{k}" for k in range(d))
        parts.append(f"""r{d} AS (SELECT graph, root, node, {d} AS depth, b.path AS path, b.rel AS rel, b.confidence AS confidence FROM (
          SELECT f.graph, f.root, a.dst AS node, min({{'path': list_append(f.path, a.dst), 'rel': a.rel, 'confidence': round(CAST(f.confidence * a.weight AS DECIMAL(18,12)), 4)::DOUBLE}}) AS b FROM r{d - 1} f JOIN {adj} a ON a.graph = f.graph AND a.src = f.node GROUP BY ALL) c
          WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.graph = c.graph AND s.root = c.root AND s.node = c.node))""")
    union = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(depth + 1))
    return ", ".join(parts) + f", reach AS ({union})"


_ROOTS = "SELECT graph, artifact_id AS root FROM ch"


def _class_sql(table: dict) -> str:
    tests = lambda c, parts: [f"contains(lower(coalesce({c}, '')), '{p}')" for p in parts]
    return "CASE " + " ".join(f"WHEN {' OR '.join(tests('artifact_type', kinds) + tests('name_', names))} THEN '{k}'" for k, (kinds, names) in table.items()) + " ELSE 'COMPONENT' END"


_NAMED = "named AS (SELECT id, artifact_type, coalesce(nullif(trim(qualified_name), ''), id) AS name_ FROM node)"
_IMPACT = _CHANGES + _adjacency_sql(IMPACT_RULES) + _reach_sql(_ROOTS, 5)
_PATHS = _IMPACT + f", {_NAMED}, found AS (SELECT r.graph, r.root, r.node, coalesce({_class_sql(impact.TERMINALS)}, 'COMPONENT') AS terminal, r.depth, array_to_string(r.path, ' > ') AS path, r.confidence FROM reach r LEFT JOIN named n ON n.id = r.node WHERE r.depth > 0)"
_IS_TEST = "(upper(artifact_type) IN ('TEST_CASE','TEST_SUITE') OR ((contains(lower(location), '/test') OR starts_with(lower(location), 'test')) AND (starts_with(name, 'test_') OR ends_with(name, 'Test') OR ends_with(name, 'Tests'))))"
_AFFECTED = _CHANGES + _adjacency_sql(TEST_RULES) + _reach_sql(_ROOTS, 6) + f""",
hit AS (SELECT c.pair, r.node, n.qualified_name AS test_name, min({{'depth': r.depth, 'path': array_to_string(r.path, '>'), 'rel': r.rel}}) AS b
  FROM reach r JOIN node n ON n.id = r.node AND {_IS_TEST} JOIN ch c ON c.graph = r.graph AND c.artifact_id = r.root GROUP BY ALL),
affected AS (SELECT pair, node AS test_id, test_name, b.depth AS depth, CASE WHEN b.depth <= 1 THEN 'DIRECT' ELSE 'INDIRECT' END AS impact, CASE WHEN b.depth = 1 AND b.rel = 'TESTS' THEN 'OBSERVED' ELSE 'INFERRED' END AS provenance,
  greatest(0.6::DOUBLE, 1 - 0.1::DOUBLE * (greatest(b.depth, 1) - 1)) AS confidence FROM hit),
unaffected AS (SELECT a.snapshot_id AS pair, a.id AS test_id, a.qualified_name AS test_name FROM art a JOIN pair p ON p.id = a.snapshot_id WHERE {_IS_TEST} AND a.id IN (SELECT source_artifact_id FROM edge WHERE upper(relationship_type) = 'TESTS')
  AND NOT EXISTS (SELECT 1 FROM affected f WHERE f.pair = a.snapshot_id AND f.test_id = a.id))"""

add = CATALOG.add
add("dif01_change_set", lambda t: impact.change_set(t.snapshots, t.artifacts), "art pair", _CHANGES.rstrip(", \n") + "+++ SELECT * FROM ch")
add("dif03_change_summary", lambda t: impact.change_summary(impact.change_set(t.snapshots, t.artifacts)), "art pair", _CHANGES + "+++ SELECT pair, count(*) FILTER (change_type = 'ADDED') AS added, count(*) FILTER (change_type = 'REMOVED') AS removed, count(*) FILTER (change_type = 'MODIFIED') AS modified, count(DISTINCT source_file) AS files FROM ch GROUP BY pair")
add(
    "dif06_mutations",
    lambda t: impact.mutations_of(impact.change_set(t.snapshots, t.artifacts)),
    "art pair",
    _CHANGES + """+++ SELECT pair, qualified_name AS target, CASE WHEN change_type = 'REMOVED' THEN 'REMOVE_COMPONENT' WHEN artifact_type = 'API_ENDPOINT' THEN 'MODIFY_API'
      WHEN artifact_type IN ('DATABASE_ENTITY','DATABASE_TABLE','SQL_TABLE','SQL_VIEW') THEN 'SCHEMA_MIGRATION' ELSE 'MODIFY_SYMBOL' END AS mutation_type FROM ch QUALIFY row_number() OVER (PARTITION BY pair, qualified_name ORDER BY change_type, artifact_id) = 1""",
)
add("flt15_placeholders", lambda t: placeholder_map(t.artifacts, t.external_nodes))
add(
    "trv01_impact_findings",
    lambda t: impact.named_findings(findings(t), node_table(t)).withColumn("path", F.array_join("path", ">")),
    "art edge node pair",
    _IMPACT + f""", {_NAMED}, f AS (SELECT r.graph, coalesce(a.name_, r.root) AS root_name, coalesce(b.name_, r.node) AS affected_name, rel, min({{'depth': depth, 'root': root, 'node': node, 'path': path, 'confidence': confidence}}) AS f, bool_and(b.id IS NOT NULL) AS known
        FROM reach r LEFT JOIN named a ON a.id = r.root LEFT JOIN named b ON b.id = r.node WHERE depth > 0 GROUP BY ALL)
      +++ SELECT graph, root_name, affected_name, rel, f.depth AS depth, f.root AS root, f.node AS node, array_to_string(f.path, '>') AS path, f.confidence AS confidence, CASE WHEN f.depth = 1 THEN 'DIRECT' ELSE 'PROVEN_TRANSITIVE' END AS classification,
        CASE WHEN bool_and(known) OVER (PARTITION BY graph) THEN 'COMPLETE' ELSE 'PARTIAL' END AS completeness FROM f""",
)
add("trv04_impact_paths", lambda t: impact.impact_paths(findings(t), node_table(t)), "art edge node pair", _PATHS + "+++ SELECT * FROM found")


def _summary(t: Tables) -> DataFrame:
    changed = changes(t)
    return impact.impact_summary(changed, findings(t, changed), node_table(t))


add(
    "trv05_impact_summary",
    _summary,
    "art edge node pair",
    _IMPACT + f""", {_NAMED}, near AS (SELECT c.pair, r.node, min(r.depth) AS near, max(r.depth) AS far FROM reach r JOIN ch c ON c.graph = r.graph AND c.artifact_id = r.root WHERE r.depth > 0 GROUP BY 1, 2),
      cls AS (SELECT pair, coalesce(name_, node) AS name_, near, far, CASE WHEN n.id IS NULL THEN 'COMPONENT' ELSE {_class_sql(impact.CLASSES)} END AS class FROM near LEFT JOIN named n ON n.id = node),
      byname AS (SELECT pair, name_, min(near) AS near, max(far) AS far, {', '.join(f"bool_or(class = '{k}') AS is_{k.lower()}" for k in impact.CLASSES)}, bool_or(class IN ('COMPONENT', 'SERVICE')) AS is_component FROM cls GROUP BY 1, 2),
      sums AS (SELECT pair, count(*) FILTER (near = 1) AS direct, count(*) FILTER (far > 1) AS indirect, count(*) AS unique_affected, {', '.join(f"count(*) FILTER (is_{k}) AS n_{k}" for k in (*map(str.lower, impact.CLASSES), 'component'))}, max(far) AS max_depth FROM byname GROUP BY pair)
      +++ SELECT c.pair, count(*) AS changed, {', '.join(f"coalesce(any_value({k}), 0) AS {k}" for k in ('direct', 'indirect', 'unique_affected', *(f'n_{x}' for x in (*map(str.lower, impact.CLASSES), 'component')), 'max_depth'))} FROM ch c LEFT JOIN sums s ON s.pair = c.pair GROUP BY c.pair""",
)


def _blast(t: Tables) -> DataFrame:
    return impact.blast_radius(changes(t).select("graph", F.col("artifact_id").alias("root")), t.edges, node_table(t))


_REVERSED = "adj AS (SELECT snapshot_id AS graph, target_artifact_id AS src, source_artifact_id AS dst, min(upper(relationship_type)) AS rel, 1.0::DOUBLE AS weight FROM edge WHERE source_artifact_id <> target_artifact_id GROUP BY ALL),"
add(
    "trv07_blast_radius",
    _blast,
    "art edge node pair",
    _CHANGES + _REVERSED + _reach_sql(_ROOTS, 4) + """, kind AS (SELECT r.graph, r.root, r.depth, upper(artifact_type) = 'API_ENDPOINT' OR contains(lower(coalesce(location, '')), 'route') AS api, contains(upper(artifact_type), 'TEST') OR contains(lower(coalesce(location, '')), 'test') AS test
      FROM reach r JOIN node n ON n.id = r.node), counts AS (SELECT graph, root, count(*) FILTER (depth > 0 AND NOT api AND NOT test) AS components, count(*) FILTER (depth > 0 AND api) AS apis, count(*) FILTER (depth > 0 AND test AND NOT api) AS tests, max(depth) AS depth FROM kind GROUP BY ALL)
      +++ SELECT *, least(100, 8 * components + 20 * apis + 5 * tests) AS score, CASE WHEN 8 * components + 20 * apis + 5 * tests >= 75 THEN 'CRITICAL' WHEN 8 * components + 20 * apis + 5 * tests >= 50 THEN 'HIGH' WHEN 8 * components + 20 * apis + 5 * tests >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM counts""",
)


def _ego(t: Tables) -> DataFrame:
    focus = once(t.incidents).select(F.col("snapshot_id").alias("graph"), F.col("affected_component_id").alias("root"))
    return traversal.reach(focus, traversal.undirected(once(t.edges)), 2).select("graph", "root", "node", "depth")


add(
    "trv10_ego_network",
    _ego,
    "edge inc",
    "adj AS (SELECT DISTINCT graph, src, dst, 'LINK' AS rel, 1.0::DOUBLE AS weight FROM (SELECT snapshot_id AS graph, source_artifact_id AS src, target_artifact_id AS dst FROM edge UNION ALL SELECT snapshot_id, target_artifact_id, source_artifact_id FROM edge) WHERE src <> dst), "
    + _reach_sql("SELECT snapshot_id AS graph, affected_component_id AS root FROM inc WHERE affected_component_id IS NOT NULL AND snapshot_id IS NOT NULL", 2)
    + "+++ SELECT graph, root, node, depth FROM reach",
)


def _affected(t: Tables) -> DataFrame:
    return impact.affected_tests(changes(t), t.edges, node_table(t))


def _unaffected(t: Tables, affected: DataFrame) -> DataFrame:
    return impact.unaffected_tests(affected, snapshot_pairs(t.snapshots), t.artifacts, t.edges)


def _selection(t: Tables) -> DataFrame:
    affected = checkpointed(_affected(t))
    return impact.test_selection(affected, _unaffected(t, affected))


add("trv11_affected_tests", _affected, "art edge node pair", _AFFECTED + "+++ SELECT * FROM affected")
add("tst03_unaffected_tests", lambda t: _unaffected(t, _affected(t)), "art edge node pair", _AFFECTED + "+++ SELECT * FROM unaffected")
add(
    "tst09_test_selection",
    _selection,
    "art edge node pair",
    _AFFECTED + "+++ SELECT pair, count(*) FILTER (run) AS to_run, count(*) FILTER (direct) AS direct, count(*) FILTER (NOT run) AS to_skip, count(*) FILTER (NOT run) / count(*) AS skip_share FROM (SELECT pair, true AS run, impact = 'DIRECT' AS direct FROM affected UNION ALL SELECT pair, false, false FROM unaffected) GROUP BY pair",
)


def _chains(t: Tables) -> DataFrame:
    starts = once(t.artifacts).where("artifact_type = 'API_ENDPOINT'").select(F.col("snapshot_id").alias("graph"), F.col("id").alias("root"))
    found = traversal.reach(starts, traversal.forward_of(once(t.edges), ["CALLS", "EXPOSES", "CONSUMES", "PERSISTS_TO"]), 4)
    return found.select("graph", "root", "node", "depth", F.array_join("path", ">").alias("path"))


add(
    "trv13_process_chains",
    _chains,
    "art edge",
    "adj AS (SELECT snapshot_id AS graph, source_artifact_id AS src, target_artifact_id AS dst, min(upper(relationship_type)) AS rel, 1.0::DOUBLE AS weight FROM edge WHERE upper(relationship_type) IN ('CALLS','EXPOSES','CONSUMES','PERSISTS_TO') AND source_artifact_id <> target_artifact_id GROUP BY ALL), "
    + _reach_sql("SELECT snapshot_id AS graph, id AS root FROM art WHERE artifact_type = 'API_ENDPOINT'", 4)
    + "+++ SELECT graph, root, node, depth, array_to_string(path, '>') AS path FROM reach",
)


def _causal(t: Tables) -> DataFrame:
    hit = once(t.incidents).select(F.col("snapshot_id").alias("graph"), F.col("affected_component_id").alias("target"))
    pairs = impact.change_set(t.snapshots, t.artifacts).select("graph", F.col("artifact_id").alias("root")).join(hit.where("target is not null").distinct(), "graph")
    return traversal.causal_paths(checkpointed(pairs), traversal.all_forward(t.edges)).withColumn("path", F.array_join("path", ">"))


def _directed_sql(name: str, source: str, target: str) -> str:
    return f"{name} AS (SELECT DISTINCT snapshot_id AS graph, {source} AS src, {target} AS dst, 'LINK' AS rel, 1.0::DOUBLE AS weight FROM edge WHERE source_artifact_id <> target_artifact_id)"


def _renamed(sql: str, prefix: str) -> str:
    """The level views of a traversal under other names."""
    import re

    return re.sub(r"\br(\d)\b", rf"{prefix}\1", sql).replace("reach AS", f"{prefix}reach AS")


add(
    "trv15_causal_paths",
    _causal,
    "art edge inc pair",
    _CHANGES + _directed_sql("fwd", "source_artifact_id", "target_artifact_id") + ", " + _directed_sql("bwd", "target_artifact_id", "source_artifact_id") + """,
      want AS (SELECT DISTINCT c.graph, c.artifact_id AS root, i.affected_component_id AS target FROM ch c JOIN inc i ON i.snapshot_id = c.graph WHERE i.affected_component_id IS NOT NULL), """
    + _renamed(_reach_sql("SELECT DISTINCT graph, target AS root FROM want", 4, "bwd"), "u") + ", " + _renamed(_reach_sql("SELECT DISTINCT graph, target AS root FROM want", 4, "fwd"), "d")
    + """, both_ AS (SELECT graph, root AS target, node AS root, 0 AS way, depth, list_reverse(path) AS path FROM ureach UNION ALL SELECT graph, root, node, 1, depth, path FROM dreach),
      best AS (SELECT w.graph, w.root, w.target, min({'way': way, 'depth': depth, 'path': path}) AS b FROM want w JOIN both_ x ON x.graph = w.graph AND x.root = w.root AND x.target = w.target GROUP BY ALL)
      +++ SELECT graph, root, target, b.depth AS hops, array_to_string(b.path, '>') AS path, CASE WHEN b.depth = 0 THEN 0.95::DOUBLE ELSE greatest(0.5::DOUBLE, round(0.9::DOUBLE - 0.08::DOUBLE * b.depth, 2)) END AS confidence FROM best""",
)
_CYCLE = "links AS (SELECT DISTINCT snapshot_id AS graph, source_artifact_id AS src, target_artifact_id AS dst FROM edge WHERE upper(relationship_type) IN ('CALLS','IMPORTS','DEPENDS_ON','REFERENCES') AND source_artifact_id <> target_artifact_id)"
add(
    "trv16_cycles",
    lambda t: traversal.cycles(traversal.forward_of(once(t.edges), ["CALLS", "IMPORTS", "DEPENDS_ON", "REFERENCES"]), 4).withColumn("path", F.array_join("path", ">")),
    "edge",
    _CYCLE + """, c2 AS (SELECT a.graph, [a.src, a.dst] AS p FROM links a JOIN links b ON b.graph = a.graph AND b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst),
      c3 AS (SELECT a.graph, [a.src, a.dst, b.dst] AS p FROM links a JOIN links b ON b.graph = a.graph AND b.src = a.dst JOIN links c ON c.graph = a.graph AND c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst),
      c4 AS (SELECT a.graph, [a.src, a.dst, b.dst, c.dst] AS p FROM links a JOIN links b ON b.graph = a.graph AND b.src = a.dst JOIN links c ON c.graph = a.graph AND c.src = b.dst JOIN links d ON d.graph = a.graph AND d.src = c.dst AND d.dst = a.src
        WHERE a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND a.dst <> b.dst AND a.dst <> c.dst AND b.dst <> c.dst)
      +++ SELECT graph, len(p)::INT AS length, array_to_string(p, '>') AS path FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4)""",
)
add(
    "trv16_components",
    lambda t: traversal.components(traversal.plain_links(t.edges, ["CALLS", "IMPORTS", "DEPENDS_ON", "REFERENCES"])),
    "",
    f"WITH RECURSIVE {VIEWS['edge']}, {_CYCLE}" + """, ahead AS (SELECT graph, src, dst FROM links UNION SELECT a.graph, a.src, l.dst FROM ahead a JOIN links l ON l.graph = a.graph AND l.src = a.dst),
      own AS (SELECT a.graph, a.src AS node, min(a.dst) AS component FROM ahead a JOIN ahead b ON b.graph = a.graph AND b.src = a.dst AND b.dst = a.src GROUP BY ALL)
      SELECT graph, component, node, count(*) OVER (PARTITION BY graph, component) AS size FROM own""",
)
add("trv18_baselines", lambda t: impact.one_hop_baselines(changes(t), t.edges).groupBy("pair", "baseline").agg(F.count(F.lit(1)).alias("n_nodes")), "art edge pair", _CHANGES + """near AS (SELECT c.pair, e.source_artifact_id AS node, upper(e.relationship_type) AS rel FROM ch c JOIN edge e ON e.snapshot_id = c.graph AND e.target_artifact_id = c.artifact_id),
      base AS (SELECT 'changed' AS baseline, pair, artifact_id AS node FROM ch UNION SELECT 'imports', pair, artifact_id FROM ch UNION SELECT 'calls', pair, artifact_id FROM ch UNION SELECT 'imports', pair, node FROM near WHERE rel IN ('IMPORTS','DEPENDS_ON') UNION SELECT 'calls', pair, node FROM near WHERE rel IN ('IMPORTS','DEPENDS_ON','CALLS'))
      +++ SELECT pair, baseline, count(DISTINCT node) AS n_nodes FROM base GROUP BY ALL""")
_DEGREES = """deg AS (SELECT snapshot_id, id, sum(fi) AS fan_in, sum(fo) AS fan_out, sum(ei) AS edges_in, sum(eo) AS edges_out FROM (
  SELECT snapshot_id, source_artifact_id AS id, 0 AS fi, count(DISTINCT target_artifact_id) AS fo, 0 AS ei, count(*) AS eo FROM edge GROUP BY ALL
  UNION ALL SELECT snapshot_id, target_artifact_id, count(DISTINCT source_artifact_id), 0, count(*), 0 FROM edge GROUP BY ALL) GROUP BY ALL)"""
add("trv19_degrees", lambda t: degrees(t.edges), "edge", _DEGREES + "+++ SELECT snapshot_id, id, fan_in::BIGINT AS fan_in, fan_out::BIGINT AS fan_out, edges_in::BIGINT AS edges_in, edges_out::BIGINT AS edges_out FROM deg")


def _subgraph(t: Tables) -> DataFrame:
    """Nodes of the impact graph with their role and level; one traversal per graph from all its changed nodes."""
    starts = changes(t).select("graph", F.col("graph").alias("root"), F.col("artifact_id").alias("node"))
    found = traversal.reach(starts, adjacency(t.edges, placeholders=placeholder_map(t.artifacts, t.external_nodes)), 5)
    return found.select("graph", "node", "depth", F.when(F.col("depth") == 0, "CHANGED").otherwise("AFFECTED").alias("role"))


add("trv20_impact_subgraph", _subgraph, "art edge pair", _IMPACT + "+++ SELECT graph, node, min(depth)::INT AS depth, CASE WHEN min(depth) = 0 THEN 'CHANGED' ELSE 'AFFECTED' END AS role FROM reach GROUP BY ALL")
add(
    "jn01_edges_with_ends",
    lambda t: edges_with_ends(t.edges, node_table(t)).select("id", "relationship_type", F.col("s_qualified_name").alias("source_name"), F.col("t_qualified_name").alias("target_name")),
    "edge node",
    "+++ SELECT e.id, e.relationship_type, s.qualified_name AS source_name, d.qualified_name AS target_name FROM edge e JOIN node s ON s.id = e.source_artifact_id JOIN node d ON d.id = e.target_artifact_id",
)
add("trv02_adjacency", lambda t: adjacency(t.edges), "edge", _adjacency_sql(IMPACT_RULES) + "+++ SELECT * FROM adj")
QUERIES, SQL = CATALOG.queries, CATALOG.sql
