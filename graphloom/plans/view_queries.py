"""Views, processes, what-if edits and evaluation over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import evaluation, lookup, traversal, views, whatif
from graphloom.operators.graph import once
from graphloom.plans.catalog import Catalog
from graphloom.plans.impact_queries import _CHANGES, _DEGREES, _IMPACT, _reach_sql, changes, findings, node_table

CATALOG = Catalog()
add = CATALOG.add
_FILE = "split_part(replace(location, '\\', '/'), ':', 1)"
_MACRO = "('PACKAGE','DIRECTORY','SERVICE','DATABASE','API_ENDPOINT','DOCKER_STAGE','SQL_TABLE','DATABASE_TABLE')"
_COMPONENT = "('PACKAGE','MODULE','CLASS','INTERFACE','SERVICE','COMPONENT','API_ENDPOINT','DATABASE_TABLE','SQL_TABLE','TEST_CASE','TEST_SUITE','DOCKER_STAGE')"

add("grf01_macro_view", lambda t: views.visible_nodes(t.artifacts, t.edges, 1), "art edge", _DEGREES + f"+++ SELECT a.snapshot_id, a.id FROM art a LEFT JOIN deg d ON d.id = a.id AND d.snapshot_id = a.snapshot_id WHERE artifact_type IN {_MACRO} OR (artifact_type = 'MODULE' AND (coalesce(edges_in + edges_out, 0) >= 2 OR regexp_matches(lower(coalesce(location, '')), 'app\\.|main\\.|index\\.|server\\.|route|controller|api|router')))")
add("grf01_component_view", lambda t: views.visible_nodes(t.artifacts, t.edges, 2), "art", f"+++ SELECT snapshot_id, id FROM art WHERE artifact_type IN {_COMPONENT}")


def _states(t):
    return views.node_states(t.artifacts, t.edges, changes(t), lookup.observed_artifacts(t.artifacts, t.runtime_events))


_STATES = _CHANGES + _DEGREES + """, obs AS (SELECT id FROM art WHERE id IN (SELECT component_artifact_id FROM runtime_events WHERE component_artifact_id IS NOT NULL) OR lower(name) IN (SELECT lower(component_name) FROM runtime_events WHERE component_name IS NOT NULL)),
state AS (SELECT a.id, a.snapshot_id, a.artifact_type, coalesce(edges_in, 0)::BIGINT AS edges_in, coalesce(edges_out, 0)::BIGINT AS edges_out, coalesce(lower(c.change_type), 'unchanged') AS change, o.id IS NOT NULL AS observed
  FROM art a LEFT JOIN deg d ON d.id = a.id AND d.snapshot_id = a.snapshot_id LEFT JOIN (SELECT artifact_id, change_type FROM ch WHERE change_type <> 'REMOVED') c ON c.artifact_id = a.id LEFT JOIN obs o ON o.id = a.id)"""
add("grf02_node_states", _states, "art edge pair", _STATES + "+++ SELECT * FROM state")
add("grf04_view_summary", lambda t: views.view_summary(_states(t)), "art edge pair", _STATES + "+++ SELECT snapshot_id, artifact_type, count(*) AS nodes, count(*) FILTER (observed) AS observed, 100 * count(*) FILTER (observed) / count(*) AS observed_share FROM state GROUP BY ALL")
add(
    "grf03_rolled_up_edges",
    lambda t: views.rolled_up_edges(t.artifacts, t.edges, views.visible_nodes(t.artifacts, t.edges, 2)),
    "art edge",
    f"""r AS (SELECT snapshot_id, id, {_FILE} AS file, trim(qualified_name) AS q, artifact_type IN {_COMPONENT} AS vis FROM art),
    f AS (SELECT snapshot_id, file, min(id) AS id FROM r WHERE vis GROUP BY ALL), n AS (SELECT snapshot_id, q, min(id) AS id FROM r WHERE vis GROUP BY ALL),
    p AS (SELECT r.id, arg_max(n.id, length(n.q)) AS stand FROM r JOIN n ON n.snapshot_id = r.snapshot_id AND starts_with(r.q, n.q || '.') WHERE NOT r.vis GROUP BY ALL),
    s AS (SELECT r.id, CASE WHEN r.vis THEN r.id ELSE coalesce(f.id, p.stand) END AS stand FROM r LEFT JOIN f ON f.snapshot_id = r.snapshot_id AND f.file = r.file LEFT JOIN p ON p.id = r.id)
    +++ SELECT DISTINCT e.snapshot_id, a.stand AS source, b.stand AS target, relationship_type AS rel FROM edge e JOIN s a ON a.id = e.source_artifact_id JOIN s b ON b.id = e.target_artifact_id WHERE a.stand <> b.stand""",
)
add("grf05_file_tree", lambda t: views.file_tree(t.artifacts), "art", f"p AS (SELECT snapshot_id, string_split({_FILE}, '/') AS p FROM art WHERE location IS NOT NULL), x AS (SELECT snapshot_id, p, unnest(range(1, len(p) + 1)) AS n FROM p) +++ SELECT snapshot_id, array_to_string(p[1:n], '/') AS path, array_to_string(p[1:n-1], '/') AS parent, n < len(p) AS is_folder, count(*) AS symbols FROM x GROUP BY ALL")
_ENTRY = """entry AS (SELECT snapshot_id, id, rank FROM (SELECT snapshot_id, id, CASE WHEN contains(upper(artifact_type), 'API') OR contains(upper(artifact_type), 'ENDPOINT') OR contains(lower(coalesce(location, '')), 'route') THEN 1
  WHEN (regexp_matches(lower(coalesce(name, '')), 'controller|handler|router|dispatch|service|process') OR regexp_matches(lower(coalesce(location, '')), 'controller|handler|router|dispatch|service|process')) AND artifact_type IN ('FUNCTION','METHOD','CLASS','INTERFACE') THEN 2 END AS rank
  FROM art WHERE artifact_type NOT IN ('EXTERNAL_DEPENDENCY', 'PACKAGE')) WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY rank, id) <= 10)"""
add("prc01_entry_points", lambda t: views.entry_points(t.artifacts), "art", _ENTRY + "+++ SELECT * FROM entry")


def _processes(t):
    starts = views.entry_points(t.artifacts).select(F.col("snapshot_id").alias("graph"), F.col("id").alias("root"))
    reached = traversal.reach(starts, traversal.forward_of(once(t.edges), ["CALLS", "EXPOSES", "CONSUMES", "PERSISTS_TO"]), 4)
    return views.process_steps(reached, node_table(t))


add(
    "prc02_process_steps",
    _processes,
    "art edge node",
    _ENTRY + ", adj AS (SELECT snapshot_id AS graph, source_artifact_id AS src, target_artifact_id AS dst, min(upper(relationship_type)) AS rel, 1.0::DOUBLE AS weight FROM edge WHERE upper(relationship_type) IN ('CALLS','EXPOSES','CONSUMES','PERSISTS_TO') AND source_artifact_id <> target_artifact_id GROUP BY ALL), "
    + _reach_sql("SELECT snapshot_id AS graph, id AS root FROM entry", 4)
    + """, s AS (SELECT r.graph, r.root, r.node, (row_number() OVER (PARTITION BY r.graph, r.root ORDER BY r.depth, r.path, r.node) - 1)::INT AS step, r.depth, lower(coalesce(n.name, '')) AS name FROM reach r JOIN node n ON n.id = r.node)
    +++ SELECT graph, root, node, step, depth, CASE WHEN depth = 0 THEN 'entrypoint' WHEN regexp_matches(name, 'repo|repository|db|database|dao|table|store') THEN 'database_op' WHEN regexp_matches(name, 'client|external|remote|http|api') THEN 'external_call' WHEN regexp_matches(name, 'validate|check|verify|auth|guard') THEN 'validation' ELSE 'action' END AS step_kind,
      greatest(0.6::DOUBLE, 0.85::DOUBLE - 0.05::DOUBLE * depth) AS confidence FROM s WHERE step < 15""",
)


def _outage(t):
    """SIM-04, SIM-08: direct dependants that lose something if every component hit by an incident goes away."""
    gone = once(t.incidents).select("snapshot_id", F.col("affected_component_id").alias("id")).where("id is not null and snapshot_id is not null").distinct()
    _, kept = whatif.without_components(t.artifacts, t.edges, gone)
    before = once(t.edges).groupBy("snapshot_id", F.col("source_artifact_id").alias("id")).agg(F.count(F.lit(1)).alias("before"))
    after = kept.groupBy("snapshot_id", F.col("source_artifact_id").alias("id")).agg(F.count(F.lit(1)).alias("after"))
    rows = before.join(after, ["snapshot_id", "id"], "left").withColumn("after", F.coalesce("after", F.lit(0))).where("after < before")
    return rows.join(gone, ["snapshot_id", "id"], "left_anti")


add(
    "sim04_outage",
    _outage,
    "edge inc",
    """gone AS (SELECT DISTINCT snapshot_id, affected_component_id AS id FROM inc WHERE affected_component_id IS NOT NULL AND snapshot_id IS NOT NULL),
    x AS (SELECT e.snapshot_id, e.source_artifact_id AS id, count(*) AS before, count(*) FILTER (g.id IS NULL) AS after FROM edge e LEFT JOIN gone g ON g.snapshot_id = e.snapshot_id AND g.id = e.target_artifact_id GROUP BY ALL)
    +++ SELECT * FROM x WHERE after < before AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.snapshot_id = x.snapshot_id AND g.id = x.id)""",
)
add("sim05_cut_calls", lambda t: whatif.without_dependencies(t.edges, once(t.edges).where("relationship_type = 'CALLS' and detection_method = 'name_match'").select("snapshot_id", "source_artifact_id", "target_artifact_id", "relationship_type")).groupBy("snapshot_id", "relationship_type").agg(F.count(F.lit(1)).alias("n")), "edge", "cut AS (SELECT DISTINCT snapshot_id, source_artifact_id, target_artifact_id FROM edge WHERE relationship_type = 'CALLS' AND detection_method = 'name_match') +++ SELECT e.snapshot_id, relationship_type, count(*) AS n FROM edge e LEFT JOIN cut c ON c.snapshot_id = e.snapshot_id AND c.source_artifact_id = e.source_artifact_id AND c.target_artifact_id = e.target_artifact_id AND e.relationship_type = 'CALLS' WHERE c.snapshot_id IS NULL GROUP BY ALL")
add(
    "sim07_validation",
    lambda t: whatif.validation(once(t.edges).select("snapshot_id", F.lit("ADD_DEPENDENCY").alias("mutation_type"), F.col("target_artifact_id").alias("source"), F.col("source_artifact_id").alias("target")).unionByName(once(t.edges).select("snapshot_id", F.lit("REMOVE_DEPENDENCY").alias("mutation_type"), F.col("target_artifact_id").alias("source"), F.col("source_artifact_id").alias("target"))), t.artifacts, t.edges),
    "art edge",
    """m AS (SELECT DISTINCT snapshot_id, k AS mutation_type, target_artifact_id AS source, source_artifact_id AS target FROM edge, (VALUES ('ADD_DEPENDENCY'), ('REMOVE_DEPENDENCY')) v(k)),
    j AS (SELECT m.*, a.id AS t, s.id AS s, EXISTS (SELECT 1 FROM edge e WHERE e.snapshot_id = m.snapshot_id AND e.source_artifact_id = m.source AND e.target_artifact_id = m.target) AS linked FROM m LEFT JOIN art a ON a.id = m.target AND a.snapshot_id = m.snapshot_id LEFT JOIN art s ON s.id = m.source AND s.snapshot_id = m.snapshot_id),
    r AS (SELECT *, CASE WHEN t IS NULL THEN 'UNKNOWN_TARGET' WHEN s IS NULL THEN 'UNKNOWN_SOURCE' WHEN mutation_type = 'REMOVE_DEPENDENCY' AND NOT linked THEN 'NO_SUCH_DEPENDENCY' WHEN mutation_type = 'ADD_DEPENDENCY' AND source = target THEN 'SELF_LOOP' WHEN mutation_type = 'ADD_DEPENDENCY' AND linked THEN 'DUPLICATE' END AS reason FROM j)
    +++ SELECT snapshot_id, mutation_type, source, target, CASE WHEN reason IN ('SELF_LOOP', 'DUPLICATE') THEN 'WARNING' WHEN reason IS NOT NULL THEN 'ERROR' ELSE 'OK' END AS status, reason FROM r""",
)


def _evaluation(t):
    """Components a change reaches (predicted) against components of incidents of that snapshot (labels)."""
    changed = changes(t)
    predicted = findings(t, changed).select(F.col("graph").alias("case_id"), F.col("node").alias("entity")).unionByName(changed.select(F.col("graph").alias("case_id"), F.col("artifact_id").alias("entity"))).distinct()
    truth = once(t.incidents).where("affected_component_id is not null and snapshot_id is not null").select(F.col("snapshot_id").alias("case_id"), F.col("affected_component_id").alias("entity")).distinct()
    return evaluation.confusion(predicted, truth)


_SCORES = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
_CONFUSION = _IMPACT + """, p AS (SELECT DISTINCT graph AS c, node AS e FROM reach), w AS (SELECT DISTINCT snapshot_id AS c, affected_component_id AS e FROM inc WHERE affected_component_id IS NOT NULL AND snapshot_id IS NOT NULL),
conf AS (SELECT coalesce(p.c, w.c) AS case_id, count(*) FILTER (p.c IS NOT NULL AND w.c IS NOT NULL) AS tp, count(*) FILTER (w.c IS NULL) AS fp, count(*) FILTER (p.c IS NULL) AS fn FROM p FULL JOIN w ON w.c = p.c AND w.e = p.e GROUP BY 1)"""
add("agg19_confusion", _evaluation, "art edge inc pair", _CONFUSION + f"+++ SELECT *, {_SCORES} FROM conf")
add("msc15_micro_average", lambda t: evaluation.micro_average(_evaluation(t)), "art edge inc pair", _CONFUSION + f", s AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM conf) +++ SELECT *, {_SCORES} FROM s")
add("jn17_path_steps", lambda t: evaluation.path_steps(findings(t), once(t.edges)), "art edge pair", _IMPACT + """, h AS (SELECT graph, root, node, unnest(range(1, len(path))) AS i, path FROM reach WHERE depth > 0), k AS (SELECT DISTINCT snapshot_id, least(source_artifact_id, target_artifact_id) AS a, greatest(source_artifact_id, target_artifact_id) AS b FROM edge)
  +++ SELECT h.graph, h.root, h.node, count(*) AS hops, count(k.a) AS backed FROM h LEFT JOIN k ON k.snapshot_id = h.graph AND k.a = least(path[i], path[i + 1]) AND k.b = greatest(path[i], path[i + 1]) GROUP BY ALL""")


QUERIES, SQL = CATALOG.queries, CATALOG.sql
