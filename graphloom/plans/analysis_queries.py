"""Whole analyses over the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import analysis, composites, impact, review
from graphloom.operators.graph import adjacency, once, placeholder_map
from graphloom.operators.snapshot_changes import snapshot_pairs
from graphloom.plans.catalog import Catalog, with_views
from graphloom.plans.conformance_queries import SQL as CONFORMANCE_SQL
from graphloom.plans.conformance_queries import _USES, _drift
from graphloom.plans.impact_queries import SQL as IMPACT_SQL
from graphloom.plans.impact_queries import _AFFECTED, _CHANGES, _IMPACT, _IS_TEST, _ROOTS, _affected, _reach_sql, _selection, _summary, changes, node_table
from graphloom.plans.review_queries import SQL as REVIEW_SQL
from graphloom.plans.sample_baseline import sample_baseline
from graphloom.session import checkpointed

CATALOG = Catalog()
add = CATALOG.add
_FILE = "split_part(replace(location, '\\', '/'), ':', 1)"

add("trv03_rules", lambda t: once(t.edges).select(F.upper("relationship_type").alias("rel"), analysis.rule_of(F.col("relationship_type")).alias("rule")).groupBy("rel", "rule").agg(F.count(F.lit(1)).alias("n")), "edge", "+++ SELECT upper(relationship_type) AS rel, CASE upper(relationship_type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in analysis.RULE_NAMES.items()) + " ELSE 'RULE_' || upper(relationship_type) END AS rule, count(*) AS n FROM edge GROUP BY ALL")
add("trv06_analysis", lambda t: analysis.analyze(t.snapshots, t.artifacts, t.edges, t.external_nodes)["summary"].select("pair", "changed", "unique_affected", "status"), "", f"WITH s AS ({IMPACT_SQL['trv05_impact_summary']}), p AS (SELECT id AS pair FROM (SELECT id, lag(id) OVER (PARTITION BY repository_id, branch_name ORDER BY created_at, id) AS prev FROM (SELECT DISTINCT ON (id) * FROM snapshots WHERE snapshot_metadata['status'] = 'READY')) WHERE prev IS NOT NULL) SELECT p.pair, coalesce(changed, 0) AS changed, coalesce(unique_affected, 0) AS unique_affected, CASE WHEN changed IS NULL THEN 'VERIFIED_ZERO' WHEN unique_affected > 0 THEN 'DETECTED' ELSE 'CONTAINED' END AS status FROM p LEFT JOIN s ON s.pair = p.pair")
add(
    "dif08_preconditions",
    lambda t: analysis.preconditions(once(t.snapshots).select(F.col("id").alias("target_id"), F.lag("id").over(W.partitionBy("repository_id").orderBy("created_at", "id")).alias("base_id")).where("base_id is not null"), t.snapshots),
    "snap",
    "p AS (SELECT id AS target_id, lag(id) OVER (PARTITION BY repository_id ORDER BY created_at, id) AS base_id FROM snap) +++ SELECT base_id, target_id, CASE WHEN b.repository_id <> a.repository_id THEN 'DIFFERENT_REPOSITORY' WHEN b.snapshot_metadata['status'] <> 'READY' OR a.snapshot_metadata['status'] <> 'READY' THEN 'NOT_READY' WHEN a.commit_hash = b.commit_hash THEN 'SAME_COMMIT' ELSE 'OK' END AS verdict FROM p JOIN snap b ON b.id = p.base_id JOIN snap a ON a.id = p.target_id",
)
_CALLS = "adj AS (SELECT DISTINCT snapshot_id AS graph, target_artifact_id AS src, source_artifact_id AS dst, 'CALLS' AS rel, 1.0::DOUBLE AS weight FROM edge WHERE upper(relationship_type) = 'CALLS' AND source_artifact_id <> target_artifact_id), "
add("trv09_caller_scores", lambda t: analysis.caller_scores(changes(t).select("graph", F.col("artifact_id").alias("root")), t.edges, node_table(t)), "art edge node pair", _CHANGES + _CALLS + f"reach AS (WITH RECURSIVE far AS (SELECT DISTINCT graph, root, root AS node FROM ({_ROOTS}) UNION SELECT far.graph, far.root, adj.dst FROM far JOIN adj ON adj.graph = far.graph AND adj.src = far.node) SELECT * FROM far)" + ", s AS (SELECT graph, root, count(*) AS callers, count(*) FILTER (n.artifact_type = 'API_ENDPOINT') AS endpoints FROM reach r JOIN node n ON n.id = r.node WHERE r.node <> r.root GROUP BY ALL), c AS (SELECT *, least(10 * callers, 60) + 15 * endpoints AS score FROM s) +++ SELECT *, CASE WHEN score > 75 THEN 'CRITICAL' WHEN score > 50 THEN 'HIGH' WHEN score > 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM c")


def _rails(t):
    return analysis.guardrails(t.artifacts, t.edges, node_table(t), sample_baseline(t._spark))


_RAILS = f"""drifted AS (SELECT snapshot_id, count(*) AS n FROM ({CONFORMANCE_SQL['arc01_drift']}) WHERE category <> 'CIRCULAR_DEPENDENCY' GROUP BY 1), debt AS ({CONFORMANCE_SQL['arc07_test_debt']}),
loops AS (SELECT graph FROM ({IMPACT_SQL['trv16_components']}) WHERE node = component),
fan AS (SELECT snapshot_id FROM (SELECT snapshot_id, source_artifact_id AS id FROM edge GROUP BY ALL HAVING count(DISTINCT target_artifact_id) >= 8) WHERE id IN (SELECT id FROM artifacts)),
rails AS (SELECT snapshot_id, 'LAYERS' AS guardrail, 'VIOLATION' AS status, n FROM drifted UNION ALL SELECT graph, 'CYCLES', 'VIOLATION', count(*) FROM loops GROUP BY 1 UNION ALL SELECT snapshot_id, 'COUPLING', 'WARN', count(*) FROM fan GROUP BY 1 UNION ALL SELECT snapshot_id, 'TEST_DEBT', verdict, untested FROM debt WHERE verdict <> 'PASS')"""
add("arc03_guardrails", _rails, "edge", _RAILS + "+++ SELECT * FROM rails")
add("rsk04_architecture", lambda t: analysis.architecture_factors(_rails(t)), "edge", _RAILS + "+++ SELECT snapshot_id, max(CASE status WHEN 'VIOLATION' THEN 80 ELSE 40 END)::DOUBLE AS factor FROM rails GROUP BY 1")


def _unknown(t):
    chosen = _selection(t)
    return analysis.unknown_evidence(composites.confidence(snapshot_pairs(t.snapshots), chosen, t.runtime_events), chosen)


add("rsk09_unknown_evidence", _unknown, "pair", f"sel AS ({IMPACT_SQL['tst09_test_selection']}) +++ SELECT p.id AS pair, least(100, 25 * ((coalesce(to_run + to_skip, 0) = 0)::INT + (p.id NOT IN (SELECT snapshot_id FROM runtime_events WHERE snapshot_id IS NOT NULL))::INT)) AS factor FROM pair p LEFT JOIN sel ON sel.pair = p.id")
add("flt10_high_findings", lambda t: _drift(t).where("severity = 'HIGH' and category = 'LAYER_BOUNDARY'"), "edge node", _USES + "+++ SELECT * FROM drift WHERE severity = 'HIGH' AND category = 'LAYER_BOUNDARY'")
add("tst07_ordered_tests", lambda t: _affected(t).withColumn("rank", F.row_number().over(W.partitionBy("pair").orderBy("impact", "depth", "test_name", "test_id"))).select("pair", "test_id", "rank"), "art edge node pair", _AFFECTED + "+++ SELECT pair, test_id, (row_number() OVER (PARTITION BY pair ORDER BY impact, depth, test_name, test_id))::INT AS rank FROM affected")


def _full(t):
    return analysis.full_prediction(changes(t), adjacency(t.edges, placeholders=placeholder_map(t.artifacts, t.external_nodes)))


add("msc13_full_prediction", _full, "art edge pair", _IMPACT + ", b AS (SELECT c.pair, r.node, min(r.depth) AS depth FROM reach r JOIN ch c ON c.graph = r.graph AND c.artifact_id = r.root GROUP BY ALL) +++ SELECT pair, count(*) AS nodes, sum(depth)::BIGINT AS depths, max(depth)::INT AS max_depth FROM b GROUP BY 1")
add("msc05_file_metrics", lambda t: analysis.file_metrics(t.artifacts), "art", f"f AS (SELECT snapshot_id, {_FILE} AS file, max(line_end) AS lines, max((coalesce({_IS_TEST}, false) OR contains(lower(coalesce(location, '')), 'test'))::INT) AS test FROM art GROUP BY ALL) +++ SELECT snapshot_id, count(*) AS files, sum(lines)::BIGINT AS lines, sum(lines * test)::BIGINT AS test_lines FROM f GROUP BY 1")
add("dsc08_organisation", lambda t: analysis.organisation(t.artifacts), "art", "x AS (SELECT DISTINCT snapshot_id, lower(split_part(" + _FILE + ", '/', 1)) AS top FROM art), v AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, ns in analysis.SIGNALS.items() for n in ns) + ") AS v(signal, top)) +++ SELECT snapshot_id, signal, string_agg(top, ',' ORDER BY top) AS folders FROM x JOIN v USING (top) GROUP BY ALL")
add("dsc11_entry_files", lambda t: analysis.entry_files(t.artifacts), "art", f"+++ SELECT DISTINCT snapshot_id, {_FILE} AS file FROM art WHERE regexp_matches(lower(split_part({_FILE}, '/', -1)), '^(main|app|index|server|run|manage|cli)\\.')")
add("dsc09_plan", lambda t: once(t.artifacts).groupBy("snapshot_id", F.coalesce(analysis.analyzer_of(F.col("language")), F.lit("none")).alias("analyzer")).agg(F.count_distinct(F.lower("language")).alias("languages"), F.count(F.lit(1)).alias("artifacts")), "art", "+++ SELECT snapshot_id, CASE lower(language) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in analysis.ANALYZERS.items()) + " ELSE 'none' END AS analyzer, count(DISTINCT lower(language)) AS languages, count(*) AS artifacts FROM art GROUP BY ALL")
add("snk07_reports", lambda t: analysis.markdown(_summary(t)), "", f"SELECT pair, concat_ws(chr(10), '# Impact of ' || pair, '', '- changed: ' || changed, '- direct: ' || direct, '- indirect: ' || indirect, '- tests: ' || n_test, '- endpoints: ' || n_api, '- deepest path: ' || max_depth) AS report FROM ({IMPACT_SQL['trv05_impact_summary']})")
add("msc07_latest_snapshots", lambda t: analysis.latest_per_repository(once(t.snapshots).select("repository_id", "id", "created_at", "total_symbols"), "created_at").select("repository_id", "id", "total_symbols"), "snap", "+++ SELECT repository_id, id, total_symbols FROM snap QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC) = 1")
add("sim09_plans", lambda t: analysis.scenario_plans(once(t.incidents).select(F.col("id").alias("ident"), F.col("title").alias("text"))), "inc", r"""x AS (SELECT id AS ident, title AS t, CASE WHEN regexp_matches(lower(title), 'traffic|load|capacity|spike|concurren') THEN 'CAPACITY_LOAD_SPIKE' WHEN regexp_matches(lower(title), 'remov|delet|drop|outage|shut') THEN 'REMOVE_COMPONENT' WHEN regexp_matches(lower(title), 'depend|import|connect') THEN 'ADD_DEPENDENCY' WHEN regexp_matches(lower(title), '\bapi\b|endpoint|route') THEN 'MODIFY_API' ELSE 'MODIFY_SYMBOL' END AS intent,
  coalesce(nullif(regexp_extract(title, '["''`]([^"''`]+)["''`]', 1), ''), nullif(regexp_extract(title, '\b([\w/-]+\.(?:py|ts|js|java|go|sql|cbl))\b', 1), ''), nullif(regexp_extract(title, '\b([A-Za-z]\w*(?:[._]\w+)+)', 1), ''), nullif(regexp_extract(title, '\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)\b', 1), '')) AS target FROM inc WHERE title IS NOT NULL)
  +++ SELECT ident, intent, target, CASE WHEN intent = 'CAPACITY_LOAD_SPIKE' THEN 'NOT_EVALUATED' WHEN target IS NULL THEN 'UNRESOLVED' ELSE 'PLANNED' END AS status FROM x""")
_FACTORS = f"""s AS ({IMPACT_SQL['trv05_impact_summary']}), sel AS ({IMPACT_SQL['tst09_test_selection']}),
x AS (SELECT s.*, changed + s.direct + indirect AS n, sel.direct AS td, to_run - sel.direct AS ti, coalesce(to_run + to_skip, 0) AS mapped FROM s LEFT JOIN sel ON sel.pair = s.pair),
fac AS (SELECT pair, 'IMPACT_BREADTH' AS factor, (CASE WHEN n = 0 THEN 0 WHEN n <= 3 THEN 20 WHEN n <= 8 THEN 50 WHEN n <= 15 THEN 75 ELSE 95 END)::DOUBLE AS score, n > 0 AS applies FROM x
  UNION ALL SELECT pair, 'IMPACT_DEPTH', (CASE max_depth WHEN 0 THEN 0 WHEN 1 THEN 15 WHEN 2 THEN 40 WHEN 3 THEN 70 ELSE 90 END)::DOUBLE, max_depth > 0 FROM x UNION ALL SELECT pair, 'TEST_IMPACT', (CASE WHEN mapped = 0 THEN 45 ELSE least(60, 15 * td + 5 * ti) END)::DOUBLE, true FROM x)"""


def _factors(t):
    return analysis.risk_factors(_summary(t), _selection(t))


add("rsk01_factors", _factors, "", f"WITH {_FACTORS} SELECT * FROM fac")


def _all_factors(t):
    changed = changes(t)
    selection = checkpointed(_selection(t))
    relevant = impact.reached_per_pair(changed, adjacency(t.edges, placeholders=placeholder_map(t.artifacts, t.external_nodes)), 5).select(F.col("root").alias("pair"), "node").distinct()
    unknown = analysis.unknown_evidence(composites.confidence(snapshot_pairs(t.snapshots), selection, t.runtime_events), selection)
    return analysis.all_factors(checkpointed(analysis.risk_factors(_summary(t), selection)), _rails(t), review.coupling_factors(changed, t.edges), review.interface_factors(changed, t.edges), unknown, analysis.evidence_factors(checkpointed(relevant), t.runtime_events, t.incidents))


_RELEVANT = with_views("art edge pair", _IMPACT + "+++ SELECT DISTINCT c.pair, r.node FROM reach r JOIN ch c ON c.graph = r.graph AND c.artifact_id = r.root")
_NINE = f"""WITH {_FACTORS}, rel AS ({_RELEVANT}),
run_ AS (SELECT pair, max(CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN 90 WHEN environment = 'production' THEN 70 ELSE 40 END)::DOUBLE AS score FROM (SELECT rel.pair, upper(severity) AS severity, environment FROM rel JOIN (SELECT * FROM runtime_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at) = 1) e ON e.component_artifact_id = rel.node
  QUALIFY row_number() OVER (PARTITION BY rel.pair ORDER BY ingested_at DESC NULLS LAST, event_id) <= 50) GROUP BY 1),
inc_ AS (SELECT pair, max(CASE WHEN severity = 'CRITICAL' AND n <= 4 THEN 90 ELSE 60 END)::DOUBLE AS score FROM (SELECT rel.pair, upper(severity) AS severity, row_number() OVER (PARTITION BY rel.pair ORDER BY created_at DESC NULLS LAST, i.id) AS n FROM rel JOIN (SELECT DISTINCT ON (id) * FROM incidents) i ON i.affected_component_id = rel.node) WHERE n <= 20 GROUP BY 1),
p AS (SELECT DISTINCT pair FROM fac),
nine AS (SELECT pair, factor, score, applies FROM fac UNION ALL SELECT p.pair, 'ARCHITECTURE', coalesce(factor, 0)::DOUBLE, true FROM p LEFT JOIN ({CATALOG.sql['rsk04_architecture']}) r ON r.snapshot_id = p.pair
  UNION ALL SELECT p.pair, 'COUPLING', coalesce(factor, 0)::DOUBLE, true FROM p LEFT JOIN ({REVIEW_SQL['rsk05_coupling']}) r ON r.pair = p.pair UNION ALL SELECT p.pair, 'API_SURFACE', coalesce(factor, 0)::DOUBLE, true FROM p LEFT JOIN ({REVIEW_SQL['rsk08_interface']}) r ON r.pair = p.pair
  UNION ALL SELECT p.pair, 'UNKNOWN_EVIDENCE', coalesce(factor, 0)::DOUBLE, true FROM p LEFT JOIN ({CATALOG.sql['rsk09_unknown_evidence']}) r ON r.pair = p.pair
  UNION ALL SELECT p.pair, 'RUNTIME', coalesce(score, 0)::DOUBLE, true FROM p LEFT JOIN run_ ON run_.pair = p.pair UNION ALL SELECT p.pair, 'INCIDENTS', coalesce(score, 0)::DOUBLE, score IS NOT NULL FROM p LEFT JOIN inc_ ON inc_.pair = p.pair)"""
add("rsk10_all_factors", _all_factors, "", _NINE + " SELECT * FROM nine")
add(
    "rsk10_pair_risk",
    lambda t: analysis.combined_risk(_all_factors(t)),
    "",
    _NINE + f""", w AS (SELECT *, CASE factor {' '.join(f"WHEN '{k}' THEN {v}" for k, v in analysis.WEIGHTS.items())} END::DOUBLE AS weight FROM nine WHERE applies),
      g AS (SELECT pair, round(sum(score * weight) / sum(weight), 6) AS score, coalesce(max(score) FILTER (factor = 'IMPACT_BREADTH'), 0) AS b, coalesce(max(score) FILTER (factor = 'RUNTIME'), 0) AS r, coalesce(max(score) FILTER (factor = 'ARCHITECTURE'), 0) AS a FROM w GROUP BY 1)
      SELECT pair, score, CASE WHEN a >= 100 OR score >= 75 OR b >= 70 AND r >= 70 AND a >= 80 THEN 'CRITICAL' WHEN a >= 80 OR score >= 50 OR b >= 70 AND r >= 70 OR b >= 75 THEN 'HIGH' WHEN score >= 25 OR b >= 40 THEN 'MODERATE' ELSE 'LOW' END AS category FROM g""",
)
add("rsk13_buckets", lambda t: analysis.factor_buckets(_factors(t)), "", f"WITH {_FACTORS} SELECT pair, CASE factor WHEN 'TEST_IMPACT' THEN 'tests' ELSE 'structure' END AS bucket, sum(score) AS score FROM fac GROUP BY ALL")
QUERIES, SQL = CATALOG.queries, CATALOG.sql
