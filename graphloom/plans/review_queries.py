"""Reviews of changes, components and incidents over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.graph import TEST_RULES
from graphloom.operators import conformance, impact, review, runtime, views
from graphloom.operators.graph import adjacency, once
from graphloom.operators.snapshot_changes import snapshot_pairs
from graphloom.operators.traversal import reach
from graphloom.plans import conformance_queries
from graphloom.plans.catalog import Catalog
from graphloom.plans.conformance_queries import _POLICY, _USES
from graphloom.plans.impact_queries import _AFFECTED, _CHANGES, _DEGREES, _IMPACT, _IS_TEST, _REVERSED, _affected, _reach_sql, _unaffected, changes, findings, node_table
from graphloom.plans.view_queries import _ENTRY
from graphloom.session import checkpointed
from graphloom.plans.sample_baseline import sample_baseline

CATALOG = Catalog()
add = CATALOG.add
_K = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))), '')".format
_FILE = "split_part(replace(location, '\\', '/'), ':', 1)"

add("dif05_graph_changes", lambda t: review.graph_changes(snapshot_pairs(t.snapshots), t.artifacts), "art pair", """x AS (SELECT snapshot_id, trim(qualified_name) AS q, id, line_start, line_end, coalesce(signature, '') AS sig FROM art WHERE qualified_name IS NOT NULL)
  +++ SELECT p.id AS pair, a.id AS node, CASE WHEN b.id IS NULL THEN 'added' ELSE 'modified' END AS change FROM pair p JOIN x a ON a.snapshot_id = p.id LEFT JOIN x b ON b.snapshot_id = p.prev AND b.q = a.q WHERE b.id IS NULL OR a.sig <> b.sig OR a.line_start IS DISTINCT FROM b.line_start OR a.line_end IS DISTINCT FROM b.line_end
  UNION ALL SELECT p.id, 'removed_' || b.id, 'removed' FROM pair p JOIN x b ON b.snapshot_id = p.prev WHERE NOT EXISTS (SELECT 1 FROM x a WHERE a.snapshot_id = p.id AND a.q = b.q)""")
add("trv12_core_exposure", lambda t: review.core_exposure(t.artifacts, t.edges), "art edge", _REVERSED + " " + _reach_sql("SELECT snapshot_id AS graph, id AS root FROM art WHERE artifact_type IN ('CLASS', 'INTERFACE', 'SERVICE', 'COMPONENT') QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY id) <= 30", 5) + "+++ SELECT graph, root, count(*) - 1 AS nodes, max(depth) AS depth, count(*) - 1 >= 15 OR max(depth) >= 4 AS flagged FROM reach GROUP BY ALL")
add("trv14_static_chains", lambda t: review.static_chains(t.artifacts, t.edges, views.entry_points(t.artifacts)), "art edge", _ENTRY + f""", adj AS (SELECT snapshot_id AS graph, source_artifact_id AS src, target_artifact_id AS dst, min(upper(relationship_type)) AS rel, 1.0::DOUBLE AS weight FROM edge WHERE upper(relationship_type) IN ('CALLS', 'IMPORTS', 'DEPENDS_ON') AND source_artifact_id <> target_artifact_id AND target_artifact_id NOT IN (SELECT id FROM art WHERE {_IS_TEST}) GROUP BY ALL), """
  + _reach_sql("SELECT snapshot_id AS graph, id AS root FROM entry QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY rank, id) <= 5", 4) + "+++ SELECT graph, root, count(*) AS nodes, max(depth) AS depth FROM reach GROUP BY ALL")


def _claims(t):
    changed = changes(t)
    found = reach(changed.select("graph", F.col("artifact_id").alias("root")), adjacency(t.edges, TEST_RULES), 6)
    tests = once(t.artifacts).where("artifact_type = 'TEST_CASE'").select(F.col("id").alias("node"))
    direct = once(t.edges).where("upper(relationship_type) = 'TESTS'").select(F.col("target_artifact_id").alias("id"))
    return review.coverage_claims(changed, found.join(tests, "node", "left_semi"), direct, t.artifacts, t.edges)


add("tst04_coverage_claims", _claims, "art edge node pair", _AFFECTED + ", " + _DEGREES + """, obs AS (SELECT DISTINCT target_artifact_id AS id FROM edge WHERE upper(relationship_type) = 'TESTS'), inf AS (SELECT DISTINCT root AS id FROM reach WHERE node IN (SELECT id FROM art WHERE artifact_type = 'TEST_CASE')), have AS (SELECT DISTINCT snapshot_id AS s FROM art WHERE artifact_type = 'TEST_CASE')
  +++ SELECT pair, qualified_name, change_type, CASE WHEN artifact_id IN (SELECT id FROM obs) THEN 'OBSERVED' WHEN artifact_id IN (SELECT id FROM inf) THEN 'INFERRED' WHEN graph NOT IN (SELECT s FROM have) THEN 'NO_TESTS_AT_ALL' WHEN regexp_matches(lower(coalesce(source_file, '')), '\\.(ya?ml|json|toml|ini|cfg|env)$') THEN 'CONFIGURATION'
    WHEN contains(lower(coalesce(source_file, '')), 'generated') THEN 'GENERATED' WHEN coalesce(d.fan_in, 0) = 0 THEN 'UNCALLED' ELSE 'UNKNOWN' END AS claim FROM ch LEFT JOIN deg d ON d.snapshot_id = ch.graph AND d.id = ch.artifact_id""")


def _contradictions(t):
    changed = changes(t)
    return review.contradictions(changed, _unaffected(t, checkpointed(impact.affected_tests(changed, t.edges, node_table(t)))), t.artifacts)


add("tst06_contradictions", _contradictions, "art edge node pair", _AFFECTED + f"+++ SELECT u.test_id, 'CHANGED_BUT_UNAFFECTED' AS problem FROM unaffected u JOIN ch c ON c.pair = u.pair AND c.artifact_id = u.test_id AND c.change_type <> 'REMOVED' UNION ALL SELECT test_id, 'NOT_A_TEST' FROM unaffected WHERE test_id NOT IN (SELECT id FROM art WHERE {_IS_TEST})")
add("tst08_test_commands", lambda t: review.test_commands(_affected(t), node_table(t)), "art edge node pair", _AFFECTED + f""", f AS (SELECT DISTINCT a.pair, {_FILE} AS file FROM affected a JOIN node n ON n.id = a.test_id), r AS (SELECT *, CASE WHEN ends_with(file, '.py') THEN 'pytest' WHEN regexp_matches(file, '\\.(ts|tsx|js|jsx)$') THEN 'jest' WHEN ends_with(file, '.go') THEN 'go test' ELSE 'other' END AS runner FROM f)
  +++ SELECT pair, runner, count(*) AS files, string_agg(file, ' ' ORDER BY file) AS arguments FROM r GROUP BY ALL""")
add("rsk05_coupling", lambda t: review.coupling_factors(impact.change_set(t.snapshots, t.artifacts), t.edges), "art edge pair", _CHANGES + _DEGREES + ", s AS (SELECT pair, coalesce(max(fan_in), 0)::BIGINT AS fan_in, coalesce(max(fan_out), 0)::BIGINT AS fan_out FROM ch LEFT JOIN deg d ON d.snapshot_id = ch.graph AND d.id = ch.artifact_id GROUP BY 1) +++ SELECT *, (CASE WHEN fan_in = 0 AND fan_out = 0 THEN 0 WHEN fan_in <= 2 AND fan_out <= 4 THEN 15 WHEN fan_in <= 5 THEN 50 ELSE 85 END)::DOUBLE AS factor FROM s")
add("rsk08_interface", lambda t: review.interface_factors(impact.change_set(t.snapshots, t.artifacts), t.edges), "art edge pair", _CHANGES.rstrip(", \n") + ", x AS (SELECT source_artifact_id AS id FROM edge WHERE upper(relationship_type) IN ('EXPOSES', 'CONSUMES') UNION SELECT target_artifact_id FROM edge WHERE upper(relationship_type) IN ('EXPOSES', 'CONSUMES')), s AS (SELECT pair, count(*) FILTER (artifact_type = 'API_ENDPOINT' OR contains(lower(coalesce(source_file, '')), 'api')) AS direct, count(x.id) AS touching FROM ch LEFT JOIN x ON x.id = ch.artifact_id GROUP BY 1) +++ SELECT *, (CASE WHEN direct > 0 THEN 85 WHEN touching > 0 THEN 50 ELSE 0 END)::DOUBLE AS factor FROM s")
add("rsk07_component_factors", lambda t: review.component_factors(runtime.component_health(t.runtime_events, t.incidents)), "inc ev", "e AS (SELECT component_artifact_id AS c, count(*) AS n, count(*) FILTER (upper(severity) IN ('ERROR', 'CRITICAL')) AS bad, count(*) FILTER (environment = 'production') AS prod FROM ev WHERE component_artifact_id IS NOT NULL GROUP BY 1), i AS (SELECT affected_component_id AS c, count(*) AS n, count(*) FILTER (lower(severity) = 'critical') AS bad FROM inc WHERE affected_component_id IS NOT NULL GROUP BY 1) +++ SELECT coalesce(e.c, i.c) AS component_id, (CASE WHEN e.c IS NULL THEN 0 WHEN e.bad > 0 THEN 90 WHEN prod > 0 THEN 70 ELSE 40 END)::DOUBLE AS runtime, (CASE WHEN i.c IS NULL THEN 0 WHEN i.bad > 0 THEN 90 ELSE 60 END)::DOUBLE AS incidents FROM e FULL JOIN i ON i.c = e.c")


def _uses(t):
    return conformance.layered_uses(t.edges, node_table(t), sample_baseline(t._spark))


add("arc04_guardrails", lambda t: review.guardrail_rows(None, sample_baseline(t._spark).policy, _uses(t)), "edge node", _USES + f""", h AS (SELECT snapshot_id, v.a || ' -> ' || v.b AS rule, count(DISTINCT (source_name, target_name)) AS n FROM uses u JOIN {_POLICY} ON v.a = u.a AND v.b = u.b GROUP BY ALL), r AS (SELECT DISTINCT v.a || ' -> ' || v.b AS rule FROM {_POLICY}), s AS (SELECT DISTINCT snapshot_id FROM uses)
  +++ SELECT s.snapshot_id, r.rule, coalesce(h.n, 0) AS n, CASE WHEN h.n > 0 THEN 'VIOLATION' ELSE 'PASS' END AS status FROM s CROSS JOIN r LEFT JOIN h ON h.snapshot_id = s.snapshot_id AND h.rule = r.rule""")
_SCORES = f"WITH d AS ({conformance_queries.SQL['arc09_assessment']}) "
add("arc10_weakest", lambda t: review.weakest_dimensions(conformance.assessment(t.artifacts, t.edges)), "", _SCORES + "SELECT *, (row_number() OVER (PARTITION BY snapshot_id ORDER BY score, dimension))::INT AS rank FROM d WHERE score < 80 QUALIFY rank <= 2")
add("arc11_health", lambda t: review.overall_health(conformance.assessment(t.artifacts, t.edges)).withColumn("health", F.round("health", 6)), "", _SCORES + "SELECT snapshot_id, round(CASE WHEN max(score) FILTER (dimension = 'testing') = 0 THEN least(avg(score), 45) ELSE avg(score) END, 6) AS health FROM d GROUP BY 1")
add("inc01_unlinked_events", lambda t: review.unlinked_events(t.incidents, t.incident_links, t.runtime_events), "inc link", f"""seen AS (SELECT event_id, component_artifact_id AS c, min(ingested_at) AS ts FROM runtime_events WHERE component_artifact_id IS NOT NULL GROUP BY ALL), known AS (SELECT id AS i, {_K('x')} AS e FROM (SELECT id, unnest(evidence_ids) AS x FROM inc) UNION SELECT incident_id, {_K('target_id')} FROM link WHERE target_type = 'runtime_event')
  +++ SELECT i.id AS incident_id, s.event_id FROM inc i JOIN seen s ON s.c = i.affected_component_id WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.i = i.id AND k.e = s.event_id) QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY s.ts DESC, s.event_id) <= 100""")
add("msc11_incident_cards", lambda t: review.incident_cards(t.incidents, t.incident_links, t.artifacts), "inc link art", "n AS (SELECT incident_id, count(*) AS links FROM link GROUP BY 1) +++ SELECT i.id AS incident_id, a.qualified_name AS component, coalesce(n.links, 0) AS links FROM inc i LEFT JOIN n ON n.incident_id = i.id LEFT JOIN art a ON a.id = i.affected_component_id")
add("msc08_artifact_tests", lambda t: review.artifact_tests(t.artifacts, t.edges), "art edge", "n AS (SELECT target_artifact_id AS id, count(DISTINCT source_artifact_id) AS tests FROM edge WHERE upper(relationship_type) = 'TESTS' GROUP BY 1), h AS (SELECT DISTINCT snapshot_id FROM art WHERE artifact_type = 'TEST_CASE') +++ SELECT a.id, a.snapshot_id, coalesce(n.tests, 0) AS tests, CASE WHEN n.tests > 0 THEN 'OBSERVED' WHEN h.snapshot_id IS NULL THEN 'NO_AUTOMATED_TEST_EXISTS' ELSE 'UNKNOWN' END AS claim FROM art a LEFT JOIN n ON n.id = a.id LEFT JOIN h ON h.snapshot_id = a.snapshot_id WHERE a.artifact_type <> 'TEST_CASE'")
add("top04_latest_events", lambda t: review.latest_events(t.runtime_events), "", "r AS (SELECT component_artifact_id, event_id, min(ingested_at) AS ts FROM runtime_events WHERE component_artifact_id IS NOT NULL GROUP BY ALL) +++ SELECT component_artifact_id, event_id, (row_number() OVER (PARTITION BY component_artifact_id ORDER BY ts DESC, event_id))::INT AS rank FROM r QUALIFY rank <= 50")


def _confidence(t):
    changed = changes(t)
    return review.evidence_confidence(findings(t, changed), changed).select("graph", F.round("confidence", 6).alias("confidence"))


add("agg22_evidence_confidence", _confidence, "art edge pair", _IMPACT + """, p AS (SELECT graph, 0.5 + greatest(0.1, 0.5 - 0.1 * (depth - 1)) AS p FROM reach WHERE depth > 0 UNION ALL SELECT graph, 0.4 + CASE WHEN source_file <> '' THEN 0.4 ELSE 0 END + CASE WHEN artifact_type IS NOT NULL THEN 0.2 ELSE 0 END FROM ch) +++ SELECT graph, round(greatest(0.2, least(1.0, sum(p)::DOUBLE / count(*))), 6)::DOUBLE AS confidence FROM p GROUP BY 1""")
add("ask01_intents", lambda t: review.question_intents(t.documents), "", r"""q AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '([A-Z][^.?!\n]{5,}\?)', 1))) AS q FROM documents WHERE text IS NOT NULL)
  +++ SELECT doc_id, CASE WHEN regexp_matches(q, 'incident|outage|alert') THEN 'incident' WHEN regexp_matches(q, 'impact|affect|break|downstream') THEN 'impact' WHEN regexp_matches(q, 'rule|baseline|layer|violat') THEN 'guardrail' WHEN regexp_matches(q, 'test|suite|coverage') THEN 'test' ELSE 'component' END AS intent, count(*) AS n FROM q GROUP BY ALL""")
QUERIES, SQL = CATALOG.queries, CATALOG.sql
