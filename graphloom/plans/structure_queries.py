"""Aggregates and rankings over all snapshots."""

from __future__ import annotations

from graphloom.functions.graph import CLUSTER_PATTERNS
from graphloom.operators import impact, structure
from graphloom.operators.snapshot_changes import snapshot_changes
from graphloom.plans.catalog import Catalog
from graphloom.plans.impact_queries import _CHANGES, _DEGREES, _IS_TEST
from graphloom.plans.preparation import _CHANGES as _DIFF

CATALOG = Catalog()
add = CATALOG.add
_FILE = "split_part(replace(location, '\\', '/'), ':', 1)"
_AT = "lower(coalesce(location, qualified_name, ''))"
_CLUSTER = (
    "clu AS (SELECT id, snapshot_id, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains({_AT}, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in CLUSTER_PATTERNS.items())
    + f" WHEN artifact_type IN ('API_ENDPOINT', 'HTTP_ROUTE') THEN 'api' WHEN artifact_type IN ('DATABASE_ENTITY', 'TABLE') THEN 'data' WHEN artifact_type IN ('SERVICE', 'CLASS') THEN 'service' WHEN regexp_matches({_AT}, 'main|server|index|app') THEN 'application' ELSE 'utility' END AS cluster, {_FILE} AS file FROM art)"
)
_TESTED = "tested AS (SELECT DISTINCT target_artifact_id AS id FROM edge WHERE upper(relationship_type) = 'TESTS')"

add("agg01_type_counts", lambda t: structure.type_counts(t.artifacts, t.edges), "art edge", "+++ SELECT snapshot_id, 'artifact' AS entity, artifact_type AS kind, count(*) AS n FROM art GROUP BY ALL UNION ALL SELECT snapshot_id, 'edge', relationship_type, count(*) FROM edge GROUP BY ALL")
add("agg02_overview", lambda t: structure.overview(t.artifacts, t.edges), "art edge", f"e AS (SELECT snapshot_id, count(*) AS n FROM edge GROUP BY 1), a AS (SELECT snapshot_id, count(*) AS artifacts, count(DISTINCT {_FILE}) AS files, count(*) FILTER (artifact_type = 'TEST_CASE') AS tests, count(*) FILTER (artifact_type = 'API_ENDPOINT') AS endpoints, sum(CASE WHEN line_end >= line_start THEN line_end - line_start + 1 ELSE 0 END)::BIGINT AS lines FROM art GROUP BY 1) +++ SELECT a.*, coalesce(e.n, 0) AS edges FROM a LEFT JOIN e USING (snapshot_id)")
add(
    "agg03_packages",
    lambda t: structure.packages(t.artifacts),
    "art",
    f"""p AS (SELECT *, {_FILE} AS file, CASE WHEN contains({_FILE}, '/') THEN split_part({_FILE}, '/', 1) WHEN contains(qualified_name, '.') THEN split_part(qualified_name, '.', 1) ELSE 'root' END AS package FROM art),
    f AS (SELECT snapshot_id, package, string_agg(name, ',' ORDER BY name) AS sample FROM (SELECT DISTINCT snapshot_id, package, name FROM p) GROUP BY ALL),
    s AS (SELECT snapshot_id, package, name FROM (SELECT DISTINCT snapshot_id, package, name FROM p) QUALIFY row_number() OVER (PARTITION BY snapshot_id, package ORDER BY name) <= 3)
    +++ SELECT p.snapshot_id, p.package, count(*) AS total, count(*) FILTER (artifact_type = 'CLASS') AS classes, count(*) FILTER (artifact_type IN ('FUNCTION', 'METHOD')) AS functions, count(*) FILTER (artifact_type = 'MODULE') AS modules, count(DISTINCT file) AS files,
      (SELECT string_agg(s.name, ',' ORDER BY s.name) FROM s WHERE s.snapshot_id = p.snapshot_id AND s.package = p.package) AS sample FROM p GROUP BY p.snapshot_id, p.package""",
)
add("agg04_language_share", lambda t: structure.language_share(t.artifacts), "art", "l AS (SELECT snapshot_id, coalesce(nullif(lower(language), ''), 'unknown') AS language, count(*) AS symbols FROM art GROUP BY ALL) +++ SELECT *, 100 * symbols / sum(symbols) OVER (PARTITION BY snapshot_id) AS share FROM l")
add("agg05_scan_rhythm", lambda t: structure.scan_rhythm(t.snapshots), "snap", "+++ SELECT repository_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, (isodow(created_at AT TIME ZONE 'UTC') - 1)::INT AS weekday, (hour(created_at AT TIME ZONE 'UTC') // 4)::BIGINT AS bucket, count(*) AS n FROM snap GROUP BY ALL")
add(
    "agg06_activity_tags",
    lambda t: structure.activity_tags(t.snapshots),
    "snap",
    """x AS (SELECT repository_id, hour(created_at AT TIME ZONE 'UTC') AS h, isodow(created_at AT TIME ZONE 'UTC') - 1 AS d FROM snap WHERE created_at IS NOT NULL),
    s AS (SELECT repository_id, count(*) AS n, avg((h >= 22)::INT) AS night, avg((h >= 5 AND h < 9)::INT) AS early, avg((d >= 5)::INT) AS weekend, avg((h >= 9 AND h < 17 AND d < 5)::INT) AS office FROM x GROUP BY 1 HAVING count(*) >= 3)
    +++ SELECT repository_id, n, coalesce(nullif(concat_ws(',', CASE WHEN night >= 0.3 THEN 'night' END, CASE WHEN early >= 0.2 THEN 'early' END, CASE WHEN weekend >= 0.25 THEN 'weekend' END, CASE WHEN office >= 0.4 THEN 'office' END), ''), 'steady') AS tags FROM s""",
)
add("agg07_churn", lambda t: structure.churn(snapshot_changes(t.snapshots, t.artifacts)), "", _DIFF.strip().removeprefix("WITH") + "+++ SELECT *, greatest(0, added - removed) AS net, CASE WHEN added > 0 THEN least(100.0::DOUBLE, 100 * removed / added) ELSE 0.0::DOUBLE END AS removed_per_added FROM (SELECT snapshot_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed FROM changes GROUP BY 1)")
add(
    "agg08_scale",
    lambda t: structure.scale(t.snapshots, t.artifacts),
    "snap",
    """loc AS (SELECT snapshot_id, CAST(sum(n) AS BIGINT) AS n_lines FROM (SELECT snapshot_id, split_part(replace(location, '\\', '/'), ':', 1) AS file, max(line_end) AS n FROM artifacts WHERE line_end IS NOT NULL GROUP BY ALL) GROUP BY 1)
    +++ SELECT s.id AS snapshot_id, n_lines, CASE WHEN n_lines < 1000 THEN 'tiny' WHEN n_lines < 10000 THEN 'small' WHEN n_lines < 50000 THEN 'medium' WHEN n_lines < 250000 THEN 'large' WHEN n_lines IS NOT NULL THEN 'huge' END AS scale FROM snap s LEFT JOIN loc ON loc.snapshot_id = s.id""",
)
add(
    "agg09_code_ratios",
    lambda t: structure.code_ratios(t.artifacts, t.edges),
    "art edge",
    """a AS (SELECT snapshot_id, count(*) AS n, count(*) FILTER (c) AS calls, count(*) FILTER (c AND trim(coalesce(docstring, '')) <> '') AS documented, count(*) FILTER (c AND metadata['async'] IS NOT NULL) AS asynchronous, count(*) FILTER (artifact_type = 'TEST_CASE') AS tests
      FROM (SELECT *, artifact_type IN ('FUNCTION', 'METHOD', 'CONSTRUCTOR') AS c FROM art) GROUP BY 1), e AS (SELECT snapshot_id, count(*) AS edges FROM edge GROUP BY 1)
    +++ SELECT snapshot_id, coalesce(documented / nullif(calls, 0), 0) AS documented_share, coalesce(asynchronous / nullif(calls, 0), 0) AS async_share, coalesce(edges, 0) / n AS coupling, 100 * tests / n AS tests_per_100 FROM a LEFT JOIN e USING (snapshot_id)""",
)
add("agg10_most_changed_files", lambda t: structure.most_changed_files(impact.change_set(t.snapshots, t.artifacts)), "art pair", _CHANGES + "f AS (SELECT pair, source_file, count(*) AS n FROM ch GROUP BY ALL) +++ SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY pair ORDER BY n DESC, source_file) = 1")
add("agg11_clusters", lambda t: structure.clusters(t.artifacts), "art", _CLUSTER + "+++ SELECT *, greatest(3.2::DOUBLE, least(10::DOUBLE, 8.5::DOUBLE - CASE WHEN symbols > 100 THEN 2.0 WHEN symbols > 40 THEN 1.0 ELSE 0.0 END - CASE WHEN cluster IN ('service', 'api') AND symbols > 15 THEN 1.5 ELSE 0.0 END)) AS health FROM (SELECT snapshot_id, cluster, count(*) AS symbols, count(DISTINCT file) AS files FROM clu GROUP BY ALL)")
add("agg12_cluster_edges", lambda t: structure.cluster_edges(t.artifacts, t.edges), "art edge", _CLUSTER + "+++ SELECT snapshot_id, source, target, n, least(8, greatest(1, floor(log2(n + 1) + 0.5)::INT)) AS weight FROM (SELECT e.snapshot_id, a.cluster AS source, b.cluster AS target, count(*) AS n FROM edge e JOIN clu a ON a.id = e.source_artifact_id JOIN clu b ON b.id = e.target_artifact_id WHERE a.cluster <> b.cluster GROUP BY ALL)")
add("agg13_file_health", lambda t: structure.file_health(t.artifacts, t.edges), "art edge", _TESTED + f"+++ SELECT *, greatest(1.2::DOUBLE, least(9.8::DOUBLE, 8.5::DOUBLE - CASE WHEN lines > 1000 THEN 2.5 WHEN lines > 400 THEN 1.5 ELSE 0.0 END - CASE WHEN reached = 0 THEN 2.0 ELSE 0.0 END)) AS health FROM (SELECT snapshot_id, {_FILE} AS file, max(line_end) AS lines, count(*) AS symbols, max((x.id IS NOT NULL)::INT) AS reached FROM art a LEFT JOIN tested x ON x.id = a.id GROUP BY ALL)")
add(
    "agg14_test_coverage",
    lambda t: structure.test_coverage(t.artifacts, t.edges),
    "art edge",
    _TESTED + f""", s AS (SELECT snapshot_id, count(*) FILTER (t) AS tests, count(*) FILTER (NOT t AND hit) AS tested, count(*) FILTER (NOT t) AS testable FROM (SELECT a.snapshot_id, coalesce({_IS_TEST}, false) AS t, x.id IS NOT NULL AS hit FROM art a LEFT JOIN tested x ON x.id = a.id) GROUP BY 1),
    r AS (SELECT *, coalesce(tested / nullif(testable, 0), 0) AS ratio FROM s) +++ SELECT *, CASE WHEN tests = 0 THEN 'NONE' WHEN ratio >= 0.5 THEN 'GOOD' WHEN ratio >= 0.1 THEN 'PARTIAL' ELSE 'LOW' END AS status FROM r""",
)
add("agg15_folders", lambda t: structure.folders(t.artifacts), "art", f"f AS (SELECT snapshot_id, regexp_replace({_FILE}, '/[^/]*$', '') AS folder, count(*) AS symbols FROM art GROUP BY ALL) +++ SELECT *, (row_number() OVER (PARTITION BY snapshot_id ORDER BY symbols DESC, folder))::INT AS rank FROM f QUALIFY rank <= 10")
add("agg23_incident_counts", lambda t: structure.incident_counts(t.incidents), "inc", "+++ SELECT lower(severity) AS severity, status, count(*) AS n FROM inc GROUP BY ALL")
add(
    "top01_records",
    lambda t: structure.top_records(t.artifacts, t.edges),
    "art edge",
    _DEGREES + """, longest AS (SELECT snapshot_id, 'longest_symbol' AS record, id AS holder, (line_end - line_start + 1)::BIGINT AS value FROM art WHERE line_end >= line_start QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY line_end - line_start DESC, id) = 1),
    named AS (SELECT snapshot_id, 'longest_name' AS record, name AS holder, length(name) AS value FROM art WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY length(name) DESC, name) = 1),
    counted AS (SELECT snapshot_id, name, count(*) AS n FROM art WHERE length(name) > 2 GROUP BY ALL HAVING count(*) > 1),
    reused AS (SELECT snapshot_id, 'most_reused_name' AS record, name AS holder, n AS value FROM counted QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY n DESC, name) = 1),
    linked AS (SELECT d.snapshot_id, 'most_connected' AS record, d.id AS holder, (edges_in + edges_out)::BIGINT AS value FROM deg d JOIN art a ON a.id = d.id WHERE a.artifact_type NOT IN ('MODULE', 'PACKAGE') QUALIFY row_number() OVER (PARTITION BY d.snapshot_id ORDER BY edges_in + edges_out DESC, d.id) = 1)
    +++ SELECT * FROM longest UNION ALL SELECT * FROM named UNION ALL SELECT * FROM reused UNION ALL SELECT * FROM linked""",
)
add("top02_hubs", lambda t: structure.hubs(t.artifacts, t.edges), "art edge", _DEGREES + "+++ SELECT d.snapshot_id, d.id, a.name, (edges_in + edges_out)::BIGINT AS degree, (row_number() OVER (PARTITION BY d.snapshot_id ORDER BY edges_in + edges_out DESC, d.id))::INT AS rank FROM deg d JOIN art a ON a.id = d.id QUALIFY rank <= 8")
add("top03_fan_outs", lambda t: structure.fan_outs(t.artifacts, t.edges), "art edge", _DEGREES + "+++ SELECT d.snapshot_id, d.id, a.qualified_name, fan_out::BIGINT AS fan_out FROM deg d JOIN art a ON a.id = d.id WHERE fan_out >= 8")
add("msc01_snapshot_list", lambda t: structure.snapshot_list(t.snapshots, t.artifacts, t.edges), "snap art edge", "a AS (SELECT snapshot_id AS id, count(*) AS n FROM art GROUP BY 1), e AS (SELECT snapshot_id AS id, count(*) AS n FROM edge GROUP BY 1) +++ SELECT s.id AS snapshot_id, s.repository_id, s.created_at, coalesce(a.n, 0) AS n_artifacts, coalesce(e.n, 0) AS n_edges, coalesce(snapshot_metadata['status'], CASE WHEN a.n IS NULL THEN 'NEEDS_REINDEX' WHEN e.n IS NULL THEN 'INCOMPLETE_DATA' ELSE 'READY' END) AS status FROM snap s LEFT JOIN a ON a.id = s.id LEFT JOIN e ON e.id = s.id")
QUERIES, SQL = CATALOG.queries, CATALOG.sql
