"""Whole analyses and the rows around them (drivers, guardrails, preconditions, live impact, factors, reports)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.graph import is_test, path_of
from graphloom.operators import conformance, impact
from graphloom.operators.graph import adjacency, nodes, once, placeholder_map
from graphloom.operators.review import live_changes
from graphloom.operators.traversal import components, plain_links, reach
from graphloom.session import checkpointed
from graphloom.sources.baseline import Baseline

#: Names of the propagation rules; other types get RULE_ and their name.
RULE_NAMES = {
    "CALLS": "RULE_CALLS_CALLER_IMPACT", "IMPORTS": "RULE_IMPORTS_IMPORTER_IMPACT", "DEPENDS_ON": "RULE_DEPENDS_ON_DEPENDENT_IMPACT", "CONSUMES": "RULE_CONSUMES_CLIENT_IMPACT", "EXTENDS": "RULE_EXTENDS_SUBCLASS_IMPACT",
    "IMPLEMENTS": "RULE_IMPLEMENTS_IMPL_IMPACT", "PERSISTS_TO": "RULE_PERSISTS_TO_DATA_IMPACT", "EXPOSES": "RULE_EXPOSES_API_IMPACT", "TESTS": "RULE_TESTS_TEST_IMPACT", "PARTICIPATES_IN": "RULE_PARTICIPATES_PROCESS_IMPACT", "TRANSITIONS_TO": "RULE_TRANSITIONS_STATE_IMPACT",
}
#: Analyzers by language.
ANALYZERS = {"python": "syntax_tree", "java": "java_lines", "typescript": "script_lines", "javascript": "script_lines", "cobol": "cobol_lines", "c": "native_lines", "cpp": "native_lines", "sql": "sql_lines", "plsql": "sql_lines", "dockerfile": "docker_lines"}
#: Folders that tell how a tree is organised.
SIGNALS = {"services": ["services", "apps", "microservices", "packages"], "frontend": ["frontend", "client", "ui", "web"], "backend": ["backend", "server", "api", "core"], "library": ["lib", "src"]}


def _named(value: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value)


def rule_of(rel: Column) -> Column:
    """TRV-03: name of the rule of a relationship type."""
    return F.coalesce(_named(F.upper(rel), RULE_NAMES), F.concat(F.lit("RULE_"), F.upper(rel)))


def analyzer_of(language: Column) -> Column:
    """EXT-09, DSC-09: the analyzer a file's language calls for; null if there is none."""
    return _named(F.lower(language), ANALYZERS)


def snapshot_rows(rows: DataFrame, snapshot_id: str) -> DataFrame:
    """SRC-13: all rows of one snapshot; on data partitioned by ``snapshot_id`` only its partition is read."""
    return rows.where(F.col("snapshot_id") == snapshot_id)


def scoped(rows: DataFrame, repositories: list[str]) -> DataFrame:
    """FLT-20, FLT-09: rows of the repositories a caller may see."""
    return rows.where(F.col("repository_id").isin(repositories))


def analyze(snapshots: DataFrame, artifacts: DataFrame, edges: DataFrame, external: DataFrame, max_depth: int = 5) -> dict[str, DataFrame]:
    """TRV-06: the whole impact analysis: ``changes``, ``findings``, ``paths``, ``summary``; the summary has a status per pair.

    Pairs whose snapshots do not differ are in the summary as VERIFIED_ZERO, others as DETECTED or, without anything affected, CONTAINED.
    """
    from graphloom.operators.snapshot_changes import snapshot_pairs

    every = nodes(artifacts, external)
    changes = checkpointed(impact.change_set(snapshots, artifacts))
    findings = impact.impact_findings(changes, edges, placeholder_map(artifacts, external), max_depth)
    summary = snapshot_pairs(snapshots).select(F.col("snapshot_id").alias("pair")).join(impact.impact_summary(changes, findings, every), "pair", "left")
    counts = [c for c in summary.columns if c != "pair"]
    summary = summary.select("pair", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    status = F.when(F.col("changed") == 0, "VERIFIED_ZERO").when(F.col("unique_affected") > 0, "DETECTED").otherwise("CONTAINED")
    return {"changes": changes, "findings": findings, "paths": impact.impact_paths(findings, every), "summary": summary.withColumn("status", status)}


def preconditions(pairs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """DIF-08: whether a pair (``base_id, target_id``) may be compared, and if not the first reason."""
    row = lambda p: once(snapshots).select(F.col("id").alias(f"{p}_id"), F.struct("repository_id", "commit_hash", F.element_at("snapshot_metadata", "status").alias("status")).alias(p))
    both = pairs.join(row("base"), "base_id", "left").join(row("target"), "target_id", "left")
    reason = F.when(F.col("base").isNull() | F.col("target").isNull(), "UNKNOWN_SNAPSHOT").when(F.col("base.repository_id") != F.col("target.repository_id"), "DIFFERENT_REPOSITORY").when((F.col("base.status") != "READY") | (F.col("target.status") != "READY"), "NOT_READY").when(F.col("base.commit_hash") == F.col("target.commit_hash"), "SAME_COMMIT")
    return both.select("base_id", "target_id", F.coalesce(reason, F.lit("OK")).alias("verdict"))


def caller_scores(roots: DataFrame, edges: DataFrame, node_table: DataFrame, max_depth: int | None = None) -> DataFrame:
    """TRV-09: per root its direct and transitive callers and a score of at most 60 for callers plus 15 per endpoint."""
    found = reach(roots, adjacency(edges, {"CALLS": ("reverse", 1.0, True)}), max_depth).where("depth > 0")
    kinds = node_table.select(F.col("id").alias("node"), (F.col("artifact_type") == "API_ENDPOINT").alias("api"))
    sums = found.join(kinds, "node").groupBy("graph", "root").agg(F.count(F.lit(1)).alias("callers"), F.count_if("api").alias("endpoints"))
    score = F.least(10 * F.col("callers"), F.lit(60)) + 15 * F.col("endpoints")
    return sums.withColumn("score", score).withColumn("risk", F.when(F.col("score") > 75, "CRITICAL").when(F.col("score") > 50, "HIGH").when(F.col("score") > 25, "MEDIUM").otherwise("LOW"))


def guardrails(artifacts: DataFrame, edges: DataFrame, node_table: DataFrame, baseline: Baseline | None) -> DataFrame:
    """ARC-03: per snapshot the guardrails that are hit: layer rules (or inversions without a baseline), cycles, coupling, test debt.

    ``n`` of CYCLES is the number of cyclic components (of cycles of any length), which is exact; the number of simple cycles is exponential.
    """
    from graphloom.operators.structure import fan_outs

    def counted(rows: DataFrame, name: str, status: str) -> DataFrame:
        return rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).select("snapshot_id", F.lit(name).alias("guardrail"), F.lit(status).alias("status"), "n")

    layers = conformance.drift(edges, node_table, baseline) if baseline is not None else conformance.inversions(edges, node_table)
    loops = components(plain_links(edges, ["CALLS", "IMPORTS", "DEPENDS_ON", "REFERENCES"])).where("node = component").withColumnRenamed("graph", "snapshot_id")
    debt = conformance.test_debt(artifacts, edges).where("verdict <> 'PASS'").select("snapshot_id", F.lit("TEST_DEBT").alias("guardrail"), F.col("verdict").alias("status"), F.col("untested").alias("n"))
    parts = [counted(layers, "LAYERS", "VIOLATION"), counted(loops, "CYCLES", "VIOLATION"), counted(fan_outs(artifacts, edges), "COUPLING", "WARN"), debt]
    return reduce(DataFrame.unionByName, parts)


def architecture_factors(rails: DataFrame) -> DataFrame:
    """RSK-04: per snapshot 100 with a critical violation, 80 with another one, 40 with a warning only. Rails may name a ``severity``."""
    critical = F.upper("severity") == "CRITICAL" if "severity" in rails.columns else F.lit(False)
    return rails.groupBy("snapshot_id").agg(F.max(F.when((F.col("status") == "VIOLATION") & F.coalesce(critical, F.lit(False)), 100.0).when(F.col("status") == "VIOLATION", 80.0).otherwise(40.0)).alias("factor"))


#: Weights of the factors of a change.
WEIGHTS = {"IMPACT_BREADTH": 1.1, "IMPACT_DEPTH": 0.8, "TEST_IMPACT": 1.2, "ARCHITECTURE": 1.5, "COUPLING": 1.0, "RUNTIME": 1.0, "INCIDENTS": 1.0, "API_SURFACE": 1.2, "UNKNOWN_EVIDENCE": 0.6}


def evidence_factors(relevant: DataFrame, events: DataFrame, incidents: DataFrame, latest_events: int = 50, latest_incidents: int = 20, judged: int = 4) -> DataFrame:
    """RSK-06, RSK-07: ``pair, factor, score, applies`` from what happened to the changed and affected nodes (``pair, node``) of a pair.

    The latest ``latest_events`` distinct events by arrival: an error 90, one in production 70, any 40, none 0. The latest ``latest_incidents`` incidents by the time of
    their record: a critical one among the first ``judged`` 90, others 60, none does not apply. Ties go by id. The limits are what a report looks at.
    """
    first = events.where("event_id is not null").groupBy("event_id").agg(F.min(F.struct("ingested_at", "component_artifact_id", "severity", "environment")).alias("e"))
    ran = first.select(F.col("e.component_artifact_id").alias("node"), F.col("event_id").alias("id"), F.col("e.ingested_at").alias("at"), F.upper("e.severity").alias("severity"), "e.environment")
    hit = once(incidents).select(F.col("affected_component_id").alias("node"), "id", F.col("created_at").alias("at"), F.upper("severity").alias("severity"))
    newest = lambda rows, most: relevant.join(rows, "node").withColumn("n", F.row_number().over(W.partitionBy("pair").orderBy(F.desc_nulls_last("at"), "id"))).where(F.col("n") <= most)
    runtime = newest(ran, latest_events).groupBy("pair").agg(F.max(F.when(F.col("severity").isin("ERROR", "CRITICAL"), 90.0).when(F.col("environment") == "production", 70.0).otherwise(40.0)).alias("runtime"))
    found = newest(hit, latest_incidents).groupBy("pair").agg(F.max(F.when((F.col("severity") == "CRITICAL") & (F.col("n") <= judged), 90.0).otherwise(60.0)).alias("incidents"))
    rows = relevant.select("pair").distinct().join(runtime, "pair", "left").join(found, "pair", "left")
    entries = F.array(F.struct(F.lit("RUNTIME").alias("factor"), F.coalesce("runtime", F.lit(0.0)).alias("score"), F.lit(True).alias("applies")), F.struct(F.lit("INCIDENTS").alias("factor"), F.coalesce("incidents", F.lit(0.0)).alias("score"), F.col("incidents").isNotNull().alias("applies")))
    return rows.select("pair", F.explode(entries).alias("f")).select("pair", "f.*")


def all_factors(factors: DataFrame, rails: DataFrame, coupling: DataFrame, interface: DataFrame, unknown: DataFrame, evidence: DataFrame) -> DataFrame:
    """RSK-10: the nine factors of each pair that has ``factors``: those, and the ones given per snapshot or pair."""
    pairs = factors.select("pair").distinct()
    one = lambda rows, name, otherwise: pairs.join(rows, "pair", "left").select("pair", F.lit(name).alias("factor"), F.coalesce(F.col("factor").cast("double"), F.lit(otherwise)).alias("score"), F.lit(True).alias("applies"))
    parts = [
        factors.select("pair", "factor", F.col("score").cast("double").alias("score"), "applies"),
        one(architecture_factors(rails).withColumnRenamed("snapshot_id", "pair"), "ARCHITECTURE", 0.0),
        one(coupling.select("pair", "factor"), "COUPLING", 0.0),
        one(interface.select("pair", "factor"), "API_SURFACE", 0.0),
        one(unknown.select("pair", "factor"), "UNKNOWN_EVIDENCE", 0.0),
        evidence.join(pairs, "pair", "left_semi").select("pair", "factor", "score", "applies"),
    ]
    return reduce(DataFrame.unionByName, parts)


def risk_factors(summary: DataFrame, selection: DataFrame) -> DataFrame:
    """RSK-01, RSK-02, RSK-03: ``pair, factor, score, applies`` of each pair.

    Breadth by the number changed and affected, depth by the longest path, tests by those to run (45 where none is mapped).
    Breadth and depth of 0 do not apply.
    """
    rows = summary.join(selection.select("pair", F.col("direct").alias("t_direct"), (F.col("to_run") - F.col("direct")).alias("t_indirect"), (F.col("to_run") + F.col("to_skip")).alias("mapped")), "pair", "left")
    n, d = F.col("changed") + F.col("direct") + F.col("indirect"), F.col("max_depth")
    breadth = F.when(n == 0, 0.0).when(n <= 3, 20.0).when(n <= 8, 50.0).when(n <= 15, 75.0).otherwise(95.0)
    depth = F.when(d == 0, 0.0).when(d == 1, 15.0).when(d == 2, 40.0).when(d == 3, 70.0).otherwise(90.0)
    tests = F.when(F.coalesce("mapped", F.lit(0)) == 0, 45.0).otherwise(F.least(F.lit(60.0), 15.0 * F.col("t_direct") + 5.0 * F.col("t_indirect")))
    entries = [F.struct(F.lit(name).alias("factor"), score.alias("score"), applies.alias("applies")) for name, score, applies in (("IMPACT_BREADTH", breadth, n > 0), ("IMPACT_DEPTH", depth, d > 0), ("TEST_IMPACT", tests, F.lit(True)))]
    return rows.select("pair", F.explode(F.array(*entries)).alias("f")).select("pair", "f.*")


def combined_risk(factors: DataFrame) -> DataFrame:
    """RSK-10: per pair the weighted mean of the factors that apply, and its category; an unknown factor is an error.

    CRITICAL from 75, with a critical guardrail (an architecture score of 100), or where a broad change (breadth from 70) of live parts (runtime from 70) violates a guardrail (architecture
    from 80); HIGH from 50, with any violation, broad and live, or breadth from 75; MODERATE from 25 or breadth from 40.
    """
    known = _named(F.col("factor"), {k: str(v) for k, v in WEIGHTS.items()}).cast("double")
    weight = F.coalesce(known, F.raise_error(F.concat(F.lit("no weight for factor "), F.col("factor"))).cast("double"))
    of = lambda name: F.coalesce(F.max(F.when(F.col("factor") == name, F.col("score"))), F.lit(0.0))
    sums = factors.where("applies").groupBy("pair").agg(F.round(F.sum(F.col("score") * weight) / F.sum(weight), 6).alias("score"), of("IMPACT_BREADTH").alias("breadth"), of("RUNTIME").alias("runtime"), of("ARCHITECTURE").alias("architecture"))
    broad = (F.col("breadth") >= 70) & (F.col("runtime") >= 70)
    violated = F.col("architecture") >= 80
    category = F.when((F.col("architecture") >= 100) | (F.col("score") >= 75) | broad & violated, "CRITICAL").when(violated | (F.col("score") >= 50) | broad | (F.col("breadth") >= 75), "HIGH").when((F.col("score") >= 25) | (F.col("breadth") >= 40), "MODERATE").otherwise("LOW")
    return sums.select("pair", "score", category.alias("category"))


def factor_buckets(factors: DataFrame) -> DataFrame:
    """RSK-13: factors (``pair, factor, score``) summed by bucket: tests, guardrails, incidents, structure."""
    name = F.upper("factor")
    bucket = F.when(name.contains("TEST") | (name == "UNKNOWN_EVIDENCE"), "tests").when(name.contains("GUARDRAIL") | name.contains("ARCHITECTURE"), "guardrails").when(name.contains("INCIDENT") | name.contains("RUNTIME"), "incidents").otherwise("structure")
    return factors.groupBy("pair", bucket.alias("bucket")).agg(F.sum("score").alias("score"))


def unknown_evidence(confidence: DataFrame, selection: DataFrame) -> DataFrame:
    """RSK-09: 25 points per missing kind of evidence (mapped tests, runtime events), at most 100."""
    rows = confidence.join(selection.select("pair", (F.col("to_run") + F.col("to_skip")).alias("mapped")), "pair", "left")
    no_tests = (F.coalesce("mapped", F.lit(0)) == 0).cast("int")
    missing = no_tests + F.when(F.col("confidence") + 0.35 * no_tests < 0.9, 1).otherwise(0)
    return rows.select("pair", F.least(F.lit(100), 25 * missing).alias("factor"))


def live_impact(files: DataFrame, hunks: DataFrame, artifacts: DataFrame, edges: DataFrame, snapshot_id: str, max_depth: int = 5) -> DataFrame:
    """MSC-06: what uncommitted changes affect on the graph of their base snapshot: ``root, node, depth``."""
    base = snapshot_rows(artifacts, snapshot_id)
    changed = live_changes(files, hunks, base).select(F.lit(snapshot_id).alias("graph"), F.col("artifact_id").alias("root"))
    return reach(changed, adjacency(snapshot_rows(edges, snapshot_id)), max_depth).where("depth > 0").select("root", "node", "depth")


def scenario_verdicts(predicted: DataFrame, expected: DataFrame, excluded: DataFrame) -> DataFrame:
    """EVL-03: per scenario (``case_id``): expected names found in some predicted one, and negative controls that were hit.

    A name is found if it is part of a predicted one; predictions and names meet per case only.
    """
    hits = lambda wanted, label: wanted.distinct().join(predicted.select("case_id", F.col("entity").alias("p")).distinct(), "case_id", "left").groupBy("case_id", "entity").agg(F.coalesce(F.bool_or(F.col("p").contains(F.col("entity"))), F.lit(False)).alias("hit")).groupBy("case_id").agg(F.count(F.lit(1)).alias(f"{label}_all"), F.count_if("hit").alias(f"{label}_hit"))
    rows = hits(expected, "expected").join(hits(excluded, "excluded"), "case_id", "full_outer").na.fill(0)
    return rows.withColumn("passed", (F.col("expected_all") == F.col("expected_hit")) & (F.col("excluded_hit") == 0))


def label_set(scenarios: DataFrame) -> DataFrame:
    """MSC-14: labels from scenarios (``case_id, direct, indirect, tests`` as arrays): one row per entity and label."""
    kinds = F.array(*(F.struct(F.lit(k.upper()).alias("label"), F.coalesce(k, F.array().cast("array<string>")).alias("names")) for k in ("direct", "indirect", "tests")))
    return scenarios.select("case_id", F.explode(kinds).alias("k")).select("case_id", "k.label", F.explode("k.names").alias("entity")).where("entity is not null").distinct()


def full_prediction(changes: DataFrame, links: DataFrame, max_depth: int = 5) -> DataFrame:
    """MSC-13: the full algorithm as a fourth baseline: changed and affected nodes per pair, with the sum and the greatest of their depths; one traversal per pair."""
    best = impact.reached_per_pair(changes, links, max_depth).groupBy(F.col("root").alias("pair"), "node").agg(F.min("depth").alias("depth"))
    return best.groupBy("pair").agg(F.count(F.lit(1)).alias("nodes"), F.sum("depth").alias("depths"), F.max("depth").alias("max_depth"))


def file_metrics(artifacts: DataFrame) -> DataFrame:
    """MSC-05: per snapshot: files, lines and test lines (of files with a test or ``test`` in their path)."""
    test = is_test(F.col("artifact_type"), F.col("location"), F.col("name")) | F.lower(F.coalesce("location", F.lit(""))).contains("test")
    rows = once(artifacts).groupBy("snapshot_id", path_of("location").alias("file")).agg(F.max("line_end").alias("lines"), F.max(test.cast("int")).alias("test"))
    return rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum(F.col("lines") * F.col("test")).alias("test_lines"))


def organisation(artifacts: DataFrame) -> DataFrame:
    """DSC-08: per snapshot the signals that its top folders give."""
    top = F.lower(F.split_part(path_of("location"), F.lit("/"), F.lit(1)))
    signal = F.array_compact(F.array(*(F.when(F.col("top").isin(v), k) for k, v in SIGNALS.items())))
    rows = once(artifacts).select("snapshot_id", top.alias("top")).distinct()
    return rows.select("snapshot_id", "top", F.explode(signal).alias("signal")).groupBy("snapshot_id", "signal").agg(F.array_join(F.array_sort(F.collect_set("top")), ",").alias("folders"))


def entry_files(artifacts: DataFrame) -> DataFrame:
    """DSC-11: files whose name says that a program starts there."""
    name = F.lower(F.element_at(F.split(path_of("location"), "/"), -1))
    return once(artifacts).where(name.rlike(r"^(main|app|index|server|run|manage|cli)\.")).select("snapshot_id", path_of("location").alias("file")).distinct()


def latest_per_repository(results: DataFrame, order: str) -> DataFrame:
    """MSC-07: the newest row of each repository."""
    return results.withColumn("_k", F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def markdown(summary: DataFrame) -> DataFrame:
    """SNK-07, MSC-17: an impact summary as one Markdown text per pair."""
    lines = [F.concat(F.lit("# Impact of "), "pair"), F.lit("")] + [F.concat(F.lit(f"- {label}: "), F.col(c).cast("string")) for label, c in (("changed", "changed"), ("direct", "direct"), ("indirect", "indirect"), ("tests", "n_test"), ("endpoints", "n_api"), ("deepest path", "max_depth"))]
    return summary.select("pair", F.concat_ws("\n", *lines).alias("report"))


def scenario_plans(texts: DataFrame) -> DataFrame:
    """SIM-09: ``ident, intent, target`` of change requests in words (``ident, text``): capacity before removal, dependency, interface, change.

    The target is the first quoted name, else a file name, else an identifier with a dot, underscore or inner capital; null if none is named.
    """
    low = F.lower("text")
    intent = F.when(low.rlike(r"traffic|load|capacity|spike|concurren"), "CAPACITY_LOAD_SPIKE").when(low.rlike(r"remov|delet|drop|outage|shut"), "REMOVE_COMPONENT").when(low.rlike(r"depend|import|connect"), "ADD_DEPENDENCY").when(low.rlike(r"\bapi\b|endpoint|route"), "MODIFY_API").otherwise("MODIFY_SYMBOL")
    first = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    target = F.coalesce(first(r"[\"'`]([^\"'`]+)[\"'`]"), first(r"\b([\w/-]+\.(?:py|ts|js|java|go|sql|cbl))\b"), first(r"\b([A-Za-z]\w*(?:[._]\w+)+)"), first(r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)\b"))
    status = F.when(intent == "CAPACITY_LOAD_SPIKE", "NOT_EVALUATED").when(target.isNull(), "UNRESOLVED").otherwise("PLANNED")
    return texts.where("text is not null").select("ident", intent.alias("intent"), target.alias("target"), status.alias("status"))
