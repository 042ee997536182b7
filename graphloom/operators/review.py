"""Per-change and per-component reviews built from the other operators (TST, RSK, ARC, INC, MSC rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.graph import is_test, path_of
from graphloom.functions.text import some
from graphloom.operators.graph import degrees, once
from graphloom.operators.traversal import forward_of, reach, reversed_all


def graph_changes(pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """DIF-05: nodes of two consecutive graphs: added, removed (id prefixed) or modified in lines or signature; hashes do not count."""
    roles = pairs.select(F.col("snapshot_id").alias("pair"), F.explode(F.array(F.struct(F.col("snapshot_id").alias("sid"), F.lit(True).alias("now")), F.struct(F.col("previous_id").alias("sid"), F.lit(False).alias("now")))).alias("r")).select("pair", F.col("r.sid").alias("snapshot_id"), "r.now")
    x = F.struct("id", "line_start", "line_end", F.coalesce("signature", F.lit("")).alias("signature"))
    rows = once(artifacts).select("snapshot_id", F.trim("qualified_name").alias("q"), x.alias("x")).join(roles, "snapshot_id").groupBy("pair", "q").agg(F.max(F.when(F.col("now"), F.col("x"))).alias("a"), F.max(F.when(~F.col("now"), F.col("x"))).alias("b"))
    differs = reduce(Column.__or__, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("line_start", "line_end", "signature")])
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(differs, "modified")
    node = F.when(F.col("a").isNull(), F.concat(F.lit("removed_"), "b.id")).otherwise(F.col("a.id"))
    return rows.select("pair", node.alias("node"), change.alias("change")).where("change is not null")


def live_changes(files: DataFrame, hunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """DIF-02, DIF-04: ``change_type, path, artifact_id, confidence`` from file states (``change_type, path, old_path``) and hunks (``path, first_line, last_line``).

    A removed file removes its symbols; a modified or renamed one changes the symbols its hunks overlap, or all of them without hunks; a
    file with no symbol concerned is an item of its own, ``file_`` plus the start of its path's hash.
    """
    symbols = once(artifacts).select(F.col("id").alias("artifact_id"), path_of("location").alias("at"), F.col("line_start").alias("low"), F.coalesce("line_end", "line_start").alias("high"))
    rows = files.withColumn("at", F.coalesce("old_path", "path"))
    removed = rows.where("change_type = 'REMOVED'").join(symbols, "at").select("change_type", "path", "artifact_id", F.lit(0.95).alias("confidence"))
    touched = rows.where("change_type in ('MODIFIED', 'RENAMED')")
    cut = touched.join(hunks, "path").join(symbols, "at").where((F.col("low") <= F.col("last_line")) & (F.col("high") >= F.col("first_line")))
    whole = touched.join(hunks.select("path"), "path", "left_anti").join(symbols, "at")
    found = removed.unionByName(cut.select("change_type", "path", "artifact_id", F.lit(0.95).alias("confidence"))).unionByName(whole.select("change_type", "path", "artifact_id", F.lit(0.85).alias("confidence"))).distinct()
    rest = rows.join(found.select("path"), "path", "left_anti").select("change_type", "path", F.concat(F.lit("file_"), F.substring(F.sha2("path", 256), 1, 12)).alias("artifact_id"), F.lit(0.9).alias("confidence"))
    return found.unionByName(rest)


def core_exposure(artifacts: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """TRV-12: for up to ``most`` classes and interfaces per snapshot (by id): nodes and depth reached by all reversed edges, flagged if wide or deep."""
    core = once(artifacts).where(F.col("artifact_type").isin("CLASS", "INTERFACE", "SERVICE", "COMPONENT"))
    starts = core.withColumn("k", F.row_number().over(W.partitionBy("snapshot_id").orderBy("id"))).where(F.col("k") <= most).select(F.col("snapshot_id").alias("graph"), F.col("id").alias("root"))
    sums = reach(starts, reversed_all(once(edges)), 5).groupBy("graph", "root").agg((F.count(F.lit(1)) - 1).alias("nodes"), F.max("depth").alias("depth"))
    return sums.withColumn("flagged", (F.col("nodes") >= 15) | (F.col("depth") >= 4))


def static_chains(artifacts: DataFrame, edges: DataFrame, entries: DataFrame, most: int = 5) -> DataFrame:
    """TRV-14: nodes reached from up to ``most`` entry points per snapshot along calls and imports, tests left out."""
    tests = once(artifacts).where(is_test(F.col("artifact_type"), F.col("location"), F.col("name"))).select(F.col("id").alias("dst"))
    starts = entries.withColumn("k", F.row_number().over(W.partitionBy("snapshot_id").orderBy("rank", "id"))).where(F.col("k") <= most).select(F.col("snapshot_id").alias("graph"), F.col("id").alias("root"))
    links = forward_of(once(edges), ["CALLS", "IMPORTS", "DEPENDS_ON"]).join(tests, "dst", "left_anti")
    return reach(starts, links, 4).groupBy("graph", "root").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))


def coverage_claims(changes: DataFrame, affected: DataFrame, direct: DataFrame, artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """TST-04, TST-05: per change a coverage claim and, where none is known, why.

    OBSERVED with a TESTS edge, INFERRED if its snapshot's tests are reached from it, else NO_TESTS_AT_ALL, CONFIGURATION, GENERATED, UNCALLED or UNKNOWN.
    ``direct``: ids of artifacts with a TESTS edge; ``affected``: roots from which a test is reached.
    """
    deg = degrees(edges).select(F.col("snapshot_id").alias("graph"), F.col("id").alias("artifact_id"), "fan_in")
    have = once(artifacts).where("artifact_type = 'TEST_CASE'").select(F.col("snapshot_id").alias("graph"), F.lit(True).alias("any_test")).distinct()
    rows = changes.join(direct.select(F.col("id").alias("artifact_id"), F.lit(True).alias("observed")).distinct(), "artifact_id", "left").join(affected.select(F.col("root").alias("artifact_id"), F.lit(True).alias("inferred")).distinct(), "artifact_id", "left").join(have, "graph", "left").join(deg, ["graph", "artifact_id"], "left")
    path = F.lower(F.coalesce("source_file", F.lit("")))
    claim = F.when(F.col("observed"), "OBSERVED").when(F.col("inferred"), "INFERRED").when(F.col("any_test").isNull(), "NO_TESTS_AT_ALL").when(path.rlike(r"\.(ya?ml|json|toml|ini|cfg|env)$"), "CONFIGURATION").when(path.contains("generated"), "GENERATED").when(F.coalesce("fan_in", F.lit(0)) == 0, "UNCALLED").otherwise("UNKNOWN")
    return rows.select("pair", "qualified_name", "change_type", claim.alias("claim"))


def contradictions(changes: DataFrame, unaffected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """TST-06: rows that must not exist: changed tests called unaffected, unaffected rows that are no tests."""
    changed = unaffected.join(changes.where("change_type <> 'REMOVED'").select("pair", F.col("artifact_id").alias("test_id")), ["pair", "test_id"], "left_semi").select("test_id", F.lit("CHANGED_BUT_UNAFFECTED").alias("problem"))
    tests = once(artifacts).where(is_test(F.col("artifact_type"), F.col("location"), F.col("name"))).select(F.col("id").alias("test_id"))
    return changed.unionByName(unaffected.join(tests, "test_id", "left_anti").select("test_id", F.lit("NOT_A_TEST").alias("problem")))


def test_commands(affected: DataFrame, nodes: DataFrame) -> DataFrame:
    """TST-08: per pair and runner the test files to run, sorted and joined."""
    files = nodes.select(F.col("id").alias("test_id"), path_of("location").alias("file"))
    runner = F.when(F.col("file").endswith(".py"), "pytest").when(F.col("file").rlike(r"\.(ts|tsx|js|jsx)$"), "jest").when(F.col("file").endswith(".go"), "go test").otherwise("other")
    rows = affected.join(files, "test_id").select("pair", runner.alias("runner"), "file").distinct()
    return rows.groupBy("pair", "runner").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_list("file")), " ").alias("arguments"))


def coupling_factors(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """RSK-05: per pair the greatest distinct fan-in and fan-out of changed symbols and the factor they give."""
    deg = degrees(edges).select(F.col("snapshot_id").alias("graph"), F.col("id").alias("artifact_id"), "fan_in", "fan_out")
    rows = changes.join(deg, ["graph", "artifact_id"], "left").groupBy("pair").agg(F.coalesce(F.max("fan_in"), F.lit(0)).alias("fan_in"), F.coalesce(F.max("fan_out"), F.lit(0)).alias("fan_out"))
    i, o = F.col("fan_in"), F.col("fan_out")
    return rows.withColumn("factor", F.when((i == 0) & (o == 0), 0.0).when((i <= 2) & (o <= 4), 15.0).when(i <= 5, 50.0).otherwise(85.0))


def interface_factors(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """RSK-08: per pair: changed endpoints, changed symbols that touch one by EXPOSES or CONSUMES, factor."""
    touching = once(edges).where(F.upper("relationship_type").isin("EXPOSES", "CONSUMES"))
    ends = touching.select(F.col("source_artifact_id").alias("artifact_id")).unionByName(touching.select(F.col("target_artifact_id").alias("artifact_id"))).distinct().withColumn("touches", F.lit(True))
    rows = changes.join(ends, "artifact_id", "left")
    direct = (F.col("artifact_type") == "API_ENDPOINT") | F.lower(F.coalesce("source_file", F.lit(""))).contains("api")
    sums = rows.groupBy("pair").agg(F.count_if(direct).alias("direct"), F.count("touches").alias("touching"))
    return sums.withColumn("factor", F.when(F.col("direct") > 0, 85.0).when(F.col("touching") > 0, 50.0).otherwise(0.0))


def component_factors(health: DataFrame) -> DataFrame:
    """RSK-06, RSK-07: runtime and incident factors of a component from its counts."""
    run = F.when(F.col("events") == 0, 0.0).when(F.col("errors") > 0, 90.0).when(F.col("production") > 0, 70.0).otherwise(40.0)
    inc = F.when(F.col("incidents") == 0, 0.0).when(F.col("critical") > 0, 90.0).otherwise(60.0)
    return health.select("component_id", run.alias("runtime"), inc.alias("incidents"))


def guardrail_rows(findings: DataFrame, policy: DataFrame, uses: DataFrame) -> DataFrame:
    """ARC-04: one row per snapshot and rule: PASS, or VIOLATION with its count. Snapshots come from ``uses``."""
    rules = policy.select(F.concat_ws(" -> ", "source_layer", "target_layer").alias("rule"), "source_layer", "target_layer")
    snaps = uses.select("snapshot_id").distinct()
    hits = uses.join(F.broadcast(rules), ["source_layer", "target_layer"]).select("snapshot_id", "rule", "source_name", "target_name").distinct().groupBy("snapshot_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    names = [r[0] for r in rules.select("rule").collect()]
    every = snaps.select("snapshot_id", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("rule"))
    rows = every.join(hits, ["snapshot_id", "rule"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("n") > 0, "VIOLATION").otherwise("PASS"))


def overall_health(scores: DataFrame) -> DataFrame:
    """ARC-11: mean of the dimensions, at most 45 where testing is 0."""
    rows = scores.groupBy("snapshot_id").agg(F.avg("score").alias("mean"), F.max(F.when(F.col("dimension") == "testing", F.col("score"))).alias("testing"))
    return rows.select("snapshot_id", F.when(F.col("testing") == 0, F.least(F.col("mean"), F.lit(45.0))).otherwise(F.col("mean")).alias("health"))


def weakest_dimensions(scores: DataFrame, most: int = 2) -> DataFrame:
    """ARC-10: the ``most`` lowest dimensions below 80 per snapshot, in order."""
    order = W.partitionBy("snapshot_id").orderBy("score", "dimension")
    return scores.where("score < 80").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def unlinked_events(incidents: DataFrame, links: DataFrame, events: DataFrame, most: int = 100) -> DataFrame:
    """INC-01: up to ``most`` events of an incident's component that it does not link yet, newest first, ties by id."""
    seen = events.where("component_artifact_id is not null").groupBy("event_id", "component_artifact_id").agg(F.min("ingested_at").alias("at"))
    named = once(incidents).select(F.col("id").alias("incident_id"), F.explode("evidence_ids").alias("e")).select("incident_id", F.lower(some("e")).alias("event_id"))
    known = named.unionByName(once(links).where("target_type = 'runtime_event'").select("incident_id", F.lower(some("target_id")).alias("event_id")))
    rows = once(incidents).select(F.col("id").alias("incident_id"), F.col("affected_component_id").alias("component_artifact_id")).join(seen, "component_artifact_id").join(known, ["incident_id", "event_id"], "left_anti")
    return rows.withColumn("k", F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc("at"), "event_id"))).where(F.col("k") <= most).select("incident_id", "event_id")


def incident_cards(incidents: DataFrame, links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """MSC-11: incidents with the name of their component and the number of links."""
    n = once(links).groupBy(F.col("incident_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    names = once(artifacts).select(F.col("id").alias("affected_component_id"), F.col("qualified_name").alias("component"))
    return once(incidents).select("id", "affected_component_id").join(n, "id", "left").join(names, "affected_component_id", "left").select(F.col("id").alias("incident_id"), "component", F.coalesce("links", F.lit(0)).alias("links"))


def artifact_tests(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """MSC-08: per non-test artifact the number of tests and a claim."""
    n = once(edges).where("upper(relationship_type) = 'TESTS'").groupBy(F.col("target_artifact_id").alias("id")).agg(F.count_distinct("source_artifact_id").alias("tests"))
    have = once(artifacts).where("artifact_type = 'TEST_CASE'").select("snapshot_id", F.lit(True).alias("any_test")).distinct()
    rows = once(artifacts).where("artifact_type <> 'TEST_CASE'").select("id", "snapshot_id").join(n, "id", "left").join(have, "snapshot_id", "left")
    claim = F.when(F.col("tests") > 0, "OBSERVED").when(F.col("any_test").isNull(), "NO_AUTOMATED_TEST_EXISTS").otherwise("UNKNOWN")
    return rows.select("id", "snapshot_id", F.coalesce("tests", F.lit(0)).alias("tests"), claim.alias("claim"))


def latest_events(events: DataFrame, most: int = 50) -> DataFrame:
    """TOP-04: the ``most`` newest events of each component, ties by id."""
    rows = events.where("component_artifact_id is not null").groupBy("component_artifact_id", "event_id").agg(F.min("ingested_at").alias("at"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("component_artifact_id").orderBy(F.desc("at"), "event_id"))).where(F.col("rank") <= most).select("component_artifact_id", "event_id", "rank")


def evidence_confidence(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """AGG-22: per graph: mean points of findings (nearer counts more), between .2 and 1."""
    points = F.lit(0.5) + F.greatest(F.lit(0.1), 0.5 - 0.1 * (F.col("depth") - 1))
    f = findings.groupBy("graph").agg(F.sum(points).alias("p"), F.count(F.lit(1)).alias("n"))
    own = F.lit(0.4) + F.when(F.col("source_file") != "", 0.4).otherwise(0.0) + F.when(F.col("artifact_type").isNotNull(), 0.2).otherwise(0.0)
    c = changes.groupBy("graph").agg(F.sum(own).alias("p"), F.count(F.lit(1)).alias("n"))
    return f.unionByName(c).groupBy("graph").agg((F.sum("p") / F.sum("n")).alias("mean")).select("graph", F.greatest(F.lit(0.2), F.least(F.lit(1.0), "mean")).alias("confidence"))


def question_intents(texts: DataFrame) -> DataFrame:
    """ASK-01: ``doc_id, intent`` of question-like sentences of any length by keywords, first match in order."""
    low = F.lower(F.col("question"))
    intent = F.when(low.rlike("incident|outage|alert"), "incident").when(low.rlike("impact|affect|break|downstream"), "impact").when(low.rlike("rule|baseline|layer|violat"), "guardrail").when(low.rlike("test|suite|coverage"), "test").otherwise("component")
    rows = texts.where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Z][^.?!\n]{5,}\?)"), 1)).alias("question"))
    return rows.select("doc_id", intent.alias("intent")).groupBy("doc_id", "intent").agg(F.count(F.lit(1)).alias("n"))
