"""Change sets and what they affect (DIF, TRV, TST families)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.graph import TEST_RULES, is_test, path_of
from graphloom.functions.text import some
from graphloom.operators.graph import adjacency, once
from graphloom.operators.snapshot_changes import snapshot_pairs
from graphloom.operators.traversal import reach, reversed_all

#: What an affected node counts as, in order of precedence: parts of its type, and parts of its name.
TERMINALS = {"TEST": (["test"], ["test"]), "API": (["api", "endpoint", "route"], []), "PROCESS": (["process", "workflow"], []), "DATABASE": (["db", "table", "entity"], [])}
CLASSES = {"TEST": (["test"], ["test"]), "API": (["api", "endpoint"], ["route", "/api/"]), "PROCESS": (["process"], ["workflow"]), "SERVICE": (["service"], ["service"]), "DATABASE": (["database"], ["table"])}
#: Types that a schema migration changes.
DATABASE_TYPES = ["DATABASE_ENTITY", "DATABASE_TABLE", "SQL_TABLE", "SQL_VIEW"]


def counted_as(kind: F.Column, name: F.Column, table: dict) -> F.Column:
    """The first class of a table that a type or name falls into, COMPONENT if none."""
    out = F.lit("COMPONENT")
    for label in reversed(table):
        hit = F.lit(False)
        for text, parts in zip((kind, name), table[label], strict=True):
            for part in parts:
                hit = hit | F.coalesce(F.lower(text).contains(part), F.lit(False))
        out = F.when(hit, label).otherwise(out)
    return out


def change_set(snapshots: DataFrame, artifacts: DataFrame) -> DataFrame:
    """DIF-01: symbol changes between consecutive READY snapshots of a branch.

    ``pair`` (the later snapshot), ``previous_id``, ``qualified_name``, ``change_type`` (ADDED, REMOVED, MODIFIED), ``artifact_id`` and
    ``graph`` (the snapshot the symbol is looked up in: the earlier one for removals), ``artifact_type``, ``source_file``,
    ``confidence``. A symbol is modified if both hashes are there and differ, or its signature (null is
    empty) or lines differ. Of several rows of a name the one with the largest id counts. External placeholders are left out.
    """
    pairs = snapshot_pairs(snapshots)
    rows = once(artifacts).where("artifact_type <> 'EXTERNAL_DEPENDENCY' and qualified_name is not null").select(
        F.col("snapshot_id").alias("sid"), F.trim("qualified_name").alias("qualified_name"), F.struct(F.col("id"), "artifact_type", F.coalesce("signature", F.lit("")).alias("signature"), "line_start", "line_end", F.when(F.col("source_hash") != "", F.col("source_hash")).alias("source_hash"), path_of("location").alias("file")).alias("x")
    )
    roles = pairs.select(F.col("snapshot_id").alias("pair"), "previous_id", F.explode(F.array(F.struct(F.col("snapshot_id").alias("sid"), F.lit(True).alias("now")), F.struct(F.col("previous_id").alias("sid"), F.lit(False).alias("now")))).alias("r")).select("pair", "previous_id", "r.*")
    sides = rows.join(roles, "sid").groupBy("pair", "previous_id", "qualified_name").agg(F.max(F.when(F.col("now"), F.col("x"))).alias("a"), F.max(F.when(~F.col("now"), F.col("x"))).alias("b"))
    modified = F.coalesce(F.col("a.source_hash") != F.col("b.source_hash"), F.lit(False)) | (F.col("a.signature") != F.col("b.signature")) | ~F.col("a.line_start").eqNullSafe(F.col("b.line_start")) | ~F.col("a.line_end").eqNullSafe(F.col("b.line_end"))
    change = F.when(F.col("b").isNull(), "ADDED").when(F.col("a").isNull(), "REMOVED").when(modified, "MODIFIED")
    one = F.coalesce("a", "b")
    return sides.select("pair", "previous_id", "qualified_name", change.alias("change_type"), one["id"].alias("artifact_id"), F.when(change == "REMOVED", F.col("previous_id")).otherwise(F.col("pair")).alias("graph"), one["artifact_type"].alias("artifact_type"), one["file"].alias("source_file"), F.when(change == "MODIFIED", 0.95).otherwise(1.0).alias("confidence")).where("change_type is not null")


def change_summary(changes: DataFrame) -> DataFrame:
    """DIF-03: counts per pair."""
    kinds = [F.count_if(F.col("change_type") == k).alias(k.lower()) for k in ("ADDED", "REMOVED", "MODIFIED")]
    return changes.groupBy("pair").agg(*kinds, F.count_distinct("source_file").alias("files"))


def impact_findings(changes: DataFrame, edges: DataFrame, placeholders: DataFrame | None = None, max_depth: int = 5, left_out: DataFrame | None = None) -> DataFrame:
    """TRV-01: ``graph, root, node, depth, rel, confidence, path, classification`` of everything a change affects.

    Nodes of ``left_out`` (``node``; tests or endpoints that are not asked for) are neither reported nor passed.
    """
    roots = changes.select("graph", F.col("artifact_id").alias("root"))
    links = adjacency(edges, placeholders=placeholders)
    if left_out is not None:
        links = links.join(left_out.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti")
    found = reach(roots, links, max_depth).where("depth > 0")
    return found.withColumn("classification", F.when(F.col("depth") == 1, "DIRECT").otherwise("PROVEN_TRANSITIVE"))


def names_of(node_table: DataFrame) -> DataFrame:
    """``node, name, kind``: the qualified name of a node, its id where it has none."""
    return node_table.select(F.col("id").alias("node"), F.coalesce(some("qualified_name"), "id").alias("name"), F.col("artifact_type").alias("kind"))


def named_findings(findings: DataFrame, node_table: DataFrame) -> DataFrame:
    """TRV-01: findings by name: of several with one graph, root name, affected name and relationship the least deep, then the smallest ids.

    ``completeness`` per graph is COMPLETE, or PARTIAL where a finding meets a node that no table knows.
    """
    names = names_of(node_table)
    rows = findings.join(names.select(F.col("node").alias("root"), F.col("name").alias("root_name")), "root", "left").join(names.select("node", F.col("name").alias("affected_name"), F.lit(True).alias("known")), "node", "left")
    rows = rows.select("graph", F.coalesce("root_name", "root").alias("root_name"), F.coalesce("affected_name", "node").alias("affected_name"), "rel", F.struct("depth", "root", "node", "path", "confidence").alias("f"), F.coalesce("known", F.lit(False)).alias("known"))
    best = rows.groupBy("graph", "root_name", "affected_name", "rel").agg(F.min("f").alias("f"), F.bool_and("known").alias("known"))
    partial = best.where(~F.col("known")).select("graph").distinct().withColumn("partial", F.lit(True))
    done = best.join(partial, "graph", "left")
    return done.select("graph", "root_name", "affected_name", "rel", "f.*", F.when(F.col("f.depth") == 1, "DIRECT").otherwise("PROVEN_TRANSITIVE").alias("classification"), F.when(F.col("partial"), "PARTIAL").otherwise("COMPLETE").alias("completeness"))


def impact_paths(findings: DataFrame, node_table: DataFrame) -> DataFrame:
    """TRV-04: findings with what the node a path ends in counts as, the path as text and its length; of equal paths the most confident."""
    kinds = names_of(node_table).select("node", counted_as(F.col("kind"), F.col("name"), TERMINALS).alias("terminal"))
    rows = findings.select("graph", "root", "node", "depth", F.array_join("path", " > ").alias("path"), "confidence")
    best = rows.groupBy("graph", "root", "node", "depth", "path").agg(F.max("confidence").alias("confidence"))
    return best.join(kinds, "node", "left").select("graph", "root", "node", F.coalesce("terminal", F.lit("COMPONENT")).alias("terminal"), "depth", "path", "confidence")


def impact_summary(changes: DataFrame, findings: DataFrame, node_table: DataFrame) -> DataFrame:
    """TRV-05: per pair: changed, directly and indirectly affected names, unique ones, by class, greatest depth.

    Direct and indirect may overlap, a service counts as a component too. A name that several nodes have counts once in each of their classes.
    """
    kinds = names_of(node_table).select("node", "name", counted_as(F.col("kind"), F.col("name"), CLASSES).alias("class"))
    reached = findings.select("graph", "root", "node", "depth").join(changes.select("pair", "graph", F.col("artifact_id").alias("root")), ["graph", "root"])
    reached = reached.groupBy("pair", "node").agg(F.min("depth").alias("near"), F.max("depth").alias("far"))
    rows = reached.join(kinds, "node", "left").select("pair", "near", "far", F.coalesce("name", "node").alias("name"), F.coalesce("class", F.lit("COMPONENT")).alias("class"))
    labels = [*CLASSES, "COMPONENT"]
    has = {k: F.bool_or(F.col("class").isin("COMPONENT", "SERVICE") if k == "COMPONENT" else F.col("class") == k).alias(k) for k in labels}
    names = rows.groupBy("pair", "name").agg(F.min("near").alias("near"), F.max("far").alias("far"), *has.values())
    sums = names.groupBy("pair").agg(F.count_if(F.col("near") == 1).alias("direct"), F.count_if(F.col("far") > 1).alias("indirect"), F.count(F.lit(1)).alias("unique_affected"), *(F.count_if(k).alias(f"n_{k.lower()}") for k in labels), F.max("far").alias("max_depth"))
    changed = changes.groupBy("pair").agg(F.count(F.lit(1)).alias("changed"))
    counts = [c for c in sums.columns if c != "pair"]
    return changed.join(sums, "pair", "left").select("pair", "changed", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def reached_per_pair(changes: DataFrame, adjacency: DataFrame, max_depth: int) -> DataFrame:
    """One traversal per pair and graph from all its changed nodes at once; ``root`` is the pair."""
    return reach(changes.select("graph", F.col("pair").alias("root"), F.col("artifact_id").alias("node")), adjacency, max_depth)


def blast_radius(roots: DataFrame, edges: DataFrame, node_table: DataFrame, max_depth: int = 4) -> DataFrame:
    """TRV-07: per root: affected components, endpoints and tests, score and risk level."""
    found = reach(roots, reversed_all(once(edges)), max_depth)
    kinds = node_table.select(F.col("id").alias("node"), F.upper("artifact_type").alias("kind"), F.lower(F.coalesce("location", F.lit(""))).alias("at"))
    rows = found.join(kinds, "node")
    api = (F.col("kind") == "API_ENDPOINT") | F.col("at").contains("route")
    test = ~api & (F.col("kind").contains("TEST") | F.col("at").contains("test"))
    other = F.col("depth") > 0
    counts = rows.groupBy("graph", "root").agg(F.count_if(other & ~api & ~test).alias("components"), F.count_if(other & api).alias("apis"), F.count_if(other & test).alias("tests"), F.max("depth").alias("depth"))
    score = F.least(F.lit(100), 8 * F.col("components") + 20 * F.col("apis") + 5 * F.col("tests"))
    return counts.withColumn("score", score).withColumn("risk", F.when(F.col("score") >= 75, "CRITICAL").when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 25, "MEDIUM").otherwise("LOW"))


def affected_tests(changes: DataFrame, edges: DataFrame, node_table: DataFrame, max_depth: int = 6) -> DataFrame:
    """TRV-11, TST-01, TST-02: per pair and test: least depth, whether direct, provenance and confidence."""
    found = reached_per_pair(changes, adjacency(edges, TEST_RULES), max_depth)
    tests = node_table.where(is_test(F.col("artifact_type"), F.col("location"), F.col("name"))).select(F.col("id").alias("node"), F.col("qualified_name").alias("test_name"))
    rows = found.join(tests, "node").withColumnRenamed("root", "pair")
    best = rows.groupBy("pair", "node", "test_name").agg(F.min(F.struct("depth", F.array_join("path", ">").alias("path"), "rel")).alias("b"))
    depth = F.col("b.depth")
    return best.select("pair", F.col("node").alias("test_id"), "test_name", depth.alias("depth"), F.when(depth <= 1, "DIRECT").otherwise("INDIRECT").alias("impact"), F.when((depth == 1) & (F.col("b.rel") == "TESTS"), "OBSERVED").otherwise("INFERRED").alias("provenance"), F.greatest(F.lit(0.6), 1 - 0.1 * (F.greatest(depth, F.lit(1)) - 1)).alias("confidence"))


def unaffected_tests(affected: DataFrame, pairs: DataFrame, artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """TST-03: tests of the later snapshot with a TESTS edge that no change reaches."""
    tests = once(artifacts).where(is_test(F.col("artifact_type"), F.col("location"), F.col("name"))).select(F.col("id").alias("test_id"), F.col("snapshot_id").alias("pair"), F.col("qualified_name").alias("test_name"))
    mapped = once(edges).where("upper(relationship_type) = 'TESTS'").select(F.col("source_artifact_id").alias("test_id")).distinct()
    rows = tests.join(pairs.select(F.col("snapshot_id").alias("pair")), "pair").join(mapped, "test_id", "left_semi")
    return rows.join(affected.select("pair", "test_id"), ["pair", "test_id"], "left_anti").select("pair", "test_id", "test_name")


def test_selection(affected: DataFrame, unaffected: DataFrame) -> DataFrame:
    """TST-09, AGG-17, AGG-20: per pair: tests to run, tests to skip, share skipped."""
    rows = affected.select("pair", F.lit(True).alias("run"), (F.col("impact") == "DIRECT").alias("direct")).unionByName(unaffected.select("pair", F.lit(False).alias("run"), F.lit(False).alias("direct")))
    sums = rows.groupBy("pair").agg(F.count_if("run").alias("to_run"), F.count_if("direct").alias("direct"), F.count_if(~F.col("run")).alias("to_skip"))
    return sums.withColumn("skip_share", F.col("to_skip") / (F.col("to_run") + F.col("to_skip")))


def mutations_of(changes: DataFrame) -> DataFrame:
    """DIF-06: one proposed mutation per changed symbol name, the first of each."""
    order = W.partitionBy("pair", "qualified_name").orderBy("change_type", "artifact_id")
    kind = F.when(F.col("change_type") == "REMOVED", "REMOVE_COMPONENT").when(F.col("artifact_type") == "API_ENDPOINT", "MODIFY_API").when(F.col("artifact_type").isin(DATABASE_TYPES), "SCHEMA_MIGRATION").otherwise("MODIFY_SYMBOL")
    return changes.withColumn("n", F.row_number().over(order)).where("n = 1").select("pair", F.col("qualified_name").alias("target"), kind.alias("mutation_type"))


def one_hop_baselines(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """TRV-18: predicted nodes of the three simple baselines per pair: changed, plus importers, plus callers."""
    roots = changes.select("pair", "graph", F.col("artifact_id").alias("node"))
    own = roots.select("pair", "node").withColumn("baseline", F.lit("changed"))
    hops = once(edges).select(F.col("snapshot_id").alias("graph"), F.col("target_artifact_id").alias("node"), F.col("source_artifact_id").alias("caller"), F.upper("relationship_type").alias("rel"))
    near = roots.join(hops, ["graph", "node"])
    imports = near.where(F.col("rel").isin("IMPORTS", "DEPENDS_ON")).select("pair", F.col("caller").alias("node"))
    calls = near.where(F.col("rel") == "CALLS").select("pair", F.col("caller").alias("node"))
    base = roots.select("pair", "node")
    return own.unionByName(base.unionByName(imports).withColumn("baseline", F.lit("imports"))).unionByName(base.unionByName(imports).unionByName(calls).withColumn("baseline", F.lit("calls"))).distinct()
