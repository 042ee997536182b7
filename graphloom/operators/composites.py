"""Compositions of the other operators: projections, simulations, overlays, confidence (GRF-06, SIM-08, JN-02, JN-12, RSK-11, AGG-16, AGG-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.graph import path_of
from graphloom.operators.conformance import import_lines
from graphloom.operators.graph import degrees, once
from graphloom.operators.impact import blast_radius
from graphloom.operators.lookup import longest_prefix
from graphloom.operators.traversal import reach, reversed_all
from graphloom.operators.whatif import without_components
from graphloom.sources.baseline import Baseline


def blast_nodes(roots: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """TRV-08: every affected node with a confidence that falls by depth (never under .6); the depth limit is honoured."""
    found = reach(roots, reversed_all(once(edges)), max_depth).where("depth > 0")
    return found.select("graph", "root", "node", "depth", F.greatest(F.lit(0.6), 1 - 0.12 * (F.col("depth") - 1)).alias("confidence"))


def processes_through(steps: DataFrame, components: DataFrame) -> DataFrame:
    """JN-02: processes (``graph, root``) that pass a component (``graph, node``), each once with its first step there."""
    return steps.join(components.select("graph", "node").distinct(), ["graph", "node"]).groupBy("graph", "root", "node").agg(F.min("step").alias("step"))


def process_lists(steps: DataFrame) -> DataFrame:
    """MSC-12, PRC-03: each process as one row: number of steps, nodes in order."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "node")))
    return steps.groupBy("graph", "root").agg(F.count(F.lit(1)).alias("steps"), F.array_join(F.transform(ordered, lambda s: s["node"]), ">").alias("nodes"))


def flagged_edges(edges: DataFrame, nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """JN-12: edges overlaid with architecture findings of the same names: ``snapshot_id, relationship_type, edges, flagged``."""
    named = lambda p: nodes.select(F.col("id").alias(f"{p}_artifact_id"), F.trim("qualified_name").alias(f"{p}_name"))
    marks = findings.select("snapshot_id", "source_name", "target_name", F.lit(1).alias("hit")).distinct()
    rows = once(edges).join(named("source"), "source_artifact_id").join(named("target"), "target_artifact_id").join(marks, ["snapshot_id", "source_name", "target_name"], "left")
    return rows.groupBy("snapshot_id", "relationship_type").agg(F.count(F.lit(1)).alias("edges"), F.count("hit").alias("flagged"))


def glance(artifacts: DataFrame, edges: DataFrame, top: int = 6) -> DataFrame:
    """AGG-16: per snapshot and part (storage, api, frontend, service) the ``top`` distinct names by degree; first matching part counts."""
    kind, at = F.upper("artifact_type"), F.lower(F.coalesce("location", F.lit("")))
    part = F.when(kind.isin("SQL_TABLE", "SQL_VIEW", "DATABASE_ENTITY") | at.rlike("store|database|/db"), "storage").when((kind == "API_ENDPOINT") | at.rlike("/api/|route|controller|gateway"), "api").when(at.rlike(r"\.(tsx|jsx|vue)(:|$)"), "frontend").when(kind.isin("CLASS", "INTERFACE", "SERVICE"), "service")
    deg = degrees(edges).select("snapshot_id", "id", (F.col("edges_in") + F.col("edges_out")).alias("degree"))
    rows = once(artifacts).withColumn("part", part).where("part is not null").join(deg, ["snapshot_id", "id"], "left").groupBy("snapshot_id", "part", "name").agg(F.max(F.coalesce("degree", F.lit(0))).alias("degree"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("snapshot_id", "part").orderBy(F.desc("degree"), "name"))).where(F.col("rank") <= top)


def completeness(artifacts: DataFrame) -> DataFrame:
    """AGG-24: per snapshot: files, files with a known language, share, status."""
    rows = once(artifacts).groupBy("snapshot_id", path_of("location").alias("file")).agg(F.max(F.when(F.col("language") != "", 1).otherwise(0)).alias("known"))
    sums = rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.sum("known").alias("analysed"))
    share = 100 * F.col("analysed") / F.col("files")
    return sums.withColumn("share", share).withColumn("status", F.when(F.col("share") >= 95, "COMPLETE").when(F.col("share") >= 50, "PARTIAL").otherwise("LIMITED"))


def confidence(pairs: DataFrame, selection: DataFrame, events: DataFrame) -> DataFrame:
    """RSK-11: confidence per pair, kept apart from risk: less without mapped tests, less without runtime events of the snapshot."""
    ran = events.select(F.col("snapshot_id").alias("pair"), F.lit(True).alias("ran")).where("pair is not null").distinct()
    rows = pairs.select(F.col("snapshot_id").alias("pair")).join(selection.select("pair", (F.col("to_run") + F.col("to_skip")).alias("mapped")), "pair", "left").join(ran, "pair", "left")
    value = 1.0 - F.when(F.coalesce("mapped", F.lit(0)) == 0, 0.35).otherwise(0.0) - F.when(F.col("ran").isNull(), 0.2).otherwise(0.0)
    rows = rows.select("pair", F.round(F.greatest(F.lit(0.1), value), 6).alias("confidence"))
    return rows.withColumn("level", F.when(F.col("confidence") >= 0.8, "HIGH").when(F.col("confidence") >= 0.5, "MEDIUM").otherwise("LOW"))


def simulated_outage(artifacts: DataFrame, edges: DataFrame, nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """SIM-08: blast radius of removed components (``snapshot_id, id``) on the base graph, with what the copy keeps of each snapshot.

    Removed nodes are looked up in the base graph, as they no longer exist in the copy; the base tables stay as they are.
    """
    kept_nodes, kept_edges = without_components(artifacts, edges, gone)
    radius = blast_radius(gone.select(F.col("snapshot_id").alias("graph"), F.col("id").alias("root")).distinct(), edges, nodes)
    left = kept_nodes.groupBy(F.col("snapshot_id").alias("graph")).agg(F.count(F.lit(1)).alias("nodes_left")).join(kept_edges.groupBy(F.col("snapshot_id").alias("graph")).agg(F.count(F.lit(1)).alias("edges_left")), "graph", "left")
    return radius.join(left, "graph", "left").select("graph", "root", "components", "apis", "tests", "score", "risk", F.coalesce("nodes_left", F.lit(0)).alias("nodes_left"), F.coalesce("edges_left", F.lit(0)).alias("edges_left"))


def file_drift(files: DataFrame, baseline: Baseline) -> DataFrame:
    """ARC-02: drift over import lines of source files: ``path, line_no, severity, source_layer, target_layer, module``.

    HIGH for a forbidden layer or a forbidden first part of an import, MEDIUM for one that is not allowed; each finding once.
    """
    rows = import_lines(files).withColumn("source_module", F.regexp_replace(F.regexp_replace(path_of("path"), r"\.[^./]*$", ""), "/", "."))
    layers = lambda df, column, name: longest_prefix(df, column, baseline.modules, "layer").withColumnRenamed("layer", name)
    rows = layers(layers(rows, "source_module", "source_layer"), "module", "target_layer")
    crossing = rows.join(F.broadcast(baseline.policy), ["source_layer", "target_layer"]).withColumn("severity", F.when(F.col("verdict") == "FORBIDDEN", "HIGH").otherwise("MEDIUM"))
    top = F.split_part("module", F.lit("."), F.lit(1))
    banned = rows.join(F.broadcast(baseline.imports), (F.col("source_layer") == F.col("layer")) & (top == F.split_part("import_prefix", F.lit("."), F.lit(1)))).withColumn("severity", F.lit("HIGH"))
    columns = ["path", "line_no", "severity", "source_layer", "target_layer", "module"]
    return crossing.select(*columns).unionByName(banned.select(*columns)).distinct()


def common_symbols(pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """SET-02, SET-03: per pair: symbols in both snapshots, only in the later, only in the earlier one."""
    names = once(artifacts).select("snapshot_id", F.trim("qualified_name").alias("q")).where("q is not null").distinct()
    roles = pairs.select(F.col("snapshot_id").alias("pair"), F.explode(F.array(F.struct(F.col("snapshot_id").alias("sid"), F.lit(1).alias("now")), F.struct(F.col("previous_id").alias("sid"), F.lit(0).alias("now")))).alias("r")).select("pair", F.col("r.sid").alias("snapshot_id"), "r.now")
    sides = names.join(roles, "snapshot_id").groupBy("pair", "q").agg(F.min("now").alias("low"), F.max("now").alias("high"))
    return sides.groupBy("pair").agg(F.count_if((F.col("low") == 0) & (F.col("high") == 1)).alias("both"), F.count_if(F.col("low") == 1).alias("later"), F.count_if(F.col("high") == 0).alias("earlier"))
