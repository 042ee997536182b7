"""Graph views: levels, node states, edge rollup, file trees (GRF, PRC families)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.graph import COMPONENT_TYPES, MACRO_TYPES, MEMBER_TYPES, path_of
from graphloom.operators.graph import degrees, once

#: Words that mark entry points and step kinds of processes.
ENTRY_WORDS = ["controller", "handler", "router", "dispatch", "service", "process"]
STEP_WORDS = {
    "database_op": ["repo", "repository", "db", "database", "dao", "table", "store"],
    "external_call": ["client", "external", "remote", "http", "api"],
    "validation": ["validate", "check", "verify", "auth", "guard"],
}
HUB_PATHS = ["app.", "main.", "index.", "server.", "route", "controller", "api", "router"]


def _any(text, words):
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def visible_nodes(artifacts: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """GRF-01: ``snapshot_id, id`` shown at a level: 1 macro parts and module hubs, 2 components, 3 members, 4 all."""
    rows = once(artifacts)
    kind = F.upper("artifact_type")
    if level == 1:
        deg = degrees(edges).select("snapshot_id", "id", (F.col("edges_in") + F.col("edges_out")).alias("degree"))
        hub = (kind == "MODULE") & ((F.coalesce("degree", F.lit(0)) >= 2) | _any(F.lower(F.coalesce("location", F.lit(""))), HUB_PATHS))
        return rows.join(deg, ["snapshot_id", "id"], "left").where(kind.isin(MACRO_TYPES) | hub).select("snapshot_id", "id")
    shown = {2: COMPONENT_TYPES, 3: COMPONENT_TYPES + MEMBER_TYPES}.get(level)
    return (rows.where(kind.isin(shown)) if shown else rows).select("snapshot_id", "id")


def node_states(artifacts: DataFrame, edges: DataFrame, changes: DataFrame, observed: DataFrame) -> DataFrame:
    """GRF-02: artifacts with degrees, their change against the previous snapshot, and whether they ran."""
    deg = degrees(edges).select("snapshot_id", "id", "edges_in", "edges_out")
    changed = changes.where("change_type <> 'REMOVED'").select(F.col("artifact_id").alias("id"), F.lower("change_type").alias("change"))
    rows = once(artifacts).select("id", "snapshot_id", "artifact_type").join(deg, ["snapshot_id", "id"], "left").join(changed, "id", "left").join(observed.select("id", F.lit(True).alias("ran")), "id", "left")
    return rows.select("id", "snapshot_id", "artifact_type", F.coalesce("edges_in", F.lit(0)).alias("edges_in"), F.coalesce("edges_out", F.lit(0)).alias("edges_out"), F.coalesce("change", F.lit("unchanged")).alias("change"), F.coalesce("ran", F.lit(False)).alias("observed"))


def view_summary(states: DataFrame) -> DataFrame:
    """GRF-04: per snapshot and type: nodes, observed ones and their share in percent."""
    rows = states.groupBy("snapshot_id", "artifact_type").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("observed").alias("observed"))
    return rows.withColumn("observed_share", 100 * F.col("observed") / F.col("nodes"))


def rolled_up_edges(artifacts: DataFrame, edges: DataFrame, visible: DataFrame) -> DataFrame:
    """GRF-03, DED-02: edges between visible stand-ins, each once: ``snapshot_id, source, target, rel``.

    An artifact stands for itself if visible, else for the visible artifact of the same file with the smallest id, else for
    the visible one with the longest dotted prefix of its qualified name. Own prefixes are exploded and joined by equality.
    """
    rows = once(artifacts).select("snapshot_id", "id", path_of("location").alias("file"), F.trim("qualified_name").alias("q"))
    seen = rows.join(visible, ["snapshot_id", "id"], "left_semi")
    by_file = seen.groupBy("snapshot_id", "file").agg(F.min("id").alias("by_file"))
    by_name = seen.groupBy("snapshot_id", "q").agg(F.min("id").alias("by_name"))
    hidden = rows.join(visible, ["snapshot_id", "id"], "left_anti").join(by_file, ["snapshot_id", "file"], "left")
    parts = F.split("q", r"\.")
    prefixes = hidden.where("by_file is null").select("snapshot_id", "id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1))).alias("n"), parts.alias("p")).select("snapshot_id", "id", "n", F.array_join(F.slice("p", 1, F.col("n")), ".").alias("q"))
    longest = prefixes.join(by_name, ["snapshot_id", "q"]).groupBy("snapshot_id", "id").agg(F.max_by("by_name", "n").alias("stand_in"))
    stands = seen.select("id", F.col("id").alias("stand_in")).unionByName(hidden.where("by_file is not null").select("id", F.col("by_file").alias("stand_in"))).unionByName(longest.select("id", "stand_in"))
    e = once(edges).select("snapshot_id", "source_artifact_id", "target_artifact_id", F.col("relationship_type").alias("rel"))
    e = e.join(stands.select(F.col("id").alias("source_artifact_id"), F.col("stand_in").alias("source")), "source_artifact_id").join(stands.select(F.col("id").alias("target_artifact_id"), F.col("stand_in").alias("target")), "target_artifact_id")
    return e.where("source <> target").select("snapshot_id", "source", "target", "rel").distinct()


def file_tree(artifacts: DataFrame) -> DataFrame:
    """GRF-05: folders and files as parent and child rows with the number of symbols below."""
    parts = F.split(path_of("location"), "/")
    rows = once(artifacts).where("location is not null").select("snapshot_id", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    up = F.when(F.col("n") > 1, F.array_join(F.slice("p", 1, F.col("n") - 1), "/")).otherwise("")
    return rows.groupBy("snapshot_id", F.array_join(F.slice("p", 1, F.col("n")), "/").alias("path"), up.alias("parent"), (F.col("n") < F.size("p")).alias("is_folder")).agg(F.count(F.lit(1)).alias("symbols"))


def entry_points(artifacts: DataFrame, most: int = 10) -> DataFrame:
    """PRC-01: up to ``most`` process entry points per snapshot, by kind, then id."""
    name, at, kind = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("location", F.lit(""))), F.upper("artifact_type")
    api = kind.contains("API") | kind.contains("ENDPOINT") | at.contains("route")
    worker = (_any(name, ENTRY_WORDS) | _any(at, ENTRY_WORDS)) & kind.isin("FUNCTION", "METHOD", "CLASS", "INTERFACE")
    rows = once(artifacts).where(~kind.isin("EXTERNAL_DEPENDENCY", "PACKAGE")).withColumn("rank", F.when(api, 1).when(worker, 2)).where("rank is not null")
    return rows.withColumn("k", F.row_number().over(W.partitionBy("snapshot_id").orderBy("rank", "id"))).where(F.col("k") <= most).select("snapshot_id", "id", "rank")


def process_steps(reached: DataFrame, nodes: DataFrame, most: int = 15) -> DataFrame:
    """PRC-02, TRV-13: ordered steps of each process with their kind and confidence; at most ``most`` per entry point."""
    name = F.lower(F.coalesce("name", F.lit("")))
    kind = F.when(F.col("depth") == 0, "entrypoint")
    for label, words in STEP_WORDS.items():
        kind = kind.when(_any(name, words), label)
    rows = reached.join(nodes.select(F.col("id").alias("node"), "name"), "node")
    order = W.partitionBy("graph", "root").orderBy("depth", "path", "node")
    return rows.withColumn("step", F.row_number().over(order) - 1).where(F.col("step") < most).select("graph", "root", "node", "step", "depth", kind.otherwise("action").alias("step_kind"), F.greatest(F.lit(0.6), 0.85 - 0.05 * F.col("depth")).alias("confidence"))
