"""Graph tables: nodes, edges with ends, adjacency, placeholders, degrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.graph import IMPACT_RULES, rule
from graphloom.session import bounded_broadcast

NODE = ["id", "artifact_type", "language", "name", "qualified_name", "location"]


def once(rows: DataFrame, identity: str = "id") -> DataFrame:
    """Each record once; repeated rows are equal."""
    return rows.dropDuplicates([identity])


def nodes(artifacts: DataFrame, external: DataFrame) -> DataFrame:
    """Artifacts and placeholders of outside packages; the latter belong to no snapshot."""
    inside = once(artifacts).select(*NODE, "snapshot_id")
    return inside.unionByName(once(external).select(*NODE, F.lit(None).cast("string").alias("snapshot_id")))


def edges_with_ends(edges: DataFrame, all_nodes: DataFrame, how: str = "inner") -> DataFrame:
    """JN-01: edges with the columns of both ends as ``s_*`` and ``t_*``."""
    end = lambda p: all_nodes.select(*(F.col(c).alias(f"{p}_{c}") for c in NODE))
    return once(edges).join(end("s"), F.col("source_artifact_id") == F.col("s_id"), how).join(end("t"), F.col("target_artifact_id") == F.col("t_id"), how)


def placeholder_map(artifacts: DataFrame, external: DataFrame) -> DataFrame:
    """FLT-15: ``snapshot_id, placeholder, concrete``.

    A placeholder becomes the artifact of a snapshot with its qualified name, else (aliased paths ``@/a/b``) the one
    of ``src.a.b`` or the only one of that file stem, else the only one of its name, the only one whose file
    stem is the last part of its path, the only one whose name is its last dotted part. Placeholders that fit none, or several, stay.
    """
    concrete = artifacts.where("artifact_type <> 'EXTERNAL_DEPENDENCY'").select("snapshot_id", "id", "name", "qualified_name", F.regexp_extract("location", r"([^/\\:]+?)(?:\.[^./\\:]*)?(?::\d+)?$", 1).alias("stem"))
    outside = once(external).where("artifact_type = 'EXTERNAL_DEPENDENCY'").select(F.col("id").alias("placeholder"), F.col("name").alias("p_name"), F.col("qualified_name").alias("p_qualified"))
    outside = bounded_broadcast(outside)
    aliased = F.col("p_qualified").startswith("@/")
    dotted = F.concat(F.lit("src."), F.regexp_replace(F.expr("substring(p_qualified, 3)"), "/", "."))
    keys = [
        (1, "qualified_name", F.col("p_qualified")),
        (2, "qualified_name", F.when(aliased, dotted)),
        (3, "stem", F.when(aliased, F.element_at(F.split("p_qualified", "/"), -1))),
        (4, "name", F.when(~aliased, F.col("p_name"))),
        (5, "stem", F.when(~aliased, F.element_at(F.split("p_qualified", "/"), -1))),
        (6, "name", F.when(~aliased, F.element_at(F.split("p_qualified", r"\."), -1))),
    ]
    parts = []
    for rank, column, wanted in keys:
        names = outside.select("placeholder", wanted.alias("wanted")).where("wanted is not null")
        hits = concrete.join(names, F.col(column) == F.col("wanted")).groupBy("snapshot_id", "placeholder").agg(F.min("id").alias("concrete"), F.max("id").alias("last"))
        parts.append(hits.where("concrete = last").select("snapshot_id", "placeholder", F.struct(F.lit(rank), "concrete").alias("c")))
    return reduce(DataFrame.unionByName, parts).groupBy("snapshot_id", "placeholder").agg(F.min("c").getField("concrete").alias("concrete"))


def adjacency(edges: DataFrame, rules: dict = IMPACT_RULES, placeholders: DataFrame | None = None) -> DataFrame:
    """TRV-02: ``graph, src, dst, rel, weight``: from a trigger to what it affects, parallel edges merged to the strongest.

    Relationships without an enabled rule and self-loops are left out.
    """
    base = once(edges).select(F.col("snapshot_id").alias("graph"), F.col("source_artifact_id").alias("a"), F.col("target_artifact_id").alias("b"), F.upper("relationship_type").alias("rel"), F.coalesce("confidence", F.lit(1.0)).alias("c"))
    if placeholders is not None:
        for end in ("a", "b"):
            known = placeholders.select(F.col("snapshot_id").alias("graph"), F.col("placeholder").alias(end), F.col("concrete").alias(f"{end}_concrete"))
            base = base.join(known, ["graph", end], "left").withColumn(end, F.coalesce(f"{end}_concrete", end)).drop(f"{end}_concrete")
    way = rule(F.col("rel"), rules, 0)
    forward = way == "forward"
    rows = base.where(way.isNotNull() & (F.col("a") != F.col("b"))).select("graph", F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"), "rel", (F.col("c") * rule(F.col("rel"), rules, 1)).alias("weight"))
    return rows.groupBy("graph", "src", "dst", "rel").agg(F.max("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """TRV-19: ``snapshot_id, id, fan_in, fan_out`` (distinct) and ``edges_in, edges_out`` (all).

    Distinct ends are counted by grouping on the pair first, so a hub never meets one task with all its edges.
    """
    pair = once(edges).groupBy("snapshot_id", "source_artifact_id", "target_artifact_id").agg(F.count(F.lit(1)).alias("n"))
    out = pair.groupBy("snapshot_id", F.col("source_artifact_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"), F.sum("n").alias("edges_out")).withColumns({"fan_in": F.lit(0), "edges_in": F.lit(0)})
    into = pair.groupBy("snapshot_id", F.col("target_artifact_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"), F.sum("n").alias("edges_in")).withColumns({"fan_out": F.lit(0), "edges_out": F.lit(0)})
    return out.unionByName(into).groupBy("snapshot_id", "id").agg(*(F.sum(c).alias(c) for c in ("fan_in", "fan_out", "edges_in", "edges_out")))
