"""What-if edits as pure functions over a copy of the graph (SIM family). Base tables are never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import once

COLUMNS = ["id", "snapshot_id", "source_artifact_id", "target_artifact_id", "relationship_type", "confidence"]


def virtual(rows: DataFrame, suffix: str = "#virtual") -> DataFrame:
    """SIM-01: the same rows under a virtual snapshot id."""
    return rows.withColumn("snapshot_id", F.concat("snapshot_id", F.lit(suffix)))


def without_components(artifacts: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SIM-04: drop components (``snapshot_id, id``) and every edge that touches one."""
    ends = lambda c: gone.select("snapshot_id", F.col("id").alias(c)).distinct()
    kept = once(edges).join(ends("source_artifact_id"), ["snapshot_id", "source_artifact_id"], "left_anti").join(ends("target_artifact_id"), ["snapshot_id", "target_artifact_id"], "left_anti")
    return once(artifacts).join(gone.select("snapshot_id", "id").distinct(), ["snapshot_id", "id"], "left_anti"), kept


def without_dependencies(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """SIM-05: drop edges by ``snapshot_id, source_artifact_id, target_artifact_id`` and, where given, ``relationship_type``."""
    keys = ["snapshot_id", "source_artifact_id", "target_artifact_id"]
    if "relationship_type" in gone.columns:
        keys = [*keys, "relationship_type"]
    return once(edges).join(gone.select(*keys).distinct(), keys, "left_anti")


def with_dependencies(edges: DataFrame, added: DataFrame) -> DataFrame:
    """SIM-03: add edges (``snapshot_id, source_artifact_id, target_artifact_id, relationship_type``); ids follow from content."""
    key = F.concat_ws("::", "snapshot_id", "source_artifact_id", F.coalesce("relationship_type", F.lit("DEPENDS_ON")), "target_artifact_id")
    rows = added.select(F.concat(F.lit("rel_"), F.substring(F.sha2(key, 256), 1, 28)).alias("id"), "snapshot_id", "source_artifact_id", "target_artifact_id", F.coalesce("relationship_type", F.lit("DEPENDS_ON")).alias("relationship_type"), F.lit(1.0).alias("confidence"))
    return once(edges).select(*COLUMNS).unionByName(rows).dropDuplicates(["id"])


def retyped(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """SIM-06: give the first edge (smallest id) of each pair another type (``new_type``)."""
    keys = ["snapshot_id", "source_artifact_id", "target_artifact_id"]
    first = once(edges).groupBy(*keys).agg(F.min("id").alias("id")).join(kinds.select(*keys, "new_type").distinct(), keys).select("id", "new_type")
    return once(edges).select(*COLUMNS).join(first, "id", "left").withColumn("relationship_type", F.coalesce("new_type", "relationship_type")).drop("new_type")


def with_changed_signatures(artifacts: DataFrame, changed: DataFrame) -> DataFrame:
    """SIM-02: alter the signature of symbols (``snapshot_id, id``), so that a comparison finds them modified."""
    mark = changed.select("snapshot_id", "id", F.lit(True).alias("_m")).distinct()
    rows = once(artifacts).join(mark, ["snapshot_id", "id"], "left")
    return rows.withColumn("signature", F.when(F.col("_m"), F.concat(F.coalesce("signature", F.lit("")), F.lit(" #changed"))).otherwise(F.col("signature"))).drop("_m")


def validation(mutations: DataFrame, artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """SIM-07: verdict per mutation (``snapshot_id, mutation_type, source, target``): ok, warning or error with a reason."""
    known = once(artifacts).select("snapshot_id", F.col("id").alias("k"), F.lit(True).alias("hit"))
    pairs = once(edges).select("snapshot_id", F.col("source_artifact_id").alias("source"), F.col("target_artifact_id").alias("target"), F.lit(True).alias("linked")).distinct()
    rows = mutations.distinct()
    rows = rows.join(known.withColumnsRenamed({"k": "target", "hit": "t_hit"}), ["snapshot_id", "target"], "left").join(known.withColumnsRenamed({"k": "source", "hit": "s_hit"}), ["snapshot_id", "source"], "left").join(pairs, ["snapshot_id", "source", "target"], "left")
    adds, cuts = F.col("mutation_type") == "ADD_DEPENDENCY", (F.col("mutation_type") == "REMOVE_DEPENDENCY") & F.col("source").isNotNull()
    reason = (
        F.when(F.col("t_hit").isNull(), "UNKNOWN_TARGET").when((adds | cuts) & F.col("s_hit").isNull(), "UNKNOWN_SOURCE").when(cuts & F.col("linked").isNull(), "NO_SUCH_DEPENDENCY").when(adds & (F.col("source") == F.col("target")), "SELF_LOOP").when(adds & F.col("linked"), "DUPLICATE")
    )
    status = F.when(reason.isin("SELF_LOOP", "DUPLICATE"), "WARNING").when(reason.isNotNull(), "ERROR").otherwise("OK")
    return rows.select("snapshot_id", "mutation_type", "source", "target", status.alias("status"), reason.alias("reason"))
