"""Predictions against independent labels (EVL, AGG-19, SET families)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(predicted: DataFrame, truth: DataFrame, case: str = "case_id", entity: str = "entity") -> DataFrame:
    """AGG-19, JN-18: per case: true and false positives, false negatives, precision, recall, F1 (0 where undefined)."""
    rows = predicted.select(case, entity, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(case, entity, F.lit(0).alias("p"), F.lit(1).alias("t"))).groupBy(case, entity).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    sums = rows.groupBy(case).agg(F.count_if((F.col("p") == 1) & (F.col("t") == 1)).alias("tp"), F.count_if((F.col("p") == 1) & (F.col("t") == 0)).alias("fp"), F.count_if((F.col("p") == 0) & (F.col("t") == 1)).alias("fn"))
    return with_scores(sums)


def with_scores(sums: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def micro_average(per_case: DataFrame) -> DataFrame:
    """MSC-15: counts summed over cases, then scores."""
    return with_scores(per_case.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def independent(labels: DataFrame, forbidden: str = "(?i)prediction|system_output|self_generated|model_output") -> DataFrame:
    """EVL-02: cases whose labels may be used: non-empty, flagged independent, provenance free of the system's own output."""
    rows = labels.groupBy("case_id").agg(F.bool_and("is_independent").alias("a"), F.bool_and(~F.coalesce("source", F.lit("")).rlike(forbidden)).alias("b"), F.count("entity").alias("n"))
    return rows.where("a and b and n > 0").select("case_id")


def path_steps(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """JN-17, EVL-01: per path (``graph, root, node, path``): hops, and hops backed by an edge in either direction."""
    hops = paths.select("graph", "root", "node", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("i", "h")).select("graph", "root", "node", "i", F.least("h.a", "h.b").alias("a"), F.greatest("h.a", "h.b").alias("b"))
    known = edges.select(F.col("snapshot_id").alias("graph"), F.least("source_artifact_id", "target_artifact_id").alias("a"), F.greatest("source_artifact_id", "target_artifact_id").alias("b"), F.lit(1).alias("hit")).distinct()
    return hops.join(known, ["graph", "a", "b"], "left").groupBy("graph", "root", "node").agg(F.count(F.lit(1)).alias("hops"), F.count("hit").alias("backed"))
