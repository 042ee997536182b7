"""SNK-02 to SNK-06: result tables and upserts on Parquet folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_result(rows: DataFrame, path: str, analysis_id: str) -> None:
    """SNK-02, SNK-03: store a result under its id; storing it again replaces it, others stay."""
    rows.withColumn("analysis_id", F.lit(analysis_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path)


def load_result(spark: SparkSession, path: str, analysis_id: str) -> DataFrame:
    """A stored result; the id prunes partitions."""
    return spark.read.parquet(path).where(F.col("analysis_id") == analysis_id).drop("analysis_id")


def without_partition(rows: DataFrame, column: str, value: str) -> DataFrame:
    """SNK-06: all rows but those of one partition (write the result elsewhere, then swap)."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(value)))


def upserted(base: DataFrame, updates: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """SNK-04, SNK-05: base with updates by key: values of an update win where they are not null, new keys are added.

    Of several updates of a key the one with the greatest ``order`` counts (without one, the greatest values). Null keys never match.
    """
    values = [c for c in base.columns if c not in keys]
    best = updates.groupBy(*keys).agg(F.max(F.struct(*([order.alias("_o")] if order is not None else []), *values)).alias("_u"))
    joined = base.join(best, keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(F.col(f"_u.{c}"), F.col(c)).alias(c) for c in values))


def dimension(base: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """SNK-04: a dimension table (``id, name``) with the names of ``rows`` it lacks; ids follow from the names."""
    fresh = rows.select(name).where(F.col(name).isNotNull()).distinct().join(base.select(F.col("name").alias(name)), name, "left_anti")
    return base.select("id", "name").unionByName(fresh.select(F.concat(F.lit("dim_"), F.substring(F.sha2(name, 256), 1, 16)).alias("id"), F.col(name).alias("name")))
