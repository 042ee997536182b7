"""Problem 3: per-key results where a few keys hold most records.

No key is ever handled by one task on its own. Identities are counted once each, so every identity has to travel once: as a
128-bit digest beside its key, in a native hash aggregate whose bounded map-side tables (which spill) combine repeats first, and spread by digest
however hot the key is. After that only key states combined per partition move: counts, sums and numbers of values, which merge algebraically.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest(column: str) -> list[Column]:
    """128 bits that stand for a value; null stays null."""
    known = F.col(column).isNotNull()
    return [F.when(known, F.xxhash64(F.lit(seed), F.col(column))).alias(f"_d{seed}") for seed in (0, 1)]


def key_counts(rows: DataFrame, keys: Sequence[str] = ("target_artifact_id", "relationship_type"), identity: str = "id") -> DataFrame:
    """Per key: ``n_edges``, the distinct identities. One exchange by digest, one of compact counts.

    A null identity counts as no edge, null keys form their own group, repeated rows count once. Other columns are not read.
    """
    keys = list(keys)
    once = rows.where(F.col(identity).isNotNull()).select(*keys, *_digest(identity)).groupBy(*keys, "_d0", "_d1").agg(F.lit(1).alias("_one"))
    return once.groupBy(*keys).agg(F.count("_one").alias("n_edges"))


def hot_key_profile(
    rows: DataFrame,
    keys: Sequence[str] = ("target_artifact_id", "relationship_type"),
    identity: str = "id",
    member: str = "source_artifact_id",
    value: str = "confidence",
) -> DataFrame:
    """Per key: ``n_edges`` (distinct identities), ``n_sources`` (distinct members), ``mean_confidence``.

    Repeated rows of one identity count once; a null identity counts as no edge.
    Null keys form their own group; null members are not counted as a source; null values are
    left out of the mean, which is null if none is left (values count to nine decimals).
    Rows of one identity that disagree on the value take the largest; that disagree on the
    key count under each. An empty table gives no rows. Other columns are ignored.
    """
    keys = list(keys)
    counted = rows.where(F.col(identity).isNotNull())
    edges = (
        counted.select(*keys, *_digest(identity), value)
        .groupBy(*keys, "_d0", "_d1")
        .agg(F.max(F.col(value).cast("decimal(18,9)")).alias("_v"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_edges"), F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    )
    sources = counted.select(*keys, *_digest(member)).groupBy(*keys, "_d0", "_d1").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("_d0").alias("n_sources"))
    left, right = edges.alias("l"), sources.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    mean = F.when(F.col("_n") > 0, F.col("_s").cast("double") / F.col("_n"))
    return left.join(right, same).select(*(F.col(f"l.{k}").alias(k) for k in keys), "n_edges", "n_sources", mean.alias("mean_confidence"))


def hot_keys(profile: DataFrame, share: float = 0.01, count: str = "n_edges") -> DataFrame:
    """Keys of a profile that hold at least ``share`` of everything counted.

    The total is a scalar subquery. Its aggregate names every column of the profile, so both
    plans are the same below and the exchanges are run once and reused.
    """
    others = [c for c in profile.columns if c != count]
    total = profile.agg(F.sum(count).alias("_total"), *(F.max(c).alias(f"_{c}") for c in others))
    total = total.select(F.struct(*total.columns).alias("_t")).select(F.col("_t._total"))
    return profile.where(F.col(count) >= total.scalar() * share)
