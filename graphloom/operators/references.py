"""Problem 5: references to records that do not exist.

State per key: how many references point at it and how many records exist under it, both
signed sums of change deltas (+1 added, -1 removed), so the state can be kept up by merging
deltas. Keys with references above zero and existence at zero are the orphans; only those
are joined back to the referring rows. Sums combine map-side, so hot keys stay compact;
the join back meets only orphan keys and is left to AQE's skew join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import key
from graphloom.session import bounded_broadcast

COLUMNS = ["ref_table", "ref_id", "missing_key", "kind"]


def deltas(rows: DataFrame, keys: list[str], references: int = 0, existence: int = 0) -> DataFrame:
    """One change delta per row."""
    return rows.select(*keys, F.lit(references).cast("bigint").alias("refs"), F.lit(existence).cast("bigint").alias("exist"))


def merged_state(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """State from deltas, or from an earlier state and deltas; both have the same columns.

    Keys whose two sums are zero leave the state. Null keys are no keys.
    """
    rows = reduce(DataFrame.unionByName, [p.select(*keys, "refs", "exist") for p in parts])
    rows = rows.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    return rows.groupBy(*keys).agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist")).where("refs <> 0 or exist <> 0")


def orphans(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist."""
    return state.where((F.col("refs") > 0) & (F.col("exist") <= 0))


def _edge_orphans(edges: DataFrame, artifacts: DataFrame, external: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Orphan rows of edges with their snapshot's time.

    An edge's key exists if it is external or an artifact of the edge's own snapshot.
    """
    outside = bounded_broadcast(external.select(key("id").alias("k")).where("k is not null").distinct())
    refs = edges.select(F.col("id").alias("ref_id"), key("target_artifact_id").alias("k"), F.coalesce("snapshot_id", F.lit("")).alias("s"))
    refs = refs.where("k is not null").join(outside, "k", "left_anti")
    records = artifacts.select(key("id").alias("k"), F.coalesce("snapshot_id", F.lit("")).alias("s")).where("k is not null")
    found = orphans(merged_state([deltas(refs, ["k", "s"], references=1), deltas(records, ["k", "s"], existence=1)], ["k", "s"])).select("k", "s")
    times = snapshots.groupBy(F.col("id").alias("s")).agg(F.min("created_at").alias("at"))
    seen = records.join(found.select("k").distinct(), "k", "left_semi").join(times.select("s", F.col("at").alias("record_at")), "s", "left").select("k", "record_at")
    bounds = seen.groupBy("k").agg(F.min("record_at").alias("first_at"), F.max("record_at").alias("last_at"), F.lit(True).alias("known"))
    same = seen.where("record_at is not null").select("k", F.col("record_at").alias("at")).distinct()
    placed = found.join(times, "s", "left").join(same, ["k", "at"], "left_anti").join(bounds, "k", "left")
    late = (F.col("last_at") > F.col("at")) & ~(F.col("first_at") < F.col("at"))
    kind = F.when(F.col("known").isNull(), "missing").when(late, "late").otherwise("deleted")
    back = refs.join(placed.select("k", "s", "at", kind.alias("kind")), ["k", "s"])
    return back.select(F.lit("edges").alias("ref_table"), "ref_id", F.col("k").alias("missing_key"), "kind", F.col("at").alias("period_at"))


def _artifact_link_orphans(links: DataFrame, artifacts: DataFrame, external: DataFrame) -> DataFrame:
    refs = links.where(F.lower("target_type") == "artifact").select(F.col("id").alias("ref_id"), key("target_id").alias("k"), F.col("created_at").alias("at"))
    refs = refs.where("k is not null")
    records = artifacts.select(key("id").alias("k")).unionByName(external.select(key("id").alias("k")))
    found = orphans(merged_state([deltas(refs, ["k"], references=1), deltas(records, ["k"], existence=1)], ["k"])).select("k")
    return refs.join(found, "k").select(F.lit("incident_links").alias("ref_table"), "ref_id", F.col("k").alias("missing_key"), F.lit("missing").alias("kind"), F.col("at").alias("period_at"))


def _event_orphans(links: DataFrame, incidents: DataFrame, events: DataFrame) -> DataFrame:
    linked = links.where(F.lower("target_type") == "runtime_event").select(F.lit("incident_links").alias("ref_table"), F.col("id").alias("ref_id"), key("target_id").alias("k"), F.col("created_at").alias("at"))
    named = incidents.select(F.lit("incidents").alias("ref_table"), F.col("id").alias("ref_id"), F.explode("evidence_ids").alias("e"), F.col("created_at").alias("at")).select("ref_table", "ref_id", key("e").alias("k"), "at")
    refs = linked.unionByName(named).where("k is not null")
    records = events.select(key("event_id").alias("k"), "ingested_at").where("k is not null")
    state = (
        refs.select("k", F.lit(1).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("exist"), F.lit(None).cast("timestamp").alias("seen"), "at")
        .unionByName(records.select("k", F.lit(0).cast("bigint").alias("refs"), F.lit(1).cast("bigint").alias("exist"), F.col("ingested_at").alias("seen"), F.lit(None).cast("timestamp").alias("at")))
        .groupBy("k")
        .agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist"), F.min("seen").alias("first_seen"), F.min("at").alias("first_at"))
        .where((F.col("refs") > 0) & ((F.col("exist") <= 0) | (F.col("first_seen") > F.col("first_at"))))
        .select("k", "exist", "first_seen")
    )
    back = refs.join(state, "k").where((F.col("exist") <= 0) | (F.col("first_seen") > F.col("at")))
    kind = F.when(F.col("exist") <= 0, "missing").otherwise("late")
    return back.select("ref_table", "ref_id", F.col("k").alias("missing_key"), kind.alias("kind"), F.col("at").alias("period_at"))


def dangling_references(edges: DataFrame, links: DataFrame, incidents: DataFrame, artifacts: DataFrame, external: DataFrame, snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """Each reference whose record is missing, deleted or late, once: ``ref_table, ref_id, missing_key, kind, period_at``.

    Keys are compared in lower case without blanks around them; null and empty keys are no
    references; a repeated row or a key named twice by one record counts once. An artifact known
    both before and after an edge's snapshot, or only in snapshots without a time, is ``deleted``;
    one whose snapshot has the very time of the edge's is no orphan. An event without arrival
    time, or a referring record without a time, is never ``late``. ``period_at`` is the time of
    the edge's snapshot or of the record, null where unknown. Empty tables give no rows, or
    all references as missing where it is the referred table that is empty.
    """
    parts = [_edge_orphans(edges, artifacts, external, snapshots), _artifact_link_orphans(links, artifacts, external), _event_orphans(links, incidents, events)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(*COLUMNS).agg(F.min("period_at").alias("period_at"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per referring table, month and kind; the month is null where the time is unknown."""
    return found.groupBy("ref_table", F.date_format("period_at", "yyyy-MM").alias("month"), "kind").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("missing_key").alias("n_keys"))
