"""Filters, lookups and resolution cascades (FLT, JN families)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.graph import path_of
from graphloom.operators.graph import once
from graphloom.operators.instants import service_of
from graphloom.session import bounded_broadcast


def artifact_scan(artifacts: DataFrame, kind: str | None = None, language: str | None = None) -> DataFrame:
    """FLT-01: artifacts by type (compared in upper case) and language (in lower case)."""
    rows = once(artifacts)
    rows = rows.where(F.col("artifact_type") == kind.upper()) if kind else rows
    return rows.where(F.lower("language") == language.lower()) if language else rows


def edge_scan(edges: DataFrame, kind: str) -> DataFrame:
    """FLT-02: edges of one type."""
    return once(edges).where(F.col("relationship_type") == kind)


def dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """FLT-03: edges with the names of both ends, ``unknown`` where an end has no record."""
    named = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"))
    rows = once(edges).join(named("s"), F.col("source_artifact_id") == F.col("s_id"), "left").join(named("t"), F.col("target_artifact_id") == F.col("t_id"), "left")
    return rows.select("id", "snapshot_id", "relationship_type", F.coalesce("s_name", F.lit("unknown")).alias("source_name"), F.coalesce("t_name", F.lit("unknown")).alias("target_name"))


def event_filter(events: DataFrame, environment: str | None = None, severity: str | None = None, event_type: str | None = None, service: str | None = None) -> DataFrame:
    """FLT-04: exact environment, type and severity whatever the case, service by part of the name."""
    rows = events
    if environment:
        rows = rows.where(F.col("environment") == environment)
    for column, value in (("severity", severity), ("event_type", event_type)):
        if value:
            rows = rows.where(F.upper(column) == value.upper())
    if service:
        rows = rows.where(F.lower(service_of(rows)).contains(service.lower()))
    return rows


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """LIM-01: one page; the size is kept within 1 to 200, the order must end in a unique column."""
    size = min(200, max(1, size))
    return rows.orderBy(*order).offset(max(0, number) * size).limit(size)


def api_surface(artifacts: DataFrame) -> DataFrame:
    """FLT-06: endpoints with their method (GET where none is given)."""
    return once(artifacts).where("artifact_type = 'API_ENDPOINT'").select("id", "snapshot_id", "qualified_name", F.coalesce(F.element_at("metadata", "http_method"), F.lit("GET")).alias("http_method"))


def candidates(artifacts: DataFrame, term: str) -> DataFrame:
    """FLT-07: artifacts with the term in name, qualified name or location, whatever the case."""
    low = term.lower()
    return once(artifacts).where(F.lower("name").contains(low) | F.lower("qualified_name").contains(low) | F.lower("location").contains(low))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """FLT-11: the newest snapshot of each repository; ties go to the larger id."""
    return once(snapshots).groupBy("repository_id").agg(F.max(F.struct("created_at", "id")).alias("m")).select("repository_id", F.col("m.id").alias("snapshot_id"))


def preceding_snapshots(snapshots: DataFrame) -> DataFrame:
    """FLT-12: each snapshot with the one created before it in its repository (as-of lookup)."""
    return once(snapshots).select(F.col("id").alias("snapshot_id"), F.lag("id").over(W.partitionBy("repository_id").orderBy("created_at", "id")).alias("preceding_id"))


def resolved_revisions(snapshots: DataFrame, revisions: DataFrame) -> DataFrame:
    """FLT-13: ``revision, snapshot_id, matched_by``: by id, else commit, else commit prefix of at least seven characters.

    Prefixes are met by joining on their first seven characters, so no pair of all revisions and snapshots is built.
    Several snapshots of the best kind: the newest, then the larger id.
    """
    snaps = once(snapshots).select("id", "commit_hash", "created_at", F.substring("commit_hash", 1, 7).alias("head"))
    wanted = revisions.select("revision").where("revision is not null").distinct()
    by = lambda rank, kind, rows: rows.select("revision", F.struct(F.lit(-rank).alias("rank"), "created_at", "id", F.lit(kind).alias("kind")).alias("m"))
    parts = [
        by(1, "id", wanted.join(snaps, F.col("revision") == F.col("id"))),
        by(2, "commit", wanted.join(snaps, F.col("revision") == F.col("commit_hash"))),
        by(3, "prefix", wanted.where(F.length("revision") >= 7).join(snaps, F.substring("revision", 1, 7) == F.col("head")).where(F.col("commit_hash").startswith(F.col("revision")))),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("revision").agg(F.max("m").alias("m")).select("revision", F.col("m.id").alias("snapshot_id"), F.col("m.kind").alias("matched_by"))


def resolved_entities(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """FLT-14: ``snapshot_id, ident, artifact_id, matched_by, ambiguous``.

    An identifier (``snapshot_id, ident``) is an id, else a qualified name, else a name, else one of these whatever the case, else a
    file. The best kind decides; several artifacts of it make it ambiguous and give the smallest id.
    """
    rows = once(artifacts).select("snapshot_id", "id", "name", "qualified_name", path_of("location").alias("file"))
    idents = wanted.select("snapshot_id", "ident").where("ident is not null").distinct()
    kinds = [("id", F.col("id"), False), ("qualified_name", F.col("qualified_name"), False), ("name", F.col("name"), False), ("any_case", F.lower("qualified_name"), True), ("any_case", F.lower("name"), True), ("file", F.col("file"), False)]
    rank = {"id": 1, "qualified_name": 2, "name": 3, "any_case": 4, "file": 5}
    parts = []
    for kind, key, lower in kinds:
        right = rows.select("snapshot_id", key.alias("key"), "id")
        left = idents.withColumn("key", F.lower("ident") if lower else F.col("ident"))
        parts.append(left.join(right, ["snapshot_id", "key"]).select("snapshot_id", "ident", F.lit(rank[kind]).alias("rank"), F.lit(kind).alias("matched_by"), "id"))
    found = reduce(DataFrame.unionByName, parts).groupBy("snapshot_id", "ident", "rank", "matched_by").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))
    best = found.groupBy("snapshot_id", "ident").agg(F.min(F.struct("rank", "id", "matched_by", "n")).alias("m"))
    return best.select("snapshot_id", "ident", F.col("m.id").alias("artifact_id"), F.col("m.matched_by").alias("matched_by"), (F.col("m.n") > 1).alias("ambiguous"))


def symbols_at(hunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """JN-07: symbols whose lines overlap changed lines (``snapshot_id, file, first_line, last_line``) of the same file.

    Joined on snapshot and file; the interval test is a residual. A missing end is the start; symbols without lines never overlap.
    """
    rows = once(artifacts).select("snapshot_id", path_of("location").alias("file"), F.col("id").alias("artifact_id"), F.col("line_start").alias("low"), F.coalesce("line_end", "line_start").alias("high"))
    met = hunks.join(rows, ["snapshot_id", "file"]).where((F.col("low") <= F.col("last_line")) & (F.col("high") >= F.col("first_line")))
    return met.select("snapshot_id", "file", "artifact_id").distinct()


def commit_overview(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """JN-13: commits seen at run time and commits scanned, full outer on the short hash."""
    seen = events.where("commit_sha is not null").groupBy(F.substring("commit_sha", 1, 7).alias("commit")).agg(F.count_distinct("event_id").alias("n_events"))
    scanned = once(snapshots).groupBy(F.substring("commit_hash", 1, 7).alias("commit")).agg(F.count(F.lit(1)).alias("n_snapshots"))
    both = scanned.alias("a").join(seen.alias("b"), "commit", "full_outer")
    return both.select("commit", F.coalesce("n_snapshots", F.lit(0)).alias("n_snapshots"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def observed_artifacts(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """JN-14: artifacts seen at run time by id, or by name whatever the case."""
    ids = events.select(F.col("component_artifact_id").alias("id")).where("id is not null").distinct()
    names = events.select(F.lower("component_name").alias("low")).where("low is not null").distinct()
    rows = once(artifacts).select("id", "snapshot_id", F.lower("name").alias("low"))
    return rows.join(ids, "id", "left_semi").select("id", "snapshot_id").unionByName(rows.join(names, "low", "left_semi").select("id", "snapshot_id")).distinct()


def untested(artifacts: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """JN-15: artifacts of the given types that no TESTS edge points at."""
    tested = once(edges).where("upper(relationship_type) = 'TESTS'").select(F.col("target_artifact_id").alias("id"))
    return once(artifacts).where(F.col("artifact_type").isin(kinds)).join(tested, "id", "left_anti").select("id", "snapshot_id", "qualified_name")


def mutual_edges(edges: DataFrame) -> DataFrame:
    """JN-16: ``snapshot_id, a, b`` with a < b and edges both ways."""
    way = once(edges).select("snapshot_id", F.least("source_artifact_id", "target_artifact_id").alias("a"), F.greatest("source_artifact_id", "target_artifact_id").alias("b"), (F.col("source_artifact_id") < F.col("target_artifact_id")).alias("up")).where("a <> b")
    return way.groupBy("snapshot_id", "a", "b").agg(F.bool_or("up").alias("u"), F.bool_or(~F.col("up")).alias("d")).where("u and d").select("snapshot_id", "a", "b")


def test_catalog(artifacts: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN-19: tests with the names of what they test, call or import, sorted and joined."""
    tests = once(artifacts).where("artifact_type = 'TEST_CASE'").select(F.col("id").alias("test_id"), "snapshot_id", F.col("qualified_name").alias("test_name"))
    used = once(edges).where(F.upper("relationship_type").isin("TESTS", "CALLS", "IMPORTS")).select(F.col("source_artifact_id").alias("test_id"), F.col("target_artifact_id").alias("id")).join(nodes.select("id", F.col("qualified_name").alias("target")), "id")
    return tests.join(used.select("test_id", "target"), "test_id", "left").groupBy("test_id", "snapshot_id", "test_name").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))


def longest_prefix(rows: DataFrame, value: str, prefixes: DataFrame, label: str) -> DataFrame:
    """FLT-18: ``value`` with the label of the longest pattern that is it or a dotted prefix of it, else null.

    The value's own prefixes are exploded and joined by equality, so patterns are never crossed with rows.
    """
    parts = F.split(F.regexp_replace(F.regexp_replace(F.col(value), "/", "."), r"^(backend\.|src\.|services\.)", ""), r"\.")
    own = rows.select(value).distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("prefix", F.array_join(F.slice(parts, 1, F.col("n")), "."))
    found = own.join(bounded_broadcast(prefixes.select("prefix", label)), "prefix").groupBy(value).agg(F.max_by(label, "n").alias(label))
    return rows.join(found, value, "left")
