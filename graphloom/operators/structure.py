"""Aggregates and rankings over the graph (AGG, TOP, WIN families)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.graph import CLUSTER_PATTERNS, first_match, is_test, path_of
from graphloom.operators.graph import degrees, once

CORE_TYPES = ["CLASS", "INTERFACE", "SERVICE", "COMPONENT", "CONTROLLER"]


def type_counts(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-01: ``snapshot_id, entity, kind, n`` for artifact and relationship types."""
    a = once(artifacts).groupBy("snapshot_id", F.lit("artifact").alias("entity"), F.col("artifact_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    e = once(edges).groupBy("snapshot_id", F.lit("edge").alias("entity"), F.col("relationship_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(e)


def overview(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-02, AGG-25: per snapshot: artifacts, files, tests, endpoints, lines spanned, edges."""
    span = F.when(F.col("line_end") >= F.col("line_start"), F.col("line_end") - F.col("line_start") + 1).otherwise(0)
    a = once(artifacts).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("artifacts"), F.count_distinct(path_of("location")).alias("files"), F.count_if(F.col("artifact_type") == "TEST_CASE").alias("tests"), F.count_if(F.col("artifact_type") == "API_ENDPOINT").alias("endpoints"), F.sum(span).alias("lines"))
    e = once(edges).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("edges"))
    return a.join(e, "snapshot_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def packages(artifacts: DataFrame, samples: int = 3) -> DataFrame:
    """AGG-03: per snapshot and package (first path segment, else first dotted part, else ``root``): totals, files, first names.

    The sample keeps the smallest names by a running top-k of array slices, so a large package is never collected whole.
    """
    path = path_of("location")
    package = F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).when(F.col("qualified_name").contains("."), F.split_part("qualified_name", F.lit("."), F.lit(1))).otherwise("root")
    rows = once(artifacts).withColumn("package", package)
    sums = rows.groupBy("snapshot_id", "package").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("artifact_type") == "CLASS").alias("classes"), F.count_if(F.col("artifact_type").isin("FUNCTION", "METHOD")).alias("functions"), F.count_if(F.col("artifact_type") == "MODULE").alias("modules"), F.count_distinct(path).alias("files"))
    first = rows.select("snapshot_id", "package", "name").distinct().withColumn("n", F.row_number().over(W.partitionBy("snapshot_id", "package").orderBy("name"))).where(F.col("n") <= samples)
    names = first.groupBy("snapshot_id", "package").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("sample"))
    return sums.join(names, ["snapshot_id", "package"])


def language_share(artifacts: DataFrame) -> DataFrame:
    """AGG-04: per snapshot and language: symbols and their share in percent; null and empty languages are ``unknown``."""
    rows = once(artifacts).groupBy("snapshot_id", F.coalesce(F.when(F.col("language") != "", F.lower("language")), F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("symbols"))
    return rows.withColumn("share", 100 * F.col("symbols") / F.sum("symbols").over(W.partitionBy("snapshot_id")))


def scan_rhythm(snapshots: DataFrame) -> DataFrame:
    """AGG-05: snapshots per repository, month, weekday (Monday 0) and four-hour bucket."""
    return once(snapshots).groupBy("repository_id", F.date_format("created_at", "yyyy-MM").alias("month"), F.weekday("created_at").alias("weekday"), F.floor(F.hour("created_at") / 4).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def activity_tags(snapshots: DataFrame, least: int = 3) -> DataFrame:
    """AGG-06: per repository with at least ``least`` scans: shares at night, early, at weekends and in office hours, as tags."""
    hour, day = F.hour("created_at"), F.weekday("created_at")
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    rows = once(snapshots).where("created_at is not null").groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), share(hour >= 22).alias("night"), share((hour >= 5) & (hour < 9)).alias("early"), share(day >= 5).alias("weekend"), share((hour >= 9) & (hour < 17) & (day < 5)).alias("office")).where(F.col("n") >= least)
    tags = F.array_compact(F.array(F.when(F.col("night") >= 0.3, "night"), F.when(F.col("early") >= 0.2, "early"), F.when(F.col("weekend") >= 0.25, "weekend"), F.when(F.col("office") >= 0.4, "office")))
    return rows.select("repository_id", "n", F.coalesce(F.when(F.size(tags) > 0, F.array_join(tags, ",")), F.lit("steady")).alias("tags"))


def churn(changes: DataFrame) -> DataFrame:
    """AGG-07: per snapshot: added, removed, net growth (never negative) and removed per hundred added (at most 100)."""
    rows = changes.groupBy("snapshot_id").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    ratio = F.when(F.col("added") > 0, F.least(F.lit(100.0), 100 * F.col("removed") / F.col("added"))).otherwise(0.0)
    return rows.withColumn("net", F.greatest(F.lit(0), F.col("added") - F.col("removed"))).withColumn("removed_per_added", ratio)


def scale(snapshots: DataFrame, artifacts: DataFrame) -> DataFrame:
    """AGG-08: size class of each snapshot by its lines (per file the last line of any symbol); without any known line it has none."""
    files = artifacts.where("line_end is not null").groupBy("snapshot_id", path_of("location").alias("file")).agg(F.max("line_end").alias("lines"))
    total = files.groupBy("snapshot_id").agg(F.sum("lines").alias("n_lines"))
    n = F.col("n_lines")
    kind = F.when(n < 1_000, "tiny").when(n < 10_000, "small").when(n < 50_000, "medium").when(n < 250_000, "large").when(n.isNotNull(), "huge")
    return snapshots.select(F.col("id").alias("snapshot_id")).distinct().join(total, "snapshot_id", "left").select("snapshot_id", "n_lines", kind.alias("scale"))


def code_ratios(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-09: per snapshot: documented and async share of callables, edges per artifact, tests per hundred artifacts."""
    call = F.col("artifact_type").isin("FUNCTION", "METHOD", "CONSTRUCTOR")
    a = once(artifacts).groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(call).alias("calls"),
        F.count_if(call & (F.coalesce(F.trim("docstring"), F.lit("")) != "")).alias("documented"),
        F.count_if(call & F.element_at("metadata", "async").isNotNull()).alias("asynchronous"),
        F.count_if(F.col("artifact_type") == "TEST_CASE").alias("tests"),
    )
    e = once(edges).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("edges"))
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    rows = a.join(e, "snapshot_id", "left")
    return rows.select("snapshot_id", safe(F.col("documented"), F.col("calls")).alias("documented_share"), safe(F.col("asynchronous"), F.col("calls")).alias("async_share"), safe(F.coalesce("edges", F.lit(0)), F.col("n")).alias("coupling"), safe(100 * F.col("tests"), F.col("n")).alias("tests_per_100"))


def most_changed_files(changes: DataFrame) -> DataFrame:
    """AGG-10: per repository side of the change set: the file with most changed symbols, ties by name."""
    rows = changes.groupBy("pair", "source_file").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("pair").orderBy(F.desc("n"), "source_file")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("pair", "source_file", "n")


def cluster_of(artifacts: DataFrame) -> DataFrame:
    """AGG-11: ``id, snapshot_id, cluster`` by path pattern, else by type."""
    at = F.lower(F.coalesce("location", "qualified_name", F.lit("")))
    kind = F.col("artifact_type")
    entry = at.contains("main") | at.contains("server") | at.contains("index") | at.contains("app")
    by_type = F.when(kind.isin("API_ENDPOINT", "HTTP_ROUTE"), "api").when(kind.isin("DATABASE_ENTITY", "TABLE"), "data").when(kind.isin("SERVICE", "CLASS"), "service").when(entry, "application").otherwise("utility")
    return once(artifacts).select("id", "snapshot_id", F.coalesce(first_match(at, CLUSTER_PATTERNS, None), by_type).alias("cluster"), path_of("location").alias("file"))


def clusters(artifacts: DataFrame) -> DataFrame:
    """AGG-11: per snapshot and cluster: symbols, files, health score."""
    rows = cluster_of(artifacts).groupBy("snapshot_id", "cluster").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("file").alias("files"))
    n = F.col("symbols")
    health = 8.5 - F.when(n > 100, 2.0).when(n > 40, 1.0).otherwise(0.0) - F.when(F.col("cluster").isin("service", "api") & (n > 15), 1.5).otherwise(0.0)
    return rows.withColumn("health", F.greatest(F.lit(3.2), F.least(F.lit(10.0), health)))


def cluster_edges(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-12: per snapshot: edges between different clusters and their drawing weight (1 to 8)."""
    c = cluster_of(artifacts)
    rows = once(edges).select("snapshot_id", "source_artifact_id", "target_artifact_id").join(c.select(F.col("id").alias("source_artifact_id"), F.col("cluster").alias("source")), "source_artifact_id").join(c.select(F.col("id").alias("target_artifact_id"), F.col("cluster").alias("target")), "target_artifact_id")
    sums = rows.where("source <> target").groupBy("snapshot_id", "source", "target").agg(F.count(F.lit(1)).alias("n"))
    return sums.withColumn("weight", F.least(F.lit(8), F.greatest(F.lit(1), F.floor(F.log2(F.col("n") + 1) + 0.5).cast("int"))))


def file_health(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-13: per snapshot and file: lines, symbols, whether a test reaches it, health between 1.2 and 9.8."""
    rows = once(artifacts).select("id", "snapshot_id", path_of("location").alias("file"), "line_end")
    tested = once(edges).where("upper(relationship_type) = 'TESTS'").select(F.col("target_artifact_id").alias("id"), F.lit(1).alias("hit")).distinct()
    sums = rows.join(tested, "id", "left").groupBy("snapshot_id", "file").agg(F.max("line_end").alias("lines"), F.count(F.lit(1)).alias("symbols"), F.coalesce(F.max("hit"), F.lit(0)).alias("reached"))
    score = 8.5 - F.when(F.col("lines") > 1000, 2.5).when(F.col("lines") > 400, 1.5).otherwise(0.0) - F.when(F.col("reached") == 0, 2.0).otherwise(0.0)
    return sums.withColumn("health", F.greatest(F.lit(1.2), F.least(F.lit(9.8), score)))


def test_coverage(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-14: per snapshot: tests, tested artifacts, testable artifacts, ratio and status."""
    rows = once(artifacts)
    test = is_test(F.col("artifact_type"), F.col("location"), F.col("name"))
    tested = once(edges).where("upper(relationship_type) = 'TESTS'").select(F.col("target_artifact_id").alias("id"), F.lit(True).alias("hit")).distinct()
    sums = rows.withColumn("t", test).join(tested, "id", "left").groupBy("snapshot_id").agg(F.count_if("t").alias("tests"), F.count_if(~F.col("t") & F.col("hit").isNotNull()).alias("tested"), F.count_if(~F.col("t")).alias("testable"))
    ratio = F.when(F.col("testable") > 0, F.col("tested") / F.col("testable")).otherwise(0.0)
    return sums.withColumn("ratio", ratio).withColumn("status", F.when(F.col("tests") == 0, "NONE").when(F.col("ratio") >= 0.5, "GOOD").when(F.col("ratio") >= 0.1, "PARTIAL").otherwise("LOW"))


def folders(artifacts: DataFrame, top: int = 10) -> DataFrame:
    """AGG-15: the ``top`` folders of each snapshot by symbols, ties by name."""
    rows = once(artifacts).groupBy("snapshot_id", F.regexp_replace(path_of("location"), r"/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("symbols"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.desc("symbols"), "folder"))).where(F.col("rank") <= top)


def top_records(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """TOP-01: per snapshot: longest symbol, longest name, most reused name, most connected symbol. Ties take the smaller id or name."""
    rows = once(artifacts)
    longest = rows.where("line_end >= line_start").groupBy("snapshot_id").agg(F.min(F.struct((F.col("line_start") - F.col("line_end")).alias("k"), "id")).alias("m")).select("snapshot_id", F.lit("longest_symbol").alias("record"), F.col("m.id").alias("holder"), (1 - F.col("m.k")).cast("bigint").alias("value"))
    name = rows.where("name is not null").groupBy("snapshot_id").agg(F.min(F.struct((-F.length("name")).alias("k"), "name")).alias("m")).select("snapshot_id", F.lit("longest_name").alias("record"), F.col("m.name").alias("holder"), (-F.col("m.k")).cast("bigint").alias("value"))
    reused = rows.where("length(name) > 2").groupBy("snapshot_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("snapshot_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "name")).alias("m")).select("snapshot_id", F.lit("most_reused_name").alias("record"), F.col("m.name").alias("holder"), (-F.col("m.k")).alias("value"))
    linked = degrees(edges).join(rows.where("artifact_type not in ('MODULE', 'PACKAGE')").select("id"), "id").groupBy("snapshot_id").agg(F.min(F.struct((-(F.col("edges_in") + F.col("edges_out"))).alias("k"), "id")).alias("m")).select("snapshot_id", F.lit("most_connected").alias("record"), F.col("m.id").alias("holder"), (-F.col("m.k")).cast("bigint").alias("value"))
    return longest.unionByName(name).unionByName(reused).unionByName(linked)


def hubs(artifacts: DataFrame, edges: DataFrame, top: int = 8) -> DataFrame:
    """TOP-02: the ``top`` artifacts of each snapshot by all edges, ties by id."""
    rows = degrees(edges).join(once(artifacts).select("id", "name"), "id").withColumn("degree", F.col("edges_in") + F.col("edges_out"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.desc("degree"), "id"))).where(F.col("rank") <= top).select("snapshot_id", "id", "name", "degree", "rank")


def fan_outs(artifacts: DataFrame, edges: DataFrame, least: int = 8) -> DataFrame:
    """TOP-03, ARC-06: artifacts with at least ``least`` distinct targets."""
    return degrees(edges).where(F.col("fan_out") >= least).join(once(artifacts).select("id", "qualified_name"), "id").select("snapshot_id", "id", "qualified_name", "fan_out")


def snapshot_list(snapshots: DataFrame, artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """MSC-01, MSC-03: every snapshot with its stored counts and a status made from them where none is given."""
    a = once(artifacts).groupBy(F.col("snapshot_id").alias("id")).agg(F.count(F.lit(1)).alias("n_artifacts"))
    e = once(edges).groupBy(F.col("snapshot_id").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"))
    rows = once(snapshots).join(a, "id", "left").join(e, "id", "left")
    status = F.coalesce(F.element_at("snapshot_metadata", "status"), F.when(F.coalesce("n_artifacts", F.lit(0)) == 0, "NEEDS_REINDEX").when(F.coalesce("n_edges", F.lit(0)) == 0, "INCOMPLETE_DATA").otherwise("READY"))
    return rows.select(F.col("id").alias("snapshot_id"), "repository_id", "created_at", F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), status.alias("status"))


def incident_counts(incidents: DataFrame) -> DataFrame:
    """AGG-23: incidents by severity (lower case) and status."""
    return once(incidents).groupBy(F.lower("severity").alias("severity"), "status").agg(F.count(F.lit(1)).alias("n"))
