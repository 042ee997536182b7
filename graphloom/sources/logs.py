"""Event files, commit logs, diffs and label files as tables (SRC-05, SRC-07, SRC-14 to SRC-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id string, timestamp string, event_type string, service string, service_name string, component_name string, environment string, severity string, message string, trace_id string, span_id string, request_id string, commit_sha string, attributes map<string,string>"


def read_events(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """SRC-05: events of a JSON array file, or of JSON lines where lines that cannot be read are dropped."""
    reader = spark.read.schema(EVENT).option("mode", "FAILFAST" if array else "DROPMALFORMED")
    return reader.option("multiLine", str(array).lower()).json(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """The same events as a stream of JSON line files."""
    return spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def commits(log: DataFrame, most_files: int = 50) -> DataFrame:
    """SRC-07: commits from ``git log --numstat`` blocks (one row each, column ``value``).

    A block is ``sha, parents, author, date, subject`` separated by the unit separator, then one line per file: added, deleted, path; ``-`` is binary.
    """
    head = F.split(F.split_part("value", F.lit("\n"), F.lit(1)), "\x1f")
    files = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^(\d+|-)\t(\d+|-)\t"))
    part = lambda x, i: F.split_part(x, F.lit("\t"), F.lit(i))
    number = lambda i: F.aggregate(files, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(F.try_to_number(F.nullif(part(x, i), F.lit("-")), F.lit("999999999")).cast("bigint"), F.lit(0).cast("bigint")))
    rows = log.select(head.alias("h"), files.alias("f"), number(1).alias("additions"), number(2).alias("deletions"))
    parents = F.filter(F.split(F.coalesce(F.try_element_at("h", F.lit(2)), F.lit("")), " "), lambda p: p != "")
    return rows.where(F.size("h") >= 5).select(
        F.try_element_at("h", F.lit(1)).alias("commit_sha"), F.try_element_at("h", F.lit(3)).alias("author"), F.try_element_at("h", F.lit(4)).alias("authored_date"), F.try_element_at("h", F.lit(5)).alias("message"), parents.alias("parent_hashes"), (F.size(parents) > 1).alias("is_merge"),
        F.size("f").alias("files_changed"), "additions", "deletions", F.slice(F.transform("f", lambda x: F.struct(part(x, 3).alias("path"), (part(x, 1) == "-").alias("is_binary"))), 1, most_files).alias("files"),
    )


def ancestors(history: DataFrame, spark_depth: int | None = None) -> DataFrame:
    """SRC-10: ``commit_sha, ancestor`` of all generations, or within ``spark_depth``, by frontier joins over parent hashes."""
    from graphloom.operators.traversal import reach

    links = history.select(F.lit("h").alias("graph"), F.col("commit_sha").alias("src"), F.explode("parent_hashes").alias("dst")).withColumns({"rel": F.lit("PARENT"), "weight": F.lit(1.0)})
    found = reach(history.select(F.lit("h").alias("graph"), F.col("commit_sha").alias("root")), links, spark_depth)
    return found.where("depth > 0").select(F.col("root").alias("commit_sha"), F.col("node").alias("ancestor"))


def name_status(lines: DataFrame) -> DataFrame:
    """SRC-16: ``change_type, path, old_path`` from lines of ``git diff --name-status -M`` (column ``value``)."""
    parts = F.split("value", "\t")
    code = F.substring(parts[0], 1, 1)
    kind = F.when(code == "A", "ADDED").when(code == "D", "REMOVED").when(code == "M", "MODIFIED").when(code == "R", "RENAMED")
    return lines.select(kind.alias("change_type"), F.element_at(parts, -1).alias("path"), F.when(code == "R", parts[1]).alias("old_path")).where("change_type is not null")


def hunks(diffs: DataFrame) -> DataFrame:
    """SRC-15: ``path, first_line, last_line`` of the new side of ``diff -U0`` texts (``path, text``); pure deletions touch the line before."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^@@ -\d+(?:,\d+)? (\+\d+(?:,\d+)?) @@"), 1))
    rows = diffs.select("path", found.alias("h"))
    first: Column = F.regexp_extract("h", r"\+(\d+)", 1).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("h", r",(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return rows.select("path", first.alias("first_line"), (first + F.greatest(count, F.lit(1)) - 1).alias("last_line"))


def labels(spark: SparkSession, path: str, flag: str = "is_independent") -> DataFrame:
    """SRC-14: label files with an ``items`` array as rows; ``flag`` names the field that calls the labels independent."""
    schema = f"case_id string, evaluation_mode string, `{flag}` boolean, items array<struct<entity:string,label:string,source:string,method:string,confidence:double>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select("case_id", F.col(flag).alias("is_independent"), F.explode_outer("items").alias("i")).select("case_id", "is_independent", "i.*")
