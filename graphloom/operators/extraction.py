"""Source text to artifacts and edges (EXT family).

Input rows are ``path, language, text``. Line-oriented languages are taken apart with built-in expressions; Python
source needs its syntax tree and goes through ``mapInPandas``. Edges name their ends by qualified name; ``link`` turns these into ids.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ARTIFACT = ["artifact_type", "language", "name", "qualified_name", "path", "line_start", "line_end", "confidence"]
EDGE = ["source", "target", "relationship_type", "path", "line", "confidence"]
RAW = "record string, kind string, language string, name string, qualified_name string, target string, path string, line_start int, line_end int, confidence double"
#: Calls of these say nothing about the graph.
BUILTINS = {"print", "len", "range", "str", "int", "float", "dict", "list", "set"}


def module_name(path: str) -> str:
    return path.replace("\\", "/").removesuffix(".py").removesuffix("/__init__").strip("/").replace("/", ".")


def python_records(path: str, text: str) -> list[tuple]:
    """EXT-01: records of one Python file; a file that does not parse gives its module only."""
    module = module_name(path)
    lines = text.count("\n") + 1
    in_tests = "test" in path.lower()
    out: list[tuple] = [("A", "MODULE", "python", module.rpartition(".")[2], module, None, path, 1, lines, 1.0)]
    edge = lambda kind, source, target, line, confidence: out.append(("E", kind, "python", None, source, target, path, line, None, confidence))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out

    def calls(owner: str, body: ast.AST) -> None:
        for node in ast.walk(body):
            if isinstance(node, ast.Call):
                name = ast.unparse(node.func) if isinstance(node.func, (ast.Name, ast.Attribute)) else None
                if name and name not in BUILTINS:
                    edge("CALLS", owner, name, node.lineno, 0.85)

    def visit(nodes: list[ast.stmt], owner: str, in_class: bool) -> None:
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                own = f"{owner}.{node.name}"
                out.append(("A", "CLASS", "python", node.name, own, None, path, node.lineno, node.end_lineno, 1.0))
                edge("CONTAINS", owner, own, node.lineno, 1.0)
                for base in node.bases:
                    edge("EXTENDS", own, ast.unparse(base), node.lineno, 0.95)
                visit(node.body, own, True)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = f"{owner}.{node.name}"
                test = node.name.startswith("test_") or in_tests
                out.append(("A", "TEST_CASE" if test else "METHOD" if in_class else "FUNCTION", "python", node.name, own, None, path, node.lineno, node.end_lineno, 1.0))
                edge("CONTAINS", owner, own, node.lineno, 1.0)
                if node.name.startswith("test_"):
                    edge("TESTS", own, node.name[5:], node.lineno, 0.90)
                for deco in node.decorator_list:
                    route = deco.func if isinstance(deco, ast.Call) else None
                    if isinstance(route, ast.Attribute) and isinstance(route.value, ast.Name) and route.value.id in ("app", "router") and route.attr in ("get", "post", "put", "delete", "patch") and deco.args and isinstance(deco.args[0], ast.Constant):
                        endpoint = f"{route.attr.upper()} {deco.args[0].value}"
                        out.append(("A", "API_ENDPOINT", "python", endpoint, f"{module}::{endpoint}", None, path, node.lineno, node.lineno, 0.99))
                        edge("EXPOSES", own, f"{module}::{endpoint}", node.lineno, 0.99)
                calls(own, node)
            elif isinstance(node, ast.Import):
                for name in node.names:
                    edge("IMPORTS", module, name.name, node.lineno, 1.0)
            elif isinstance(node, ast.ImportFrom):
                edge("IMPORTS", module, "." * node.level + (node.module or ""), node.lineno, 1.0)

    visit(tree.body, module, False)
    return out


def _python(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [r for path, text in zip(batch["path"], batch["text"], strict=True) for r in python_records(path, text)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])


def python_source(files: DataFrame) -> DataFrame:
    """EXT-01 for every Python file."""
    return files.where("language = 'python' and text is not null and path is not null").select("path", "text").mapInPandas(_python, RAW)


def _lines(files: DataFrame, languages: list[str]) -> DataFrame:
    rows = files.where(F.col("language").isin(languages) & F.col("text").isNotNull())
    return rows.select("path", "language", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("i", "line")).withColumn("n", F.col("i") + 1)


def _artifact(rows: DataFrame, kind: str, name, qualified, confidence: float) -> DataFrame:
    return rows.select(F.lit("A").alias("record"), F.lit(kind).alias("kind"), "language", name.alias("name"), qualified.alias("qualified_name"), F.lit(None).cast("string").alias("target"), "path", F.col("n").cast("int").alias("line_start"), F.col("n").cast("int").alias("line_end"), F.lit(confidence).alias("confidence"))


def _edge(rows: DataFrame, kind: str, source, target, confidence: float) -> DataFrame:
    return rows.select(F.lit("E").alias("record"), F.lit(kind).alias("kind"), "language", F.lit(None).cast("string").alias("name"), source.alias("qualified_name"), target.alias("target"), "path", F.col("n").cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(confidence).alias("confidence"))


def _matched(rows: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    return rows.withColumn("x", F.regexp_extract("line", pattern, group)).where("x <> ''")


def _compose_services(lines: DataFrame) -> DataFrame:
    """Lines of compose files that name a service: one level below the top key ``services``. The window holds the lines of one file."""
    within = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    kept = lines.where(~F.col("line").rlike(r"^\s*(#|$)"))
    top = F.last(F.when(F.col("line").rlike(r"^\w"), F.regexp_extract("line", r"^(\w+)", 1)), ignorenulls=True).over(within)
    key = kept.select("*", top.alias("top"), F.length(F.regexp_extract("line", r"^( *)", 1)).alias("depth"), F.regexp_extract("line", r"^ +([\w.-]+):\s*(?:#.*)?$", 1).alias("x")).where("top = 'services' and depth > 0")
    least = F.min("depth").over(W.partitionBy("path"))
    return key.withColumn("least", least).where("depth = least and x <> ''")


def line_languages(files: DataFrame) -> DataFrame:
    """EXT-02 to EXT-07 for line-oriented patterns: TypeScript and JavaScript, Java, COBOL, C and C++, SQL, Docker."""
    name, x = F.col("path"), F.col("x")
    script = _lines(files, ["typescript", "javascript"])
    java = _lines(files, ["java"])
    cobol, native, sql, docker = _lines(files, ["cobol"]).withColumn("line", F.upper("line")), _lines(files, ["c", "cpp"]), _lines(files, ["sql", "plsql"]), _lines(files, ["dockerfile"])
    own = F.concat_ws("::", name, x)
    java_class = F.concat_ws("::", name, F.element_at(F.split(F.element_at(F.split(F.col("path"), "/"), -1), r"\."), 1))  # by rule a file has the name of its public class
    java_test = F.lower(F.col("path")).contains("test")
    java_methods = _matched(java, r"^\s+(?:@\w+\s+)*(?:(?:public|protected|private|static|final|synchronized|abstract)\s+)+(?:<[^>]+>\s+)?[\w.<>\[\], ?]+?\s+(\w+)\s*\([^;=]*\)\s*(?:throws\s+[\w., ]+)?\{?\s*$")
    java_mapped = _matched(java, r"@(?:Get|Post|Put|Delete|Patch)Mapping\((?:value\s*=\s*)?\"([^\"]+)\"")
    java_subject = F.regexp_replace(F.element_at(F.split(F.element_at(F.split(F.col("path"), "/"), -1), r"\."), 1), r"(?:^Test|Tests?$|IT$)", "")
    compose = _lines(files, ["yaml"]).where(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"^(docker-)?compose[\w.-]*\.ya?ml$"))
    parts = [
        _artifact(_matched(java, r"^\s*package\s+([\w.]+)\s*;"), "PACKAGE", F.element_at(F.split(x, r"\."), -1), x, 1.0),
        _artifact(java_methods.where(~java_test), "METHOD", x, F.concat_ws(".", java_class, x), 0.95),
        _artifact(java_methods.where(java_test), "TEST_CASE", x, F.concat_ws(".", java_class, x), 0.95),
        _edge(java_methods, "CONTAINS", java_class, F.concat_ws(".", java_class, x), 1.0),
        _edge(java_methods.where(java_test & (java_subject != "")), "TESTS", F.concat_ws(".", java_class, x), java_subject, 0.7),
        _edge(java_mapped, "EXPOSES", java_class, own, 0.99),
        _artifact(_matched(script, r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), "FUNCTION", x, own, 0.95),
        _artifact(_compose_services(compose), "SERVICE", x, own, 0.95),
        _artifact(_matched(docker, r"(?i)^FROM\s+(?:--\S+\s+)?(\S+)\s*$"), "DOCKER_STAGE", x, F.concat_ws("::", name, F.concat_ws("@", x, "n")), 1.0),
        _edge(_matched(docker, r"(?i)^FROM\s+(?:--\S+\s+)?(\S+)"), "DEPENDS_ON", name, x, 1.0),
        _edge(_matched(docker, r"(?i)^EXPOSE\s+(\d+)"), "EXPOSES", name, x, 1.0),
        _edge(_matched(script, r"^\s*import\b.*?['\"]([^'\"]+)['\"]"), "IMPORTS", name, x, 1.0),
        _artifact(_matched(script, r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), "CLASS", x, own, 1.0),
        _artifact(_matched(script, r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"), "FUNCTION", x, own, 1.0),
        _edge(_matched(script, r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|const|class)\s+(\w+)"), "EXPORTS", name, own, 1.0),
        _artifact(_matched(script, r"\b(?:describe|it|test)\(\s*['\"`]([^'\"`]+)"), "TEST_CASE", x, own, 0.95),
        _edge(_matched(java, r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), "IMPORTS", name, x, 1.0),
        _artifact(_matched(java, r"\bclass\s+(\w+)"), "CLASS", x, own, 1.0),
        _artifact(_matched(java, r"\binterface\s+(\w+)"), "INTERFACE", x, own, 1.0),
        _edge(_matched(java, r"\bclass\s+\w+\s+extends\s+([\w.]+)"), "EXTENDS", F.concat_ws("::", name, F.regexp_extract("line", r"\bclass\s+(\w+)", 1)), x, 0.95),
        _artifact(_matched(java, r"@(?:Get|Post|Put|Delete|Patch)Mapping\((?:value\s*=\s*)?\"([^\"]+)\""), "API_ENDPOINT", x, own, 0.99),
        _artifact(_matched(cobol, r"\b(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b"), "COBOL_DIVISION", x, own, 1.0),
        _edge(_matched(cobol, r"\bCOPY\s+([A-Z0-9_-]+)"), "COPY_DEPENDS_ON", name, x, 0.95),
        _edge(_matched(native, r"#include\s+[\"<]([^\">]+)[\">]"), "INCLUDES", name, x, 1.0),
        _artifact(_matched(native, r"\b(?:class|struct)\s+(\w+)\b"), "CPP_STRUCT", x, own, 0.95),
        _artifact(_matched(sql, r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)"), "SQL_TABLE", x, F.concat(F.lit("db::table::"), x), 1.0),
        _artifact(_matched(docker, r"(?i)^FROM\s+\S+\s+AS\s+(\S+)"), "DOCKER_STAGE", x, own, 1.0),
    ]
    return reduce(DataFrame.unionByName, parts)


def extracted(files: DataFrame) -> DataFrame:
    """EXT-10: all records of all analyzers; equal records once."""
    return python_source(files).unionByName(line_languages(files)).distinct()


def artifact_id(snapshot, language, path, kind, qualified):
    """Content id of an artifact."""
    clean = F.btrim(F.translate(path, "\\", "/"), F.lit("/"))
    return F.concat(F.lit("art_"), F.substring(F.sha2(F.concat_ws("::", snapshot, F.lower(language), clean, F.upper(kind), qualified), 256), 1, 28))


def relationship_id(snapshot, source, kind, target):
    """Content id of an edge."""
    return F.concat(F.lit("rel_"), F.substring(F.sha2(F.concat_ws("::", snapshot, source, F.upper(kind), target), 256), 1, 28))


def linked(records: DataFrame, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """SNK-01: artifacts and edges of a snapshot with ids; ends without an artifact become placeholders.

    Ends are met by exact qualified name (the smallest id where several share it). An unknown source becomes a PACKAGE ``<source>``, an
    unknown target an EXTERNAL_DEPENDENCY ``<external>``; both have the last dotted part as name. Texts are kept whole.
    """
    snap = F.lit(snapshot_id)
    a = records.where("record = 'A'").select(artifact_id(snap, F.col("language"), F.col("path"), F.col("kind"), F.col("qualified_name")).alias("id"), snap.alias("snapshot_id"), F.col("kind").alias("artifact_type"), "language", "name", "qualified_name", F.concat_ws(":", "path", "line_start").alias("location"), "line_start", "line_end", "confidence")
    a = a.groupBy("id").agg(*(F.min(c).alias(c) for c in a.columns if c != "id"))
    known = a.groupBy("qualified_name").agg(F.min("id").alias("known"))
    e = records.where("record = 'E'").select(F.col("qualified_name").alias("source"), "target", F.col("kind").alias("relationship_type"), F.concat_ws(":", "path", "line_start").alias("source_location"), "confidence")
    e = e.join(known.withColumnsRenamed({"qualified_name": "source", "known": "s_id"}), "source", "left").join(known.withColumnsRenamed({"qualified_name": "target", "known": "t_id"}), "target", "left")
    s_new = artifact_id(snap, F.lit("generic"), F.lit("<source>"), F.lit("PACKAGE"), F.col("source"))
    t_new = artifact_id(snap, F.lit("external"), F.lit("<external>"), F.lit("EXTERNAL_DEPENDENCY"), F.col("target"))
    made = e.where("s_id is null").select(s_new.alias("id"), F.col("source").alias("q"), F.lit("PACKAGE").alias("kind"), F.lit("generic").alias("language"), F.lit("<source>").alias("location"))
    made = made.unionByName(e.where("t_id is null").select(t_new.alias("id"), F.col("target").alias("q"), F.lit("EXTERNAL_DEPENDENCY").alias("kind"), F.lit("external").alias("language"), F.lit("<external>").alias("location"))).dropDuplicates(["id"])
    made = made.select("id", snap.alias("snapshot_id"), F.col("kind").alias("artifact_type"), "language", F.element_at(F.split("q", r"\."), -1).alias("name"), F.col("q").alias("qualified_name"), "location", F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(0.5).alias("confidence"))
    e = e.withColumns({"source_artifact_id": F.coalesce("s_id", s_new), "target_artifact_id": F.coalesce("t_id", t_new)})
    e = e.withColumn("id", relationship_id(snap, F.col("source_artifact_id"), F.col("relationship_type"), F.col("target_artifact_id")))
    edges = e.groupBy("id").agg(snap.alias("snapshot_id"), *(F.min(c).alias(c) for c in ("source_artifact_id", "target_artifact_id", "relationship_type", "confidence", "source_location")))
    return a.unionByName(made), edges


def write_snapshot(rows: DataFrame, path: str) -> None:
    """SNK-01: idempotent write: the rows' snapshots replace their partitions, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)
