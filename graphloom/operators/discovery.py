"""What a source tree uses (DSC family), from files or from texts about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.graph import path_of
from graphloom.operators.graph import once
from graphloom.sources.files import language_of

#: Manifests by tool: (file name, kind, tool).
MANIFESTS = [
    ("pom.xml", "build", "maven"), ("build.gradle", "build", "gradle"), ("build.gradle.kts", "build", "gradle"), ("package.json", "package", "npm"), ("package-lock.json", "package", "npm"), ("yarn.lock", "package", "yarn"),
    ("pnpm-lock.yaml", "package", "pnpm"), ("requirements.txt", "package", "pip"), ("pyproject.toml", "build", "pyproject"), ("poetry.lock", "package", "poetry"), ("pipfile", "package", "pipenv"), ("go.mod", "package", "go"),
    ("cargo.toml", "package", "cargo"), ("gemfile", "package", "bundler"), ("composer.json", "package", "composer"), ("makefile", "build", "make"), ("cmakelists.txt", "build", "cmake"), ("dockerfile", "infrastructure", "docker"),
    ("docker-compose.yml", "infrastructure", "docker-compose"), ("docker-compose.yaml", "infrastructure", "docker-compose"), ("pytest.ini", "test", "pytest"), ("conftest.py", "test", "pytest"), ("jest.config.js", "test", "jest"),
]
#: Words in manifests by technology: (word, kind, technology).
TECHNOLOGIES = [
    ("spring-boot", "framework", "spring-boot"), ("fastapi", "framework", "fastapi"), ("django", "framework", "django"), ("flask", "framework", "flask"), ("react", "framework", "react"), ("express", "framework", "express"),
    ("next", "framework", "next"), ("vue", "framework", "vue"), ("angular", "framework", "angular"), ("psycopg", "database", "postgresql"), ("postgresql", "database", "postgresql"), ("mysql", "database", "mysql"), ("sqlite", "database", "sqlite"),
    ("redis", "database", "redis"), ("mongodb", "database", "mongodb"), ("pymongo", "database", "mongodb"), ("graphql", "api", "graphql"), ("grpc", "api", "grpc"), ("openapi", "api", "openapi"), ("pytest", "test", "pytest"), ("junit", "test", "junit"), ("jest", "test", "jest"),
]
#: Security patterns per line: (id, severity, pattern).
SECURITY = [
    ("CREDENTIAL", "HIGH", r"(?i)(?:api_key|apikey|secret_key|secretkey|jwt_secret|auth_token)\s*[:=]\s*['\"]([a-zA-Z0-9_\-./]{16,})['\"]"),
    ("PRIVATE_KEY", "CRITICAL", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----"),
    ("SQL_INJECTION", "HIGH", r"(?i)execute\(\s*f[\"'].*?(?:SELECT|INSERT|UPDATE|DELETE)"),
    ("UNSAFE_EVAL", "MEDIUM", r"(?i)(?:eval|exec)\(\s*[^)]+\)"),
    ("UNSAFE_HTML", "MEDIUM", r"dangerouslySetInnerHTML"),
    ("OPEN_CORS", "MEDIUM", r"allow_origins\s*=\s*\[\s*[\"']\*[\"']\s*\]"),
]


def language_of_artifacts(artifacts: DataFrame) -> DataFrame:
    """DSC-01: files, artifacts and recorded languages per language of the path."""
    return once(artifacts).groupBy("snapshot_id", F.coalesce(language_of(path_of("location")), F.lit("unknown")).alias("language")).agg(F.count_distinct(path_of("location")).alias("files"), F.count(F.lit(1)).alias("artifacts"))


def manifests(files: DataFrame) -> DataFrame:
    """DSC-02, DSC-06, DSC-07: tools by the presence of their files (``path``)."""
    spark = files.sparkSession
    known = spark.createDataFrame(MANIFESTS, "file_name string, kind string, tool string")
    rows = files.select("path", F.lower(F.element_at(F.split("path", "/"), -1)).alias("file_name"))
    return rows.join(F.broadcast(known), "file_name").groupBy("kind", "tool").agg(F.min("path").alias("evidence"), F.count(F.lit(1)).alias("files"))


def technologies(files: DataFrame) -> DataFrame:
    """DSC-03 to DSC-05: technologies named as dependencies in manifest texts (``path, text``), with a version where one follows."""
    names = [m[0] for m in MANIFESTS]
    rows = files.where(F.lower(F.element_at(F.split("path", "/"), -1)).isin(names) & F.col("text").isNotNull())
    hits = F.array_compact(F.array(*(F.when(F.lower("text").contains(w), F.struct(F.lit(k).alias("kind"), F.lit(t).alias("technology"), F.regexp_extract(F.lower("text"), rf"{w}[\w\-\[\]\"']*\s*(?:==|>=|~=|:|\^|@)?\s*[\"'^~]*(\d+(?:\.\d+)*)", 1).alias("version"))) for w, k, t in TECHNOLOGIES)))
    return rows.select("path", F.explode(hits).alias("h")).groupBy("h.kind", "h.technology").agg(F.max("h.version").alias("version"), F.min("path").alias("evidence"))


def pinned_versions(texts: DataFrame) -> DataFrame:
    """DSC-03: ``doc_id, package, version`` of ``name==1.2.3`` lines anywhere in texts."""
    lines = texts.where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^([A-Za-z][\w.\-]*==\d+(?:\.\d+)*)\s*$"), 1)).alias("x"))
    return lines.select("doc_id", F.split_part("x", F.lit("=="), F.lit(1)).alias("package"), F.split_part("x", F.lit("=="), F.lit(2)).alias("version")).distinct()


def security_findings(files: DataFrame, most_lines: int | None = None) -> DataFrame:
    """DSC-10: findings per line of ``path, text``; comment lines are skipped and credentials masked in the evidence."""
    lines = files.where("text is not null").select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("i", "line")).withColumn("line", F.trim("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike(r"^(//|#|/\*|\*)"))
    if most_lines is not None:
        lines = lines.where(F.col("i") < most_lines)
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("finding"), F.lit(s).alias("severity"))) for n, s, p in SECURITY)))
    secret = F.regexp_extract("line", SECURITY[0][2], 1)
    masked = F.when(secret != "", F.replace(F.col("line"), secret, F.concat(F.substring(secret, 1, 4), F.lit("****"), F.right(secret, F.lit(4))))).otherwise(F.col("line"))
    found = lines.select("path", (F.col("i") + 1).alias("line_no"), F.explode(hits).alias("h"), masked.alias("evidence"), "line")
    return found.where(~((F.col("h.finding") == "CREDENTIAL") & F.lower("line").rlike("example|placeholder"))).select("path", "line_no", "h.finding", "h.severity", F.substring("evidence", 1, 120).alias("evidence"))
