"""Extraction and discovery over the texts and paths at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import conformance, discovery, extraction
from graphloom.operators.graph import once
from graphloom.functions.graph import path_of
from graphloom.plans.catalog import Catalog
from graphloom.sources.files import EXTENSIONS, line_count

CATALOG = Catalog()
add = CATALOG.add
_FILE = "split_part(replace(location, '\\', '/'), ':', 1)"
_EXT = "(VALUES " + ", ".join(f"('{e}', '{n}')" for e, n in EXTENSIONS.items()) + ") AS v(ext, language)"


def _code(t):
    """Fenced Python of documents as files, one each (``<doc_id>/block.py``): blocks that begin with a definition, a decorator or an import."""
    blocks = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)```\w*\s*\r?\n(\s*(?:@\w|(?:async )?def |class |import |from \w).*?)```"), 1))
    rows = t.documents.where("text is not null").select("doc_id", blocks.alias("k", "text"))
    return rows.select(F.concat_ws("/", F.lit("docs"), F.col("doc_id").cast("string"), F.concat(F.lit("block"), F.col("k").cast("string"), F.lit(".py"))).alias("path"), F.lit("python").alias("language"), "text")


add("ext01_python_records", lambda t: extraction.extracted(_code(t)).groupBy("record", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files")))
add("snk01_linked_edges", lambda t: extraction.linked(extraction.extracted(_code(t)), "snap_docs")[1].select("id", "source_artifact_id", "target_artifact_id", "relationship_type"))
add("ext11_import_lines", lambda t: conformance.import_lines(t.documents.where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text")), "", r"l AS (SELECT doc_id::VARCHAR AS path, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) AS line_no FROM documents WHERE text IS NOT NULL) +++ SELECT path, line_no::INT AS line_no, coalesce(nullif(regexp_extract(line, '^\s*from\s+([\w.]+)\s+import\b', 1), ''), nullif(regexp_extract(line, '^\s*import\s+([\w.]+)', 1), '')) AS module FROM l WHERE module IS NOT NULL")
add("src03_line_counts", lambda t: t.documents.select("doc_id", line_count(F.col("text")).alias("lines"), F.sha2("text", 256).alias("sha256")), "", "+++ SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS lines, sha256(text) AS sha256 FROM documents")
add("dsc01_languages", lambda t: discovery.language_of_artifacts(t.artifacts), "art", f"a AS (SELECT snapshot_id, {_FILE} AS file, lower(split_part({_FILE}, '.', -1)) AS ext FROM art) +++ SELECT snapshot_id, coalesce(v.language, 'unknown') AS language, count(DISTINCT file) AS files, count(*) AS artifacts FROM a LEFT JOIN {_EXT} ON v.ext = a.ext GROUP BY ALL")
add("dsc03_pinned_versions", lambda t: discovery.pinned_versions(t.documents), "", r"x AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, chr(13), ''), '(?m)^([A-Za-z][\w.\-]*==\d+(?:\.\d+)*)\s*$', 1)) AS x FROM documents) +++ SELECT DISTINCT doc_id, split_part(x, '==', 1) AS package, split_part(x, '==', 2) AS version FROM x")
add("dsc10_security_findings", lambda t: discovery.security_findings(t.documents.select(F.col("doc_id").cast("string").alias("path"), "text")))
add("ext12_module_names", lambda t: conformance.file_layers(once(t.artifacts).select(F.col("location").alias("path"))).select(path_of("path").alias("path"), "module").distinct(), "art", f"+++ SELECT DISTINCT {_FILE} AS path, replace(regexp_replace({_FILE}, '\\.[^./]*$', ''), '/', '.') AS module FROM art")
QUERIES, SQL = CATALOG.queries, CATALOG.sql
