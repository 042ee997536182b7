"""Architecture conformance and guardrails (ARC family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.graph import path_of
from graphloom.operators.graph import degrees, edges_with_ends, once
from graphloom.operators.lookup import longest_prefix, mutual_edges
from graphloom.operators.traversal import cycles, plain_links
from graphloom.sources.baseline import Baseline

USES = ["IMPORTS", "CALLS", "DEPENDS_ON"]
LINKS = [*USES, "REFERENCES"]
#: Words of low and high layers for inversion without a baseline.
LOW_WORDS = ["model", "entities", "database", "db", "schema"]
HIGH_WORDS = ["controller", "router", "route", "view", "api"]


def _any(text: F.Column, words: list[str]) -> F.Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def layered_uses(edges: DataFrame, nodes: DataFrame, baseline: Baseline) -> DataFrame:
    """Uses between artifacts with the layers of both ends (null where a module has none)."""
    kept = once(edges).where(F.upper("relationship_type").isin(USES))
    layers = longest_prefix(nodes.select("id", F.trim("qualified_name").alias("q")), "q", baseline.modules, "layer").select("id", "q", "layer")
    end = lambda p: layers.select(F.col("id").alias(f"{p}_artifact_id"), F.col("q").alias(f"{p}_name"), F.col("layer").alias(f"{p}_layer"))
    return kept.select("snapshot_id", "source_artifact_id", "target_artifact_id", "relationship_type").join(end("source"), "source_artifact_id").join(end("target"), "target_artifact_id")


def drift(edges: DataFrame, nodes: DataFrame, baseline: Baseline) -> DataFrame:
    """JN-10, JN-11, layers and imports of ARC-01: ``snapshot_id, category, severity, source_name, target_name``, each finding once.

    Layer boundaries that are forbidden (HIGH) or not in a non-empty list of allowed ones (MEDIUM), and imports whose name is, or is
    under, a forbidden prefix (HIGH).
    """
    uses = layered_uses(edges, nodes, baseline)
    crossing = uses.join(F.broadcast(baseline.policy), ["source_layer", "target_layer"])
    boundaries = crossing.select("snapshot_id", F.lit("LAYER_BOUNDARY").alias("category"), F.when(F.col("verdict") == "FORBIDDEN", "HIGH").otherwise("MEDIUM").alias("severity"), "source_name", "target_name")
    top = F.split_part("target_name", F.lit("."), F.lit(1))
    banned = uses.join(F.broadcast(baseline.imports), (F.col("source_layer") == F.col("layer")) & (top == F.split_part("import_prefix", F.lit("."), F.lit(1))))
    banned = banned.where((F.col("target_name") == F.col("import_prefix")) | F.col("target_name").startswith(F.concat("import_prefix", F.lit("."))))
    return boundaries.unionByName(banned.select("snapshot_id", F.lit("FORBIDDEN_IMPORT").alias("category"), F.lit("HIGH").alias("severity"), "source_name", "target_name")).distinct()


def _named_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``links`` with the names of ``source_artifact_id`` and ``target_artifact_id``; those of unknown nodes are left out."""
    end = lambda p: nodes.select(F.col("id").alias(f"{p}_artifact_id"), F.trim("qualified_name").alias(f"{p}_name"))
    return links.join(end("source"), "source_artifact_id").join(end("target"), "target_artifact_id")


def rule_findings(edges: DataFrame, nodes: DataFrame, baseline: Baseline) -> DataFrame:
    """Uses and references whose ends are, or are under, the source and target of an explicit rule; each finding once."""
    kept = edges.where(F.upper("relationship_type").isin(LINKS)).select("snapshot_id", "source_artifact_id", "target_artifact_id")
    under = lambda name, prefix: (F.col(name) == F.col(prefix)) | F.col(name).startswith(F.concat(prefix, F.lit(".")))
    hits = _named_ends(kept, nodes).join(F.broadcast(baseline.rules), under("source_name", "rule_source") & under("target_name", "rule_target"))
    return hits.select("snapshot_id", "category", "severity", "source_name", "target_name").distinct()


def cycle_findings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for every simple cycle, of any length, of uses and references: the names of its smallest node and of the next one."""
    loops = cycles(plain_links(edges, LINKS), None)
    ends = loops.select(F.col("graph").alias("snapshot_id"), F.col("path")[0].alias("source_artifact_id"), F.col("path")[1].alias("target_artifact_id"))
    return _named_ends(ends, nodes).select("snapshot_id", F.lit("CIRCULAR_DEPENDENCY").alias("category"), F.lit("CRITICAL").alias("severity"), "source_name", "target_name")


def full_drift(edges: DataFrame, nodes: DataFrame, baseline: Baseline) -> DataFrame:
    """ARC-01: findings of layers and imports, of explicit rules and of cycles; cycles that begin with the same link are rows of their own."""
    return drift(edges, nodes, baseline).unionByName(rule_findings(edges, nodes, baseline)).unionByName(cycle_findings(edges, nodes))


def conformance(edges: DataFrame, nodes: DataFrame, findings: DataFrame, baseline: Baseline) -> DataFrame:
    """AGG-21: per snapshot: uses, violations and conformance in percent (100 without violations)."""
    uses = once(edges).where(F.upper("relationship_type").isin(USES)).join(nodes.select(F.col("id").alias("source_artifact_id")), "source_artifact_id", "left_semi").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("uses"))
    bad = findings.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("violations"))
    rows = uses.join(bad, "snapshot_id", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    base = F.greatest(F.col("uses"), F.lit(3 * baseline.layer_count + baseline.rule_count))
    return rows.withColumn("conformance", F.greatest(F.lit(0.0), 100 - 100 * F.col("violations") / base))


def drift_changes(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """DIF-07: per snapshot pair: findings that are new, resolved or persistent."""
    roles = pairs.select(F.col("snapshot_id").alias("pair"), F.explode(F.array(F.struct(F.col("snapshot_id").alias("sid"), F.lit(True).alias("now")), F.struct(F.col("previous_id").alias("sid"), F.lit(False).alias("now")))).alias("r")).select("pair", F.col("r.sid").alias("snapshot_id"), "r.now")
    keyed = findings.join(roles, "snapshot_id").groupBy("pair", "category", "source_name", "target_name").agg(F.bool_or("now").alias("a"), F.bool_or(~F.col("now")).alias("b"))
    state = F.when(F.col("a") & F.col("b"), "persistent").when(F.col("a"), "new").otherwise("resolved")
    return keyed.groupBy("pair", "category", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def boundary_evidence(findings: DataFrame, uses: DataFrame, most: int = 10) -> DataFrame:
    """ARC-05: layer boundaries by pair of layers with the number of findings and the first ``most`` names."""
    from pyspark.sql import Window as W

    layers = uses.select("snapshot_id", "source_name", "target_name", "source_layer", "target_layer").distinct()
    rows = findings.where("category = 'LAYER_BOUNDARY'").join(layers, ["snapshot_id", "source_name", "target_name"])
    keys = ["snapshot_id", "source_layer", "target_layer"]
    ranked = rows.select(*keys, F.concat_ws(" -> ", "source_name", "target_name").alias("e")).withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("e")))
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.col("e")))), ", ")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first.alias("evidence"))


def inversions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """ARC-08: imports and calls from low-layer paths to high-layer ones, by words in the location."""
    rows = edges_with_ends(edges, nodes).where(F.upper("relationship_type").isin("IMPORTS", "CALLS"))
    at = lambda p: F.lower(F.coalesce(F.when(F.col(f"{p}_location") != "", F.col(f"{p}_location")), f"{p}_qualified_name", F.lit("")))
    return rows.where(_any(at("s"), LOW_WORDS) & _any(at("t"), HIGH_WORDS)).select("snapshot_id", F.col("s_qualified_name").alias("source_name"), F.col("t_qualified_name").alias("target_name")).distinct()


def test_debt(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """ARC-07: per snapshot: tests, modules and classes, how many of these no test reaches, verdict."""
    rows = once(artifacts)
    tested = once(edges).where("upper(relationship_type) in ('TESTS', 'TESTED_BY', 'COVERS')").select(F.col("target_artifact_id").alias("id"), F.lit(True).alias("hit")).distinct()
    code = F.col("artifact_type").isin("MODULE", "CLASS")
    sums = rows.join(tested, "id", "left").groupBy("snapshot_id").agg(F.count_if(F.col("artifact_type") == "TEST_CASE").alias("tests"), F.count_if(code).alias("modules"), F.count_if(code & F.col("hit").isNull()).alias("untested"))
    ratio = F.col("tests") / F.greatest(F.col("modules"), F.lit(1))
    return sums.withColumn("ratio", ratio).withColumn("verdict", F.when(F.col("ratio") < 0.05, "VIOLATION").when((F.col("ratio") < 0.2) | (F.col("untested") > 5), "WARN").otherwise("PASS"))


def assessment(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """ARC-09, ARC-11: per snapshot and dimension a score from mutual uses, hubs, orphan endpoints and tested components."""
    rows = once(artifacts)
    mutual = mutual_edges(edges).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("cycles"))
    deg = degrees(edges)
    god = deg.where("edges_out >= 12 or (edges_in >= 15 and edges_out >= 8)").join(rows.select("id"), "id", "left_semi").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("hubs"))
    api = rows.where("artifact_type = 'API_ENDPOINT'").select("id", "snapshot_id").join(deg.where("edges_in > 0").select("id"), "id", "left_anti").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("orphans"))
    tested = once(edges).where("upper(relationship_type) = 'TESTS'").groupBy("snapshot_id").agg(F.count_distinct("target_artifact_id").alias("tested"))
    base = rows.groupBy("snapshot_id").agg(F.count_if(F.col("artifact_type") == "API_ENDPOINT").alias("endpoints"), F.count_if(F.col("artifact_type").isin("SERVICE", "CONTROLLER", "COMPONENT", "CLASS")).alias("core"), F.count_if(F.col("artifact_type") == "TEST_CASE").alias("tests"))
    wide = reduce(lambda a, b: a.join(b, "snapshot_id", "left"), [mutual, god, api, tested], base).fillna(0)
    dims = {
        "architecture": F.greatest(100.0 - 15 * F.col("cycles"), F.lit(30.0)),
        "coupling": F.greatest(100.0 - 12 * F.col("hubs"), F.lit(40.0)),
        "interface": F.when(F.col("endpoints") == 0, 70.0).otherwise(F.greatest(100.0 - 5 * F.col("orphans"), F.lit(60.0))),
        "testing": F.when(F.col("tests") == 0, 0.0).when(F.col("core") == 0, 50.0).otherwise(F.least(100.0 * F.col("tested") / F.col("core"), F.lit(100.0))),
    }
    return wide.select("snapshot_id", F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), s.cast("double").alias("score")) for n, s in dims.items()))).alias("d")).select("snapshot_id", "d.*")


def import_lines(texts: DataFrame) -> DataFrame:
    """EXT-11, EXT-12: ``path, line_no, module`` of import statements in source texts (``path, text``)."""
    lines = texts.select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("i", "line"))
    module = F.coalesce(*(F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in (r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)")))
    return lines.select("path", (F.col("i") + 1).alias("line_no"), module.alias("module")).where("module is not null")


def file_layers(files: DataFrame) -> DataFrame:
    """Path of a file as a module name."""
    return files.select("path", F.regexp_replace(F.regexp_replace(path_of("path"), r"\.[^./]*$", ""), "/", ".").alias("module"))
