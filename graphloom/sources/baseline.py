"""SRC-12: architecture baselines (layers, what each may use, forbidden imports) as small tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

class Baseline:
    """Tables of a baseline: ``modules(prefix, layer)``, ``policy(source_layer, target_layer, verdict)``, ``imports(layer, prefix)``, ``rules(rule_source, rule_target, category, severity)``."""

    def __init__(self, spark: SparkSession, content: dict):
        layers = content.get("layers") or {}
        self.layer_count = len(layers)
        rules = [(r["source"], r["target"], r.get("category", "LAYER_VIOLATION"), r.get("severity", "HIGH")) for r in content.get("rules") or [] if r.get("source") and r.get("target") and r.get("forbidden", True)]
        self.rule_count = sum(len(v) for v in (content.get("forbidden_imports") or {}).values()) + len(content.get("rules") or [])
        modules = [(m.replace("/", "."), n) for n, v in layers.items() for m in v.get("modules") or []]
        policy = []
        for n, v in layers.items():
            banned, allowed = set(v.get("forbidden") or []), set(v.get("allowed") or [])
            for other in layers:
                if other in banned:
                    policy.append((n, other, "FORBIDDEN"))
                elif allowed and other != n and other not in allowed:
                    policy.append((n, other, "NOT_ALLOWED"))
        imports = [(n, p) for n, ps in (content.get("forbidden_imports") or {}).items() for p in ps]
        self.modules: DataFrame = spark.createDataFrame(modules, "prefix string, layer string")
        self.policy: DataFrame = spark.createDataFrame(policy, "source_layer string, target_layer string, verdict string")
        self.rules: DataFrame = spark.createDataFrame(rules, "rule_source string, rule_target string, category string, severity string")
        self.imports: DataFrame = spark.createDataFrame(imports, "layer string, import_prefix string")


def load_baseline(spark: SparkSession, path: str) -> Baseline:
    """The baseline of a YAML file."""
    import yaml

    return Baseline(spark, yaml.safe_load(Path(path).read_text()) or {})
