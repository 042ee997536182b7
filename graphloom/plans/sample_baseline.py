"""The architecture baseline that the queries over the sample tables check against."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.sources.baseline import Baseline

#: Roots under which the modules of a role may lie.
ROOTS = ["", "core.", "lib.", "app."]


def _under_roots(names: str) -> list[str]:
    return [root + name for name in names.split() for root in ROOTS]


#: A baseline for graphs whose modules are named by role; used where no file is given.
ROLES = {
    "layers": {
        "presentation": {"modules": _under_roots("gateway router lens channel relay harbor beacon mirror"), "allowed": ["application", "domain"], "forbidden": []},
        "application": {"modules": _under_roots("dispatch planner scheduler courier loader mapper intake parser resolver walker linker"), "allowed": [], "forbidden": ["presentation"]},
        "domain": {"modules": _under_roots("ledger journal notary catalog atlas compass tracker monitor roster docket"), "allowed": [], "forbidden": ["presentation", "application"]},
        "infrastructure": {"modules": _under_roots("cache store vault pool spooler queue shard index buffer engine"), "allowed": ["domain"], "forbidden": []},
    },
    "forbidden_imports": {"domain": ["mellowpool", "opalsigner", "marblerelay"]},
}


def sample_baseline(spark: SparkSession) -> Baseline:
    return Baseline(spark, ROLES)
