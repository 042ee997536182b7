"""Column expressions over artifacts and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a relationship passes impact on: direction, factor, whether it does.
IMPACT_RULES = {
    "CALLS": ("reverse", 1.0, True),
    "IMPORTS": ("reverse", 0.95, True),
    "DEPENDS_ON": ("reverse", 0.95, True),
    "CONSUMES": ("reverse", 0.90, True),
    "EXTENDS": ("reverse", 1.0, True),
    "IMPLEMENTS": ("reverse", 1.0, True),
    "PERSISTS_TO": ("reverse", 0.90, True),
    "EXPOSES": ("forward", 0.95, True),
    "TESTS": ("reverse", 1.0, True),
    "PARTICIPATES_IN": ("forward", 0.85, True),
    "TRANSITIONS_TO": ("forward", 0.85, True),
    "CONTAINS": ("reverse", 0.70, False),
    "PART_OF": ("forward", 0.70, False),
}
#: Relationships that lead from a change to tests.
TEST_RULES = {r: ("reverse", 1.0, True) for r in ("TESTS", "CALLS", "IMPORTS", "DEPENDS_ON", "EXTENDS", "IMPLEMENTS", "CONSUMES")} | {r: ("forward", 1.0, True) for r in ("EXPOSES", "CONTAINS", "PART_OF")}
#: Words in a path by layer; the first layer with a match counts.
LAYER_WORDS = {
    "presentation": ["api", "controller", "presentation", "routes", "web", "endpoint"],
    "application": ["service", "application", "usecase", "handler", "manager"],
    "domain": ["domain", "model", "entity", "schema"],
    "infrastructure": ["db", "database", "repository", "infrastructure", "client", "adapter"],
    "test": ["test"],
}
#: Path patterns of clusters; the first cluster with a match counts.
CLUSTER_PATTERNS = {
    "ui": ["components/", "pages/", "views/", "frontend/", ".tsx", ".jsx", ".vue"],
    "api": ["api/", "routes/", "controllers/", "gateway/"],
    "middleware": ["middleware", "auth", "guard", "security"],
    "service": ["services/", "service", "domain/", "logic/"],
    "data": ["models/", "entities/", "database/", "db/", "schema", "tables"],
    "utility": ["utils/", "common/", "lib/", "helpers/"],
    "test": ["test/", "tests/", "__tests__", ".test.", ".spec."],
    "config": ["config", ".env", "docker", "scripts/", "docs/"],
}
MACRO_TYPES = ["PACKAGE", "DIRECTORY", "SERVICE", "DATABASE", "API_ENDPOINT", "DOCKER_STAGE", "SQL_TABLE", "DATABASE_TABLE"]
COMPONENT_TYPES = ["PACKAGE", "MODULE", "CLASS", "INTERFACE", "SERVICE", "COMPONENT", "API_ENDPOINT", "DATABASE_TABLE", "SQL_TABLE", "TEST_CASE", "TEST_SUITE", "DOCKER_STAGE"]
MEMBER_TYPES = ["METHOD", "FUNCTION", "CONSTRUCTOR"]


def first_match(text: Column, words: dict[str, list[str]], otherwise: str | None) -> Column:
    """The first key any of whose words is contained in the text."""
    out = None
    for name, parts in words.items():
        hit = text.contains(parts[0])
        for part in parts[1:]:
            hit = hit | text.contains(part)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def path_of(location: Column | str) -> Column:
    """File part of ``path:line`` with forward slashes."""
    value = F.col(location) if isinstance(location, str) else location
    return F.split_part(F.translate(value, "\\", "/"), F.lit(":"), F.lit(1))


def layer_of_path(path: Column) -> Column:
    return first_match(F.lower(F.coalesce(path, F.lit(""))), LAYER_WORDS, "core")


def level_of_type(kind: Column) -> Column:
    """1 for macro types, 2 for components, 3 for members, 4 for the rest."""
    upper = F.upper(kind)
    return F.when(upper.isin(MACRO_TYPES), 1).when(upper.isin(COMPONENT_TYPES), 2).when(upper.isin(MEMBER_TYPES), 3).otherwise(4)


def is_test(kind: Column, location: Column, name: Column) -> Column:
    """Test artifacts by type, or by path and name."""
    path = F.lower(F.coalesce(location, F.lit("")))
    named = name.startswith("test_") | name.endswith("Test") | name.endswith("Tests")
    return F.coalesce(F.upper(kind).isin("TEST_CASE", "TEST_SUITE") | ((path.contains("/test") | path.startswith("test")) & named), F.lit(False))


def rule(rel: Column, rules: dict, position: int) -> Column:
    """One attribute of a relationship's rule, null without an enabled one."""
    out = F.lit(None)
    for name, values in rules.items():
        if values[2]:
            out = F.when(rel == name, F.lit(values[position])).otherwise(out)
    return out
