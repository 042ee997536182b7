"""Registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.tables import table

#: Common table expressions that the SQL of several queries starts from.
VIEWS = {
    "art": "art AS (SELECT DISTINCT ON (id) * FROM artifacts)",
    "edge": "edge AS (SELECT DISTINCT ON (id) * FROM edges)",
    "ext": "ext AS (SELECT DISTINCT ON (id) * FROM external_nodes)",
    "node": "node AS (SELECT id, artifact_type, language, name, qualified_name, location, snapshot_id FROM (SELECT DISTINCT ON (id) * FROM artifacts) UNION ALL SELECT id, artifact_type, language, name, qualified_name, location, NULL FROM (SELECT DISTINCT ON (id) * FROM external_nodes))",
    "snap": "snap AS (SELECT DISTINCT ON (id) * FROM snapshots)",
    "ev": "ev AS (SELECT * FROM runtime_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at) = 1)",
    "inc": "inc AS (SELECT DISTINCT ON (id) * FROM incidents)",
    "link": "link AS (SELECT DISTINCT ON (id) * FROM incident_links)",
    "pair": "pair AS (SELECT * FROM (SELECT id, lag(id) OVER (PARTITION BY repository_id, branch_name ORDER BY created_at, id) AS prev FROM (SELECT DISTINCT ON (id) * FROM snapshots WHERE snapshot_metadata['status'] = 'READY')) WHERE prev IS NOT NULL)",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """SQL text that begins with the named views (and may go on with its own after ``+``)."""
    parts = [VIEWS[n] for n in names.split()]
    own, _, select = body.rpartition("+++")
    parts += [own.strip().rstrip(",")] if own.strip() else []
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}" if parts else select


class Tables:
    """Lazy access to the tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._folder, name)


class Catalog:
    """Queries and SQL of one family."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], views: str = "", sql: str | None = None) -> None:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.__name__ = name
        self.queries[name] = run
        if sql is not None:
            self.sql[name] = with_views(views, sql)
