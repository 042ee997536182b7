"""Queries of the training-text problems; none of them can be put in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import leaks, packing, spam
from graphloom.sources.tables import table

BUDGET = "standard"


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    budget = table(spark, folder, "context_budgets").where(f"budget_name = '{BUDGET}'").agg({"capacity_tokens": "max"}).first()[0]
    return packing.packed(table(spark, folder, "documents"), int(budget))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _containers(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(_containers(spark, folder))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(_leaks(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return spam.page_shares(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p7_containers, p7_fill, p8_found, p8_items, p9_found, p9_shares)}
SQL: dict[str, str] = {}
