"""The registry behind ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FAMILIES = ("text", "retrieval", "vectors", "metrics", "tables", "questions", "answers", "lake", "layout", "chunksets", "joins")


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can run it on whole tables, its check."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"lakequill.catalog.{family}")
