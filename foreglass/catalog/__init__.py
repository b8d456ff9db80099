"""Registered queries with their SQL counterparts.

Every query reads the given tables. ``register`` stores the Spark callable and,
where SQL can say the same on whole tables, the SQL used to check it.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foreglass.scale import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AREAS = (
    "scans",
    "relational",
    "joins",
    "profiles",
    "ratings",
    "runs",
    "sequences",
    "texts",
    "replies",
    "retrieval",
    "linkage",
    "samples",
    "learning",
    "jobs",
    "streams",
)


def register(name: str, sql: str | None = None):
    """Decorator: add a query under ``name``."""

    def keep(function):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table with long texts, with enough partitions for CPU-bound work on them."""
    return spread(table(spark, sf_dir, name), key)


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
