"""Registry of the grid queries: one entry ties a Spark plan to its reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register fn(spark, sf_dir) under name, with the SQL that must give the same rows."""

    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


# Each module registers its queries as it is imported.
from .queries import audit_queries, change_queries, composition, extras, notes_queries, reference_queries, region_queries  # noqa: E402, F401
