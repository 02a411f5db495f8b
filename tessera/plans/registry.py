"""Every registered query of the library and its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan (spark, sf_dir) -> DataFrame and the SQL that gives the same rows."""

    def add(plan):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLE_SQL[name] = sql
        return plan

    return add


def load() -> None:
    for module in ("core", "relations", "eventlog", "passages", "evaluation", "retrieval", "documents", "probes", "resolution", "checks", "assembly"):
        importlib.import_module(f"tessera.plans.{module}")
