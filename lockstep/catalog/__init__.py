"""Registered queries: each pairs a Spark plan over the warehouse with SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lockstep import verification
from lockstep.sources.warehouse import Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(build: Callable[[Warehouse], DataFrame]):
        QUERIES[name] = lambda spark, path: build(Warehouse(spark, path))
        if sql is not None:
            ORACLE[name] = verification.sql(sql)
        return build
    return wrap


def load() -> None:
    from lockstep.catalog import (coverage, ingest, research, sessions, signals, snapshots,  # noqa: F401
                                  text)
