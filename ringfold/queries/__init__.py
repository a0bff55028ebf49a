"""Named queries over the TPC-H-like tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .registry import REGISTRY


def load() -> None:
    from . import extraction, geometry, matching, network, routes, scalars  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
