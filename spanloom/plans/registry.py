"""Collects the named queries of all packs and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with ``QUERIES`` and ``ORACLES``.
PACKS = ("spans_pack", "stats_pack", "linking_pack", "io_pack", "files_pack")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for p in PACKS for k, f in import_module(f"{__package__}.{p}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in PACKS for k, s in import_module(f"{__package__}.{p}").ORACLES.items()}
