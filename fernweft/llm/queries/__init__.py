"""Queries over the text tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in (import_module(f"{__name__}.{x}") for x in MODULES)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    found = (import_module(f"{__name__}.{x}") for x in MODULES)
    return {m.NAME: m.ORACLE for m in found if getattr(m, "ORACLE", None)}
