"""All queries of the engine outside the training-data subpackage."""

from __future__ import annotations

from importlib import import_module

from fernweft.plans.catalog import Query

MODULES = ("relational", "scalars", "streams", "extensions")


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in import_module(f"fernweft.plans.{m}").CATALOG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"fernweft.plans.{m}").CATALOG.sql.items()}
