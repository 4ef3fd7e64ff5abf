"""Queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from fernweft.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    """Queries and SQL by name, in the order of their definition."""

    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated query; ``oracle`` is its DuckDB SQL."""

        def register(query: Query) -> Query:
            self.queries[name] = query
            if oracle:
                self.sql[name] = oracle
            return query

        return register

    def add_sql(self, name: str, tables: str, spark_sql: str, oracle: str | None = None) -> None:
        """Register a query in Spark SQL over ``tables``; ``oracle`` defaults
        to the same text."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = {t: read_table(spark, sf_dir, t) for t in tables.split()}
            # Tables are passed as arguments, so queries leave no views behind.
            return spark.sql(spark_sql.format_map({t: "{" + t + "}" for t in frames}), **frames)

        self.queries[name] = query
        self.sql[name] = oracle or spark_sql.format_map({t: t for t in tables.split()})
