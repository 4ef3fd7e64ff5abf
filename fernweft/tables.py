"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; columns and filters of the caller reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temporary views, for queries written in SQL."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
