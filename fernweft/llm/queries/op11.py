"""Fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweft.llm.order_minhash import OrderMinHash, compare_edited
from fernweft.tables import read_table

NAME = "op11_order_minhash"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(read_table(spark, sf_dir, "documents"), OrderMinHash())
