"""SimHash components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweft.llm.simhash import near_duplicates
from fernweft.tables import read_table

NAME = "op3_simhash"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
