"""Documents that hold test items, verbatim or edited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweft.llm.decontaminate import Matching, find_leaks
from fernweft.tables import read_table

NAME = "op7_decontaminate"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and item."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark"), "leaks", Matching())
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", F.round("leak.score", 4).alias("score"), "leak.start", "leak.end"
    )
