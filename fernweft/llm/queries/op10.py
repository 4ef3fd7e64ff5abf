"""Main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweft.llm.html_extract import Scoring, extract_pages
from fernweft.tables import read_table

NAME = "op10_html_tree"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(read_table(spark, sf_dir, "pages"), "text", how=Scoring())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
