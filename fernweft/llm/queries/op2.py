"""Verdicts on the URLs of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweft.llm.url_filter import Rule, UrlModel, judge
from fernweft.tables import read_table

NAME = "op2_url_filter"

# Fixed values of the contract.
RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    found = judge(pages, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), RULES, UrlModel())
    return found.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.odds")
