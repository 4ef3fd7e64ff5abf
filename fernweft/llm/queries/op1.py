"""Secrets in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernweft.llm.secrets import BASE, Scan, scan_secrets
from fernweft.tables import read_table

NAME = "op1_secrets"


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, "found", scan=Scan()).select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[number(F.col("found"), k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
