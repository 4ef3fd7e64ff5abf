"""Exact duplicates among all documents, by a digest index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweft.llm.exact_dedup import DigestIndex, ingest_by_id
from fernweft.tables import read_table

NAME = "op4_exact_dedup"

ORACLE = """
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(body) AS text_sha256
FROM normal
WINDOW same AS (PARTITION BY body)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as two batches: the second meets the filled index."""
    index = DigestIndex.temporary(spark)
    found = ingest_by_id(read_table(spark, sf_dir, "documents"), index, batches=2)
    index.drop()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
