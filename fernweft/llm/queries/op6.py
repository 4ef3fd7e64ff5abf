"""All documents in shards 0 to 7 of a hash tree, and with one shard more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweft.llm.sharding import assign, grow, shard_tree
from fernweft.tables import read_table

NAME = "op6_hash_tree"
SHARDS = 8


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(read_table(spark, sf_dir, "documents"), shard_tree(SHARDS), grow(shard_tree(SHARDS)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
