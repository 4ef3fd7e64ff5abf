"""Languages of all documents, by a net that never saw the held-out third."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernweft.llm.langid import ByteNet, Training, identify, train
from fernweft.tables import read_table

NAME = "op8_byte_cnn"


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fitted(docs: DataFrame, training: Training = Training()) -> ByteNet:
    """A net from the labelled documents that are not held out."""
    return train(docs.where(~F.coalesce(held_out(), F.lit(False))), training)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fitted(docs), "found")
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
