"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fernweft.materialize import new_path

FORMATS = ("parquet", "orc", "json", "csv", "xml", "avro", "text")
OPTIONS = {
    "csv": {"header": "true", "escape": '"', "multiLine": "true", "emptyValue": '""', "nullValue": ""},
    "json": {"ignoreNullFields": "false"},
    "xml": {"rowTag": "row", "rootTag": "rows"},
}


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Scan files; a schema saves the pass that would infer one."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known are {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**OPTIONS.get(fmt, {}) | options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_files(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "error", **options: str) -> None:
    """Write files, one folder for each value of ``partition_by``."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known are {', '.join(FORMATS)}")
    writer = df.write.format(fmt).mode(mode).options(**OPTIONS.get(fmt, {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def round_trip(df: DataFrame, fmt: str, partition_by: list[str] | None = None) -> DataFrame:
    """What a reader gets of a table written in a format."""
    path = new_path(df.sparkSession, f"files-{fmt}")
    write_files(df, path, fmt, partition_by)
    return read_files(df.sparkSession, path, fmt, df.schema).select(*df.columns)
