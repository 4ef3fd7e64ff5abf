"""Reading text formats whose rows may be broken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fernweft.materialize import materialize
from fernweft.sources.files import OPTIONS

RAW = "__raw"


@dataclass(frozen=True)
class Checked:
    """Rows that fit the schema, and those that do not: ``raw, file``."""

    good: DataFrame
    bad: DataFrame

    def counts(self) -> tuple[int, int]:
        return self.good.count(), self.bad.count()


def read_checked(spark: SparkSession, path: str, fmt: str, schema: StructType, **options: str) -> Checked:
    """Read CSV or JSON files, and put rows aside that do not fit ``schema``: a
    value of another type, too few or too many columns of a CSV row, broken JSON.

    A record is a line. Files may differ: a JSON field that a file lacks is null
    and one that the schema lacks is passed over; with CSV headers, columns go by
    the names of each file's own header. Empty lines are no rows. Both results
    come from one reading, which is written, so that counts and rows agree.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"rows of {fmt!r} cannot be checked; csv and json can")
    given = OPTIONS.get(fmt, {}) | {"multiLine": "false"} | options
    wide = StructType([*schema.fields, StructField(RAW, StringType())])
    reader = spark.read.format(fmt).options(**given, mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, enforceSchema="false").schema(wide)
    rows = materialize(reader.load(path).select("*", F.col("_metadata.file_path").alias("__file")), "checked")
    good = rows.where(F.col(RAW).isNull()).select(*[F.col(f"`{c}`") for c in schema.names])
    bad = rows.where(F.col(RAW).isNotNull()).select(F.col(RAW).alias("raw"), F.col("__file").alias("file"))
    return Checked(good, bad)
