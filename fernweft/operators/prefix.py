"""Running totals and gapless numbers over orders too long for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows that one bucket should hold at most, so that a task sorts them in
#: memory, and rows that make a bucket worth having.
MOST_IN_BUCKET, LEAST_IN_BUCKET = 50_000, 250


def bucket_rows(spark: SparkSession, rows: int) -> int:
    """Rows for each bucket, so that all shuffle partitions get some buckets.

    Both bounds are of sizes: no row is left out of a bucket."""
    share = rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(MOST_IN_BUCKET, max(LEAST_IN_BUCKET, share))


def bucket_bits(rows: int, rows_per_bucket: int) -> int:
    """Bits of a uniform hash that split ``rows`` into buckets of that size."""
    return (max(rows, 0) // rows_per_bucket).bit_length()


def running_total(
    df: DataFrame,
    value: Column,
    name: str,
    *,
    within: list[str],
    bucket: str,
    order: list[Column],
) -> DataFrame:
    """Add column ``name``: the inclusive sum of ``value`` in order.

    The order within each ``within`` group is ``bucket`` first and ``order``
    inside a bucket, so ``bucket`` must not decrease along the wanted order.
    Two steps replace the window over whole groups: sums of each bucket give
    its offset (a table of buckets, not of rows), and a window inside each
    bucket adds the rest. No task sees more than a bucket of rows. Groups and
    buckets may be null; an empty input gives an empty output.
    """
    keys = [*within, bucket]
    before = Window.partitionBy(*within).orderBy(F.col(bucket).asc_nulls_first()) if within else Window.orderBy(F.col(bucket).asc_nulls_first())
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    offsets = sums.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.coalesce(F.sum("__sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("__inside", F.sum(value).over(inside))
    matches = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = summed.join(offsets, matches, "inner")
    return joined.withColumn(name, F.col("__offset") + F.col("__inside")).drop("__inside", "__offset", *[f"__{k}" for k in keys])
