"""Places of rows in an order of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fernweft.materialize import materialize

#: Spark numbers the rows of a partition below this bit.
ROW_BITS = 33


def places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Add column ``name``: places 0, 1, 2, ... of all rows in ``order``.

    One range sort deals the rows out; a partition's places begin where those of
    the partitions before it end. Rows that tie, be they most of the table, are
    parted by a number of the row, so no value fills a task; their order among
    themselves is arbitrary but written, so that later plans see one order. The
    table that is broadcast has one row for each shuffle partition."""
    numbered = df.withColumn("__tie", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order, "__tie").drop("__tie")
    held = materialize(ranged.withColumn("__sorted", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__sorted", ROW_BITS)
    sizes = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    within = F.col("__sorted").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    joined = held.withColumn("__part", part).join(F.broadcast(begins), "__part")
    return joined.withColumn(name, F.col("__begin") + within).drop("__part", "__sorted", "__begin")
