"""As-of and interval joins on public DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], *, strict: bool = False, slot: Column | None = None) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its group.

    Latest is by ``on``, at or before the left row's (before, if ``strict``).
    Rows of both sides are put in one order for each group and the last right
    value is carried on, so the cost is one shuffle and sort, without a range
    comparison. Right rows that tie on ``on`` are ordered by their values, and
    the last wins. Groups are null-safe; without a match values are null.

    ``slot``, an expression of ``on`` that never falls as ``on`` rises, cuts a
    group's order into slots, so that no task holds a hot group: each slot
    starts with the last right row before it, found in a table of slots.
    """
    pick = F.struct(*values)
    before = left.select("*", F.lit(None).cast(right.select(pick.alias("p")).schema["p"].dataType).alias("__right"), F.lit(0 if strict else 1).alias("__side"))
    after = right.select(*by, on, pick.alias("__right"), F.lit(1 if strict else 0).alias("__side"))
    merged = before.unionByName(after.withColumn("__from_right", F.lit(True)), allowMissingColumns=True)
    groups = list(by)
    if slot is not None:
        merged, groups = merged.withColumn("__slot", slot), [*by, "__slot"]
        latest = F.max(F.when(F.col("__from_right"), F.struct(on, "__right"))).alias("__latest")
        over = Window.partitionBy(*by).orderBy(F.col("__slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        known = merged.groupBy(*groups).agg(latest).withColumn("__latest", F.last("__latest", ignorenulls=True).over(over))
        heads = known.where(F.col("__latest").isNotNull()).select(*groups, F.col("__latest.__right").alias("__right"), F.lit(-1).alias("__side"), F.lit(True).alias("__from_right"))
        merged = merged.unionByName(heads, allowMissingColumns=True)
    order = Window.partitionBy(*groups).orderBy(F.col(on).asc_nulls_first(), "__side", F.col("__right").asc_nulls_first())
    carried = F.last("__right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = merged.withColumn("__found", carried).where(F.col("__from_right").isNull())
    return found.select(*left.columns, *[F.col(f"__found.{v}").alias(f"right_{v}") for v in values])


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, seconds: int) -> DataFrame:
    """Pairs with ``left_on < right_on <= left_on + seconds`` in each group.

    Time is cut into slots as wide as the interval and a left row goes to its
    own slot and the next, so the join is on equal (group, slot) and a group
    that holds most rows is spread over its slots. Right columns are prefixed
    with ``right_``; null times and groups match nothing.
    """
    width = F.lit(seconds)
    slot = F.floor(F.unix_micros(F.col(left_on).cast("timestamp")) / 1_000_000 / width)
    spread = left.select("*", F.explode(F.array(slot, slot + 1)).alias("__slot"))
    other = right.select(
        *[F.col(c).alias(f"right_{c}") for c in right.columns],
        F.floor(F.unix_micros(F.col(right_on).cast("timestamp")) / 1_000_000 / width).alias("__rslot"),
    )
    same = F.col("__slot") == F.col("__rslot")
    for c in by:
        same &= F.col(c) == F.col(f"right_{c}")
    until = F.col(left_on) + F.make_dt_interval(secs=F.lit(seconds))
    near = (F.col(f"right_{right_on}") > F.col(left_on)) & (F.col(f"right_{right_on}") <= until)
    return spread.join(other, same & near).drop("__slot", "__rslot")
