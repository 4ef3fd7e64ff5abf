"""Exact percentiles of groups of any size, by selection.

The usual aggregate holds all distinct values of a group in one buffer. Here a
wanted rank is closed in on: the range that must hold it is cut into bins, rows
are counted by bin (a small table, added up before the shuffle), and the bin
with the rank becomes the next range. Once a range has few rows, or one value,
only those rows are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fernweft.materialize import materialize, release

#: Rows that one task sorts for one rank, and bins that a range is cut into.
MOST, BINS = 50_000, 1024
LARGEST = 1.7976931348623157e308


def _bounded(c: Column) -> Column:
    """Half of a value, so that differences are finite."""
    return F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)) / 2


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], name: str = "value", most: int = MOST, bins: int = BINS) -> DataFrame:
    """Columns ``by, share, name``: one row for each group and each of ``shares``.

    Between two values the result is interpolated, as ``percentile`` does. Null
    values and NaN are left out; groups may be null, and a group without values
    is no row. Ties, of all rows even, cost nothing: a range of one value is not
    sorted. The numbers are those of ``value`` as a double.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
    sizes = materialize(sizes, "sizes")
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    wanted = sizes.withColumn("share", share).withColumn("at", (F.col("rows") - 1) * F.col("share"))
    wanted = materialize(wanted.select(*keys, "share", "at", "rows", "low", "high"), "wanted")
    ranks = wanted.withColumn("rank", F.explode(F.array(F.floor("at"), F.ceil("at"))))
    state = materialize(ranks.select(*keys, "rank", "low", "high", F.lit(0).cast("long").alias("before"), "rows").distinct(), "ranks")
    while not (wide := state.where((F.col("rows") > most) & (F.col("low") < F.col("high")))).isEmpty():
        after = materialize(state.where((F.col("rows") <= most) | (F.col("low") >= F.col("high"))).unionByName(_closer(rows, wide, keys, bins)), "ranks")
        release(state)
        state = after
    single = state.where("low >= high").select(*keys, "rank", F.col("low").alias("v"))
    few = _within(rows, state.where("low < high"), keys)
    nth = F.row_number().over(Window.partitionBy(*keys, "rank").orderBy("v"))
    sorted_ = few.withColumn("nth", nth + F.col("before") - 1).where("nth = rank").select(*keys, "rank", "v")
    found = materialize(single.unionByName(sorted_), "found-ranks")
    lower = found.select(*[F.col(k).alias(k + "_l") for k in keys], F.col("rank").alias("lower"), F.col("v").alias("v_low"))
    upper = found.select(*[F.col(k).alias(k + "_u") for k in keys], F.col("rank").alias("upper"), F.col("v").alias("v_high"))
    ends = wanted.withColumn("lower_", F.floor("at")).withColumn("upper_", F.ceil("at"))
    joined = ends.join(lower, _same(keys, "_l") & (F.col("lower_") == F.col("lower"))).join(upper, _same(keys, "_u") & (F.col("upper_") == F.col("upper")))
    part = F.col("at") - F.col("lower")
    between = F.when(F.col("lower") == F.col("upper"), F.col("v_low")).otherwise((F.lit(1.0) - part) * F.col("v_low") + part * F.col("v_high"))
    return joined.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "share", between.alias(name))


def _same(keys: list[str], suffix: str) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(k + suffix)) for k in keys], F.lit(True))


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with each range of their group that they are in."""
    named = ranges.select(*[F.col(k).alias(k + "_r") for k in keys], "rank", "low", "high", "before")
    inside = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    return rows.join(named, _same(keys, "_r") & inside).drop(*[k + "_r" for k in keys])


def _closer(rows: DataFrame, ranges: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """For each range the bin that holds its rank, with its least and greatest
    value. These are in different bins, so every step leaves rows behind."""
    low, high, v = (_bounded(F.col(c)) for c in ("low", "high", "v"))
    bin_ = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))
    counted = _within(rows, ranges, keys).groupBy(*keys, "rank", "before", bin_.alias("bin"))
    counted = counted.agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
    earlier = Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.col("before") + F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    held = counted.where("before <= rank and rank < before + rows")
    return held.select(*keys, "rank", "low", "high", "before", "rows")
