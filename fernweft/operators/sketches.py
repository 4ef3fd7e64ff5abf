"""Sketches kept in a table by slice, merged over any range of slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fernweft.materialize import materialize

#: Registers of a distinct count are two to this power, and the size parameter
#: of a quantile sketch.
LG_REGISTERS, QUANTILE_K = 12, 400


def sketch_table(df: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """One row for each group: ``n``, an HLL sketch ``users`` of ``distinct``
    and a KLL sketch ``spread`` of ``value``, in a written table.

    Groups are reduced before the shuffle, and a sketch is of bounded size
    whatever the rows of its group. Nulls are in no sketch."""
    kept = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(distinct, LG_REGISTERS).alias("users"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_K).alias("spread"),
    )
    return materialize(kept, "sketches")


def merged(sketches: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """Rows of a sketch table merged by ``by`` (a part of its groups, or none):
    ``n``, estimated ``distinct`` and ``quantiles`` at ``shares``.

    Merging distinct sketches equals sketching all rows at once; quantiles keep
    the same bound on the error of their rank."""
    whole = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("users", F.lit(False)).alias("users"), F.kll_merge_agg_double("spread", QUANTILE_K).alias("spread")
    )
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("spread", F.lit(s)) for s in shares])
    return whole.select(*by, "n", F.hll_sketch_estimate("users").alias("distinct"), quantiles.alias("quantiles"))


def heavy_hitters(df: DataFrame, key: str, share: float, rows: int | None = None) -> DataFrame:
    """Keys with at least ``share`` of all rows, ``key, n``, exactly.

    A key that frequent has that share of the rows of some part, so each part of
    the table names its own (at most ``1 / share`` of them), and only named keys
    are counted over all rows. Null is a key. Nothing that grows with the number
    of keys is shuffled."""
    total = df.count() if rows is None else rows
    part = F.spark_partition_id()
    named = materialize(_frequent(df.select(F.col(key).alias("key"), part.alias("part")), share), "named-keys")
    counted = df.join(F.broadcast(named), F.col(key).eqNullSafe(F.col("named")), "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= F.lit(share * total))


def _frequent(keyed: DataFrame, share: float) -> DataFrame:
    """Keys with ``share`` of the rows of a part, ``named``: parts times the
    inverse of the share at most, which bounds what is broadcast."""
    counts = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    sizes = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(sizes, "part").where(F.col("n") >= F.lit(share) * F.col("rows")).select(F.col("key").alias("named")).distinct()


def probed(sketch: bytes, keys: list[int]) -> list[int]:
    """Counts of whole numbers by a count-min sketch that ``F.count_min_sketch``
    made: never below the true counts, and above by its error at most.

    Read as Spark writes it: version, total, depth, width, a multiplier for each
    row of counters, then the counters row by row."""
    at = 4 + 8
    depth, width = (int.from_bytes(sketch[at + 4 * i : at + 4 * i + 4], "big", signed=True) for i in range(2))
    words = [int.from_bytes(sketch[i : i + 8], "big", signed=True) for i in range(at + 8, len(sketch), 8)]
    multipliers, counters = words[:depth], words[depth:]

    def slot(key: int, row: int) -> int:
        h = multipliers[row] * key & (1 << 64) - 1
        h = h - (1 << 64) if h >> 63 else h
        h = (h + (h >> 32)) & 0x7FFFFFFF
        return h % width

    return [min(counters[row * width + slot(key, row)] for row in range(depth)) for key in keys]


def count_min(column: Column, error: float, confidence: float, seed: int = 1) -> Column:
    """A count-min sketch: counts are above the truth by ``error`` of all rows
    at most, with ``confidence``."""
    return F.count_min_sketch(column, F.lit(error), F.lit(confidence), F.lit(seed))
