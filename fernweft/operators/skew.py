"""Aggregations and joins whose hot keys are spread by salt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def salted_distinct_count(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact distinct values of each key: first distinct pairs, then counts.

    The pairs are dealt by key and value, so no key's values meet in a task
    before they have become partial counts."""
    pairs = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join a table with hot keys to one with a row for each key.

    Facts draw a salt from a hash of the whole row, and each lookup row is
    there once for each salt: a hot key is spread over ``salts`` tasks. For
    lookups too large to broadcast where adaptive splitting does not apply.

    The copies are merged and never broadcast: Spark's estimate of the lookup
    does not count them, so it would send ``salts`` times what it takes for
    small through the driver."""
    salt = F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    spread = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return facts.withColumn("__salt", salt).join(spread.hint("merge"), [key, "__salt"], how).drop("__salt")
