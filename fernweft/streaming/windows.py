"""Windowed aggregates and stateful operators for tables and streams alike.

Each takes a DataFrame that may stream and returns one of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def timed(df: DataFrame, ts: str, delay: str | None = None) -> DataFrame:
    """``ts`` as a timestamp, with a watermark if ``delay`` is given."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if delay else out


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], **aggregates: Column) -> DataFrame:
    return _windowed(df, F.window(ts, width), by, aggregates)


def sliding(df: DataFrame, ts: str, width: str, step: str, by: list[str], **aggregates: Column) -> DataFrame:
    return _windowed(df, F.window(ts, width, step), by, aggregates)


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], **aggregates: Column) -> DataFrame:
    """Rows of a group no further apart than ``gap`` form a session."""
    return _windowed(df, F.session_window(ts, gap), by, aggregates)


def _windowed(df: DataFrame, window: Column, by: list[str], aggregates: dict[str, Column]) -> DataFrame:
    grouped = df.groupBy(window.alias("w"), *by).agg(*[c.alias(k) for k, c in aggregates.items()])
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggregates)


def first_seen(df: DataFrame, ts: str, key: list[str], delay: str) -> DataFrame:
    """The first row of each key among those within the watermark's reach."""
    return timed(df, ts, delay).dropDuplicatesWithinWatermark(key)


def paired(left: DataFrame, right: DataFrame, by: str, ts: str, seconds: int, delay: str) -> DataFrame:
    """Stream-stream join: right rows up to ``seconds`` after a left row of
    the same ``by``. The time bound lets Spark drop old state."""
    a = timed(left, ts, delay).alias("a")
    b = timed(right, ts, delay).select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    until = F.col(f"a.{ts}") + F.make_dt_interval(secs=F.lit(seconds))
    near = (F.col(f"a.{by}") == F.col(f"right_{by}")) & (F.col(f"right_{ts}") > F.col(f"a.{ts}")) & (F.col(f"right_{ts}") <= until)
    return a.join(b, near)


def running_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key so far, in arbitrary state kept by Python; one output
    row for each key and batch. Needs the RocksDB provider of state."""
    kind = dict(df.dtypes)[key]

    class Count(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "n bigint")

        def handleInputRows(self, key_: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
            n = (self.seen.get()[0] if self.seen.exists() else 0) + sum(len(part) for part in rows)
            self.seen.update((n,))
            yield pd.DataFrame({key: [key_[0]], "n": [n]})

        def close(self) -> None:
            pass

    return df.groupBy(key).transformWithStateInPandas(Count(), f"{key} {kind}, n bigint", "append", "none")
