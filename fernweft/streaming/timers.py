"""Sessions in arbitrary state, closed by timers of event time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SPAN = {"key": object, "first": "int64", "last": "int64", "n": "int64"}
HELD = pa.schema([("key", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])
#: Keys are dealt into so many buckets, each with one state and one timer.
BUCKETS = 128


def timed_sessions(df: DataFrame, key: str, ts: str, gap: int, longest: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Sessions ``key, first, last, n`` of a stream that has a watermark on
    ``ts``: rows of a key no further than ``gap`` seconds apart.

    A session that has lasted ``longest`` seconds ends there, and the next row
    begins another; built-in session windows have no such end. Keys are dealt
    into ``buckets`` by hash. The open sessions of a bucket are its state, and
    its timer is at the end of the first: a batch is a few calls a bucket,
    however many keys and sessions it has, and a bucket's rows of a batch fit
    one task. Sessions are emitted and dropped once the watermark has passed
    them, rows or no rows. Rows may come in any order within the watermark's
    delay, but ``longest`` cuts a session by the rows as they come, so it wants
    them in order. Null times are left out; null keys are a key. Needs the
    RocksDB provider of state.
    """
    kind = dict(df.dtypes)[key]
    micros, most = gap * 1_000_000, None if longest is None else longest * 1_000_000

    def stamp(column: pd.Series) -> pd.Series:
        aware = column.dt.tz_convert("UTC") if column.dt.tz is not None else column.dt.tz_localize(timezone.utc)
        return aware.astype("datetime64[us, UTC]").astype("int64")

    def due(spans: pd.DataFrame) -> pd.Series:
        """Milliseconds at which sessions are over."""
        return -(-(spans["last"] + micros) // 1000)

    class Sessions(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # One value, as each row of a list is a call of its own.
            self.open = handle.getValueState("open", "due bigint, spans binary")

        def spans(self) -> pd.DataFrame:
            held = self.open.get() if self.open.exists() else None
            self.timer = held and held[0]
            return pa.ipc.open_stream(held[1]).read_pandas() if held else pd.DataFrame({c: pd.Series(dtype=t) for c, t in SPAN.items()})

        def keep(self, spans: pd.DataFrame) -> None:
            """Hold these sessions, with one timer at the end of the first."""
            timer = int(due(spans).min()) if len(spans) else None
            if self.timer is not None and self.timer != timer:
                self.handle.deleteTimer(self.timer)
            if timer is None:
                self.open.clear()
                return
            if self.timer != timer:
                self.handle.registerTimer(timer)
            packed = pa.RecordBatch.from_pandas(spans, HELD, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, HELD) as out:
                out.write_batch(packed)
            self.open.update((timer, sink.getvalue().to_pybytes()))

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            parts = [self.spans()]
            for part in rows:
                part = part[part["ts"].notna()]
                at = stamp(part["ts"])
                parts.append(pd.DataFrame({"key": part["key"].astype(object), "first": at, "last": at, "n": 1}))
            self.keep(merged_spans(pd.concat(parts, ignore_index=True), micros, most))
            return iter([])

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            # Timers up to the watermark fire; one stands for all such ends.
            now, spans = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), self.spans()
            over = due(spans) <= now
            # A timer that has fired is gone.
            self.timer = None
            self.keep(spans[~over])
            if over.any():
                yield spans[over]

        def close(self) -> None:
            pass

    # Frames lose names that begin with an underscore.
    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"))
    found = dealt.groupBy("bucket").transformWithStateInPandas(Sessions(), "key string, first bigint, last bigint, n bigint", "append", "eventTime")
    return found.select(F.col("key").cast(kind).alias(key), F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n")


def merged_spans(spans: pd.DataFrame, gap: int, longest: int | None) -> pd.DataFrame:
    """Sessions of spans ``key, first, last, n``, of which a row is the least:
    those of a key less than ``gap`` apart are one, if ``first`` is less than
    ``longest`` after the session's."""
    code = pd.factorize(spans["key"], use_na_sentinel=False)[0]
    order = np.lexsort((spans["first"].to_numpy(), code))
    spans, code = spans.iloc[order].reset_index(drop=True), code[order]
    first, last = spans["first"].to_numpy(), spans["last"].to_numpy()
    reach = spans["last"].groupby(code).cummax().to_numpy()
    begins = np.ones(len(spans), bool)
    begins[1:] = (code[1:] != code[:-1]) | (first[1:] - reach[:-1] >= gap)
    if longest is not None:
        began = 0
        for i, at in enumerate(first.tolist()):
            begins[i] = begins[i] or at - began >= longest
            began = at if begins[i] else began
    at = np.flatnonzero(begins)
    if not len(at):
        return spans
    ends, n = np.maximum.reduceat(last, at), np.add.reduceat(spans["n"].to_numpy(), at)
    return pd.DataFrame({"key": spans["key"].to_numpy(object)[at], "first": first[at], "last": ends, "n": n})
