"""A table replayed as a stream, in the order of its event times.

A stream of a table's files takes them by time of change, so a watermark drops
whatever lies in files that were written late, and one batch of all files keeps
the state of the whole table. Here the table is first dealt out into slices of
event time, whatever its files hold; a running query is then handed one slice
after the other, each as one batch. No row is late, and state is that of a slice
and of what the query's watermark holds back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fernweft.materialize import new_path
from fernweft.streaming.runs import PROVIDER

#: Tasks that write one slice, so that a slice with most rows is many tasks'.
WRITERS = 8
MICROS = 1_000_000


@dataclass(frozen=True)
class Replayed:
    """What a replay wrote, the batches it took, and the most rows of state that
    it kept after a batch."""

    rows: DataFrame
    batches: int
    most_state: int


def replay(
    table: DataFrame,
    ts: str,
    seconds: int,
    build: Callable[[Callable[[], DataFrame]], DataFrame],
    label: str = "replay",
    provider: str | None = None,
    writers: int = WRITERS,
) -> Replayed:
    """Run a streaming query over ``table`` in slices of ``seconds`` of ``ts``.

    ``build`` gets a function that opens the stream, as often as it is called,
    and returns the query's result in append mode. Rows without a time are left
    out: no watermark tells when they are due. Slices without rows are skipped.
    The result depends on the rows alone, not on the files that hold them. Each
    slice is moved into the query's folder at once, and the sink is exactly-once.
    """
    spark, root = table.sparkSession, new_path(table.sparkSession, label)
    slices = _sliced(table, ts, seconds, f"{root}/waiting", writers)
    source, fs = f"{root}/source", _Folder(spark, root)
    fs.make(source)

    def opened() -> DataFrame:
        return spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(source)

    result = build(opened)
    query = _started(result, root, provider)
    try:
        for number in slices:
            fs.move(f"{root}/waiting/slice={number}", f"{source}/{number:020d}")
            query.processAllAvailable()
        progress = query.recentProgress
    finally:
        query.stop()
    kept = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]
    batches = sum(1 for p in progress if p["numInputRows"])
    return Replayed(spark.read.schema(result.schema).parquet(f"{root}/out"), batches, max(kept, default=0))


def _sliced(table: DataFrame, ts: str, seconds: int, path: str, writers: int) -> list[int]:
    """Write a folder for each slice of time; returns their numbers in order,
    one for each slice, counted from the first."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    number = F.floor(micros / F.lit(seconds * MICROS))
    dated = table.where(F.col(ts).isNotNull())
    first = dated.agg(F.min(number).alias("n")).first()["n"] or 0
    salt = F.pmod(F.xxhash64(micros, F.monotonically_increasing_id()), F.lit(writers))
    dealt = dated.withColumn("slice", number - F.lit(first)).repartition(F.col("slice"), salt)
    dealt.write.partitionBy("slice").parquet(path)
    fs = _Folder(table.sparkSession, path)
    return sorted(int(name.partition("=")[2]) for name in fs.names(path) if name.startswith("slice="))


def _started(result: DataFrame, root: str, provider: str | None) -> StreamingQuery:
    spark, before = result.sparkSession, result.sparkSession.conf.get(PROVIDER, None)
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    progress = spark.conf.get(kept)
    if provider:
        spark.conf.set(PROVIDER, provider)
    spark.conf.set(kept, "100000")
    try:
        writer = result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out")
        return writer.start()
    finally:
        spark.conf.set(kept, progress)
        if provider:
            spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class _Folder:
    """Folders in the store that holds ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self._fs.exists(self._path(path)) else []

    def move(self, path: str, to: str) -> None:
        if not self._fs.rename(self._path(path), self._path(to)):
            raise OSError(f"cannot move {path} to {to}")
