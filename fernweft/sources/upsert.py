"""A table of the latest row of each key, kept by batches that rewrite little.

The table is a folder. Rows are dealt into buckets by key; a batch writes anew
only the buckets that it touches, under its own number, and then a list of where
each bucket is. The list is what commits it: a batch that is cut off before
leaves the table as it was, and one that is run again after it changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from fernweft.materialize import new_path


class UpsertTable:
    """Rows by ``key``; of two with one key that with the greater ``order``
    columns stays, and of equal ones the later batch's. ``buckets`` holds from
    the table's first batch on: a list has one entry for each."""

    def __init__(self, spark: SparkSession, schema: StructType, key: list[str], order: list[str], path: str | None = None, buckets: int = 32):
        self.spark, self.schema, self.key, self.order = spark, schema, key, order
        self.path, self.buckets = (path or new_path(spark, "upserts")).rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _lists(self) -> list[int]:
        folder = self._path(f"{self.path}/lists")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _places(self) -> dict[int, int]:
        """The batch that wrote each bucket last."""
        if not (batches := self._lists()):
            return {}
        text = self.spark.read.text(f"{self.path}/lists/{batches[-1]}", wholetext=True).first()["value"]
        held = json.loads(text)
        self.buckets = held["buckets"]
        return {int(b): n for b, n in held["places"].items()}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        places = self._places()
        folders = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in places.items() if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in a batch; for ``foreachBatch``. Rows without a whole key are
        left out. Numbers rise; one that was taken in already does nothing."""
        done = self._lists()
        if done and number <= done[-1]:
            return
        places = self._places()
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        known = batch.select(*self.schema.names).dropna(subset=self.key)
        rows = known.withColumn("bucket", bucket).withColumn("__new", F.lit(1))
        # A bucket's number is all that is gathered of a batch.
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
        if touched:
            old = self.read(touched).withColumn("bucket", bucket).withColumn("__new", F.lit(0))
            last = Window.partitionBy(*self.key).orderBy(*[F.desc_nulls_last(c) for c in self.order], F.desc("__new"))
            latest = rows.unionByName(old).withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth", "__new")
            latest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        self._commit(number, places | dict.fromkeys(touched, number))

    def _commit(self, number: int, places: dict[int, int]) -> None:
        """Write the list beside its place and move it there at once."""
        text = json.dumps({"buckets": self.buckets, "places": places})
        waiting, to = self._path(f"{self.path}/waiting/{number}"), self._path(f"{self.path}/lists/{number}")
        out = self._fs.create(waiting, True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        self._fs.mkdirs(to.getParent())
        if not self._fs.rename(waiting, to):
            raise OSError(f"cannot write the list of batch {number}")


def run_upserts(stream: DataFrame, table: UpsertTable) -> UpsertTable:
    """Run a stream to the end of its input into the table. The checkpoint is in
    the table's folder, so a later run goes on where this one ended."""
    writer = stream.writeStream.option("checkpointLocation", f"{table.path}/state").foreachBatch(table.merge)
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return table
