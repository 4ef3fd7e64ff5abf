"""Running a streaming query over all input there is, into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweft.materialize import new_path
from fernweft.tables import read_table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keeps state on the executors' disks; arbitrary state needs it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = 1) -> DataFrame:
    """A table as a stream of its files, all in one batch without a number.

    Files come by time of change, not by that of their rows: where a watermark
    drops late rows, only one batch gives what the whole table holds.

    A table is a file or a folder of files; the schema is taken from a scan.
    """
    schema = read_table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(conf).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_append(stream: DataFrame, label: str = "stream", provider: str | None = None) -> DataFrame:
    """Run to the end of the input with an exactly-once Parquet sink.

    ``provider`` names the class that keeps the state, if not the session's."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, label)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-state").option("path", out)
    before = spark.conf.get(PROVIDER, None)
    if provider:
        spark.conf.set(PROVIDER, provider)
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        if provider:
            spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(out)


def run_append_parts(stream: DataFrame, parts: list[DataFrame], source: str, label: str = "stream") -> DataFrame:
    """Write each part to the folder that the stream reads and run it to the
    end, one after the other, from one checkpoint and into one sink."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, label)
    for part in parts:
        part.write.mode("append").parquet(source)
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-state").option("path", out)
        query = writer.trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, label: str = "stream") -> DataFrame:
    """Run to the end of the input; each batch writes the whole result anew,
    under its number, and the last is returned. A batch that is run again
    after a failure overwrites what it wrote, so results are exact."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, label)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch-{number}")
        last.append(number)

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", out + "-state").foreachBatch(write)
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch-{max(last)}")


def run_memory(stream: DataFrame, mode: str = "complete", name: str = "stream") -> DataFrame:
    """Run to the end of the input into the memory sink, a table on the driver:
    for results of a size known to be small."""
    spark = stream.sparkSession
    table = f"{name}_{new_path(spark, 'memory').rpartition('-')[2]}"
    query = stream.writeStream.format("memory").queryName(table).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(table)
