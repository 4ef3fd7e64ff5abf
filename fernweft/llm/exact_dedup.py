"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest, in the shared folder. A
batch of documents is reduced to one row for each digest, joined against the
index by a sort-merge anti-join that need not shuffle the index, and what is
new is appended. Compaction writes each bucket as one sorted file again.
Everything here is DataFrame code; texts are read once and never shuffled.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernweft.llm.common import SPACE, fresh
from fernweft.materialize import claim, delete, materialize, new_path

#: Begins the name of an entry that tells an index's buckets; readers of the
#: folder pass over it.
NOTE = "_buckets-"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space made one space."""
    normal = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    return F.sha2(normal, 256)


class DigestIndex:
    """Digests of all documents kept so far, with the id that keeps each.

    The index is what its ``folder`` holds, whoever wrote it: a later
    application that names the same folder meets all that is in it. ``table`` is
    the name under which the session's catalog knows the files. Without a folder
    the index is temporary: below the shared folder, and deleted with the
    application's other tables.

    ``buckets`` defaults to the session's shuffle partitions, so that a batch
    shuffled by digest meets the index bucket by bucket. The number is noted in
    the folder when the index is made and holds from then on.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, folder: str | None = None):
        self.spark = spark
        self.table = table
        self.folder = (folder or new_path(spark, f"index-{table}")).rstrip("/")
        self._temporary = folder is None
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._noted() or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int | None = None) -> DigestIndex:
        """An empty index under a name of its own."""
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", buckets)

    def _noted(self) -> int:
        """Buckets of the files in the folder, 0 where there is no index."""
        if not self._fs.exists(self._path(self.folder)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return max((int(n.removeprefix(NOTE)) for n in names if n.startswith(NOTE)), default=0)

    def exists(self) -> bool:
        return self._noted() > 0

    def _registered(self) -> bool:
        """Whether there is an index; if so the catalog knows its files."""
        if not self.exists():
            return False
        if self.spark.catalog.tableExists(self.table):
            known = self.spark.sql(f"DESCRIBE FORMATTED {self.table}").where("col_name = 'Location'").first()["data_type"]
            if known.rstrip("/").rpartition(":")[2].lstrip("/") != self.folder.rpartition(":")[2].lstrip("/"):
                raise ValueError(f"the catalog has {self.table} at {known}, not at {self.folder}")
        else:
            place = self.folder.replace("'", "\\'")
            columns = f"(digest STRING, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE {self.table} {columns} LOCATION '{place}'")
        return True

    def read(self) -> DataFrame:
        """Columns ``digest`` (hex) and ``keep_id``; one row for each digest."""
        if self._registered():
            return self.spark.table(self.table)
        return self.spark.createDataFrame([], "digest string, keep_id bigint")

    def append(self, fresh_rows: DataFrame) -> None:
        """Add rows of new digests; each writing task fills one bucket."""
        if not self.exists():
            if self._temporary:
                claim(self.spark, self.folder)
            self._fs.mkdirs(self._path(f"{self.folder}/{NOTE}{self.buckets}"))
        self._registered()
        rows = fresh_rows.select("digest", F.col("keep_id").cast("long").alias("keep_id")).repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def compact(self, folder: str | None = None) -> DigestIndex:
        """The same index in another folder, a temporary one unless named, with
        one sorted file for each bucket; this one stays until it is dropped."""
        other = DigestIndex(self.spark, f"{self.table}_{uuid.uuid4().hex[:8]}", self.buckets, folder)
        if self.exists():
            # Read as plain files: as a bucketed table the rows count as dealt out
            # already, and each task would write a file for each bucket.
            other.append(self.spark.read.schema("digest string, keep_id bigint").parquet(self.folder))
        return other

    def drop(self) -> None:
        """Delete the index: its files, wherever they are, and the table."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._fs.delete(self._path(self.folder), True)
        delete(self.spark, [self.folder])

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate a batch against itself and the index, and append to it.

        Returns one row for each input row: ``doc_id``, ``keep_id`` (id of the
        row that stays: the index's if it holds the digest, else the smallest
        of the batch), ``group_size`` (rows of the batch with that digest),
        ``kept`` and ``digest``.

        Null texts equal empty ones. Null ids come after all others; where a
        group has no other id, ``keep_id`` is null. Where rows of a group share
        the smallest id, one of them is kept. A digest that the index already
        holds keeps no row of the batch. Long texts are read whole and leave as
        digests. An empty batch appends nothing. Other columns of the input are
        not read.
        """
        return _labelled(self, [self._take(docs, id_col, text_col)])

    def _take(self, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows of a batch, a row for each of its digests, and those of them
        that were new to the index, which holds them from now on."""
        rows = materialize(
            docs.select(
                F.col(id_col).cast("long").alias("doc_id"),
                text_digest(F.col(text_col)).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "digests",
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
        batch = materialize(rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size")), "batch")
        new = batch.hint("merge").join(self.read().hint("merge"), "digest", "left_anti")
        new = materialize(new.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("row")), "new-digests")
        self.append(new)
        return rows, batch.select("digest", "group_size"), new.select("digest", "row")


def _labelled(index: DigestIndex, batches: list[tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """All rows of the batches with what became of their digests."""
    # Rows are numbered by batch: a number is told from the same of another.
    number = lambda k, name: F.struct(F.lit(k).alias("batch"), F.col("row")).alias(name)
    rows = reduce(DataFrame.unionByName, (r.select("doc_id", "digest", number(k, "row")) for k, (r, _, _) in enumerate(batches)))
    sizes = reduce(DataFrame.unionByName, (s for _, s, _ in batches))
    if len(batches) > 1:
        sizes = sizes.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    new = reduce(DataFrame.unionByName, (n.select("digest", number(k, "kept_row")) for k, (_, _, n) in enumerate(batches)))
    held = index.read().select("digest", "keep_id")
    decided = sizes.hint("merge").join(held.hint("merge"), "digest").join(new.hint("merge"), "digest", "left")
    # Written, so that both sides of the last join are plain shuffles, of which
    # adaptive execution can split the partition of a hot digest.
    decided = materialize(decided.select("digest", "keep_id", "group_size", "kept_row"), "decided")
    return rows.join(decided, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False)).alias("kept"), "digest"
    )


def ingest_by_id(docs: DataFrame, index: DigestIndex, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a whole table in batches of rising ids, each of which meets
    the index of those before; the index keeps the smallest id of each digest.

    Ranges of ids are of equal width, null ids are in the last. Columns are
    those of ``DigestIndex.ingest``; ``group_size`` counts over all batches, and
    a row is kept if its digest was new to the index. An empty table gives no
    rows."""
    key = F.col(id_col).cast("long")
    low, high = docs.agg(F.min(key), F.max(key)).first()
    cuts = [] if low is None else [low + (high - low) * k // batches for k in range(1, batches)]
    bounds = [None, *cuts, None]
    parts = []
    for after, upto in zip(bounds, bounds[1:]):
        within = (F.lit(True) if after is None else key > after) & (F.lit(True) if upto is None else key <= upto)
        parts.append(index._take(docs.where(F.coalesce(within, F.lit(upto is None))), id_col, text_col))
    return _labelled(index, parts)


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Edge cases are those of ``DigestIndex.ingest``; columns of the input may
    bear any name.
    """
    digest, keeper = fresh(docs.columns, "__digest", "__keeper")
    kept = index.ingest(docs, id_col, text_col).where("kept").select(F.col("digest").alias(keeper), F.col("doc_id").alias(keeper + "_id"))
    marked = docs.withColumn(digest, text_digest(F.col(text_col)))
    same = (F.col(digest) == F.col(keeper)) & F.col(id_col).cast("long").eqNullSafe(F.col(keeper + "_id"))
    return marked.join(kept, same, "left_semi").dropDuplicates([digest]).drop(digest)
