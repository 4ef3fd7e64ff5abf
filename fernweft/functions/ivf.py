"""A vector index of inverted lists: rows by the nearest of some centroids.

Centroids are fitted on a bounded sample; every row is put into the list of its
nearest centroid, and a search looks only into the lists whose centroids are
nearest to the query. The index is a folder: one table of centroids, and one of
rows sorted by list, in files that hold few lists each.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fernweft.functions.vectors import BLOCK_BYTES, TILE, Best, few_tasks, stacked
from fernweft.materialize import materialize, new_path, release


@dataclass(frozen=True)
class Lists:
    """``lists``: their number; None: the root of the number of rows, and at
    most one for each ``per_list`` rows of the sample. ``sample`` bounds the rows
    that centroids are fitted on, in the driver; all rows are indexed."""

    lists: int | None = None
    sample: int = 20_000
    per_list: int = 16
    rounds: int = 10
    seed: int = 5


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, a tile of distances at a time."""
    squares, step = (centroids**2).sum(1)[None, :], max(1, TILE // max(1, len(centroids)))
    parts = [(squares - 2 * vectors[i : i + step] @ centroids.T).argmin(1) for i in range(0, len(vectors), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def k_means(vectors: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of a sample. One that loses its rows moves to the row that is
    farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        own = nearest(vectors, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        n = np.bincount(own, minlength=k)
        empty = np.flatnonzero(n == 0)
        farthest = np.argsort(-((vectors - centroids[own]) ** 2).sum(1))[: len(empty)]
        centroids = sums / np.maximum(n, 1)[:, None]
        centroids[empty] = vectors[farthest]
    return centroids


class VectorIndex:
    """Rows of an id and a vector, in lists. ``path`` is the index: it can be
    opened again by any application."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.schema("list int, id bigint, vector array<double>").parquet(f"{path}/rows")
        held = spark.read.schema("list int, vector array<double>").parquet(f"{path}/centroids").orderBy("list").toArrow()
        self.centroids = stacked(held["vector"].combine_chunks()) if held.num_rows else np.zeros((0, 1))

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, vector_col: str, how: Lists = Lists(), path: str | None = None) -> VectorIndex:
        """Index all rows with a vector; null vectors are in no list.

        A list that holds most rows is in many files, as rows are dealt out by
        list and a hash of the id."""
        spark, path = rows.sparkSession, path or new_path(rows.sparkSession, "vectors")
        known = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        n = known.count()
        sample = known.orderBy(F.xxhash64("id"), "id").limit(how.sample).select("vector").toArrow()
        vectors = stacked(sample["vector"].combine_chunks()) if n else np.zeros((0, 1))
        k = min(len(vectors), how.lists or max(1, min(math.isqrt(n), len(vectors) // how.per_list)))
        centroids = k_means(vectors, k, how.rounds, how.seed) if k else np.zeros((0, 1))
        table = [(i, c.tolist()) for i, c in enumerate(centroids)]
        spark.createDataFrame(table, "list int, vector array<double>").coalesce(1).write.parquet(f"{path}/centroids")

        def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = nearest(stacked(batch.column(1)), centroids)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], ["list", "id", "vector"])

        dealt = known.mapInArrow(listed, "list int, id bigint, vector array<double>")
        dealt = dealt.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list", "id")
        dealt.write.parquet(f"{path}/rows")
        return cls(spark, path)

    def probed(self, queries: DataFrame, id_col: str, vector_col: str, probes: int) -> DataFrame:
        """Queries ``id, vector`` with the ``lists`` of greatest dot product."""
        centroids = self.centroids

        def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, TILE // max(1, len(centroids)))
            for whole in batches:
                for i in range(0, whole.num_rows, step):
                    batch = whole.slice(i, step)
                    near = stacked(batch.column(1)) @ centroids.T if len(centroids) else np.zeros((batch.num_rows, 0))
                    lists = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    ends = pa.array(np.arange(batch.num_rows + 1) * lists.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(lists.ravel()))], ["id", "vector", "lists"])

        known = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return known.mapInArrow(look, "id bigint, vector array<double>, lists array<int>")

    def scanned_share(self, queries: DataFrame, id_col: str, vector_col: str, probes: int) -> float:
        """Pairs of query and row that a search scores, as a share of all."""
        sizes = self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        asked = self.probed(queries, id_col, vector_col, probes).select(F.explode("lists").alias("list"), "id")
        met = asked.groupBy("list").agg(F.count(F.lit(1)).alias("asked")).join(sizes, "list").agg(F.sum(F.col("asked") * F.col("n"))).first()[0]
        everything = queries.where(F.col(vector_col).isNotNull()).count() * self.rows.count()
        return (met or 0) / everything if everything else 0.0

    def search(self, queries: DataFrame, id_col: str, vector_col: str, k: int, probes: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """For each query up to ``k`` rows of greatest dot product in its
        ``probes`` lists, itself left out.

        Columns ``query_id, neighbour_id, score, rank``; ties go to the smaller
        id. With as many probes as lists the result is exact. Queries go in
        blocks of about ``block_bytes``, one on the executors at a time, and each
        task keeps ``k`` rows for each of them. Null vectors match nothing."""
        asked = materialize(self.probed(queries, id_col, vector_col, probes), "probes")
        n = asked.count()
        blocks = max(1, -(-n * 8 * (self.centroids.shape[1] + probes + 2 * k) // block_bytes))
        dealt = materialize(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries")
        parts = [self._block(dealt.where(F.col("block") == b), k) for b in range(blocks)]
        release(asked)
        release(dealt)
        return reduce(DataFrame.unionByName, parts)

    def _block(self, block: DataFrame, k: int) -> DataFrame:
        held = block.select("id", "vector", "lists").toArrow()
        ids, matrix = held["id"].to_numpy(), stacked(held["vector"].combine_chunks())
        lists = held["lists"].combine_chunks()
        number = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
        order = np.argsort(number, kind="stable")
        cuts = np.searchsorted(number[order], np.arange(len(self.centroids) + 1))
        shared = self.spark.sparkContext.broadcast((ids, matrix, owner[order], cuts))
        del held, lists, number, owner, order

        def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, against, askers, cuts = shared.value
            kept = Best(query_ids, against, k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, row_ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), stacked(batch.column(2))
                for i in np.unique(own).tolist():
                    who, rows = askers[cuts[i] : cuts[i + 1]], np.flatnonzero(own == i)
                    if len(who):
                        kept.meet(row_ids[rows], vectors[rows], who)
            yield from kept.batches()

        found = few_tasks(self.rows).mapInArrow(best, "query_id bigint, neighbour_id bigint, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id"))
        rows = materialize(found.withColumn("rank", place).where(F.col("rank") <= k), "neighbours")
        shared.destroy()
        return rows
