"""Vector search: top neighbours of a stated set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fernweft.materialize import materialize, release

#: Bytes of query vectors, with what is kept for them, that a task holds at once.
BLOCK_BYTES = 64 << 20
#: Scores that are looked at, and pairs that are made again, at once.
TILE, LOT = 1 << 20, 1 << 15


def stacked(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Best:
    """The ``k`` rows of greatest score for each query, ties to the smaller id;
    a query's own id is left out.

    Scores are made in tiles of ``tile``, and only those that beat what a query
    has kept are made again, pair by pair so that equal vectors score the same
    wherever they lie, and sorted. Memory is that of what is kept and of a tile."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, tile: int = TILE):
        self.ids, self.queries, self.k, self.tile = ids, queries, k, tile
        self.norms = np.linalg.norm(queries, axis=1, keepdims=True) if len(ids) else np.zeros((0, 1))
        self.scores = np.full((len(ids), k), -np.inf)
        self.rows = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, row_ids: np.ndarray, vectors: np.ndarray, who: np.ndarray | None = None) -> None:
        """Score rows for all queries, or those at the places ``who``."""
        n = len(self.ids) if who is None else len(who)
        wide = max(1, min(len(row_ids), 1024, self.tile))
        high = max(1, self.tile // wide)
        for j in range(0, len(row_ids), wide):
            for i in range(0, n, high):
                places = np.arange(i, min(n, i + high)) if who is None else who[i : i + high]
                self._tile(places, row_ids[j : j + wide], vectors[j : j + wide])

    def _tile(self, places: np.ndarray, row_ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.queries[places] @ vectors.T
        least, largest = self.scores[places, -1:], self.rows[places, -1:]
        slack = 1e-12 * self.norms[places] * np.linalg.norm(vectors, axis=1).max()
        better = (scores > least + slack) | ((scores >= least - slack) & (row_ids[None, :] < largest))
        better &= self.ids[places][:, None] != row_ids[None, :]
        at, row = np.nonzero(better)
        if not len(at):
            return
        lots = [slice(i, i + LOT) for i in range(0, len(at), LOT)]
        exact = np.concatenate([np.einsum("ij,ij->i", self.queries[places[at[s]]], vectors[row[s]]) for s in lots])
        hit = np.unique(at)
        owner = np.concatenate([np.repeat(hit, self.k), at])
        found = np.concatenate([self.scores[places[hit]].ravel(), exact])
        ids = np.concatenate([self.rows[places[hit]].ravel(), row_ids[row]])
        order = np.lexsort((ids, -found, owner))
        # The first k of each owner, who has k or more.
        begin = np.searchsorted(owner[order], hit)
        chosen = order[begin[:, None] + np.arange(self.k)[None, :]]
        self.scores[places[hit]], self.rows[places[hit]] = found[chosen], ids[chosen]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What was kept, as ``query_id, neighbour_id, score``."""
        step = max(1, self.tile // self.k)
        for i in range(0, len(self.ids), step):
            scores, rows = self.scores[i : i + step], self.rows[i : i + step]
            known = np.isfinite(scores)
            columns = [np.repeat(self.ids[i : i + step], known.sum(1)), rows[known], scores[known]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "neighbour_id", "score"])


def few_tasks(df: DataFrame) -> DataFrame:
    """Tasks that each keep rows for all queries: a few for each core, so that
    what they hand on does not grow with the table."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_neighbours(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` rows of greatest dot product for each query, itself left out.

    Columns ``query_id, neighbour_id, score, rank``; ties go to the smaller
    id. Queries are dealt into blocks of about ``block_bytes``, each of which
    meets all rows in one pass; its result is written and its vectors are
    withdrawn before the next is sent. A task keeps ``k`` rows for each query,
    and tasks are a few for each core, so what is shuffled does not grow with
    the rows. Scores are made in tiles, so neither does memory. Null vectors
    match nothing.
    """
    wanted = queries.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    n, dims = wanted.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    count = max(1, -(-n * ((dims or 0) + 2 * k) * 8 // block_bytes))
    dealt = materialize(wanted.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count))), "queries")
    parts = [_block(rows, dealt.where(F.col("block") == b), id_col, vector_col, k) for b in range(count)]
    release(dealt)
    return reduce(DataFrame.unionByName, parts)


def _block(rows: DataFrame, block: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    held = block.select("id", F.col("vector").cast("array<double>")).toArrow()
    ids, matrix = held["id"].to_numpy(), stacked(held["vector"].combine_chunks())
    del held
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Best(*shared.value, k)
        for batch in batches:
            if batch.num_rows and len(kept.ids):
                kept.meet(batch.column(0).to_numpy(), stacked(batch.column(1)))
        yield from kept.batches()

    vectors = few_tasks(rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col))
    found = vectors.mapInArrow(best, "query_id bigint, neighbour_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id"))
    best_rows = materialize(found.withColumn("rank", place).where(F.col("rank") <= k), "neighbours")
    shared.destroy()
    return best_rows
