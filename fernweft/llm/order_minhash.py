"""Fingerprints of texts by order MinHash.

A text's k-mers are numbered by occurrence, so that a repeated one counts as
often as it stands there. Each of a number of draws orders the numbered k-mers
by a hash of its own and picks the least few; the picked k-mers, in the order of
the text, are hashed to one entry of the fingerprint. Entries of two texts agree
where the same k-mers are picked and stand in the same order, so the share of
equal entries falls with the edit distance, and with a change of order too.

Fingerprints are made row by row. Comparing each document with its neighbour in
the order of ids takes one range sort; a partition's last document meets the
first of the next one in a table of two rows for each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from fernweft.materialize import materialize

#: K-mers that are hashed for all draws at once.
BLOCK = 1 << 13
#: Multipliers of the hashes: odd numbers without small factors or patterns.
STEP, NUMBERED, JOINED = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of a 64-bit number."""
    values = (values ^ (values >> np.uint64(32))) * STEP
    values = (values ^ (values >> np.uint64(29))) * NUMBERED
    return values ^ (values >> np.uint64(32))


@dataclass(frozen=True)
class OrderMinHash:
    """``k`` characters in a k-mer, ``picks`` k-mers in an entry, ``draws``
    entries of 16 bits in a fingerprint."""

    k: int = 8
    picks: int = 2
    draws: int = 64
    seed: int = 11

    @cached_property
    def multipliers(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 1 << 31, self.draws, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)

    def kmers(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a text's k-mers, and the numbers by which draws order them:
        hashes of k-mers with their occurrence. A text shorter than ``k`` is one
        k-mer, an empty one has none."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        width = min(self.k, len(codes))
        if not width:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        hashes = np.zeros(len(codes) - width + 1, np.uint64)
        for j in range(width):
            hashes = hashes * STEP + codes[j : j + len(hashes)]
        hashes = mixed(hashes)
        order = np.argsort(hashes, kind="stable")
        ordered, places = hashes[order], np.arange(len(order))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), places, 0))
        numbers = np.empty(len(order), np.uint64)
        numbers[order] = places - first
        return hashes, (mixed(hashes + numbers * JOINED) >> np.uint64(32)).astype(np.uint32)

    def fingerprint(self, text: str | None) -> np.ndarray:
        """The entries; equal texts have equal ones. A null text is empty."""
        hashes, keys = self.kmers(text or "")
        rows, picks = np.arange(self.draws), min(self.picks, len(keys))
        at = np.zeros((self.draws, 0), np.int64)
        for start in range(0, len(keys), BLOCK):
            # The least of a block compete with the least of those before it.
            near = np.broadcast_to(np.arange(start, min(start + BLOCK, len(keys))), (self.draws, min(BLOCK, len(keys) - start)))
            candidates = np.concatenate([at, near], axis=1) if start else near
            drawn = keys[candidates] * self.multipliers if start else keys[None, : near.shape[1]] * self.multipliers
            won = np.empty((self.draws, min(picks, drawn.shape[1])), np.int64)
            for p in range(won.shape[1]):
                best = drawn.argmin(1)
                won[:, p] = candidates[rows, best]
                drawn[rows, best] = np.uint32(0xFFFFFFFF)
            at = won
        at.sort(axis=1)
        entries = np.zeros(self.draws, np.uint64)
        for p in range(at.shape[1]):
            entries = mixed(entries * JOINED + hashes[at[:, p]])
        return (entries >> np.uint64(48)).astype(np.uint16)

    def shown(self, entries: np.ndarray) -> str:
        """Four hex digits an entry."""
        return entries.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of entries that are equal."""
    return float((a == b).mean())


def fingerprint_column(text: Column, how: OrderMinHash = OrderMinHash()) -> Column:
    """A text's fingerprint in hex digits."""

    @F.arrow_udf("string")
    def printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([how.shown(how.fingerprint(t.as_py())) for t in texts], pa.string())

    return printed(text)


def likeness_column(a: Column, b: Column) -> Column:
    """Share of equal entries of two fingerprints in hex digits."""

    @F.arrow_udf("double")
    def near(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pair in batches:
            left, right = ([np.frombuffer(bytes.fromhex(x), np.uint16) for x in side.to_pylist()] for side in pair)
            yield pa.array([likeness(x, y) for x, y in zip(left, right)], pa.float64())

    return near(a, b)


def edited(text: str, other: str) -> str:
    """The second half of a text replaced by as much of another's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


MADE = pa.schema(
    [("place", pa.int32()), ("edge", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string())]
    + [("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
)
SCHEMA = "place int, edge string, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compare_edited(docs: DataFrame, how: OrderMinHash = OrderMinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text and the document that comes next.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``; one row for each input row. Documents go by
    descending id, and the first comes after the last. The edited text is the
    document's first half and as much of the next one's beginning.

    Null texts are empty, and an empty text's fingerprint equals only that of
    others. Null ids come last; rows that share an id go by a hash of their text,
    and equal rows, in any order, are next to each other. A single row is next
    to itself. Long texts are read whole, in memory that grows with the longest.
    An empty table gives no rows. Other columns are not read.
    """

    def finished(doc_id: int | None, text: str, print_: np.ndarray, other: str, other_print: np.ndarray) -> tuple:
        made = edited(text, other)
        made_print = how.fingerprint(made)
        digest = hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest()
        prints = (how.shown(print_), how.shown(made_print), likeness(print_, made_print), likeness(print_, other_print))
        return (None, None, doc_id, len(text), digest, *prints, None)

    def edge(kind: str, doc_id: int | None, text: str) -> tuple:
        return (TaskContext.get().partitionId(), kind, doc_id, *[None] * 6, text)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(column), f.type) for column, f in zip(zip(*rows), MADE)], schema=MADE)

    def in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int | None, str, np.ndarray] | None = None
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                here = (doc_id, text, how.fingerprint(text))
                rows.append(edge("first", doc_id, text) if before is None else finished(*before, *here[1:]))
                before = here
            if rows:
                yield batch_of(rows)
        if before is not None:
            yield batch_of([edge("last", *before[:2])])

    def at_edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, other in zip(*(c.to_pylist() for c in batch.columns)):
                yield batch_of([finished(doc_id, text, how.fingerprint(text), other, how.fingerprint(other))])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The number of the row parts equal rows, should they be most of the table.
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("row")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = materialize(ordered.mapInArrow(in_order, SCHEMA), "compared")
    firsts = made.where("edge = 'first'").select("place", F.col("text").alias("other"))
    everything = Window.orderBy("place")
    following = firsts.select(
        F.col("place").alias("of"), F.coalesce(F.lead("place").over(everything), F.first("place").over(everything)).alias("place")
    )
    lasts = made.where("edge = 'last'").select(F.col("place").alias("of"), "doc_id", "text")
    met = lasts.join(following, "of").join(firsts, "place").select("doc_id", "text", "other")
    return made.where(F.col("edge").isNull()).unionByName(met.mapInArrow(at_edges, SCHEMA)).select(*RESULT)
