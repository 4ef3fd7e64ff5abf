"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints at most 2k bits apart have a common neighbour at most k bits
from each. Every distinct fingerprint emits all its variants within k bits;
fingerprints that meet on a variant are at most 2k bits apart, so a variant's
members form a clique. A variant has at most as many members as its own ball,
whatever the data. Linking members to the least one keeps the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from fernweft.llm.common import fresh
from fernweft.llm.components import components
from fernweft.materialize import materialize

SEED = 42
#: Bytes of text whose words are in memory at once.
BLOCK = 1 << 20


def word_blocks(raw: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Words of a text in lists, cut where a block ends at white space."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + block)
        while end < n and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        if words := raw[at:end].split():
            yield words
        at = end


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included.

    Words are runs free of ASCII white space, with A-Z lower-cased. Fewer than
    ``width`` words make one shingle; none give 0. A bit is set if more than
    half of the shingles' XXH64 values have it.
    """
    ones, total = np.zeros(64, np.int64), 0
    carried: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for words in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carried + words
        if len(words) >= width:
            shifted = [words[i:] for i in range(width)]
            hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*shifted)), np.uint64, len(words) - width + 1)
            for part in range(0, len(hashes), 1 << 14):
                bits = np.unpackbits(hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        carried = words[-(width - 1) :] if width > 1 else []
    if not total and carried:
        return digest(b" ".join(carried), SEED)
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def fingerprint_column(text: Column, width: int = 3) -> Column:
    """``fingerprint`` as a bigint column with the same 64 bits."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return simhash(text)


def ball(radius: int) -> list[int]:
    """XOR masks of up to ``radius`` of 64 bits, as signed 64-bit numbers."""
    masks = [sum(1 << i for i in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Verified edges ``a, b`` that connect distinct ``fingerprint`` values at
    most ``radius`` bits apart, an even number. Every pair that near is
    connected, directly or through the least member of a common variant."""
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even: the ball of half the radius is emitted")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    variants = prints.select("fingerprint", F.explode(masks).alias("mask")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant")
    )
    least = F.min("fingerprint").over(Window.partitionBy("variant"))
    met = variants.withColumn("least", least).where("fingerprint <> least")
    pairs = met.select(F.col("fingerprint").alias("a"), F.col("least").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Fingerprint and component of each row; one output row for each input row.

    Columns ``doc_id, fingerprint`` (bigint), ``component_id`` (smallest id
    reachable over links, itself included), ``first_row`` (whether the row
    stands for its component: smallest id, null ids last, then first row) and
    ``extra`` expressions over the input.

    Null and empty texts have fingerprint 0 and are linked like any other. Long
    texts are read whole, their words a block at a time. Null
    ids are passed over in ``component_id``, which is null only where a
    component has no other. Repeated rows are alike but for ``first_row``. An
    empty table gives no rows. Other columns are not read.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            fingerprint_column(F.col(text_col), width).alias("fingerprint"),
            F.monotonically_increasing_id().alias("row"),
            *[c.alias(k) for k, c in (extra or {}).items()],
        ),
        "fingerprints",
    )
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    prints = materialize(rows.groupBy("fingerprint").agg(lead.alias("lead")), "distinct-fingerprints")
    roots = components(links(prints.select("fingerprint"), radius))
    rooted = prints.join(roots, prints.fingerprint == roots.node, "left").select(
        "fingerprint", "lead", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    leads = rooted.groupBy("root").agg(F.min("lead").alias("first"))
    # Written, so that the last join has a plain shuffle on both sides, of
    # which adaptive execution can split the partition of a hot fingerprint.
    classes = materialize(rooted.join(leads, "root").select("fingerprint", "first"), "classes")
    return rows.join(classes, "fingerprint").select(
        "doc_id",
        "fingerprint",
        F.col("first.doc_id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("first_row"),
        *(extra or {}),
    )


def deduplicate(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, with all its
    columns. Rows that agree in id and text with the one that stays are copies
    of it; one of them is returned. Other edge cases: ``near_duplicates``.

    What goes is joined with the documents, not what stays: fewer rows. As
    they grow with the documents they are never broadcast; one shuffle deals
    out the documents, whatever their number."""
    mark, gone = fresh(docs.columns, "__mark", "__gone")
    key = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text"))
    found = near_duplicates(docs, width, radius, id_col, text_col, {"mark": key})
    marks = found.groupBy("mark").agg(F.max("first_row").alias("leads"), F.count(F.lit(1)).alias("rows"))
    marks = materialize(marks.where("not leads or rows > 1").select(F.col("mark").alias(gone), "leads"), "marks")
    marked = docs.withColumn(mark, key)
    # A struct is never null itself, and its null fields compare as equal.
    same = F.col(mark) == F.col(gone)
    once = marked.join(marks.select(gone).hint("merge"), same, "left_anti")
    if marks.where("leads").isEmpty():
        return once.drop(mark)
    again = marked.join(marks.where("leads").select(gone).hint("merge"), same, "left_semi").dropDuplicates([mark])
    return once.unionByName(again).drop(mark)
