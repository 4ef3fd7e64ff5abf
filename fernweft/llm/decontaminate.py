"""Benchmark decontamination: rare n-gram seeds, then local alignment.

A test item's n-grams are counted over all training documents. The rarer ones
are seeds by themselves, and common ones are where several meet: a leak raises
the counts of the very n-grams that it keeps. Passages around a document's
seeds are aligned with the item by Smith-Waterman over words, so that edited
copies score by the words they keep in order.

Benchmarks are taken in blocks of bounded size, one after the other: executors
hold one block at a time. Documents are read in place and never shuffled; with
further blocks, what one has found is written before the next is sent.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from fernweft.llm.common import fresh
from fernweft.materialize import materialize, release

_word = re.compile(r"\w+")
_space = re.compile(r"\s")
HITS = "array<struct<item_id:bigint,score:double,start:bigint,end:bigint>>"
MATCH, MISMATCH, GAP = 2, -1, -1
#: Odd multiplier of the n-gram keys, which wrap around 64 bits. Two n-grams of
#: one key make a seed too many, which the alignment then judges.
STEP = np.int64(-7046029254386353131)
#: Characters of a text whose words are in memory as strings at once.
PIECE = 1 << 20
#: Places of grams that are worked on at once, or those of one item.
LOT = 1 << 20


@dataclass(frozen=True)
class Matching:
    """``n``: words of a seed. ``least_words``: words of an item at least, or
    ``n`` if that is more; shorter ones occur by chance and are passed over.
    ``seed_share``: share of an item's n-grams,
    rarest first, that are seeds alone (ties of the last are all taken).
    ``common``: different n-grams of any count in a passage that are seeds.
    ``least_score``: alignment score over that of a verbatim copy.
    ``slack``: words, as a share of the item, that a passage reaches beyond it.
    ``block_chars``: characters of benchmark text that executors hold at once;
    a worker needs about 6 bytes for each, and the driver 14 while it makes a block.
    """

    n: int = 3
    least_words: int = 5
    seed_share: float = 0.5
    common: int = 2
    least_score: float = 0.5
    slack: float = 0.3
    block_chars: int = 24_000_000


def words(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def pieces(text: str, size: int) -> Iterator[str]:
    """A text in pieces, each cut after white space at or beyond ``size``."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            gap = _space.search(text, end)
            end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


class Block:
    """A block of items: vocabulary, words of all items in a row, and grams.

    Where items have each gram is known in the driver only; executors search by
    a matcher's entries."""

    def __init__(self, items: list[tuple[int, str]], n: int, least_words: int = 1):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        row, item_ids, sizes = array("i"), [], []
        for item_id, text in items:
            found = words(text)
            if len(found) >= max(n, least_words):
                row.extend(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found)
                item_ids.append(item_id)
                sizes.append(len(found))
        self.flat, self.item_ids, self.sizes = np.array(row, np.int32), np.array(item_ids, np.int64), np.array(sizes, np.int64)
        #: Where each item begins in the row, and beyond the last where it ends.
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        place, owner = spread(self.begins[:-1], self.sizes - n + 1)
        self.owner, self.offset = owner.astype(np.int32), (place - self.begins[owner]).astype(np.int32)
        self.grams_sorted, gram = np.unique(self.grams(self.flat, place), return_inverse=True)
        self.gram = gram.astype(np.int32)

    def __getstate__(self) -> dict[str, object]:
        return {name: value for name, value in self.__dict__.items() if name not in ("owner", "offset", "gram")}

    def item(self, k: int) -> np.ndarray:
        """Word ids of an item, given its number."""
        return self.flat[self.begins[k] : self.begins[k + 1]]

    def grams(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of the n-grams that start at the given places."""
        key = np.zeros(len(at), np.int64)
        for k in range(self.n):
            key = key * STEP + ids[at + k] + 1
        return key

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and gram numbers of the block's grams in a text of word ids
        (-1: not in the vocabulary)."""
        known = ids >= 0
        whole = np.ones(max(0, len(ids) - self.n + 1), bool)
        for k in range(self.n):
            whole &= known[k : k + len(whole)]
        place = np.flatnonzero(whole)
        if not len(place) or not len(self.grams_sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = self.grams(ids, place)
        slot = np.minimum(np.searchsorted(self.grams_sorted, key), len(self.grams_sorted) - 1)
        same = self.grams_sorted[slot] == key
        return place[same], slot[same]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text's words, -1 for words that no item has."""
        get = self.vocabulary.get
        parts = [np.zeros(0, np.int64)]
        for piece in pieces(text or "", PIECE):
            found = words(piece)
            parts.append(np.fromiter(map(get, found, repeat(-1)), np.int64, len(found)))
        return np.concatenate(parts)

    def seeds(self, counts: np.ndarray, share: float) -> np.ndarray:
        """Which entries (item, offset) are rare, given each gram's count."""
        rarity = counts[self.gram]
        starts = np.searchsorted(self.owner, np.arange(len(self.item_ids) + 1))
        last = starts[:-1] + np.maximum(0, np.ceil(share * np.diff(starts)).astype(np.int64) - 1)
        bars = rarity[np.lexsort((rarity, self.owner))[last]]
        return rarity <= bars[self.owner]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of word ids, and its start and end in the
    passage. A word outside the vocabulary (-1) matches none."""
    n = len(passage)
    along = np.arange(1, n + 1) * -GAP
    above = np.zeros(n + 1, np.int64)
    start_above = np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = above[1:] + GAP
        own = np.maximum(np.maximum(diagonal, up), 0)
        start = np.where(own == 0, np.arange(1, n + 1), np.where(own == diagonal, start_above[:-1], start_above[1:]))
        lifted = own + along
        reach = np.maximum.accumulate(lifted)
        row = reach - along
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(n), 0))
        start = np.where(row > own, start[source], start)
        above = np.concatenate([[0], row])
        start_above = np.concatenate([[0], start])
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(start[k]), k + 1)
    return best


class Matcher:
    """Finds a block's items in texts, given the seeds."""

    def __init__(self, block: Block, rare: np.ndarray, how: Matching):
        self.block, self.how = block, how
        # Of an item's places of one gram the first and last tell where passages
        # begin and end; those between are left out.
        order = np.lexsort((block.offset, block.owner, block.gram))
        gram, owner = block.gram[order], block.owner[order]
        other = (np.diff(gram) != 0) | (np.diff(owner) != 0)
        order = order[np.append(True, other) | np.append(other, True)] if len(order) else order
        self.entry_rare, self.entry_owner, self.entry_offset = rare[order], block.owner[order], block.offset[order]
        #: Where each gram's entries begin, and beyond the last where they end.
        self.entries = np.searchsorted(block.gram[order], np.arange(len(block.grams_sorted) + 1)).astype(np.int32)
        #: Grams that are rare for some item.
        self.gram_rare = np.zeros(len(block.grams_sorted), bool)
        self.gram_rare[block.gram[rare]] = True
        self.pads = np.ceil(how.slack * block.sizes).astype(np.int64) + 2
        #: Marks of the words that the text at hand has.
        self.present = np.zeros(len(block.vocabulary), bool)

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """Best passage (item id, score, start and end in words) of every item
        that the text holds; texts null or without seeds have none."""
        ids = self.block.encode(text)
        best: dict[int, tuple[int, int, int]] = {}
        for k, lo, hi in self.searched(ids, True):
            item = self.block.item(k)
            passage = ids[lo:hi]
            # No score exceeds that of the item's words that the passage has.
            least = self.how.least_score * MATCH * len(item)
            if MATCH * np.isin(item, passage).sum() < least:
                continue
            score, start, end = align(item, passage)
            if score >= least and score > best.get(k, (0, 0, 0))[0]:
                best[k] = (score, lo + start, lo + end)
        return [(int(self.block.item_ids[k]), score / (MATCH * self.block.sizes[k]), start, end) for k, (score, start, end) in best.items()]

    def passages(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """Item number, and first and beyond last word, of each passage that
        has a rare gram of the item, or enough different ones, by item and
        place. Where an item's passages would overlap they are one."""
        return list(self.searched(ids, False))

    def searched(self, ids: np.ndarray, reaching: bool) -> Iterator[tuple[int, int, int]]:
        """``passages``, or only those of items that could reach the bar with
        all of their words that the text has.

        Items are narrowed down by what the whole text has of them, each gram
        counted once, before any place is looked at; those left are taken in lots
        of bounded size. So a text of grams that very many items share costs no
        more than one with few."""
        place, gram = self.block.hits(ids)
        # Most texts have no gram of any item, or one that is common.
        if not len(place) or len(place) < self.how.common and not self.gram_rare[gram].any():
            return
        by_gram = np.argsort(gram, kind="stable")
        place, gram = place[by_gram], gram[by_gram]
        at = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1])
        grams, times = gram[at], np.append(at[1:], len(gram)) - at
        if len(grams) < self.how.common and not self.gram_rare[grams].any():
            return
        entry, which = spread(self.entries[grams], self.entries[grams + 1] - self.entries[grams])
        owner = self.entry_owner[entry]
        chosen = np.flatnonzero(self.able(ids, owner, self.entry_rare[entry], reaching)[owner])
        chosen = chosen[np.argsort(owner[chosen], kind="stable")]
        entry, which, owner = entry[chosen], which[chosen], owner[chosen]
        firsts = np.flatnonzero(np.diff(owner, prepend=-1))
        before = np.concatenate([[0], np.cumsum(times[which])])
        while len(firsts):
            ends = np.append(firsts[1:], len(owner))
            n = max(1, int(np.searchsorted(before[ends] - before[firsts[0]], LOT, "right")))
            lot = slice(firsts[0], ends[n - 1])
            yield from self.lot_passages(ids, grams, place, at[which[lot]], times[which[lot]], which[lot], entry[lot])
            firsts = firsts[n:]

    def able(self, ids: np.ndarray, owner: np.ndarray, rare: np.ndarray, reaching: bool) -> np.ndarray:
        """Which items could have a passage, by item number."""
        enough = np.bincount(owner) + self.how.common * np.bincount(owner, rare) >= self.how.common
        if not reaching:
            return enough
        items = np.flatnonzero(enough)
        known = ids[ids >= 0]
        self.present[known] = True
        at, _ = spread(self.block.begins[items], self.block.sizes[items])
        had = np.add.reduceat(self.present[self.block.flat[at]], np.concatenate([[0], np.cumsum(self.block.sizes[items])[:-1]]), dtype=np.int64) if len(items) else items
        self.present[known] = False
        enough[items] = MATCH * had >= self.how.least_score * MATCH * self.block.sizes[items]
        return enough

    def lot_passages(self, ids: np.ndarray, grams: np.ndarray, places: np.ndarray, at: np.ndarray, times: np.ndarray, which: np.ndarray, entry: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Passages of the items of some entries. ``places`` has where the text
        has each gram; an entry's are ``times`` from ``at``."""
        hit, number = spread(at, times)
        owner, begin = self.entry_owner[entry][number], places[hit] - self.entry_offset[entry][number]
        rare, gram = self.entry_rare[entry][number], grams[which][number]
        chosen = np.lexsort((begin, owner))
        owner, begin, rare, gram = owner[chosen], begin[chosen], rare[chosen], gram[chosen]
        cut = (owner[1:] != owner[:-1]) | (np.diff(begin) > (self.block.sizes + 2 * self.pads)[owner[1:]])
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        lasts = np.append(starts[1:], len(owner)) - 1
        number = np.repeat(np.arange(len(starts)), lasts - starts + 1)
        by_gram = np.lexsort((gram, number))
        new = np.concatenate([[True], (np.diff(number[by_gram]) != 0) | (np.diff(gram[by_gram]) != 0)])
        seeded = np.logical_or.reduceat(rare, starts) | (np.bincount(number[by_gram], new) >= self.how.common)
        k, lo, hi = owner[starts[seeded]], begin[starts[seeded]], begin[lasts[seeded]]
        lo, hi = np.maximum(0, lo - self.pads[k]), np.minimum(len(ids), hi + self.block.sizes[k] + self.pads[k])
        yield from zip(k.tolist(), lo.tolist(), hi.tolist())


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``count`` numbers from ``first``, one after the other, and the
    number of the run that each belongs to."""
    run = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    return np.arange(len(run)) - np.repeat(ends - count, count) + np.asarray(first)[run], run


def blocks(benchmark: DataFrame, how: Matching, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark in blocks; the driver holds one partition and one block."""
    held: list[tuple[int, str]] = []
    size = 0
    items = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).distinct()
    for item_id, text in items.toLocalIterator():
        if held and size + len(text) > how.block_chars:
            yield Block(held, how.n, how.least_words)
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    if held:
        yield Block(held, how.n, how.least_words)


def gram_counts(docs: DataFrame, block: Block, text_col: str) -> np.ndarray:
    """Documents that hold each gram of the block, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = shared.value
        total = np.zeros(len(own.grams_sorted), np.int64)
        for batch in batches:
            for text in batch.column(0):
                _, gram = own.hits(own.encode(text.as_py()))
                total[np.unique(gram)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts, known = np.zeros(len(block.grams_sorted), np.int64), counted.toArrow()
    counts[known["gram"].to_numpy()] = known["n"].to_numpy()
    shared.destroy()
    return counts


def matched(shared: Broadcast, text: Column) -> Column:
    """The items of one block that each text holds."""

    @F.arrow_udf(HITS)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        own: Matcher = shared.value
        for texts in batches:
            rows = (own.find(t.as_py()) for t in texts)
            yield pa.array([[dict(zip(("item_id", "score", "start", "end"), h)) for h in hits] for hits in rows], kind)

    return match(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks", how: Matching = Matching(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the test items that each text holds in column ``name``:
    an array of ``item_id, score, start, end`` (in words), one for each item.

    Null and empty texts hold none; long texts are searched whole, in memory
    that grows with the text and a block, not with both. Items that
    are null, without an id or too short (``Matching.least_words``) are passed
    over; repeated items count once. Repeated rows are judged alike. An empty
    table gives no rows; with an empty benchmark no document holds any item. A
    column named ``name`` is replaced.

    A block's words and seeds are sent to the executors, and withdrawn once
    its hits are written; those of the last block stay for the result.
    """
    spark = docs.sparkSession
    found, last = docs.withColumn(name, F.array().cast(HITS)), None
    shared: Broadcast | None = None
    for block in blocks(benchmark, how, item_id, item_text):
        if shared is not None:
            found, before = materialize(found, "leaks"), last
            shared.destroy()
            if before is not None:
                release(before)
            last = found
        chosen = block.seeds(gram_counts(docs, block, text_col), how.seed_share)
        shared = spark.sparkContext.broadcast(Matcher(block, chosen, how))
        found = found.withColumn(name, F.concat(F.col(name), matched(shared, F.col(text_col))))
        del block  # before the driver makes the next
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: Matching = Matching(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no test item, with all their columns.

    Edge cases are those of ``find_leaks``.
    """
    (name,) = fresh(docs.columns, "__leaks")
    return find_leaks(docs, benchmark, name, how, text_col, item_id, item_text).where(F.size(name) == 0).drop(name)
