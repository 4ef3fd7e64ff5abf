"""Spellings one error apart, found by forward and backward automata.

Of two words that differ by one inserted, deleted or replaced character, either
the first half of the shorter is exact or its second half is. Words are dealt
out by their halves; the words of a bucket are put into a minimal acyclic
automaton, read forwards for first halves and backwards for second ones. A word
is matched exactly through its half and completed with one error. States know
how many words lie beyond them, so a match has a number (a perfect hash) under
which what is known of the word is kept.

A word meets the shorter and equal ones, and the longer ones, under keys of
their own (the length of the shorter, and its half). A half that more words
share than an automaton should hold is cut into parts, and its words are looked
up in each. Tasks hand on counts and best matches of words, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernweft.materialize import materialize, release

#: Words that an automaton holds at most, and on average. Sizes, not caps: more
#: words of one half are more automata, each of which is asked.
MOST, MEAN = 40_000, 10_000
#: Counts that a task holds before it hands them on.
HELD = 400_000
#: Fixed values of the contract: characters of words.
LETTERS = r"A-Za-zÀ-ÿ"


@dataclass(frozen=True)
class Spelling:
    """Words have ``least_length`` characters and occur ``least_count`` times;
    a form is ``ratio`` times as frequent. Where ``misspell`` divides the
    checksum of a document's id and a word, the word loses a character: errors
    planted to be found. None plants none."""

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    misspell: int | None = None


def word_counts(docs: DataFrame, how: Spelling, held: int = HELD) -> DataFrame:
    """Words and their occurrences ``word, n`` in columns ``doc_id, text``."""
    pattern = re.compile(f"[{LETTERS}]{{{how.least_length},}}")

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                # Bytes are lower-cased in ASCII only.
                found = pattern.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                if how.misspell is None:
                    seen.update(found)
                else:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % how.misspell == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= how.least_length:
                            seen[word] += n
                if len(seen) >= held:
                    yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                    seen = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = docs.select("doc_id", "text").mapInArrow(words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= how.least_count)


class Automaton:
    """Minimal acyclic automaton of words, added in order of code points and
    each once; a word's number is its place among them."""

    def __init__(self) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.sizes: list[int] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._open: list[list] = [[False]]
        self._last = ""

    def add(self, word: str) -> None:
        last, open_ = self._last, self._open
        n = min(len(last), len(word))
        same = next((i for i in range(n) if last[i] != word[i]), n)
        self._close(same)
        open_.extend([False] for _ in range(len(word) - same))
        open_[-1][0] = True
        self._last = word

    def _close(self, upto: int) -> None:
        """Settle the states of the last word beyond a prefix: a state like one
        that is known is that one."""
        last, open_ = self._last, self._open
        for at in range(len(last), upto, -1):
            open_[at - 1] += (last[at - 1], self._settled(open_.pop()))

    def _settled(self, state: list) -> int:
        key = tuple(state)
        found = self._known.get(key)
        if found is None:
            size, edges = int(state[0]), {}
            for k in range(1, len(state), 2):
                edges[state[k]] = (state[k + 1], size)
                size += self.sizes[state[k + 1]]
            found = self._known[key] = len(self.edges)
            self.edges.append(edges)
            self.sizes.append(size)
            self.final.append(state[0])
        return found

    def close(self) -> None:
        """No words follow; from now on the automaton can be asked."""
        self._close(0)
        self.root = self._settled(self._open[0])
        self._known = {}

    def walk(self, state: int, number: int, word: str, at: int, end: int) -> tuple[int, int] | None:
        edges = self.edges
        for c in word[at:end]:
            step = edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, word: str, start: int) -> Iterator[int]:
        """Numbers of the words that replace or insert one character of
        ``word`` at ``start`` or later, each once: an inserted character that
        repeats its neighbour stands behind it."""
        here, end = self.walk(self.root, 0, word, 0, start), len(word)
        for at in range(start, end + 1):
            if here is None:
                return
            state, number = here
            c = word[at] if at < end else ""
            for other, (to, before) in self.edges[state].items():
                if other != c:
                    for next_at in (at, at + 1)[: 1 + (at < end)]:
                        found = self.walk(to, number + before, word, next_at, end)
                        if found and self.final[found[0]]:
                            yield found[1]
            here = self.walk(state, number, word, at, at + 1) if at < end else None


def dealt(words: DataFrame, least_length: int, most: int, mean: int) -> DataFrame:
    """Words by bucket and part: ``bucket, part, path, n, asked, held``.

    ``path`` is the length of the shorter word and the word, turned round in
    odd buckets; ``held`` rows go into the automaton, ``asked`` ones are looked
    up."""
    size, m = F.length("word"), F.col("m")
    half = F.floor(m / 2).cast("int")
    keyed = words.withColumn("m", F.explode(F.array(size, size - 1))).where(m >= least_length)
    keyed = keyed.withColumn("back", F.explode(F.array(F.lit(0), F.lit(1))))
    path = F.when(F.col("back") == 0, F.col("word")).otherwise(F.reverse("word"))
    keyed = keyed.withColumn("path", path).withColumn("key", F.xxhash64("back", "m", F.col("path").substr(F.lit(1), F.when(F.col("back") == 0, half).otherwise(m - half))))
    keyed = keyed.select("back", "key", F.concat_ws(":", "m", "path").alias("path"), "n", (size == m).alias("asked"))
    n = words.count()
    keyed = keyed.withColumn("bucket", F.pmod("key", F.lit(max(1, 2 * n // mean))) * 2 + F.col("back")).withColumn("part", F.lit(0)).withColumn("held", F.lit(True))
    hot = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most), "hot-halves")
    if not hot.isEmpty():
        # Hot halves are few by their size: one for each ``most`` rows at most.
        parts = F.coalesce(F.ceil(F.col("rows") / most), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("path"), F.col("parts")).cast("int")
        each = keyed.join(hot, "key", "left").withColumn("parts", parts).withColumn("own", own)
        each = each.withColumn("part", F.explode(F.when(F.col("asked"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
        keyed = each.withColumn("held", F.col("part") == F.col("own"))
    return keyed.select("bucket", "part", "path", "n", "asked", "held")


def best_matches(words: DataFrame, least_length: int, most: int = MOST, mean: int = MEAN) -> DataFrame:
    """For distinct words ``word, n``: their near words ``n_near`` and of these
    the most frequent, ``best`` with ``best_n`` (ties: the first by code
    points). Words without near ones are left out."""

    def flush(rows: list[tuple], more: Iterable[tuple], back: bool) -> Iterator[tuple[str, int, int, str]]:
        """``rows`` fill the automaton, in order; ``more`` are only asked."""
        automaton = Automaton()
        for path, *_ in rows:
            automaton.add(path)
        automaton.close()
        near = [0] * len(rows)
        best: list[tuple[int, str] | None] = [None] * len(rows)
        turn = -1 if back else 1
        names = [path.partition(":")[2][::turn] for path, *_ in rows]

        def ask(path: str, n: int) -> tuple[str, int, tuple[int, str] | None]:
            size, _, turned = path.partition(":")
            word, m = turned[::turn], int(size)
            half, count, top = m // 2, 0, None
            for k in automaton.one_error(path, len(size) + 1 + (m - half if back else half)):
                other = names[k]
                if back and other[:half] == word[:half]:
                    continue  # found forwards
                count += 1
                if top is None or (-rows[k][1], other) < top:
                    top = (-rows[k][1], other)
                if len(other) > m:  # is not itself asked under this length
                    near[k] += 1
                    if best[k] is None or (-n, word) < best[k]:
                        best[k] = (-n, word)
            return word, count, top

        for k, (path, n, asked) in enumerate(rows):
            if asked:
                _, count, top = ask(path, n)
                near[k] += count
                if top is not None and (best[k] is None or top < best[k]):
                    best[k] = top
        for path, n, _ in more:
            word, count, top = ask(path, n)
            if count:
                yield word, count, -top[0], top[1]
        yield from ((names[k], near[k], -b[0], b[1]) for k, b in enumerate(best) if b is not None)

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        row = next(stream, None)
        out: list[tuple] = []
        while row is not None:
            group, rows = row[:2], []
            while row is not None and row[:2] == group and row[5]:
                rows.append(row[2:5])
                row = next(stream, None)

            def others() -> Iterator[tuple]:
                nonlocal row
                while row is not None and row[:2] == group:
                    yield row[2:5]
                    row = next(stream, None)

            for found in flush(rows, others(), group[0] % 2 == 1):
                out.append(found)
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [name for name, _ in kinds])

    rows = dealt(words, least_length, most, mean)
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part", F.desc("held"), "path")
    found = ordered.mapInArrow(match, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("first.n")).alias("best_n"), F.col("first.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """For ``word, form``: the end of the chain of forms, ``word, root``.

    Each round doubles the steps that a word has gone. A form is several times
    as frequent as its word, so chains are short and have no cycles."""
    known = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = known.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("went"))
        after = materialize(moved, "roots")
        release(known)
        known = after
        if after.where("went").isEmpty():
            return known.select("word", "root")


def group_spellings(docs: DataFrame, how: Spelling = Spelling(), id_col: str = "doc_id", text_col: str = "text", most: int = MOST, mean: int = MEAN) -> DataFrame:
    """Words of all texts with the more frequent spelling that each goes with.

    Columns ``word, form, root, n, n_near, form_n``: one row for each word that
    is long and frequent enough. ``n_near`` counts words one error away, ``form``
    is the most frequent of them if frequent enough, else null, and ``root`` is
    where the chain of forms ends, the word itself if it has none.

    Words are maximal runs of letters, with A-Z in lower case. Null and empty
    texts have none; a null id counts as an empty one, where ids matter. Long
    texts are read whole, repeated rows count as often as they occur, ties go to
    the first word by code points. An empty table gives no rows. Other columns
    are not read.
    """
    words = materialize(word_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), how), "words")
    found = best_matches(words, how.least_length, most, mean)
    fits = F.col("best_n") >= F.col("n") * how.ratio
    judged = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")
    )
    judged = materialize(judged, "spellings")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
