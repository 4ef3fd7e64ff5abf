"""How far sources differ in their use of words, from an inverted index.

The shares that two sources of a language give to a term are compared over all
terms kept for that language. A source's share of a term that it never uses is
the same for all such terms, so each pair of sources starts at the number of
terms times the difference of these baselines. Postings (source and count of a
term) then correct it: once for each term of one source against the other's
baseline, summed by count, and once for each term that both have. Terms that
neither source uses are never visited.

Texts are reduced to counts inside the tasks that read them; what is shuffled
are counts of terms, then of kept terms. All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fernweft.materialize import materialize, release
from fernweft.operators.skew import salted_join
from fernweft.operators.topk import top_per_group

#: Counts that a task holds before it hands them on.
HELD = 400_000
#: ASCII letters in lower case, bytes of longer characters as they are, and a
#: space for everything else.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


@dataclass(frozen=True)
class Audit:
    """``least_docs``: documents of a language that a kept term is in.

    A term's share is ``1 + floor(scale * (count + prior) / (all + prior *
    terms))``. ``top`` terms are listed for each source."""

    least_docs: int = 30
    prior: int = 5
    scale: int = 1_000_000_000
    top: int = 50


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Occurrences ``n`` and documents ``docs`` of each term of each group.

    ``docs`` has text columns ``lang, source, text`` without nulls in the first
    two. Every group also has a row with the empty term and no occurrences, so
    that groups without terms are known."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, source) not in groups:
                    groups[lang, source] = (Counter({b"": 0}), Counter())
                n, within = groups[lang, source]
                found, before = terms(text), len(n)
                n.update(found)
                within.update(set(found))
                size += len(n) - before
                if size >= held:
                    yield from handed(groups)
                    groups, size = {}, 0
        yield from handed(groups)

    def handed(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, within) in groups.items():
            words = pa.array(list(n), pa.binary()).cast(pa.string())
            columns = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*columns, words, pa.array(list(n.values()), pa.int64()), pa.array([within[t] for t in n], pa.int64())], schema=COUNTED)

    partial = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, everything: Column, terms_: Column, how: Audit) -> Column:
    """A term's share in integers; null where no term is kept."""
    whole = lambda c: c.cast("decimal(38,0)")
    above = (count.cast("decimal(20,0)") + how.prior) * F.lit(how.scale).cast("decimal(10,0)")
    below = everything.cast("decimal(20,0)") + terms_.cast("decimal(12,0)") * F.lit(how.prior).cast("decimal(6,0)")
    return F.when(terms_ > 0, F.lit(1) + F.call_function("div", whole(above), whole(below)))


def index(docs: DataFrame, how: Audit) -> tuple[DataFrame, DataFrame]:
    """Postings ``lang, source, term, n, p, q`` of kept terms, where ``p`` is the
    share in the source and ``q`` that in the language, and groups ``lang,
    source, kept, base`` with the number of kept terms and the share of a term
    that the group does not use."""
    counts = materialize(term_counts(docs), "term-counts")
    by_term = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = materialize(by_term.where(F.col("docs") >= how.least_docs).select("lang", "term", "total"), "kept-terms")
    held = materialize(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_all"))
    used = held.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    known = counts.where("term = ''").select("lang", "source").join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    filled = known.na.fill(0, ["all", "kept", "lang_all"])
    groups = materialize(filled.withColumn("base", share(F.lit(0), F.col("all"), F.col("kept"), how)), "groups")
    with_sizes = held.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("all"), F.col("kept"), how), share(F.col("total"), F.col("lang_all"), F.col("kept"), how)
    postings = materialize(with_sizes.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "postings")
    release(counts)
    release(held)
    return postings, groups.select("lang", "source", "kept", "base")


def divergence(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Sum of ``abs(p - q)`` over all kept terms for each ordered pair of
    sources of a language: ``lang, source, other, value``.

    The pairs are what is asked for, so they are many where sources are; a
    language's sources are dealt over tasks by salt."""
    others = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"))
    far = F.abs(F.col("base") - F.col("other_base"))
    base = salted_join(groups, others, "lang").where("source <> other")
    start = base.select("lang", "source", "other", F.coalesce(F.col("kept") * far, F.lit(0)).alias("v"))
    # Terms of one source with the same count are corrected at once.
    alike = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).join(groups.select("lang", "source", "base"), ["lang", "source"])
    one = salted_join(alike, others, "lang").where("source <> other").withColumn("v", F.col("m") * (F.abs(F.col("p") - F.col("other_base")) - far)).where("v <> 0")
    one = one.groupBy("lang", "source", "other").agg(F.sum("v").alias("v"))
    based = postings.join(groups.select("lang", "source", "base"), ["lang", "source"]).select("lang", "source", "term", "p", "base")
    second = based.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("base").alias("other_base"))
    met = based.join(second, ["lang", "term"]).where("source < other")
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    both = met.withColumn("v", gap("p", "other_p") - gap("p", "other_base") - gap("base", "other_p") + gap("base", "other_base")).where("v <> 0")
    both = both.groupBy("lang", "source", "other").agg(F.sum("v").alias("v"))
    # Both sums are written once: each serves a pair in both orders.
    fixes = materialize(one.unionByName(both), "corrections")
    turned = fixes.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "v")
    summed = start.unionByName(fixes).unionByName(turned).groupBy("lang", "source", "other")
    return summed.agg(F.sum("v").alias("value"))


def audit(docs: DataFrame, how: Audit = Audit(), lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Differences between sources, and the terms that mark each source.

    Columns ``lang, source, part, item, value, rank``. Part ``pair``: item is
    each other source of the language, value the sum of the differences of
    shares over all kept terms. Part ``term``: items are the ``how.top`` terms
    whose share in the source is most above that in the language. Ranks go by
    value, greatest first, then by item.

    Null texts, languages and sources count as empty; an empty name is a name.
    Groups without terms are compared like any other; a language without kept
    terms has pairs of value 0. Repeated rows count as often as they occur. Long
    texts are read whole. An empty table gives no rows. Other columns are not
    read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    postings, groups = index(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).alias("text")), how)
    pairs = divergence(postings, groups)
    order = [F.desc("value"), F.asc("item")]
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    ranked = by_pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    above = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked.unionByName(top_per_group(above, ["lang", "source"], order, how.top))
