"""Mixing sources to target weights by weighted fair queueing.

Each source lines its documents up in a shuffled order. A document's virtual
finish time is the source's words up to and including it, divided by the
source's target. All documents are range-sorted by that time and the order is
cut at the total budget, so every source has then given close to its target.
A source whose target exceeds its size queues again, up to a number of epochs.

Only DataFrame functions are used. Running totals go through buckets (see
``fernweft.operators.prefix``) cut by place in a range-sorted order, so a source
or an id with most of the rows is spread over many tasks; rows carried through
the shuffles are ids and counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from fernweft.llm.common import WORD, fresh, id_hash, word_count
from fernweft.materialize import materialize
from fernweft.operators.order import places
from fernweft.operators.prefix import bucket_bits, bucket_rows, running_total


@dataclass(frozen=True)
class Mix:
    """``weights`` go to sources in code point order, null last, in turn.

    ``share`` is the budget as a share of all words; ``epochs`` bounds how
    often a document is taken; ``seed`` picks the shuffled order.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.0
    epochs: int = 3
    seed: str = "mix:"


def targets(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row for each source: ``source, rank, size_all, rows, target``.

    Filling water: sources are ordered by cap over weight; the capped ones
    form a prefix of that order, and the first source whose share of what the
    prefix leaves stays below its cap fixes the level of all after it. The
    windows run over the table of sources, one row each, in one task: the number
    of sources must fit there.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy(F.col("ratio"), F.col("rank"))
    weights = F.array(*[F.lit(w) for w in mix.weights])
    stats = (
        rows.groupBy("source")
        .agg(F.sum("size").alias("size_all"), F.count(F.lit(1)).alias("rows"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(mix.weights) + 1).cast("int")))
        .withColumn("cap", F.col("size_all") * mix.epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.floor(F.sum("size_all").over(everything) * F.lit(mix.share)).cast("long"))
    )
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leveled = stats.withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    )
    open_from = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)
    capped = F.col("open").isNull() | (F.struct("ratio", "rank") < F.struct(F.col("open.ratio"), F.col("open.rank")))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("open.level") * F.col("weight"))
    return leveled.withColumn("open", open_from).select("source", "rank", "size_all", "rows", "budget", target.alias("target"))


def queue(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Every row with ``size, source_size, target, rank, place, cum, takes``.

    ``cum`` is the running total of sizes in the source's shuffled order and
    ``takes`` the number of times that the cut order holds the row.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            id_hash(F.col(id_col), mix.seed).alias("place"),
        ),
        "mix-rows",
    )
    goals = materialize(targets(rows, mix), "mix-targets")
    n, budget = goals.agg(F.sum("rows"), F.max("budget")).first()
    each = bucket_rows(docs.sparkSession, n or 0)
    goal = goals.select(F.col("source").alias("__source"), "rank", F.col("size_all").alias("source_size"), "target")
    known = rows.join(goal, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # Slices are cut by place in one order of all rows, not by hash of the id:
    # the rows of a repeated or null id, be they most of the table, are many.
    queued = places(known, [F.col("rank"), F.col("place"), F.col("doc_id").asc_nulls_first(), F.col("size")], "at")
    lined = running_total(
        queued.withColumn("slice", F.floor(F.col("at") / each)), F.col("size"), "cum", within=["rank"], bucket="slice", order=[F.col("at")]
    ).drop("at")
    lined = materialize(lined, "mix-queue")
    # A source's queue is dense in its finish time, so slices of equal width
    # hold like numbers of rows.
    finish = (F.col("source_size") * F.col("epoch") + F.col("cum")) / F.col("target")
    order = (
        lined.where("size > 0")
        .select("rank", "cum", "size", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(mix.epochs - 1))).alias("epoch"))
        .withColumn("finish", finish)
        .withColumn("slice", F.floor(F.col("finish") * float(1 << bucket_bits(n or 0, each))))
    )
    served = running_total(
        order, F.col("size"), "served", within=[], bucket="slice", order=[F.col("finish"), F.col("rank"), F.col("cum")]
    )
    last = served.where(F.col("served") <= F.lit(budget or 0)).agg(F.max(F.struct("finish", "rank", "cum")).alias("last")).first()["last"]
    if last is None:
        return lined.withColumn("takes", F.lit(0)).drop("slice")
    cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).alias("rank"), F.lit(last["cum"]).alias("cum"))
    takes = sum(
        F.when(F.struct(((F.col("source_size") * e + F.col("cum")) / F.col("target")).alias("finish"), "rank", "cum") <= cut, 1).otherwise(0)
        for e in range(mix.epochs)
    )
    return lined.withColumn("takes", F.when(F.col("size") > 0, takes).otherwise(0)).drop("slice")


def plan_mix(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How much of each row the mix takes; one output row for each input row.

    Columns ``doc_id, source, size`` (words), ``source_size, target`` (words
    the mix wants of the source), ``takes`` (times) and ``taken`` (words).

    A null text has no words; rows without words are never taken. A null
    source is a source, last in order. Ids may be null or repeat, in most rows
    too; rows alike in source, id and size are interchangeable. An empty table gives an empty plan.
    Other columns are not read.
    """
    rows = queue(docs, mix, id_col, text_col, source_col)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", F.col("takes").cast("int").alias("takes"), (F.col("size") * F.col("takes")).alias("taken")
    )


def edges(rows: DataFrame, mix: Mix) -> DataFrame:
    """Where each source's takes end: for t from 1 to the epochs, ``last<t>`` is
    the last place in its queue with t takes or more, ``all<t>`` the rows there
    and ``some<t>`` those of them that are taken so often."""
    levels = range(1, mix.epochs + 1)
    key = F.struct("place", "doc_id", "size")
    ends = rows.groupBy("source").agg(*[F.max(F.when(F.col("takes") >= t, key)).alias(f"last{t}") for t in levels])
    met = rows.join(ends.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    out = []
    for t in levels:
        here = key == F.col(f"last{t}")
        out += [
            F.max(f"last{t}").alias(f"last{t}"),
            F.count(F.when(here, 1)).alias(f"all{t}"),
            F.count(F.when(here & (F.col("takes") >= t), 1)).alias(f"some{t}"),
        ]
    return met.groupBy("source").agg(*out)


def apply_mix(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: each row as often as the mix takes it.

    A source's queue is taken up to a place, so a row's id and source tell how
    often it is taken, and the documents are not shuffled. Only rows that
    repeat at such a place, in id and size, are told apart by number.

    Columns are those of the input, under any names. Other edge cases are those
    of ``plan_mix``.
    """
    ends = materialize(edges(queue(docs, mix, id_col, text_col, source_col), mix), "mix-edges")
    of, end, place, times, tied = fresh(docs.columns, "__of", "__end", "__place", "__times", "__tied")
    levels = range(1, mix.epochs + 1)
    parted = ends.where(" or ".join(f"some{t} < all{t}" for t in levels)).first() is not None
    ends = ends.select(F.col("source").alias(of), F.struct(*[c for c in ends.columns if c != "source"]).alias(end))
    joined = docs.join(ends, F.col(source_col).cast("string").eqNullSafe(F.col(of))).withColumn(place, id_hash(F.col(id_col), mix.seed))
    # A struct is never null itself, and its null fields compare as equal.
    here, size = F.struct(F.col(place).alias("place"), F.col(id_col).alias("doc_id")), word_count(F.col(text_col))
    whole, parts = F.lit(0), []
    for t in levels:
        last, every, some = (F.col(end)[f"{x}{t}"] for x in ("last", "all", "some"))
        at = F.struct(last["place"].alias("place"), last["doc_id"].alias("doc_id"))
        within = (here < at) | (here == at) & ((size < last["size"]) | (size == last["size"]) & (some == every))
        whole += F.when(last.isNotNull() & within, 1).otherwise(0)
        parts.append(last.isNotNull() & (here == at) & (size == last["size"]) & (some < every))
    joined = joined.where(F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))).withColumn(times, whole)
    row = times + "_row"
    joined = joined.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), times, place, of, F.array(*[F.when(p, F.col(end)[f"some{t}"]) for t, p in zip(levels, parts)]).alias(tied))
    if parted:
        apart, slices = F.exists(tied, lambda n: n.isNotNull()), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ties = materialize(joined.where(apart).withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices))), "mix-ties")
        nth = running_total(ties, F.lit(1), "nth", within=[of, place], bucket="slice", order=[F.col(place)])
        more = F.aggregate(tied, F.lit(0), lambda n, some: n + F.when(F.col("nth") <= some, 1).otherwise(0))
        joined = joined.where(~apart).select(row, times).unionByName(nth.select(row, (F.col(times) + more).alias(times)))
    taken = joined.where(F.col(times) > 0)
    return taken.select(row, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(row)[c].alias(c) for c in docs.columns])
