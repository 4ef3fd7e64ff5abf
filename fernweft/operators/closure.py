"""Nodes that can be reached over the edges of a graph, cycles included.

Starts are numbered, and a node has one row for each 64 of them of which some
reach it: bits in a long. Rounds join and combine bits, never pairs; pairs are
made from bits as they are read, and are neither written nor shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fernweft.materialize import materialize, release
from fernweft.operators.order import places

#: Starts of a word of bits, as a power of two.
WORD_BITS = 6
#: Words and nodes, about, that are paired at once.
WORDS, TAIL = 16, 512


def reachable(edges: DataFrame, start: DataFrame, most_steps: int | None = None) -> DataFrame:
    """Columns ``start, node, steps``: the nodes that are reached from each of
    ``start``'s nodes over one edge or more, with the fewest edges it takes.

    ``edges`` has columns ``a`` and ``b``, ``start`` has ``node``. Each round
    takes only the bits that the last one added along the edges, so cycles end.
    Rounds are as many as the longest of the shortest paths, or ``most_steps``.
    Repeated edges and loops do not matter; nulls are no nodes.
    """
    links, (bits, names) = _links(edges), _numbered(start)
    found: list[DataFrame] = []
    state, fresh = bits.withColumn("fresh", F.lit(0).cast("long")).limit(0), bits
    while most_steps is None or len(found) < most_steps:
        state = _round(state, fresh, links)
        fresh = materialize(_added(state).withColumn("steps", F.lit(len(found) + 1)), "reached")
        if fresh.isEmpty():
            break
        found.append(fresh)
    empty = bits.withColumn("steps", F.lit(0)).limit(0)
    return _pairs(reduce(DataFrame.unionByName, found, empty), names, "steps")


def reached_nodes(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Columns ``start, node`` of ``reachable``, in fewer rounds.

    A node that one node alone leads to is reached by that one and by what
    reaches it. Such chains are followed up to their heads by doubling, and
    rounds go from head to head: they are as many as the longest of the shortest
    paths there, besides the logarithm of the longest chain.
    """
    links, (bits, names) = _links(edges), _numbered(start)
    one = links.groupBy("b").agg(F.min("a").alias("up"), F.count(F.lit(1)).alias("n")).where("n = 1")
    chain, own = _chains(materialize(one.select(F.col("b").alias("node"), "up"), "chain"), bits)
    inner = chain.select("node")
    # Chains that come from a ring have no head: their own bits are all.
    tops = materialize(chain.join(inner.select(F.col("node").alias("up")), "up", "left_anti").select("node", "up"), "chain-heads")
    into = materialize(links.join(inner.select(F.col("node").alias("b")), "b", "left_anti").select("a", F.col("b").alias("head")), "into-heads")
    first = bits.unionByName(own).join(into, F.col("node") == F.col("a")).groupBy("word", "head").agg(F.bit_or("bits").alias("bits"))
    first = materialize(first.select("word", F.col("head").alias("node"), "bits"), "first-bits")
    heads = into.join(tops.withColumnRenamed("node", "a"), "a").select(F.col("up").alias("a"), F.col("head").alias("b"))
    heads = heads.unionByName(into.join(inner.select(F.col("node").alias("a")), "a", "left_anti").select("a", F.col("head").alias("b")))
    between, state, fresh = materialize(heads.distinct(), "links"), first.withColumn("fresh", F.col("bits")), first
    while not fresh.isEmpty():
        state = _round(state, fresh, between)
        fresh = _added(state)
    known = state.select("word", F.col("node").alias("up"), F.col("bits").alias("above"))
    headed = own.join(tops, "node", "left").join(known, ["up", "word"], "left")
    rest = headed.select("word", F.array("node").alias("nodes"), F.expr("bits & ~coalesce(above, 0)").alias("bits")).where("bits <> 0")
    return _all_pairs(state, _tails(tops, state), rest, names)


def _links(edges: DataFrame) -> DataFrame:
    return materialize(edges.where("a is not null and b is not null").select("a", "b").distinct(), "links")


def _numbered(start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word, node, bits`` of the starts, and the ``starts`` of each word."""
    placed = places(start.where("node is not null").select("node").distinct(), [F.col("node")], "number")
    cut = placed.select(F.shiftright("number", WORD_BITS).alias("word"), "node", F.col("number").bitwiseAND((1 << WORD_BITS) - 1).cast("int").alias("bit"))
    named = cut.groupBy("word").agg(F.collect_list(F.struct("bit", F.col("node").alias("start"))).alias("starts"))
    return materialize(cut.select("word", "node", F.expr("shiftleft(1L, bit)").alias("bits")), "start-bits"), materialize(named, "starts")


def _round(state: DataFrame, fresh: DataFrame, links: DataFrame) -> DataFrame:
    """``word, node, bits, fresh`` after one edge more; the old state goes."""
    onward = fresh.join(links, fresh["node"] == links["a"]).select("word", F.col("b").alias("node"), "bits", F.lit(0).cast("long").alias("old"))
    both = state.select("word", "node", "bits", F.col("bits").alias("old")).unionByName(onward)
    grown = both.groupBy("word", "node").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
    after = materialize(grown.select("word", "node", "bits", F.expr("bits & ~old").alias("fresh")), "reached-bits")
    if any("/reached-bits-" in f for f in state.inputFiles()):
        release(state)
    return after


def _added(state: DataFrame) -> DataFrame:
    return state.where("fresh <> 0").select("word", "node", F.col("fresh").alias("bits"))


def _chains(chain: DataFrame, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, up`` with ``up`` as far as the chain goes, and ``word, node,
    bits`` of the starts from there on to the node before this one. Doubling
    ends with the longest chain; in rings, once all nodes are passed."""
    own = materialize(chain.join(bits.withColumnRenamed("node", "up"), "up").select("word", "node", "bits"), "chain-bits")
    passed, n = 1, chain.count()
    while passed < 2 * n:
        above = chain.select(F.col("node").alias("up"), F.col("up").alias("next"))
        if chain.join(above, "up", "left_semi").isEmpty():
            break
        longer = materialize(chain.join(above, "up", "left").select("node", F.coalesce("next", "up").alias("up")), "chain")
        more = chain.join(own.withColumnRenamed("node", "up"), "up").select("word", "node", "bits")
        grown = materialize(own.unionByName(more).groupBy("word", "node").agg(F.bit_or("bits").alias("bits")), "chain-bits")
        release(chain)
        release(own)
        chain, own, passed = longer, grown, 2 * passed
    return chain, own


def _tails(tops: DataFrame, state: DataFrame) -> DataFrame:
    """``up, nodes``: each head and its chains, in arrays of about ``TAIL`` nodes."""
    whole = tops.select("up", "node").unionByName(state.select(F.col("node").alias("up"), "node").distinct())
    sizes = whole.groupBy("up").agg(F.ceil(F.count(F.lit(1)) / TAIL).alias("parts"))
    cut = whole.join(sizes, "up").groupBy("up", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    return materialize(cut.agg(F.collect_list("node").alias("nodes")).select("up", "nodes"), "tails")


def _all_pairs(state: DataFrame, tails: DataFrame, rest: DataFrame, names: DataFrame) -> DataFrame:
    """``start, node`` of what reaches heads and hence their tails, and of ``rest``.

    ``WORDS`` words of a head meet an array of its nodes and the starts of these
    words, so that little is dealt out beside the pairs that come of it, and as
    much to each task whatever the graph. A run of nodes comes out for one start
    after the other, so that a file of pairs repeats itself and stays small.
    """
    group = F.floor(F.col("word") / WORDS).alias("group")
    wide = state.groupBy(group, F.col("node").alias("up")).agg(F.collect_list(F.struct("word", "bits")).alias("held"))
    cells = wide.join(tails, "up").select("group", "held", "nodes")
    cells = cells.unionByName(rest.select(group, F.array(F.struct("word", "bits")).alias("held"), "nodes"))
    word = F.struct("word", F.sort_array("starts")["start"].alias("starts"))
    stated = materialize(names.groupBy(group).agg(F.sort_array(F.collect_list(word))["starts"].alias("words")), "stated")
    # Tasks are stated, as their work is in what they return and not in what they read.
    tasks = 8 * state.sparkSession.sparkContext.defaultParallelism
    salts = -(-16 * tasks // max(1, stated.count()))
    dealt = cells.withColumn("salt", F.pmod(F.xxhash64(F.col("nodes")[0]), F.lit(salts))).repartition(tasks, "group", "salt")
    copies = stated.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).repartition(tasks, "group", "salt")
    # Merged, never broadcast: Spark's estimate leaves the copies out.
    met = dealt.join(copies.hint("merge"), ["group", "salt"]).select("nodes", "words", F.explode("held").alias("one"))
    each = met.select("nodes", F.col("one.bits").alias("bits"), F.col("words")[F.pmod("one.word", F.lit(WORDS)).cast("int")].alias("starts"))
    held = each.select("nodes", F.expr("if(bit_count(bits) = size(starts), starts, filter(starts, (s, i) -> getbit(bits, i) = 1))").alias("starts"))
    return held.select("nodes", F.explode("starts").alias("start")).select("start", F.explode("nodes").alias("node"))


def _pairs(found: DataFrame, names: DataFrame, *more: str) -> DataFrame:
    """``start, node`` of each bit, made as they are read."""
    each = found.where("bits <> 0").join(names, "word")
    held = F.expr("filter(starts, s -> getbit(bits, s.bit) = 1)")
    return each.select(F.explode(held).alias("one"), "node", *more).select(F.col("one.start").alias("start"), "node", *more)
