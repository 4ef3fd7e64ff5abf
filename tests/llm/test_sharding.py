"""The hash tree against draws computed plainly, and its law."""

from __future__ import annotations

import math
import time
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fernweft.llm.sharding import Node, assign, descend, grow, shard_of, shard_tree, table_of

SCHEMA = "doc_id bigint, text string, shard string"


def plain(node, doc_id):
    """The descent level by level, with hashes from another library."""
    first = 42 if doc_id is None else xxhash.xxh64_intdigest((doc_id & (2**64 - 1)).to_bytes(8, "little"), seed=42)

    def weight(node):
        return sum(map(weight, node.children)) if node.children else node.weight

    def drawn(node, path):
        u = ((xxhash.xxh64_intdigest(path.encode(), seed=first) >> 11) + 0.5) / 2**53
        return -math.log(u) / weight(node)

    path = ""
    while node.children:
        _, i = min((drawn(c, f"{path}/{c.name}"), i) for i, c in enumerate(node.children))
        node = node.children[i]
        path += "/" + node.name
    return node.shard


UNEVEN = Node("root", (Node("r0", (Node("k0", shard=0, weight=3.0), Node("k1", shard=1))), Node("r1", (Node("k0", shard=2, weight=0.5),))))


@pytest.mark.parametrize("tree", [shard_tree(8), shard_tree(9), shard_tree(3), shard_tree(1), shard_tree(13, 2, 3), UNEVEN])
def test_descent_agrees_with_plain_draws(spark, tree):
    ids = [*range(-3, 200), None, 2**62]
    got = {r.doc_id: r.shard for r in assign(spark.createDataFrame([(i, "t", "x") for i in ids], SCHEMA), tree).collect()}
    assert got == {i: plain(tree, i) for i in ids}


def test_shares_follow_weights(spark):
    n = 20_000
    counts = Counter(r.shard for r in shard_of(spark.range(n).toDF("doc_id"), UNEVEN).collect())
    for shard, weight in ((0, 3.0), (1, 1.0), (2, 0.5)):
        assert counts[shard] / n == pytest.approx(weight / 4.5, abs=0.02)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(6000).toDF("doc_id")
    trees = [shard_tree(1)]
    while len(trees) < 41:
        trees.append(grow(trees[-1]))
    rows = ids.select("doc_id", *[descend(t, F.col("doc_id")).alias(f"s{t.shards()}") for t in trees]).collect()
    for n in range(1, 41):
        moved = [r for r in rows if r[f"s{n}"] != r[f"s{n + 1}"]]
        assert moved and {r[f"s{n + 1}"] for r in moved} == {n}, n
        assert len(moved) / len(rows) == pytest.approx(1 / (n + 1), abs=0.03)


def test_a_shard_keeps_its_place_in_every_tree():
    places = {n.name: at for _, n, at in shard_tree(200).leaves()}
    for n in range(1, 200):
        assert all(places[leaf.name] == at for _, leaf, at in shard_tree(n).leaves())


def test_a_shard_added_to_racks_takes_rows_only_into_itself(spark):
    tree = shard_tree(13, 2, 3)
    rows = assign(spark.range(5000).toDF("doc_id").selectExpr("doc_id", "'t' as text"), tree, grow(tree, 2.0)).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {13} and len(moved) / len(rows) == pytest.approx(2 / 15, abs=0.03)


def test_draws_are_fan_out_times_depth():
    assert (shard_tree(1000, 10, 10).most_draws(), shard_tree(1000, 10, 10).depth()) == (30, 3)
    assert shard_tree(1000).most_draws() <= 8 + 8 + 16
    assert len(table_of(shard_tree(1000, 10, 10))) == 1 + 10 + 100 + 1000


def test_an_id_of_most_rows_is_many_tasks(spark):
    """Nine tenths of the rows have one id, so one shard; its slots are dealt
    out over the partitions of the order that is written."""
    rows = spark.range(20_000).selectExpr("case when id % 10 > 0 then 5 else id end as doc_id", "'same' as text")
    got = assign(rows, shard_tree(8))
    sizes = {r["shard"]: (r["count"], r["top"]) for r in got.groupBy("shard").agg(F.count(F.lit(1)).alias("count"), F.max("slot").alias("top")).collect()}
    assert all(top == n - 1 for n, top in sizes.values()) and max(n for n, _ in sizes.values()) > 18_000
    assert got.select("shard", "slot").distinct().count() == 20_000


def test_a_thousand_shards_are_planned_and_used(spark):
    docs, began = spark.range(2000).toDF("doc_id"), time.perf_counter()
    placed = shard_of(docs, shard_tree(1000))
    placed._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 5
    assert len({r.shard for r in placed.collect()}) > 800


def test_more_weight_moves_rows_only_into_its_shard(spark):
    heavier = Node("root", (Node("r0", (Node("k0", shard=0, weight=3.0), Node("k1", shard=1, weight=2.0))), UNEVEN.children[1]))
    rows = assign(spark.range(4000).toDF("doc_id").selectExpr("doc_id", "'t' as text"), UNEVEN, heavier).collect()
    moved = {(r.shard, r.grown_shard) for r in rows if r.shard != r.grown_shard}
    # Out of the other region into this one, and within it into the shard.
    assert (0, 1) in moved and moved <= {(0, 1), (2, 0), (2, 1)}


def test_slots_sizes_and_checksums(spark):
    texts = ["", None, "é", "plain", "long " * 100_000]
    rows = [(i, texts[i % 5], "clash") for i in range(100)] + [(7, "é", "again"), (7, "é", "again"), (None, "n", "x"), (None, "n", "x")]
    got = assign(spark.createDataFrame(rows, SCHEMA), shard_tree(8), grow(shard_tree(8))).collect()
    assert len(got) == len(rows)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_empty_table(spark):
    assert assign(spark.createDataFrame([], SCHEMA), shard_tree(8)).count() == 0
