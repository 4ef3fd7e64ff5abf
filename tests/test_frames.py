"""Frames in slots against whole windows, and reachability against a search."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from fernweft.materialize import written
from fernweft.operators.closure import reachable, reached_nodes
from fernweft.operators.frames import row_frame, time_frame

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """A table of which one user has nine tenths, with ties and nulls."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 10 else rng.choice(["a", None]), rng.choice([None, *[START + timedelta(seconds=rng.randrange(5000))] * 30]), rng.choice([None, rng.randrange(100)])) for i in range(700)]
    return spark.createDataFrame(rows, "id int, user string, ts timestamp_ntz, v int").repartition(4)


@pytest.mark.parametrize("preceding,following,slot", [(60, 0, None), (60, 60, None), (0, 25, 7), (300, 10, 1000)])
def test_time_frames_agree_with_whole_windows(hot, preceding, following, slot):
    aggregates = {"top": F.max("v"), "n": F.count(F.lit(1)), "total": F.sum("v")}
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    whole = Window.partitionBy("user").orderBy(micros).rangeBetween(-preceding * 1_000_000, following * 1_000_000)
    want = hot.select("*", *[a.over(whole).alias(k) for k, a in aggregates.items()])
    got = time_frame(hot, ["user"], "ts", preceding, following, slot, **aggregates)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("before,after,rows", [(2, 1, 50), (0, 3, 10), (5, 0, 1), (4, 4, 10_000)])
def test_row_frames_agree_with_whole_windows(hot, before, after, rows):
    order = [F.col("ts").asc_nulls_last(), F.col("id")]
    whole = Window.partitionBy("user").orderBy(*order).rowsBetween(-before, after)
    want = hot.select("*", F.min("v").over(whole).alias("low"), F.count(F.lit(1)).over(whole).alias("n"))
    got = row_frame(hot, ["user"], order, before, after, rows, low=F.min("v"), n=F.count(F.lit(1)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_slot_holds_the_hot_group(hot):
    """The rows of a slot, seen by an aggregate that counts its window."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    sizes = hot.where("user = 'hot'").groupBy(slot).count()
    most = sizes.agg(F.max("count")).first()[0]
    frames = time_frame(hot, ["user"], "ts", 60, n=F.count(F.lit(1)))
    assert frames.where("user = 'hot' and ts is not null").agg(F.max("n")).first()[0] <= 2 * most < 60


def test_frames_of_empty_tables(hot):
    assert time_frame(hot.limit(0), ["user"], "ts", 60, n=F.count(F.lit(1))).count() == 0
    assert row_frame(hot.limit(0), ["user"], [F.col("ts")], 1, 1, n=F.count(F.lit(1))).count() == 0


def search(edges, start):
    out = set()
    for s in start:
        seen, edge, steps = {}, {s}, 0
        while edge:
            steps += 1
            edge = {b for a, b in edges if a in edge} - seen.keys()
            seen |= {n: steps for n in edge}
        out |= {(s, n, k) for n, k in seen.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reachable_agrees_with_a_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(1, 1), (2, 3), (2, 3), (100, 101), (101, 102), (102, 100)]
    edges += [(7, n) for n in range(200, 260)]
    start = [1, 2, 7, 100, 999]
    got = reachable(spark.createDataFrame([*edges, (None, 3), (3, None)], "a int, b int"), spark.createDataFrame([(s,) for s in [*start, 1, None]], "node int"))
    assert {tuple(r) for r in got.collect()} == search(edges, start) and got.count() == len(search(edges, start))
    near = reachable(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(100,)], "node int"), most_steps=2)
    assert {tuple(r) for r in near.collect()} == {(100, 101, 1), (100, 102, 2)}


def test_reachable_without_edges(spark):
    none = spark.createDataFrame([], "a int, b int")
    assert reachable(none, spark.createDataFrame([(1,)], "node int")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_reached_nodes_follow_chains_and_rings(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(20 + 20 * seed)] + [(1, 1), (100, 101), (101, 102), (102, 100), (101, 110), (110, 111)]
    edges += [(n, n + 1) for n in range(200, 290)] + [(3, 200), (290, 4), (500, 500), (500, 501), (600, 601), (601, 602)]
    start = [*range(0, 40, 3), *range(200, 290, 7), 100, 102, 110, 500, 600, 999]
    got = reached_nodes(spark.createDataFrame([*edges, (None, 3), (3, None)], "a int, b int"), spark.createDataFrame([(s,) for s in [*start, 0, None]], "node int")).collect()
    assert {tuple(r) for r in got} == {(s, n) for s, n, _ in search(edges, start)} and len(got) == len({tuple(r) for r in got})


def test_reached_pairs_are_not_written(spark):
    """All 400 nodes of a ring with shortcuts reach each other: 160,000 pairs."""
    nodes = spark.range(400).select(F.col("id").alias("node"))
    edges = nodes.selectExpr("node as a", "(node + 1) % 400 as b").union(nodes.selectExpr("node as a", "(node * 7 + 3) % 400 as b"))
    earlier = set(written(spark))
    got = reached_nodes(edges, nodes)
    assert sum(spark.read.parquet(p).count() for p in written(spark) if p not in earlier) < 20_000
    assert got.count() == 160_000


def test_no_task_holds_the_pairs_of_a_head(spark, tmp_path):
    """3,000 starts lead to one head and on to its chain of 1,000 nodes."""
    nodes = spark.range(10_000, 13_000).select(F.col("id").alias("node"))
    edges = nodes.selectExpr("node as a", "0L as b").union(spark.range(1_000).selectExpr("id as a", "id + 1 as b"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = reached_nodes(edges, nodes)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        got.write.parquet(f"{tmp_path}/pairs")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert sum(sizes) == 3_000 * 1_001 and max(sizes) < sum(sizes) / 2
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.distinct().count() == 3_000 * 1_001 and found.where("start < 10000 or node > 1000").isEmpty()
