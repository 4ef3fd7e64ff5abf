"""Operators of the engine on small tables with nulls, ties and hot keys."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark import Broadcast
from pyspark.sql import functions as F

from fernweft.functions.vectors import top_neighbours
from fernweft.operators.asof import asof_join, interval_join
from fernweft.operators.prefix import bucket_bits, bucket_rows, running_total
from fernweft.operators.skew import salted_distinct_count, salted_join
from fernweft.operators.topk import top_per_group
from fernweft.plans.extensions import CATALOG as EXTENSIONS
from fernweft.sources.files import read_files, round_trip

START = datetime(2024, 1, 1)


def test_asof_takes_latest_at_or_before_with_null_groups(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), (None, 3), ("b", 9)], "g string, t int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 4, 40), (None, 2, 20), ("b", 10, 100)], "g string, t int, v int")
    got = {(r.g, r.t): r.right_v for r in asof_join(left, right, ["g"], "t", ["v"]).collect()}
    assert got == {("a", 5): 50, ("a", 1): None, (None, 3): 20, ("b", 9): None}
    strict = {(r.g, r.t): r.right_v for r in asof_join(left, right, ["g"], "t", ["v"], strict=True).collect()}
    assert strict[("a", 5)] == 40


@pytest.mark.parametrize("strict", [False, True])
def test_asof_in_slots_agrees_with_one_order(spark, strict):
    rng = random.Random(6)
    make = lambda n: [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(60)]), i) for i in range(n)]
    left, right = (spark.createDataFrame(make(n), "g string, t int, v int") for n in (200, 40))
    whole = asof_join(left, right, ["g"], "t", ["v"], strict=strict)
    for width in (1, 7, 100):
        slots = asof_join(left, right, ["g"], "t", ["v"], strict=strict, slot=F.floor(F.col("t") / width))
        assert sorted(map(str, slots.collect())) == sorted(map(str, whole.collect()))


def test_estimates_keep_their_error_bounds(spark, sf_dir):
    orders, events = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("orders", "events"))
    exact = {r[0]: r[1] for r in orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey")).collect()}
    for r in EXTENSIONS.queries["a8_approx_distinct"](spark, "/root/testdata/sf0.1").collect():
        assert abs(r.customers / exact[r.o_orderstatus] - 1) <= 3 * 0.02
    users = {r[0]: r[1] for r in events.groupBy("event_type").agg(F.count_distinct("user_id")).collect()}
    values = {r[0]: sorted(r[1]) for r in events.groupBy("event_type").agg(F.collect_list("value")).collect()}
    for r in EXTENSIONS.queries["a13_sketches"](spark, "/root/testdata/sf0.1").collect():
        assert abs(r.users / users[r.event_type] - 1) <= 3 * 1.04 / 2**6, "HLL of 2^12 registers"
        own = values[r.event_type]
        place = sum(v <= r.middle for v in own) / len(own)
        assert abs(place - 0.5) <= 1 / 10_000 + 1 / len(own), "rank error of 1 / accuracy"
        assert r.sketch_bytes > 0


def test_interval_join_agrees_with_nested_loops(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), START + timedelta(seconds=rng.randrange(500)), i) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, ts timestamp, i int")
    got = sorted((r.i, r.right_i) for r in interval_join(df, df, ["g"], "ts", "ts", 30).collect())
    want = sorted((a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and timedelta(0) < b[1] - a[1] <= timedelta(seconds=30))
    assert got == want


@pytest.mark.parametrize("bits", [0, 3, 6])
def test_running_total_agrees_with_one_pass(spark, bits):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), i, rng.randrange(9)) for i in rng.sample(range(64), 60)]
    df = spark.createDataFrame(rows, "g string, k int, v int").withColumn("slice", F.shiftright("k", 6 - bits))
    got = {(r.g, r.k): r.s for r in running_total(df, F.col("v"), "s", within=["g"], bucket="slice", order=[F.col("k")]).collect()}
    want, sums = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + v
        want[(g, k)] = sums[g]
    assert got == want


def test_buckets_grow_with_rows(spark):
    assert [bucket_bits(n, 50_000) for n in (0, 49_999, 50_000, 1_000_000)] == [0, 0, 1, 5]
    assert [bucket_rows(spark, n) for n in (0, 160_000, 10**9)] == [250, 10_000, 50_000]


def test_salted_forms_agree_with_plain_ones(spark):
    facts = spark.createDataFrame([("hot", i % 7) for i in range(200)] + [("cold", 1), (None, 2)], "k string, v int")
    lookup = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, w int")
    joined = salted_join(facts, lookup, "k", 4)
    assert joined.groupBy("k").count().orderBy("k").collect() == facts.join(lookup, "k").groupBy("k").count().orderBy("k").collect()
    counts = {r.k: r.n for r in salted_distinct_count(facts, ["k"], "v", "n").collect()}
    assert counts == {"hot": 7, "cold": 1, None: 1}


def test_salted_copies_are_not_broadcast(spark):
    """A lookup that Spark takes for small is there ``salts`` times."""
    lookup = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    joined = salted_join(spark.range(1000).select((F.col("id") % 7).alias("k")), lookup, "k", 4)
    assert joined.count() == 1000 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_top_per_group_prunes_before_the_shuffle(spark):
    df = spark.range(100).select(F.col("id") % 3, "id").toDF("g", "id")
    top = top_per_group(df, ["g"], [F.desc("id")], 2)
    assert sorted((r.g, r.id) for r in top.collect()) == [(0, 96), (0, 99), (1, 94), (1, 97), (2, 95), (2, 98)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_neighbours_in_blocks_agree_with_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "i int, v array<double>")
    live, most = set(), []
    send, destroy = type(spark.sparkContext).broadcast, Broadcast.destroy
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: (b := send(self, x), live.add(id(b)), most.append(len(live)))[0])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (live.discard(id(self)), destroy(self, *a)))
    got = top_neighbours(df, df.where("i % 10 = 0"), "i", "v", 3, block_bytes=128).collect()
    assert len(most) > 1 and max(most) == 1, "one block at a time"
    for q in range(0, 60, 10):
        scores = sorted(((-vectors[q] @ vectors[j], j) for j in range(60) if j != q))[:3]
        assert [r.neighbour_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [j for _, j in scores]
    assert top_neighbours(df, df.where("i < 0"), "i", "v", 3).count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats_keep_nulls_quotes_and_lines(spark, fmt):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, None), (3, "é,x")], "i int, s string")
    assert sorted(round_trip(df, fmt).collect()) == sorted(df.collect())


def test_unknown_format_is_named(spark):
    with pytest.raises(ValueError, match="unknown format"):
        read_files(spark, "/nowhere", "docx")
