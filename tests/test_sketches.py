"""Sketches merged over days against one pass, and probes against counts."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fernweft.operators.sketches import count_min, heavy_hitters, merged, probed, sketch_table
from fernweft.streaming.replay import replay
from fernweft.streaming.runs import ROCKSDB
from fernweft.streaming.timers import timed_sessions
from fernweft.streaming.windows import timed

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(8)
    rows = [(i % 10, rng.choice("ab"), rng.choice([None, *[int(rng.paretovariate(0.4)) % 5000] * 20]), rng.gauss(0, 9)) for i in range(20_000)]
    return spark.createDataFrame(rows, "day int, kind string, user int, v double").repartition(6).cache(), rows


def test_merged_days_equal_one_pass(visits):
    df, rows = visits
    days = sketch_table(df, ["day", "kind"], "user", "v")
    got = {r.kind: r for r in merged(days.where("day between 2 and 7"), ["kind"], [0.1, 0.5, 0.99]).collect()}
    once = {r.kind: r.n for r in df.where("day between 2 and 7").groupBy("kind").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user", 12)).alias("n")).collect()}
    for kind in "ab":
        own = [r for r in rows if r[1] == kind and 2 <= r[0] <= 7]
        exact = len({r[2] for r in own if r[2] is not None})
        assert got[kind].n == len(own)
        assert abs(got[kind].distinct / once[kind] - 1) <= 0.01, "the union is the sketch of all rows"
        assert abs(got[kind].distinct / exact - 1) <= 3 * 1.04 / 2**6
        values = sorted(r[3] for r in own)
        for share, q in zip([0.1, 0.5, 0.99], got[kind].quantiles):
            assert abs(sum(v <= q for v in values) / len(values) - share) <= 0.02
    assert merged(days, [], [0.5]).first().n == len(rows)


def test_count_min_is_never_below_and_seldom_above_its_error(visits):
    df, rows = visits
    counts = Counter(r[2] for r in rows if r[2] is not None)
    sketch = df.agg(count_min(F.col("user"), 0.005, 0.99).alias("s")).first().s
    keys = [*list(counts)[:300], 10**9, -5]
    got = probed(bytes(sketch), keys)
    assert all(n >= counts[k] for k, n in zip(keys, got))
    assert sum(n <= counts[k] + 0.005 * sum(counts.values()) for k, n in zip(keys, got)) >= 0.98 * len(keys)


@pytest.mark.parametrize("share", [0.5, 0.02, 0.001])
def test_heavy_hitters_are_exact(visits, share):
    df, rows = visits
    counts = Counter(r[2] for r in rows)
    got = {r.user: r.n for r in heavy_hitters(df, "user", share).collect()}
    assert got == {k: n for k, n in counts.items() if n >= share * len(rows)}


def sessions_of(rows, gap, longest):
    out = []
    for user in {r[0] for r in rows}:
        held = None
        for at in sorted(r[1] for r in rows if r[0] == user):
            if held and at - held[1] < gap and (longest is None or at - held[0] < longest):
                held = [held[0], at, held[2] + 1]
            else:
                out += [(user, *held)] if held else []
                held = [at, at, 1]
        out += [(user, *held)] if held else []
    return out


@pytest.mark.parametrize("longest", [None, 90])
def test_timers_close_sessions(spark, longest):
    """In batches of an hour, with sessions across them and a longest length."""
    rng = random.Random(6)
    rows = [(rng.choice("abc"), rng.randrange(60 * 60 * 5)) for _ in range(150)]
    df = spark.createDataFrame([(u, START + timedelta(seconds=s)) for u, s in rows], "user string, ts timestamp_ntz")
    gap = 600
    got = replay(df, "ts", 3600, lambda stream: timed_sessions(timed(stream(), "ts", "0 seconds"), "user", "ts", gap, longest and longest * 60), "timers", ROCKSDB)
    end = max(s for _, s in rows)
    want = sorted((u, START + timedelta(seconds=a), START + timedelta(seconds=b), n) for u, a, b, n in sessions_of(rows, gap, longest and longest * 60) if b + gap <= end)
    assert sorted((r.user, r["first"].replace(tzinfo=None), r["last"].replace(tzinfo=None), r.n) for r in got.rows.collect()) == want
    assert got.batches >= 5


def test_state_and_timers_are_by_bucket(spark):
    """600 keys of four sessions each: a batch does not call for each of them."""
    df = spark.range(2400).select((F.col("id") % 600).alias("user"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id"))).alias("ts"))
    df = df.withColumn("user", F.when(F.col("user") > 0, F.col("user")))
    got = replay(df, "ts", 86_400, lambda stream: timed_sessions(timed(stream(), "ts", "0 seconds"), "user", "ts", 300, buckets=8), "timers", ROCKSDB)
    rows = got.rows.collect()
    assert len(rows) == 2395 and len({(r.user, r["first"]) for r in rows}) == 2395 and all(r.n == 1 for r in rows)
    assert sum(r.user is None for r in rows) == 4 and got.most_state <= 8 * 3
