"""Places, theta joins and percentiles against lists."""

from __future__ import annotations

import operator
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweft.materialize import written
from fernweft.operators.order import places
from fernweft.operators.percentiles import exact_percentiles
from fernweft.operators.theta import later_of_later, theta_count, theta_join
from tests.test_plans import plan

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def test_places_are_gapless_and_in_order(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 1, 1, 1, 1, 5, rng.random() * 9]) for _ in range(500)]
    got = places(spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(5), [F.desc_nulls_last("v")]).collect()
    got.sort(key=lambda r: r.place)
    assert [r.place for r in got] == list(range(500))
    assert [r.v for r in got] == sorted(values, key=lambda v: (v is None, -(v or 0)))
    assert places(spark.createDataFrame([], "v double"), [F.asc("v")]).count() == 0


def test_places_where_all_rows_tie(spark):
    same = spark.range(20_000).select(F.lit(7).alias("v"))
    spread = places(same, [F.asc("v")]).groupBy(F.floor(F.col("place") / 100)).count()
    assert spread.count() == 200


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 301])
def test_later_of_later(n):
    rng = np.random.default_rng(n)
    px, py, side = rng.permutation(n), rng.permutation(n), rng.integers(0, 2, n)
    want = [0 if side[i] else int(((px > px[i]) & (py > py[i]) & (side == 1)).sum()) for i in range(n)]
    assert later_of_later(px, py, side).tolist() == want


def sides(seed):
    rng = random.Random(seed)
    some = lambda: rng.choice([None, *range(9)])
    left = [(i, some(), some()) for i in range(60)] + [(7, 3, 3)] * 4
    right = [(some(), some(), i) for i in range(70)] + [(3, 3, 99)] * 5
    return left, right


@pytest.mark.parametrize("ops,rows", [(("<", ">"), 3), (("<=", ">="), 3), ((">", "<="), 3), ((">=", "<"), 3), (("<", "<"), 1000)])
def test_theta_joins_agree_with_all_pairs(spark, ops, rows):
    left, right = sides(rows)
    a = spark.createDataFrame(left, "id int, a int, n int").repartition(3)
    b = spark.createDataFrame(right, "c int, d int, tag int").repartition(2)
    on = [("a", ops[0], "c"), ("n", ops[1], "d")]

    def meets(x, y):
        return None not in (x[1], x[2], y[0], y[1]) and OPS[ops[0]](x[1], y[0]) and OPS[ops[1]](x[2], y[1])

    key = lambda rows: sorted(rows, key=repr)
    counts = theta_count(a, b, on, "found", rows)
    assert key(tuple(r) for r in counts.collect()) == key((*x, sum(meets(x, y) for y in right)) for x in left)
    pairs = theta_join(a, b, on, rows)
    assert pairs.columns == ["id", "a", "n", "right_c", "right_d", "right_tag"]
    assert key(tuple(r) for r in pairs.collect()) == key(x + y for x in left for y in right if meets(x, y))
    for df in (counts, pairs):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_theta_joins_of_empty_sides(spark):
    a, none = spark.createDataFrame([(1, 2)], "a int, n int"), spark.createDataFrame([], "c int, d int")
    on = [("a", "<", "c"), ("n", "<", "d")]
    assert [tuple(r) for r in theta_count(a, none, on, "found").collect()] == [(1, 2, 0)]
    assert theta_count(a.limit(0), none, on, "found").count() == 0 and theta_join(a, none, on).count() == 0
    with pytest.raises(ValueError, match="two inequalities"):
        theta_join(a, none, [("a", "=", "c"), ("n", "<", "d")])


@pytest.mark.parametrize("most,bins", [(1, 2), (5, 16), (10_000, 1024)])
def test_percentiles_agree_with_the_aggregate(spark, most, bins):
    rng = random.Random(most)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 1.5, rng.gauss(0, 1), rng.gauss(0, 1) * 1e6, 1e-9 * rng.random()])) for _ in range(400)]
    rows += [("one", 4.0), ("none", None), ("big", 1.7e308), ("big", -1.7e308), ("big", 0.0), ("same", 2.0), ("same", 2.0), ("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): r.v for r in exact_percentiles(df, ["g"], "v", shares, "v", most, bins).collect()}
    want = {}
    for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("v")).where("g <> 'none' or g is null").collect():
        want |= {(r.g, s): v for s, v in zip(shares, r.v)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want if k[0] != "inf" or k[1] <= 0.5)


def test_percentiles_of_many_values_and_of_none(spark):
    many = spark.range(300_000).select(F.lit(1).alias("g"), (F.xxhash64("id") / 1e9).alias("v"))
    (got,) = exact_percentiles(many, ["g"], "v", [0.5], "v", most=1000).collect()
    assert got.v == pytest.approx(many.agg(F.median("v").alias("m")).first().m, rel=1e-12)
    assert exact_percentiles(many.limit(0), ["g"], "v", [0.5]).count() == 0
    whole = exact_percentiles(many, [], "v", [0.0, 1.0], most=1000).collect()
    assert sorted(r.value for r in whole) == list(many.agg(F.min("v"), F.max("v")).first())


def test_pairs_are_not_written(spark):
    """Each row meets each other: 4 million pairs of 4,000 rows."""
    a = spark.range(2_000).select(F.col("id").alias("a"), F.lit(1).alias("n"))
    b = spark.range(2_000).select((F.col("id") + 5_000).alias("c"), F.lit(2).alias("d"))
    earlier = set(written(spark))
    pairs = theta_join(a, b, [("a", "<", "c"), ("n", "<=", "d")], 300)
    new = [p for p in written(spark) if p not in earlier]
    assert sum(spark.read.parquet(p).count() for p in new) <= 20_000
    assert pairs.count() == 4_000_000
    assert theta_join(a, b, [("a", "<", "c"), ("n", "<=", "d")], 10, 1).count() == 4_000_000
    assert theta_join(a, b, [("a", ">", "c"), ("n", "<=", "d")], 300).count() == 0


def test_a_file_of_pairs_stays_small(spark, tmp_path):
    """Nine million pairs of rows that are not alike, in a fraction of a byte each."""
    a = spark.range(4_000).selectExpr("xxhash64(id) as id", "pmod(xxhash64(id, 1), 100000) as x", "pmod(xxhash64(id, 2), 100000) as y")
    b = spark.range(4_000).selectExpr("xxhash64(id, 3) as tag", "pmod(xxhash64(id, 4), 200000) as u", "pmod(xxhash64(id, 5), 150000) - 60000 as v", "id % 7 as n")
    pairs = theta_join(a, b, [("x", "<", "u"), ("y", ">=", "v")]).select("id", "right_tag", "right_n", "right_u")
    pairs.write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n == a.join(b, (F.col("x") < F.col("u")) & (F.col("y") >= F.col("v"))).count() > 8_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.8 * n
