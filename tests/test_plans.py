"""Physical plans: what reaches the scans, and what must not appear."""

from __future__ import annotations

import re

import pytest

from fernweft.operators.asof import asof_join
from fernweft.plans import registry

QUERIES = registry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["s1_parquet_scan"](spark, sf_dir))
    assert "GreaterThanOrEqual(l_quantity,49.0)" in text and "EqualTo(l_returnflag,R)" in text
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>", text)


def test_star_join_prunes_and_pushes(spark, sf_dir):
    text = plan(QUERIES["j1_star_join"](spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "l_comment" not in text and "c_name" not in text
    assert "Cartesian" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["j4_interval_join", "j5_asof_join", "j10_salted_join", "j2_semi_join", "j3_anti_join", "j7_lateral", "u_intersect_all"])
def test_no_pairing_of_all_rows(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Cartesian" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", [n for n in QUERIES if n[0] in "fjopuw" and n != "op"])
def test_relational_queries_stay_in_the_jvm(spark, sf_dir, name):
    assert not re.search(r"Python|Pandas|Arrow", plan(QUERIES[name](spark, sf_dir)))


def exchanges(text):
    return re.findall(r"^\(\d+\) Exchange\b.*?Arguments: ([^\n]*)", text, re.M | re.S)


def test_as_of_join_is_one_shuffle(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert len(exchanges(plan(asof_join(events, events, ["user_id"], "ts", ["value"])))) == 1


def test_as_of_join_deals_a_group_out_over_slots(spark, sf_dir):
    """Slots are summed and carried over; rows are dealt out once, by slot."""
    dealt = exchanges(plan(QUERIES["j5_asof_join"](spark, sf_dir)))
    assert len(dealt) == 3 and sum("__slot" in d for d in dealt) == 2


def test_places_in_a_whole_order_are_counted_in_buckets(spark, sf_dir):
    """Only the table of buckets, summed before, is in one task."""
    dealt = exchanges(plan(QUERIES["o1_sort_nulls"](spark, sf_dir)))
    assert sum("SinglePartition" in d for d in dealt) == 1 and sum("bucket" in d for d in dealt) >= 2


def test_top_per_group_and_top_k_cut_early(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["w6_top_per_group"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan(QUERIES["o2_top_k"](spark, sf_dir))


def test_partitioned_folders_are_pruned(spark, sf_dir):
    assert re.search(r"PartitionFilters: \[[^\]]*o_orderstatus", plan(QUERIES["s5_partitioned_write"](spark, sf_dir)))
