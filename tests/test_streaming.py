"""Streams over several batches, with late and repeated rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fernweft.plans.streams import CATALOG
from fernweft.streaming.replay import replay
from fernweft.streaming.runs import ROCKSDB, run_append, run_complete
from fernweft.streaming.windows import first_seen, running_counts, sessions, timed, tumbling

START = datetime(2024, 1, 1)
SCHEMA = "id bigint, user string, ts timestamp_ntz"


@pytest.fixture
def stream(spark, tmp_path):
    """Makes a stream of batches, in the order given."""

    def make(*batches):
        for n, rows in enumerate(batches):
            data = [(i, u, START + timedelta(minutes=m)) for i, u, m in rows]
            spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n:03}")
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    return make


def test_rows_behind_the_watermark_are_dropped(stream):
    batches = [(1, "a", 5), (2, "a", 15)], [(3, "a", 200)], [(4, "a", 201)], [(5, "a", 6)], [(6, "a", 400)], [(7, "a", 401)]
    counted = tumbling(timed(stream(*batches), "ts", "10 minutes"), "ts", "1 hour", [], n=F.count(F.lit(1)))
    got = {r.window_start: r.n for r in run_append(counted).collect()}
    assert got[START] == 2, "row 5 came after its window had closed"
    assert got[START + timedelta(hours=3)] == 2


def test_complete_mode_keeps_open_windows(stream):
    counted = tumbling(timed(stream([(1, "a", 5)], [(2, "b", 70)]), "ts"), "ts", "1 hour", [], n=F.count(F.lit(1)))
    assert sorted(r.n for r in run_complete(counted).collect()) == [1, 1]


def test_repeats_are_dropped_across_batches(stream):
    got = first_seen(stream([(1, "a", 1), (2, "a", 2)], [(1, "a", 1)], [(3, "b", 3)]), "ts", ["id"], "1 hour")
    assert sorted(r.id for r in run_append(got.select("id")).collect()) == [1, 2, 3]


def test_state_carries_over_batches(stream):
    counts = run_append(running_counts(stream([(1, "a", 1), (2, "b", 2)], [(3, "a", 3)], [(4, "a", 4)]).select("user"), "user"), provider=ROCKSDB)
    assert sorted((r.user, r.n) for r in counts.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_sessions_join_rows_within_the_gap(stream):
    batches = [(1, "a", 0), (2, "a", 20), (3, "a", 100)], [(4, "a", 1000)], [(5, "a", 1001)]
    got = run_append(sessions(timed(stream(*batches), "ts", "10 minutes"), "ts", "30 minutes", ["user"], n=F.count(F.lit(1)))).collect()
    assert sorted((r.window_start, r.n) for r in got) == [(START, 2), (START + timedelta(minutes=100), 1)]


def in_files(events, folder, parts):
    """The table as files whose order of time is not that of their writing."""
    cut = events.withColumn("part", F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000), F.lit(parts)))
    for k in range(parts - 1, -1, -2):
        cut.where(F.col("part").isin(k, k - 1)).drop("part").repartition(2 if parts > 1 else 1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("name,parts", [(f"{n}", p) for n in ("t3_sessions_stream", "t4_watermark_stream", "t5_dedup_stream", "t7_stream_stream_join") for p in (4, 40)][::2] + [("t3_sessions_stream", 40)])
def test_files_out_of_time_order_lose_no_rows(spark, sf_dir, duck, tmp_path, name, parts):
    in_files(spark.read.parquet(f"{sf_dir}/events.parquet"), f"{tmp_path}/events.parquet", parts)
    got = CATALOG.queries[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(CATALOG.sql[name]).fetchall())


def test_a_replay_keeps_state_of_a_window(spark):
    """A row each minute for ten days: state is of a slice, not of the table."""
    rows = spark.range(14_400).select("id", (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id"))).alias("ts"))
    rows = rows.orderBy(F.xxhash64("id")).union(rows.limit(1).select("id", F.lit(None).cast("timestamp_ntz")))
    seen = replay(rows, "ts", 86_400, lambda stream: first_seen(stream(), "ts", ["id"], "1 hour").select("id"), "seen")
    assert seen.batches == 10 and seen.rows.count() == 14_400
    assert seen.most_state <= 1440 + 121
    empty = replay(rows.limit(0), "ts", 86_400, lambda stream: first_seen(stream(), "ts", ["id"], "1 hour"), "none")
    assert empty.batches == 0 and empty.rows.count() == 0
