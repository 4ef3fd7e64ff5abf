"""Windows by time over tables, and the same as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernweft.materialize import new_path
from fernweft.plans.catalog import Catalog
from fernweft.streaming.replay import replay
from fernweft.streaming.runs import ROCKSDB, run_append, run_append_parts, run_complete, run_memory, stream_table
from fernweft.streaming.timers import timed_sessions
from fernweft.streaming.windows import first_seen, paired, running_counts, sessions, sliding, timed, tumbling
from fernweft.tables import read_table

CATALOG = Catalog()
#: Seconds of event time that a replayed stream takes in one batch.
SLICE = 10 * 86_400
TOTAL = "cast(sum(cast(value as decimal(18,6))) as double) as total"


def exact_total() -> Column:
    """A sum that does not depend on the order of its rows."""
    return F.sum(F.col("value").cast("decimal(18,6)")).cast("double")


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


TUMBLING = f"""select date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end, event_type,
count(*) as n, {TOTAL} from events group by 1, 2, 3"""


@CATALOG.add("t1_tumbling", TUMBLING)
def tumbling_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed(read_table(spark, sf_dir, "events"), "ts")
    return plain(tumbling(events, "ts", "1 day", ["event_type"], n=F.count(F.lit(1)), total=exact_total()))


@CATALOG.add("t1_tumbling_stream", TUMBLING)
def tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed(stream_table(spark, sf_dir, "events"), "ts", "1 hour")
    return plain(run_complete(tumbling(events, "ts", "1 day", ["event_type"], n=F.count(F.lit(1)), total=exact_total()), "tumbling"))


@CATALOG.add(
    "t2_sliding",
    """select s as window_start, s + interval 1 day as window_end, event_type, count(*) as n
       from (select *, unnest([date_trunc('hour', ts) - (hour(ts) % 12 + k * 12) * interval 1 hour for k in [0, 1]]) as s from events)
       group by all""",
)
def sliding_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed(read_table(spark, sf_dir, "events"), "ts")
    return plain(sliding(events, "ts", "1 day", "12 hours", ["event_type"], n=F.count(F.lit(1))))


SESSIONS = """with marked as (
  select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as fresh from events
), numbered as (select *, sum(fresh) over (partition by user_id order by ts) as nr from marked)
select min(ts) as window_start, max(ts) + interval 2 hour as window_end, user_id, count(*) as n from numbered group by user_id, nr"""


@CATALOG.add("t3_sessions", SESSIONS)
def sessions_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed(read_table(spark, sf_dir, "events"), "ts")
    return plain(sessions(events, "ts", "2 hours", ["user_id"], n=F.count(F.lit(1))))


@CATALOG.add("t3_sessions_stream", f"select * from ({SESSIONS}) where date_trunc('milliseconds', window_end) <= (select date_trunc('milliseconds', max(ts)) from events)")
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed; the last ones stay open."""
    events = read_table(spark, sf_dir, "events").select("ts", "user_id")
    found = replay(events, "ts", SLICE, lambda stream: sessions(timed(stream(), "ts", "0 seconds"), "ts", "2 hours", ["user_id"], n=F.count(F.lit(1))), "sessions")
    return plain(found.rows)


@CATALOG.add(
    "t4_watermark_stream",
    """select date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end, count(*) as n from events
       where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) group by 1, 2""",
)
def closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has closed, each written once."""
    events = read_table(spark, sf_dir, "events").select("ts")
    return plain(replay(events, "ts", SLICE, lambda stream: tumbling(timed(stream(), "ts", "0 seconds"), "ts", "1 day", [], n=F.count(F.lit(1))), "days").rows)


@CATALOG.add("t5_dedup_stream", "select event_id, user_id from events")
def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    return replay(events, "ts", SLICE, lambda stream: first_seen(stream(), "ts", ["event_id"], "1 hour").select("event_id", "user_id"), "first-seen").rows


@CATALOG.add("t6_stream_static_join", "select event_id, c_name, c_mktsegment from events join customer on user_id = c_custkey where event_type = 'error'")
def stream_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = stream_table(spark, sf_dir, "events").where("event_type = 'error'")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return run_append(errors.join(customers, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", "c_mktsegment"), "errors")


@CATALOG.add(
    "t7_stream_stream_join",
    """select a.event_id, b.event_id as right_event_id from events a join events b on a.user_id = b.user_id
       and b.ts > a.ts and b.ts <= a.ts + interval 6 hour where a.event_type = 'view' and b.event_type = 'purchase'""",
)
def stream_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')").select("event_id", "user_id", "ts", "event_type")

    def build(stream: Callable[[], DataFrame]) -> DataFrame:
        views, buys = (stream().where(F.col("event_type") == kind).drop("event_type") for kind in ("view", "purchase"))
        return paired(views, buys, "user_id", "ts", 6 * 3600, "0 seconds").select("event_id", "right_event_id")

    return replay(events, "ts", SLICE, build, "pairs").rows


@CATALOG.add("t8_arbitrary_state", "select user_id, count(*) as n from events group by user_id")
def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = run_append(running_counts(stream_table(spark, sf_dir, "events").select("user_id"), "user_id"), "counts", ROCKSDB)
    return counts.groupBy("user_id").agg(F.max("n").alias("n"))


@CATALOG.add(
    "t8_timer_sessions",
    f"""select user_id, window_start as first, window_end - interval 2 hour as last, n from ({SESSIONS})
        where date_trunc('milliseconds', window_end) <= (select date_trunc('milliseconds', max(ts)) from events)""",
)
def timer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in state of our own, each closed by a timer."""
    events = read_table(spark, sf_dir, "events").select("ts", "user_id")
    found = replay(events, "ts", SLICE, lambda stream: timed_sessions(timed(stream(), "ts", "0 seconds"), "user_id", "ts", 2 * 3600), "timers", ROCKSDB)
    return plain(found.rows)


@CATALOG.add("s4_memory_sink", "select event_type, count(*) as n from events group by event_type")
def memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each type of event fits the driver."""
    counted = stream_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return run_memory(counted, "complete", "types")


@CATALOG.add(
    "t9_late_rows",
    """select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end, count(*) as n from events
       where event_id % 50 <> 0 and date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events where event_id % 50 <> 0) - interval 1 hour
       group by 1, 2""",
)
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream in which each fiftieth event comes last, when
    the watermark has closed its hour: it is dropped, the others are counted.
    The stream is run to its end, which closes the hours, and taken up again for
    the late rows; both parts arrive as any number of files."""
    events, source = read_table(spark, sf_dir, "events"), new_path(spark, "late")
    timely = events.where("event_id % 50 <> 0")
    cutoff = timely.agg((F.max("ts") - F.expr("interval 3 hours")).alias("t"))
    late = events.where("event_id % 50 = 0").join(F.broadcast(cutoff), F.col("ts") < F.col("t")).drop("t")
    events.limit(0).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    counted = tumbling(timed(stream, "ts", "1 hour"), "ts", "1 hour", [], n=F.count(F.lit(1)))
    return plain(run_append_parts(counted, [timely, late], source, "late-hours"))
