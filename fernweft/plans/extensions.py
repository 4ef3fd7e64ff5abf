"""File formats, sketches, user functions and vector search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweft.functions.ivf import Lists, VectorIndex
from fernweft.functions.vectors import dot, top_neighbours
from fernweft.materialize import new_path
from fernweft.operators.sketches import heavy_hitters, merged, sketch_table
from fernweft.plans.catalog import Catalog
from fernweft.sources.checked import read_checked
from fernweft.sources.files import round_trip
from fernweft.sources.upsert import UpsertTable, run_upserts
from fernweft.streaming.runs import stream_table
from fernweft.tables import read_table

CATALOG = Catalog()


def formats() -> None:
    for fmt in ("csv", "json", "orc", "xml"):

        @CATALOG.add(f"s3_{fmt}_files", "select c_custkey, c_name, c_nationkey, c_acctbal from customer")
        def query(spark: SparkSession, sf_dir: str, fmt: str = fmt) -> DataFrame:
            return round_trip(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), fmt)


formats()


@CATALOG.add("s3_text_files", "select c_name as value from customer")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), "text")


@CATALOG.add("s5_partitioned_write", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter prunes whole folders of what was written."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return round_trip(orders, "parquet", ["o_orderstatus"]).where("o_orderstatus = 'F'")


@CATALOG.add(
    "s5_upserts",
    "select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id",
)
def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, kept by a stream that merges its batches."""
    events = stream_table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return run_upserts(events, UpsertTable(spark, events.schema, ["user_id"], ["ts", "event_id"])).read()


@CATALOG.add(
    "s3_broken_rows",
    """select case when c_custkey % 10 > 0 then c_custkey end as c_custkey, case when c_custkey % 10 > 0 then c_name end as c_name,
              case when c_custkey % 10 = 0 then 'x' || c_custkey || ',' || c_name end as raw from customer""",
)
def broken_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of CSV, each tenth with a key that is no number."""
    path, key = new_path(spark, "broken"), F.col("c_custkey").cast("string")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    lines = customers.select(F.concat_ws(",", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("x"), key)).otherwise(key), "c_name"))
    lines.write.text(path)
    got = read_checked(spark, path, "csv", customers.schema, header="false")
    return got.good.unionByName(got.bad.select("raw"), allowMissingColumns=True)


@CATALOG.add("a8_approx_distinct")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An estimate; tests hold it to its error bound."""
    return read_table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


@CATALOG.add("a13_merged_sketches")
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of events kept as sketches, and half a month of them merged."""
    events = read_table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "user_id", "value")
    days = sketch_table(events, ["day", "event_type"], "user_id", "value")
    half = merged(days.where("day between date '2024-01-08' and date '2024-01-22'"), ["event_type"], [0.25, 0.5, 0.75])
    return half.select("event_type", "n", F.col("distinct").alias("users"), "quantiles")


@CATALOG.add("a13_heavy_hitters", "select user_id, count(*) as n from events group by user_id having count(*) >= 0.005 * (select count(*) from events)")
def heavy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters(read_table(spark, sf_dir, "events").select("user_id"), "user_id", 0.005)


@CATALOG.add("a13_sketches")
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mergeable estimates; tests hold them to their error bounds."""
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 12)).alias("users"),
        F.percentile_approx("value", 0.5, 10_000).alias("middle"),
        F.length(F.count_min_sketch("user_id", F.lit(0.01), F.lit(0.95), F.lit(1))).alias("sketch_bytes"),
    )


SCALED = "select event_id, value * 2 + 1 as y from events"


@CATALOG.add("x0_pandas_udf", SCALED)
def pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def scaled(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return read_table(spark, sf_dir, "events").select("event_id", scaled("value").alias("y"))


@CATALOG.add("x0_arrow_udf", SCALED)
def arrow_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("double")
    def scaled(x: pa.Array) -> pa.Array:
        return pc.add(pc.multiply(x, 2.0), 1.0)

    return read_table(spark, sf_dir, "events").select("event_id", scaled("value").alias("y"))


@CATALOG.add("x0_python_udf", "select r_regionkey, '<' || r_name || '>' as shown from region")
def python_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udf("string", useArrow=True)
    def shown(x: str) -> str:
        return f"<{x}>"

    return read_table(spark, sf_dir, "region").select("r_regionkey", shown("r_name").alias("shown"))


@CATALOG.add("x1_udtf", "select n_nationkey, unnest(range(n_regionkey)) as step from nation")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="step bigint")
    class Steps:
        def eval(self, n: int) -> Iterator[tuple[int]]:
            for i in range(n):
                yield (i,)

    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return nation.lateralJoin(Steps(F.col("n_regionkey").outer())).select("n_nationkey", "step")


@CATALOG.add("x1_map_in_arrow", "select event_id, user_id from events where value > 100")
def map_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def large(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater(batch["value"], 100.0)).select(["event_id", "user_id"])

    return read_table(spark, sf_dir, "events").select("event_id", "user_id", "value").mapInArrow(large, "event_id bigint, user_id bigint")


@CATALOG.add("x2_dot_product", "select vec_id, round(list_dot_product(embedding::double[], embedding::double[]), 6) as norm from embeddings")
def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@CATALOG.add(
    "x2_top_neighbours",
    """select q.vec_id as query_id, r.vec_id as neighbour_id, round(list_dot_product(q.embedding::double[], r.embedding::double[]), 6) as score,
       cast(row_number() over (partition by q.vec_id order by list_dot_product(q.embedding::double[], r.embedding::double[]) desc, r.vec_id) as int) as rank
       from embeddings q join embeddings r on q.vec_id % 20 = 0 and q.vec_id <> r.vec_id qualify rank <= 10""",
)
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20, against all rows."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = top_neighbours(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return found.withColumn("score", F.round("score", 6))


@CATALOG.add("x2_index_neighbours")
def index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index of inverted lists over all rows. The given vectors
    lie in no clusters, so two thirds of the lists are read for a recall of more
    than 0.9, to which a test holds it."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = VectorIndex.build(rows, "vec_id", "embedding", Lists())
    probes = -(-len(index.centroids) * 2 // 3)
    return index.search(rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, probes).withColumn("score", F.round("score", 6))


@CATALOG.add("x3_pandas_aggregate", "select event_type, round(max(value) - min(value), 6) as spread from events group by event_type")
def pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user aggregate over partial results: each task reduces its rows with
    pandas, so no group is gathered whole."""

    def partial(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.groupby("event_type", as_index=False).agg(low=("value", "min"), high=("value", "max"))

    @F.pandas_udf("double")
    def spread(low: pd.Series, high: pd.Series) -> float:
        return round(float(high.max() - low.min()), 6)

    events = read_table(spark, sf_dir, "events").select("event_type", "value")
    return events.mapInPandas(partial, "event_type string, low double, high double").groupBy("event_type").agg(spread("low", "high").alias("spread"))
