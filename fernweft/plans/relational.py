"""Scans, projections, filters, joins, aggregates, windows, sets and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fernweft.operators.asof import asof_join, interval_join
from fernweft.operators.closure import reached_nodes
from fernweft.operators.frames import row_frame, time_frame
from fernweft.operators.percentiles import exact_percentiles
from fernweft.operators.prefix import running_total
from fernweft.operators.skew import salted_distinct_count, salted_join
from fernweft.operators.theta import theta_count, theta_join
from fernweft.operators.topk import top_per_group
from fernweft.plans.catalog import Catalog
from fernweft.tables import read_table

CATALOG = Catalog()
MONEY = "cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(12,2)))"

CATALOG.add_sql(
    "s1_parquet_scan",
    "lineitem",
    "select l_orderkey, l_linenumber, l_quantity from {lineitem} where l_quantity >= 49 and l_returnflag = 'R'",
)
CATALOG.add_sql(
    "p1_projection",
    "part",
    "select p_partkey, p_retailprice * 2 as doubled, concat(p_brand, '/', p_type) as label, p_size % 7 as rest from {part}",
)
CATALOG.add_sql(
    "p2_time_range",
    "orders",
    "select o_orderkey, o_orderdate from {orders} where o_orderdate >= date '1996-01-01' and o_orderdate < date '1996-04-01'",
)
CATALOG.add_sql(
    "p3_predicates",
    "part",
    """select p_partkey,
              case when p_size between 1 and 10 then 'small' when p_size in (11, 12, 13) then 'odd' else 'large' end as kind,
              nullif(p_brand, 'Brand#1') is null as is_first
       from {part} where p_name like '%ring%' and p_brand is not null and not (p_size = 50)""",
)
CATALOG.add_sql(
    "p3_regex_filter",
    "documents",
    "select doc_id, lang from {documents} where rlike(source, '^src1[0-9]$')",
    "select doc_id, lang from documents where regexp_matches(source, '^src1[0-9]$')",
)
CATALOG.add_sql(
    "p4_safe_cast",
    "documents",
    "select doc_id, try_cast(source as int) as bad, try_cast(substring(source, 4) as int) as good from {documents}",
)

REGIONS = """select r_name, cast(sum({money}) as double) as revenue, count(*) as n_lines
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{customer}} on o_custkey = c_custkey
join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
where o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01' group by r_name""".format(money=MONEY)
CATALOG.add_sql("j1_star_join", "lineitem orders customer nation region", REGIONS)
CATALOG.add_sql(
    "j2_semi_join",
    "customer orders",
    "select c_custkey, c_name from {customer} where exists (select 1 from {orders} where o_custkey = c_custkey and o_totalprice > 100000)",
)
CATALOG.add_sql(
    "j3_anti_join",
    "customer orders",
    "select c_custkey from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey and o_totalprice > 100000)",
)
for kind in ("left", "right", "full"):
    CATALOG.add_sql(
        f"j3_{kind}_join",
        "supplier nation",
        f"select s_suppkey, n_name from (select * from {{supplier}} where s_acctbal > 0) s {kind} join (select * from {{nation}} where n_regionkey < 3) n on s_nationkey = n_nationkey",
    )
CATALOG.add_sql("j3_cross_join", "region nation", "select r_name, n_name from {region} cross join {nation}")


@CATALOG.add(
    "j4_interval_join",
    """select a.event_id, b.event_id as right_event_id from events a join events b on a.user_id = b.user_id
       and b.ts > a.ts and b.ts <= a.ts + interval 6 hour where a.event_type = 'view' and b.event_type = 'purchase'""",
)
def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views, buys = events.where("event_type = 'view'"), events.where("event_type = 'purchase'")
    return interval_join(views, buys, ["user_id"], "ts", "ts", 6 * 3600).select("event_id", "right_event_id")


@CATALOG.add(
    "j5_asof_join",
    """select a.event_id, b.event_id as right_event_id, b.value as right_value
       from (select * from events where event_type = 'purchase') a
       asof left join (select * from events where event_type = 'click') b on a.user_id = b.user_id and a.ts >= b.ts""",
)
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    buys, clicks = events.where("event_type = 'purchase'"), events.where("event_type = 'click'")
    found = asof_join(buys, clicks, ["user_id"], "ts", ["event_id", "value"], slot=F.to_date("ts"))
    return found.select("event_id", "right_event_id", "right_value")


CATALOG.add_sql(
    "j6_asof_self",
    "events",
    "select event_id, lag(value) over (partition by user_id order by ts) as before from {events}",
)
CATALOG.add_sql(
    "j7_lateral",
    "customer orders",
    """select c_custkey, t.n, t.top from {customer}, lateral
       (select count(*) as n, max(o_totalprice) as top from {orders} where o_custkey = c_custkey) t""",
)
for hint in ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl"):
    JOINED = "select {hint} n_name, count(*) as n from {{supplier}} s join {{nation}} n on s_nationkey = n_nationkey group by n_name"
    CATALOG.add_sql(f"j8_{hint}_hint", "supplier nation", JOINED.format(hint=f"/*+ {hint}(n) */"), JOINED.format(hint="").format(supplier="supplier", nation="nation"))
CATALOG.add_sql(
    "j9_theta_join",
    "region nation",
    "select r_name, n_name from {region} join {nation} on n_regionkey < r_regionkey and n_nationkey > r_regionkey * 3",
)


@CATALOG.add(
    "j9_theta_counts",
    """select o_orderkey, coalesce(n, 0) as n from orders left join (
         select o_orderkey, count(*) as n from orders join lineitem on l_extendedprice > o_totalprice and l_shipdate < o_orderdate group by o_orderkey
       ) using (o_orderkey)""",
)
def dominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, the line items that are dearer and were shipped before."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    lines = read_table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_shipdate")
    return theta_count(orders, lines, [("o_totalprice", "<", "l_extendedprice"), ("o_orderdate", ">", "l_shipdate")]).select("o_orderkey", "n")


@CATALOG.add(
    "j9_theta_pairs",
    """select o_orderkey, l_orderkey, l_linenumber, l_extendedprice from orders
       join lineitem on l_extendedprice > o_totalprice + 90000 and l_shipdate <= o_orderdate - interval 1500 day""",
)
def dominating(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_totalprice + 90000").alias("price"), F.expr("o_orderdate - interval 1500 days").alias("date"))
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    found = theta_join(orders, lines, [("price", "<", "l_extendedprice"), ("date", ">=", "l_shipdate")])
    return found.select("o_orderkey", *[F.col(f"right_{c}").alias(c) for c in lines.columns[:3]])


@CATALOG.add("j10_salted_join", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def hot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return salted_join(orders, read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


CATALOG.add_sql(
    "a1_aggregates",
    "lineitem",
    f"""select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as decimal(12,2))) as double) as quantity,
               cast(sum({MONEY}) as double) as revenue, min(l_shipdate) as first_ship, max(l_discount) as top_discount,
               cast(sum(cast(l_tax as decimal(12,4))) as double) / count(*) as mean_tax
        from {{lineitem}} where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus""",
)
CATALOG.add_sql("a2_distinct", "lineitem", "select distinct l_returnflag, l_linestatus from {lineitem}")


@CATALOG.add("a2_count_distinct", "select o_orderpriority, count(distinct o_custkey) as customers from orders group by o_orderpriority")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted_distinct_count(read_table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_custkey", "customers")


GROUPED = """select o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus) as int) as g1, cast(grouping(o_orderpriority) as int) as g2,
count(*) as n from {orders} group by """
CATALOG.add_sql("a3_grouping_sets", "orders", GROUPED + "grouping sets ((o_orderstatus), (o_orderpriority), ())")
CATALOG.add_sql("a3_cube", "orders", GROUPED + "cube (o_orderstatus, o_orderpriority)")
CATALOG.add_sql("a4_rollup", "orders", GROUPED + "rollup (o_orderstatus, o_orderpriority)")
CATALOG.add_sql(
    "a5_deviation",
    "lineitem",
    "select l_returnflag, round(stddev_samp(l_quantity), 6) as dev, round(var_pop(l_quantity), 6) as var from {lineitem} group by l_returnflag",
)
CATALOG.add_sql("a6_correlation", "lineitem", "select round(corr(l_quantity, l_extendedprice), 9) as r, round(covar_samp(l_quantity, l_tax), 9) as c from {lineitem}")
CATALOG.add_sql(
    "a7_percentile",
    "lineitem",
    "select l_returnflag, percentile(l_quantity, 0.25) as q1, median(l_quantity) as mid from {lineitem} group by l_returnflag",
    "select l_returnflag, quantile_cont(l_quantity, 0.25) as q1, median(l_quantity) as mid from lineitem group by l_returnflag",
)


@CATALOG.add(
    "a7_selected_percentile",
    """select l_returnflag, unnest([0.01, 0.25, 0.5, 0.999]) as share, round(unnest(quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.999])), 6) as price
       from lineitem group by l_returnflag""",
)
def selected_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of nearly as many values as rows, without a buffer of them."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return exact_percentiles(lines, ["l_returnflag"], "l_extendedprice", [0.01, 0.25, 0.5, 0.999], "price").withColumn("price", F.round("price", 6))


CATALOG.add_sql(
    "a9_max_by",
    "orders",
    "select o_orderpriority, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) as top, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) as low from {orders} group by o_orderpriority",
    "select o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as low from orders group by o_orderpriority",
)
CATALOG.add_sql(
    "a10_listagg",
    "nation region",
    "select r_name, listagg(n_name, ',') within group (order by n_name) as nations from {nation} join {region} on n_regionkey = r_regionkey group by r_name",
    "select r_name, string_agg(n_name, ',' order by n_name) as nations from nation join region on n_regionkey = r_regionkey group by r_name",
)


@CATALOG.add(
    "a11_pivot",
    """select o_orderpriority, count(*) filter (o_orderstatus = 'F') as F, count(*) filter (o_orderstatus = 'O') as O,
       count(*) filter (o_orderstatus = 'P') as P from orders group by o_orderpriority""",
)
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = read_table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


CATALOG.add_sql(
    "a12_more_aggregates",
    "lineitem",
    """select l_returnflag, bool_and(l_quantity > 0) as every, bool_or(l_quantity > 49) as some, bit_and(l_linenumber) as bits,
              bit_or(l_linenumber) as any_bits, array_join(array_sort(collect_set(l_linenumber)), ',') as numbers, round(skewness(l_quantity), 6) as skew,
              round(regr_slope(l_extendedprice, l_quantity), 6) as slope
       from {lineitem} group by l_returnflag""",
    """select l_returnflag, bool_and(l_quantity > 0) as every, bool_or(l_quantity > 49) as some, bit_and(l_linenumber) as bits,
              bit_or(l_linenumber) as any_bits, array_to_string(list_sort(list(distinct l_linenumber)), ',') as numbers,
              round((avg(l_quantity ** 3) - 3 * avg(l_quantity) * avg(l_quantity ** 2) + 2 * avg(l_quantity) ** 3) / var_pop(l_quantity) ** 1.5, 6) as skew,
              round(regr_slope(l_extendedprice, l_quantity), 6) as slope
       from lineitem group by l_returnflag""",
)
CATALOG.add_sql(
    "a12_collect_list",
    "nation",
    "select n_regionkey, array_join(array_sort(collect_list(n_name)), ',') as names, size(collect_list(n_nationkey)) as n from {nation} group by n_regionkey",
    "select n_regionkey, array_to_string(list_sort(list(n_name)), ',') as names, cast(len(list(n_nationkey)) as int) as n from nation group by n_regionkey",
)
CATALOG.add_sql(
    "a12_mode_any_kurtosis",
    "lineitem",
    """select l_returnflag, mode() within group (order by l_linestatus) as common, any_value(l_returnflag) as one,
              round(kurtosis(l_quantity), 6) as kurt, count_if(l_quantity > 40) as many from {lineitem} group by l_returnflag""",
    """with moments as (select l_returnflag, avg(l_quantity) as m from lineitem group by 1), counts as (
         select l_returnflag, l_linestatus, row_number() over (partition by l_returnflag order by count(*) desc, l_linestatus) as nr from lineitem group by 1, 2)
       select l.l_returnflag, any_value(c.l_linestatus) as common, any_value(l.l_returnflag) as one,
              round(avg((l_quantity - m) ** 4) / avg((l_quantity - m) ** 2) ** 2 - 3, 6) as kurt, count(*) filter (l_quantity > 40) as many
       from lineitem l join moments using (l_returnflag) join counts c on c.l_returnflag = l.l_returnflag and nr = 1 group by l.l_returnflag""",
)
CATALOG.add_sql(
    "a12_filter_having",
    "orders",
    """select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F') as done from {orders}
       group by o_custkey having count(*) >= 12""",
)

RANKED = """select l_orderkey, l_partkey, l_linenumber, {calls} from {{lineitem}} window w as
(partition by l_suppkey order by l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice)"""
CALLS = "cast(row_number() over w as int) as nr, cast(rank() over w as int) as rk, cast(ntile(4) over w as int) as quarter, round(cume_dist() over w, 9) as cd"
CATALOG.add_sql("w1_ranks", "lineitem", RANKED.format(calls=CALLS))
CATALOG.add_sql(
    "w2_offsets",
    "orders",
    """select o_orderkey, cast(dense_rank() over (partition by o_custkey order by o_orderdate) as int) as dr,
              round(percent_rank() over (partition by o_custkey order by o_orderdate), 9) as pr,
              lead(o_totalprice, 2) over w as ahead, first_value(o_totalprice) over w as first, nth_value(o_totalprice, 2) over w as second
       from {orders} window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
)
CATALOG.add_sql(
    "w4_time_frame",
    "events",
    "select event_id, max(value) over (partition by user_id order by ts range between interval 1 day preceding and current row) as top from {events}",
)
CATALOG.add_sql(
    "w5_row_frame",
    "events",
    "select event_id, min(value) over (partition by user_id order by ts rows between 2 preceding and 1 following) as low from {events}",
)


@CATALOG.add("w4_slotted_frame", CATALOG.sql["w4_time_frame"])
def slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by time where a user may have most of the rows."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return time_frame(events, ["user_id"], "ts", 86_400, top=F.max("value")).select("event_id", "top")


@CATALOG.add("w5_slotted_frame", CATALOG.sql["w5_row_frame"])
def slotted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return row_frame(events, ["user_id"], [F.col("ts"), F.col("event_id")], 2, 1, low=F.min("value")).select("event_id", "low")


@CATALOG.add(
    "w6_top_per_group",
    "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2",
)
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).drop("rank")


@CATALOG.add(
    "o1_sort_nulls",
    """select p_partkey, row_number() over (order by small nulls last, p_partkey) as place
       from (select p_partkey, nullif(p_size % 5, 0) as small from part)""",
)
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an order of the whole table, counted in buckets along it."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", F.expr("nullif(p_size % 5, 0)").alias("small"))
    # Keys fit 48 bits; nulls come last, as 5 is beyond all remainders.
    bucket = F.shiftleft(F.coalesce("small", F.lit(5)).cast("long"), 48) + F.shiftright("p_partkey", 12)
    return running_total(parts.withColumn("bucket", bucket), F.lit(1), "place", within=[], bucket="bucket", order=[F.col("p_partkey")]).select("p_partkey", "place")


CATALOG.add_sql("o2_top_k", "orders", "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 20")
CATALOG.add_sql("o2_offset", "orders", "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 20 offset 10")
for op in ("intersect", "except", "intersect all", "except all", "union", "union all"):
    CATALOG.add_sql(
        f"u_{op.replace(' ', '_')}",
        "events orders",
        # Users with few events, and customers beyond them, are on one side only.
        f"select user_id % 97 as k from {{events}} where user_id < 60 {op} select o_custkey % 89 + 7 as k from {{orders}} where o_custkey % 3 > 0",
    )
CATALOG.add_sql(
    "u3_recursive",
    "region",
    "with recursive r(n, total) as (select r_regionkey, r_regionkey from {region} union all select n + 1, total + n from r where n < 40) select n, cast(total as bigint) as total from r",
)


@CATALOG.add(
    "u3_reachable",
    """with recursive edges as (
         select distinct user_id as a, lead(user_id) over (partition by event_type, date_trunc('day', ts) order by ts, event_id) as b from events where event_type = 'error'
       ), reached(start, node) as (
         select a, b from edges where a % 20 = 0 and b is not null union select start, b from reached join edges on node = a where b is not null
       ) select start, node from reached""",
)
def reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that an error can be handed on to, from one user to the next."""
    errors = read_table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "ts", "event_id")
    after = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    edges = errors.select(F.col("user_id").alias("a"), F.lead("user_id").over(after).alias("b"))
    return reached_nodes(edges, errors.where("user_id % 20 = 0").select(F.col("user_id").alias("node")))
