"""Registered queries of the analytics engine, each with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import calendar
from tessel.functions.ordered import range_join
from tessel.operators import analysis, catalogue, quality, retrieval
from tessel.plans.model import Entity, Metric, Model, Relationship
from tessel.plans import builder, predicates, questions
from tessel.plans.planner import Request, compile_comparison, compile_request
from tessel.sources import ingest, upkeep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def tables(spark: SparkSession, sf: str) -> Callable[[str], DataFrame]:
    return lambda name: calendar.days(spark, "1995-01-01", "2024-12-31") if name == "calendar" else spark.read.parquet(f"{sf}/{name}.parquet")


def r2(name: str, digits: int = 2) -> Column:
    return F.round(F.col(f"`{name}`"), digits).alias(name)


MODEL = Model(
    entities={
        "order": Entity("order", "orders", ("o_orderkey",), {"priority": "o_orderpriority", "status": "o_orderstatus", "customer": "o_custkey"}),
        "line": Entity("line", "lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), {"returnflag": "l_returnflag", "linestatus": "l_linestatus"}),
        "customer": Entity("customer", "customer", ("c_custkey",), {"segment": "c_mktsegment", "balance": "c_acctbal"}, frozenset({"c_acctbal"})),
        "nation": Entity("nation", "nation", ("n_nationkey",), {"name": "n_name"}),
        "region": Entity("region", "region", ("r_regionkey",), {"name": "r_name"}),
        "part": Entity("part", "part", ("p_partkey",), {"brand": "p_brand", "type": "p_type"}),
        "event": Entity("event", "events", ("event_id",), {"type": "event_type", "user": "user_id"}),
        "supplier": Entity("supplier", "supplier", ("s_suppkey",), {"name": "s_name"}, frozenset({"s_acctbal"})),
        "supplier_nation": Entity("supplier_nation", "nation", ("n_nationkey",), {"name": "n_name"}),
        "calendar": Entity("calendar", "calendar", ("full_date",), {"month": "month_name", "weekday": "weekday"}, order_by={"month": "month_number", "weekday": "weekday_number"}),
    },
    relationships=[
        Relationship("order", "o_custkey", "customer", "c_custkey"),
        Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
        Relationship("nation", "n_regionkey", "region", "r_regionkey"),
        Relationship("line", "l_orderkey", "order", "o_orderkey"),
        Relationship("line", "l_partkey", "part", "p_partkey"),
        Relationship("event", "user_id", "customer", "c_custkey"),
        Relationship("line", "l_suppkey", "supplier", "s_suppkey"),
        Relationship("supplier", "s_nationkey", "supplier_nation", "n_nationkey"),
    ],
    metrics={
        "order_value": Metric("order_value", "order", "sum", "o_totalprice", time="o_orderdate", coverage=(date(1995, 1, 1), date(2001, 8, 1))),
        "order_count": Metric("order_count", "order", "count", "*", time="o_orderdate"),
        "customers": Metric("customers", "order", "count_distinct", "o_custkey", time="o_orderdate"),
        "average_order": Metric("average_order", "order", "ratio", "sum(o_totalprice)", "count(*)", time="o_orderdate"),
        "fiscal_value": Metric("fiscal_value", "order", "sum", "o_totalprice", time="o_orderdate", fiscal_start=4),
        "line_value": Metric("line_value", "line", "sum", "l_extendedprice * (1 - l_discount)", time="l_shipdate"),
        "return_rate": Metric("return_rate", "line", "ratio", "sum(case when l_returnflag = 'R' then 1 else 0 end)", "count(*)", scale=100.0, time="l_shipdate"),
        "unit_price": Metric("unit_price", "line", "ratio", "sum(l_extendedprice)", "sum(l_quantity)", time="l_shipdate"),
        "event_count": Metric("event_count", "event", "count", "*", time="ts"),
        "purchase_value": Metric("purchase_value", "event", "sum", "value", filters=("event_type = 'purchase'",), time="ts"),
        "local_events": Metric("local_events", "event", "count", "*", time="ts", offset="+08:00"),
        "mean_value": Metric("mean_value", "order", "avg", "o_totalprice", time="o_orderdate"),
        "least_value": Metric("least_value", "order", "min", "o_totalprice", time="o_orderdate"),
        "greatest_value": Metric("greatest_value", "order", "max", "o_totalprice", time="o_orderdate"),
        "orders_with": Metric("orders_with", "line", "count_distinct", "l_orderkey", time="l_shipdate"),  # a line is the bridge of orders and parts
    },
    calendar="calendar",
)


def ask(spark: SparkSession, sf: str, *metrics: str, **more: object) -> DataFrame:
    out = compile_request(MODEL, tables(spark, sf), Request(metrics, **more))
    return out.select(*(F.round(F.col(f"`{c}`"), 2).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in out.dtypes))


@query("""select r_name as "region.name", strftime(o_orderdate, '%Y-%m') as period, round(sum(o_totalprice), 2) as order_value
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1999-01-01' group by 1, 2""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "order_value", dimensions=("region.name",), grain="monthly", ranges=((date(1996, 1, 1), date(1998, 12, 31)),))


@query("select round(sum(o_totalprice), 2) as order_value, count(*) as order_count, count(distinct o_custkey) as customers, round(avg(o_totalprice), 2) as mean_value, min(o_totalprice) as least_value, max(o_totalprice) as greatest_value from orders")
def metric_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "order_value", "order_count", "customers", "mean_value", "least_value", "greatest_value")


@query("""select p_brand as "part.brand", round(sum(l_extendedprice * (1 - l_discount)), 2) as line_value from lineitem join part on l_partkey = p_partkey group by 1 order by 2 desc, 1 limit 10""")
def metric_by_dimension_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "line_value", dimensions=("part.brand",), limit=10, descending=True)


for _grain, _fmt in (("daily", "strftime({}, '%Y-%m-%d')"), ("weekly", "strftime(date_trunc('week', {}), '%Y-%m-%d')"), ("monthly", "strftime({}, '%Y-%m')"), ("quarterly", "year({0}) || '-Q' || quarter({0})"), ("yearly", "strftime({}, '%Y')")):

    def _by_period(spark: SparkSession, sf: str, grain: str = _grain) -> DataFrame:
        return ask(spark, sf, "order_value", "order_count", grain=grain)

    QUERIES[f"metric_by_period_{_grain}"] = _by_period
    ORACLES[f"metric_by_period_{_grain}"] = f"select {_fmt.format('o_orderdate')} as period, round(sum(o_totalprice), 2) as order_value, count(*) as order_count from orders group by 1"


@query("select strftime(o_orderdate, '%Y-W%W') as week, count(*) as n from orders group by 1")
def bucket_week_label(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)("orders").groupBy(calendar.week_label(F.to_date("o_orderdate")).alias("week")).agg(F.count("*").alias("n"))


@query("select strftime(date_trunc('quarter', o_orderdate - interval 3 month) + interval 3 month, '%Y-%m-%d') as period, round(sum(o_totalprice), 2) as fiscal_value from orders group by 1")
def bucket_fiscal_quarter(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "fiscal_value", grain="fiscal_quarter")


@query("select strftime(date_trunc('year', date_trunc('month', o_orderdate) - interval 3 month) + interval 3 month, '%Y-%m-%d') as period, round(sum(o_totalprice), 2) as fiscal_value from orders group by 1")
def bucket_fiscal_year(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "fiscal_value", grain="fiscal_year")


@query("select strftime(ts + interval 8 hour, '%Y-%m-%d') as period, count(*) as local_events from events where ts + interval 8 hour >= timestamp '2024-01-05' and ts + interval 8 hour < timestamp '2024-01-20' group by 1")
def bucket_fixed_offset(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "local_events", grain="daily", ranges=((date(2024, 1, 5), date(2024, 1, 19)),))


@query("""select r_name as "region.name", c_mktsegment as "customer.segment", round(sum(o_totalprice), 2) as order_value from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where o_orderstatus in ('F', 'O') and (c_mktsegment = 'BUILDING' or c_mktsegment is null or not o_totalprice between 1000 and 50000) group by 1, 2""")
def governed_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "order_value", dimensions=("region.name", "customer.segment"), where="order.status in ('F', 'O') and (customer.segment = 'BUILDING' or customer.segment is null or not o_totalprice between 1000 and 50000)")


@query("""select l_linestatus as "line.linestatus", round(sum(case when l_returnflag = 'R' then 1 else 0 end) * 100.0 / nullif(count(*), 0), 2) as return_rate, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double) as return_rate__numerator, cast(count(*) as double) as return_rate__denominator from lineitem group by 1""")
def ratio_return_rate(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "return_rate", dimensions=("line.linestatus",))


@query("""select o_orderpriority as "order.priority", round(sum(o_totalprice) / count(*), 2) as average_order, round(sum(o_totalprice), 2) as average_order__numerator, cast(count(*) as double) as average_order__denominator from orders group by 1""")
def ratio_average_order(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "average_order", dimensions=("order.priority",))


@query("""select p_brand as "part.brand", round(sum(l_extendedprice) / sum(l_quantity), 2) as unit_price, round(sum(l_extendedprice), 2) as unit_price__numerator, round(sum(l_quantity), 2) as unit_price__denominator from lineitem join part on l_partkey = p_partkey group by 1""")
def ratio_weighted_price(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "unit_price", dimensions=("part.brand",))


@query("""with a as (select strftime(o_orderdate, '%Y-%m') as period, round(sum(o_totalprice), 2) as order_value from orders group by 1), b as (select strftime(ts, '%Y-%m') as period, count(*) as event_count from events group by 1)
    select coalesce(a.period, b.period) as period, order_value, event_count from a full join b on a.period is not distinct from b.period""")
def drill_across_month(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "order_value", "event_count", grain="monthly")


@query("""with a as (select c_mktsegment as s, round(sum(o_totalprice), 2) as v from orders join customer on o_custkey = c_custkey group by 1), b as (select c_mktsegment as s, round(sum(value), 2) as p from events join customer on user_id = c_custkey where event_type = 'purchase' group by 1)
    select coalesce(a.s, b.s) as "customer.segment", v as order_value, p as purchase_value from a full join b on a.s is not distinct from b.s""")
def drill_across_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "order_value", "purchase_value", dimensions=("customer.segment",))


@query("select (select count(*) from orders) as order_count, (select count(*) from events) as event_count, (select round(sum(l_extendedprice * (1 - l_discount)), 2) from lineitem) as line_value")
def drill_across_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "order_count", "event_count", "line_value")


@query("select p_brand, count(*) as n, count(*) filter (where p_size > 25) as large from part group by 1 having count(*) >= 10")
def having_and_case(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large")).where("n >= 10")


@query("""with s as (select s_nationkey as k, count(*) as suppliers from supplier group by 1), c as (select c_nationkey as k, round(sum(c_acctbal), 2) as balance from customer group by 1)
    select n_name, coalesce(suppliers, 0) as suppliers, coalesce(balance, 0) as balance from nation left join s on n_nationkey = s.k left join c on n_nationkey = c.k""")
def left_join_of_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    s = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return t("nation").select("n_nationkey", "n_name").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select("n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("balance", F.lit(0.0)).alias("balance"))


@query("select p_partkey, p_brand, cast(dense_rank() over (partition by p_brand order by p_retailprice desc) as integer) as place from part qualify place <= 3")
def window_dense_rank(spark: SparkSession, sf: str) -> DataFrame:
    place = F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice")))
    return tables(spark, sf)("part").select("p_partkey", "p_brand", place.alias("place")).where("place <= 3")


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as running from orders")
def window_running_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return tables(spark, sf)("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("select o_custkey, min(o_orderkey) filter (where f) as first_order from (select *, o_orderdate = min(o_orderdate) over (partition by o_custkey) as f from orders) group by 1")
def window_first_row(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier where s_acctbal > 5000")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return t("customer").select(F.col("c_custkey").alias("k")).join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return t("customer").select(F.col("c_nationkey").alias("k")).unionAll(t("supplier").select("s_nationkey"))


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return compile_request(MODEL, tables(spark, sf), Request(("order_value",), grain="monthly"))


_COMPARE = """with m as (select strftime(o_orderdate, '%Y-%m') as period, sum(o_totalprice) as v, date_trunc('month', o_orderdate) as d from orders group by 1, 3)
    select a.period, round(a.v, 2) as current, round(b.v, 2) as baseline, round(a.v - b.v, 2) as delta, round((a.v - b.v) / abs(b.v), 6) as relative, round((a.v - b.v) / abs(b.v) * 100, 4) as percent,
    case when b.v is null then 'missing_value' else 'ok' end as state from m a left join m b on b.d = a.d - interval {} month"""


def _compared(spark: SparkSession, sf: str, back: int) -> DataFrame:
    out = analysis.compare_periods(_monthly(spark, sf), "period", "order_value", back)
    return out.select("period", r2("current"), r2("baseline"), r2("delta"), r2("relative", 6), r2("percent", 4), "state")


@query(_COMPARE.format(12))
def compare_periods_yoy(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf, 12)


@query(_COMPARE.format(1))
def compare_periods_mom(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf, 1)


@query("""with b as (select p_brand as name, sum(l_extendedprice) as v, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1), r as (select *, row_number() over (order by v desc, name) as rn from b)
    select case when rn <= 5 then name else 'others' end as name, rn > 5 as is_others, round(sum(v), 2) as value, count(*) as categories, cast(0 as bigint) as below_min_sample, round(sum(v) / (select sum(v) from b), 6) as share from r group by 1, 2""")
def drill_down_others(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    b = t("lineitem").select("l_partkey", "l_extendedprice").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("p_brand").agg(F.sum("l_extendedprice").alias("v"), F.count("*").alias("n"))
    return analysis.drill_down(b, "p_brand", "v", 5, "n", 1).select("name", "is_others", r2("value"), "categories", "below_min_sample", r2("share", 6))


@query("""with c as (select o_orderpriority as name, coalesce(sum(o_totalprice) filter (where year(o_orderdate) = 1997), 0) as cur, coalesce(sum(o_totalprice) filter (where year(o_orderdate) = 1996), 0) as base from orders where year(o_orderdate) in (1996, 1997) group by 1), t as (select sum(cur) - sum(base) as d from c)
    select name, round(cur, 2) as current, round(base, 2) as baseline, round(cur - base, 2) as delta, round((cur - base) / nullif(d, 0), 4) as share, (cur - base) * d < 0 as offsetting from c, t""")
def contribution_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    o = tables(spark, sf)("orders").where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1998-01-01"))
    year = F.year("o_orderdate")
    c = o.groupBy("o_orderpriority").agg(F.sum(F.when(year == 1997, F.col("o_totalprice"))).alias("cur"), F.sum(F.when(year == 1996, F.col("o_totalprice"))).alias("base"))
    return analysis.contribution(c, "o_orderpriority", "cur", "base").select("name", r2("current"), r2("baseline"), r2("delta"), r2("share", 4), "offsetting")


@query("select strftime(o_orderdate, '%Y') as period, round(sum(o_totalprice), 2) as cells, round(sum(o_totalprice), 2) as total, true as reconciled from orders group by 1")
def reconcile_buckets(spark: SparkSession, sf: str) -> DataFrame:
    cells = compile_request(MODEL, tables(spark, sf), Request(("order_value",), dimensions=("order.priority",), grain="yearly"))
    totals = compile_request(MODEL, tables(spark, sf), Request(("order_value",), grain="yearly"))
    return analysis.reconcile(cells, totals, "period", "order_value", "order_value").select("period", r2("cells"), r2("total"), "reconciled")


@query("""with g as (select l_returnflag, sum(l_extendedprice) as n, sum(l_quantity) as d from lineitem group by 1) select round(sum(n), 2) as numerator, round(sum(d), 2) as denominator, round(sum(n) / sum(d), 6) as ratio, round(avg(n / d), 6) as unweighted from g""")
def combine_ratio(spark: SparkSession, sf: str) -> DataFrame:
    g = tables(spark, sf)("lineitem").groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("n"), F.sum("l_quantity").alias("d"))
    return analysis.combine_ratio(g, "n", "d").select(r2("numerator"), r2("denominator"), r2("ratio", 6), r2("unweighted", 6))


_DAYS = "with d as (select strftime(ts, '%Y-%m-%d') as label, sum(value) as v from events group by 1)"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("label")).agg(F.sum("value").alias("v"))


def _anomalies(df: DataFrame) -> DataFrame:
    return df.select("label", r2("value"), r2("expected"), r2("score", 4), "is_anomaly", "state")


@query(_DAYS + """, c as (select median(v) as m from d), s as (select median(abs(v - m)) * 1.4826 as sc from d, c)
    select label, round(v, 2) as value, round(m, 2) as expected, round((v - m) / sc, 4) as score, abs((v - m) / sc) >= 2.0 as is_anomaly, 'ok' as state from d, c, s""")
def anomaly_robust(spark: SparkSession, sf: str) -> DataFrame:
    return _anomalies(analysis.anomalies(_daily(spark, sf), "label", "v", "robust", 2.0))


@query(_DAYS + """, c as (select avg(v) as m, stddev_pop(v) as sc from d) select label, round(v, 2) as value, round(m, 2) as expected, round((v - m) / sc, 4) as score, abs((v - m) / sc) >= 1.5 as is_anomaly, 'ok' as state from d, c""")
def anomaly_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return _anomalies(analysis.anomalies(_daily(spark, sf), "label", "v", "zscore", 1.5))


@query(_DAYS + """, o as (select median(v) as overall from d), g as (select isodow(cast(label as date)) as w, median(v) as m from d group by 1 having count(*) >= 2),
    a as (select label, v, coalesce(m - overall, 0) as adj, v - coalesce(m - overall, 0) as x from d cross join o left join g on isodow(cast(label as date)) = w), c as (select median(x) as m from a), s as (select median(abs(x - m)) * 1.4826 as sc from a, c)
    select label, round(v, 2) as value, round(m + adj, 2) as expected, round((x - m) / sc, 4) as score, abs((x - m) / sc) >= 2.0 as is_anomaly, 'ok' as state from a, c, s""")
def anomaly_weekly_season(spark: SparkSession, sf: str) -> DataFrame:
    return _anomalies(analysis.anomalies(_daily(spark, sf), "label", "v", "robust", 2.0, season="weekday"))


@query(_DAYS + """, n as (select label, case when label in ('2024-01-05', '2024-01-06') then null else v end as raw from d), f as (select label, raw, last_value(raw ignore nulls) over (order by label) as v from n),
    c as (select median(v) as m from f), s as (select median(abs(v - m)) * 1.4826 as sc from f, c) select label, round(v, 2) as value, round(m, 2) as expected, round((v - m) / sc, 4) as score, abs((v - m) / sc) >= 2.0 and raw is not null as is_anomaly, 'ok' as state from f, c, s""")
def anomaly_gap(spark: SparkSession, sf: str) -> DataFrame:
    d = _daily(spark, sf).withColumn("v", F.when(~F.col("label").isin("2024-01-05", "2024-01-06"), F.col("v")))
    return _anomalies(analysis.anomalies(d, "label", "v", "robust", 2.0, missing="gap"))


_GRAIN = "with g as (select {0}, count(*) as n from {1} group by {0}) select 'grain_unique' as \"check\", '{2}' as target, count(*) filter (where n > 1) as duplicate_groups, cast(0 as bigint) as null_rows, cast(sum(n) as bigint) as total, case when count(*) filter (where n > 1) > 0 then 'error' else 'ok' end as status from g"


@query(_GRAIN.format("l_orderkey, l_linenumber", "lineitem", "l_orderkey,l_linenumber"))
def dq_grain_failing(spark: SparkSession, sf: str) -> DataFrame:
    return quality.grain_unique(tables(spark, sf)("lineitem"), ["l_orderkey", "l_linenumber"])


@query(_GRAIN.format("o_orderkey", "orders", "o_orderkey"))
def dq_grain_unique(spark: SparkSession, sf: str) -> DataFrame:
    return quality.grain_unique(tables(spark, sf)("orders"), ["o_orderkey"])


@query("""with e as (select case when event_type = 'click' then null else value end as value, event_type, case when false then 1 end as nothing from events)
    select 'value' as target, count(*) filter (where value is null) as failed, count(*) as total, round(count(*) filter (where value is null) / count(*), 6) as rate, case when count(*) filter (where value is null) > 0 then 'warning' else 'ok' end as status from e
    union all select 'event_type', 0, count(*), 0.0, 'ok' from e union all select 'nothing', count(*), count(*), 1.0, 'error' from e""")
def dq_null_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = tables(spark, sf)("events").select(F.when(F.col("event_type") != "click", F.col("value")).alias("value"), "event_type", F.lit(None).cast("int").alias("nothing"))
    return quality.null_rates(e, ["value", "event_type", "nothing"])


@query("select cast(max(cast(o_orderdate as date)) as varchar) as newest, cast(date '2001-08-03' - max(cast(o_orderdate as date)) as integer) as lag_days, case when date '2001-08-03' - max(cast(o_orderdate as date)) <= 0 then 'ok' when date '2001-08-03' - max(cast(o_orderdate as date)) <= 3 then 'warning' else 'error' end as status from orders")
def dq_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return quality.freshness(tables(spark, sf)("orders"), "o_orderdate", "2001-08-03", 3)


@query("select count(distinct cast(o_orderdate as date)) as present, cast(2405 as bigint) as expected, round(count(distinct cast(o_orderdate as date)) / 2405, 6) as ratio, case when count(distinct cast(o_orderdate as date)) < 2405 then 'warning' else 'ok' end as status from orders where cast(o_orderdate as date) between date '1995-01-01' and date '2001-08-01'")
def dq_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.coverage(tables(spark, sf)("orders"), "o_orderdate", "1995-01-01", "2001-08-01")


@query("select strftime(day, '%Y-%m-%d') as day from (select cast(unnest(generate_series(date '1995-01-01', date '2001-08-01', interval 1 day)) as date) as day) where day not in (select cast(o_orderdate as date) from orders)")
def dq_missing_days(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.missing_days(tables(spark, sf)("orders"), "o_orderdate", "1995-01-01", "2001-08-01").select(F.col("day").cast("string").alias("day"))


@query("select count(*) as orphans, count(distinct o_custkey) as orphan_keys, case when count(*) > 0 then 'error' else 'ok' end as status from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20)")
def dq_referential(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return quality.referential(t("orders"), "o_custkey", t("customer").where("c_nationkey < 20"), "c_custkey")


@query("select count(*) filter (where conv_id is null or turn is null) as null_rows, cast(0 as bigint) as duplicate_groups from conversations")
def contract_primary_key(spark: SparkSession, sf: str) -> DataFrame:
    return quality.contract_key(tables(spark, sf)("conversations"), ["conv_id", "turn"]).select(F.col("null_rows").cast("long").alias("null_rows"), "duplicate_groups")


@query("select count(*) filter (where x is null or trim(x) = '') as failed, round(count(*) filter (where x is null or trim(x) = '') / count(*), 6) as rate from (select case when c_nationkey = 3 then null when c_nationkey = 4 then '  ' else c_name end as x from customer)")
def contract_null_rate(spark: SparkSession, sf: str) -> DataFrame:
    c = tables(spark, sf)("customer").select(F.when(F.col("c_nationkey") == 3, F.lit(None)).when(F.col("c_nationkey") == 4, "  ").otherwise(F.col("c_name")).alias("x"))
    return quality.contract_null_rate(c, "x")


@query("select min(l_discount) as least, max(l_discount) as greatest, count(*) filter (where l_discount > 0.08) as failed from lineitem")
def contract_range(spark: SparkSession, sf: str) -> DataFrame:
    return quality.contract_range(tables(spark, sf)("lineitem"), "l_discount", 0, 0.08)


@query("select count(*) filter (where try_cast(x as date) is null) as failed, count(*) as total from (select case when o_orderkey % 10 = 0 then '2024-02-30' else strftime(o_orderdate, '%Y-%m-%d') end as x from orders)")
def contract_time_values(spark: SparkSession, sf: str) -> DataFrame:
    o = tables(spark, sf)("orders").select(F.when(F.col("o_orderkey") % 10 == 0, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("x"))
    return quality.contract_times(o, "x")


def _raw_events(spark: SparkSession, sf: str) -> DataFrame:
    e = tables(spark, sf)("events")
    return e.select((F.col("event_id") % 4000).cast("string").alias("Event ID"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("Kind"), F.col("event_id").alias("ordinal"))


_REASONS = """with e as (select cast(event_id % 4000 as varchar) as id, case when event_type <> 'click' then event_type end as kind, event_id as o from events), f as (select id, min(o) as first from e where kind is not null group by 1)
    select case when kind is null then 'missing kind' when o <> first then 'duplicate' else 'accepted' end as reason, count(*) as n from e left join f using (id) group by 1"""


@query(_REASONS)
def ingest_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    d = _raw_events(spark, sf)
    d = ingest.normalise(d.select("Event ID", "Kind", F.col("ordinal").cast("string").alias("o"))).withColumn(ingest.ORDINAL, F.col("o").cast("long"))
    judged = ingest.judge_rows(d, ingest.Rules(required=("kind",), unique=("event_id",)))
    return judged.groupBy(F.coalesce(ingest.REASON, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("select event_id, value from events where event_id > 900")
def ingest_watermark_delta(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.after_watermark(tables(spark, sf)("events").select("event_id", "value"), "event_id", "900")


@query("""select 'c_custkey' as "column", count(*) as n, 'INTEGER' as type from customer union all select 'c_acctbal', count(*), 'REAL' from customer union all select 'c_name', count(*), 'TEXT' from customer""")
def ingest_type_profile(spark: SparkSession, sf: str) -> DataFrame:
    c = tables(spark, sf)("customer").select("c_custkey", F.format_string("%.2f", "c_acctbal").alias("c_acctbal"), "c_name")
    return ingest.infer_types(ingest.normalise(c))


@query("select 's_suppkey' as \"column\", count(*) as rows, cast(0 as bigint) as nulls, count(distinct s_suppkey) as distinct from supplier union all select 's_nationkey', count(*), 0, count(distinct s_nationkey) from supplier".replace("as distinct", 'as "distinct"').replace("as rows", 'as "rows"'))
def ingest_profile(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.profile(tables(spark, sf)("supplier").select("s_suppkey", "s_nationkey"))


@query("""with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0), p as (select query_id, vec_id, list_distance(cast(embedding as double[]), cast(q as double[])) as distance from embeddings, q)
    select query_id, vec_id, round(distance, 4) as distance from p qualify row_number() over (partition by query_id order by distance, vec_id) <= 5""")
def vector_top5(spark: SparkSession, sf: str) -> DataFrame:
    v = tables(spark, sf)("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return retrieval.vector_top(v, v.where("vec_id % 100 = 0"), "embedding", "vec_id", 5).select("query_id", "vec_id", r2("distance", 4))


@query("""select c_name as value from customer where lower(c_name) like '%0001%' or lower(c_name) like '%0002%' group by 1 order by length(c_name), c_name limit 3""")
def value_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.value_search(tables(spark, sf)("customer"), "c_name", ["0001", "0002"], 3)


@query("select distinct p_brand from part order by 1 limit 100")
def distinct_preview(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.distinct_preview(tables(spark, sf)("part"), "p_brand")


@query("""with t as (select item_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as w from benchmark)
    select a.item_id, b.item_id as other_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) as similarity from t a, t b where a.item_id < b.item_id and len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.2""")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = retrieval.jaccard_pairs(tables(spark, sf)("benchmark"), "item_id", "text", 0.2)
    return out.select("item_id", F.col("other_item_id").alias("other_id"), r2("similarity", 6))


@query(r"""with o as (select doc_id, coalesce(text, '') as text from documents), n as (select doc_id, trim(regexp_replace(text, ' +', ' ', 'g'), ' ') as text from o union all select -1 - page_id, coalesce(html, '') from pages)
    select doc_id, case when o.text is null then 'insert' when n.text is null then 'keep' when o.text = n.text then 'unchanged' else 'update' end as action from o full join n using (doc_id)""")
def content_hash_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with tidied blanks, and all pages, into the documents."""
    old = tables(spark, sf)("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tidy = old.select("doc_id", F.trim(F.regexp_replace("text", " +", " ")).alias("text"))
    pages = tables(spark, sf)("pages").select((-1 - F.col("page_id")).alias("doc_id"), F.coalesce("html", F.lit("")).alias("text"))
    return retrieval.upsert(old, tidy.unionByName(pages), "doc_id", ["text"])


@query("""with q as (select c_mktsegment as segment, round(sum(o_totalprice), 2) as order_value from orders join customer on o_custkey = c_custkey where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01' and o_orderstatus = 'F' group by 1)
    select segment as "customer.segment", order_value from q order by order_value desc, segment limit 3""")
def question_top_segments(spark: SparkSession, sf: str) -> DataFrame:
    return answer(spark, sf, "Top 3 order value by customer segment in 1997 where status = 'F'")


@query("""select o_orderpriority as "order.priority", strftime(o_orderdate, '%Y-%m') as period, count(*) as order_count from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01' group by 1, 2""")
def question_follow_up(spark: SparkSession, sf: str) -> DataFrame:
    """A question by status; then by priority instead, then over time."""
    request = questions.to_request(MODEL, "Order count by order status in 1996", date(2001, 8, 1))
    for text in ("by order priority instead", "over time"):
        request = questions.follow_up(MODEL, request, text, date(2001, 8, 1))[0]
    return compile_request(MODEL, tables(spark, sf), request)


def answer(spark: SparkSession, sf: str, question: str) -> DataFrame:
    r = questions.to_request(MODEL, question, date(2001, 8, 1))
    return ask(spark, sf, *r.metrics, dimensions=r.dimensions, grain=r.grain, ranges=r.ranges, where=r.where, limit=r.limit, descending=r.descending)


@query("""select 'o_totalprice' as "column", round(sum(o_totalprice), 2) as total, min(o_totalprice) as least, max(o_totalprice) as greatest, count(o_totalprice) as n, cast(0 as bigint) as nulls from orders
    union all select 'o_custkey', cast(sum(o_custkey) as double), cast(min(o_custkey) as double), cast(max(o_custkey) as double), count(*), 0 from orders""")
def result_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.result_aggregates(tables(spark, sf)("orders"), ["o_totalprice", "o_custkey"]).select("column", r2("total"), "least", "greatest", "n", "nulls")


@query("select quantile_disc(o_totalprice, 0.5) as p50_disc, round(quantile_cont(o_totalprice, 0.5), 4) as p50_linear, quantile_disc(o_totalprice, 0.95) as p95_disc, round(quantile_cont(o_totalprice, 0.95), 4) as p95_linear from orders")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.percentiles(tables(spark, sf)("orders"), "o_totalprice").select("p50_disc", r2("p50_linear", 4), "p95_disc", r2("p95_linear", 4))


@query("select event_type as kind, count(*) as n, round(sum(value), 2) as total, round(max(value), 2) as longest from events group by 1")
def telemetry_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    e = tables(spark, sf)("events").select("event_type", F.lit(0.0).alias("s"), F.col("value").alias("e"))
    return analysis.telemetry(e, "event_type", "s", "e").select("kind", "n", r2("total"), r2("longest"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def tumbling_hours(spark: SparkSession, sf: str) -> DataFrame:
    from tessel.streaming.windows import windowed_metric

    return windowed_metric(tables(spark, sf)("events"), "ts", ["event_type"], "value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r2("total"))


@query("""with t as (select unnest([{'place': 0, 'name': 'c_custkey', 'v': cast(c_custkey as varchar)}, {'place': 1, 'name': 'c_name', 'v': c_name}, {'place': 2, 'name': 'c_mktsegment', 'v': nullif(c_mktsegment, 'BUILDING')}]) as c from customer),
    n as (select c.place as place, c.name as name, c.v as v, coalesce(trim(c.v) <> '', false) as filled from t)
    select place, name, case when count(*) filter (where filled) > 0 and bool_and(not filled or try_cast(v as double) is not null) then 'NUMBER' else 'TEXT' end as type, count(*) filter (where not filled) as nulls from n group by 1, 2""")
def csv_profile(spark: SparkSession, sf: str) -> DataFrame:
    c = tables(spark, sf)("customer")
    return upkeep.profile_csv(c.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment")))


@query("""with m as (select o_orderpriority as priority, strftime(o_orderdate, '%Y-%m') as period, sum(o_totalprice) as v from orders group by 1, 2), w as (select *, lag(period) over (partition by priority order by v, period) as previous from m) select priority, period, previous from w where previous >= period""")
def period_order_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Each priority's months in order of value: where they aren't in order of time."""
    m = tables(spark, sf)("orders").groupBy(F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.sum("o_totalprice").alias("v"))
    return upkeep.period_order(m.withColumn("at", F.struct("v", "period")), "period", "at", ["priority"]).select("priority", "period", "previous")


@query("""select strftime(o_orderdate, '%B') as "calendar.month", round(sum(o_totalprice), 2) as order_value, count(distinct o_custkey) as customers from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' group by 1""")
def calendar_months(spark: SparkSession, sf: str) -> DataFrame:
    """By the calendar table's month names, in the order of months."""
    return ask(spark, sf, "order_value", "customers", dimensions=("calendar.month",), ranges=((date(1996, 1, 1), date(1997, 12, 31)),))


@query("""select strftime(o_orderdate, '%A') as "calendar.weekday", count(*) as order_count from orders group by isodow(o_orderdate), 1 order by isodow(o_orderdate) limit 3""")
def natural_order_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first three weekdays: labels go by their companion, not by the alphabet."""
    return ask(spark, sf, "order_count", dimensions=("calendar.weekday",), limit=3)


@query("""select sn.n_name as "supplier_nation.name", cn.n_name as "nation.name", round(sum(l_extendedprice * (1 - l_discount)), 2) as line_value from lineitem join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey
    join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey where cn.n_name in ('NATION_1', 'NATION_2', 'NATION_3') or sn.n_name = 'NATION_4' group by 1, 2""")
def role_playing_nations(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "line_value", dimensions=("supplier_nation.name", "nation.name"), where="nation.name in ('NATION_1', 'NATION_2', 'NATION_3') or supplier_nation.name = 'NATION_4'")


@query("""select p_brand as "part.brand", o_orderpriority as "order.priority", count(distinct l_orderkey) as orders_with from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey group by 1, 2""")
def bridge_orders_of_brands(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "orders_with", dimensions=("part.brand", "order.priority"))


@query("""with p as (select user_id, epoch_us(ts) as at from events where event_type = 'purchase') select e.event_type as kind, count(*) as n, round(sum(e.value), 2) as total from events e join p on e.user_id = p.user_id and epoch_us(e.ts) >= p.at and epoch_us(e.ts) < p.at + 21600000000 group by 1""")
def range_join_after_purchase(spark: SparkSession, sf: str) -> DataFrame:
    """What users do in the six hours from each of their purchases on."""
    e = tables(spark, sf)("events").select("user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    hours = 6 * 3600 * 1_000_000
    p = e.where("event_type = 'purchase'").select("user_id", F.col("at").alias("begin"))
    return range_join(e, F.col("at"), p, F.col("begin"), F.col("begin") + hours, hours, ["user_id"]).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""select p_brand as name, round(sum(l_extendedprice), 2) as value, (select count(distinct p_brand) from lineitem join part on l_partkey = p_partkey) > 4 as truncated from lineitem join part on l_partkey = p_partkey group by 1 order by sum(l_extendedprice) desc, 1 limit 4""")
def truncated_top_brands(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    b = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("name")).agg(F.sum("l_extendedprice").alias("value"))
    return analysis.truncated_top(b, "value", ["name"], 4).select("name", r2("value"), "truncated")


@query("""with q as (select o_orderpriority as p, year(o_orderdate) || '-Q' || quarter(o_orderdate) as period, (year(o_orderdate) - 1) || '-Q' || quarter(o_orderdate) as before, sum(o_totalprice) as v from orders group by 1, 2, 3)
    select a.p as "order.priority", a.period, a.before as baseline_period, round(a.v, 2) as current, round(b.v, 2) as baseline, round(a.v - b.v, 2) as delta, round((a.v - b.v) / abs(b.v), 6) as relative, round((a.v - b.v) / abs(b.v) * 100, 4) as percent, case when b.v is null then 'missing_value' else 'ok' end as state
    from q a left join q b on a.p = b.p and b.period = a.before where a.period like '1997-%'""")
def question_year_over_year(spark: SparkSession, sf: str) -> DataFrame:
    r = questions.to_request(MODEL, "Quarterly order value by order priority in 1997 year over year", date(2001, 8, 1))
    out = compile_comparison(MODEL, tables(spark, sf), r)
    return out.select(F.col("`order.priority`").alias("order.priority"), "period", "baseline_period", r2("current"), r2("baseline"), r2("delta"), r2("relative", 6), r2("percent", 4), "state")


@query("""select strftime(o_orderdate, '%Y-%m') as period, count(*) as order_count from orders where (o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-04-01') or (o_orderdate >= timestamp '1998-05-01' and o_orderdate < timestamp '1998-06-01') group by 1""")
def question_several_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranges, one joined and one in Chinese."""
    return answer(spark, sf, "monthly order count from January 1996 to March 1996 and 1998年5月")


@query("""with m as (select strftime(o_orderdate, '%Y-%m') as label, sum(o_totalprice) as v from orders group by 1) select min(label) as first_label, max(label) as last_label, round(arg_min(v, label), 2) as first, round(arg_max(v, label), 2) as last, count(*) as points, round(arg_max(v, label) - arg_min(v, label), 2) as delta from m""")
def series_first_last(spark: SparkSession, sf: str) -> DataFrame:
    s = analysis.series(_monthly(spark, sf))
    return analysis.series_ends(s, "label", "value").select("first_label", "last_label", r2("first"), r2("last"), "points", r2("delta"))


@query("""with m as (select strftime(o_orderdate, '%Y-%m') as label, sum(o_totalprice) as v from orders group by 1) select '2001-08' as label, round(max(v) filter (where label = '2001-08'), 2) as value, '2001-07' as baseline_label, round(max(v) filter (where label = '2001-07'), 2) as baseline from m""")
def comparison_of_last_month(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.comparison_pair(analysis.series(_monthly(spark, sf)), "2001-08", "2001-07").select("label", r2("value"), "baseline_label", r2("baseline"))


@query("""with g as (select n_name as d, round(sum(o_totalprice), 2) as v, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1)
    select 'order_value' as metric, max(v) as greatest, min(v) as least, (select d from g order by v desc, d limit 1) as top from g union all select 'order_count', cast(max(n) as double), cast(min(n) as double), (select d from g order by n desc, d limit 1) from g""")
def metric_cards(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.metric_cards(ask(spark, sf, "order_value", "order_count", dimensions=("nation.name",)), "nation.name", ["order_value", "order_count"])


@query("""with g as (select c_mktsegment as g, sum(c_acctbal) as v from customer group by 1) select g as "group", round(v, 2) as total, round(v / (select sum(v) from g), 6) as share, g = (select g from g order by v desc, g limit 1) as is_top from g""")
def segment_totals(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.group_totals(tables(spark, sf)("customer"), "c_mktsegment", "c_acctbal").select("group", r2("total"), r2("share", 6), "is_top")


@query("""with o as (select strftime(o_orderdate, '%Y-%m') as m from orders where o_orderpriority = '1-URGENT' group by 1), e as (select strftime(unnest(generate_series(date '1994-11-01', date '2001-08-01', interval 1 month)), '%Y-%m') as m)
    select (select count(*) from o) as rows_analysed, least((select count(*) from o), 24) as rows_shown, (select count(*) from o) > 24 as display_truncated, false as input_truncated, count(*) as expected, count(*) filter (where m not in (select m from o)) as missing, count(*) filter (where m not in (select m from o)) = 0 as complete from e""")
def completeness_of_months(spark: SparkSession, sf: str) -> DataFrame:
    m = tables(spark, sf)("orders").where("o_orderpriority = '1-URGENT'").select(F.date_format("o_orderdate", "yyyy-MM").alias("label")).distinct()
    expected = spark.range(1).select(F.explode(F.sequence(F.lit("1994-11-01").cast("date"), F.lit("2001-08-01").cast("date"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("label"))
    return analysis.completeness(m, "label", expected, 24).select("rows_analysed", F.col("rows_shown").cast("long").alias("rows_shown"), "display_truncated", "input_truncated", "expected", "missing", "complete")


@query("""with b as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as w from benchmark), d as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) as w from documents)
    select item_id, doc_id, round(len(list_intersect(b.w, d.w)) / least(len(b.w), len(d.w)), 6) as overlap from b, d where len(list_intersect(b.w, d.w)) >= 5 and len(list_intersect(b.w, d.w)) / least(len(b.w), len(d.w)) >= 0.8""")
def holdout_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share most of their tokens with a benchmark item, or hold most of its."""
    t = tables(spark, sf)
    return retrieval.token_overlap(t("benchmark"), "item_id", t("documents"), "doc_id", "text", 0.8, 5).select("item_id", "doc_id", r2("overlap", 6))


@query("""with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0), p as (select query_id, vec_id, list_distance(cast(embedding as double[]), cast(q as double[])) as distance from embeddings, q where label in (1, 3))
    select query_id, vec_id, round(distance, 4) as distance from p qualify row_number() over (partition by query_id order by distance, vec_id) <= 3""")
def vector_top3_of_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Filters come before ranking."""
    v = tables(spark, sf)("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return retrieval.vector_top(v, v.where("vec_id % 100 = 0"), "embedding", "vec_id", 3, {"label": [1, 3]}).select("query_id", "vec_id", r2("distance", 4))


@query("select vec_id from embeddings where not coalesce(label = 2 , false)")
def vector_delete_label(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.delete_where(tables(spark, sf)("embeddings"), {"label": 2}).select("vec_id")


@query("""select 'region' as "table", 'r_name' as "column", r_name as value from region where lower(r_name) like '%europe%' or lower(r_name) like '%amer%' union all (select 'part', 'p_brand', p_brand from part where lower(p_brand) like '%brand%' group by p_brand order by length(p_brand), p_brand limit 3)""")
def value_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Values of regions and parts that hold a word of the question."""
    t = tables(spark, sf)
    return retrieval.value_hints({"region": t("region"), "part": t("part").select("p_brand", "p_name")}, "sales of a BRAND in Europe or in Amer", {"part": {"p_name"}})


@query("""select 'orders' as child, 'o_custkey' as child_column, 'customer' as parent, 'c_custkey' as parent_key where not exists (select 1 from orders where o_custkey not in (select c_custkey from customer))
    union all select 'customer', 'c_nationkey', 'nation', 'n_nationkey' where not exists (select 1 from customer where c_nationkey not in (select n_nationkey from nation)) union all select 'supplier', 's_nationkey', 'nation', 'n_nationkey' where not exists (select 1 from supplier where s_nationkey not in (select n_nationkey from nation))
    union all select 'nation', 'n_regionkey', 'region', 'r_regionkey' where not exists (select 1 from nation where n_regionkey not in (select r_regionkey from region)) union all select 'lineitem', 'l_orderkey', 'orders', 'o_orderkey' where not exists (select 1 from lineitem where l_orderkey not in (select o_orderkey from orders))
    union all select 'lineitem', 'l_suppkey', 'supplier', 's_suppkey' where not exists (select 1 from lineitem where l_suppkey not in (select s_suppkey from supplier)) union all select 'lineitem', 'l_partkey', 'part', 'p_partkey' where not exists (select 1 from lineitem where l_partkey not in (select p_partkey from part))""")
def model_references(spark: SparkSession, sf: str) -> DataFrame:
    """The references that the model builder finds and proves."""
    t = tables(spark, sf)
    names = ("orders", "customer", "nation", "region", "supplier", "part", "lineitem")
    return builder.as_rows(builder.propose({n: t(n) for n in names}), t("region"))


@query("""select o_orderkey, cast(cast(o_totalprice as decimal(18, 2)) as varchar) as price, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as at, lower(hex(encode(o_orderpriority))) as raw, o_orderstatus = 'F' as done from orders""")
def json_safe_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = tables(spark, sf)("orders")
    return catalogue.json_safe(o.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").cast("binary").alias("raw"), (F.col("o_orderstatus") == "F").alias("done")))


@query("""select count(*) filter (where x is null) as null_rows, (select count(*) from (select x from (select case when c_nationkey < 3 then null else c_nationkey end as x from customer) group by x having count(*) > 1)) as duplicate_groups from (select case when c_nationkey < 3 then null else c_nationkey end as x from customer)""")
def contract_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Several nulls are a group of duplicates."""
    c = tables(spark, sf)("customer").select(F.when(F.col("c_nationkey") >= 3, F.col("c_nationkey")).alias("x"))
    return quality.contract_key(c, ["x"]).select(F.col("null_rows").cast("long").alias("null_rows"), "duplicate_groups")


@query("""select coalesce(r, 'accepted') as reason, count(*) as n from (select case when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 'duplicate' end as r from customer) group by 1""")
def ingest_published_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose key was published before are duplicates."""
    t = tables(spark, sf)
    published = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    judged = ingest.judge_rows(ingest.with_ordinal(t("customer").select("c_custkey")), ingest.Rules(unique=("c_custkey",)), published)
    return judged.groupBy(F.coalesce(ingest.REASON, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("select cast(max(event_id) as varchar) as watermark from events where event_type <> 'click'")
def ingest_advance(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest accepted value as a number: 999 is less than 1000."""
    e = tables(spark, sf)("events").where("event_type <> 'click'").select(F.col("event_id").cast("string").alias("event_id"))
    return spark.createDataFrame([(ingest.advance(e, "event_id", "17"),)], "watermark string")


@query("""select 'lineitem.l_orderkey>orders.o_orderkey' as step, count(*) filter (where l_orderkey not in (select o_orderkey from orders)) as orphans, count(distinct l_orderkey) filter (where l_orderkey not in (select o_orderkey from orders)) as orphan_keys, case when count(*) filter (where l_orderkey not in (select o_orderkey from orders)) > 0 then 'error' else 'ok' end as status from lineitem
    union all select 'orders.o_custkey>customer.c_custkey', count(*) filter (where o_custkey not in (select c_custkey from customer)), count(distinct o_custkey) filter (where o_custkey not in (select c_custkey from customer)), case when count(*) filter (where o_custkey not in (select c_custkey from customer)) > 0 then 'error' else 'ok' end from orders""")
def contract_path_references(spark: SparkSession, sf: str) -> DataFrame:
    return quality.path_references(MODEL, tables(spark, sf), "line", "customer")


@query("""select 'orders' as target, cast(0 as bigint) as duplicate_groups, cast(0 as bigint) as null_rows, count(*) as total, 'ok' as status from orders union all select 'customer.c_custkey', 0, 0, count(*), 'ok' from customer union all select 'nation.n_nationkey', 0, 0, count(*), 'ok' from nation""")
def join_targets_proven(spark: SparkSession, sf: str) -> DataFrame:
    return quality.proven_join(MODEL, tables(spark, sf), "order", "nation")


@query("select count(*) filter (where cast(ts as varchar) >= '2024-01-05' and cast(ts as varchar) <= '2024-01-08') as raw, count(*) filter (where cast(ts as date) between date '2024-01-05' and date '2024-01-08') as days from events")
def window_raw_and_day(spark: SparkSession, sf: str) -> DataFrame:
    """Textual bounds leave out the last day; calendar days keep it."""
    e = tables(spark, sf)("events")
    return e.agg(F.count_if(predicates.window(F.col("ts"), "2024-01-05", "2024-01-08", "raw")).alias("raw"), F.count_if(predicates.window(F.col("ts"), "2024-01-05", "2024-01-08")).alias("days"))


@query("""select '{"a":' || cast(o_custkey as varchar) || ',"m":{"k":"' || o_orderstatus || '","z":1},"z":[' || cast(o_orderkey as varchar) || ']}' as "nested", cast(o_orderkey as varchar) as order_key from orders""")
def ingest_nested_json(spark: SparkSession, sf: str) -> DataFrame:
    """Nested values as JSON with sorted keys, and a column by its alias."""
    o = tables(spark, sf)("orders")
    nested = F.struct(F.array("o_orderkey").alias("z"), F.col("o_custkey").alias("a"), F.struct(F.lit(1).alias("z"), F.col("o_orderstatus").alias("k")).alias("m"))
    return ingest.normalise(o.select(nested.alias("Nested"), F.col("o_orderkey").alias("Order No")), {"order_no": "order_key"})


@query("select role as model, count(*) as calls, cast(sum(length(coalesce(text, ''))) as bigint) as chars, cast(sum(turn) as bigint) as turns, cast(sum(length(coalesce(text, ''))) + sum(turn) as bigint) as total from conversations where role is not null group by 1")
def telemetry_by_model(spark: SparkSession, sf: str) -> DataFrame:
    c = tables(spark, sf)("conversations").select("role", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.col("turn").alias("turns"))
    return analysis.tokens_by_model(c, "role", ["chars", "turns"])


@query("""with m as (select o_orderpriority as p, strftime(o_orderdate, '%Y-%m') as period, sum(o_totalprice) as v from orders group by 1, 2), t as (select strftime(o_orderdate, '%Y-%m') as period, sum(o_totalprice) as total from orders where o_orderdate < timestamp '2001-06-01' group by 1), c as (select period, sum(v) as cells from m group by 1)
    select coalesce(c.period, t.period) as period, round(cells, 2) as cells, round(total, 2) as total, t.total is not null as reconciled from c full join t on c.period = t.period""")
def reconcile_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    """Totals lack the last months, so those aren't reconciled: a missing side is no zero here."""
    cells = compile_request(MODEL, tables(spark, sf), Request(("order_value",), dimensions=("order.priority",), grain="monthly"))
    totals = compile_request(MODEL, tables(spark, sf), Request(("order_value",), grain="monthly", ranges=((date(1995, 1, 1), date(2001, 5, 31)),)))
    return analysis.reconcile(cells, totals, "period", "order_value", "order_value", complete=False, category="order.priority").select("period", r2("cells"), r2("total"), "reconciled")
