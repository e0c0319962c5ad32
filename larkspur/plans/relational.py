"""General relational queries that the driver's tables invite. These have no model in the reference; they show the engine at work on a star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import joins
from larkspur.plans.registry import Tables, query


def _money(c: str) -> F.Column:
    return F.col(c).cast("decimal(14,4)")


@query("d_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice::DECIMAL(14,4) * (1 - l_discount::DECIMAL(14,4))), 2)::DOUBLE AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02 00:00:00'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(_money("l_extendedprice") * (1 - _money("l_discount"))), 2).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("d_revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice::DECIMAL(14,4) * (1 - l_discount::DECIMAL(14,4))), 2)::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def by_nation(t: Tables) -> DataFrame:
    """Revenue is summed by order before it meets anything else, so the large table is shuffled once, pre-aggregated."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(_money("l_extendedprice") * (1 - _money("l_discount"))).alias("r"))
    per_customer = per_order.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r"))
    named = per_customer.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(joins.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(F.round(F.sum("r"), 2).cast("double").alias("revenue"))


@query("d_cube", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)")
def cube(t: Tables) -> DataFrame:
    return t.part.cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("d_rank_frames", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def ranks(t: Tables) -> DataFrame:
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(v).cast("long").alias("q"))


@query("d_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def intersect(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal > 5000").select("c_custkey"))


@query("d_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts - p > INTERVAL 30 MINUTE GROUP BY 1")
def sessions(t: Tables) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.select("user_id", "ts", before.alias("p"))
    return rows.where("p IS NULL OR ts - p > INTERVAL 30 MINUTE").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("d_asof_last_click", "SELECT p.event_id, max(c.event_id) AS click_id FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.event_id < p.event_id WHERE p.event_type = 'purchase' GROUP BY 1")
def asof(t: Tables) -> DataFrame:
    """Each purchase with the last click before it: one window over both, no inequality join."""
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return t.events.where("event_type IN ('click', 'purchase')").withColumn("click_id", last).where("event_type = 'purchase'").select("event_id", "click_id")


@query("d_pivot", "SELECT p_brand, count(*) FILTER (WHERE p_type = 'PROMO') AS promo, count(*) FILTER (WHERE p_type = 'LARGE') AS large FROM part GROUP BY 1")
def pivot(t: Tables) -> DataFrame:
    found = t.part.groupBy("p_brand").pivot("p_type", ["PROMO", "LARGE"]).agg(F.count(F.lit(1)))
    return found.select("p_brand", F.coalesce("PROMO", F.lit(0)).alias("promo"), F.coalesce("LARGE", F.lit(0)).alias("large"))


@query("d_quantiles", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1")
def quantiles(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5)).alias("median"), F.percentile("l_quantity", F.lit(0.9)).alias("p90"))
