"""Queries over the retail views; each stands beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import loading, quality, windows

from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2001-08-02"


def query(key: str, sql: str):
    """Registers a function of views, called with a reader of views, under ``key``."""

    def put(f):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: f(lambda name, stored=None: view(spark, sf_dir, name, stored))
        SQL[key] = with_views(sql)
        return f

    return put


dec = lambda c: F.col(c).cast("decimal(18,2)")
total = lambda c, name: F.sum(c).cast("decimal(28,2)").alias(name)
done = lambda: F.col("status").isin("completed", "delivered", "shipped")


# ------------------------------------------------------------------ scans


@query("extract_table", "SELECT order_id, customer_id, total_amount FROM v_orders WHERE status = 'completed' ORDER BY total_amount DESC, order_id LIMIT 100")
def _(v):
    return v("v_orders").where("status = 'completed'").select("order_id", "customer_id", "total_amount").orderBy(F.desc("total_amount"), "order_id").limit(100)


@query("extract_incremental", "SELECT order_id, order_date FROM v_orders WHERE order_date > DATE '2000-06-01'")
def _(v):
    return v("v_orders").where("order_date > DATE '2000-06-01'").select("order_id", "order_date")


@query("extract_recent_days", f"SELECT order_id, order_date FROM v_orders WHERE order_date >= DATE '{AS_OF}' - INTERVAL 90 DAY")
def _(v):
    return v("v_orders").where(F.col("order_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 90)).select("order_id", "order_date")


# ------------------------------------------------------------------ cleaning


@query("order_size_tier", "SELECT order_id, CASE WHEN total_amount < 50 THEN 'Small' WHEN total_amount < 100 THEN 'Medium' WHEN total_amount < 250 THEN 'Large' WHEN total_amount < 500 THEN 'XLarge' ELSE 'Premium' END AS size_tier FROM v_orders")
def _(v):
    return v("v_orders").select("order_id", C.tier(F.col("total_amount"), [50, 100, 250, 500], ["Small", "Medium", "Large", "XLarge", "Premium"]).alias("size_tier"))


@query("order_status_flags", "SELECT order_id, status IN ('completed','delivered','shipped') AS is_completed, status IN ('cancelled','refunded') AS is_cancelled, status IN ('pending','processing','on_hold') AS is_pending FROM v_orders")
def _(v):
    return v("v_orders").select("order_id", done().alias("is_completed"), F.col("status").isin("cancelled", "refunded").alias("is_cancelled"), F.col("status").isin("pending", "processing", "on_hold").alias("is_pending"))


@query("md5_surrogate_int", "SELECT order_id, CAST('0x' || substr(md5(CAST(order_id AS VARCHAR)), 1, 8) AS BIGINT) AS sk FROM v_orders")
def _(v):
    return v("v_orders").select("order_id", C.md5_surrogate_int(F.col("order_id")).alias("sk"))


@query("date_key", "SELECT order_id, CAST(strftime(order_date, '%Y%m%d') AS INT) AS date_key FROM v_orders")
def _(v):
    return v("v_orders").select("order_id", C.date_key(F.col("order_date")).alias("date_key"))


@query("minmax_normalize", "SELECT product_id, round(CAST((price - (SELECT min(price) FROM v_products)) AS DOUBLE) / CAST((SELECT max(price) - min(price) FROM v_products) AS DOUBLE), 6) AS scaled FROM v_products")
def _(v):
    p = v("v_products")
    b = F.broadcast(p.agg(F.min("price").alias("lo"), F.max("price").alias("hi")))  # one row
    span = (F.col("hi") - F.col("lo")).cast("double")
    return p.crossJoin(b).select("product_id", F.round(F.when(span == 0, 0.5).otherwise((F.col("price") - F.col("lo")).cast("double") / span), 6).alias("scaled"))


# ------------------------------------------------------------------ joins


@query("join_broadcast_left", "SELECT o.order_id, c.name, c.segment FROM v_orders o LEFT JOIN v_customers c USING (customer_id)")
def _(v):
    # left to the planner: it broadcasts the customers while they are small and sorts beyond that
    return v("v_orders").join(v("v_customers"), "customer_id", "left").select("order_id", "name", "segment")


@query("join_inner_fact_fact", "SELECT i.order_id, i.product_id, i.quantity, o.order_date FROM v_items i JOIN v_orders o USING (order_id)")
def _(v):
    return v("v_items").join(v("v_orders"), "order_id").select("order_id", "product_id", "quantity", "order_date")


@query("join_left_dim_metrics", "SELECT c.customer_id, coalesce(n, 0) AS orders, CAST(coalesce(s, 0) AS DECIMAL(28,2)) AS spent FROM v_customers c LEFT JOIN (SELECT customer_id, count(*) AS n, sum(total_amount) AS s FROM v_orders GROUP BY 1) m USING (customer_id)")
def _(v):
    m = v("v_orders").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("s"))
    return v("v_customers").join(m, "customer_id", "left").select("customer_id", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("s", F.lit(0)).cast("decimal(28,2)").alias("spent"))


# ------------------------------------------------------------------ reshaping


@query("deduplicate", "SELECT customer_id, order_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY total_amount DESC, order_id) AS rn FROM v_orders) WHERE rn = 1")
def _(v):
    return loading.deduplicate(v("v_orders"), ["customer_id"], [F.desc("total_amount"), "order_id"]).select("customer_id", "order_id")


@query("top_k", "SELECT customer_id, CAST(sum(total_amount) AS DECIMAL(28,2)) AS spent FROM v_orders GROUP BY 1 ORDER BY spent DESC, 1 LIMIT 50")
def _(v):
    return v("v_orders").groupBy("customer_id").agg(total("total_amount", "spent")).orderBy(F.desc("spent"), "customer_id").limit(50)


# ------------------------------------------------------------------ quality


@query("dq_outliers_iqr", "WITH q AS (SELECT quantile_cont(CAST(total_amount AS DOUBLE), 0.25) AS lo, quantile_cont(CAST(total_amount AS DOUBLE), 0.75) AS hi FROM d_orders) SELECT order_id, CAST(total_amount AS DOUBLE) AS total_amount FROM d_orders, q WHERE total_amount < lo - 1.5 * (hi - lo) OR total_amount > hi + 1.5 * (hi - lo)")
def _(v):
    return quality.outliers_iqr(v("d_orders").select("order_id", F.col("total_amount").cast("double").alias("total_amount")), "total_amount")
