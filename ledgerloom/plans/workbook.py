"""Analytic queries, marts, windows and cleaning; each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .retail import query, total

n = lambda: F.count(F.lit(1))
line = lambda: F.col("quantity") * F.col("unit_price")
LINE = "CAST(sum(quantity * unit_price) AS DECIMAL(28,2))"
SPENT = "CAST(sum(total_amount) AS DECIMAL(28,2))"


def line_total(name: str = "revenue") -> Column:
    return F.sum(line()).cast("decimal(28,2)").alias(name)


def geo(v):
    # nations and regions have a fixed number of rows; the planner broadcasts them
    return v("v_orders").join(v("v_customers"), "customer_id").join(v("v_nations"), "nation_key").join(v("v_regions"), "region_key")


# ------------------------------------------------------------------ marts


@query("gold_fact_order_items", "SELECT order_id, line_number, product_id, customer_id, order_date, status, quantity, CAST(quantity * unit_price AS DECIMAL(18,2)) AS line_total FROM v_items JOIN v_orders USING (order_id)")
def _(v):
    return v("v_items").join(v("v_orders"), "order_id").select("order_id", "line_number", "product_id", "customer_id", "order_date", "status", "quantity", line().cast("decimal(18,2)").alias("line_total"))


@query("lake_run_summary", f"SELECT count(*) AS orders, count(DISTINCT customer_id) AS customers, {SPENT} AS revenue, min(order_date) AS first_day, max(order_date) AS last_day FROM v_orders")
def _(v):
    c = v("v_orders").groupBy("customer_id").agg(n().alias("k"), F.sum("total_amount").alias("s"), F.min("order_date").alias("a"), F.max("order_date").alias("b"))
    return c.agg(F.sum("k").alias("orders"), n().alias("customers"), total("s", "revenue"), F.min("a").alias("first_day"), F.max("b").alias("last_day"))


@query("join_star_multi", f"SELECT region, category, count(*) AS lines, {LINE} AS revenue FROM v_items JOIN v_orders USING (order_id) JOIN v_products USING (product_id) JOIN v_customers USING (customer_id) JOIN v_nations USING (nation_key) JOIN v_regions USING (region_key) GROUP BY 1, 2")
def _(v):
    return geo(v).join(v("v_items"), "order_id").join(v("v_products"), "product_id").groupBy("region", "category").agg(n().alias("lines"), line_total())


# ------------------------------------------------------------------ windows


@query("lead", "SELECT order_id, lead(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS next_date FROM v_orders")
def _(v):
    return v("v_orders").select("order_id", F.lead("order_date").over(Window.partitionBy("customer_id").orderBy("order_date", "order_id")).alias("next_date"))


def by_price():
    return Window.partitionBy("category").orderBy(F.desc("price"))


@query("rank", "SELECT product_id, rank() OVER (PARTITION BY category ORDER BY price DESC) AS place FROM v_products")
def _(v):
    return v("v_products").select("product_id", F.rank().over(by_price()).cast("long").alias("place"))


@query("dense_rank", "SELECT product_id, dense_rank() OVER (PARTITION BY category ORDER BY price DESC) AS place FROM v_products")
def _(v):
    return v("v_products").select("product_id", F.dense_rank().over(by_price()).cast("long").alias("place"))


@query("percent_rank", "SELECT product_id, round(percent_rank() OVER (PARTITION BY category ORDER BY price DESC), 6) AS place FROM v_products")
def _(v):
    return v("v_products").select("product_id", F.round(F.percent_rank().over(by_price()), 6).alias("place"))


@query("row_number", "SELECT product_id, row_number() OVER (PARTITION BY category ORDER BY price DESC, product_id) AS place FROM v_products")
def _(v):
    return v("v_products").select("product_id", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("price"), "product_id")).cast("long").alias("place"))


@query("lag", "SELECT order_id, lag(total_amount, 2) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS two_before FROM v_orders")
def _(v):
    return v("v_orders").select("order_id", F.lag("total_amount", 2).over(Window.partitionBy("customer_id").orderBy("order_date", "order_id")).alias("two_before"))


@query("min_periods", "SELECT order_id, CASE WHEN count(*) OVER w >= 3 THEN CAST(sum(total_amount) OVER w AS DECIMAL(28,2)) END AS last3 FROM v_orders WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id ROWS 2 PRECEDING)")
def _(v):
    w = Window.partitionBy("customer_id").orderBy("order_date", "order_id").rowsBetween(-2, 0)
    return v("v_orders").select("order_id", F.when(n().over(w) >= 3, F.sum("total_amount").over(w).cast("decimal(28,2)")).alias("last3"))


@query("zscore_standardize", "SELECT product_id, round((CAST(price AS DOUBLE) - m) / s, 4) AS z FROM v_products, (SELECT avg(CAST(price AS DOUBLE)) AS m, stddev_samp(CAST(price AS DOUBLE)) AS s FROM v_products)")
def _(v):
    p = v("v_products").select("product_id", F.col("price").cast("double").alias("price"))
    stats = F.broadcast(p.agg(F.avg("price").alias("m"), F.stddev_samp("price").alias("s")))  # one row
    return p.crossJoin(stats).select("product_id", F.when(F.col("s") == 0, 0.0).otherwise(F.round((F.col("price") - F.col("m")) / F.col("s"), 4)).alias("z"))


@query("nullcheck_table", "SELECT product_id, nullif(CASE WHEN product_id % 5 = 0 THEN '' ELSE brand END, '') AS brand, nullif(category, '') AS category FROM v_products")
def _(v):
    p = v("v_products").select("product_id", F.when(F.col("product_id") % 5 == 0, "").otherwise(F.col("brand")).alias("brand"), "category")
    return p.select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in p.schema])


@query("decode_json_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM v_events")
def _(v):
    return v("v_events").select("event_id", F.from_json("props", "k LONG").alias("x")).select("event_id", "x.k")


