"""Product, category and geographic marts, and facts; each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import cleaning as K
from ledgerloom.operators import windows
from ledgerloom.sources.scratch import materialize
from ledgerloom.streaming import events as S

from .cleaning import cut_sql
from .marts import AGE, A, M, R, every, flagged, mean, money, n, now, ratio
from .retail import AS_OF, query
from .views import done

PERF = f"SELECT product_id, count(*) AS times_ordered, sum(quantity)::BIGINT AS total_quantity_sold, count(DISTINCT order_id) AS unique_orders, {M.format('total_price', 'total_revenue')}, {M.format('profit_amount', 'total_profit')}, {A.format('unit_price', 'avg_selling_price')}, {A.format('discount_percent', 'avg_discount_given')}, {M.format('discount_amount', 'total_discount_amount')}, round(avg(profit_margin), 8) AS avg_profit_margin, min(unit_price) AS min_selling_price, max(unit_price) AS max_selling_price FROM e_items GROUP BY 1"


def by_product(lines: DataFrame):
    """Lines grouped by product, which meet as they are, in few bytes: aggregates by product and each of what is counted once are wider, and no fewer, than the lines."""
    return lines.repartition("product_id").groupBy("product_id")


def performance(items: DataFrame) -> DataFrame:
    return by_product(items).agg(
        n().alias("times_ordered"), F.sum("quantity").alias("total_quantity_sold"), F.countDistinct("order_id").alias("unique_orders"), money("total_price", "total_revenue"), money("profit_amount", "total_profit"), mean("unit_price").alias("avg_selling_price"), mean("discount_percent").alias("avg_discount_given"),
        money("discount_amount", "total_discount_amount"), F.round(F.avg("profit_margin"), 8).alias("avg_profit_margin"), F.min("unit_price").alias("min_selling_price"), F.max("unit_price").alias("max_selling_price"),
    )


@query("product_performance_mart", f"""WITH p AS ({PERF}), r AS (SELECT *, dense_rank() OVER (ORDER BY total_revenue DESC) AS revenue_rank, dense_rank() OVER (ORDER BY total_quantity_sold DESC) AS quantity_rank, dense_rank() OVER (ORDER BY total_profit DESC) AS profit_rank, ntile(100) OVER (ORDER BY total_revenue, product_id)::INT AS revenue_percentile FROM p)
SELECT r.*, revenue_rank <= 100 AS is_top_seller, quantity_rank > max(quantity_rank) OVER () * 0.9 AS is_slow_mover, name, category, brand, cost FROM r LEFT JOIN v_products USING (product_id)""")
def _(v):
    r = windows.global_orders(performance(v("e_items")), "product_id", {"quantity_rank": ("total_quantity_sold", "dense_rank"), "profit_rank": ("total_profit", "dense_rank"), "revenue_rank": ("total_revenue", "dense_rank"), "_place": ("total_revenue", "row_number"), "_rows": ("total_revenue", "rows"), "_last": ("total_quantity_sold", "distinct")})
    # the place in ascending order, ties by the smaller id, from that in descending order
    r = r.withColumn("revenue_percentile", windows.tile(F.col("_rows") - F.col("_place") + 1, F.col("_rows"), 100))
    r = r.withColumn("is_top_seller", F.col("revenue_rank") <= 100).withColumn("is_slow_mover", F.col("quantity_rank") > F.col("_last") * 0.9).drop("_place", "_rows", "_last")
    return r.join(v("v_products").select("product_id", "name", "category", "brand", "cost"), "product_id", "left")


@query("ntile", "SELECT product_id, ntile(100) OVER (ORDER BY price DESC, product_id DESC)::INT AS tile FROM v_products")
def _(v):
    r = windows.global_orders(v("v_products").select("product_id", "price"), "product_id", {"place": ("price", "row_number"), "rows": ("price", "rows")})
    return r.select("product_id", windows.tile(F.col("place"), F.col("rows"), 100).alias("tile"))


SUMMARY = f"SELECT product_id, count(*) AS times_ordered, sum(quantity)::BIGINT AS total_quantity_sold, count(DISTINCT order_id) AS unique_orders, count(DISTINCT customer_id) AS unique_customers, {M.format('total_price', 'total_revenue')}, {A.format('unit_price', 'avg_selling_price')}, {M.format('profit_amount', 'total_profit')}, round(avg(profit_margin), 8) AS avg_profit_margin, {M.format('discount_amount', 'total_discounts_given')}, min(order_date) AS first_order_date, max(order_date) AS last_order_date FROM e_items JOIN (SELECT order_id, order_date, customer_id FROM v_orders) o USING (order_id) GROUP BY 1"


@query("product_performance_summary", f"WITH p AS ({SUMMARY}) SELECT p.*, dense_rank() OVER (ORDER BY total_revenue DESC) AS revenue_rank, dense_rank() OVER (ORDER BY total_quantity_sold DESC) AS quantity_rank, name, category, brand FROM p LEFT JOIN v_products USING (product_id)")
def _(v):
    # an order that occurs for several customers counts once, with the first of them
    o = v("v_orders").select("order_id", "order_date", "customer_id").withColumn("first", F.row_number().over(Window.partitionBy("order_id").orderBy("customer_id")) == 1)
    of = ("quantity", "total_price", "unit_price", "profit_amount", "profit_margin", "discount_amount")
    lines = v("e_items").join(o, "order_id").select("product_id", "customer_id", "order_id", "order_date", "first", *of).repartition("product_id")
    # lines of one order, then those of one customer, then all of a product, without moving again
    k = lines.groupBy("product_id", "customer_id", "order_id").agg(F.max("first").cast("int").alias("orders"), n().alias("k"), *[F.sum(c).alias(c) for c in of], *[F.count(c).alias(f"n_{c}") for c in ("unit_price", "profit_margin")], F.min("order_date").alias("since"), F.max("order_date").alias("until"))
    sums = ("orders", "k", *of, "n_unit_price", "n_profit_margin")
    c = k.groupBy("product_id", "customer_id").agg(*[F.sum(x).alias(x) for x in sums], F.min("since").alias("since"), F.max("until").alias("until"))
    p = c.groupBy("product_id").agg(
        F.sum("k").alias("times_ordered"), F.sum("quantity").alias("total_quantity_sold"), F.sum("orders").alias("unique_orders"), F.count("customer_id").alias("unique_customers"), money("total_price", "total_revenue"), ratio(F.sum("unit_price"), F.sum("n_unit_price")).alias("avg_selling_price"), money("profit_amount", "total_profit"),
        F.round(F.try_divide(F.sum("profit_margin"), F.sum("n_profit_margin")), 8).alias("avg_profit_margin"), money("discount_amount", "total_discounts_given"), F.min("since").alias("first_order_date"), F.max("until").alias("last_order_date"),
    )
    r = windows.global_orders(p, "product_id", {"revenue_rank": ("total_revenue", "dense_rank"), "quantity_rank": ("total_quantity_sold", "dense_rank")})
    return r.join(v("v_products").select("product_id", "name", "category", "brand"), "product_id", "left")


@query("product_summary", f"""WITH p AS (SELECT product_id, count(*) AS total_orders, sum(quantity)::BIGINT AS total_quantity_sold, {M.format('total_price', 'total_revenue')}, count(DISTINCT customer_id) AS unique_customers, min(order_date) AS first_sale_date, max(order_date) AS last_sale_date FROM e_items JOIN (SELECT order_id, order_date, customer_id FROM v_orders) o USING (order_id) GROUP BY 1)
SELECT *, {R.format('total_quantity_sold', 'total_orders')} AS avg_quantity_per_order, {R.format('total_revenue', 'total_quantity_sold')} AS revenue_per_unit, {AGE.format('first_sale_date')}::INT AS days_since_first_sale, {AGE.format('last_sale_date')}::INT AS days_since_last_sale, {cut_sql('total_revenue', *K.REVENUE)} AS performance_tier FROM p""")
def _(v):
    p = by_product(v("e_items").join(v("v_orders").select("order_id", "order_date", "customer_id"), "order_id")).agg(n().alias("total_orders"), F.sum("quantity").alias("total_quantity_sold"), money("total_price", "total_revenue"), F.countDistinct("customer_id").alias("unique_customers"), F.min("order_date").alias("first_sale_date"), F.max("order_date").alias("last_sale_date"))
    return p.select("*", ratio("total_quantity_sold", "total_orders").alias("avg_quantity_per_order"), ratio("total_revenue", "total_quantity_sold").alias("revenue_per_unit"), F.date_diff(now(), "first_sale_date").alias("days_since_first_sale"), F.date_diff(now(), "last_sale_date").alias("days_since_last_sale"), C.bucketize_right_closed(F.col("total_revenue"), *K.REVENUE).alias("performance_tier"))


NET = "(SELECT *, CAST(subtotal - discount_amount AS DECIMAL(18,2)) AS net_amount FROM e_items)"
DIM = f"""SELECT product_id, name AS product_name, category, brand, coalesce(q, 0)::BIGINT AS total_quantity_sold, coalesce(r, 0)::DECIMAL(28,2) AS total_revenue, coalesce(t, 0) AS times_ordered, avg_quantity_per_order, avg_selling_price, unique_orders FROM v_products LEFT JOIN (SELECT product_id, sum(quantity) AS q, sum(net_amount) AS r, count(*) AS t, {A.format('quantity', 'avg_quantity_per_order')}, {A.format('unit_price', 'avg_selling_price')}, count(DISTINCT order_id) AS unique_orders FROM {NET} GROUP BY 1) m USING (product_id)"""


def dim_products(v) -> DataFrame:
    """Products with what they sold; those without sales at 0."""
    net = F.col("subtotal") - F.col("discount_amount")
    m = by_product(v("e_items")).agg(F.sum("quantity").alias("q"), F.sum(net).alias("r"), n().alias("t"), mean("quantity").alias("avg_quantity_per_order"), mean("unit_price").alias("avg_selling_price"), F.countDistinct("order_id").alias("unique_orders"))
    return v("v_products").join(m, "product_id", "left").select("product_id", F.col("name").alias("product_name"), "category", "brand", F.coalesce("q", F.lit(0)).cast("long").alias("total_quantity_sold"), F.coalesce("r", F.lit(0)).cast("decimal(28,2)").alias("total_revenue"), F.coalesce("t", F.lit(0)).cast("long").alias("times_ordered"), "avg_quantity_per_order", "avg_selling_price", "unique_orders")


@query("gold_dim_products", f"WITH d AS ({DIM}), r AS (SELECT *, dense_rank() OVER (ORDER BY total_revenue DESC) AS revenue_rank, dense_rank() OVER (ORDER BY total_quantity_sold DESC) AS quantity_rank, percent_rank() OVER (ORDER BY total_revenue DESC) AS revenue_percentile FROM d) SELECT *, CASE WHEN revenue_percentile <= 0.1 THEN 'Top 10%' WHEN revenue_percentile <= 0.25 THEN 'Top 25%' WHEN revenue_percentile <= 0.5 THEN 'Top 50%' ELSE 'Bottom 50%' END AS performance_tier FROM r")
def _(v):
    r = windows.global_orders(dim_products(v), "product_id", {"revenue_rank": ("total_revenue", "dense_rank"), "quantity_rank": ("total_quantity_sold", "dense_rank"), "_rank": ("total_revenue", "rank"), "_rows": ("total_revenue", "rows")})
    share = (F.col("_rank") - 1).cast("double") / F.greatest(F.col("_rows") - 1, F.lit(1)).cast("double")
    x = F.col("revenue_percentile")
    return r.withColumn("revenue_percentile", share).drop("_rank", "_rows").withColumn("performance_tier", F.when(x <= 0.1, "Top 10%").when(x <= 0.25, "Top 25%").when(x <= 0.5, "Top 50%").otherwise("Bottom 50%"))


@query("gold_product_performance", f"WITH d AS ({DIM}), m AS (SELECT product_id, year(order_date) AS y, month(order_date) AS mo, sum(quantity) AS q, CAST(sum(net_amount) AS DECIMAL(28,2)) AS r FROM {NET} JOIN (SELECT order_id, order_date FROM v_orders) o USING (order_id) GROUP BY 1, 2, 3) SELECT d.product_id, product_name, category, brand, total_quantity_sold, total_revenue, dense_rank() OVER (ORDER BY total_revenue DESC) AS revenue_rank, avg_monthly_revenue, best_month_revenue, worst_month_revenue FROM d LEFT JOIN (SELECT product_id, {A.format('r', 'avg_monthly_revenue')}, max(r) AS best_month_revenue, min(r) AS worst_month_revenue FROM m GROUP BY 1) USING (product_id)")
def _(v):
    months = v("e_items").join(v("v_orders").select("order_id", "order_date"), "order_id").groupBy("product_id", F.trunc("order_date", "month").alias("month")).agg(money(F.col("subtotal") - F.col("discount_amount"), "r"))
    best = months.groupBy("product_id").agg(mean("r").alias("avg_monthly_revenue"), F.max("r").alias("best_month_revenue"), F.min("r").alias("worst_month_revenue"))
    d = dim_products(v).select("product_id", "product_name", "category", "brand", "total_quantity_sold", "total_revenue")
    return windows.global_orders(d, "product_id", {"revenue_rank": ("total_revenue", "dense_rank")}).join(best, "product_id", "left")


@query("gold_fact_orders", "WITH i AS (SELECT order_id, count(*) AS k, sum(quantity) AS q, sum(discount_amount) AS d, count(DISTINCT product_id) AS u FROM e_items GROUP BY 1) SELECT order_id, customer_id, order_date, total_amount, coalesce(k, 0) AS line_item_count, coalesce(q, 0)::BIGINT AS total_quantity, CAST(coalesce(d, 0) AS DECIMAL(28,2)) AS total_discount, coalesce(u, 0) AS unique_products, CAST(total_amount - coalesce(d, 0) AS DECIMAL(28,2)) AS net_revenue FROM v_orders LEFT JOIN i USING (order_id)")
def _(v):
    i = v("e_items").groupBy("order_id").agg(n().alias("k"), F.sum("quantity").alias("q"), F.sum("discount_amount").alias("d"), F.countDistinct("product_id").alias("u"))
    zero = lambda c, t="long": F.coalesce(c, F.lit(0)).cast(t)
    return v("v_orders").join(i, "order_id", "left").select("order_id", "customer_id", "order_date", "total_amount", zero("k").alias("line_item_count"), zero("q").alias("total_quantity"), zero("d", "decimal(28,2)").alias("total_discount"), zero("u").alias("unique_products"), (F.col("total_amount") - F.coalesce("d", F.lit(0))).cast("decimal(28,2)").alias("net_revenue"))


@query("order_item_rollup", "SELECT order_id, item_count, total_quantity, items_subtotal, total_discount, total_tax, items_total, order_profit, round(avg_profit_margin, 6) AS avg_profit_margin, array_to_string(product_ids, ',') AS product_ids, min_item_price, max_item_price, avg_item_price FROM e_rollup")
def _(v):
    return v("e_rollup").withColumn("avg_profit_margin", F.round("avg_profit_margin", 6)).withColumn("product_ids", F.array_join(F.col("product_ids").cast("array<string>"), ","))


@query("category_performance_mart", f"WITH c AS (SELECT category, count(DISTINCT product_id) AS products_count, sum(quantity)::BIGINT AS total_quantity_sold, {M.format('total_price', 'total_revenue')}, {M.format('profit_amount', 'total_profit')}, count(DISTINCT order_id) AS total_orders, round(avg(profit_margin), 8) AS avg_profit_margin, {A.format('unit_price', 'avg_item_price')} FROM e_items LEFT JOIN (SELECT product_id, category FROM v_products) p USING (product_id) GROUP BY 1) SELECT *, CAST(total_revenue AS DOUBLE) / CAST(sum(total_revenue) OVER () AS DOUBLE) * 100 AS revenue_share, dense_rank() OVER (ORDER BY total_revenue DESC) AS category_rank FROM c")
def _(v):
    c = v("e_items").join(v("v_products").select("product_id", "category"), "product_id", "left").groupBy("category").agg(F.countDistinct("product_id").alias("products_count"), F.sum("quantity").alias("total_quantity_sold"), money("total_price", "total_revenue"), money("profit_amount", "total_profit"), F.countDistinct("order_id").alias("total_orders"), F.round(F.avg("profit_margin"), 8).alias("avg_profit_margin"), mean("unit_price").alias("avg_item_price"))
    # a row per category
    return c.select("*", ratio("total_revenue", F.sum("total_revenue").over(every()), 100).alias("revenue_share"), F.dense_rank().over(Window.orderBy(F.desc("total_revenue"))).cast("long").alias("category_rank"))


GEO = "v_orders JOIN v_customers USING (customer_id) JOIN v_nations USING (nation_key) JOIN v_regions USING (region_key)"


def geo(v) -> DataFrame:
    # nations and regions have a fixed number of rows; the planner broadcasts them
    return v("v_orders").join(v("v_customers"), "customer_id").join(v("v_nations"), "nation_key").join(v("v_regions"), "region_key")


@query("geographic_sales_mart", f"WITH g AS (SELECT nation AS country, region, segment AS city, count(order_id) AS total_orders, count(DISTINCT customer_id) AS unique_customers, {M.format('total_amount', 'total_revenue')}, {A.format('total_amount', 'avg_order_value')}, count(*) FILTER (status IN ('completed','delivered','shipped')) AS completed_orders FROM {GEO} GROUP BY 1, 2, 3) SELECT *, {R.format('completed_orders', 'total_orders')} * 100 AS completion_rate, dense_rank() OVER (ORDER BY total_revenue DESC) AS revenue_rank FROM g")
def _(v):
    g = geo(v).groupBy(F.col("nation").alias("country"), "region", F.col("segment").alias("city")).agg(n().alias("total_orders"), F.countDistinct("customer_id").alias("unique_customers"), money("total_amount", "total_revenue"), mean("total_amount").alias("avg_order_value"), flagged(done(), "completed_orders"))
    # a row per place
    return g.select("*", ratio("completed_orders", "total_orders", 100).alias("completion_rate"), F.dense_rank().over(Window.orderBy(F.desc("total_revenue"))).cast("long").alias("revenue_rank"))


@query("dim_geography", "SELECT DISTINCT trim(city) AS city, trim(state) AS state, trim(country) AS country, left(zip_code, 5) AS zip_code FROM d_customers")
def _(v):
    return v("d_customers").select(F.trim("city").alias("city"), F.trim("state").alias("state"), F.trim("country").alias("country"), F.substring("zip_code", 1, 5).alias("zip_code")).distinct()


@query("orders_with_item_counts", "SELECT order_id, customer_id, order_date, total_amount, coalesce(k, 0) AS item_count, CAST(coalesce(d, 0) AS DECIMAL(28,2)) AS total_discount FROM v_orders LEFT JOIN (SELECT order_id, count(*) AS k, sum(discount_amount) AS d FROM e_items GROUP BY 1) USING (order_id)")
def _(v):
    i = v("e_items").groupBy("order_id").agg(n().alias("k"), F.sum("discount_amount").alias("d"))
    return v("v_orders").join(i, "order_id", "left").select("order_id", "customer_id", "order_date", "total_amount", F.coalesce("k", F.lit(0)).cast("long").alias("item_count"), F.coalesce("d", F.lit(0)).cast("decimal(28,2)").alias("total_discount"))


# ------------------------------------------------------------------ warehouse marts

SALES = f"""SELECT order_date AS full_date, count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS unique_customers, sum(item_count)::BIGINT AS total_items, {M.format('total_amount - tax_amount - shipping_amount', 'gross_revenue')}, {M.format('total_amount', 'net_revenue')}, {M.format('total_discount', 'total_discounts')}, {M.format('tax_amount', 'total_tax')}, {M.format('shipping_amount', 'total_shipping')}, {M.format('order_profit', 'total_profit')},
  {A.format('total_amount', 'avg_order_value')}, {A.format('item_count', 'avg_items_per_order')}, {A.format('total_discount', 'avg_discount')}, count(*) FILTER (status = 'completed') AS completed_orders, count(*) FILTER (status = 'cancelled') AS cancelled_orders, count(*) FILTER (status = 'refunded') AS refunded_orders, count(*) FILTER (NOT is_repeat_customer) AS new_customers, count(*) FILTER (is_repeat_customer) AS repeat_customers FROM e_orders GROUP BY 1"""


def sales(v) -> DataFrame:
    """The warehouse's sales of each day."""
    return v("e_orders").groupBy(F.col("order_date").alias("full_date")).agg(
        n().alias("total_orders"), F.countDistinct("customer_id").alias("unique_customers"), F.sum("item_count").alias("total_items"), money(F.col("total_amount") - F.col("tax_amount") - F.col("shipping_amount"), "gross_revenue"), money("total_amount", "net_revenue"), money("total_discount", "total_discounts"), money("tax_amount", "total_tax"), money("shipping_amount", "total_shipping"), money("order_profit", "total_profit"),
        mean("total_amount").alias("avg_order_value"), mean("item_count").alias("avg_items_per_order"), mean("total_discount").alias("avg_discount"), *[flagged(F.col("status") == s, f"{s}_orders") for s in ("completed", "cancelled", "refunded")], flagged(~F.col("is_repeat_customer"), "new_customers"), flagged("is_repeat_customer", "repeat_customers"),
    )


@query("mart_sales_summary_sql", f"WITH s AS ({SALES}) SELECT *, strftime(full_date, '%Y%m%d')::INT AS date_key, year(full_date) AS year, quarter(full_date) AS quarter, month(full_date) AS month, monthname(full_date) AS month_name, week(full_date) AS week, dayname(full_date) AS day_name, isodow(full_date) >= 6 AS is_weekend FROM s")
def _(v):
    d = F.col("full_date")
    parts = [f(d).cast("long").alias(k) for k, f in (("year", F.year), ("quarter", F.quarter), ("month", F.month), ("week", F.weekofyear))]
    return sales(v).select("*", C.date_key(d).alias("date_key"), *parts, F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "EEEE").alias("day_name"), (F.weekday(d) >= 5).alias("is_weekend"))


@query("vw_daily_kpis", f"WITH s AS ({SALES}) SELECT full_date, total_orders, unique_customers, gross_revenue, net_revenue, total_profit, avg_order_value, new_customers, repeat_customers, coalesce({R.format('repeat_customers', 'unique_customers')} * 100, 0) AS repeat_customer_rate, coalesce({R.format('cancelled_orders', 'total_orders')} * 100, 0) AS cancellation_rate FROM s")
def _(v):
    rate = lambda a, b: F.coalesce(ratio(a, b, 100), F.lit(0.0))
    return sales(v).select("full_date", "total_orders", "unique_customers", "gross_revenue", "net_revenue", "total_profit", "avg_order_value", "new_customers", "repeat_customers", rate("repeat_customers", "unique_customers").alias("repeat_customer_rate"), rate("cancelled_orders", "total_orders").alias("cancellation_rate"))


#: Days before the last order that the windows of the warehouse's marts end at; the data's dates are old.
LAST = "1998-07-20"
RECENT = {days: f"order_date >= DATE '{LAST}' - INTERVAL {days} DAY" for days in (7, 30, 90)}


def recent(days: int):
    return F.col("order_date") >= F.date_sub(F.lit(LAST).cast("date"), days)


PRODUCT = f"""SELECT product_id, name AS product_name, category, brand, price, count(DISTINCT order_id) AS total_orders, sum(quantity)::BIGINT AS total_units_sold, {M.format('total_price', 'total_revenue')}, {M.format('profit_amount', 'total_profit')}, {A.format('unit_price', 'avg_selling_price')}, {A.format('discount_percent', 'avg_discount_percent')},
  {', '.join(f"count(DISTINCT CASE WHEN {c} THEN order_id END) AS orders_last_{d}d, sum(CASE WHEN {c} THEN quantity ELSE 0 END)::BIGINT AS units_sold_last_{d}d, CAST(sum(CASE WHEN {c} THEN total_price ELSE 0 END) AS DECIMAL(28,2)) AS revenue_last_{d}d" for d, c in RECENT.items() if d < 90)}
  FROM v_products LEFT JOIN (SELECT e.* EXCLUDE (tax_amount), o.order_date FROM e_items e JOIN v_orders o ON o.order_id = e.order_id) USING (product_id) GROUP BY 1, 2, 3, 4, 5"""


def product_mart(v) -> DataFrame:
    i = v("e_items").join(v("v_orders").select("order_id", "order_date"), "order_id")
    new = [F.when(recent(d), F.col(c)).otherwise(0).alias(f"{c}_{d}") for d in (7, 30) for c in ("quantity", "total_price")]
    lines = i.select("product_id", "order_id", "quantity", "total_price", "profit_amount", "unit_price", "discount_percent", "order_date").repartition("product_id")
    # an order's lines of a product first: it counts once, and as recent if one of them is
    of = ("quantity", "total_price", "profit_amount", "unit_price", "discount_percent")
    one = lines.select("*", *new).groupBy("product_id", "order_id").agg(*[F.sum(c).alias(c) for c in (*of, *[f"{c}_{d}" for d in (7, 30) for c in of[:2]])], *[F.count(c).alias(f"n_{c}") for c in of[3:]], *[F.max(recent(d)).alias(f"recent_{d}") for d in (7, 30)])
    parts = []
    for d in (7, 30):
        parts += [F.count_if(f"recent_{d}").alias(f"orders_last_{d}d"), F.sum(f"quantity_{d}").alias(f"units_sold_last_{d}d"), money(f"total_price_{d}", f"revenue_last_{d}d")]
    average = lambda c: ratio(F.sum(c), F.sum(f"n_{c}"))
    m = one.groupBy("product_id").agg(n().alias("total_orders"), F.sum("quantity").alias("total_units_sold"), money("total_price", "total_revenue"), money("profit_amount", "total_profit"), average("unit_price").alias("avg_selling_price"), average("discount_percent").alias("avg_discount_percent"), *parts)
    p = v("v_products").select("product_id", F.col("name").alias("product_name"), "category", "brand", "price").join(m, "product_id", "left")
    counts = [c for c in m.columns if c.startswith(("total_orders", "orders_last", "units_sold_last", "revenue_last"))]
    return p.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(m.schema[c].dataType)) for c in counts})


def product_ranks(v) -> DataFrame:
    """The warehouse's products with their places by revenue, by units, and within their category."""
    r = windows.global_orders(product_mart(v), "product_id", {"revenue_rank": ("total_revenue", "rank"), "units_sold_rank": ("total_units_sold", "rank")})
    return r.withColumn("category_revenue_rank", F.rank().over(Window.partitionBy("category").orderBy(F.desc_nulls_last("total_revenue"))).cast("long"))


@query("mart_product_performance_sql", f"WITH p AS ({PRODUCT}) SELECT *, rank() OVER (ORDER BY total_revenue DESC NULLS LAST) AS revenue_rank, rank() OVER (ORDER BY total_units_sold DESC NULLS LAST) AS units_sold_rank, rank() OVER (PARTITION BY category ORDER BY total_revenue DESC NULLS LAST) AS category_revenue_rank FROM p")
def _(v):
    return product_ranks(v)


@query("vw_top_products", f"WITH p AS ({PRODUCT}), r AS (SELECT *, rank() OVER (ORDER BY total_revenue DESC NULLS LAST) AS revenue_rank FROM p) SELECT product_name, category, brand, price, total_orders, total_units_sold, total_revenue, total_profit, revenue_rank, revenue_last_30d, units_sold_last_30d FROM r WHERE revenue_rank <= 100")
def _(v):
    r = windows.global_orders(product_mart(v), "product_id", {"revenue_rank": ("total_revenue", "rank")}).where("revenue_rank <= 100")
    return r.select("product_name", "category", "brand", "price", "total_orders", "total_units_sold", "total_revenue", "total_profit", "revenue_rank", "revenue_last_30d", "units_sold_last_30d")


@query("mv_product_performance", f"SELECT product_id, name, category, brand, count(DISTINCT order_id) AS total_orders, sum(quantity)::BIGINT AS total_units, {M.format('total_price', 'total_revenue')}, {M.format('profit_amount', 'total_profit')}, round(avg(profit_margin), 8) AS avg_margin FROM v_products LEFT JOIN (SELECT * EXCLUDE (tax_amount) FROM e_items) USING (product_id) GROUP BY 1, 2, 3, 4")
def _(v):
    m = by_product(v("e_items")).agg(F.countDistinct("order_id").alias("k"), F.sum("quantity").alias("total_units"), money("total_price", "total_revenue"), money("profit_amount", "total_profit"), F.round(F.avg("profit_margin"), 8).alias("avg_margin"))
    return v("v_products").join(m, "product_id", "left").select("product_id", "name", "category", "brand", F.coalesce("k", F.lit(0)).cast("long").alias("total_orders"), "total_units", "total_revenue", "total_profit", "avg_margin")


CUSTOMER = f"""WITH o AS (SELECT customer_id, count(*) AS total_orders, {M.format('total_amount', 'total_spent')}, {A.format('total_amount', 'avg_order_value')}, sum(item_count)::BIGINT AS total_items_purchased, min(order_date) AS first_order_date, max(order_date) AS last_order_date, mode() WITHIN GROUP (ORDER BY payment_method) AS m0,
  {', '.join(f"count(*) FILTER ({RECENT[d]}) AS orders_last_{d}d, CAST(sum(CASE WHEN {RECENT[d]} THEN total_amount ELSE 0 END) AS DECIMAL(28,2)) AS spent_last_{d}d" for d in (30, 90))}, count(*) FILTER (year(order_date) = {LAST[:4]}) AS orders_ytd, CAST(sum(CASE WHEN year(order_date) = {LAST[:4]} THEN total_amount ELSE 0 END) AS DECIMAL(28,2)) AS spent_ytd FROM e_orders GROUP BY 1),
pay AS (SELECT customer_id, payment_method AS preferred_payment FROM (SELECT customer_id, payment_method, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, payment_method) AS rn FROM v_orders GROUP BY 1, 2) WHERE rn = 1),
lines AS (SELECT customer_id, category, brand FROM v_items i JOIN v_orders o ON o.order_id = i.order_id JOIN v_products p ON p.product_id = i.product_id),
cat AS (SELECT customer_id, category AS favorite_category FROM (SELECT customer_id, category, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, category) AS rn FROM lines GROUP BY 1, 2) WHERE rn = 1),
bra AS (SELECT customer_id, brand AS favorite_brand FROM (SELECT customer_id, brand, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, brand) AS rn FROM lines GROUP BY 1, 2) WHERE rn = 1)
SELECT c.customer_id, c.name AS full_name, c.segment AS customer_segment, datediff('month', c.registered_on, DATE '{LAST}')::INT AS tenure_months, o.* EXCLUDE (customer_id, m0), date_diff('day', last_order_date, DATE '{LAST}')::INT AS days_since_last_order, favorite_category, favorite_brand, preferred_payment
FROM v_customers c LEFT JOIN o USING (customer_id) LEFT JOIN pay USING (customer_id) LEFT JOIN cat USING (customer_id) LEFT JOIN bra USING (customer_id)"""


def favourite(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The most frequent value per key, ties by the smallest: counted first, so a key's values are few."""
    return df.groupBy(key, value).agg(n().alias("k")).groupBy(key).agg(F.min(F.struct(-F.col("k"), value)).getField(value).alias(name))


def favourites(df: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """The most frequent value of each of several text columns per key, ties by the smallest, from one pass over the rows."""
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("of"), F.col(c).alias("value")) for i, c in enumerate(names)]))
    # rows move as they are, in few bytes: counts by key and value are no fewer, and each row counts several times
    counts = df.select(key, *names).repartition(key).select(key, each).groupBy(key, "of", "value").agg(n().alias("k"))
    best = F.min_by("value", F.struct(-F.col("k"), "value"))
    return counts.groupBy(key, "of").agg(best.alias("value")).groupBy(key).agg(*[F.max(F.when(F.col("of") == i, F.col("value"))).alias(a) for i, a in enumerate(names.values())])


def customer_mart(v) -> DataFrame:
    parts = []
    for d in (30, 90):
        parts += [flagged(recent(d), f"orders_last_{d}d"), money(F.when(recent(d), F.col("total_amount")).otherwise(0), f"spent_last_{d}d")]
    ytd = F.year("order_date") == int(LAST[:4])
    o = v("e_orders").groupBy("customer_id").agg(n().alias("total_orders"), money("total_amount", "total_spent"), mean("total_amount").alias("avg_order_value"), F.sum("item_count").alias("total_items_purchased"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"), *parts, flagged(ytd, "orders_ytd"), money(F.when(ytd, F.col("total_amount")).otherwise(0), "spent_ytd"))
    lines = v("v_items").select("order_id", "product_id").join(v("v_orders").select("order_id", "customer_id"), "order_id").join(v("v_products").select("product_id", "category", "brand"), "product_id")
    last = F.lit(LAST).cast("date")
    months = ((F.year(last) - F.year("registered_on")) * 12 + F.month(last) - F.month("registered_on")).cast("int")
    x = v("v_customers").select("customer_id", F.col("name").alias("full_name"), F.col("segment").alias("customer_segment"), months.alias("tenure_months")).join(o, "customer_id", "left").withColumn("days_since_last_order", F.date_diff(last, "last_order_date"))
    return x.join(favourites(lines, "customer_id", {"category": "favorite_category", "brand": "favorite_brand"}), "customer_id", "left").join(favourite(v("v_orders"), "customer_id", "payment_method", "preferred_payment"), "customer_id", "left")


query("mart_customer_analytics_sql", CUSTOMER)(customer_mart)


@query("vw_customer_segments", f"WITH c AS ({CUSTOMER}) SELECT customer_segment, count(*) AS customer_count, {A.format('total_orders', 'avg_orders')}, {A.format('total_spent', 'avg_total_spent')}, round(avg(avg_order_value), 8) AS avg_order_value, {A.format('days_since_last_order', 'avg_days_since_order')} FROM c GROUP BY 1")
def _(v):
    return customer_mart(v).groupBy("customer_segment").agg(n().alias("customer_count"), mean("total_orders").alias("avg_orders"), mean("total_spent").alias("avg_total_spent"), F.round(F.avg("avg_order_value"), 8).alias("avg_order_value"), mean("days_since_last_order").alias("avg_days_since_order"))


CATEGORY = f"""WITH m AS (SELECT category, year(order_date) AS year, month(order_date) AS month, count(DISTINCT product_id) AS product_count, count(DISTINCT brand) AS brand_count, {A.format('price', 'avg_price')}, count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS unique_customers, sum(quantity)::BIGINT AS total_units_sold, {M.format('total_price', 'total_revenue')}, {M.format('profit_amount', 'total_profit')}, {A.format('total_price', 'avg_order_value')}, {A.format('discount_percent', 'avg_discount_percent')}, {M.format('discount_amount', 'total_discounts')} FROM e_items JOIN (SELECT order_id, order_date, customer_id FROM v_orders) o USING (order_id) JOIN (SELECT product_id, category, brand, price FROM v_products) p USING (product_id) GROUP BY 1, 2, 3)
SELECT *, CAST(total_revenue AS DOUBLE) / nullif(CAST(sum(total_revenue) OVER (PARTITION BY year, month) AS DOUBLE), 0) * 100 AS revenue_share_pct, lag(total_revenue) OVER w AS prev_month_revenue, {R.format('total_revenue - lag(total_revenue) OVER w', 'lag(total_revenue) OVER w')} * 100 AS revenue_growth_pct FROM m WINDOW w AS (PARTITION BY category ORDER BY year, month)"""


def order_counts(v, o: DataFrame, keys: list[str]) -> DataFrame:
    """How many different orders and customers per category and month: an order goes once for each category to its customer's place, where both count."""
    of = v("e_items").select("order_id", "product_id").join(v("v_products").select("product_id", "category"), "product_id")
    each = of.select("order_id", "category").repartition("order_id").distinct().join(o, "order_id")
    first = F.row_number().over(Window.partitionBy("order_id", *keys).orderBy("customer_id")) == 1
    rows = each.select(*keys, "customer_id", first.cast("int").alias("orders")).repartition(*keys, "customer_id")
    return rows.groupBy(*keys, "customer_id").agg(F.sum("orders").alias("orders")).groupBy(*keys).agg(F.sum("orders").alias("total_orders"), F.count("customer_id").alias("unique_customers"))


def category_mart(v) -> DataFrame:
    keys = ["category", "year", "month"]
    o = v("v_orders").select("order_id", "customer_id", F.year("order_date").cast("long").alias("year"), F.month("order_date").cast("long").alias("month"))
    # counted first, a row a key, so that their shuffle files are gone when the sums move
    counts = materialize(order_counts(v, o, keys))
    x = v("e_items").join(o.drop("customer_id"), "order_id").join(v("v_products").select("product_id", "category", "brand", "price"), "product_id")
    # sums by brand add up before they move and count the brands; lines meet by product, which counts with the first of them
    summed = ("price", "quantity", "total_price", "profit_amount", "discount_percent", "discount_amount")
    first = F.row_number().over(Window.partitionBy("product_id", *keys).orderBy("order_id")) == 1
    lines = x.select("product_id", *keys, "brand", *summed, first.cast("int").alias("product_count"))
    by_brand = lines.groupBy(*keys, "brand").agg(*[F.sum(c).alias(c) for c in ("product_count", *summed)], *[F.count(c).alias(f"{c}_n") for c in ("price", "total_price", "discount_percent")])
    both = by_brand.unionByName(counts, allowMissingColumns=True).groupBy(*keys)  # nulls of either add nothing
    total = lambda c: F.sum(c).cast("decimal(28,2)")
    avg = lambda c: ratio(F.sum(c), F.sum(f"{c}_n"))
    m = both.agg(F.sum("product_count").alias("product_count"), F.count("brand").alias("brand_count"), avg("price").alias("avg_price"), F.sum("total_orders").alias("total_orders"), F.sum("unique_customers").alias("unique_customers"), F.sum("quantity").alias("total_units_sold"), total("total_price").alias("total_revenue"), total("profit_amount").alias("total_profit"), avg("total_price").alias("avg_order_value"), avg("discount_percent").alias("avg_discount_percent"), total("discount_amount").alias("total_discounts"))
    before = F.lag("total_revenue").over(Window.partitionBy("category").orderBy("year", "month"))
    return m.select("*", ratio("total_revenue", F.sum("total_revenue").over(Window.partitionBy("year", "month")), 100).alias("revenue_share_pct"), before.alias("prev_month_revenue"), ratio(F.col("total_revenue") - before, before, 100).alias("revenue_growth_pct"))


query("mart_category_performance_sql", CATEGORY)(category_mart)

GEOGRAPHIC = f"""SELECT nation AS country, region, segment AS city, year(order_date) AS year, quarter(order_date) AS quarter, count(DISTINCT customer_id) AS total_customers, count(DISTINCT CASE WHEN NOT is_repeat_customer THEN customer_id END) AS new_customers, count(DISTINCT order_id) AS total_orders, {M.format('total_amount', 'total_revenue')}, {M.format('order_profit', 'total_profit')}, {A.format('total_amount', 'avg_order_value')}, sum(item_count)::BIGINT AS total_items_sold, {A.format('shipping_amount', 'avg_shipping_cost')}, CAST(sum(date_diff('day', order_date, delivered_on)) AS DOUBLE) / count(*) AS avg_delivery_days,
  CAST(sum(total_amount) AS DOUBLE) / count(DISTINCT customer_id) AS revenue_per_customer, CAST(count(order_id) AS DOUBLE) / count(DISTINCT customer_id) AS orders_per_customer FROM {GEO.replace('v_orders', 'e_orders')} GROUP BY 1, 2, 3, 4, 5"""


def geographic_mart(v) -> DataFrame:
    x = v("e_orders").join(v("v_customers").select("customer_id", "nation_key", "segment"), "customer_id").join(v("v_nations"), "nation_key").join(v("v_regions"), "region_key").withColumn("days", F.date_diff("delivered_on", "order_date"))
    g = x.groupBy(F.col("nation").alias("country"), "region", F.col("segment").alias("city"), F.year("order_date").cast("long").alias("year"), F.quarter("order_date").cast("long").alias("quarter")).agg(F.countDistinct("customer_id").alias("total_customers"), F.countDistinct(F.when(~F.col("is_repeat_customer"), F.col("customer_id"))).alias("new_customers"), n().alias("total_orders"), money("total_amount", "total_revenue"), money("order_profit", "total_profit"), mean("total_amount").alias("avg_order_value"), F.sum("item_count").alias("total_items_sold"), mean("shipping_amount").alias("avg_shipping_cost"), mean("days").alias("avg_delivery_days"))
    return g.select("*", ratio("total_revenue", "total_customers").alias("revenue_per_customer"), ratio("total_orders", "total_customers").alias("orders_per_customer"))


query("mart_geographic_sales_sql", GEOGRAPHIC)(geographic_mart)


@query("product_profit_extract", f"SELECT product_id, name, category, coalesce(units, 0)::BIGINT AS units, CAST(coalesce(revenue, 0) AS DECIMAL(28,2)) AS revenue, CAST(coalesce(cost, 0) AS DECIMAL(28,4)) AS cost, CAST(coalesce(revenue, 0) - coalesce(cost, 0) AS DECIMAL(28,4)) AS gross_profit FROM (SELECT product_id, name, category FROM v_products) p LEFT JOIN (SELECT product_id, sum(quantity) AS units, sum(subtotal) AS revenue, sum(quantity * unit_cost) AS cost FROM e_items JOIN v_orders o USING (order_id) WHERE status NOT IN ('cancelled', 'refunded') GROUP BY 1) USING (product_id)")
def _(v):
    kept = v("v_orders").where(~F.col("status").isin("cancelled", "refunded")).select("order_id")
    m = v("e_items").join(kept, "order_id").groupBy("product_id").agg(F.sum("quantity").alias("units"), F.sum("subtotal").alias("revenue"), F.sum(F.col("quantity") * F.col("unit_cost")).alias("cost"))
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t)
    return v("v_products").select("product_id", "name", "category").join(m, "product_id", "left").select("product_id", "name", "category", zero("units", "long").alias("units"), zero("revenue", "decimal(28,2)").alias("revenue"), zero("cost", "decimal(28,4)").alias("cost"), (zero("revenue", "decimal(28,4)") - zero("cost", "decimal(28,4)")).cast("decimal(28,4)").alias("gross_profit"))


@query("rolling_anomaly", "WITH k AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS events FROM v_events GROUP BY 1), m AS (SELECT *, CAST(sum(events) OVER w AS DOUBLE) / count(*) OVER w AS window_mean FROM k WINDOW w AS (PARTITION BY time_bucket(INTERVAL 10 MINUTE, window_start))) SELECT * FROM m WHERE events > window_mean * 1.2")
def _(v):
    return S.rolling_anomaly(v("v_events"), 1.2)
