"""The analytic workbook; each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import affinity, windows
from ledgerloom.operators.jobs import Mart
from ledgerloom.sources.scratch import materialize

from .marts import RFM, A, M, R, every, flagged, mean, money, n, ratio, rfm
from .products import CATEGORY, CUSTOMER, GEOGRAPHIC, LAST, PERF, SALES, category_mart, customer_mart, geographic_mart, performance, product_ranks, sales
from .retail import query
from .views import enriched_items, enriched_orders

MONTHLY = f"SELECT year(full_date) AS year, month(full_date) AS month, monthname(full_date) AS month_name, CAST(sum(net_revenue) AS DECIMAL(28,2)) AS revenue, CAST(sum(total_orders) AS BIGINT) AS orders, CAST(sum(unique_customers) AS BIGINT) AS customers FROM ({SALES}) GROUP BY 1, 2, 3"


@query("q01_monthly_yoy", f"WITH m AS ({MONTHLY}) SELECT c.year, c.month, c.month_name, c.revenue AS current_revenue, p.revenue AS previous_year_revenue, CAST(c.revenue - coalesce(p.revenue, 0) AS DECIMAL(28,2)) AS revenue_difference, CASE WHEN p.revenue > 0 THEN {R.format('c.revenue - p.revenue', 'p.revenue')} * 100 END AS yoy_growth_pct, c.orders AS current_orders, c.customers AS current_customers FROM m c LEFT JOIN m p ON c.month = p.month AND c.year = p.year + 1")
def _(v):
    d = F.col("full_date")
    m = sales(v).groupBy(F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), F.date_format(d, "MMMM").alias("month_name")).agg(money("net_revenue", "revenue"), F.sum("total_orders").alias("orders"), F.sum("unique_customers").alias("customers"))
    p = m.select((F.col("year") + 1).alias("year"), "month", F.col("revenue").alias("previous_year_revenue"))
    x = m.join(p, ["year", "month"], "left")
    before = F.col("previous_year_revenue")
    return x.select("year", "month", "month_name", F.col("revenue").alias("current_revenue"), before, (F.col("revenue") - F.coalesce(before, F.lit(0))).cast("decimal(28,2)").alias("revenue_difference"), F.when(before > 0, ratio(F.col("revenue") - before, before, 100)).alias("yoy_growth_pct"), F.col("orders").alias("current_orders"), F.col("customers").alias("current_customers"))


@query("q02_moving_averages", f"WITH s AS ({SALES}) SELECT full_date, net_revenue AS daily_revenue, total_orders AS daily_orders, CAST(sum(net_revenue) OVER w6 AS DOUBLE) / count(*) OVER w6 AS ma_7day_revenue, CAST(sum(net_revenue) OVER w29 AS DOUBLE) / count(*) OVER w29 AS ma_30day_revenue, CAST(sum(total_orders) OVER w6 AS DOUBLE) / count(*) OVER w6 AS ma_7day_orders, CAST(net_revenue - lag(net_revenue) OVER w AS DECIMAL(28,2)) AS daily_revenue_change, CAST(net_revenue - lag(net_revenue, 7) OVER w AS DECIMAL(28,2)) AS wow_revenue_change FROM s WINDOW w AS (ORDER BY full_date), w6 AS (ORDER BY full_date ROWS 6 PRECEDING), w29 AS (ORDER BY full_date ROWS 29 PRECEDING)")
def _(v):
    w = Window.orderBy("full_date")  # a row per day
    w6, w29 = w.rowsBetween(-6, 0), w.rowsBetween(-29, 0)
    avg = lambda c, f: F.sum(c).over(f).cast("double") / n().over(f)
    change = lambda k: (F.col("net_revenue") - F.lag("net_revenue", k).over(w)).cast("decimal(28,2)")
    return sales(v).select("full_date", F.col("net_revenue").alias("daily_revenue"), F.col("total_orders").alias("daily_orders"), avg("net_revenue", w6).alias("ma_7day_revenue"), avg("net_revenue", w29).alias("ma_30day_revenue"), avg("total_orders", w6).alias("ma_7day_orders"), change(1).alias("daily_revenue_change"), change(7).alias("wow_revenue_change"))


@query("q03_revenue_by_dow", f"WITH s AS ({SALES}) SELECT dayname(full_date) AS day_name, dayofweek(full_date) AS day_of_week, count(*) AS total_days, CAST(sum(total_orders) AS BIGINT) AS total_orders, {M.format('net_revenue', 'total_revenue')}, {A.format('net_revenue', 'avg_daily_revenue')}, round(avg(avg_order_value), 8) AS avg_order_value, CAST(sum(net_revenue) AS DOUBLE) / CAST(sum(sum(net_revenue)) OVER () AS DOUBLE) * 100 AS revenue_share_pct FROM s GROUP BY 1, 2")
def _(v):
    d = F.col("full_date")
    g = sales(v).groupBy(F.date_format(d, "EEEE").alias("day_name"), (F.dayofweek(d) - 1).cast("long").alias("day_of_week")).agg(n().alias("total_days"), F.sum("total_orders").alias("total_orders"), money("net_revenue", "total_revenue"), mean("net_revenue").alias("avg_daily_revenue"), F.round(F.avg("avg_order_value"), 8).alias("avg_order_value"))
    return g.select("*", ratio("total_revenue", F.sum("total_revenue").over(every()), 100).alias("revenue_share_pct"))


@query("q04_abc_analysis", f"WITH p AS ({PERF}), c AS (SELECT product_id, total_revenue, CAST(sum(total_revenue) OVER () AS DOUBLE) AS total, CAST(sum(total_revenue) OVER (ORDER BY total_revenue DESC RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS run FROM p WHERE total_revenue > 0) SELECT product_id, name, category, brand, total_revenue, CAST(total_revenue AS DOUBLE) / total * 100 AS revenue_pct, run / total * 100 AS cumulative_pct, CASE WHEN run / total <= 0.70 THEN 'A' WHEN run / total <= 0.90 THEN 'B' ELSE 'C' END AS abc_class FROM c JOIN v_products USING (product_id)")
def _(v):
    p = materialize(performance(v("e_items")).select("product_id", "total_revenue").where("total_revenue > 0"))
    r = windows.global_orders(p, "product_id", {"running_sum": ("total_revenue", "running_sum")}, once=False).crossJoin(F.broadcast(p.agg(F.sum("total_revenue").cast("double").alias("total"))))  # one row
    share = F.col("running_sum").cast("double") / F.col("total")
    x = r.join(v("v_products").select("product_id", "name", "category", "brand"), "product_id")
    return x.select("product_id", "name", "category", "brand", "total_revenue", (F.col("total_revenue").cast("double") / F.col("total") * 100).alias("revenue_pct"), (share * 100).alias("cumulative_pct"), F.when(share <= 0.70, "A").when(share <= 0.90, "B").otherwise("C").alias("abc_class"))


def affinity_sql(lines: str, least: int) -> str:
    return f"WITH l AS (SELECT DISTINCT order_id, item FROM ({lines})) SELECT a.item AS item_1, b.item AS item_2, count(*) AS times_bought_together, CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT order_id) FROM l) * 100 AS support_pct FROM l a JOIN l b ON a.order_id = b.order_id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= {least} ORDER BY times_bought_together DESC, 1, 2 LIMIT 50"


def top_pairs(lines: DataFrame, least: int) -> DataFrame:
    """The fifty pairs of ``item`` that most orders hold, ``least`` at least."""
    top = affinity.affinity(lines, "order_id", "item", least).orderBy(F.desc("times_bought_together"), "item_1", "item_2").limit(50)
    orders = F.broadcast(lines.agg(F.countDistinct("order_id").alias("orders")))  # one row
    return top.crossJoin(orders).select("item_1", "item_2", "times_bought_together", ratio("times_bought_together", "orders", 100).alias("support_pct"))


@query("q05_product_affinity", "SELECT item_1 AS product_1, item_2 AS product_2, times_bought_together, support_pct FROM (" + affinity_sql("SELECT order_id, product_id AS item FROM v_items", 2) + ")")
def _(v):
    # the least count is a parameter of the workbook; the data's products are too many for 10
    return top_pairs(v("v_items").select("order_id", F.col("product_id").alias("item")), 2).withColumnsRenamed({"item_1": "product_1", "item_2": "product_2"})


@query("q05_brand_affinity", affinity_sql("SELECT order_id, brand AS item FROM v_items JOIN v_products USING (product_id)", 10))
def _(v):
    return top_pairs(v("v_items").join(v("v_products").select("product_id", F.col("brand").alias("item")), "product_id").select("order_id", "item"), 10)


@query("q06_category_trend", f"WITH c AS ({CATEGORY}) SELECT category, year, month, total_revenue, total_units_sold, prev_month_revenue, revenue_growth_pct AS mom_growth_pct, revenue_share_pct FROM c WHERE year >= {LAST[:4]} - 1")
def _(v):
    return category_mart(v).where(F.col("year") >= int(LAST[:4]) - 1).select("category", "year", "month", "total_revenue", "total_units_sold", "prev_month_revenue", F.col("revenue_growth_pct").alias("mom_growth_pct"), "revenue_share_pct")


@query("q07_cohort", f"SELECT date_trunc('month', registered_on)::DATE AS cohort_month, date_trunc('month', order_date)::DATE AS order_month, (((year(order_date) - year(registered_on)) * 12 + month(order_date) - month(registered_on)) % 12)::INT AS months_since_signup, count(DISTINCT customer_id) AS active_customers, {M.format('total_amount', 'cohort_revenue')}, {A.format('total_amount', 'avg_order_value')} FROM v_orders JOIN v_customers USING (customer_id) GROUP BY 1, 2, 3")
def _(v):
    x = v("v_orders").join(v("v_customers").select("customer_id", "registered_on"), "customer_id").select("customer_id", "total_amount", F.trunc("registered_on", "month").alias("cohort_month"), F.trunc("order_date", "month").alias("order_month"))
    since = (F.months_between("order_month", "cohort_month") % 12).cast("int").alias("months_since_signup")
    return x.groupBy("cohort_month", "order_month", since).agg(F.countDistinct("customer_id").alias("active_customers"), money("total_amount", "cohort_revenue"), mean("total_amount").alias("avg_order_value"))


@query("q08_rfm_distribution", f"WITH r AS ({RFM}) SELECT customer_segment AS rfm_segment, count(*) AS customer_count, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100 AS pct_of_customers, {M.format('monetary', 'total_revenue')}, CAST(sum(monetary) AS DOUBLE) / CAST(sum(sum(monetary)) OVER () AS DOUBLE) * 100 AS pct_of_revenue, {A.format('frequency', 'avg_orders')}, {A.format('monetary', 'avg_spent')}, {A.format('recency', 'avg_days_since_order')} FROM r GROUP BY 1")
def _(v):
    g = rfm(v("v_orders")).groupBy(F.col("customer_segment").alias("rfm_segment")).agg(n().alias("customer_count"), money("monetary", "total_revenue"), mean("frequency").alias("avg_orders"), mean("monetary").alias("avg_spent"), mean("recency").alias("avg_days_since_order"))
    return g.select("*", ratio("customer_count", F.sum("customer_count").over(every()), 100).alias("pct_of_customers"), ratio("total_revenue", F.sum("total_revenue").over(every()), 100).alias("pct_of_revenue"))


TENURE = "CASE WHEN tenure_months < 84 THEN 'Under 7 years' WHEN tenure_months < 96 THEN '7 to 8 years' ELSE 'Over 8 years' END"


@query("q09_ltv", f"WITH c AS ({CUSTOMER}), g AS (SELECT customer_segment, {TENURE} AS tenure_group, count(*) AS customer_count, {A.format('total_spent', 'avg_lifetime_value')}, {A.format('total_orders', 'avg_lifetime_orders')}, round(avg(CAST(total_spent AS DOUBLE) / tenure_months), 6) AS avg_monthly_value, round(avg(CAST(total_spent AS DOUBLE) / tenure_months) * 12, 5) AS projected_annual_value FROM c WHERE tenure_months > 0 GROUP BY 1, 2) SELECT * FROM g")
def _(v):
    c = customer_mart(v).where("tenure_months > 0")
    month = F.avg(F.col("total_spent").cast("double") / F.col("tenure_months"))
    return c.groupBy("customer_segment", F.expr(TENURE).alias("tenure_group")).agg(n().alias("customer_count"), mean("total_spent").alias("avg_lifetime_value"), mean("total_orders").alias("avg_lifetime_orders"), F.round(month, 6).alias("avg_monthly_value"), F.round(month * 12, 5).alias("projected_annual_value"))


CHURN = "CASE WHEN days_since_last_order <= 30 THEN 'Active' WHEN days_since_last_order <= 60 THEN 'At Risk' WHEN days_since_last_order <= 90 THEN 'High Risk' ELSE 'Churned' END"


@query("q10_churn_risk", f"WITH c AS ({CUSTOMER}) SELECT {CHURN} AS churn_status, count(*) AS customer_count, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100 AS pct_of_total, {A.format('total_spent', 'avg_total_spent')}, {A.format('total_orders', 'avg_orders')}, {M.format('total_spent', 'at_risk_revenue')} FROM c WHERE total_orders > 0 GROUP BY 1")
def _(v):
    d = F.col("days_since_last_order")
    status = F.when(d <= 30, "Active").when(d <= 60, "At Risk").when(d <= 90, "High Risk").otherwise("Churned")
    g = customer_mart(v).where("total_orders > 0").groupBy(status.alias("churn_status")).agg(n().alias("customer_count"), mean("total_spent").alias("avg_total_spent"), mean("total_orders").alias("avg_orders"), money("total_spent", "at_risk_revenue"))
    order = F.when(F.col("churn_status") == "Active", 1).when(F.col("churn_status") == "At Risk", 2).when(F.col("churn_status") == "High Risk", 3).otherwise(4)
    return g.withColumn("pct_of_total", ratio("customer_count", F.sum("customer_count").over(every()), 100)).orderBy(order)


@query("q11_regional", f"WITH g AS ({GEOGRAPHIC}) SELECT region, country, CAST(sum(total_customers) AS BIGINT) AS total_customers, CAST(sum(new_customers) AS BIGINT) AS new_customers, CAST(sum(total_orders) AS BIGINT) AS total_orders, {M.format('total_revenue', 'total_revenue')}, CAST(sum(total_revenue) AS DOUBLE) / CAST(sum(sum(total_revenue)) OVER () AS DOUBLE) * 100 AS revenue_share_pct, round(avg(avg_order_value), 8) AS avg_order_value, round(avg(avg_delivery_days), 8) AS avg_delivery_days, CAST(sum(total_revenue) AS DOUBLE) / CAST(sum(total_customers) AS DOUBLE) AS revenue_per_customer FROM g WHERE year = {LAST[:4]} - 1 GROUP BY 1, 2")
def _(v):
    g = geographic_mart(v).where(F.col("year") == int(LAST[:4]) - 1).groupBy("region", "country").agg(F.sum("total_customers").alias("total_customers"), F.sum("new_customers").alias("new_customers"), F.sum("total_orders").alias("total_orders"), money("total_revenue", "total_revenue"), F.round(F.avg("avg_order_value"), 8).alias("avg_order_value"), F.round(F.avg("avg_delivery_days"), 8).alias("avg_delivery_days"))
    return g.select("*", ratio("total_revenue", F.sum("total_revenue").over(every()), 100).alias("revenue_share_pct"), ratio("total_revenue", "total_customers").alias("revenue_per_customer"))


@query("q12_city", f"WITH g AS ({GEOGRAPHIC}) SELECT city, country, CAST(sum(total_customers) AS BIGINT) AS customers, CAST(sum(total_orders) AS BIGINT) AS orders, {M.format('total_revenue', 'revenue')}, round(avg(avg_order_value), 8) AS avg_order_value, round(avg(orders_per_customer), 8) AS orders_per_customer FROM g WHERE year = {LAST[:4]} - 1 GROUP BY 1, 2 HAVING sum(total_orders) >= 10 ORDER BY revenue DESC, city, country LIMIT 50")
def _(v):
    g = geographic_mart(v).where(F.col("year") == int(LAST[:4]) - 1).groupBy("city", "country").agg(F.sum("total_customers").alias("customers"), F.sum("total_orders").alias("orders"), F.sum("total_revenue").cast("decimal(28,2)").alias("revenue"), F.round(F.avg("avg_order_value"), 8).alias("avg_order_value"), F.round(F.avg("orders_per_customer"), 8).alias("orders_per_customer"))
    return g.where("orders >= 10").orderBy(F.desc("revenue"), "city", "country").limit(50)


DAYS = "CAST(date_diff('day', order_date, {0}) AS DOUBLE)"


@query("q13_fulfilment", f"SELECT status AS order_status, count(*) AS order_count, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100 AS pct_of_orders, {M.format('total_amount', 'total_value')}, sum({DAYS.format('shipped_on')}) / count(*) AS avg_days_to_ship, sum({DAYS.format('delivered_on')}) / count(*) AS avg_days_to_deliver, quantile_cont({DAYS.format('delivered_on')}, 0.5) AS median_delivery_days, quantile_cont({DAYS.format('delivered_on')}, 0.95) AS p95_delivery_days FROM v_orders GROUP BY 1")
def _(v):
    o = v("v_orders").select("status", "total_amount", F.date_diff("shipped_on", "order_date").alias("a"), F.date_diff("delivered_on", "order_date").alias("b"))
    # exact percentiles merge counts of different values, and days are few
    g = o.groupBy(F.col("status").alias("order_status")).agg(n().alias("order_count"), money("total_amount", "total_value"), mean("a").alias("avg_days_to_ship"), mean("b").alias("avg_days_to_deliver"), F.percentile("b", F.lit(0.5)).alias("median_delivery_days"), F.percentile("b", F.lit(0.95)).alias("p95_delivery_days"))
    return g.withColumn("pct_of_orders", ratio("order_count", F.sum("order_count").over(every()), 100))


#: Fixed values of our own: carriers and days of the shipping methods.
METHODS = [("Standard", "Post", 3, 7), ("Express", "Courier", 1, 3), ("Overnight", "Courier", 0, 1), ("Pickup", "None", 0, 5)]
METHODS_SQL = "(VALUES " + ", ".join(f"('{m}', '{c}', {a}, {b})" for m, c, a, b in METHODS) + ") AS sm(shipping_method, carrier, delivery_days_min, delivery_days_max)"


@query("q14_shipping_methods", f"SELECT shipping_method, carrier, count(order_id) AS orders, {M.format('shipping_amount', 'total_shipping_revenue')}, {A.format('shipping_amount', 'avg_shipping_cost')}, sum({DAYS.format('delivered_on')}) / count(*) AS avg_delivery_days, delivery_days_min, delivery_days_max, count(*) FILTER ({DAYS.format('delivered_on')} > delivery_days_max) AS late_deliveries, CAST(count(*) FILTER ({DAYS.format('delivered_on')} > delivery_days_max) AS DOUBLE) / nullif(count(order_id), 0) * 100 AS late_delivery_pct FROM {METHODS_SQL} JOIN v_orders USING (shipping_method) GROUP BY ALL")
def _(v):
    o = v("v_orders").select("order_id", "shipping_method", "shipping_amount", F.date_diff("delivered_on", "order_date").alias("days"))
    methods = F.broadcast(o.sparkSession.createDataFrame(METHODS, "shipping_method string, carrier string, delivery_days_min int, delivery_days_max int"))  # a row per method
    g = o.join(methods, "shipping_method").groupBy("shipping_method", "carrier", "delivery_days_min", "delivery_days_max").agg(F.count("order_id").alias("orders"), money("shipping_amount", "total_shipping_revenue"), mean("shipping_amount").alias("avg_shipping_cost"), mean("days").alias("avg_delivery_days"), flagged(F.col("days") > F.col("delivery_days_max"), "late_deliveries"))
    return g.withColumn("late_delivery_pct", ratio("late_deliveries", "orders", 100))


@query("q15_payment_methods", f"WITH g AS (SELECT payment_method, count(*) AS order_count, {M.format('total_amount', 'total_processed')}, {A.format('total_amount', 'avg_transaction_value')}, CAST(sum(total_amount * 0.029 + 0.30) AS DECIMAL(28,4)) AS estimated_fees FROM v_orders GROUP BY 1) SELECT *, CAST(order_count AS DOUBLE) / CAST(sum(order_count) OVER () AS DOUBLE) * 100 AS usage_pct FROM g")
def _(v):
    fee = F.col("total_amount") * F.lit("0.029").cast("decimal(4,3)") + F.lit("0.30").cast("decimal(3,2)")
    g = v("v_orders").groupBy("payment_method").agg(n().alias("order_count"), money("total_amount", "total_processed"), mean("total_amount").alias("avg_transaction_value"), F.sum(fee).cast("decimal(28,4)").alias("estimated_fees"))
    return g.withColumn("usage_pct", ratio("order_count", F.sum("order_count").over(every()), 100))


YEARS = {"c": f"year(full_date) = {LAST[:4]} AND full_date <= DATE '{LAST}'", "p": f"year(full_date) = {LAST[:4]} - 1 AND full_date <= DATE '{LAST}' - INTERVAL 1 YEAR"}
FIELDS = {"Orders": "total_orders", "Customers": "unique_customers", "Revenue": "net_revenue", "Profit": "total_profit"}
_YTD = ", ".join(f"CAST(sum(CASE WHEN {c} THEN {f} ELSE 0 END) AS DOUBLE) AS {k}_{f}" for k, c in YEARS.items() for f in FIELDS.values())


@query("q16_ytd_vs_prev", f"WITH s AS ({SALES}), y AS (SELECT {_YTD} FROM s) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, c_{f} AS current_ytd, p_{f} AS previous_ytd, c_{f} - p_{f} AS difference, (c_{f} - p_{f}) / nullif(p_{f}, 0) * 100 AS yoy_change_pct FROM y" for m, f in FIELDS.items()))
def _(v):
    d, last = F.col("full_date"), F.lit(LAST).cast("date")
    tests = {"c": (F.year(d) == int(LAST[:4])) & (d <= last), "p": (F.year(d) == int(LAST[:4]) - 1) & (d <= F.add_months(last, -12))}
    y = sales(v).agg(*[F.sum(F.when(t, F.col(f)).otherwise(0)).cast("double").alias(f"{k}_{f}") for k, t in tests.items() for f in FIELDS.values()])
    rows = []
    for m, f in FIELDS.items():
        c, p = F.col(f"c_{f}"), F.col(f"p_{f}")
        rows.append(F.struct(F.lit(m).alias("metric"), c.alias("current_ytd"), p.alias("previous_ytd"), (c - p).alias("difference"), (F.try_divide(c - p, p) * 100).alias("yoy_change_pct")))
    return y.select(F.inline(F.array(*rows)))


@query("join_cross_scalar", f"WITH s AS ({SALES}), a AS (SELECT count(*) AS days, {M.format('net_revenue', 'revenue')} FROM s), b AS (SELECT count(*) AS products FROM v_products) SELECT days, revenue, products FROM a, b")
def _(v):
    a = sales(v).agg(n().alias("days"), money("net_revenue", "revenue"))
    return a.crossJoin(v("v_products").agg(n().alias("products")))  # one row each


#: The warehouse's marts: enriched lines and orders are stored first, and the five marts read them.
WAREHOUSE_MARTS = [
    Mart("sales_summary", ("e_orders",), sales),
    Mart("product_performance", ("e_items",), product_ranks),
    Mart("customer_analytics", ("e_orders",), customer_mart),
    Mart("category_performance", ("e_items",), category_mart),
    Mart("geographic_sales", ("e_orders",), geographic_mart),
    Mart("e_orders", ("e_items",), enriched_orders),
    Mart("e_items", (), enriched_items),
]
