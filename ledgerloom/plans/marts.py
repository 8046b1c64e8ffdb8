"""Marts, the gold layer and the analytic workbook in full; each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import cleaning as K
from ledgerloom.operators import windows

from .cleaning import cut_sql
from .retail import AS_OF, query
from .views import done

n = lambda: F.count(F.lit(1))
every = lambda: Window.partitionBy()  # noqa: E731  over few rows only
now = lambda: F.lit(AS_OF).cast("date")
AGE = f"date_diff('day', {{}}, DATE '{AS_OF}')"


def money(c: str | Column, name: str) -> Column:
    return F.sum(c).cast("decimal(28,2)").alias(name)


def ratio(a: str | Column, b: str | Column, factor: int = 1) -> Column:
    """One division in double precision, null for a divisor of 0; not rounded, so that engines agree."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    out = F.try_divide(x.cast("double"), y.cast("double"))
    return out * factor if factor != 1 else out


def mean(c: str) -> Column:
    """Of a decimal or whole number: its exact sum by the count of its values."""
    return ratio(F.sum(c), F.count(c))


def flagged(c: str | Column, name: str) -> Column:
    return F.count_if(F.col(c) if isinstance(c, str) else c).alias(name)


M = "CAST(sum({0}) AS DECIMAL(28,2)) AS {1}"
A = "CAST(sum({0}) AS DOUBLE) / nullif(count({0}), 0) AS {1}"
R = "CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0)"

# ------------------------------------------------------------------ sales by period

DAY = f"""SELECT order_date, count(*) AS total_orders, count(DISTINCT customer_id) AS unique_customers, count(*) FILTER (is_completed) AS completed_orders, count(*) FILTER (is_cancelled) AS cancelled_orders,
  {M.format('total_amount', 'gross_revenue')}, CAST(sum(CASE WHEN is_completed THEN total_amount ELSE 0 END) AS DECIMAL(28,2)) AS net_revenue, {A.format('total_amount', 'avg_order_value')}, min(total_amount) AS min_order_value, max(total_amount) AS max_order_value,
  count(*) FILTER (is_repeat_customer) AS repeat_customers, count(*) FILTER (NOT is_repeat_customer) AS new_customers, CAST(sum(item_count) AS BIGINT) AS total_items_sold, CAST(sum(total_quantity) AS BIGINT) AS total_units_sold,
  {M.format('order_profit', 'total_profit')}, round(avg(avg_profit_margin), 8) AS avg_profit_margin, count(*) FILTER (order_size_tier = 'Small') AS small_orders, count(*) FILTER (order_size_tier = 'Medium') AS medium_orders, count(*) FILTER (order_size_tier = 'Large') AS large_orders,
  count(*) FILTER (order_size_tier = 'Premium') AS premium_orders, count(*) FILTER (is_weekend) AS weekend_orders, count(*) FILTER (NOT is_weekend) AS weekday_orders FROM e_orders GROUP BY 1"""


def daily(o: DataFrame) -> DataFrame:
    """The aggregates of each day of enriched orders, but for the median."""
    tiers = [flagged(F.col("order_size_tier") == t, f"{t.lower()}_orders") for t in ("Small", "Medium", "Large", "Premium")]
    return o.groupBy("order_date").agg(
        n().alias("total_orders"), F.countDistinct("customer_id").alias("unique_customers"), flagged("is_completed", "completed_orders"), flagged("is_cancelled", "cancelled_orders"), money("total_amount", "gross_revenue"), money(F.when(F.col("is_completed"), F.col("total_amount")).otherwise(0), "net_revenue"),
        mean("total_amount").alias("avg_order_value"), F.min("total_amount").alias("min_order_value"), F.max("total_amount").alias("max_order_value"), flagged("is_repeat_customer", "repeat_customers"), flagged(~F.col("is_repeat_customer"), "new_customers"), F.sum("item_count").alias("total_items_sold"), F.sum("total_quantity").alias("total_units_sold"),
        money("order_profit", "total_profit"), F.round(F.avg("avg_profit_margin"), 8).alias("avg_profit_margin"), *tiers, flagged("is_weekend", "weekend_orders"), flagged(~F.col("is_weekend"), "weekday_orders"),
    )


@query("daily_sales_mart", f"""WITH d AS ({DAY}), m AS (SELECT order_date, median(CAST(total_amount AS DOUBLE)) AS median_order_value FROM e_orders GROUP BY 1)
SELECT *, {R.format('completed_orders', 'total_orders')} * 100 AS completion_rate, {R.format('cancelled_orders', 'total_orders')} * 100 AS cancellation_rate, {R.format('repeat_customers', 'unique_customers')} * 100 AS repeat_customer_rate, {R.format('total_items_sold', 'total_orders')} AS items_per_order,
  coalesce(CASE WHEN net_revenue > 0 THEN {R.format('total_profit', 'net_revenue')} * 100 END, 0) AS profit_margin, year(order_date) AS year, month(order_date) AS month, day(order_date) AS day, dayofweek(order_date) + 1 AS day_of_week, week(order_date) AS week_of_year, quarter(order_date) AS quarter, isodow(order_date) >= 6 AS is_weekend
FROM d JOIN m USING (order_date)""")
def _(v):
    o = v("e_orders")
    d = daily(o).join(windows.grouped_median(o, ["order_date"], "total_amount", "median_order_value"), "order_date")
    c = F.col("order_date")
    return d.select(
        "*", ratio("completed_orders", "total_orders", 100).alias("completion_rate"), ratio("cancelled_orders", "total_orders", 100).alias("cancellation_rate"), ratio("repeat_customers", "unique_customers", 100).alias("repeat_customer_rate"), ratio("total_items_sold", "total_orders").alias("items_per_order"),
        F.coalesce(F.when(F.col("net_revenue") > 0, ratio("total_profit", "net_revenue", 100)), F.lit(0.0)).alias("profit_margin"), *[f(c).cast("long").alias(k) for k, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("day_of_week", F.dayofweek), ("week_of_year", F.weekofyear), ("quarter", F.quarter))], (F.weekday(c) >= 5).alias("is_weekend"),
    )


SUMS = ("total_orders", "gross_revenue", "net_revenue", "total_items_sold", "total_profit", "completed_orders", "new_customers", "repeat_customers")


def rolled(g, *more: Column) -> DataFrame:
    """Days summed up."""
    typed = lambda c: "decimal(28,2)" if c in ("gross_revenue", "net_revenue", "total_profit") else "long"
    return g.agg(n().alias("days_with_orders"), F.sum("unique_customers").alias("total_customers"), *[F.sum(c).cast(typed(c)).alias(c) for c in SUMS], F.round(F.avg("avg_order_value"), 8).alias("avg_order_value"), *more)


ROLLED = "count(*) AS days_with_orders, sum(unique_customers)::BIGINT AS total_customers, " + ", ".join(f"CAST(sum({c}) AS {'DECIMAL(28,2)' if c in ('gross_revenue', 'net_revenue', 'total_profit') else 'BIGINT'}) AS {c}" for c in SUMS) + ", round(avg(avg_order_value), 8) AS avg_order_value"


@query("weekly_sales_mart", f"WITH d AS ({DAY}), w AS (SELECT year(order_date) AS year, week(order_date) AS week_of_year, order_date - CAST(dayofweek(order_date) AS INT) AS week_start, {ROLLED}, CAST(sum(cancelled_orders) AS BIGINT) AS cancelled_orders FROM d GROUP BY 1, 2, 3) SELECT *, {R.format('completed_orders', 'total_orders')} * 100 AS completion_rate, {R.format('total_orders', 'days_with_orders')} AS avg_daily_orders, {R.format('gross_revenue', 'days_with_orders')} AS avg_daily_revenue FROM w")
def _(v):
    c = F.col("order_date")
    w = rolled(daily(v("e_orders")).groupBy(F.year(c).cast("long").alias("year"), F.weekofyear(c).cast("long").alias("week_of_year"), F.date_sub(c, F.dayofweek(c) - 1).alias("week_start")), F.sum("cancelled_orders").alias("cancelled_orders"))
    return w.select("*", ratio("completed_orders", "total_orders", 100).alias("completion_rate"), ratio("total_orders", "days_with_orders").alias("avg_daily_orders"), ratio("gross_revenue", "days_with_orders").alias("avg_daily_revenue"))


@query("monthly_sales_mart", f"WITH d AS ({DAY}), m AS (SELECT year(order_date) AS year, month(order_date) AS month, {ROLLED}, min(order_date) AS month_start, max(order_date) AS month_end FROM d GROUP BY 1, 2), p AS (SELECT *, lag(gross_revenue) OVER w AS prev_month_revenue, lag(total_orders) OVER w AS prev_month_orders FROM m WINDOW w AS (ORDER BY year, month)) SELECT *, coalesce(CASE WHEN prev_month_revenue > 0 THEN {R.format('gross_revenue - prev_month_revenue', 'prev_month_revenue')} * 100 END, 0) AS revenue_mom_growth, coalesce(CASE WHEN prev_month_orders > 0 THEN {R.format('total_orders - prev_month_orders', 'prev_month_orders')} * 100 END, 0) AS orders_mom_growth FROM p")
def _(v):
    c = F.col("order_date")
    m = rolled(daily(v("e_orders")).groupBy(F.year(c).cast("long").alias("year"), F.month(c).cast("long").alias("month")), F.min(c).alias("month_start"), F.max(c).alias("month_end"))
    w = Window.orderBy("year", "month")  # a row per month
    p = m.withColumn("prev_month_revenue", F.lag("gross_revenue").over(w)).withColumn("prev_month_orders", F.lag("total_orders").over(w))
    growth = lambda a, b: F.coalesce(F.when(F.col(b) > 0, ratio(F.col(a) - F.col(b), b, 100)), F.lit(0.0))
    return p.select("*", growth("gross_revenue", "prev_month_revenue").alias("revenue_mom_growth"), growth("total_orders", "prev_month_orders").alias("orders_mom_growth"))


@query("gold_daily_sales", f"""SELECT order_date, date_key, count(*) AS total_orders, count(DISTINCT customer_id) AS unique_customers, {M.format('total_amount - tax_amount - shipping_amount', 'gross_sales')}, {M.format('total_amount', 'net_revenue')}, {M.format('tax_amount', 'total_tax')}, {M.format('shipping_amount', 'total_shipping')}, {A.format('total_amount', 'avg_order_value')}, max(total_amount) AS max_order_value, min(total_amount) AS min_order_value,
  count(*) FILTER (is_completed) AS completed_orders, count(*) FILTER (is_cancelled) AS cancelled_orders, count(*) FILTER (order_value_tier = 'High') AS high_value_orders, count(*) FILTER (order_value_tier = 'Very High') AS very_high_value_orders, CAST(count(*) FILTER (is_completed) AS DOUBLE) / count(*) * 100 AS completion_rate, CAST(count(*) FILTER (is_cancelled) AS DOUBLE) / count(*) * 100 AS cancellation_rate
FROM (SELECT *, strftime(order_date, '%Y%m%d')::INT AS date_key, CASE WHEN total_amount < 50 THEN 'Very Low' WHEN total_amount < 100 THEN 'Low' WHEN total_amount < 200 THEN 'Medium' WHEN total_amount < 500 THEN 'High' ELSE 'Very High' END AS order_value_tier, status = 'completed' AS is_completed, status = 'cancelled' AS is_cancelled FROM v_orders) GROUP BY 1, 2""")
def _(v):
    o = K.silver_orders(v("v_orders"))
    d = o.groupBy("order_date", "date_key").agg(
        n().alias("total_orders"), F.countDistinct("customer_id").alias("unique_customers"), money(F.col("total_amount") - F.col("tax_amount") - F.col("shipping_amount"), "gross_sales"), money("total_amount", "net_revenue"), money("tax_amount", "total_tax"), money("shipping_amount", "total_shipping"), mean("total_amount").alias("avg_order_value"),
        F.max("total_amount").alias("max_order_value"), F.min("total_amount").alias("min_order_value"), flagged("is_completed", "completed_orders"), flagged("is_cancelled", "cancelled_orders"), flagged(F.col("order_value_tier") == "High", "high_value_orders"), flagged(F.col("order_value_tier") == "Very High", "very_high_value_orders"),
    )
    return d.select("*", ratio("completed_orders", "total_orders", 100).alias("completion_rate"), ratio("cancelled_orders", "total_orders", 100).alias("cancellation_rate"))


@query("hourly_patterns_mart", f"SELECT order_hour, dayofweek(order_date) + 1 AS day_of_week, count(*) AS total_orders, {M.format('total_amount', 'total_revenue')}, {A.format('total_amount', 'avg_order_value')}, count(DISTINCT customer_id) AS unique_customers, dayname(order_date) AS day_name, order_hour BETWEEN 9 AND 17 AS is_business_hours, CASE WHEN order_hour < 6 THEN 'Night' WHEN order_hour < 12 THEN 'Morning' WHEN order_hour < 18 THEN 'Afternoon' ELSE 'Evening' END AS time_period FROM v_orders GROUP BY ALL")
def _(v):
    g = v("v_orders").groupBy("order_hour", F.dayofweek("order_date").cast("long").alias("day_of_week")).agg(n().alias("total_orders"), money("total_amount", "total_revenue"), mean("total_amount").alias("avg_order_value"), F.countDistinct("customer_id").alias("unique_customers"))
    names = F.array(*map(F.lit, ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")))
    return g.select("*", F.get(names, (F.col("day_of_week") - 1).cast("int")).alias("day_name"), F.col("order_hour").between(9, 17).alias("is_business_hours"), C.tier(F.col("order_hour"), [6, 12, 18], ["Night", "Morning", "Afternoon", "Evening"]).alias("time_period"))


@query("daily_sales_summary", f"""WITH o AS (SELECT order_date, count(*) AS total_orders, count(DISTINCT customer_id) AS unique_customers, {M.format('total_amount', 'total_revenue')}, {A.format('total_amount', 'avg_order_value')}, count(*) FILTER (is_completed) AS completed_orders, count(*) FILTER (is_cancelled) AS cancelled_orders, CAST(sum(CASE WHEN is_weekend THEN total_amount ELSE 0 END) AS DECIMAL(28,2)) AS weekend_revenue, CAST(sum(CASE WHEN NOT is_weekend THEN total_amount ELSE 0 END) AS DECIMAL(28,2)) AS weekday_revenue, min(total_amount) AS min_order_value, max(total_amount) AS max_order_value FROM e_orders GROUP BY 1),
i AS (SELECT order_date, sum(quantity)::BIGINT AS total_items_sold, count(DISTINCT product_id) AS unique_products_sold, {M.format('profit_amount', 'total_profit')}, round(avg(profit_margin), 8) AS avg_profit_margin FROM e_items JOIN v_orders USING (order_id) GROUP BY 1)
SELECT *, {R.format('completed_orders', 'total_orders')} * 100 AS completion_rate, {R.format('cancelled_orders', 'total_orders')} * 100 AS cancellation_rate FROM o LEFT JOIN i USING (order_date)""")
def _(v):
    o = v("v_orders").withColumn("is_completed", done()).withColumn("is_cancelled", F.col("status").isin("cancelled", "refunded")).withColumn("is_weekend", F.weekday("order_date") >= 5)
    part = lambda c, name: money(F.when(c, F.col("total_amount")).otherwise(0), name)
    d = o.groupBy("order_date").agg(n().alias("total_orders"), F.countDistinct("customer_id").alias("unique_customers"), money("total_amount", "total_revenue"), mean("total_amount").alias("avg_order_value"), flagged("is_completed", "completed_orders"), flagged("is_cancelled", "cancelled_orders"), part(F.col("is_weekend"), "weekend_revenue"), part(~F.col("is_weekend"), "weekday_revenue"), F.min("total_amount").alias("min_order_value"), F.max("total_amount").alias("max_order_value"))
    i = v("e_items").join(v("v_orders").select("order_id", "order_date"), "order_id").groupBy("order_date").agg(F.sum("quantity").alias("total_items_sold"), F.countDistinct("product_id").alias("unique_products_sold"), money("profit_amount", "total_profit"), F.round(F.avg("profit_margin"), 8).alias("avg_profit_margin"))
    return d.join(i, "order_date", "left").select("*", ratio("completed_orders", "total_orders", 100).alias("completion_rate"), ratio("cancelled_orders", "total_orders", 100).alias("cancellation_rate"))


@query("daily_summary_trend", f"""WITH d AS (SELECT order_date AS date, count(*) AS total_orders, {M.format('total_price', 'total_revenue')}, sum(quantity)::BIGINT AS total_items_sold, count(DISTINCT customer_id) AS unique_customers, count(DISTINCT product_id) AS unique_products, {M.format('discount_amount', 'total_discounts')} FROM e_items JOIN v_orders USING (order_id) GROUP BY 1)
SELECT *, {R.format('total_revenue', 'total_orders')} AS avg_order_value, {R.format('total_items_sold', 'total_orders')} AS avg_items_per_order, {R.format('total_revenue - lag(total_revenue) OVER w', 'lag(total_revenue) OVER w')} * 100 AS revenue_change, {R.format('total_orders - lag(total_orders) OVER w', 'lag(total_orders) OVER w')} * 100 AS orders_change, CASE WHEN count(*) OVER r = 7 THEN CAST(sum(total_revenue) OVER r AS DOUBLE) / 7 END AS revenue_7d_avg, CASE WHEN count(*) OVER r = 7 THEN CAST(sum(total_orders) OVER r AS DOUBLE) / 7 END AS orders_7d_avg FROM d WINDOW w AS (ORDER BY date), r AS (ORDER BY date ROWS 6 PRECEDING)""")
def _(v):
    d = v("e_items").join(v("v_orders").select("order_id", "order_date", "customer_id"), "order_id").groupBy(F.col("order_date").alias("date")).agg(n().alias("total_orders"), money("total_price", "total_revenue"), F.sum("quantity").alias("total_items_sold"), F.countDistinct("customer_id").alias("unique_customers"), F.countDistinct("product_id").alias("unique_products"), money("discount_amount", "total_discounts"))
    w = Window.orderBy("date")  # a row per day
    r = w.rowsBetween(-6, 0)
    change = lambda c: ratio(F.col(c) - F.lag(c).over(w), F.lag(c).over(w), 100)
    rolling = lambda c: F.when(n().over(r) == 7, F.sum(c).over(r).cast("double") / 7)
    return d.select("*", ratio("total_revenue", "total_orders").alias("avg_order_value"), ratio("total_items_sold", "total_orders").alias("avg_items_per_order"), change("total_revenue").alias("revenue_change"), change("total_orders").alias("orders_change"), rolling("total_revenue").alias("revenue_7d_avg"), rolling("total_orders").alias("orders_7d_avg"))


PERIODS = ("day", "week", "month")


@query("order_summary_period", " UNION ALL ".join(f"SELECT '{p}' AS grain, date_trunc('{p}', order_date)::DATE AS period, count(*) AS orders, count(DISTINCT customer_id) AS customers, {M.format('total_amount', 'revenue')}, {A.format('total_amount', 'average')} FROM v_orders GROUP BY 2" for p in PERIODS))
def _(v):
    o = v("v_orders").select("customer_id", "total_amount", "order_date")
    parts = [o.groupBy(F.lit(p).alias("grain"), F.date_trunc(p, "order_date").cast("date").alias("period")).agg(n().alias("orders"), F.countDistinct("customer_id").alias("customers"), money("total_amount", "revenue"), mean("total_amount").alias("average")) for p in PERIODS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("hourly_sales_agg", f"SELECT order_hour, {M.format('total_amount', 'revenue')}, {A.format('total_amount', 'average')}, count(*) AS orders, sum(item_count)::BIGINT AS items FROM e_orders GROUP BY 1")
def _(v):
    return v("e_orders").groupBy("order_hour").agg(money("total_amount", "revenue"), mean("total_amount").alias("average"), n().alias("orders"), F.sum("item_count").alias("items"))


# ------------------------------------------------------------------ customers


def step_sql(x: str, edges: list[float], above: bool) -> str:
    return "CASE " + " ".join(f"WHEN {x} {'>=' if above else '<='} {e} THEN {s}" for s, e in zip((5, 4, 3, 2), edges, strict=True)) + " ELSE 1 END"


def step(x: str, edges: list[float], above: bool) -> Column:
    """Scores 5 to 1."""
    out = None
    for s, e in zip((5, 4, 3, 2), edges, strict=True):
        hit = F.col(x) >= e if above else F.col(x) <= e
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out.otherwise(1)


# Thresholds of the scores.
RECENCY, GOLD_RECENCY, FREQUENCY, MONETARY = [30, 60, 90, 180], [7, 30, 90, 180], [20, 10, 5, 2], [1000, 500, 200, 50]

RFM = f"""SELECT *, CASE WHEN rfm_score >= 12 THEN 'Champions' WHEN rfm_score >= 9 AND recency_score >= 4 THEN 'Loyal Customers' WHEN rfm_score >= 9 THEN 'At Risk' WHEN frequency_score >= 4 AND recency_score <= 2 THEN 'Can''t Lose Them' WHEN rfm_score >= 6 AND recency_score >= 3 THEN 'Potential Loyalists' WHEN frequency_score = 1 AND recency_score >= 4 THEN 'New Customers' WHEN rfm_score <= 5 THEN 'Lost' ELSE 'Others' END AS customer_segment FROM (
SELECT *, recency_score + frequency_score + monetary_score AS rfm_score, concat(recency_score, frequency_score, monetary_score) AS rfm_string FROM (SELECT *, {step_sql('recency', RECENCY, False)} AS recency_score, {step_sql('frequency', FREQUENCY, True)} AS frequency_score, {step_sql('monetary', MONETARY, True)} AS monetary_score FROM (
SELECT customer_id, {AGE.format('max(order_date)')}::INT AS recency, count(*) AS frequency, {M.format('total_amount', 'monetary')}, min(order_date) AS first_order_date, max(order_date) AS last_order_date, {A.format('total_amount', 'avg_order_value')} FROM v_orders WHERE status IN ('completed','delivered','shipped') GROUP BY 1)))"""


def rfm(o: DataFrame) -> DataFrame:
    """Recency, frequency and money of customers with completed orders, scores, their sum and digits, segment."""
    c = o.where(done()).groupBy("customer_id").agg(F.date_diff(now(), F.max("order_date")).alias("recency"), n().alias("frequency"), money("total_amount", "monetary"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"), mean("total_amount").alias("avg_order_value"))
    c = c.withColumns({"recency_score": step("recency", RECENCY, False), "frequency_score": step("frequency", FREQUENCY, True), "monetary_score": step("monetary", MONETARY, True)})
    r, f, s = F.col("recency_score"), F.col("frequency_score"), F.col("rfm_score")
    c = c.withColumn("rfm_score", r + f + F.col("monetary_score")).withColumn("rfm_string", F.concat(r.cast("string"), f.cast("string"), F.col("monetary_score").cast("string")))
    segment = F.when(s >= 12, "Champions").when((s >= 9) & (r >= 4), "Loyal Customers").when(s >= 9, "At Risk").when((f >= 4) & (r <= 2), "Can't Lose Them").when((s >= 6) & (r >= 3), "Potential Loyalists").when((f == 1) & (r >= 4), "New Customers").when(s <= 5, "Lost").otherwise("Others")
    return c.withColumn("customer_segment", segment)


@query("customer_rfm_mart", RFM)
def _(v):
    return rfm(v("v_orders"))


# months between two dates as Spark counts them: whole ones, and days of 31 parts unless both are the last of their months
_MONTHS = "CASE WHEN day(b) = day(a) OR (b = last_day(b) AND a = last_day(a)) THEN CAST((year(b) - year(a)) * 12 + month(b) - month(a) AS DOUBLE) ELSE round((year(b) - year(a)) * 12 + month(b) - month(a) + CAST(day(b) - day(a) AS DOUBLE) / 31, 8) END"


@query("customer_clv_mart", f"""WITH c AS (SELECT customer_id, {M.format('total_amount', 'total_revenue')}, count(*) AS total_orders, {A.format('total_amount', 'avg_order_value')}, min(order_date) AS a, max(order_date) AS b FROM v_orders WHERE status IN ('completed','delivered','shipped') GROUP BY 1), t AS (SELECT *, {_MONTHS} AS m FROM c), u AS (SELECT *, CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE m END AS tenure_months FROM t)
SELECT customer_id, total_revenue, total_orders, avg_order_value, a AS first_order_date, b AS last_order_date, round(tenure_months, 6) AS tenure_months, round(total_orders / tenure_months, 6) AS purchase_frequency, round(CAST(total_revenue AS DOUBLE) / tenure_months, 6) AS monthly_revenue, round(CAST(total_revenue AS DOUBLE) / tenure_months * 12, 4) AS clv_12m, round(CAST(total_revenue AS DOUBLE) / tenure_months * 24, 4) AS clv_24m, CASE WHEN CAST(total_revenue AS DOUBLE) / tenure_months * 12 >= 5000 THEN 'Platinum' WHEN CAST(total_revenue AS DOUBLE) / tenure_months * 12 >= 2000 THEN 'Gold' WHEN CAST(total_revenue AS DOUBLE) / tenure_months * 12 >= 500 THEN 'Silver' ELSE 'Bronze' END AS clv_tier, {AGE.format('b')}::INT AS days_since_last_order, {AGE.format('b')} <= 90 AS is_active FROM u""")
def _(v):
    c = v("v_orders").where(done()).groupBy("customer_id").agg(money("total_amount", "total_revenue"), n().alias("total_orders"), mean("total_amount").alias("avg_order_value"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"))
    m = F.months_between("last_order_date", "first_order_date")
    c = c.withColumn("t", F.when(m == 0, 1.0).otherwise(m)).withColumn("clv", F.col("total_revenue").cast("double") / F.col("t") * 12)
    tier = F.when(F.col("clv") >= 5000, "Platinum").when(F.col("clv") >= 2000, "Gold").when(F.col("clv") >= 500, "Silver").otherwise("Bronze")
    age = F.date_diff(now(), "last_order_date")
    return c.select("customer_id", "total_revenue", "total_orders", "avg_order_value", "first_order_date", "last_order_date", F.round("t", 6).alias("tenure_months"), F.round(F.col("total_orders") / F.col("t"), 6).alias("purchase_frequency"), F.round(F.col("total_revenue").cast("double") / F.col("t"), 6).alias("monthly_revenue"), F.round("clv", 4).alias("clv_12m"), F.round(F.col("total_revenue").cast("double") / F.col("t") * 24, 4).alias("clv_24m"), tier.alias("clv_tier"), age.alias("days_since_last_order"), (age <= 90).alias("is_active"))


# Bins of money and tenure.
CLASS = ([0, 100, 500, 2000, None], ["Bronze", "Silver", "Gold", "Platinum"])
_QUINTILE = "CASE WHEN c.rows >= 5 THEN greatest(1, CAST(ceil(CAST((row_number() OVER (ORDER BY {0}, customer_id) - 1) * 5 AS DOUBLE) / (c.rows - 1)) AS INT)) END"


@query("customer_summary_rfm_quintile", f"""WITH s AS (SELECT customer_id, count(*) AS total_orders, {M.format('o.total_amount', 'total_revenue')}, {A.format('o.total_amount', 'avg_order_value')}, min(o.total_amount) AS min_order_value, max(o.total_amount) AS max_order_value, sum(total_quantity)::BIGINT AS total_items_purchased, min(order_date) AS first_order_date, max(order_date) AS last_order_date FROM e_orders o GROUP BY 1), c AS (SELECT count(*) AS rows FROM s),
t AS (SELECT s.*, date_diff('day', first_order_date, last_order_date)::INT AS customer_lifetime_days, {AGE.format('last_order_date')}::INT AS days_since_last_order, {cut_sql('total_revenue', *CLASS)} AS customer_segment FROM s),
q AS (SELECT t.*, CAST(customer_lifetime_days AS DOUBLE) / nullif(total_orders - 1, 0) AS avg_days_between_orders, 6 - {_QUINTILE.format('days_since_last_order')} AS recency_score, {_QUINTILE.format('total_orders')} AS frequency_score, {_QUINTILE.format('total_revenue')} AS monetary_score FROM t, c)
SELECT *, recency_score * 100 + frequency_score * 10 + monetary_score AS rfm_score FROM q""")
def _(v):
    s = v("e_orders").groupBy("customer_id").agg(n().alias("total_orders"), money("total_amount", "total_revenue"), mean("total_amount").alias("avg_order_value"), F.min("total_amount").alias("min_order_value"), F.max("total_amount").alias("max_order_value"), F.sum("total_quantity").alias("total_items_purchased"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"))
    s = s.withColumn("customer_lifetime_days", F.date_diff("last_order_date", "first_order_date")).withColumn("days_since_last_order", F.date_diff(now(), "last_order_date")).withColumn("customer_segment", C.bucketize_right_closed(F.col("total_revenue"), *CLASS))
    s = s.withColumn("avg_days_between_orders", ratio("customer_lifetime_days", F.col("total_orders") - 1))
    scores = {"recency_score": "days_since_last_order", "frequency_score": "total_orders", "monetary_score": "total_revenue"}
    s = windows.global_orders(s, "customer_id", {**{name: (c, "row_number") for name, c in scores.items()}, "_rows": ("total_orders", "rows")})
    rows = F.col("_rows")
    for name in scores:
        # the place in ascending order, ties by the smaller id, from that in descending order
        fifth = F.greatest(F.lit(1), F.ceil((rows - F.col(name)) * 5 / F.greatest(rows - 1, F.lit(1)))).cast("int")
        s = s.withColumn(name, F.when(rows >= 5, 6 - fifth if name == "recency_score" else fifth))
    s = s.drop("_rows")
    return s.withColumn("rfm_score", F.col("recency_score") * 100 + F.col("frequency_score") * 10 + F.col("monetary_score"))


DIM_CUSTOMERS = f"""SELECT customer_id, name AS full_name, segment AS customer_segment, coalesce(lifetime_orders, 0) AS lifetime_orders, coalesce(lifetime_revenue, 0)::DECIMAL(28,2) AS lifetime_revenue, coalesce(avg_order_value, 0) AS avg_order_value, coalesce(distinct_order_days, 0) AS distinct_order_days, coalesce(completed_orders, 0) AS completed_orders, coalesce(cancelled_orders, 0) AS cancelled_orders, coalesce({AGE.format('last_order_date')}, 9999)::INT AS days_since_last_order, coalesce({AGE.format('first_order_date')}, 0)::INT AS days_since_first_order,
  CASE WHEN lifetime_revenue >= 1000 THEN 'Platinum' WHEN lifetime_revenue >= 500 THEN 'Gold' WHEN lifetime_revenue >= 200 THEN 'Silver' WHEN lifetime_revenue > 0 THEN 'Bronze' ELSE 'Prospect' END AS customer_value_tier,
  CASE WHEN {AGE.format('last_order_date')} <= 30 THEN 'Active' WHEN {AGE.format('last_order_date')} <= 90 THEN 'At Risk' WHEN {AGE.format('last_order_date')} <= 365 THEN 'Dormant' WHEN lifetime_orders IS NULL THEN 'Never Purchased' ELSE 'Churned' END AS activity_status, coalesce({R.format('completed_orders', 'lifetime_orders')} * 100, 0) AS completion_rate, coalesce({R.format('cancelled_orders', 'lifetime_orders')} * 100, 0) AS cancellation_rate
FROM v_customers LEFT JOIN (SELECT customer_id, count(*) AS lifetime_orders, sum(total_amount) AS lifetime_revenue, {A.format('total_amount', 'avg_order_value')}, min(order_date) AS first_order_date, max(order_date) AS last_order_date, count(DISTINCT order_date) AS distinct_order_days, count(*) FILTER (status = 'completed') AS completed_orders, count(*) FILTER (status = 'cancelled') AS cancelled_orders FROM v_orders GROUP BY 1) USING (customer_id)"""


def dim_customers(v) -> DataFrame:
    """Customers with what they ordered over their lifetime, value tier, activity and rates."""
    m = v("v_orders").groupBy("customer_id").agg(n().alias("o"), money("total_amount", "s"), mean("total_amount").alias("a"), F.min("order_date").alias("first"), F.max("order_date").alias("last"), F.countDistinct("order_date").alias("d"), flagged(F.col("status") == "completed", "done"), flagged(F.col("status") == "cancelled", "gone"))
    x = v("v_customers").join(m, "customer_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    x = x.select("customer_id", F.col("name").alias("full_name"), F.col("segment").alias("customer_segment"), zero("o").alias("lifetime_orders"), F.coalesce("s", F.lit(0)).cast("decimal(28,2)").alias("lifetime_revenue"), F.coalesce("a", F.lit(0.0)).alias("avg_order_value"), zero("d").alias("distinct_order_days"), zero("done").alias("completed_orders"), zero("gone").alias("cancelled_orders"), F.coalesce(F.date_diff(now(), "last"), F.lit(9999)).alias("days_since_last_order"), F.coalesce(F.date_diff(now(), "first"), F.lit(0)).alias("days_since_first_order"))
    spent, age = F.col("lifetime_revenue"), F.col("days_since_last_order")
    tier = F.when(spent >= 1000, "Platinum").when(spent >= 500, "Gold").when(spent >= 200, "Silver").when(spent > 0, "Bronze").otherwise("Prospect")
    active = F.when(age <= 30, "Active").when(age <= 90, "At Risk").when(age <= 365, "Dormant").when(F.col("lifetime_orders") == 0, "Never Purchased").otherwise("Churned")
    rate = lambda c: F.coalesce(ratio(c, "lifetime_orders", 100), F.lit(0.0))
    return x.select("*", tier.alias("customer_value_tier"), active.alias("activity_status"), rate("completed_orders").alias("completion_rate"), rate("cancelled_orders").alias("cancellation_rate"))


query("gold_dim_customers", DIM_CUSTOMERS)(dim_customers)


@query("gold_customer_rfm", f"""WITH d AS ({DIM_CUSTOMERS}), s AS (SELECT customer_id, full_name, customer_segment, days_since_last_order, lifetime_orders, lifetime_revenue, {step_sql('days_since_last_order', GOLD_RECENCY, False)} AS recency_score, {step_sql('lifetime_orders', FREQUENCY, True)} AS frequency_score, {step_sql('lifetime_revenue', MONETARY, True)} AS monetary_score FROM d), r AS (SELECT *, recency_score + frequency_score + monetary_score AS rfm_score FROM s), g AS (SELECT *, CASE WHEN rfm_score >= 13 THEN 'Champions' WHEN rfm_score >= 10 THEN 'Loyal Customers' WHEN rfm_score >= 7 THEN 'Potential Loyalists' WHEN rfm_score >= 4 THEN 'At Risk' ELSE 'Need Attention' END AS rfm_segment FROM r)
SELECT *, CASE rfm_segment WHEN 'Champions' THEN 'Loyalty rewards, early access' WHEN 'Loyal Customers' THEN 'Upsell, cross-sell' WHEN 'Potential Loyalists' THEN 'Nurture campaigns' WHEN 'At Risk' THEN 'Win-back campaigns' ELSE 'Re-engagement emails' END AS marketing_action FROM g""")
def _(v):
    s = dim_customers(v).select("customer_id", "full_name", "customer_segment", "days_since_last_order", "lifetime_orders", "lifetime_revenue", step("days_since_last_order", GOLD_RECENCY, False).alias("recency_score"), step("lifetime_orders", FREQUENCY, True).alias("frequency_score"), step("lifetime_revenue", MONETARY, True).alias("monetary_score"))
    s = s.withColumn("rfm_score", F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score"))
    x = F.col("rfm_score")
    s = s.withColumn("rfm_segment", F.when(x >= 13, "Champions").when(x >= 10, "Loyal Customers").when(x >= 7, "Potential Loyalists").when(x >= 4, "At Risk").otherwise("Need Attention"))
    g = F.col("rfm_segment")
    return s.withColumn("marketing_action", F.when(g == "Champions", "Loyalty rewards, early access").when(g == "Loyal Customers", "Upsell, cross-sell").when(g == "Potential Loyalists", "Nurture campaigns").when(g == "At Risk", "Win-back campaigns").otherwise("Re-engagement emails"))


@query("customer_order_sequence", f"SELECT order_id, row_number() OVER w AS order_sequence, lag(order_date) OVER w AS previous_order_date, date_diff('day', lag(order_date) OVER w, order_date)::INT AS days_since_last_order, row_number() OVER w > 1 AS is_repeat_customer, count(*) OVER c AS customer_lifetime_orders, CAST(sum(total_amount) OVER c AS DECIMAL(28,2)) AS customer_lifetime_value, CAST(sum(total_amount) OVER c AS DOUBLE) / count(*) OVER c AS customer_avg_order_value FROM v_orders WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id), c AS (PARTITION BY customer_id)")
def _(v):
    w, c = Window.partitionBy("customer_id").orderBy("order_date", "order_id"), Window.partitionBy("customer_id")
    before, spent = F.lag("order_date").over(w), F.sum("total_amount").over(c)
    return v("v_orders").select("order_id", F.row_number().over(w).cast("long").alias("order_sequence"), before.alias("previous_order_date"), F.date_diff("order_date", before).alias("days_since_last_order"), (F.row_number().over(w) > 1).alias("is_repeat_customer"), n().over(c).alias("customer_lifetime_orders"), spent.cast("decimal(28,2)").alias("customer_lifetime_value"), (spent.cast("double") / n().over(c)).alias("customer_avg_order_value"))


@query("customer_metrics_extract", f"SELECT customer_id, name, count(DISTINCT order_id) AS total_orders, CAST(coalesce(sum(total_amount), 0) AS DECIMAL(28,2)) AS total_spent, coalesce(CAST(sum(total_amount) AS DOUBLE) / nullif(count(total_amount), 0), 0) AS avg_order_value, min(order_date) AS first_order_date, max(order_date) AS last_order_date FROM v_customers LEFT JOIN v_orders USING (customer_id) GROUP BY 1, 2")
def _(v):
    o = v("v_orders").groupBy("customer_id").agg(F.countDistinct("order_id").alias("k"), F.sum("total_amount").alias("s"), mean("total_amount").alias("a"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"))
    return v("v_customers").join(o, "customer_id", "left").select("customer_id", "name", F.coalesce("k", F.lit(0)).cast("long").alias("total_orders"), F.coalesce("s", F.lit(0)).cast("decimal(28,2)").alias("total_spent"), F.coalesce("a", F.lit(0.0)).alias("avg_order_value"), "first_order_date", "last_order_date")


@query("customer_360", f"SELECT c.customer_id, c.name, c.segment, count(DISTINCT o.order_id) AS total_orders, CAST(sum(i.quantity) AS BIGINT) AS total_items, CAST(sum(i.total_price) AS DECIMAL(28,2)) AS total_revenue, date_diff('day', min(order_date), max(order_date))::INT AS lifetime_days, {AGE.format('max(order_date)')}::INT AS days_since_last_order FROM v_customers c LEFT JOIN v_orders o ON o.customer_id = c.customer_id LEFT JOIN e_items i ON i.order_id = o.order_id GROUP BY 1, 2, 3")
def _(v):
    # lines are rolled up to orders before the customer's sums: order_id is then distinct by itself
    i = v("e_items").groupBy("order_id").agg(F.sum("quantity").alias("q"), F.sum("total_price").alias("p"))
    o = v("v_orders").join(i, "order_id", "left").groupBy("customer_id").agg(n().alias("k"), F.sum("q").alias("total_items"), F.sum("p").cast("decimal(28,2)").alias("total_revenue"), F.date_diff(F.max("order_date"), F.min("order_date")).alias("lifetime_days"), F.date_diff(now(), F.max("order_date")).alias("days_since_last_order"))
    return v("v_customers").join(o, "customer_id", "left").select("customer_id", "name", "segment", F.coalesce("k", F.lit(0)).cast("long").alias("total_orders"), "total_items", "total_revenue", "lifetime_days", "days_since_last_order")
