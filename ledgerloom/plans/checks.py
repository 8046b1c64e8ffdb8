"""Quality queries; each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import assertions as A
from ledgerloom.operators import loading, quality

from .retail import AS_OF, query

STATUSES = ["completed", "processing", "shipped"]
as_of = lambda: F.lit(AS_OF).cast("date")

# ------------------------------------------------------------------ assertions


@query("assert_expression_is_true", "SELECT order_id, line_number FROM v_items WHERE NOT (quantity * unit_price < 500)")
def _(v):
    return A.expression_is_true(v("v_items"), F.col("quantity") * F.col("unit_price") < 500).select("order_id", "line_number")


@query("assert_accepted_range", "SELECT product_id, price FROM v_products WHERE price < 20 OR price > 400")
def _(v):
    return A.accepted_range(v("v_products"), "price", 20, 400).select("product_id", "price")


@query("assert_accepted_values", "SELECT status, count(*) AS n FROM v_orders WHERE status NOT IN ('completed','processing','shipped') GROUP BY 1")
def _(v):
    return A.accepted_values(v("v_orders"), "status", STATUSES)


@query("assert_not_accepted_values", "SELECT status, count(*) AS n FROM v_orders WHERE status IN ('cancelled','refunded') GROUP BY 1")
def _(v):
    return A.accepted_values(v("v_orders"), "status", ["cancelled", "refunded"], accept=False)


@query("assert_at_least_one", "SELECT customer_id FROM v_orders GROUP BY 1 HAVING count(CASE WHEN status = 'cancelled' THEN order_id END) = 0")
def _(v):
    o = v("v_orders").select("customer_id", F.when(F.col("status") == "cancelled", F.col("order_id")).alias("cancelled"))
    return A.at_least_one(o, "cancelled", ["customer_id"])


@query("assert_not_constant", "SELECT customer_id FROM v_orders GROUP BY 1 HAVING count(DISTINCT status) = 1")
def _(v):
    return A.not_constant(v("v_orders"), "status", ["customer_id"])


@query("assert_not_empty_string", "SELECT product_id FROM (SELECT product_id, CASE WHEN product_id % 7 = 0 THEN '  ' ELSE name END AS name FROM v_products) WHERE trim(name) = ''")
def _(v):
    p = v("v_products").withColumn("name", F.when(F.col("product_id") % 7 == 0, "  ").otherwise(F.col("name")))
    return A.not_empty_string(p, "name").select("product_id")


@query("assert_not_null_proportion", "SELECT payment_method, round(CAST(count(CASE WHEN order_id % 3 <> 0 THEN order_id END) AS DOUBLE) / count(*), 6) AS share FROM v_orders GROUP BY 1 HAVING CAST(count(CASE WHEN order_id % 3 <> 0 THEN order_id END) AS DOUBLE) / count(*) < 0.9")
def _(v):
    o = v("v_orders").select("payment_method", F.when(F.col("order_id") % 3 != 0, F.col("order_id")).alias("x"))
    return A.not_null_proportion(o, "x", 0.9, by=("payment_method",)).withColumn("share", F.round("share", 6))


@query("assert_recency", f"SELECT customer_id, max(order_date) AS latest FROM v_orders GROUP BY 1 HAVING max(order_date) < DATE '{AS_OF}' - INTERVAL 365 DAY")
def _(v):
    return A.recency(v("v_orders"), "order_date", AS_OF, 365, ["customer_id"])


@query("assert_sequential_values", "SELECT order_id, line_number, previous FROM (SELECT order_id, line_number, lag(line_number) OVER (PARTITION BY order_id ORDER BY line_number) AS previous FROM v_items) WHERE line_number <> previous + 1")
def _(v):
    return A.sequential_values(v("v_items").select("order_id", "line_number"), "line_number", ["order_id"])


@query("assert_sequential_dates", "SELECT order_date, previous FROM (SELECT order_date, lag(order_date) OVER (ORDER BY order_date) AS previous FROM (SELECT DISTINCT order_date FROM v_orders)) WHERE order_date <> previous + INTERVAL 1 DAY")
def _(v):
    # a row per day
    return A.sequential_values(v("v_orders").select("order_date").distinct(), "order_date", [], 1, "DAY")


@query("assert_ranges_without_gaps", "SELECT order_id, next_start FROM (SELECT order_id, order_date, lead(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS next_start FROM v_orders) WHERE NOT coalesce(order_date + INTERVAL 30 DAY = next_start, true)")
def _(v):
    o = v("v_orders").withColumn("ends", F.date_add("order_date", 30))
    return A.mutually_exclusive_ranges(o, "order_date", "ends", ["customer_id"], ["order_date", "order_id"], gaps="not_allowed").select("order_id", "next_start")


@query("assert_mutually_exclusive_ranges", "SELECT order_id, next_start FROM (SELECT order_id, order_date, lead(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS next_start FROM v_orders) WHERE order_date + INTERVAL 30 DAY > next_start")
def _(v):
    o = v("v_orders").withColumn("ends", F.date_add("order_date", 30))
    return A.mutually_exclusive_ranges(o, "order_date", "ends", ["customer_id"], ["order_date", "order_id"]).select("order_id", "next_start")


@query("assert_relationships_where", "SELECT order_id, customer_id FROM v_orders o WHERE status = 'completed' AND NOT EXISTS (SELECT 1 FROM v_customers c WHERE c.customer_id = o.customer_id AND c.balance > 0)")
def _(v):
    return A.relationships_where(v("v_orders"), "customer_id", v("v_customers"), "customer_id", F.col("status") == "completed", F.col("balance") > 0).select("order_id", "customer_id")


@query("assert_unique_combination", "SELECT product_id, quantity, count(*) AS n FROM v_items GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    return quality.duplicates(v("v_items"), ["product_id", "quantity"])


_SIDES = "FROM (SELECT {by} AS k, count(*) AS n FROM v_orders GROUP BY 1) a FULL JOIN (SELECT {by} AS k, count(*) AS n FROM d_orders GROUP BY 1) b USING (k)"


def sides(v):
    return v("v_orders"), v("d_orders")


@query("assert_equal_rowcount", "SELECT k AS status, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b " + _SIDES.format(by="status") + " WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def _(v):
    return A.equal_rowcount(*sides(v), ["status"])


@query("assert_fewer_rows_than", "SELECT k AS customer_id, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b " + _SIDES.format(by="customer_id") + " WHERE coalesce(a.n, 0) >= coalesce(b.n, 0)")
def _(v):
    return A.fewer_rows_than(*sides(v), ["customer_id"])


@query("assert_cardinality_equality", "SELECT k AS value, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b " + _SIDES.format(by="order_date") + " WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def _(v):
    a, b = sides(v)
    return A.cardinality_equality(a, "order_date", b, "order_date")


@query("join_full_outer_counts", "SELECT k AS payment_method, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b " + _SIDES.format(by="payment_method"))
def _(v):
    return A.group_counts(*sides(v), ["payment_method"])


@query("assert_equality", "(SELECT order_id, status, 'a' AS side FROM v_orders EXCEPT SELECT order_id, CASE WHEN status = 'shipped' THEN 'sent' ELSE status END, 'a' FROM v_orders) UNION ALL (SELECT order_id, CASE WHEN status = 'shipped' THEN 'sent' ELSE status END, 'b' FROM v_orders EXCEPT SELECT order_id, status, 'b' FROM v_orders)")
def _(v):
    o = v("v_orders").select("order_id", "status")
    return loading.except_both_ways(o, o.withColumn("status", F.when(F.col("status") == "shipped", "sent").otherwise(F.col("status"))))


# ------------------------------------------------------------------ checks


def ratio_sql(rules: dict[str, tuple[str, float]], table: str) -> str:
    """One row per rule, as ``quality.ratio_checks`` returns them."""
    part = "SELECT '{k}' AS rule_name, round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END), 6) AS actual_value, avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END) >= {t} AS passed FROM " + table
    return " UNION ALL ".join(part.format(k=k, c=c, t=t) for k, (c, t) in rules.items())


def ratio_query(key: str, table: str, rules: dict[str, tuple[str, float]], sql_rules: dict[str, str] | None = None) -> None:
    """Rules in SQL, the same text for both engines but where ``sql_rules`` says otherwise."""
    oracle = {k: ((sql_rules or {}).get(k, c), t) for k, (c, t) in rules.items()}
    query(key, ratio_sql(oracle, table))(lambda v: quality.ratio_checks(v(table), {k: (F.expr(c), t) for k, (c, t) in rules.items()}))


ratio_query("dq_not_null", "d_orders", {"order_id": ("order_id IS NOT NULL", 1.0), "customer_id": ("customer_id IS NOT NULL", 0.95), "status": ("status IS NOT NULL", 0.95), "shipping_method": ("shipping_method IS NOT NULL", 0.9)})
ratio_query("dq_regex", "d_customers", {"phone": ("coalesce(phone, '') RLIKE '^(?:[+]1 [(]555[)] [0-9]{7})$'", 0.9), "full_name": ("full_name RLIKE '^(?:Ann van .*)'", 0.5)}, {"phone": "regexp_matches(coalesce(phone, ''), '^(?:[+]1 [(]555[)] [0-9]{7})$')", "full_name": "regexp_matches(full_name, '^(?:Ann van .*)')"})
ratio_query("dq_no_future_dates", "d_orders", {"order_date": (f"order_date IS NULL OR order_date <= DATE '{AS_OF}'", 1.0)})
ratio_query("dq_cross_field", "d_items", {"discounted_total": ("discount_amount <= quantity * unit_price", 0.99), "tax": ("tax_amount <= quantity * unit_price", 0.5)})


@query("top_duplicates", "SELECT order_id, count(*) AS n FROM v_items GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, 1 LIMIT 10")
def _(v):
    return quality.duplicates(v("v_items"), ["order_id"]).orderBy(F.desc("n"), "order_id").limit(10)


@query("dq_freshness_days", f"SELECT max(order_date) AS latest, date_diff('day', max(order_date), DATE '{AS_OF}')::INT AS age, date_diff('day', max(order_date), DATE '{AS_OF}') <= 1 AS passed FROM v_orders")
def _(v):
    age = F.date_diff(as_of(), F.col("latest"))
    return v("v_orders").agg(F.max("order_date").alias("latest")).select("latest", age.alias("age"), (age <= 1).alias("passed"))


# Hours that a table's last change may lie back.
LIMITS = {"r_customers": 24, "r_products": 24, "r_orders": 4, "r_items": 4}


@query("dq_table_freshness_report", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, {h} AS max_hours, CAST(date_diff('second', max(updated_at), TIMESTAMP '{AS_OF} 00:00:00') AS DOUBLE) / 3600 AS hours_since_update, coalesce(date_diff('second', max(updated_at), TIMESTAMP '{AS_OF} 00:00:00') <= {h} * 3600, false) AS passed FROM {t}" for t, h in LIMITS.items()))
def _(v):
    now, last = F.lit(f"{AS_OF} 00:00:00").cast("timestamp"), F.max("updated_at").cast("timestamp")
    hours = F.timestamp_diff("SECOND", last, now).cast("double") / 3600
    parts = [v(t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.lit(h).alias("max_hours"), hours.alias("hours_since_update"), F.coalesce(hours <= h, F.lit(False)).alias("passed")) for t, h in LIMITS.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("dq_outliers_zscore", "SELECT order_id, total_amount FROM d_orders, (SELECT avg(CAST(total_amount AS DOUBLE)) AS m, stddev_samp(CAST(total_amount AS DOUBLE)) AS s FROM d_orders) WHERE abs(CAST(total_amount AS DOUBLE) - m) > 3 * s")
def _(v):
    return quality.outliers_zscore(v("d_orders").select("order_id", "total_amount"), "total_amount")


@query("dq_value_range_violations", "SELECT count(*) AS n FROM v_items WHERE quantity < 5 OR quantity > 45")
def _(v):
    return A.accepted_range(v("v_items"), "quantity", 5, 45).agg(F.count(F.lit(1)).alias("n"))


@query("dq_null_percentage", "SELECT round(100.0::DOUBLE * count(*) FILTER (order_id % 10 = 0) / count(*), 4) AS pct, 100.0::DOUBLE * count(*) FILTER (order_id % 10 = 0) / count(*) <= 5 AS passed FROM v_orders")
def _(v):
    holed = v("v_orders").select(F.when(F.col("order_id") % 10 != 0, F.col("order_id")).alias("x"))
    pct = F.lit(100.0) * F.count_if(F.col("x").isNull()) / F.count(F.lit(1))
    return holed.agg(F.round(pct, 4).alias("pct"), (pct <= 5).alias("passed"))


@query("dq_order_totals_consistent", "SELECT order_id, total_amount, CAST(s AS DECIMAL(28,2)) AS items_total FROM v_orders LEFT JOIN (SELECT order_id, sum(quantity * unit_price) AS s FROM v_items GROUP BY 1) USING (order_id) WHERE abs(total_amount - coalesce(s, 0)) > 0.01")
def _(v):
    s = v("v_items").groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(28,2)").alias("items_total"))
    off = F.abs(F.col("total_amount") - F.coalesce("items_total", F.lit(0).cast("decimal(28,2)"))) > F.lit("0.01").cast("decimal(3,2)")
    return v("v_orders").join(s, "order_id", "left").where(off).select("order_id", "total_amount", "items_total")


@query("require_fields", "SELECT order_id FROM v_orders WHERE order_id IS NOT NULL AND nullif(customer_id % 5, 0) IS NOT NULL")
def _(v):
    return v("v_orders").withColumn("customer_id", F.nullif(F.col("customer_id") % 5, F.lit(0))).dropna(subset=["order_id", "customer_id"]).select("order_id")
