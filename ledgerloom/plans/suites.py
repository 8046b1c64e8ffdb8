"""Quality suites over the faulty views; each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import quality
from ledgerloom.operators import suites as S
from ledgerloom.sources.scratch import scratch_path

from .retail import AS_OF, query
from .views import VIEWS

NOW = f"{AS_OF} 00:00:00"
crit, high, med, low = ({"severity": s} for s in ("critical", "high", "medium", "low"))

STATUSES = ["pending", "processing", "shipped", "delivered", "cancelled", "refunded"]
ORDERS = [
    {"check": "primary_key", "column": "order_id", **crit},
    *[{"check": "not_null", "column": c, **high} for c in ("order_id", "customer_id", "order_date", "total_amount")],
    {"check": "values_in_set", "column": "status", "valid_values": STATUSES, **med},
    {"check": "range", "column": "total_amount", "min_value": 0, **high},
    {"check": "range", "column": "quantity", "min_value": 1, **high},
    {"check": "no_future_dates", "column": "order_date", **high},
    {"check": "freshness", "column": "order_date", "max_age_hours": 24, **med},
    {"check": "cross_field", "name": "total_amount_consistency", "condition": "total_amount >= tax_amount * 0.9", **med},
]
CUSTOMERS = [
    {"check": "primary_key", "column": "customer_id", **crit},
    *[{"check": "not_null", "column": c, **high} for c in ("customer_id", "email")],
    {"check": "email_format", "column": "email", "threshold": 0.99, **med},
    {"check": "unique", "column": "email", **high},
    {"check": "phone_format", "column": "phone", "threshold": 0.95, **low},
]
PRODUCTS = [
    {"check": "primary_key", "column": "product_id", **crit},
    *[{"check": "not_null", "column": c, **high} for c in ("product_id", "name", "price")],
    {"check": "range", "column": "price", "min_value": 0, **high},
    {"check": "range", "column": "stock_quantity", "min_value": 0, **med},
    {"check": "not_null", "column": "category", "threshold": 0.95, **med},
]
COLUMNS = {
    "d_orders": {"order_id", "customer_id", "order_date", "total_amount", "status", "payment_method", "shipping_method", "shipping_amount", "tax_amount"},
    "d_customers": {"customer_id", "email", "phone"},
    "d_products": {"product_id", "name", "price", "stock_quantity", "category"},
}


def share_sql(holds: str, of: str = "true") -> str:
    return f"coalesce(CAST(count(*) FILTER (coalesce({holds}, false) AND {of}) AS DOUBLE) / nullif(count(*) FILTER ({of}), 0), 1.0)"


def value_sql(s: dict, table: str) -> str:
    """A check's value as a scalar subquery."""
    k, c = s["check"], s.get("column")
    filled = f"{c} IS NOT NULL"
    over = f" FROM {table}"
    if k == "not_null":
        return f"(SELECT {share_sql(filled)}{over})"
    if k == "completeness":
        return f"(SELECT ({' + '.join(share_sql(f'{x} IS NOT NULL') for x in s['columns'])}) / {len(s['columns'])}{over})"
    if k == "values_in_set":
        return "(SELECT " + share_sql(f"{c} IN ({', '.join(repr(x) for x in s['valid_values'])})", filled) + f"{over})"
    if k == "range":
        tests = [f"{c} {op} {s[key]}" for key, op in (("min_value", ">="), ("max_value", "<=")) if s.get(key) is not None]
        return f"(SELECT {share_sql(' AND '.join(tests), filled)}{over})"
    if k in ("regex", "email_format", "phone_format"):
        pattern = {"email_format": S.EMAIL, "phone_format": S.PHONE}.get(k) or s["pattern"]
        return f"(SELECT {share_sql(f'regexp_matches(CAST({c} AS VARCHAR), {chr(39)}^(?:{pattern}){chr(39)})', filled)}{over})"
    if k == "no_future_dates":
        return f"(SELECT {share_sql(f'{c} <= TIMESTAMP {chr(39)}{NOW}{chr(39)}', filled)}{over})"
    if k == "freshness":
        return f"(SELECT CAST(date_diff('second', CAST(max({c}) AS TIMESTAMP), TIMESTAMP '{NOW}') AS DOUBLE) / 3600{over})"
    if k == "cross_field":
        return f"(SELECT {share_sql(s['condition'])}{over})"
    if k == "not_empty":
        return f"(SELECT CAST(count(*) > 0 AS INT){over})"
    if k == "unique":
        return f"(SELECT coalesce(CAST(count(DISTINCT {c}) AS DOUBLE) / nullif(count({c}), 0), 1.0){over})"
    if k == "primary_key":
        return f"(SELECT coalesce(CAST(sum(CASE WHEN {filled} AND k = 1 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(k), 0), 1.0) FROM (SELECT {c}, count(*) AS k{over} GROUP BY 1))"
    if k == "referential":
        return f"(SELECT coalesce(CAST(count(*) FILTER ({c} IN (SELECT {s['reference_column']} FROM {s['reference']} WHERE {s['reference_column']} IS NOT NULL)) AS DOUBLE) / nullif(count(*), 0), 1.0){over} WHERE {filled})"
    if k == "outliers":
        return f"(SELECT coalesce(CAST(count(*) FILTER (x BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS DOUBLE) / nullif(count(*), 0), 1.0) FROM (SELECT CAST({c} AS DOUBLE) AS x, quantile_cont(CAST({c} AS DOUBLE), 0.25) OVER () AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) OVER () AS b{over} WHERE {filled}))"
    raise ValueError(k)


def suite_sql(specs: list[dict], table: str, dataset: str, columns: set[str] | None = None) -> str:
    parts = []
    for s in specs:
        lost = columns is not None and "column" in s and s["column"] not in columns
        t = float(s.get("threshold", s.get("max_age_hours", 1.0)))
        v = "0.0" if lost else value_sql(s, table)
        ok = "false" if lost else f"coalesce(v {'<=' if s['check'] == 'freshness' else '>='} {t}, false)"
        parts.append(f"SELECT '{dataset}' AS dataset, '{S.rule_name(s)}' AS rule_name, '{S.TYPES[s['check']]}' AS check_type, '{s.get('severity', 'medium')}' AS severity, {t}::DOUBLE AS expected_threshold, round(CAST(v AS DOUBLE), 6) AS actual_value, {ok} AS passed, {chr(39) + 'column not found' + chr(39) if lost else 'CAST(NULL AS VARCHAR)'} AS error FROM (SELECT {v} AS v)")
    return " UNION ALL ".join(parts)


def suite(key: str, specs: list[dict], table: str, dataset: str, columns: set[str] | None = None) -> None:
    query(key, suite_sql(specs, table, dataset, columns))(lambda v: S.run_checks(v(table), specs, dataset, NOW))


suite("dq_suite_orders", ORDERS, "d_orders", "orders", COLUMNS["d_orders"])
suite("dq_suite_customers", CUSTOMERS, "d_customers", "customers")
suite("dq_suite_products", PRODUCTS, "d_products", "products")
suite("dq_email", [{"check": "email_format", "column": "email", "threshold": 0.5, **med}], "d_customers", "customers")
suite("dq_phone", [{"check": "phone_format", "column": "phone", "threshold": 0.5, **med}], "d_customers", "customers")
suite("dq_freshness", [{"check": "freshness", "column": "order_date", "max_age_hours": 24, **med}, {"check": "freshness", "column": "order_date", "name": "year", "max_age_hours": 8760 * 40, **low}], "v_orders", "orders")
suite("dq_completeness", [{"check": "completeness", "columns": ["order_id", "customer_id", "order_date", "status", "payment_method", "shipping_method"], "threshold": 0.95, **med}], "d_orders", "orders")
suite("dq_table_not_empty", [{"check": "not_empty", **crit}], "d_orders", "orders")
suite("dq_value_distribution", [{"check": "range", "column": "total_amount", "min_value": 0, "max_value": 100000, "threshold": 0.99, **med}, {"check": "range", "column": "shipping_amount", "min_value": 0, "max_value": 9, **low}], "d_orders", "orders")

CONFIG = [
    {"check": "primary_key", "column": "order_id"}, {"check": "not_null", "column": "customer_id"}, {"check": "not_null", "column": "order_date"}, {"check": "range", "column": "total_amount", "min_value": 0},
    {"check": "values_in_set", "column": "status", "valid_values": ["pending", "processing", "shipped", "delivered", "cancelled"]},
]
suite("dq_from_config", CONFIG, "d_orders", "orders")


@query("dq_custom", f"SELECT 'orders' AS dataset, 'custom_round_amount' AS rule_name, 'custom' AS check_type, 'low' AS severity, 0.5::DOUBLE AS expected_threshold, round(v, 6) AS actual_value, v >= 0.5 AS passed, CAST(NULL AS VARCHAR) AS error FROM (SELECT {share_sql('total_amount > tax_amount')} AS v FROM d_orders)")
def _(v):
    return S.run_checks(v("d_orders"), [{"check": "custom", "name": "round_amount", "holds": lambda d: d["total_amount"] > d["tax_amount"], "threshold": 0.5, **low}], "orders", NOW)


_NUMBERS = ("order_id", "customer_id", "total_amount", "shipping_amount", "tax_amount")
_PROFILE = [
    *[{"check": "not_null", "column": c, "threshold": 0.95} for c in VIEWS["d_orders"][1]], *[{"check": "outliers", "column": c, "threshold": 0.95, **low} for c in _NUMBERS], {"check": "no_future_dates", "column": "order_date"},
]


@query("dq_profile_auto", suite_sql(_PROFILE, "d_orders", "orders"))
def _(v):
    o = v("d_orders")
    return S.run_checks(o, S.profile(o), "orders", NOW)


WAREHOUSE = {
    "d_customers": [{"check": "not_empty", **med}, {"check": "not_null", "column": "customer_id"}, {"check": "not_null", "column": "email", "threshold": 0.95}, {"check": "unique", "column": "customer_id"}, {"check": "values_in_set", "column": "segment", "valid_values": ["Premium", "Regular", "New", "VIP"]}],
    "d_products": [{"check": "not_empty"}, {"check": "not_null", "column": "product_id"}, {"check": "not_null", "column": "name"}, {"check": "unique", "column": "product_id"}, {"check": "range", "column": "price", "min_value": 0}, {"check": "range", "column": "cost", "min_value": -100, "max_value": 100}],
    "d_orders": [{"check": "not_empty"}, {"check": "not_null", "column": "order_id"}, {"check": "not_null", "column": "customer_id", "threshold": 0.95}, {"check": "unique", "column": "order_id"}, {"check": "range", "column": "total_amount", "name": "positive", "min_value": 0}, {"check": "range", "column": "tax_amount", "name": "tax_positive", "min_value": 0}, {"check": "range", "column": "total_amount", "min_value": 0, "max_value": 100000}, {"check": "values_in_set", "column": "status", "valid_values": ["pending", "processing", "shipped", "completed", "cancelled"]}, {"check": "referential", "column": "customer_id", "reference": "d_customers", "reference_column": "customer_id"}, {"check": "referential", "column": "order_date", "reference": "g_calendar", "reference_column": "full_date"}],
    "g_daily": [{"check": "not_empty"}, {"check": "range", "column": "net_revenue", "name": "positive", "min_value": 0}, {"check": "range", "column": "total_orders", "min_value": 0}, {"check": "unique", "column": "date_key"}],
    "g_calendar": [{"check": "not_empty"}, {"check": "unique", "column": "date_key"}],
}
LINES = [{"check": "not_empty"}, {"check": "unique", "column": "item_id"}, {"check": "range", "column": "quantity", "min_value": 1}, {"check": "range", "column": "unit_price", "min_value": 0}, {"check": "referential", "column": "product_id", "reference": "d_products", "reference_column": "product_id"}, {"check": "referential", "column": "order_id", "reference": "d_orders", "reference_column": "order_id"}]


def warehouse(v, of: dict[str, list[dict]] = WAREHOUSE) -> DataFrame:
    """Customers, products, orders, the daily sales and their calendar, each read once."""
    return S.run_suites({t: (v(t), specs) for t, specs in of.items()}, NOW)


WAREHOUSE_SQL = " UNION ALL ".join(suite_sql(specs, t, t) for t, specs in WAREHOUSE.items())
#: With the lines of orders
WHOLE = WAREHOUSE | {"d_items": LINES}
query("dq_suite_warehouse", " UNION ALL ".join(suite_sql(specs, t, t) for t, specs in WHOLE.items()))(lambda v: warehouse(v, WHOLE))
query("dq_suite_lines", suite_sql(LINES, "d_items", "fact_order_items"))(lambda v: S.run_checks(v("d_items"), LINES, "fact_order_items", NOW, {t: v(t) for t in ("d_products", "d_orders")}))

ALL_SQL = " UNION ALL ".join((suite_sql(ORDERS, "d_orders", "orders", COLUMNS["d_orders"]), suite_sql(CUSTOMERS, "d_customers", "customers"), suite_sql(PRODUCTS, "d_products", "products")))


def suites(v) -> DataFrame:
    return S.run_suites({name: (v(t), specs) for t, specs, name in (("d_orders", ORDERS, "orders"), ("d_customers", CUSTOMERS, "customers"), ("d_products", PRODUCTS, "products"))}, NOW)


_W = "CASE severity WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.75 ELSE 1.0 END"
SCORE_SQL = f"SELECT dataset, round(CAST(sum(CASE WHEN passed THEN {_W} ELSE 0 END) AS DOUBLE) / CAST(sum({_W}) AS DOUBLE), 6) AS overall_score, count(*) AS checks, count(*) FILTER (passed) AS passed_checks, count(*) FILTER (NOT passed) AS failed_checks, count(*) FILTER (NOT passed AND severity = 'critical') AS critical_failures FROM r GROUP BY 1"


@query("dq_score", f"WITH r AS ({ALL_SQL}) {SCORE_SQL}")
def _(v):
    return S.score(suites(v))


@query("dq_overall_summary", f"WITH r AS ({ALL_SQL}), s AS ({SCORE_SQL}) SELECT count(*) AS datasets, CAST(sum(checks) AS BIGINT) AS total_checks, CAST(sum(passed_checks) AS BIGINT) AS passed, CAST(sum(failed_checks) AS BIGINT) AS failed, round(avg(overall_score), 6) AS average_score, CAST(sum(critical_failures) AS BIGINT) AS critical_failures, round(CAST(sum(passed_checks) AS DOUBLE) / CAST(sum(checks) AS DOUBLE), 6) AS pass_rate, sum(critical_failures) > 0 AS has_critical_failures, CASE WHEN sum(failed_checks) = 0 THEN 'healthy' ELSE 'degraded' END AS overall_status FROM s")
def _(v):
    return S.overall(suites(v))


@query("dq_overall_status", f"WITH r AS ({WAREHOUSE_SQL}) SELECT CASE WHEN bool_and(passed) THEN 'healthy' ELSE 'degraded' END AS overall_status FROM r")
def _(v):
    return S.overall(warehouse(v)).select("overall_status")


# rows updated in the 24 hours before the run
DAY = f"updated_at >= TIMESTAMP '{NOW}' - INTERVAL '24' HOUR"
RECENT = {
    "r_customers": [*[{"check": "not_null", "column": c, **x} for c, x in (("customer_id", crit), ("email", high), ("first_name", med), ("last_name", med))], {"check": "unique", "column": "customer_id", **crit}, {"check": "unique", "column": "email", **high}, {"check": "email_format", "column": "email", **med}],
    "r_products": [*[{"check": "not_null", "column": c, **x} for c, x in (("product_id", crit), ("name", high), ("category", med), ("price", high))], {"check": "unique", "column": "product_id", **crit}, {"check": "range", "column": "price", "min_value": 0.01, "max_value": 100000, **high}, {"check": "range", "column": "stock_quantity", "min_value": 0, "max_value": 1000000, **med}],
    "r_orders": [*[{"check": "not_null", "column": c, **x} for c, x in (("order_id", crit), ("customer_id", crit), ("order_date", high), ("total_amount", high))], {"check": "unique", "column": "order_id", **crit}, {"check": "range", "column": "total_amount", "min_value": 0, "max_value": 1000000, **high}, {"check": "values_in_set", "column": "status", "valid_values": STATUSES, **med}, {"check": "freshness", "column": "updated_at", "max_age_hours": 24, **high}],
}


@query("dq_suite_recent", "WITH " + ", ".join(f"recent_{t} AS (SELECT * FROM {t} WHERE {DAY})" for t in RECENT) + " " + " UNION ALL ".join(suite_sql(specs, f"recent_{t}", t) for t, specs in RECENT.items()))
def _(v):
    return S.run_suites({t: (v(t).where(DAY), specs) for t, specs in RECENT.items()}, NOW)


@query("dq_unique", "WITH k AS (SELECT order_id, count(*) AS k FROM d_orders WHERE order_id IS NOT NULL GROUP BY 1) SELECT sum(k)::BIGINT AS total_count, count(*) AS unique_count, CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS duplicate_count, CAST(count(*) AS DOUBLE) / CAST(sum(k) AS DOUBLE) AS ratio FROM k")
def _(v):
    # counted by key first, so that no task holds all values
    k = v("d_orders").where("order_id IS NOT NULL").groupBy("order_id").agg(F.count(F.lit(1)).alias("k"))
    return k.agg(F.sum("k").alias("total_count"), F.count(F.lit(1)).alias("unique_count"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("duplicate_count"), F.try_divide(F.count(F.lit(1)).cast("double"), F.sum("k").cast("double")).alias("ratio"))


@query("dq_primary_key", "SELECT order_id, count(*) AS n, order_id IS NULL AS has_null FROM d_orders GROUP BY 1 HAVING count(*) > 1 OR order_id IS NULL")
def _(v):
    k = v("d_orders").groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    return k.where("n > 1 OR order_id IS NULL").withColumn("has_null", F.col("order_id").isNull())


@query("dq_values_in_set", f"SELECT status, count(*) AS n FROM d_orders WHERE status NOT IN ({', '.join(map(repr, STATUSES))}) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def _(v):
    return v("d_orders").where(~F.col("status").isin(*STATUSES)).groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status").limit(10)


@query("dq_range", f"SELECT {share_sql('price BETWEEN 20 AND 400', 'price IS NOT NULL')} AS in_range, min(price) AS actual_min, max(price) AS actual_max, count(*) FILTER (price < 20) AS below, count(*) FILTER (price > 400) AS above FROM d_products")
def _(v):
    p = F.col("price")
    return v("d_products").agg(S.share(p.between(20, 400), p.isNotNull()).alias("in_range"), F.min(p).alias("actual_min"), F.max(p).alias("actual_max"), F.count_if(p < 20).alias("below"), F.count_if(p > 400).alias("above"))


@query("dq_referential", "WITH k AS (SELECT customer_id, count(*) AS n FROM d_orders WHERE customer_id IS NOT NULL GROUP BY 1) SELECT CAST(sum(CASE WHEN c.customer_id IS NOT NULL THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS ratio, CAST(sum(CASE WHEN c.customer_id IS NULL THEN n ELSE 0 END) AS BIGINT) AS orphan_rows, count(*) FILTER (c.customer_id IS NULL) AS orphan_keys FROM k LEFT JOIN d_customers c USING (customer_id)")
def _(v):
    k = v("d_orders").where("customer_id IS NOT NULL").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    met = k.join(v("d_customers").select("customer_id", F.lit(True).alias("known")), "customer_id", "left")
    held = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return met.agg((held(F.col("known").isNotNull()).cast("double") / F.sum("n").cast("double")).alias("ratio"), held(F.col("known").isNull()).alias("orphan_rows"), F.count_if(F.col("known").isNull()).alias("orphan_keys"))


@query("join_anti_orphans", "SELECT order_id, customer_id FROM d_orders o WHERE customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_customers c WHERE c.customer_id = o.customer_id)")
def _(v):
    return quality.orphans(v("d_orders").select("order_id", "customer_id"), "customer_id", v("d_customers"), "customer_id").select("order_id", "customer_id")


@query("dq_no_duplicates", "SELECT order_id, count(*) AS n FROM d_orders GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return quality.duplicates(v("d_orders"), ["order_id"])


@query("dq_positive_amounts", "SELECT count(*) AS negative FROM d_orders WHERE total_amount < 0")
def _(v):
    return v("d_orders").where("total_amount < 0").agg(F.count(F.lit(1)).alias("negative"))


@query("dq_valid_status", f"SELECT lower(trim(status)) AS status, count(*) AS n FROM d_orders WHERE lower(trim(status)) NOT IN ({', '.join(map(repr, [*STATUSES, 'completed']))}) GROUP BY 1")
def _(v):
    s = F.lower(F.trim("status"))
    return v("d_orders").where(~s.isin(*STATUSES, "completed")).groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("dq_customer_order_counts", "SELECT customer_id, stored, coalesce(n, 0) AS actual FROM (SELECT customer_id, customer_id % 20 AS stored FROM v_customers) LEFT JOIN (SELECT customer_id, count(*) AS n FROM v_orders GROUP BY 1) USING (customer_id) WHERE stored <> coalesce(n, 0)")
def _(v):
    actual = v("v_orders").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    c = v("v_customers").select("customer_id", (F.col("customer_id") % 20).alias("stored")).join(actual, "customer_id", "left").withColumn("actual", F.coalesce("n", F.lit(0)).cast("long"))
    return c.where("stored <> actual").select("customer_id", "stored", "actual")


@query("dq_duplicate_orders", "SELECT order_id, count(*) AS count FROM d_orders GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return quality.duplicates(v("d_orders"), ["order_id"]).withColumnRenamed("n", "count")


@query("dq_negative_stock", "SELECT product_id, name, stock_quantity FROM d_products WHERE stock_quantity < 0")
def _(v):
    return v("d_products").where("stock_quantity < 0").select("product_id", "name", "stock_quantity")


@query("dq_results_log", f"WITH r AS ({ALL_SQL}) SELECT dataset, rule_name, passed, TIMESTAMP '{NOW}' AS checked_at FROM r")
def _(v):
    r = suites(v)
    path = scratch_path(r.sparkSession, "results")
    S.log_results(r, path, NOW)
    return r.sparkSession.read.parquet(path).select("dataset", "rule_name", "passed", "checked_at")


@query("dq_history", f"WITH r AS ({ALL_SQL}) SELECT dataset, rule_name, passed, checked_at FROM (SELECT *, TIMESTAMP '{NOW}' AS checked_at FROM r UNION ALL SELECT *, TIMESTAMP '2001-08-01 00:00:00' FROM r) ORDER BY checked_at DESC, dataset, rule_name LIMIT 20")
def _(v):
    r = suites(v)
    path = scratch_path(r.sparkSession, "results")
    S.log_results(r, path, "2001-08-01 00:00:00")
    S.log_results(r, path, NOW)
    return S.history(r.sparkSession.read.parquet(path), 20).select("dataset", "rule_name", "passed", "checked_at")


RULES = {"invalid_amount": "total_amount > 0", "no_customer": "customer_id IS NOT NULL", "future_date": f"order_date <= DATE '{AS_OF}'", "unknown_status": "lower(trim(status)) <> 'lost'"}


@query("quarantine_split", "SELECT order_id, total_amount, CASE WHEN reasons = '' THEN 'good' ELSE 'quarantined' END AS outcome, reasons FROM (SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{k}' END" for k, c in RULES.items()) + ") AS reasons FROM d_orders)")
def _(v):
    o = v("d_orders").select("order_id", "customer_id", "order_date", "status", "total_amount")
    path = scratch_path(o.sparkSession, "quarantine")
    quality.write_quarantined(o, {k: F.expr(c) for k, c in RULES.items()}, path)
    return o.sparkSession.read.parquet(path).select("order_id", "total_amount", "outcome", F.array_join("reasons", ",").alias("reasons"))


@query("quality_gate", f"WITH r AS ({ALL_SQL}), s AS ({SCORE_SQL}) SELECT CASE WHEN avg(overall_score) >= 0.9 THEN 'load' WHEN avg(overall_score) >= 0.7 THEN 'quarantine' ELSE 'fail' END AS path FROM s")
def _(v):
    a = F.col("average_score")
    return S.overall(suites(v)).select(F.when(a >= S.LOAD_AT, "load").when(a >= S.QUARANTINE_AT, "quarantine").otherwise("fail").alias("path"))


@query("assert_unique", "SELECT order_id, count(*) AS n FROM d_orders WHERE order_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return quality.duplicates(v("d_orders").where("order_id IS NOT NULL"), ["order_id"])


@query("assert_not_null", "SELECT order_id, total_amount FROM d_orders WHERE customer_id IS NULL")
def _(v):
    return v("d_orders").where("customer_id IS NULL").select("order_id", "total_amount")


@query("assert_relationships", "SELECT item_id, product_id FROM d_items WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM d_products WHERE price > 0)")
def _(v):
    return quality.orphans(v("d_items").select("item_id", "product_id"), "product_id", v("d_products").where("price > 0"), "product_id").select("item_id", "product_id")


@query("assert_positive_revenue", "SELECT order_date, CAST(sum(total_amount) AS DECIMAL(28,2)) AS revenue FROM d_orders GROUP BY 1 HAVING sum(total_amount) < 0")
def _(v):
    return v("d_orders").groupBy("order_date").agg(F.sum("total_amount").cast("decimal(28,2)").alias("revenue")).where("revenue < 0")
