"""Cleaning, derived fields, tiers and keys over the faulty views; each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import cleaning as K
from ledgerloom.operators.loading import deduplicate

from .retail import AS_OF, query

BATCH = "20010802000000"


def cut_sql(x: str, edges: list, labels: list[str]) -> str:
    """Right-closed bins in SQL."""
    parts = []
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        tests = ([f"{x} > {lo}"] if lo is not None else []) + ([f"{x} <= {hi}"] if hi is not None else [])
        parts.append(f"WHEN {' AND '.join(tests)} THEN '{label}'")
    return f"CASE {' '.join(parts)} END"


def cut_query(key: str, table: str, ids: list[str], x: str, bins: tuple, name: str) -> None:
    query(key, f"SELECT {', '.join(ids)}, {cut_sql(x, *bins)} AS {name} FROM {table}")(lambda v: v(table).select(*ids, C.bucketize_right_closed(F.expr(x), *bins).alias(name)))


cut_query("order_value_tier_cut", "d_orders", ["order_id", "total_amount"], "total_amount", K.ORDER_VALUE, "order_value_tier")
cut_query("quantity_tier", "d_items", ["item_id", "quantity"], "quantity", K.QUANTITY, "quantity_tier")
cut_query("product_price_tier_cut", "d_products", ["product_id", "price"], "price", K.PRODUCT_PRICE, "price_tier")


@query("shipping_speed_tier", f"SELECT order_id, date_diff('day', order_date, shipped_on)::INT AS days_to_ship, {cut_sql('date_diff(%sday%s, order_date, shipped_on)' % (chr(39), chr(39)), *K.SHIPPING_SPEED)} AS shipping_speed FROM v_orders")
def _(v):
    days = F.date_diff("shipped_on", "order_date")
    return v("v_orders").select("order_id", days.alias("days_to_ship"), C.bucketize_right_closed(days, *K.SHIPPING_SPEED).alias("shipping_speed"))


@query("product_stock_status_cut", f"SELECT product_id, stock_quantity > 0 AS is_in_stock, stock_quantity > 0 AND stock_quantity <= 10 AS is_low_stock, stock_quantity = 0 AS is_out_of_stock, {cut_sql('stock_quantity', *K.STOCK)} AS stock_status FROM d_products")
def _(v):
    q = F.col("stock_quantity")
    return v("d_products").select("product_id", (q > 0).alias("is_in_stock"), ((q > 0) & (q <= 10)).alias("is_low_stock"), (q == 0).alias("is_out_of_stock"), C.bucketize_right_closed(q, *K.STOCK).alias("stock_status"))


@query("product_margin_tier", f"WITH m AS (SELECT product_id, CAST(price - cost AS DOUBLE) / nullif(CAST(price AS DOUBLE), 0) * 100 AS profit_margin FROM d_products) SELECT product_id, profit_margin, {cut_sql('profit_margin', *K.MARGIN)} AS margin_tier FROM m")
def _(v):
    return K.product_margin(v("d_products")).select("product_id", "profit_margin", "margin_tier")


@query("order_flags_lower", "SELECT order_id, s IN ('completed','delivered','shipped') AS is_completed, s = 'cancelled' AS is_cancelled, s IN ('pending','processing') AS is_pending, s = 'returned' AS is_returned FROM (SELECT order_id, lower(trim(status)) AS s FROM d_orders)")
def _(v):
    s = F.lower(F.trim("status"))
    return v("d_orders").select("order_id", s.isin("completed", "delivered", "shipped").alias("is_completed"), (s == "cancelled").alias("is_cancelled"), s.isin("pending", "processing").alias("is_pending"), (s == "returned").alias("is_returned"))


@query("order_time_features", "SELECT order_id, year(order_date) AS order_year, month(order_date) AS order_month, quarter(order_date) AS order_quarter, week(order_date) AS order_week, isodow(order_date) - 1 AS order_day_of_week, day(order_date) AS order_day_of_month, isodow(order_date) >= 6 AS is_weekend, day(order_date) <= 7 AS is_month_start, day(order_date) >= 24 AS is_month_end, CASE WHEN month(order_date) IN (12,1,2) THEN 'winter' WHEN month(order_date) IN (3,4,5) THEN 'spring' WHEN month(order_date) IN (6,7,8) THEN 'summer' WHEN month(order_date) IN (9,10,11) THEN 'fall' END AS season, order_hour FROM v_orders")
def _(v):
    o = K.order_time_features(v("v_orders").select("order_id", "order_date", "order_hour"))
    whole = ("order_year", "order_month", "order_quarter", "order_week", "order_day_of_week", "order_day_of_month")
    return o.drop("order_date").withColumns({c: F.col(c).cast("long") for c in whole})


@query("standardize_column_names", "SELECT order_id, total_amount AS order_total, status AS order_status FROM v_orders")
def _(v):
    return K.standardize_column_names(v("v_orders").select(F.col("order_id").alias("Order ID"), F.col("total_amount").alias("Order-Total"), F.col("status").alias("ORDER_STATUS")))


@query("standardize_strings", "SELECT order_id, lower(trim(status)) AS status, lower(trim(payment_method)) AS payment_method, lower(trim(shipping_method)) AS shipping_method FROM d_orders")
def _(v):
    return K.standardize_strings(v("d_orders").select("order_id", "status", "payment_method", "shipping_method"))


TEXT_DATES = "CASE WHEN order_id % 9 = 0 THEN 'not a date' WHEN order_id % 9 = 1 THEN NULL ELSE CAST(order_date AS STRING) END"


@query("parse_dates", f"SELECT order_id, TRY_CAST(t AS TIMESTAMP) AS order_date, coalesce(TRY_CAST(t AS TIMESTAMP), TIMESTAMP '{AS_OF} 00:00:00') AS created_at FROM (SELECT order_id, {TEXT_DATES} AS t FROM v_orders)")
def _(v):
    o = v("v_orders").select("order_id", F.expr(TEXT_DATES).alias("order_date"), F.expr(TEXT_DATES).alias("created_at"))
    return K.parse_dates(o, ["order_date", "created_at", "updated_at"], AS_OF).select("order_id", F.col("order_date").cast("timestamp_ntz").alias("order_date"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


CLEAN_ORDERS = "SELECT order_id, customer_id, order_date, total_amount, coalesce(upper(trim(status)), 'UNKNOWN') AS status, coalesce(trim(payment_method), 'UNKNOWN') AS payment_method, coalesce(trim(shipping_method), 'STANDARD') AS shipping_method FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY order_date DESC, customer_id, total_amount) AS rn FROM d_orders WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND order_date IS NOT NULL AND total_amount >= 0) WHERE rn = 1"


@query("clean_orders", CLEAN_ORDERS)
def _(v):
    return K.clean_orders(v("d_orders")).select("order_id", "customer_id", "order_date", "total_amount", "status", "payment_method", "shipping_method")


@query("clean_order_items", "SELECT item_id, order_id, product_id, quantity, unit_price, greatest(least(coalesce(discount_percent, 0), 100), 0) AS discount_percent, coalesce(tax_amount, 0) AS tax_amount FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY order_id, product_id, quantity, unit_price) AS rn FROM d_items WHERE item_id IS NOT NULL AND order_id IS NOT NULL AND product_id IS NOT NULL AND quantity > 0 AND unit_price >= 0) WHERE rn = 1")
def _(v):
    return K.clean_order_items(v("d_items")).drop("discount_amount")


@query("line_item_pricing", "SELECT order_id, line_number, product_id, quantity, discount_amount, subtotal, total_price FROM e_items")
def _(v):
    return v("e_items").select("order_id", "line_number", "product_id", "quantity", "discount_amount", "subtotal", "total_price")


@query("line_item_profit", "SELECT order_id, line_number, product_id, unit_cost, profit_amount, profit_margin FROM e_items")
def _(v):
    return v("e_items").select("order_id", "line_number", "product_id", "unit_cost", "profit_amount", "profit_margin")


@query("enrich_orders", f"WITH o AS ({CLEAN_ORDERS}) SELECT order_id, customer_id, total_amount, status, strftime(order_date, '%Y%m%d')::INT AS order_date_key, year(order_date) AS order_year, month(order_date) AS order_month, day(order_date) AS order_day, dayofweek(order_date) + 1 AS order_dayofweek, isodow(order_date) >= 6 AS is_weekend, quarter(order_date) AS order_quarter, CASE WHEN total_amount < 50 THEN 'Small' WHEN total_amount < 100 THEN 'Medium' WHEN total_amount < 250 THEN 'Large' WHEN total_amount < 500 THEN 'XLarge' ELSE 'Premium' END AS order_size_tier, status IN ('COMPLETED','DELIVERED','SHIPPED') AS is_completed, status IN ('CANCELLED','REFUNDED') AS is_cancelled, status IN ('PENDING','PROCESSING','ON_HOLD') AS is_pending, segment AS customer_segment, country AS customer_country, city AS customer_city, registration_date AS customer_since, date_diff('day', registration_date, order_date)::INT AS customer_tenure_days, '{BATCH}' AS batch_id FROM o LEFT JOIN d_customers USING (customer_id)")
def _(v):
    o = K.enrich_orders(K.clean_orders(v("d_orders")), v("d_customers"), BATCH).drop("order_date", "payment_method", "shipping_method", "shipping_amount", "tax_amount")
    return o.withColumns({c: F.col(c).cast("long") for c in ("order_year", "order_month", "order_day", "order_dayofweek", "order_quarter")})


LINES = "SELECT i.order_id, line_number, quantity, unit_price, discount_percent, order_date, ship_date, delivered_on AS delivery_date FROM v_items i JOIN v_orders o ON o.order_id = i.order_id"
DERIVED = f"SELECT *, CAST(final_amount + tax_amount AS DECIMAL(18,6)) AS total_amount FROM (SELECT *, CAST(final_amount * 0.08 AS DECIMAL(18,6)) AS tax_amount FROM (SELECT *, CAST(line_total - discount_amount AS DECIMAL(18,4)) AS final_amount FROM (SELECT *, CAST(line_total * discount_percent * 0.01 AS DECIMAL(18,4)) AS discount_amount FROM (SELECT *, CAST(quantity * unit_price AS DECIMAL(18,2)) AS line_total FROM ({LINES})))))"


def lines(v):
    o = v("v_orders").select("order_id", "order_date", F.col("delivered_on").alias("delivery_date"))
    return v("v_items").select("order_id", "line_number", "quantity", "unit_price", "discount_percent", "ship_date").join(o, "order_id")


@query("order_derived_fields", f"SELECT order_id, line_number, line_total, discount_amount, final_amount, tax_amount, total_amount, date_diff('day', order_date, ship_date)::INT AS days_to_ship, date_diff('day', ship_date, delivery_date)::INT AS shipping_duration, date_diff('day', order_date, delivery_date)::INT AS total_fulfillment_days FROM ({DERIVED})")
def _(v):
    return K.order_derived_fields(lines(v)).drop("quantity", "unit_price", "discount_percent", "order_date", "ship_date", "delivery_date")


#: Units of USD for one of the currency; any other counts as 1.
RATES = {"EUR": "1.10", "GBP": "1.27", "CAD": "0.74", "AUD": "0.65"}
CURRENCY = "CASE order_id % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'CAD' WHEN 3 THEN 'AUD' WHEN 4 THEN 'USD' ELSE 'XXX' END"
AMOUNTS = ["line_total", "discount_amount", "final_amount", "tax_amount", "total_amount", "unit_price"]


@query("convert_currency", f"SELECT order_id, line_number, 'USD' AS currency, currency AS original_currency, rate AS exchange_rate, {', '.join(f'CAST({c} * rate AS DECIMAL(18,4)) AS {c}_usd' for c in AMOUNTS)} FROM (SELECT *, CAST(CASE currency WHEN 'EUR' THEN 1.10 WHEN 'GBP' THEN 1.27 WHEN 'CAD' THEN 0.74 WHEN 'AUD' THEN 0.65 ELSE 1.00 END AS DECIMAL(4,2)) AS rate FROM (SELECT *, {CURRENCY} AS currency FROM ({DERIVED})))")
def _(v):
    x = K.convert_currency(K.order_derived_fields(lines(v)).withColumn("currency", F.expr(CURRENCY)), RATES, AMOUNTS)
    return x.select("order_id", "line_number", "currency", "original_currency", "exchange_rate", *[f"{c}_usd" for c in AMOUNTS])


@query("customer_clean", r"SELECT customer_id, email, string_split(email, '@')[-1] AS email_domain, coalesce(regexp_matches(email, '^[\w.-]+@[\w.-]+\.\w+$'), false) AS is_valid_email, digits AS phone_clean, coalesce(length(digits) >= 10, false) AS has_valid_phone, split_part(full_name, ' ', 1) AS first_name, CASE WHEN contains(full_name, ' ') THEN substr(full_name, position(' ' IN full_name) + 1) END AS last_name FROM (SELECT customer_id, full_name, trim(lower(email)) AS email, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM d_customers)")
def _(v):
    return K.customer_clean(v("d_customers")).select("customer_id", "email", "email_domain", "is_valid_email", "phone_clean", "has_valid_phone", "first_name", "last_name")


@query("address_standardize", "SELECT customer_id, coalesce(CASE lower(trim(country)) WHEN 'usa' THEN 'United States' WHEN 'us' THEN 'United States' WHEN 'united states of america' THEN 'United States' WHEN 'uk' THEN 'United Kingdom' WHEN 'britain' THEN 'United Kingdom' WHEN 'great britain' THEN 'United Kingdom' END, country) AS country_standardized, trim(upper(state)) AS state, left(zip_code, 5) AS zip_code FROM d_customers")
def _(v):
    return K.address_standardize(v("d_customers")).select("customer_id", "country_standardized", "state", "zip_code")


@query("customer_age_tenure", f"SELECT customer_id, age, {cut_sql('age', *K.AGE)} AS age_group, days AS customer_tenure_days, floor(days / 30.0)::INT AS customer_tenure_months, coalesce(days <= 30, false) AS is_new_customer FROM (SELECT customer_id, floor(date_diff('day', birth_date, DATE '{AS_OF}') / 365.25::DOUBLE)::INT AS age, date_diff('day', registration_date, DATE '{AS_OF}')::INT AS days FROM d_customers)")
def _(v):
    return K.customer_age_tenure(v("d_customers"), AS_OF).select("customer_id", "age", "age_group", "customer_tenure_days", "customer_tenure_months", "is_new_customer")


TITLE = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


@query("product_clean", f"SELECT product_id, trim(name) AS product_name_clean, lower(trim(name)) AS product_name_lower, {TITLE.format(x='trim(category)')} AS category, trim(split_part({TITLE.format(x='trim(category)')}, '>', 1)) AS main_category FROM d_products")
def _(v):
    return K.product_clean(v("d_products")).select("product_id", "product_name_clean", "product_name_lower", "category", "main_category")


@query("ingest_products_clean", "SELECT CAST(product_id AS STRING) AS product_id, trim(name) AS name, CASE WHEN price < 0 THEN 0 ELSE price END AS price, CASE WHEN stock_quantity < 0 THEN 0 ELSE stock_quantity END AS stock_quantity FROM d_products")
def _(v):
    clip = lambda c: F.when(F.col(c) < 0, 0).otherwise(F.col(c)).alias(c)
    return v("d_products").select(F.trim(F.col("product_id").cast("string")).alias("product_id"), F.trim("name").alias("name"), clip("price"), clip("stock_quantity"))


@query("ingest_customers_clean", f"SELECT customer_id, lower(trim(email)) AS email, {TITLE.format(x='trim(first_name)')} AS first_name, {TITLE.format(x='trim(last_name)')} AS last_name FROM d_customers")
def _(v):
    return v("d_customers").select("customer_id", F.lower(F.trim("email")).alias("email"), F.initcap(F.trim("first_name")).alias("first_name"), F.initcap(F.trim("last_name")).alias("last_name"))


@query("clean_text", r"SELECT product_id, regexp_replace(regexp_replace(trim(t), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g') AS name FROM (SELECT product_id, concat('  é ', name, ' & -  ', brand) AS t FROM d_products)")
def _(v):
    return v("d_products").select("product_id", K.clean_text(F.concat(F.lit("  é "), F.coalesce("name", F.lit("")), F.lit(" & -  "), F.col("brand"))).alias("name"))


@query("silver_customers", f"SELECT customer_id, trim(first_name) AS first_name, trim(last_name) AS last_name, concat_ws(' ', trim(first_name), trim(last_name)) AS full_name, lower(trim(email)) AS email, regexp_replace(phone, '[^0-9+\\-]', '', 'g') AS phone, trim(city) AS city, upper(trim(state)) AS state, trim(country) AS country, trim(zip_code) AS postal_code, coalesce(segment, 'Unknown') AS customer_segment, registration_date, date_diff('day', registration_date, DATE '{AS_OF}')::INT AS tenure_days, true AS is_active FROM d_customers")
def _(v):
    return K.silver_customers(v("d_customers"), AS_OF)


@query("silver_products", "SELECT product_id, trim(name) AS product_name, trim(category) AS category, trim(subcategory) AS subcategory, trim(brand) AS brand, CAST(price AS DECIMAL(10,2)) AS price, CAST(cost AS DECIMAL(10,2)) AS cost, CASE WHEN price > 0 THEN CAST(price - cost AS DOUBLE) / CAST(price AS DOUBLE) * 100 ELSE 0.0 END AS profit_margin, CASE WHEN price < 20 THEN 'Budget' WHEN price < 50 THEN 'Standard' WHEN price < 100 THEN 'Premium' ELSE 'Luxury' END AS price_tier, coalesce(stock_quantity, 0) AS stock_quantity, CASE WHEN coalesce(stock_quantity, 0) <= 0 THEN 'Out of Stock' WHEN stock_quantity < 10 THEN 'Low Stock' WHEN stock_quantity < 50 THEN 'Medium Stock' ELSE 'In Stock' END AS stock_status, coalesce(stock_quantity, 0) > 0 AS is_available FROM d_products")
def _(v):
    return K.silver_products(v("d_products"))


SILVER_ORDERS = "SELECT order_id, customer_id, order_date, strftime(order_date, '%Y%m%d')::INT AS date_key, year(order_date)::INT AS order_year, month(order_date)::INT AS order_month, day(order_date)::INT AS order_day, lower(trim(status)) AS order_status, lower(trim(payment_method)) AS payment_method, coalesce(tax_amount, 0)::DECIMAL(10,2) AS tax_amount, coalesce(shipping_amount, 0)::DECIMAL(10,2) AS shipping_amount, coalesce(total_amount, 0)::DECIMAL(14,2) AS total_amount, CASE WHEN total_amount < 50 THEN 'Very Low' WHEN total_amount < 100 THEN 'Low' WHEN total_amount < 200 THEN 'Medium' WHEN total_amount < 500 THEN 'High' ELSE 'Very High' END AS order_value_tier, lower(status) = 'completed' AS is_completed, lower(status) IN ('shipped', 'completed') AS is_shipped, lower(status) = 'cancelled' AS is_cancelled FROM {t}"


@query("silver_orders", SILVER_ORDERS.format(t="d_orders"))
def _(v):
    return K.silver_orders(v("d_orders"))


@query("silver_order_items", "SELECT item_id, order_id, product_id, coalesce(quantity, 1) AS quantity, coalesce(unit_price, 0)::DECIMAL(10,2) AS unit_price, coalesce(discount_amount, 0)::DECIMAL(10,2) AS discount_amount, CAST(coalesce(quantity, 1) * coalesce(unit_price, 0) AS DECIMAL(18,2)) AS line_total, CAST(coalesce(quantity, 1) * coalesce(unit_price, 0) - coalesce(discount_amount, 0) AS DECIMAL(18,2)) AS net_amount, coalesce(discount_amount, 0) > 0 AS has_discount FROM d_items")
def _(v):
    return K.silver_order_items(v("d_items"))


@query("bronze_metadata", f"SELECT customer_id, email, TIMESTAMP '{AS_OF} 00:00:00' AS _ingested_at, 'crm' AS _source_system, '{BATCH}' AS _batch_id FROM d_customers")
def _(v):
    return K.with_bronze_metadata(v("d_customers").select("customer_id", "email"), "crm", BATCH, f"{AS_OF} 00:00:00")


@query("clickstream_enrich", "SELECT event_id, ts::DATE AS event_date, hour(ts)::INT AS event_hour, minute(ts)::INT AS event_minute, device_type IN ('mobile', 'tablet') AS is_mobile, user_id IS NOT NULL AS is_logged_in, CASE WHEN contains(page_url, '/product/') THEN 'product' WHEN contains(page_url, '/category/') THEN 'category' WHEN contains(page_url, '/cart') THEN 'cart' WHEN contains(page_url, '/checkout') THEN 'checkout' WHEN contains(page_url, '/search') THEN 'search' WHEN page_url = '/' THEN 'home' ELSE 'other' END AS page_type, referrer_url IS NOT NULL AS has_referrer, NOT contains(referrer_url, 'google') AND NOT contains(referrer_url, 'facebook') AND NOT contains(referrer_url, 'utm_') AS is_organic FROM v_events")
def _(v):
    return K.clickstream_enrich(v("v_events")).select("event_id", "event_date", "event_hour", "event_minute", "is_mobile", "is_logged_in", "page_type", "has_referrer", "is_organic")


@query("order_event_enrich", "SELECT order_id, order_date AS event_date, order_hour AS event_hour, CASE WHEN total_amount < 50 THEN 'Small' WHEN total_amount < 100 THEN 'Medium' WHEN total_amount < 250 THEN 'Large' ELSE 'Premium' END AS order_size_tier, total_amount >= 200 AS is_high_value FROM v_orders")
def _(v):
    return v("v_orders").select("order_id", F.col("order_date").alias("event_date"), F.col("order_hour").alias("event_hour"), C.tier(F.col("total_amount"), [50, 100, 250], ["Small", "Medium", "Large", "Premium"]).alias("order_size_tier"), (F.col("total_amount") >= 200).alias("is_high_value"))


@query("select_star_except", "SELECT customer_id AS c_customer_id_raw, name AS c_name_raw, segment AS c_segment_raw, registered_on AS c_registered_on_raw FROM v_customers")
def _(v):
    return K.select_star_except(v("v_customers"), ["nation_key", "balance"], "c_", "_raw")


@query("fill_missing_values", "SELECT order_id, coalesce(status, 'Unknown') AS status, coalesce(shipping_amount, 0) AS shipping_amount FROM d_orders")
def _(v):
    return v("d_orders").select("order_id", "status", F.coalesce("shipping_amount", F.lit(0).cast("decimal(10,2)")).alias("shipping_amount")).fillna({"status": "Unknown"})


@query("remove_duplicates", "SELECT order_id, customer_id, status, total_amount FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY order_date NULLS FIRST, customer_id NULLS FIRST, total_amount NULLS FIRST, status NULLS FIRST) AS rn FROM d_orders) WHERE rn = 1")
def _(v):
    return deduplicate(v("d_orders"), ["order_id"], ["order_date", "customer_id", "total_amount", "status"]).select("order_id", "customer_id", "status", "total_amount")


@query("clean_string_columns", "SELECT customer_id, trim(city) AS city, lower(trim(email)) AS email FROM d_customers")
def _(v):
    return v("d_customers").select("customer_id", F.trim("city").alias("city"), F.lower(F.trim("email")).alias("email"))


@query("standardize_dates", f"SELECT order_id, TRY_CAST(t AS DATE) AS order_date FROM (SELECT order_id, {TEXT_DATES} AS t FROM v_orders)")
def _(v):
    return v("v_orders").select("order_id", F.try_to_timestamp(F.expr(TEXT_DATES)).cast("date").alias("order_date"))


@query("net_amount", "SELECT i.order_id, CAST(o.total_amount - i.d + o.shipping_amount AS DECIMAL(18,2)) AS net_amount FROM v_orders o JOIN (SELECT order_id, sum(discount_amount) AS d FROM e_items GROUP BY 1) i USING (order_id)")
def _(v):
    d = v("e_items").groupBy("order_id").agg(F.sum("discount_amount").alias("d"))
    return v("v_orders").join(d, "order_id").select("order_id", (F.col("total_amount") - F.col("d") + F.col("shipping_amount")).cast("decimal(18,2)").alias("net_amount"))


@query("drop_null_and_dup_rows", "SELECT order_id, customer_id FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY customer_id) AS rn FROM d_orders WHERE order_id IS NOT NULL AND customer_id IS NOT NULL) WHERE rn = 1")
def _(v):
    return K.drop_null_and_dup_rows(v("d_orders").select("order_id", "customer_id"), ["order_id", "customer_id"], ["order_id"], ["customer_id"])


# ------------------------------------------------------------------ keys and scalar functions


@query("surrogate_key_md5", "SELECT order_id, customer_id, md5(coalesce(CAST(order_id AS VARCHAR), '_dbt_utils_surrogate_key_null_') || '-' || coalesce(CAST(customer_id AS VARCHAR), '_dbt_utils_surrogate_key_null_')) AS sk FROM d_orders")
def _(v):
    return v("d_orders").select("order_id", "customer_id", C.surrogate_key(F.col("order_id"), F.col("customer_id")).alias("sk"))


_BARE = "replace(replace(page_url, 'http://', ''), 'https://', '')"


@query("url_parts", f"SELECT event_id, split_part(split_part(replace(replace(replace(page_url, 'android-app://', ''), 'http://', ''), 'https://', ''), '/', 1), '?', 1) AS host, split_part(right({_BARE}, length({_BARE}) - coalesce(nullif(position('/' IN {_BARE}), 0), position('?' IN {_BARE}) - 1)), '?', 1) AS path, nullif(split_part(split_part(page_url, 'page=', 2), '&', 1), '') AS page FROM v_events")
def _(v):
    u = F.col("page_url")
    return v("v_events").select("event_id", C.url_host(u).alias("host"), C.url_path(u).alias("path"), C.url_parameter(u, "page").alias("page"))


_POINT = "CAST(a.nation_key * 6 - 70 AS DOUBLE) AS lat1, CAST(a.nation_key * 13 - 160 AS DOUBLE) AS lon1, CAST(b.nation_key * 6 - 70 AS DOUBLE) AS lat2, CAST(b.nation_key * 13 - 160 AS DOUBLE) AS lon2"


@query("haversine_distance", f"SELECT a, b, round(mi, 4) AS miles, round(mi * 1.60934::DOUBLE, 4) AS km FROM (SELECT a, b, 2 * 3961 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))) AS mi FROM (SELECT a.nation_key AS a, b.nation_key AS b, {_POINT} FROM v_nations a JOIN v_nations b ON a.region_key = b.region_key))")
def _(v):
    n = v("v_nations")
    at = lambda k, c: (F.col(c) * k[0] - k[1]).cast("double")
    pairs = n.select(F.col("nation_key").alias("a"), "region_key").join(n.select(F.col("nation_key").alias("b"), "region_key"), "region_key")
    p = [at((6, 70), "a"), at((13, 160), "a"), at((6, 70), "b"), at((13, 160), "b")]
    return pairs.select("a", "b", F.round(C.haversine(*p), 4).alias("miles"), F.round(C.haversine(*p, unit="km"), 4).alias("km"))


@query("safe_math", "SELECT order_id, coalesce(shipping_amount, 0) + coalesce(tax_amount, 0) AS added, coalesce(shipping_amount, 0) - coalesce(tax_amount, 0) AS subtracted, CAST(shipping_amount AS DOUBLE) / nullif(CAST(order_id % 3 AS DOUBLE), 0) AS divided FROM d_orders")
def _(v):
    a, b = F.col("shipping_amount"), F.col("tax_amount")
    return v("d_orders").select("order_id", C.safe_add(a, b).alias("added"), C.safe_subtract(a, b).alias("subtracted"), C.safe_divide(a.cast("double"), (F.col("order_id") % 3).cast("double")).alias("divided"))


@query("width_bucket_edges", "SELECT product_id, quantity, ((CASE WHEN quantity % 10 = 0 THEN 1 ELSE 0 END) + least(ceil((quantity - 5) / 10.0), 5))::INT AS bucket FROM v_items")
def _(v):
    return v("v_items").select("product_id", "quantity", C.width_bucket(F.col("quantity"), 5, 45, 4).alias("bucket"))
