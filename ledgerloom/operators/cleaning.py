"""Cleaning and derived fields of orders, lines, customers and products: DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C

from .loading import deduplicate

# Labels and edges of tiers.
ORDER_VALUE = ([0, 50, 100, 250, 500, None], ["Very Low", "Low", "Medium", "High", "Very High"])
SHIPPING_SPEED = ([-1, 1, 3, 7, None], ["Same Day", "Express", "Standard", "Delayed"])
QUANTITY = ([0, 1, 3, 10, None], ["Single", "Few", "Multiple", "Bulk"])
PRODUCT_PRICE = ([0, 25, 50, 100, 250, 500, None], ["Budget", "Economy", "Standard", "Premium", "Luxury", "Ultra Luxury"])
MARGIN = ([None, 0, 20, 40, 60, 100], ["Loss", "Low Margin", "Medium Margin", "High Margin", "Very High Margin"])
STOCK = ([-1, 0, 10, 50, 100, None], ["Out of Stock", "Low Stock", "Medium Stock", "Good Stock", "Overstocked"])
AGE = ([0, 18, 25, 35, 45, 55, 65, 100], ["Under 18", "18-24", "25-34", "35-44", "45-54", "55-64", "65+"])
REVENUE = ([0, 1000, 5000, 20000, None], ["Low Performer", "Medium Performer", "High Performer", "Top Performer"])
COUNTRIES = {"usa": "United States", "us": "United States", "united states of america": "United States", "uk": "United Kingdom", "britain": "United Kingdom", "great britain": "United Kingdom"}
EMAIL = r"^[\w\.-]+@[\w\.-]+\.\w+$"
TAX_RATE = "0.08"
SEASONS = {**dict.fromkeys((12, 1, 2), "winter"), **dict.fromkeys((3, 4, 5), "spring"), **dict.fromkeys((6, 7, 8), "summer"), **dict.fromkeys((9, 10, 11), "fall")}


def standardize_column_names(df: DataFrame) -> DataFrame:
    """Lower case, spaces and hyphens to underscores."""
    return df.toDF(*[c.lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def standardize_strings(df: DataFrame, keep: tuple[str, ...] = ("order_id", "customer_id", "product_id")) -> DataFrame:
    """String columns but ids trimmed and in lower case."""
    return df.select(*[F.lower(F.trim(f.name)).alias(f.name) if f.dataType.typeName() == "string" and f.name not in keep else F.col(f.name) for f in df.schema])


def parse_dates(df: DataFrame, columns: list[str], as_of: str, fill: str = "created_at") -> DataFrame:
    """Timestamps of text columns, null where they don't parse; a missing ``fill`` becomes ``as_of``."""
    parsed = {c: F.try_to_timestamp(F.col(c)) for c in columns if c in df.columns}
    if fill in parsed:
        parsed[fill] = F.coalesce(parsed[fill], F.lit(as_of).cast("timestamp"))
    return df.withColumns(parsed)


def clean_orders(orders: DataFrame) -> DataFrame:
    """Orders with id, customer, date and an amount of 0 or more, one per id, with defaults."""
    o = orders.where("order_id IS NOT NULL AND customer_id IS NOT NULL AND order_date IS NOT NULL AND total_amount >= 0")
    o = deduplicate(o, ["order_id"], [F.desc("order_date"), "customer_id", "total_amount"])
    return o.withColumns({"status": F.coalesce(F.upper(F.trim("status")), F.lit("UNKNOWN")), "payment_method": F.coalesce(F.trim("payment_method"), F.lit("UNKNOWN")), "shipping_method": F.coalesce(F.trim("shipping_method"), F.lit("STANDARD"))})


def clean_order_items(items: DataFrame) -> DataFrame:
    """Lines with ids, a positive quantity and a price, one per id; discounts within 0 and 100, no null tax."""
    i = items.where("item_id IS NOT NULL AND order_id IS NOT NULL AND product_id IS NOT NULL AND quantity > 0 AND unit_price >= 0")
    i = deduplicate(i, ["item_id"], ["order_id", "product_id", "quantity", "unit_price"])
    return i.withColumns({"discount_percent": F.greatest(F.least(F.coalesce("discount_percent", F.lit(0)), F.lit(100)), F.lit(0)), "tax_amount": F.coalesce("tax_amount", F.lit(0).cast("decimal(10,2)"))})


def order_derived_fields(lines: DataFrame) -> DataFrame:
    """Line total, discount, final amount, tax, total; days to ship, under way and in all."""
    total = (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)")
    off = (F.col("line_total") * F.col("discount_percent") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,4)")
    x = lines.withColumn("line_total", total).withColumn("discount_amount", off).withColumn("final_amount", (F.col("line_total") - F.col("discount_amount")).cast("decimal(18,4)"))
    x = x.withColumn("tax_amount", (F.col("final_amount") * F.lit(TAX_RATE).cast("decimal(3,2)")).cast("decimal(18,6)")).withColumn("total_amount", (F.col("final_amount") + F.col("tax_amount")).cast("decimal(18,6)"))
    days = lambda b, a: F.date_diff(b, a)
    return x.withColumns({"days_to_ship": days("ship_date", "order_date"), "shipping_duration": days("delivery_date", "ship_date"), "total_fulfillment_days": days("delivery_date", "order_date")})


def order_time_features(orders: DataFrame) -> DataFrame:
    """Parts of the order's date, weekend, first and last week of the month, season."""
    d = F.col("order_date")
    season = F.create_map(*[F.lit(x) for kv in SEASONS.items() for x in kv])
    return orders.withColumns(
        {
            "order_year": F.year(d), "order_month": F.month(d), "order_quarter": F.quarter(d), "order_week": F.weekofyear(d), "order_day_of_week": F.weekday(d), "order_day_of_month": F.dayofmonth(d),
            "is_weekend": F.weekday(d) >= 5, "is_month_start": F.dayofmonth(d) <= 7, "is_month_end": F.dayofmonth(d) >= 24, "season": season[F.month(d)],
        }
    )


def enrich_orders(orders: DataFrame, customers: DataFrame, batch_id: str) -> DataFrame:
    """Date parts, size tier and status flags of cleaned orders, the customer's attributes and tenure, the batch."""
    d = F.col("order_date")
    o = orders.withColumns(
        {
            "order_date_key": C.date_key(d), "order_year": F.year(d), "order_month": F.month(d), "order_day": F.dayofmonth(d), "order_dayofweek": F.dayofweek(d), "is_weekend": F.dayofweek(d).isin(1, 7), "order_quarter": F.quarter(d),
            "order_size_tier": C.tier(F.col("total_amount"), [50, 100, 250, 500], ["Small", "Medium", "Large", "XLarge", "Premium"]),
            "is_completed": F.col("status").isin("COMPLETED", "DELIVERED", "SHIPPED"), "is_cancelled": F.col("status").isin("CANCELLED", "REFUNDED"), "is_pending": F.col("status").isin("PENDING", "PROCESSING", "ON_HOLD"),
        }
    )
    # left to the planner: it broadcasts the customers while they are small and sorts beyond that
    c = customers.select("customer_id", F.col("segment").alias("customer_segment"), F.col("country").alias("customer_country"), F.col("city").alias("customer_city"), F.col("registration_date").alias("customer_since"))
    return o.join(c, "customer_id", "left").withColumn("customer_tenure_days", F.date_diff("order_date", "customer_since")).withColumn("batch_id", F.lit(batch_id))


def convert_currency(df: DataFrame, rates: dict[str, str], columns: list[str], target: str = "USD") -> DataFrame:
    """``<column>_usd`` beside each amount, the rate and the currency that it came in; an unknown currency counts as 1."""
    rate = F.coalesce(*[F.when(F.col("currency") == c, F.lit(r)) for c, r in rates.items()], F.lit("1.00")).cast("decimal(4,2)")
    x = df.withColumn("original_currency", F.col("currency")).withColumn("exchange_rate", rate)
    return x.withColumns({f"{c}_usd": (F.col(c) * F.col("exchange_rate")).cast("decimal(18,4)") for c in columns}).withColumn("currency", F.lit(target))


def customer_clean(customers: DataFrame) -> DataFrame:
    """E-mail, its domain and validity, digits of the phone and whether they suffice, first and last name of the full one."""
    x = customers.withColumn("email", F.trim(F.lower("email")))
    digits = F.regexp_replace("phone", r"[^0-9]", "")
    parts = F.split("full_name", " ", 2)
    return x.withColumns({"email_domain": F.element_at(F.split("email", "@"), -1), "is_valid_email": F.coalesce(F.col("email").rlike(EMAIL), F.lit(False)), "phone_clean": digits, "has_valid_phone": F.coalesce(F.length(digits) >= 10, F.lit(False)), "first_name": F.get(parts, F.lit(0)), "last_name": F.get(parts, F.lit(1))})


def address_standardize(customers: DataFrame) -> DataFrame:
    """Known names of countries to one form, state in upper case, five digits of the zip code."""
    known = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    return customers.withColumns({"country_standardized": F.coalesce(F.try_element_at(known, F.trim(F.lower("country"))), F.col("country")), "state": F.trim(F.upper("state")), "zip_code": F.substring("zip_code", 1, 5)})


def customer_age_tenure(customers: DataFrame, as_of: str) -> DataFrame:
    """Age and its group, days and months since the registration, whether it is 30 days old at most."""
    now = F.lit(as_of).cast("date")
    age = F.floor(F.date_diff(now, "birth_date") / F.lit(365.25)).cast("int")
    x = customers.withColumn("age", age).withColumn("age_group", C.bucketize_right_closed(F.col("age"), *AGE)).withColumn("customer_tenure_days", F.date_diff(now, "registration_date"))
    return x.withColumn("customer_tenure_months", F.floor(F.col("customer_tenure_days") / 30).cast("int")).withColumn("is_new_customer", F.coalesce(F.col("customer_tenure_days") <= 30, F.lit(False)))


def product_clean(products: DataFrame) -> DataFrame:
    """Trimmed and lower-cased name, category in title case and the part of it before the first ``>``."""
    x = products.withColumn("product_name_clean", F.trim("name")).withColumn("product_name_lower", F.lower(F.trim("name"))).withColumn("category", F.initcap(F.trim("category")))
    return x.withColumn("main_category", F.trim(F.split_part("category", F.lit(">"), F.lit(1))))


def product_margin(products: DataFrame) -> DataFrame:
    """Margin in per cent of the price, null without a price, and its tier; above 100 there is none."""
    margin = F.try_divide((F.col("price") - F.col("cost")).cast("double"), F.col("price").cast("double")) * 100
    return products.withColumn("profit_margin", margin).withColumn("margin_tier", C.bucketize_right_closed(F.col("profit_margin"), *MARGIN))


def clean_text(x: Column) -> Column:
    """Trimmed, runs of white space to one space, then all but letters, digits, underscores and white space gone."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+", " "), r"[^\p{L}\p{N}_\s]", "")


def silver_customers(raw: DataFrame, as_of: str) -> DataFrame:
    """Names, e-mail, phone, address and segment in their clean forms, with tenure."""
    first, last = F.trim("first_name"), F.trim("last_name")
    return raw.select(
        "customer_id", first.alias("first_name"), last.alias("last_name"), F.concat_ws(" ", first, last).alias("full_name"), F.lower(F.trim("email")).alias("email"), F.regexp_replace("phone", r"[^0-9+\-]", "").alias("phone"), F.trim("city").alias("city"), F.upper(F.trim("state")).alias("state"),
        F.trim("country").alias("country"), F.trim("zip_code").alias("postal_code"), F.coalesce("segment", F.lit("Unknown")).alias("customer_segment"), "registration_date", F.date_diff(F.lit(as_of).cast("date"), "registration_date").alias("tenure_days"), F.lit(True).alias("is_active"),
    )


def silver_products(raw: DataFrame) -> DataFrame:
    """Prices as decimals, margin, price tier, stock status and availability."""
    p = raw.withColumn("stock_quantity", F.coalesce("stock_quantity", F.lit(0)).cast("int"))
    margin = F.when(F.col("price") > 0, (F.col("price") - F.col("cost")).cast("double") / F.col("price").cast("double") * 100).otherwise(F.lit(0.0))
    return p.select(
        "product_id", F.trim("name").alias("product_name"), F.trim("category").alias("category"), F.trim("subcategory").alias("subcategory"), F.trim("brand").alias("brand"), F.col("price").cast("decimal(10,2)").alias("price"), F.col("cost").cast("decimal(10,2)").alias("cost"), margin.alias("profit_margin"),
        C.tier(F.col("price"), [20, 50, 100], ["Budget", "Standard", "Premium", "Luxury"]).alias("price_tier"), "stock_quantity", C.tier(F.col("stock_quantity"), [1, 10, 50], ["Out of Stock", "Low Stock", "Medium Stock", "In Stock"]).alias("stock_status"), (F.col("stock_quantity") > 0).alias("is_available"),
    )


def silver_orders(raw: DataFrame) -> DataFrame:
    """Date parts, status and method in lower case, amounts as decimals without nulls, value tier and flags."""
    d, status = F.col("order_date"), F.lower(F.trim("status"))
    money = lambda c, p: F.coalesce(c, F.lit(0)).cast(f"decimal({p},2)")
    o = raw.withColumn("total_amount", money("total_amount", 14))
    return o.select(
        "order_id", "customer_id", "order_date", F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), F.year(d).alias("order_year"), F.month(d).alias("order_month"), F.dayofmonth(d).alias("order_day"), status.alias("order_status"), F.lower(F.trim("payment_method")).alias("payment_method"),
        money("tax_amount", 10).alias("tax_amount"), money("shipping_amount", 10).alias("shipping_amount"), "total_amount", C.tier(F.col("total_amount"), [50, 100, 200, 500], ["Very Low", "Low", "Medium", "High", "Very High"]).alias("order_value_tier"),
        (F.lower("status") == "completed").alias("is_completed"), F.lower("status").isin("shipped", "completed").alias("is_shipped"), (F.lower("status") == "cancelled").alias("is_cancelled"),
    )


def silver_order_items(raw: DataFrame) -> DataFrame:
    """Quantities and amounts without nulls, line total, net amount, whether there is a discount."""
    i = raw.withColumns({"quantity": F.coalesce("quantity", F.lit(1)).cast("int"), "unit_price": F.coalesce("unit_price", F.lit(0)).cast("decimal(10,2)"), "discount_amount": F.coalesce("discount_amount", F.lit(0)).cast("decimal(10,2)")})
    i = i.withColumn("line_total", (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)"))
    return i.select("item_id", "order_id", "product_id", "quantity", "unit_price", "discount_amount", "line_total", (F.col("line_total") - F.col("discount_amount")).cast("decimal(18,2)").alias("net_amount"), (F.col("discount_amount") > 0).alias("has_discount"))


def with_bronze_metadata(df: DataFrame, source: str, batch_id: str, at: str) -> DataFrame:
    """When, whence and in which batch rows came in."""
    return df.withColumns({"_ingested_at": F.lit(at).cast("timestamp_ntz"), "_source_system": F.lit(source), "_batch_id": F.lit(batch_id)})


def clickstream_enrich(events: DataFrame) -> DataFrame:
    """Date, hour and minute, device and login flags, kind of page by its URL, origin of the visit."""
    url, ref = F.col("page_url"), F.col("referrer_url")
    kind = F.when(F.contains(url, F.lit("/product/")), "product").when(F.contains(url, F.lit("/category/")), "category").when(F.contains(url, F.lit("/cart")), "cart").when(F.contains(url, F.lit("/checkout")), "checkout").when(F.contains(url, F.lit("/search")), "search").when(url == "/", "home").otherwise("other")
    organic = ~F.contains(ref, F.lit("google")) & ~F.contains(ref, F.lit("facebook")) & ~F.contains(ref, F.lit("utm_"))
    return events.withColumns({"event_date": F.col("ts").cast("date"), "event_hour": F.hour("ts"), "event_minute": F.minute("ts"), "is_mobile": F.col("device_type").isin("mobile", "tablet"), "is_logged_in": F.col("user_id").isNotNull(), "page_type": kind, "has_referrer": ref.isNotNull(), "is_organic": organic})


def drop_null_and_dup_rows(df: DataFrame, required: list[str], keys: list[str], order: list) -> DataFrame:
    """Rows with all required columns, one per key."""
    return deduplicate(df.dropna(subset=required), keys, order)


def select_star_except(df: DataFrame, out: list[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """All columns but some, renamed with a prefix and suffix."""
    return df.select(*[F.col(c).alias(f"{prefix}{c}{suffix}") for c in df.columns if c not in out])
