"""Files, joins by lookup, reshaping, loading and history, streams; each query beside its SQL.

Files, tables and streams are written from the views into the shared folder first.
"""

from __future__ import annotations

import datetime
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import incremental as I
from ledgerloom.operators import jobs as J
from ledgerloom.operators import loading as L
from ledgerloom.sources import files
from ledgerloom.sources.scratch import scratch_path
from ledgerloom.streaming import events as S
from ledgerloom.streaming import ledger as T

from .analytics import WAREHOUSE_MARTS
from .cleaning import BATCH
from .marts import A, M, mean, money, n
from .retail import AS_OF, query

PRODUCT_SCHEMA = "product_id bigint, name string, brand string, category string, price decimal(12,2), stock_quantity int"
PRODUCT = ["product_id", "name", "brand", "category", "price", "stock_quantity"]
PRODUCT_SQL = f"SELECT {', '.join(PRODUCT)} FROM v_products"


def products(v) -> DataFrame:
    return v("v_products").select(*PRODUCT)


def new_path(df: DataFrame, what: str = "files") -> tuple[SparkSession, str]:
    return df.sparkSession, scratch_path(df.sparkSession, what)


# ------------------------------------------------------------------ files


@query("scan_parquet", "SELECT order_id, total_amount FROM v_orders WHERE total_amount > 500")
def _(v):
    # the bound on the stored column reaches the scan's row groups; the view's own amount decides
    return v("v_orders", "o_totalprice > 249000").where("total_amount > 500").select("order_id", "total_amount")


@query("scan_csv", f"SELECT product_id, name, price FROM ({PRODUCT_SQL})")
def _(v):
    p = products(v)
    spark, path = new_path(p)
    files.sink(p, path, "csv", header=True, sep="|")
    return files.scan_csv(spark, path, PRODUCT_SCHEMA, ["product_id", "name", "price"], sep="|")


@query("scan_csv_directory", f"SELECT product_id, name, true AS from_csv FROM ({PRODUCT_SQL})")
def _(v):
    p = products(v)
    spark, path = new_path(p)
    files.sink(p.repartition(3), path, "csv", header=True)
    return files.scan_csv_directory(spark, path, PRODUCT_SCHEMA, "part-*.csv").select("product_id", "name", F.endswith("_source_file", F.lit(".csv")).alias("from_csv"))


def in_pages(p: DataFrame, rows: int) -> DataFrame:
    """Products with the number of their page of so many ids: pages grow in number with the table, not in size."""
    return p.withColumn("page", F.floor(F.col("product_id") / rows))


@query("scan_json", f"SELECT product_id, name, price FROM ({PRODUCT_SQL})")
def _(v):
    p = products(v)
    spark, path = new_path(p)
    # an envelope a page of products
    in_pages(p, 500).groupBy("page").agg(F.collect_list(F.struct("product_id", "name", "price")).alias("data")).write.partitionBy("page").json(path)
    return files.scan_json(spark, path, "product_id: bigint, name: string, price: decimal(12,2)", "data")


@query("scan_json_array", f"SELECT product_id, name, price FROM ({PRODUCT_SQL})")
def _(v):
    p = products(v)
    spark, path = new_path(p)
    # a plain array a file
    in_pages(p, 500).groupBy("page").agg(F.to_json(F.collect_list(F.struct("product_id", "name", "price"))).alias("value")).write.partitionBy("page").text(path)
    return files.scan_json(spark, path, "product_id bigint, name string, price decimal(12,2)").select("product_id", "name", "price")


@query("scan_jsonl", f"SELECT product_id, category, stock_quantity FROM ({PRODUCT_SQL})")
def _(v):
    p = products(v)
    spark, path = new_path(p)
    files.sink(p, path, "json")
    return files.scan_jsonl(spark, path, PRODUCT_SCHEMA).select("product_id", "category", "stock_quantity")


@query("scan_paged_json", "SELECT product_id // 25 AS page, product_id FROM v_products")
def _(v):
    p = in_pages(v("v_products").select("product_id"), 25)
    spark, path = new_path(p)
    pages = p.groupBy("page").agg(F.collect_list(F.struct("product_id")).alias("items"))
    # an empty page ends the reading; one that lies beyond it must not be read
    beyond = p.agg(F.max("page").alias("last")).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), "last").select((F.col("last") + F.col("k")).alias("page"), F.expr("CASE WHEN k = 1 THEN cast(array() AS array<struct<product_id: bigint>>) ELSE array(struct(-1L AS product_id)) END AS items"))
    # pages are landed many to a file, a line each
    pages.unionByName(beyond).write.json(path)
    return files.scan_paged_json(spark, path, "product_id: bigint", "items", 25, lines=True)


@query("scan_files_generic", f"SELECT product_id, brand, 'orc' AS kind FROM ({PRODUCT_SQL})")
def _(v):
    p = products(v)
    spark, path = new_path(p)
    files.sink(p, path, "orc", partition_by=("brand",))
    return files.scan_files(spark, path, "orc").select("product_id", "brand", F.element_at(F.split("_source_file", r"\."), -1).alias("kind"))


@query("scan_parquet_partitioned", f"SELECT product_id, name, brand FROM ({PRODUCT_SQL}) WHERE brand = 'Brand#13'")
def _(v):
    p = products(v)
    spark, path = new_path(p)
    files.sink(p, path, partition_by=("brand",))
    return spark.read.parquet(path).where("brand = 'Brand#13'").select("product_id", "name", "brand")  # prunes partitions


@query("load_csv_with_nulls", "SELECT customer_id, email, phone FROM d_customers UNION ALL SELECT customer_id, email, phone FROM d_customers")
def _(v):
    c = v("d_customers").select("customer_id", "email", "phone")
    spark, path = new_path(c)
    files.sink(c, f"{path}-csv", "csv", header=True, sep=";", nullValue="\\N", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    loaded = files.scan_csv(spark, f"{path}-csv", "customer_id bigint, email string, phone string", sep=";", null="\\N")
    for _ in range(2):
        files.sink(loaded, path, mode="append")
    return spark.read.parquet(path)


def _round_trip(fmt: str):
    def run(v) -> DataFrame:
        p = products(v)
        spark, path = new_path(p)
        files.sink(p, path, fmt, **({"header": True} if fmt == "csv" else {"compression": "gzip"}))
        return spark.read.schema(PRODUCT_SCHEMA).options(**({"header": True} if fmt == "csv" else {})).format(fmt).load(path)

    return run


for _fmt in ("parquet", "csv", "json"):
    query(f"sink_{_fmt}", PRODUCT_SQL)(_round_trip(_fmt))


@query("sink_lake_hourly", "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour FROM v_events")
def _(v):
    e = v("v_events").select("event_id", "ts")
    spark, path = new_path(e)
    files.sink_lake_hourly(e, path, "ts")
    return spark.read.parquet(path).select("event_id", "year", "month", "day", "hour")


@query("sink_multi_output", "SELECT 'completed' AS output, count(*) AS n FROM v_orders WHERE status = 'completed' UNION ALL SELECT 'cancelled', count(*) FROM v_orders WHERE status = 'cancelled' UNION ALL SELECT 'amounts', count(*) FROM v_orders")
def _(v):
    o = v("v_orders")
    spark, path = new_path(o)
    files.sink_multi_output(o, {f"{path}/completed": (F.col("status") == "completed", ["order_id", "total_amount"]), f"{path}/cancelled": (F.col("status") == "cancelled", ["order_id"]), f"{path}/amounts": (F.lit(True), ["order_id", "total_amount", "order_date"])})
    parts = [spark.read.parquet(f"{path}/{k}").agg(n().alias("n")).select(F.lit(k).alias("output"), "n") for k in ("completed", "cancelled", "amounts")]
    return parts[0].union(parts[1]).union(parts[2])


@query("extract_date_slice", "SELECT order_id, total_amount, order_date FROM v_orders WHERE order_date = DATE '1997-03-04' OR shipped_on >= DATE '1998-08-01'")
def _(v):
    return v("v_orders").where("order_date = DATE '1997-03-04' OR shipped_on >= DATE '1998-08-01'").select("order_id", "total_amount", "order_date")


@query("sql_with_params", f"SELECT segment, count(*) AS orders, {M.format('total_amount', 'revenue')} FROM v_orders JOIN v_customers USING (customer_id) WHERE status = 'completed' AND order_date >= DATE '1996-01-01' GROUP BY 1")
def _(v):
    o = v("v_orders")
    text = "SELECT segment, count(*) AS orders, CAST(sum(total_amount) AS DECIMAL(28,2)) AS revenue FROM {o} JOIN {c} USING (customer_id) WHERE status = :status AND order_date >= :since GROUP BY segment"
    return o.sparkSession.sql(text, args={"status": "completed", "since": datetime.date(1996, 1, 1)}, o=o, c=v("v_customers"))


# ------------------------------------------------------------------ joins with itself and by lookup


@query("join_self_pairs", "SELECT a.order_id, a.line_number AS first_line, b.line_number AS second_line FROM v_items a JOIN v_items b ON a.order_id = b.order_id AND a.product_id < b.product_id WHERE a.discount_percent = b.discount_percent")
def _(v):
    side = lambda name: v("v_items").select("order_id", F.col("product_id").alias(f"_{name}"), F.col("line_number").alias(f"{name}_line"), "discount_percent")
    return side("first").join(side("second"), ["order_id", "discount_percent"]).where("_first < _second").select("order_id", "first_line", "second_line")


@query("join_self_yoy", f"WITH m AS (SELECT date_trunc('month', order_date)::DATE AS month, {M.format('total_amount', 'revenue')} FROM v_orders GROUP BY 1) SELECT a.month, a.revenue, b.revenue AS last_year FROM m a LEFT JOIN m b ON b.month = a.month - INTERVAL 1 YEAR")
def _(v):
    m = v("v_orders").groupBy(F.trunc("order_date", "month").alias("month")).agg(money("total_amount", "revenue"))
    old = m.select(F.add_months("month", 12).alias("month"), F.col("revenue").alias("last_year"))
    return m.join(old, "month", "left")


@query("join_lookup_key", "SELECT order_id, CAST('0x' || substr(md5(CAST(c.customer_id AS VARCHAR)), 1, 8) AS BIGINT) AS customer_key FROM v_orders o LEFT JOIN (SELECT customer_id FROM v_customers WHERE customer_id % 11 <> 0) c USING (customer_id)")
def _(v):
    current = v("v_customers").where("customer_id % 11 <> 0").select("customer_id", C.md5_surrogate_int(F.col("customer_id")).alias("customer_key"))
    return v("v_orders").join(current, "customer_id", "left").select("order_id", "customer_key")


GEO = "SELECT CAST(10000 + nation_key * 20 AS STRING) AS zip_code, CAST(nation_key * 6 - 70 AS DOUBLE) AS latitude, CAST(nation_key * 13 - 160 AS DOUBLE) AS longitude, nation FROM v_nations"


@query("join_geo", f"SELECT c.customer_id, zip, latitude, longitude, nation FROM (SELECT customer_id, left(zip_code, 5) AS zip FROM d_customers) c LEFT JOIN ({GEO}) g ON g.zip_code = c.zip")
def _(v):
    g = v("v_nations").select((10000 + F.col("nation_key") * 20).cast("string").alias("zip"), (F.col("nation_key") * 6 - 70).cast("double").alias("latitude"), (F.col("nation_key") * 13 - 160).cast("double").alias("longitude"), "nation")
    return v("d_customers").select("customer_id", F.substring("zip_code", 1, 5).alias("zip")).join(g, "zip", "left")


@query("join_weather", "WITH w AS (SELECT order_date AS date, count(*) % 30 AS temperature FROM v_orders WHERE order_id % 2 = 0 GROUP BY 1) SELECT order_id, order_date, temperature FROM v_orders LEFT JOIN w ON w.date = order_date")
def _(v):
    o = v("v_orders").select("order_id", "order_date")
    w = o.where("order_id % 2 = 0").groupBy("order_date").agg((n() % 30).alias("temperature"))  # readings of the days that have any
    return o.join(w, "order_date", "left").select("order_id", "order_date", "temperature")


HOLIDAYS = ["1996-01-01", "1996-12-25", "1997-01-01", "1997-07-04", "1997-12-25"]


@query("flag_holidays", f"SELECT order_id, order_date IN ({', '.join(f'DATE {chr(39)}{h}{chr(39)}' for h in HOLIDAYS)}) AS is_holiday FROM v_orders")
def _(v):
    return v("v_orders").select("order_id", F.col("order_date").isin(*[F.lit(h).cast("date") for h in HOLIDAYS]).alias("is_holiday"))


ADDRESSES = "SELECT customer_id, zip_code, k = customer_id % 2 AS is_primary FROM d_customers, (VALUES (0), (1)) t(k)"


@query("join_primary_address", f"SELECT customer_id, name, zip_code FROM v_customers LEFT JOIN ({ADDRESSES}) a USING (customer_id) WHERE coalesce(is_primary, true)")
def _(v):
    a = v("d_customers").select("customer_id", "zip_code", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("is_primary", F.col("k") == F.col("customer_id") % 2)
    return v("v_customers").select("customer_id", "name").join(a.where("is_primary").select("customer_id", "zip_code"), "customer_id", "left")


INVENTORY = "SELECT product_id, stock_quantity, stock_quantity // 4 AS reserved_quantity FROM v_products WHERE product_id % 9 <> 0"


def inventory(v) -> DataFrame:
    return v("v_products").where("product_id % 9 <> 0").select("product_id", "stock_quantity", F.floor(F.col("stock_quantity") / 4).alias("reserved_quantity"))


@query("join_inventory", f"SELECT product_id, p.name, i.stock_quantity, i.reserved_quantity FROM v_products p LEFT JOIN ({INVENTORY}) i USING (product_id)")
def _(v):
    return v("v_products").select("product_id", "name").join(inventory(v), "product_id", "left")


@query("products_with_inventory", f"SELECT product_id, trim(p.brand) AS brand, i.stock_quantity, i.reserved_quantity FROM d_products p LEFT JOIN ({INVENTORY}) i USING (product_id) WHERE is_active AND trim(p.brand) = 'Brand#13'")
def _(v):
    p = v("d_products").where("is_active AND trim(brand) = 'Brand#13'").select("product_id", F.trim("brand").alias("brand"))
    return p.join(inventory(v), "product_id", "left")


@query("available_quantity", f"SELECT product_id, stock_quantity - reserved_quantity AS available FROM ({INVENTORY})")
def _(v):
    return inventory(v).select("product_id", (F.col("stock_quantity") - F.col("reserved_quantity")).alias("available"))


@query("join_orders_items_filtered", "SELECT o.order_id, line_number, product_id, quantity FROM v_orders o JOIN v_items i ON i.order_id = o.order_id WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND status = 'completed'")
def _(v):
    o = v("v_orders").where("order_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND status = 'completed'").select("order_id")
    return v("v_items").join(o, "order_id").select("order_id", "line_number", "product_id", "quantity")


# ------------------------------------------------------------------ reshaping and sets

PAID = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("pivot", "SELECT order_date, " + ", ".join(f'CAST(sum(CASE WHEN payment_method = {p!r} THEN total_amount ELSE 0 END) AS DECIMAL(28,2)) AS "paid_{p}"' for p in PAID) + " FROM v_orders GROUP BY 1")
def _(v):
    p = L.pivot(v("v_orders"), ["order_date"], "payment_method", PAID, F.col("total_amount"), prefix="paid_")
    return p.select("order_date", *[F.col(f"`paid_{x}`").cast("decimal(28,2)").alias(f"paid_{x}") for x in PAID])


@query("unpivot", "SELECT product_id, 'price' AS field_name, CAST(price AS VARCHAR) AS value FROM v_products UNION ALL SELECT product_id, 'stock_quantity', CAST(stock_quantity AS VARCHAR) FROM v_products UNION ALL SELECT product_id, 'category', category FROM v_products")
def _(v):
    return L.unpivot(products(v), ["product_id"], ["name", "brand"], "string")


@query("union_relations", "SELECT customer_id, name, NULL AS category, CAST(balance AS DECIMAL(14,2)) AS amount, 'customers' AS _source_relation FROM v_customers WHERE balance > 0 UNION ALL SELECT NULL, name, category, CAST(price AS DECIMAL(14,2)), 'products' FROM v_products WHERE price > 0")
def _(v):
    c = v("v_customers").select("customer_id", "name", F.col("balance").alias("amount"), "nation_key")
    p = v("v_products").select("name", "category", F.col("price").alias("amount"))
    return L.union_relations({"customers": c, "products": p}, exclude=("nation_key",), where="amount > 0", types={"amount": "decimal(14,2)"})


@query("union_by_prefix", "SELECT order_id, total_amount, 'sales_' || status AS _source_relation FROM v_orders")
def _(v):
    o = v("v_orders").select("order_id", "total_amount", "status")
    spark, run = o.sparkSession, f"sales_{uuid.uuid4().hex}_"  # names of this run, dropped at its end
    names = {s: f"{run}{s}" for s in ("completed", "shipped", "processing", "cancelled")}
    for s, name in names.items():
        o.where(F.col("status") == s).drop("status").createOrReplaceTempView(name)
    try:
        return L.union_by_prefix(spark, run).withColumn("_source_relation", F.concat(F.lit("sales_"), F.substring("_source_relation", len(run) + 1, 100)))
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


@query("distinct_values", "SELECT payment_method, count(*) AS n FROM v_orders WHERE total_amount > 100 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def _(v):
    return L.distinct_values(v("v_orders"), "payment_method", "total_amount > 100", 3)


@query("date_spine", "SELECT CAST(unnest(generate_series(min(order_date), max(order_date) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM v_orders")
def _(v):
    ends = v("v_orders").agg(F.min("order_date").alias("a"), F.max("order_date").alias("b"))
    return ends.select(F.explode(F.sequence("a", F.date_sub("b", 1))).alias("d"))


SENT = "CASE WHEN status = 'shipped' THEN 'sent' ELSE status END"


@query("except_both_ways", f"(SELECT DISTINCT customer_id, status, 'a' AS side FROM v_orders EXCEPT SELECT customer_id, {SENT}, 'a' FROM v_orders) UNION ALL (SELECT DISTINCT customer_id, {SENT}, 'b' FROM v_orders EXCEPT SELECT customer_id, status, 'b' FROM v_orders)")
def _(v):
    o = v("v_orders").select("customer_id", "status")
    return L.except_both_ways(o, o.withColumn("status", F.expr(SENT)))


# ------------------------------------------------------------------ loading

# updates: every customer's first order day, some keys twice, beside new keys
UPDATES = "SELECT customer_id + CASE WHEN customer_id % 10 = 1 THEN 50000000 ELSE 0 END AS customer_id, payment_method AS segment, order_date, order_id FROM v_orders WHERE year(order_date) = 1998"
FIRST = f"SELECT customer_id, segment FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id DESC) AS rn FROM ({UPDATES})) WHERE rn = 1"


def updates(v) -> DataFrame:
    shift = F.when(F.col("customer_id") % 10 == 1, 50000000).otherwise(0)
    return v("v_orders").where("year(order_date) = 1998").select((F.col("customer_id") + shift).alias("customer_id"), F.col("payment_method").alias("segment"), "order_date", "order_id")


def latest() -> list:
    return [F.desc("order_date"), F.desc("order_id")]


def customers(v) -> DataFrame:
    return v("v_customers").select("customer_id", "segment")


def one_each(v) -> DataFrame:
    return L.deduplicate(updates(v), ["customer_id"], latest()).select("customer_id", "segment")


@query("merge_scd1", f"WITH u AS ({FIRST}) SELECT customer_id, segment FROM v_customers WHERE customer_id NOT IN (SELECT customer_id FROM u) UNION ALL SELECT * FROM u")
def _(v):
    target = customers(v).withColumns({"order_date": F.lit(None).cast("date"), "order_id": F.lit(None).cast("long")})
    return L.merge_scd1(target, updates(v), ["customer_id"], latest()).select("customer_id", "segment")


@query("merge_scd1_partial", f"WITH u AS ({FIRST}) SELECT customer_id, CASE WHEN c.customer_id IS NULL OR u.customer_id IS NOT NULL THEN u.segment ELSE c.segment END AS segment, CASE WHEN c.customer_id IS NULL THEN 'new' ELSE c.name END AS name FROM v_customers c FULL JOIN u USING (customer_id)")
def _(v):
    u = one_each(v).withColumn("name", F.lit("new"))
    return L.merge_scd1_partial(v("v_customers").select("customer_id", "segment", "name"), u, ["customer_id"], ["segment"])


@query("insert_ignore", f"WITH u AS ({FIRST}) SELECT customer_id, segment FROM v_customers UNION ALL SELECT * FROM u WHERE customer_id NOT IN (SELECT customer_id FROM v_customers)")
def _(v):
    target = customers(v).withColumns({"order_date": F.lit(None).cast("date"), "order_id": F.lit(None).cast("long")})
    return L.insert_ignore(target, updates(v), ["customer_id"], latest()).select("customer_id", "segment")


def history(v) -> DataFrame:
    """Every customer's current version, and a past one of each third."""
    day = lambda x: F.lit(x).cast("date")
    now = customers(v).select("*", day("1997-01-01").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit(True).alias("is_current"))
    past = customers(v).where("customer_id % 3 = 0").select("customer_id", F.lit("OLD").alias("segment"), day("1992-01-01").alias("effective_from"), day("1997-01-01").alias("effective_to"), F.lit(False).alias("is_current"))
    return now.unionByName(past)


HISTORY = "SELECT customer_id, segment, DATE '1997-01-01' AS effective_from, CAST(NULL AS DATE) AS effective_to, true AS is_current FROM v_customers UNION ALL SELECT customer_id, 'OLD', DATE '1992-01-01', DATE '1997-01-01', false FROM v_customers WHERE customer_id % 3 = 0"
CHANGED = f"f AS ({FIRST}), u AS (SELECT f.customer_id, CASE WHEN f.customer_id % 4 = 0 AND c.segment IS NOT NULL THEN c.segment ELSE f.segment END AS segment FROM f LEFT JOIN v_customers c USING (customer_id)), h AS ({HISTORY})"


def changes(v) -> DataFrame:
    """Updates, of which some bring nothing new."""
    known = customers(v).withColumnRenamed("segment", "_s")
    x = one_each(v).join(known, "customer_id", "left")
    return x.select("customer_id", F.when((F.col("customer_id") % 4 == 0) & F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("segment")).alias("segment"))


MERGED = f"""SELECT h.customer_id, h.segment, effective_from, CASE WHEN is_current AND u.customer_id IS NOT NULL AND u.segment IS DISTINCT FROM h.segment THEN DATE '1998-09-01' ELSE effective_to END AS effective_to, is_current AND NOT (u.customer_id IS NOT NULL AND u.segment IS DISTINCT FROM h.segment) AS is_current FROM h LEFT JOIN u USING (customer_id)
UNION ALL SELECT u.customer_id, u.segment, DATE '1998-09-01', NULL, true FROM u LEFT JOIN (SELECT * FROM h WHERE is_current) c USING (customer_id) WHERE c.customer_id IS NULL OR u.segment IS DISTINCT FROM c.segment"""


def merged(v) -> DataFrame:
    return L.merge_scd2(history(v), changes(v), ["customer_id"], ["segment"], "1998-09-01")


query("merge_scd2", f"WITH {CHANGED} {MERGED}")(merged)


@query("scd2_current", f"WITH {CHANGED}, m AS ({MERGED}) SELECT customer_id, segment, effective_from FROM m WHERE is_current")
def _(v):
    return L.scd2_current(merged(v)).select("customer_id", "segment", "effective_from")


@query("scd2_point_in_time", f"WITH {CHANGED}, m AS ({MERGED}) SELECT order_id, m.segment FROM v_orders o LEFT JOIN m ON m.customer_id = o.customer_id AND o.order_date >= effective_from AND (effective_to IS NULL OR o.order_date < effective_to)")
def _(v):
    return L.scd2_point_in_time(v("v_orders").select("order_id", "customer_id", "order_date"), merged(v), ["customer_id"], "order_date").select("order_id", "segment")


@query("incremental_load", "SELECT order_id, order_date, CASE WHEN order_date < DATE '1997-01-01' THEN 1 ELSE 2 END AS batch FROM v_orders")
def _(v):
    o = v("v_orders").select("order_id", "order_date")
    spark, path = new_path(o, "load")
    for until in ("1997-01-01", "9999-01-01", "9999-01-01"):  # the last one finds nothing new
        I.incremental_load(o.where(F.col("order_date") < F.lit(until).cast("date")), f"{path}/rows", f"{path}/control", "orders", "order_date")
    return I.loaded(spark, f"{path}/rows", f"{path}/control", "orders").select("order_id", "order_date", F.col("_batch").alias("batch"))


@query("incremental_load_numeric", "SELECT order_id, product_id FROM v_items")
def _(v):
    # the mark is the number of the order, loaded in steps of ever more digits; lines that tie with it come by their keys
    i = v("v_items").select("order_id", "line_number", "product_id")
    spark, path = new_path(i, "load")
    for until in (9, 10, 99, 1000, 1 << 62):
        part = i.where((F.col("order_id") < until) | (F.col("order_id") == until) & (F.col("line_number") == 1))
        I.incremental_load(part, f"{path}/rows", f"{path}/control", "items", "order_id", ["order_id", "line_number"])
    return I.loaded(spark, f"{path}/rows", f"{path}/control", "items").select("order_id", "product_id")


@query("replace_aggregate", f"SELECT year(order_date)::INT AS year, order_date, count(*) AS total_orders, {M.format('total_amount', 'total_revenue')}, {A.format('total_amount', 'avg_order_value')}, count(DISTINCT customer_id) AS unique_customers FROM v_orders GROUP BY 1, 2")
def _(v):
    d = v("v_orders").groupBy(F.year("order_date").alias("year"), "order_date").agg(n().alias("total_orders"), money("total_amount", "total_revenue"), mean("total_amount").alias("avg_order_value"), F.countDistinct("customer_id").alias("unique_customers"))
    spark, path = new_path(d, "daily")
    L.replace_partitions(d.withColumn("total_orders", F.lit(0).cast("long")), path, ["year"])
    L.replace_partitions(d.where("year < 1996"), path, ["year"])
    L.replace_partitions(d.where("year >= 1996"), path, ["year"])
    return spark.read.schema(d.schema).parquet(path).select(*d.columns)


_MARTS = {
    "e_items": "v_items",
    "e_orders": "v_orders",
    "sales_summary": "(SELECT DISTINCT order_date FROM v_orders)",
    "product_performance": "v_products",
    "customer_analytics": "v_customers",
    "category_performance": "(SELECT DISTINCT category, year(order_date), month(order_date) FROM v_items JOIN v_orders USING (order_id) JOIN v_products USING (product_id))",
    "geographic_sales": "(SELECT DISTINCT nation_key, segment, year(order_date), quarter(order_date) FROM v_orders JOIN v_customers USING (customer_id))",
}


@query("refresh_marts", " UNION ALL ".join(f"SELECT '{k}' AS job_name, count(*) AS records_processed, 'success' AS status, count(*) AS stored FROM {t}" for k, t in _MARTS.items()))
def _(v):
    spark, path = new_path(v("v_orders"), "marts")
    J.refresh(spark, path, WAREHOUSE_MARTS, v)
    stored = None
    for m in WAREHOUSE_MARTS:
        one = J.current(spark, path, m.name).agg(n().alias("stored")).withColumn("job_name", F.lit(m.name))
        stored = one if stored is None else stored.unionByName(one)
    return spark.read.parquet(f"{path}/_log").select("job_name", "records_processed", "status").join(stored, "job_name")


@query("etl_job_log", "SELECT 'orders' AS job_name, 'success' AS status, count(*) AS records_processed, 90::BIGINT AS duration_seconds, false AS has_error FROM v_orders UNION ALL SELECT 'items', 'failed', 0, 90, true")
def _(v):
    spark, path = new_path(v("v_orders"), "log")
    times = iter(datetime.datetime.fromisoformat(f"{AS_OF} 00:0{m}") for m in ("0:00", "1:30", "2:00", "3:30"))
    J.run_job(spark, f"{path}/log", "orders", lambda: v("v_orders"), f"{path}/orders", lambda: next(times))
    # a line that may not be makes the write fail
    broken = v("v_items").withColumn("quantity", F.when(F.col("quantity") > 0, F.raise_error(F.lit("line refused"))).otherwise(F.col("quantity")))
    J.run_job(spark, f"{path}/log", "items", lambda: broken, f"{path}/items", lambda: next(times))
    return spark.read.parquet(f"{path}/log").select("job_name", "status", "records_processed", "duration_seconds", F.coalesce(F.col("error_message").contains("line refused"), F.lit(False)).alias("has_error"))


@query("table_stats", "SELECT count(*) AS row_count, 3::BIGINT AS file_count, true AS has_bytes FROM v_products")
def _(v):
    p = products(v)
    spark, path = new_path(p, "stats")
    p.repartition(3).write.parquet(path)
    return L.table_stats(spark, path).select("row_count", "file_count", (F.col("total_bytes") > 0).alias("has_bytes"))


BATCHES = [(BATCH, f"{AS_OF} 00:00:00", "price"), ("20010803000000", "2001-08-03 00:00:00", "price * 2"), ("20010804000000", "2001-08-04 00:00:00", "price * 3")]


def ingested(v) -> DataFrame:
    """Three batches; the later ones bring some of the products."""
    parts = [v("v_products").where(f"product_id % {k + 1} = 0").select("product_id", F.expr(price).cast("decimal(14,2)").alias("price"), F.lit(at).cast("timestamp_ntz").alias("_ingested_at"), F.lit(b).alias("_batch_id")) for k, (b, at, price) in enumerate(BATCHES)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("snapshot_read_at", f"SELECT product_id, CAST(CASE WHEN product_id % 2 = 0 THEN price * 2 ELSE price END AS DECIMAL(14,2)) AS price FROM v_products WHERE product_id % 10 <> 0")
def _(v):
    spark, path = stored_batches(v)
    return I.snapshot_read_at(spark, path, ["product_id"], at="2001-08-03 12:00:00").select("product_id", "price")


@query("snapshot_read_at_batch", "SELECT product_id, CAST(price * CASE WHEN product_id % 3 = 0 THEN 3 WHEN product_id % 2 = 0 THEN 2 ELSE 1 END AS DECIMAL(14,2)) AS price FROM v_products WHERE product_id % 3 = 0 OR product_id % 10 <> 0")
def _(v):
    spark, path = stored_batches(v)
    return I.snapshot_read_at(spark, path, ["product_id"], batch=3).select("product_id", "price")


def stored_batches(v) -> tuple[SparkSession, str]:
    """Three batches below a new path; the second one deletes some products, of which the third brings some back."""
    p = v("v_products").select("product_id", "price")
    spark, path = new_path(p, "batches")
    for k, (_, at, price) in enumerate(BATCHES):
        rows = p.where(f"product_id % {k + 1} = 0").select("product_id", F.expr(price).cast("decimal(14,2)").alias("price"))
        I.append_batch(rows, path, k + 1, at, F.col("product_id") % 10 == 0 if k == 1 else None)
    return spark, path


@query("bronze_ingest", f"SELECT _batch_id, count(*) AS n FROM (SELECT '{BATCHES[0][0]}' AS _batch_id FROM v_products UNION ALL SELECT '{BATCHES[1][0]}' FROM v_products WHERE product_id % 2 = 0 UNION ALL SELECT '{BATCHES[2][0]}' FROM v_products WHERE product_id % 3 = 0) GROUP BY 1")
def _(v):
    x = ingested(v)
    spark, path = new_path(x, "bronze")
    files.sink(x, path, mode="append", partition_by=("_batch_id",))
    return spark.read.parquet(path).groupBy(F.col("_batch_id").cast("string").alias("_batch_id")).agg(n().alias("n"))


@query("compact_table", f"SELECT product_id, name, 1::BIGINT AS file_count FROM ({PRODUCT_SQL})")
def _(v):
    p = products(v)
    spark, path = new_path(p, "small")
    p.repartition(8).write.parquet(path)
    L.compact_table(spark, path, f"{path}-compact")
    stats = L.table_stats(spark, f"{path}-compact").select("file_count")
    return spark.read.parquet(f"{path}-compact").select("product_id", "name").crossJoin(stats)  # one row


@query("evolve_columns", "SELECT product_id, CAST(NULL AS VARCHAR) AS supplier, price AS list_price, 'new' AS origin FROM v_products UNION ALL SELECT product_id, NULL, price, 'old' FROM v_products")
def _(v):
    p = v("v_products").select("product_id", "name", "price")
    spark, path = new_path(p, "evolved")
    changed = L.evolve_columns(p, add={"supplier": "string"}, rename={"price": "list_price"}, drop=["name"])
    changed.withColumn("origin", F.lit("new")).write.parquet(f"{path}/v=2")
    p.select("product_id", F.col("price").alias("list_price"), F.lit("old").alias("origin")).write.parquet(f"{path}/v=1")
    return spark.read.option("mergeSchema", True).parquet(path).select("product_id", "supplier", "list_price", "origin")


@query("verify_load", "SELECT 'rows' AS part, name, n::DECIMAL(28,2) AS value FROM (SELECT 'orders' AS name, count(*) AS n FROM v_orders UNION ALL SELECT 'items', count(*) FROM v_items UNION ALL SELECT 'customers', count(*) FROM v_customers UNION ALL SELECT 'products', count(*) FROM v_products) UNION ALL SELECT * FROM (SELECT 'top order', concat(CAST(order_id AS STRING), ' ', name), CAST(total_amount AS DECIMAL(28,2)) FROM v_orders LEFT JOIN v_customers USING (customer_id) ORDER BY total_amount DESC, order_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'first day', CAST(order_date AS STRING), CAST(sum(total_amount) AS DECIMAL(28,2)) FROM v_orders GROUP BY order_date ORDER BY order_date LIMIT 5)")
def _(v):
    value = lambda c: F.col(c).cast("decimal(28,2)").alias("value")
    parts = [v(t).agg(n().alias("n")).select(F.lit("rows").alias("part"), F.lit(name).alias("name"), value("n")) for name, t in (("orders", "v_orders"), ("items", "v_items"), ("customers", "v_customers"), ("products", "v_products"))]
    top = v("v_orders").orderBy(F.desc("total_amount"), "order_id").limit(5).join(v("v_customers").select("customer_id", "name"), "customer_id", "left")
    parts.append(top.select(F.lit("top order").alias("part"), F.concat_ws(" ", F.col("order_id").cast("string"), "name").alias("name"), value("total_amount")))
    days = v("v_orders").groupBy("order_date").agg(F.sum("total_amount").alias("s")).orderBy("order_date").limit(5)
    parts.append(days.select(F.lit("first day").alias("part"), F.col("order_date").cast("string").alias("name"), value("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ streams


def local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


_RATE = "coalesce(CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0) * 100, 0)"
KPIS = f"""WITH k AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(event_id) AS total_events, count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS active_sessions, count(*) FILTER (kind = 'page_view') AS page_views, count(*) FILTER (kind = 'product_view') AS product_views, count(*) FILTER (kind = 'add_to_cart') AS add_to_carts, count(*) FILTER (kind = 'purchase') AS purchases, count(*) FILTER (device_type IN ('mobile','tablet')) AS mobile_events, count(DISTINCT country) AS countries_active, {A.format('value', 'avg_cart_value')} FROM v_events GROUP BY 1)
SELECT *, window_start + INTERVAL 1 MINUTE AS window_end, {_RATE.format('mobile_events', 'total_events')} AS mobile_percentage, {_RATE.format('purchases', 'active_sessions')} AS conversion_rate, {_RATE.format('add_to_carts', 'product_views')} AS cart_rate FROM k"""


@query("stream_realtime_kpis", KPIS)
def _(v):
    return S.realtime_kpis(v("v_events"))


SESSIONS = "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, session_id, count(event_id) AS event_count, count(DISTINCT page_url) AS pages_viewed, count(*) FILTER (kind = 'product_view') AS products_viewed, count(*) FILTER (kind = 'add_to_cart') AS add_to_cart_events, count(*) FILTER (kind = 'purchase') AS purchases, arg_min(user_id, (ts, event_id)) AS user_id, arg_min(device_type, (ts, event_id)) AS device_type, arg_min(country, (ts, event_id)) AS country, min(ts) AS session_start, max(ts) AS session_end, max(value) AS max_cart_value, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS session_duration_seconds, count(*) FILTER (kind = 'purchase') > 0 AS is_converted FROM v_events GROUP BY 1, 2, 3"


@query("stream_session_metrics", SESSIONS)
def _(v):
    return S.session_metrics(v("v_events"))


ORDER_EVENTS = "SELECT *, CAST(order_date AS TIMESTAMP) + to_hours(order_hour) AS ts FROM e_orders"


def order_events(v) -> DataFrame:
    return v("e_orders").select("order_id", "customer_id", "total_amount", "status", "payment_method", F.col("item_count").alias("items_count"), (F.col("order_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("order_hour"))).alias("ts"))


@query("stream_order_metrics", f"WITH e AS ({ORDER_EVENTS}), m AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(order_id) AS orders_count, {M.format('total_amount', 'total_revenue')}, {A.format('total_amount', 'avg_order_value')}, CAST(sum(item_count) AS BIGINT) AS total_items, count(DISTINCT customer_id) AS unique_customers, count(*) FILTER (status = 'completed') AS completed_orders, count(*) FILTER (status = 'failed') AS failed_orders, CAST(sum(CASE WHEN total_amount >= 200 THEN total_amount ELSE 0 END) AS DECIMAL(28,2)) AS high_value_revenue, array_to_string(list_sort(list_distinct(list(payment_method))), ',') AS payment_methods_used FROM e GROUP BY 1) SELECT *, window_start + INTERVAL 1 MINUTE AS window_end, {_RATE.format('completed_orders', 'orders_count')} AS completion_rate, {_RATE.format('high_value_revenue', 'total_revenue')} AS high_value_percentage FROM m")
def _(v):
    return S.order_metrics(order_events(v))


@query("stream_hour_slice", "SELECT event_id, ts FROM v_events WHERE ts >= TIMESTAMP '2024-01-02 03:00:00' AND ts < TIMESTAMP '2024-01-02 04:00:00'")
def _(v):
    # what has landed by now is read as a stream, once
    s, spark, path = streamed(v("v_events").select("event_id", "ts"))
    S.to_parquet(S.hour_slice(s, "2024-01-02 03:00:00"), f"{path}/hour", f"{path}/ck", (), ONCE).awaitTermination()
    return spark.read.schema("event_id long, ts timestamp_ntz").parquet(f"{path}/hour")


PAYLOAD = "event_id bigint, user_id bigint, kind string, value decimal(18,2)"


def messages(v) -> DataFrame:
    """Events as they come from a topic."""
    e = v("v_events")
    return e.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.to_json(F.struct("event_id", "user_id", "kind", "value")).cast("binary").alias("value"), F.lit("events").alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"), F.floor(F.col("event_id") / 3).alias("offset"), F.col("ts").alias("timestamp"))


@query("decode_kafka_json", "SELECT CAST(user_id AS VARCHAR) AS key, event_id, user_id, kind, value, ts AS kafka_timestamp, (event_id % 3)::INT AS partition, event_id // 3 AS \"offset\" FROM v_events")
def _(v):
    return S.decode_kafka_json(messages(v), PAYLOAD)


@query("scan_kafka_raw", "SELECT CAST(user_id AS VARCHAR) AS key, length(CAST(event_id AS VARCHAR)) > 0 AS has_value, 'events' AS topic FROM v_events")
def _(v):
    return S.raw_kafka(messages(v)).select("key", F.contains("value", F.lit("event_id")).alias("has_value"), "topic")


@query("envelope_decode", f"SELECT CAST(order_id AS VARCHAR) AS key, 'shop' AS source, 'order' AS type, '{AS_OF}T00:00:00' AS timestamp, order_id, total_amount, 32 AS id_length FROM v_orders")
def _(v):
    m = S.envelope_encode(v("v_orders").select("order_id", "total_amount"), "shop", "order", "order_id", f"{AS_OF}T00:00:00")
    return S.envelope_decode(m, "order_id: bigint, total_amount: decimal(12,2)").withColumn("id_length", F.length("message_id")).drop("message_id")


@query("envelope_encode", "SELECT CAST(order_id AS VARCHAR) AS key, 'order' AS type, CAST(total_amount AS VARCHAR) AS amount FROM v_orders")
def _(v):
    m = S.envelope_encode(v("v_orders").select("order_id", "total_amount"), "shop", "order", "order_id", f"{AS_OF}T00:00:00")
    return m.select("key", F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.data.total_amount").cast("decimal(12,2)").cast("string").alias("amount"))


@query("dead_letter_split", "SELECT event_id, event_id % 50 = 0 AS dead, CASE WHEN event_id % 50 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM v_events")
def _(v):
    raw = v("v_events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("body"))
    good, dead = S.dead_letters(raw, "body", "k bigint")
    return good.select("event_id", F.lit(False).alias("dead"), "k").unionByName(dead.select("event_id", F.lit(True).alias("dead"), F.lit(None).cast("long").alias("k")))


@query("stream_sink_kafka", "SELECT CAST(user_id AS VARCHAR) AS key, event_id FROM v_events")
def _(v):
    rows = S.kafka_rows(v("v_events").select("event_id", "user_id", "kind"), "user_id")
    return rows.select("key", F.get_json_object("value", "$.event_id").cast("long").alias("event_id"))


ONCE = {"availableNow": True}


def streamed(df: DataFrame) -> tuple[DataFrame, SparkSession, str]:
    """A frame as a stream of files below a new path."""
    spark, path = new_path(df, "stream")
    df.write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in"), spark, path


@query("stream_sink_parquet", "SELECT event_id, kind, ts::DATE AS event_date FROM v_events")
def _(v):
    s, spark, path = streamed(v("v_events").select("event_id", "kind", "ts"))
    S.to_parquet(s.withColumn("event_date", F.col("ts").cast("date")), f"{path}/out", f"{path}/ck", ("event_date",), ONCE).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "kind", "event_date")


@query("stream_bronze_append", "SELECT event_id, props, 'events' AS _source_system FROM v_events")
def _(v):
    s, spark, path = streamed(v("v_events").select("event_id", "props"))
    S.to_parquet(s.withColumn("_source_system", F.lit("events")), f"{path}/bronze", f"{path}/ck", (), ONCE).awaitTermination()
    return spark.read.parquet(f"{path}/bronze")


@query("stream_sink_foreach_batch", "SELECT kind, count(*) AS n FROM v_events GROUP BY 1")
def _(v):
    s, spark, path = streamed(v("v_events").select("event_id", "kind"))
    url = f"jdbc:derby:{local_dir()}/db;create=true"  # an embedded database lives on one machine, the driver's
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    T.to_jdbc(s, url, "events_sink", "events", f"{path}/ck", trigger=ONCE, **driver).awaitTermination()
    rows = spark.read.format("jdbc").options(url=url, dbtable="events_sink", **driver).load()
    return rows.groupBy("kind").agg(n().alias("n"))


@query("stream_multi_query", "SELECT 'purchases' AS query, count(*) AS n, (SELECT count(*) FROM v_events) AS rows_in FROM v_events WHERE kind = 'purchase' UNION ALL SELECT 'all', count(*), count(*) FROM v_events")
def _(v):
    s, spark, path = streamed(v("v_events").select("event_id", "kind"))
    outputs = {"purchases": s.where("kind = 'purchase'"), "all": s}
    rows = T.supervise(spark, {k: lambda k=k, d=d: S.to_parquet(d, f"{path}/{k}", f"{path}/ck-{k}", (), ONCE) for k, d in outputs.items()})
    parts = [spark.read.parquet(f"{path}/{k}").agg(n().alias("n")).select(F.lit(k).alias("query"), "n", F.lit(rows[k]).cast("long").alias("rows_in")) for k in outputs]
    return parts[0].union(parts[1])


@query("stream_sink_console", "SELECT kind, count(*) AS n FROM v_events GROUP BY 1")
def _(v):
    s, spark, path = streamed(v("v_events").select("event_id", "kind"))
    name = f"shown_{path.rsplit('-', 1)[-1]}"
    S.to_console(s.groupBy("kind").agg(n().alias("n")), name, f"{path}/ck", "memory", ONCE).awaitTermination()
    return spark.table(name)


_FILLED = "SELECT * FROM d_orders WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND order_date IS NOT NULL"


@query("transformation_log", f"""WITH f AS ({_FILLED}), o AS (SELECT * FROM f WHERE total_amount >= 0), u AS (SELECT DISTINCT order_id FROM o)
SELECT 0 AS position, 'required fields' AS step, (SELECT count(*) FROM d_orders) AS rows_in, (SELECT count(*) FROM f) AS rows_out UNION ALL SELECT 1, 'amounts', (SELECT count(*) FROM f), (SELECT count(*) FROM o) UNION ALL SELECT 2, 'one per id', (SELECT count(*) FROM o), (SELECT count(*) FROM u) UNION ALL SELECT 3, 'defaults', (SELECT count(*) FROM u), (SELECT count(*) FROM u)""")
def _(v):
    spark, path = new_path(v("d_orders"), "steps")
    chain = J.Steps(v("d_orders")).then("required fields", lambda d: d.dropna(subset=["order_id", "customer_id", "order_date"])).then("amounts", lambda d: d.where("total_amount >= 0"))
    chain = chain.then("one per id", lambda d: L.deduplicate(d, ["order_id"], [F.desc("order_date"), "customer_id", "total_amount"])).then("defaults", lambda d: d.fillna({"payment_method": "UNKNOWN", "shipping_method": "STANDARD"}))
    chain.write(f"{path}/clean", f"{path}/log")
    return spark.read.parquet(f"{path}/log")
