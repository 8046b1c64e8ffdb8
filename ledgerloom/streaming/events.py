"""Windowed event metrics, decoding and sinks; the same functions serve a stream and a batch.

On a stream, rows beyond the watermark are dropped, and distinct values are counted as the
size of their set, which is exact and keeps them all in state; a batch counts them by
shuffles. With ``error``, both count by sketches of a fixed size instead (HyperLogLog++),
whose relative standard error that is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", watermark) if e.isStreaming else e


def _distinct(df: DataFrame, c: str, error: float | None = None) -> Column:
    if error:
        return F.approx_count_distinct(c, error)
    return F.size(F.collect_set(c)).cast("long") if df.isStreaming else F.countDistinct(c)


def _count(c: Column, name: str) -> Column:
    return F.count_if(c).alias(name)


def _rate(a: str, b: str) -> Column:
    """In per cent; 0 for none."""
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) * 100, F.lit(0.0))


def _window(columns: list[str]) -> list[Column]:
    return [F.col("window.start").cast("timestamp_ntz").alias("window_start"), F.col("window.end").cast("timestamp_ntz").alias("window_end"), *map(F.col, columns)]


def realtime_kpis(events: DataFrame, width: str = "1 minute", watermark: str = "10 minutes", error: float | None = None) -> DataFrame:
    """Per tumbling window: events, users, sessions, events by kind, mobile share, countries, mean value, conversion and cart rates."""
    e = _timed(events, watermark)
    kind = F.col("kind")
    k = e.groupBy(F.window("ts", width)).agg(
        F.count("event_id").alias("total_events"), _distinct(e, "user_id", error).alias("unique_users"), _distinct(e, "session_id", error).alias("active_sessions"), _count(kind == "page_view", "page_views"), _count(kind == "product_view", "product_views"), _count(kind == "add_to_cart", "add_to_carts"),
        _count(kind == "purchase", "purchases"), _count(F.col("device_type").isin("mobile", "tablet"), "mobile_events"), _distinct(e, "country").alias("countries_active"), (F.sum("value").cast("double") / F.count("value")).alias("avg_cart_value"),
    )
    k = k.select("*", _rate("mobile_events", "total_events").alias("mobile_percentage"), _rate("purchases", "active_sessions").alias("conversion_rate"), _rate("add_to_carts", "product_views").alias("cart_rate"))
    return k.select(*_window(k.columns[1:]))


def session_metrics(events: DataFrame, width: str = "5 minutes", watermark: str = "30 minutes", error: float | None = None) -> DataFrame:
    """Per tumbling window and session: events, pages, events by kind, first user, device and country, start, end, duration, whether it bought."""
    e = _timed(events, watermark)
    kind, first = F.col("kind"), lambda c: F.min(F.struct("ts", "event_id", c)).getField(c).alias(c)
    m = e.groupBy(F.window("ts", width), "session_id").agg(
        F.count("event_id").alias("event_count"), _distinct(e, "page_url", error).alias("pages_viewed"), _count(kind == "product_view", "products_viewed"), _count(kind == "add_to_cart", "add_to_cart_events"), _count(kind == "purchase", "purchases"), first("user_id"), first("device_type"), first("country"),
        F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.max("value").alias("max_cart_value"),
    )
    m = m.withColumns({"session_start": F.col("_a").cast("timestamp_ntz"), "session_end": F.col("_b").cast("timestamp_ntz"), "session_duration_seconds": F.unix_timestamp("_b") - F.unix_timestamp("_a"), "is_converted": F.col("purchases") > 0}).drop("_a", "_b")
    return m.select(*_window(m.columns[1:]))


def order_metrics(orders: DataFrame, width: str = "1 minute", watermark: str = "10 minutes", error: float | None = None) -> DataFrame:
    """Per tumbling window: orders, revenue, their mean, items, customers, completed and failed ones, high-value share, methods used."""
    o = _timed(orders, watermark)
    high = F.when(F.col("total_amount") >= 200, F.col("total_amount")).otherwise(0)
    m = o.groupBy(F.window("ts", width)).agg(
        F.count("order_id").alias("orders_count"), F.sum("total_amount").cast("decimal(28,2)").alias("total_revenue"), (F.sum("total_amount").cast("double") / F.count("total_amount")).alias("avg_order_value"), F.sum("items_count").alias("total_items"), _distinct(o, "customer_id", error).alias("unique_customers"), _count(F.col("status") == "completed", "completed_orders"),
        _count(F.col("status") == "failed", "failed_orders"), F.sum(high).cast("decimal(28,2)").alias("high_value_revenue"), F.array_join(F.sort_array(F.collect_set("payment_method")), ",").alias("payment_methods_used"),
    )
    m = m.select("*", _rate("completed_orders", "orders_count").alias("completion_rate"), _rate("high_value_revenue", "total_revenue").alias("high_value_percentage"))
    return m.select(*_window(m.columns[1:]))


def rolling_anomaly(events: DataFrame, factor: float = 2.0, width: str = "1 minute", within: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """``window_start, events, window_mean`` of minutes whose count exceeds ``factor`` times the mean of their ten minutes.

    Two aggregations by event time, one on the other: minutes are counted, then a window
    gathers the counts of its minutes, of which there are few. On a stream in append mode a
    minute is final once the watermark passes it, and so is its window; rows beyond the
    watermark change neither.
    """
    e = _timed(events, watermark)
    minutes = e.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    minutes = minutes.select(F.window_time("w").alias("at"), F.col("w.start").alias("start"), "events") if e.isStreaming else minutes.select(F.col("w.start").alias("at"), F.col("w.start").alias("start"), "events")
    mean = (F.sum("events").cast("double") / F.count("events")).alias("window_mean")
    tens = minutes.groupBy(F.window("at", within)).agg(F.collect_list(F.struct("start", "events")).alias("minutes"), mean)
    each = tens.select(F.inline("minutes"), "window_mean").where(F.col("events") > F.col("window_mean") * factor)
    return each.select(F.col("start").cast("timestamp_ntz").alias("window_start"), "events", "window_mean")


def hour_slice(events: DataFrame, hour: str) -> DataFrame:
    """Events from an hour's start, before the next one's."""
    start = F.lit(hour).cast("timestamp_ntz")
    return events.where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 HOUR")))


def decode_kafka_json(raw: DataFrame, schema: str) -> DataFrame:
    """Key and value as text, the value's fields flattened, with the message's time, partition and offset."""
    x = raw.select(F.col("key").cast("string").alias("key"), F.from_json(F.col("value").cast("string"), schema).alias("data"), F.col("timestamp").alias("kafka_timestamp"), "partition", "offset")
    return x.select("key", "data.*", "kafka_timestamp", "partition", "offset")


def raw_kafka(raw: DataFrame) -> DataFrame:
    """Key and value as text, nothing parsed."""
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")


def envelope_encode(df: DataFrame, source: str, kind: str, key: str, at: str) -> DataFrame:
    """Rows as messages: key, and value with id, time, source, type and the row; the id is the MD5 of the row."""
    data = F.struct(*df.columns)
    body = F.struct(F.md5(F.to_json(data)).alias("message_id"), F.lit(at).alias("timestamp"), F.lit(source).alias("source"), F.lit(kind).alias("type"), data.alias("data"))
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))


def envelope_decode(messages: DataFrame, schema: str) -> DataFrame:
    x = messages.select("key", F.from_json("value", f"message_id string, timestamp string, source string, type string, data struct<{schema}>").alias("m"))
    return x.select("key", "m.message_id", "m.timestamp", "m.source", "m.type", "m.data.*")


def dead_letters(raw: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and rows whose JSON does not parse."""
    parsed = raw.withColumn("_p", F.from_json(column, schema))
    bad = F.col("_p").isNull() | (F.try_parse_json(F.col(column)).isNull())
    return parsed.where(~bad).select("*", "_p.*").drop("_p"), parsed.where(bad).drop("_p")


# ------------------------------------------------------------------ sinks


def to_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = (), trigger: dict | None = None) -> StreamingQuery:
    """Append to a partitioned table; ``trigger`` is one minute by default."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"}))
    return (w.partitionBy(*partition_by) if partition_by else w).start()


def to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Call ``write(batch, id)`` for each batch that has rows; a repeated id must replace, not add."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(batch, number)

    return stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def kafka_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """What a Kafka sink takes: the row as JSON, and its key."""
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct(*df.columns)).alias("value"))


def to_console(stream: DataFrame, name: str, checkpoint: str, fmt: str = "console", trigger: dict | None = None) -> StreamingQuery:
    """The whole result after each batch, untruncated; ``fmt="memory"`` keeps it as a table instead."""
    w = stream.writeStream.format(fmt).outputMode("complete").queryName(name).option("checkpointLocation", checkpoint)
    return (w.option("truncate", False) if fmt == "console" else w).trigger(**(trigger or {"processingTime": "1 minute"})).start()
