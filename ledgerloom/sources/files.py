"""Readers and writers with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, path: str, fmt: str, schema: str | None = None, **options) -> DataFrame:
    """Any Spark format, with the source file's name as ``_source_file``."""
    r = spark.read.format(fmt).options(**options)
    return (r.schema(schema) if schema else r).load(path).withColumn("_source_file", F.col("_metadata.file_name"))


def scan_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8", null: str = "", **options) -> DataFrame:
    """CSV with a header and a schema; ``columns`` alone are parsed."""
    df = spark.read.schema(schema).options(header=True, sep=sep, encoding=encoding, nullValue=null, **options).csv(path)
    return df.select(*columns) if columns else df


def scan_csv_directory(spark: SparkSession, folder: str, schema: str, pattern: str = "*.csv", **options) -> DataFrame:
    """All CSV files of a folder that fit a pattern."""
    return scan_files(spark, folder, "csv", schema, header=True, pathGlobFilter=pattern, **options)


def scan_json(spark: SparkSession, path: str, schema: str, data_key: str | None = None) -> DataFrame:
    """A JSON array, or the list under ``data_key`` of an envelope."""
    if data_key is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.read.schema(f"{data_key} array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline(data_key))


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_paged_json(spark: SparkSession, folder: str, schema: str, data_key: str, page_size: int, lines: bool = False) -> DataFrame:
    """Rows of landed pages (``page``, list) in order, up to and with the first page that is not full.

    A file holds one page, over any lines; with ``lines`` it holds many, a line each, so
    that small pages don't cost a file each and large files are split.
    """
    pages = spark.read.schema(f"page long, {data_key} array<struct<{schema}>>").option("multiLine", not lines).json(folder).withColumn("_rows", F.coalesce(F.size(data_key), F.lit(0)))
    last = pages.where(F.col("_rows") < page_size).agg(F.min("page").alias("_last"))  # one row
    kept = pages.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col("page") <= F.col("_last")))
    return kept.select("page", F.inline(data_key))


def sink(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = (), **options) -> None:
    w = df.write.format(fmt).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def sink_lake_hourly(df: DataFrame, path: str, time: str) -> None:
    """Appended below ``year=/month=/day=/hour=`` of a timestamp; an hour's rows meet first, a large hour's in several tasks, so that files are few."""
    t = F.col(time)
    x = df.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)})
    sink(x.hint("rebalance", "year", "month", "day", "hour"), path, mode="append", partition_by=("year", "month", "day", "hour"))


def sink_multi_output(df: DataFrame, outputs: dict[str, tuple[Column, list[str]]]) -> None:
    """One frame into several tables: path to (rows, columns). The parent is kept for the writes and freed after them."""
    df = df.persist()
    try:
        for path, (rows, columns) in outputs.items():
            df.where(rows).select(*columns).write.mode("overwrite").parquet(path)
    finally:
        df.unpersist()


def scan_jdbc(spark: SparkSession, url: str, table: str, column: str, parts: int, fetch: int = 10_000, quote: str = '"', **options) -> DataFrame:
    """A table in parallel ranges of a numeric column, whose bounds are asked for first; ``quote`` is the database's sign around names."""
    o = {"url": url, "fetchsize": str(fetch), **options}
    lo, hi = spark.read.format("jdbc").options(**o, dbtable=f"(SELECT min({quote}{column}{quote}) AS lo, max({quote}{column}{quote}) AS hi FROM {table}) b").load().first()
    if lo is None:
        return spark.read.format("jdbc").options(**o, dbtable=table).load()
    return spark.read.format("jdbc").options(**o, dbtable=table, partitionColumn=column, lowerBound=str(lo), upperBound=str(hi + 1), numPartitions=str(parts)).load()


def sink_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=str(batch), **options).save()
