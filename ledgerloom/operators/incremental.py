"""Incremental loads with typed watermarks, and stored batches that can be replayed.

Rows of a load go to a partition of their own, ``_batch``; the control table gets the
batch's mark only after they are written whole. Readers take the batches that the control
table names, so rows of a load that broke off are never seen, and the next load writes
over them: repeating a load adds nothing twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own reader, which knows every file system."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return True


def committed(spark: SparkSession, control: str, table: str) -> DataFrame | None:
    """``_batch, mark, rows`` of the table's loads; the mark has the type of its column. None before the first load."""
    path = f"{control}/{table}"
    return spark.read.parquet(path) if exists(spark, path) else None


def loaded(spark: SparkSession, target: str, control: str, table: str, after: int = -1) -> DataFrame | None:
    """Rows of all committed batches (later than ``after``), with their ``_batch``; the partition filter keeps other batches unread. None before the first load."""
    log = committed(spark, control, table)
    if log is None:
        return None
    batches = [r["_batch"] for r in log.where(F.col("_batch") > after).select("_batch").collect()]  # a number a load
    return spark.read.parquet(target).where(F.col("_batch").isin(batches))


def incremental_load(source: DataFrame, target: str, control: str, table: str, column: str, keys: list[str] | None = None) -> int:
    """Load the rows of ``source`` beyond the last mark of ``column`` into a new batch of ``target``; how many came.

    The mark is kept and compared in the column's own type. Rows with a null in the column
    can't be ordered and never load. Rows that tie with the mark count as loaded; with
    ``keys``, those of them whose keys the target lacks load, too. The batch is written
    first, counted as it is, and its mark last: a load that fails in between leaves nothing
    that readers see, and repeating it writes the same batch again.
    """
    spark = source.sparkSession
    log = committed(spark, control, table)
    number, mark = 1, None
    if log is not None:
        kept, asked = log.schema["mark"].dataType, source.schema[column].dataType
        if kept != asked:
            raise ValueError(f"{column} of {table} is {asked.simpleString()}, its mark {kept.simpleString()}")
        last = log.orderBy(F.desc("_batch")).first()
        number, mark = last["_batch"] + 1, last["mark"]
    filled = source.where(F.col(column).isNotNull())
    new = filled
    if mark is not None:
        at = F.lit(mark).cast(source.schema[column].dataType)
        new = filled.where(F.col(column) > at)
        if keys:
            known = loaded(spark, target, control, table).where(F.col(column) == at).select(*keys).distinct()
            new = new.unionByName(filled.where(F.col(column) == at).join(known, keys, "left_anti").select(*source.columns))
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(column).alias("mark")).write.mode("overwrite").parquet(f"{target}/_batch={number}")
    rows = seen.get["rows"]
    if rows:
        commit(spark, f"{control}/{table}", number, seen.get["mark"], rows, source.schema[column].dataType.simpleString())
    return rows


def commit(spark: SparkSession, path: str, number: int, mark, rows: int, kind: str) -> None:
    """Name a batch in the control table; from then on readers see it."""
    spark.createDataFrame([(mark, rows)], f"mark {kind}, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_batch={number}")


# ------------------------------------------------------------------ batches with deletes


def append_batch(rows: DataFrame, path: str, batch: int, at: str, deletes: Column | None = None) -> None:
    """Store a batch under its number: its rows, whether each is a delete, and when it came in. Repeating a batch replaces it."""
    gone = F.coalesce(deletes, F.lit(False)) if deletes is not None else F.lit(False)
    rows.withColumns({"_deleted": gone, "_ingested_at": F.lit(at).cast("timestamp_ntz")}).write.mode("overwrite").parquet(f"{path}/rows/_batch={batch}")
    stamp = rows.sparkSession.createDataFrame([(at,)], "at string").select(F.col("at").cast("timestamp_ntz").alias("ingested_at"))
    stamp.coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/_batch={batch}")


def snapshot_read_at(spark: SparkSession, path: str, keys: list[str], at: str | None = None, batch: int | None = None) -> DataFrame:
    """The table of stored batches as of a time, or as of a batch; without either, as of now.

    As of a time: of each key the row that came in last by then, ties by the larger batch.
    As of a batch: of each key the row of the largest batch up to it, whenever that came in,
    so that a batch which came in late takes its own place. A key whose last row is a delete
    is absent. A batch that holds a key more than once counts by the hash of the row, a
    delete before any other. Which batches count is read from their list; the others'
    partitions are never opened. Last rows are found by partial maxima, so a key with many
    versions needs no task of its own.
    """
    batches = spark.read.parquet(f"{path}/batches")
    if at is not None:
        batches = batches.where(F.col("ingested_at") <= F.lit(at).cast("timestamp_ntz"))
    if batch is not None:
        batches = batches.where(F.col("_batch") <= batch)
    numbers = [r["_batch"] for r in batches.select("_batch").collect()]  # a number a batch
    rows = spark.read.parquet(f"{path}/rows").where(F.col("_batch").isin(numbers))
    rest = [c for c in rows.columns if c not in keys]
    order = [F.col("_batch")] if batch is not None and at is None else [F.col("_ingested_at"), F.col("_batch")]
    rank = F.struct(*order, F.col("_deleted"), F.xxhash64(*rows.columns))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_last"))
    return last.where(~F.col("_last._deleted")).select(*keys, "_last.*").drop("_deleted")
