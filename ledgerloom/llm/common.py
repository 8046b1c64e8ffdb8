"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names; unset in local mode, where all is one machine: a new one."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
        found = spark.sparkContext.getCheckpointDir()
    return found


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once, into the shared folder: a lost executor then costs a reread, not a rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_clean(df: DataFrame) -> DataFrame:
    """``cut``, after which the shuffle files that led to the rows go at once instead of when the driver next collects its garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        ready = df.select("*")  # a frame keeps the setting of the time when it was made
    finally:
        spark.conf.set(key, before)
    return cut(ready)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python workers get rows in batches of that size while an action runs within: long texts then take little memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """What is cut within keeps its partitioning: adaptive plans, which may change it, are off."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores put before it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc32_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null keys: remainder of the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
