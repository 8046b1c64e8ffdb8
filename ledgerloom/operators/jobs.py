"""Logged jobs, counted steps, and marts that are refreshed in the order of what they read.

Counts come with the write itself, by observation; none costs a pass of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import shuffles_go

from .incremental import exists

LOG = "job_name string, status string, records_processed long, start_time timestamp_ntz, end_time timestamp_ntz, error_message string"


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@dataclass
class Steps:
    """A chain of named steps over a frame; ``write`` runs it once and tells each step's rows in and out.

    A step that reads no more than it needs (a limit) counts what it read. A chain whose
    frame is joined with itself further on can't be counted and fails.
    """

    df: DataFrame
    names: list[str] = field(default_factory=list)
    seen: list[Observation] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.df, first = _counted(self.df)
        self.seen.append(first)

    def then(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Steps:
        self.df, out = _counted(step(self.df))
        self.names.append(name)
        self.seen.append(out)
        return self

    def write(self, path: str, log: str | None = None) -> list[tuple[str, int, int]]:
        """``(step, rows in, rows out)`` of each step, in order; appended to the table ``log``, too."""
        self.df.write.mode("overwrite").parquet(path)
        rows = [o.get["rows"] for o in self.seen]
        out = [(name, rows[k], rows[k + 1]) for k, name in enumerate(self.names)]
        if log:
            self.df.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(out)], "position int, step string, rows_in long, rows_out long").coalesce(1).write.mode("append").parquet(log)
        return out


def run_job(spark: SparkSession, log: str, name: str, build: Callable[[], DataFrame], path: str, now: Callable[[], datetime] = datetime.now) -> bool:
    """Build and write a frame, then append a row on the run to ``log``: success with the rows written, or failed with the error's first line. Tells whether it succeeded."""
    start, rows, status, error = now(), 0, "success", None
    try:
        df, seen = _counted(build())
        with shuffles_go(spark):  # else the files of one mart lie there while the next ones are made
            df.write.mode("overwrite").parquet(path)
        rows = seen.get["rows"]
    except Exception as e:  # whatever breaks a job is what its log is for
        status, error = "failed", (str(e).strip().split("\n") or [""])[0] or type(e).__name__
    _log(spark, log, name, status, rows, start, now(), error)
    return error is None


def _log(spark: SparkSession, log: str, name: str, status: str, rows: int, start: datetime, end: datetime, error: str | None) -> None:
    row = spark.createDataFrame([(name, status, rows, start, end, error)], LOG)
    row.withColumn("duration_seconds", F.timestamp_diff("SECOND", "start_time", "end_time")).coalesce(1).write.mode("append").parquet(log)


# ------------------------------------------------------------------ marts


Reader = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Mart:
    """A stored table: its name, the marts it reads, and how it is made from a reader of tables."""

    name: str
    reads: tuple[str, ...]
    build: Callable[[Reader], DataFrame]


def in_order(marts: list[Mart]) -> list[Mart]:
    """Each after those that it reads; names that are no mart's are the reader's own tables."""
    by, done, out = {m.name: m for m in marts}, {}, []

    def visit(m: Mart) -> None:
        if done.get(m.name) == "open":
            raise ValueError(f"{m.name} reads itself by way of others")
        if m.name not in done:
            done[m.name] = "open"
            for r in m.reads:
                if r in by:
                    visit(by[r])
            done[m.name] = "closed"
            out.append(m)

    for m in marts:
        visit(m)
    return out


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version of a mart that was swapped in last."""
    version = spark.read.parquet(f"{root}/_current").where(F.col("name") == name).agg(F.max("version")).first()[0]
    if version is None:
        raise ValueError(f"mart {name} was never written")
    return spark.read.parquet(f"{root}/{name}/version={version}")


def refresh(spark: SparkSession, root: str, marts: list[Mart], source: Reader, now: Callable[[], datetime] = datetime.now) -> dict[str, str]:
    """Refresh marts below ``root``; ``success``, ``failed`` or ``skipped`` of each.

    A mart reads the stored tables of the marts it declares, and others through ``source``.
    Each is written under a new version and swapped in by one row of the list of current
    versions, so readers see the old table or the new one, whole. One that fails keeps its
    old version; those that read it are skipped, and the others go on. All runs are logged
    to ``{root}/_log``.
    """
    names = {m.name for m in marts}
    status: dict[str, str] = {}
    versions = {r["name"]: r["v"] for r in spark.read.parquet(f"{root}/_current").groupBy("name").agg(F.max("version").alias("v")).collect()} if exists(spark, f"{root}/_current") else {}  # a row a mart
    for m in in_order(marts):
        lost = [r for r in m.reads if r in names and status[r] != "success"]
        if lost:
            status[m.name] = "skipped"
            _log(spark, f"{root}/_log", m.name, "skipped", 0, now(), now(), f"waits for {', '.join(lost)}")
            continue

        def read(name: str, m: Mart = m) -> DataFrame:
            if name in names and name not in m.reads:
                raise ValueError(f"{m.name} reads {name} without declaring it")
            return current(spark, root, name) if name in names else source(name)

        version = versions.get(m.name, 0) + 1
        if run_job(spark, f"{root}/_log", m.name, lambda m=m, read=read: m.build(read), f"{root}/{m.name}/version={version}", now):
            spark.createDataFrame([(m.name, version)], "name string, version int").coalesce(1).write.mode("append").parquet(f"{root}/_current")
            status[m.name] = "success"
        else:
            status[m.name] = "failed"
    return status
