"""Upserts, history and reshaping over immutable snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def deduplicate(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _one_per_key(df: DataFrame, keys: list[str], order: list | None) -> DataFrame:
    """The first row of each key; without an order, by the hash of the row, so that reruns agree."""
    return deduplicate(df, keys, order or [F.xxhash64(*df.columns)])


def merge_scd1(target: DataFrame, updates: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Updates, one per key by ``order``, replace target rows of their key; others stay."""
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(_one_per_key(updates, keys, order))


def merge_scd1_partial(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str], order: list | None = None) -> DataFrame:
    """Rows of known keys take the named columns of their update, null or not; unknown keys come in whole."""
    u = _one_per_key(updates, keys, order)
    rest = [c for c in target.columns if c not in keys]
    joined = target.withColumn("_t", F.lit(True)).alias("t").join(u.withColumn("_u", F.lit(True)).alias("u"), keys, "full")
    known, updated = F.col("t._t").isNotNull(), F.col("u._u").isNotNull()
    take = lambda c: F.when(known & (updated if c in columns else F.lit(False)) | ~known, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return joined.select(*keys, *[take(c) for c in rest]).select(*target.columns)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows whose key the target lacks are added, one per key by ``order``."""
    return target.unionByName(_one_per_key(rows, keys, order).join(target.select(*keys).distinct(), keys, "left_anti"))


def merge_scd2(history: DataFrame, updates: DataFrame, keys: list[str], tracked: list[str], as_of: str, only_changed: bool = True, order: list | None = None) -> DataFrame:
    """Close the current row of a key whose tracked columns changed, and open a new one.

    ``history``: keys, tracked columns, ``effective_from``, ``effective_to``,
    ``is_current``. One full outer join of current rows with updates, one per key by
    ``order``; past rows meet none. ``only_changed=False`` opens a version for every update.
    """
    day = F.lit(as_of).cast("date")
    u = _one_per_key(updates.select(*keys, *tracked), keys, order).select(*keys, F.lit(True).alias("is_current"), *[F.col(c).alias(f"_u_{c}") for c in tracked], F.lit(True).alias("_u"))
    x = history.withColumn("_h", F.lit(True)).join(u, [*keys, "is_current"], "full")
    differs = F.lit(not only_changed)
    for c in tracked:
        differs |= ~F.col(c).eqNullSafe(F.col(f"_u_{c}"))
    both = F.col("_h").isNotNull() & F.col("_u").isNotNull()

    def row(old: bool, start: Column, end: Column, current: Column) -> Column:
        return F.struct(*[F.col(c) for c in keys], *[F.col(c if old else f"_u_{c}").alias(c) for c in tracked], start.alias("effective_from"), end.alias("effective_to"), current.alias("is_current"))

    never = F.lit(None).cast("date")
    kept = row(True, F.col("effective_from"), F.col("effective_to"), F.col("is_current"))
    closed, opened = row(True, F.col("effective_from"), day, F.lit(False)), row(False, day, never, F.lit(True))
    out = F.when(both & differs, F.array(closed, opened)).when(F.col("_h").isNotNull(), F.array(kept)).otherwise(F.array(opened))
    return x.select(F.inline(out)).select(*history.columns)


def scd2_current(history: DataFrame) -> DataFrame:
    return history.where("is_current")


def scd2_point_in_time(facts: DataFrame, history: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Facts with the version that held at their time: from its start, before its end; without one, nulls."""
    h = history.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = (F.col(time) >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col(time) < F.col("effective_to")))
    for k in keys:
        on &= F.col(k) == F.col(f"_k_{k}")
    return facts.join(h, on, "left").drop(*[f"_k_{k}" for k in keys])


def except_both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a not in b and of b not in a, marked."""
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite the partitions that ``df`` holds and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def table_stats(spark: SparkSession, path: str) -> DataFrame:
    """Rows, files and bytes of a Parquet table; no column is read."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("rows"))
    return files.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("row_count"), F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("total_bytes"))


def compact_table(spark: SparkSession, path: str, out: str, file_bytes: int = 256 << 20) -> None:
    """Rewrite a table of many small files into few under a new path, sized by their bytes."""
    total = table_stats(spark, path).first()["total_bytes"]
    spark.read.parquet(path).repartition(max(1, -(-total // file_bytes))).write.parquet(out)


def evolve_columns(df: DataFrame, add: dict[str, str] | None = None, rename: dict[str, str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Columns added as nulls of a type, renamed, dropped."""
    out = df.withColumnsRenamed(rename or {}).drop(*(drop or []))
    return out.withColumns({c: F.lit(None).cast(t) for c, t in (add or {}).items()})


def pivot(df: DataFrame, by: list[str], column: str, values: list[str], what: Column, prefix: str = "", suffix: str = "", otherwise=0) -> DataFrame:
    """A column for each value: the sum of ``what`` over its rows, ``otherwise`` for the rest."""
    return df.groupBy(*by).agg(*[F.sum(F.when(F.col(column) == x, what).otherwise(otherwise)).alias(f"{prefix}{x}{suffix}") for x in values])


def unpivot(df: DataFrame, keep: list[str], remove: list[str], cast_to: str, field: str = "field_name", value: str = "value") -> DataFrame:
    """Columns but ``keep`` and ``remove`` as rows, cast to one type."""
    values = [c for c in df.columns if c not in keep and c not in remove]
    return df.select(*keep, *[F.col(c).cast(cast_to).alias(c) for c in values]).unpivot(keep, values, field, value)


def union_relations(frames: dict[str, DataFrame], exclude: tuple[str, ...] = (), where: str | None = None, source: str = "_source_relation", types: dict[str, str] | None = None) -> DataFrame:
    """Rows of all by name, nulls for what one lacks, with their table's name; ``types`` casts columns."""
    out = None
    for name, df in frames.items():
        x = df.drop(*exclude)
        x = x.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items() if c in x.columns}).withColumn(source, F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out.where(where) if where else out


def union_by_prefix(spark: SparkSession, prefix: str, exclude: str | None = None) -> DataFrame:
    """All tables and views of the current database whose name starts so, in one."""
    names = sorted(t.name for t in spark.catalog.listTables(pattern=f"{prefix}*") if not (exclude and t.name.startswith(exclude)))
    return union_relations({n: spark.table(n) for n in names})


def distinct_values(df: DataFrame, column: str, where: str | None = None, limit: int | None = None) -> DataFrame:
    """Values of a column by frequency, ties in their order."""
    out = (df.where(where) if where else df).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return out.limit(limit) if limit else out
