"""Checks that fuse into one aggregation per table; a row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def ratio_checks(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """``rule_name``, ``actual_value`` (share of rows that hold; 1 for none), ``passed`` — one pass for all checks; null counts as not holding."""
    n = F.count(F.lit(1))
    row = df.agg(*[F.coalesce(F.try_divide(F.sum(F.coalesce(c.cast("int"), F.lit(0))), n), F.lit(1.0)).alias(k) for k, (c, _) in checks.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule_name"), F.round(F.col(k), 6).alias("actual_value"), (F.col(k) >= least).alias("passed")) for k, (_, least) in checks.items()])).alias("x")).select("x.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row and their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, reference: DataFrame, ref_key: str) -> DataFrame:
    """Rows whose non-null key the reference lacks."""
    return df.where(F.col(key).isNotNull()).join(reference.select(F.col(ref_key).alias(key)).distinct(), key, "left_anti")


def outliers_iqr(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences; the quartiles come from counts of different values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    q = counts.agg(F.percentile(column, F.lit(0.25), F.col("_n")).alias("_lo"), F.percentile(column, F.lit(0.75), F.col("_n")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) * k
    return df.crossJoin(F.broadcast(q)).where((F.col(column) < F.col("_lo") - width) | (F.col(column) > F.col("_hi") + width)).drop("_lo", "_hi")


def outliers_zscore(df: DataFrame, column: str, deviations: float = 3.0) -> DataFrame:
    """Rows further from the mean than so many standard deviations; nulls and a column without spread have none."""
    x = F.col(column).cast("double")
    stats = F.broadcast(df.agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd")))  # one row
    return df.crossJoin(stats).where(F.abs(x - F.col("_mean")) > F.col("_sd") * deviations).drop("_mean", "_sd")


def broken_rules(df: DataFrame, rules: dict[str, Column], name: str = "reasons") -> DataFrame:
    """Adds an array of the names of all rules that a row breaks, in their order; empty for good rows. A rule that is null counts as broken."""
    each = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]
    return df.withColumn(name, F.array_compact(F.array(*each)))


def write_quarantined(df: DataFrame, rules: dict[str, Column], path: str) -> dict[str, int]:
    """Write all rows once, below ``outcome=good`` and ``outcome=quarantined``, with the rules they break; the rows of each outcome, counted by the write."""
    seen = Observation()
    out = broken_rules(df, rules).withColumn("outcome", F.when(F.size("reasons") == 0, "good").otherwise("quarantined"))
    out = out.observe(seen, F.count_if(F.col("outcome") == "good").alias("good"), F.count_if(F.col("outcome") == "quarantined").alias("quarantined"))
    out.write.mode("overwrite").partitionBy("outcome").parquet(path)
    return dict(seen.get)
