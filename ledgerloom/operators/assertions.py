"""Assertions: each returns the rows (or groups) that break it; an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _n() -> Column:
    return F.count(F.lit(1))


def expression_is_true(df: DataFrame, expression: Column) -> DataFrame:
    """Rows where the expression is false; null passes."""
    return df.where(~expression)


def accepted_range(df: DataFrame, column: str, lo=None, hi=None, inclusive: bool = True) -> DataFrame:
    """Rows outside the range; null passes, an end of None is open."""
    c, out = F.col(column), F.lit(False)
    if lo is not None:
        out |= (c < lo) if inclusive else (c <= lo)
    if hi is not None:
        out |= (c > hi) if inclusive else (c >= hi)
    return df.where(out)


def accepted_values(df: DataFrame, column: str, values: list, accept: bool = True) -> DataFrame:
    """Values, with counts, outside the list — inside it when ``accept`` is false; null passes."""
    hit = F.col(column).isin(values)
    return df.where(~hit if accept else hit).groupBy(column).agg(_n().alias("n"))


def at_least_one(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Groups without any non-null value."""
    return df.groupBy(*by).agg(F.count(column).alias("n")).where("n = 0").select(*by)


def not_constant(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Groups with a single different value: least and greatest decide it, no set of values is kept."""
    return df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")).where("_lo = _hi").select(*by)


def not_empty_string(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(column) == "")


def not_null_proportion(df: DataFrame, column: str, lo: float, hi: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Groups whose share of non-null values lies outside [lo, hi]."""
    share = df.groupBy(*by).agg(F.try_divide(F.count(column), _n()).alias("share"))
    return share.where((F.col("share") < lo) | (F.col("share") > hi))


def recency(df: DataFrame, column: str, as_of: str, days: int, by: list[str]) -> DataFrame:
    """Groups whose latest date is more than ``days`` before ``as_of``."""
    latest = df.groupBy(*by).agg(F.max(column).alias("latest"))
    return latest.where(F.col("latest") < F.date_sub(F.lit(as_of).cast("date"), days))


def sequential_values(df: DataFrame, column: str, by: list[str], step: int = 1, unit: str | None = None) -> DataFrame:
    """Rows that do not follow their predecessor within the group by exactly ``step``; with ``unit`` ("DAY", "HOUR") steps of time."""
    before = F.lag(column).over(Window.partitionBy(*by).orderBy(column))
    due = F.col("previous") + (F.lit(step) if unit is None else F.expr(f"INTERVAL {step} {unit}"))
    return df.withColumn("previous", before).where(F.col(column) != due)


def mutually_exclusive_ranges(df: DataFrame, lo: str, hi: str, by: list[str], order: list, gaps: str = "allowed", zero_length: bool = False) -> DataFrame:
    """Ranges that end before they start, or after the next one of their group starts.

    ``gaps``: "allowed", "not_allowed" (the next starts where this one ends) or
    "required"; ``zero_length`` lets a range end where it starts.
    """
    after = F.lead(lo).over(Window.partitionBy(*by).orderBy(*order))
    x = df.withColumn("next_start", after)
    end, start = F.col(hi), F.col("next_start")
    apart = {"allowed": end <= start, "not_allowed": end == start, "required": end < start}[gaps]
    forward = F.col(lo) <= end if zero_length else F.col(lo) < end
    return x.where(~(forward & F.coalesce(apart, F.lit(True))))


def relationships_where(df: DataFrame, key: str, reference: DataFrame, ref_key: str, where: Column | None = None, ref_where: Column | None = None) -> DataFrame:
    """Rows that meet ``where`` and whose non-null key is not among the reference's rows that meet ``ref_where``."""
    left = df.where(F.col(key).isNotNull() & (F.lit(True) if where is None else where))
    right = reference if ref_where is None else reference.where(ref_where)
    return left.join(right.select(F.col(ref_key).alias(key)), key, "left_anti")


def group_counts(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group on both sides, 0 where a side lacks it."""
    x, y = a.groupBy(*by).agg(_n().alias("n_a")), b.groupBy(*by).agg(_n().alias("n_b"))
    return x.join(y, by, "full").select(*by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b")])


def equal_rowcount(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return group_counts(a, b, by).where("n_a <> n_b")


def fewer_rows_than(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Groups of which ``a`` has as many rows as ``b`` or more."""
    return group_counts(a, b, by).where("n_a >= n_b")


def cardinality_equality(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """Values whose numbers of rows differ between the two sides."""
    return equal_rowcount(a.select(F.col(column_a).alias("value")), b.select(F.col(column_b).alias("value")), ["value"])
