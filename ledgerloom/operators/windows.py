"""Ranks, tiles and medians over large tables without sorting them in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import materialize


def global_ranks(df: DataFrame, value: str, tie: str | None = None, prefix: str = "", once: bool = True) -> DataFrame:
    """Adds ``rank``, ``dense_rank``, ``row_number`` and ``running_sum`` (ties share) by ``value``, descending.

    Boundary values deal rows into about as many ranges as a shuffle has partitions; each
    range's counts and sums are added up over the ranges before it (one row each), and rows
    rank within their range only. Equal values share a range, so ties stay exact;
    ``row_number`` breaks them by ``tie``, descending. Null values are ranked last.
    ``once``: materialize the table first, as it is read three times.
    """
    df = materialize(df) if once else df
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    bounds = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds), reverse=True)])
    # how many boundaries lie above the value
    bucket = F.when(F.col(value).isNull(), F.lit(buckets + 1)).otherwise(F.size(F.filter(edges, lambda b: b > F.col(value)))) if bounds else F.lit(0)
    x = df.withColumn("_b", bucket)
    sums = x.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("d"), F.sum(value).alias("s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in "nds"])
    own = Window.partitionBy("_b").orderBy(F.col(value).desc_nulls_last())
    each = Window.partitionBy("_b").orderBy(F.col(value).desc_nulls_last(), *([F.desc(tie)] if tie else []))
    ranked = x.join(F.broadcast(offsets), "_b")  # a row per range
    out = {
        "rank": (F.rank().over(own) + F.col("_n")).cast("long"),
        "dense_rank": (F.dense_rank().over(own) + F.col("_d")).cast("long"),
        "row_number": (F.row_number().over(each) + F.col("_n")).cast("long"),
        "running_sum": F.sum(value).over(own.rangeBetween(Window.unboundedPreceding, 0)) + F.col("_s"),
    }
    return ranked.select(*df.columns, *[c.alias(f"{prefix}{k}") for k, c in out.items()])


def _above(edges: list, value: Column, kind: str) -> Column:
    """How many of the falling ``edges`` are greater than the value: in whole chunks first, then within one."""
    step = max(1, math.isqrt(len(edges)))
    array = lambda xs: F.array(*[F.lit(x).cast(kind) for x in xs]).cast(f"array<{kind}>")
    within = lambda xs: F.size(F.filter(xs, lambda e: e > value))
    chunks = within(array(edges[step - 1 :: step]))
    return chunks * step + within(F.slice(array(edges), chunks * step + 1, step))


def _common_type(df: DataFrame, columns: list[str]) -> str:
    """A numeric type that holds all columns' values."""
    kinds = [df.schema[c].dataType for c in columns]
    if any(k.typeName() in ("double", "float") for k in kinds):
        return "double"
    return f"decimal(38,{max(getattr(k, 'scale', 0) for k in kinds)})"


def global_orders(df: DataFrame, key: str, wanted: dict[str, tuple[str, str]], once: bool = True) -> DataFrame:
    """Ranks of several numeric measures over all rows, descending, nulls last, in one shuffle.

    ``wanted``: new column -> (measure, kind); kinds are ``rank``, ``dense_rank``,
    ``row_number`` (ties by the larger key first), ``running_sum`` (ties share), ``rows``
    and ``distinct`` (the largest dense rank). ``key`` is unique and not null.

    One job finds splitters of all measures. Rows melt to (measure, value) and go to the
    range of their value, all measures at once; each range is sorted once, and its counts and
    sums are added up over the ranges before it. One aggregation by key brings the ranks
    back. A value that fills more than a range has ranges of its own, dealt by a numeric
    key, so that ties of a third of the rows don't meet in one task; nulls likewise.
    ``once``: materialize the table first, as it is read twice.
    """
    df = materialize(df) if once else df
    measures = list(dict.fromkeys(m for m, _ in wanted.values()))
    kind, columns = _common_type(df, measures), df.columns
    numeric_key = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long", "decimal")
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    at = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(*[F.percentile_approx(c, at, 10_000) for c in [*measures, *([key] if numeric_key else [])]]).first()
    key_edges = sorted(set(bounds[-1] or []), reverse=True) if numeric_key else []
    key_kind = df.schema[key].dataType.simpleString()
    lanes = []
    for m, (c, found) in enumerate(zip(measures, bounds, strict=False)):
        edges, v = sorted(set(found or []), reverse=True), F.col(c)
        hot = [e for e in edges if (found or []).count(e) > 1]
        alone = v.isin(*[F.lit(e) for e in hot]) if hot else F.lit(False)
        of = df.schema[c].dataType.simpleString()
        # a value that is hot comes after the rest of its range, whose least it is
        bucket = F.when(v.isNull(), 2 * len(edges) + 3).otherwise(2 * _above(edges, v, of) + F.when(alone, 1).otherwise(0)) if edges else F.when(v.isNull(), 3).otherwise(0)
        part = F.when(v.isNull() | alone, _above(key_edges, F.col(key), key_kind)).otherwise(0) if key_edges else F.lit(0)
        row = F.when(F.lit(m == 0), F.struct(*columns))
        lanes.append(F.struct(F.lit(m).alias("_m"), v.cast(kind).alias("_v"), bucket.cast("int").alias("_b"), part.cast("int").alias("_p"), row.alias("_row")))
    x = df.select(F.col(key).alias("_k"), F.inline(F.array(*lanes)))
    each = Window.partitionBy("_m", "_b", "_p").orderBy(F.col("_v").desc_nulls_last(), F.desc("_k"))
    own = Window.partitionBy("_m", "_b", "_p").orderBy(F.col("_v").desc_nulls_last())
    placed = materialize(x.withColumns({"_row_number": F.row_number().over(each), "_rank": F.rank().over(own), "_dense": F.dense_rank().over(own), "_sum": F.sum("_v").over(own.rangeBetween(Window.unboundedPreceding, 0))}))
    # a row for each measure and range
    sums = placed.groupBy("_m", "_b", "_p").agg(F.count(F.lit(1)).alias("n"), F.max("_dense").alias("d"), F.sum("_v").alias("s"))
    ordered = Window.partitionBy("_m").orderBy("_b", "_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy("_m").orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    whole, bucket = Window.partitionBy("_m"), Window.partitionBy("_m", "_b")
    first = F.when(F.row_number().over(bucket.orderBy("_p")) == 1, F.col("d")).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = sums.withColumn("d", first).select("_m", "_b", "_p", zero(F.sum("n").over(ordered)).alias("_before"), zero(F.sum("n").over(ranges)).alias("_n"), zero(F.sum("d").over(ranges)).alias("_d"), zero(F.sum("s").over(ranges)).alias("_s"), F.sum("s").over(bucket).alias("_own"), F.sum("n").over(whole).alias("_all"), F.sum("d").over(whole).alias("_distinct"))
    tied = F.col("_b") % 2 == 1
    made = {
        "rank": F.col("_rank") + F.col("_n"), "dense_rank": F.col("_dense") + F.col("_d"), "row_number": F.col("_row_number") + F.col("_before"), "running_sum": F.when(F.col("_v").isNotNull(), F.col("_s") + F.when(tied, F.col("_own")).otherwise(F.col("_sum"))),
        "rows": F.col("_all"), "distinct": F.col("_distinct"),
    }
    joined = placed.join(F.broadcast(offsets), ["_m", "_b", "_p"])
    back = [F.max(F.when(F.col("_m") == measures.index(c), made[k] if k == "running_sum" else made[k].cast("long"))).alias(name) for name, (c, k) in wanted.items()]
    return joined.groupBy("_k").agg(F.first("_row", ignorenulls=True).alias("_row"), *back).select("_row.*", *wanted)


def tile(row_number: Column, rows: Column, tiles: int) -> Column:
    """The tile of a row, as ntile gives it: the first ``rows % tiles`` tiles hold one row more."""
    small, more = F.floor(rows / tiles), rows % tiles
    head = more * (small + 1)
    return F.when(row_number <= head, F.ceil(row_number / (small + 1))).otherwise(more + F.ceil((row_number - head) / F.greatest(small, F.lit(1)))).cast("int")


def grouped_median(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The median of each group, from counts of its different values: no task holds a group's rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    through = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = counts.withColumn("_through", through).withColumn("_all", F.sum("_n").over(w))
    low = F.min(F.when(F.col("_through") >= F.floor((F.col("_all") + 1) / 2), F.col(value)))
    high = F.min(F.when(F.col("_through") >= F.floor(F.col("_all") / 2) + 1, F.col(value)))
    return c.groupBy(*by).agg(((low + high).cast("double") / 2).alias(name))
