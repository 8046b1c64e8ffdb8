"""Mixing sources to target weights by Pareto order sampling.

A source with ``size`` words and target ``T`` takes each of its documents
``floor(T / size)`` times: these whole copies are certain. The words still missing are
drawn with unequal probabilities, in proportion to a document's size: p = l * size, with
l such that the expected words are those missing; documents for which that would exceed 1
are certain too, and l is that of the others. Those are ranked by their random odds
divided by their inclusion odds, u / (1 - u) : p / (1 - p), with u a hash of the document.
The sample is the head of that order; its fixed size is counted in words, so it ends at
the document whose inclusion brings the words closest to the target.

``l`` comes from the counts of each (source, size). The order of a source is never sorted
in one task: ranks fall into buckets, the words of each (source, bucket) are summed first,
a running sum over at most ``BUCKETS`` rows a source finds the bucket that holds the end,
and only its documents are sorted, about one in ``BUCKETS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BUCKETS = 4096
SEED = "mix-1"
BROADCAST_SOURCES = 100_000


def uniform(doc_id: Column, size: Column) -> Column:
    """In [0, 1): 52 bits of the MD5 of seed, id and size."""
    key = F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size``, ``target`` for rows of (source, size).

    Targets share all words by weight; one that would exceed ``most`` times its source
    stops there and the excess is shared again by weight. In order of size over weight
    the sources that stop come first, so the sharing has a closed form. The windows run
    over one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source, in that order, that does not stop sets the level for all from there on; later levels are no higher
    s = s.withColumn("lambda", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    return s.select("source", F.col("source_size").cast("long"), F.when(F.col("lambda").isNull() | (F.col("ratio") < F.col("lambda")), F.col("cap")).otherwise(F.col("lambda") * F.col("w")).alias("target"))


def by_source_join(x: DataFrame, per_source: DataFrame, how: str) -> DataFrame:
    """Join a table of one row per source; broadcast while it has at most ``BROADCAST_SOURCES`` rows, else by a skew-aware shuffle."""
    if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    return x.join(per_source, x["source"].eqNullSafe(per_source["_s"]), how).drop("_s")


def inclusion(sized: DataFrame, t: DataFrame) -> DataFrame:
    """``source``, ``most_drawn``, ``per_word``, ``certain``: documents over ``most_drawn`` words are certain and have ``certain`` words; others are drawn with ``per_word`` times their size.

    ``t``: ``_s``, ``rest`` by source. The window runs over the different sizes of a source.
    """
    kinds = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    kinds = by_source_join(kinds, t.where("rest > 0").select("_s", "rest"), "inner")
    words, squares = (F.col("n") * F.col("size")).cast("decimal(38,0)"), F.col("n").cast("decimal(19,0)") * F.col("size").cast("decimal(9,0)") * F.col("size").cast("decimal(9,0)")
    order = Window.partitionBy("source").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    others = F.sum(squares).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    kinds = kinds.select("source", "size", larger.alias("certain"), ((F.col("rest") - larger) / others).alias("per_word"))
    fits = kinds.where(F.col("per_word") * F.col("size") <= 1)
    return fits.groupBy("source").agg(F.max(F.struct("size", "per_word", "certain")).alias("x")).select("source", F.col("x.size").alias("most_drawn"), "x.per_word", "x.certain")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).

    Null texts have size 0; documents of size 0 are taken as often as is certain and
    never drawn; null sources form one source, last in order; equal documents
    (repeated rows) are ranked in a fixed order; an empty table gives no rows.
    ``keep`` names further columns to return; others are ignored.
    """
    keep = tuple(c for c in keep if c != "source")
    sized = docs.select(F.col(id_col), "source", *keep, word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("_u", uniform(F.col(id_col), F.col("size")))
    if not keep:
        sized = cut(sized)
    t = cut(targets(sized.select("source", "size"), weights, most))
    t = t.withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    # at most `most` copies; a share within rounding of a whole number is that number
    t = t.withColumn("base", F.floor(F.col("r") + 1e-12).cast("int")).withColumn("rest", F.when(F.col("r") - F.col("base") > 1e-12, F.col("target") - F.col("base") * F.col("source_size")).otherwise(F.lit(0.0)))
    t = t.withColumnRenamed("source", "_s")
    chances = cut(inclusion(sized.select("source", "size"), t)).withColumnRenamed("source", "_c")
    t = cut(t.join(chances, t["_s"].eqNullSafe(chances["_c"]), "left").select("_s", "source_size", "target", "base", "most_drawn", "per_word", (F.col("rest") - F.col("certain")).alias("rest")))
    x = by_source_join(sized, t, "inner")
    some = F.col("most_drawn").isNotNull() & (F.col("size") > 0)
    drawn = some & (F.col("size") <= F.col("most_drawn"))
    p = F.col("per_word") * F.col("size")
    x = x.withColumn("_score", F.when(drawn, F.col("_u") / (1 - F.col("_u")) * ((1 - p) / p)))
    # rising in the score, so buckets are stretches of the order
    x = x.withColumn("_b", F.floor(F.col("_score") / (1 + F.col("_score")) * BUCKETS).cast("int"))
    by_source = Window.partitionBy("source").orderBy("_b")
    sums = x.where(drawn).groupBy("source", "_b").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    ends = sums.withColumn("through", F.sum("words").over(by_source)).withColumn("before", F.col("through") - F.col("words"))
    # the bucket in which the words pass the target: the only one to sort
    end = ends.where((F.col("before") < F.col("rest")) & (F.col("through") >= F.col("rest"))).select(F.col("source").alias("_s"), F.col("_b").alias("_end"), F.col("before").alias("_before"))
    x = by_source_join(x, cut(end), "left")
    edge = F.coalesce(drawn & (F.col("_b") == F.col("_end")), F.lit(False))
    order = Window.partitionBy("source").orderBy("_score", id_col, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = x.where(edge).withColumn("_run", F.col("_before") + F.sum("size").over(order)).withColumn("extra", (F.col("_run") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("_run")
    outer = x.where(~edge).withColumn("extra", F.when(some & (~drawn | F.col("_end").isNull() | (F.col("_b") < F.col("_end"))), 1).otherwise(0))
    both = outer.unionByName(inner)
    return both.withColumn("copies", F.col("base") + F.col("extra")).select(id_col, "source", *keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), u AS (
  SELECT *, CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM sized
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sized GROUP BY source
), c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS lam FROM l
), t AS (SELECT source, source_size, CASE WHEN lam IS NULL OR ratio < lam THEN cap ELSE lam * w END AS target FROM g
), b AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM t
), p AS (SELECT *, CAST(floor(r + 1e-12) AS INTEGER) AS base FROM b
), q AS (SELECT *, CASE WHEN r - base > 1e-12 THEN target - base * source_size ELSE 0.0::DOUBLE END AS rest FROM p
), k AS (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY ALL
), m AS (
  SELECT k.source, k.size, q.rest,
    CAST(coalesce(sum(k.n * k.size) OVER (PARTITION BY k.source ORDER BY k.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS certain,
    CAST(sum(CAST(k.n AS HUGEINT) * k.size * k.size) OVER (PARTITION BY k.source ORDER BY k.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS squares
  FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source WHERE q.rest > 0
), d AS (SELECT source, size AS most_drawn, (rest - certain) / squares AS per_word, rest - certain AS left_over FROM m WHERE (rest - certain) / squares * size <= 1
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY size DESC) = 1
), x AS (
  SELECT u.*, q.source_size, q.target, q.base, d.left_over, d.most_drawn IS NOT NULL AND size > most_drawn AS sure, coalesce(size > 0 AND size <= most_drawn, false) AS drawn,
    CASE WHEN size > 0 AND size <= most_drawn THEN u / (1 - u) * ((1 - per_word * size) / (per_word * size)) END AS score
  FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source LEFT JOIN d ON u.source IS NOT DISTINCT FROM d.source
), y AS (
  SELECT *, sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY drawn DESC, score, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS run FROM x
)
SELECT doc_id, size, source_size, target, CAST((base + CASE WHEN sure OR drawn AND run - size / 2.0 <= left_over THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM y
"""
