"""Benchmark decontamination with spaced seeds, by DataFrame functions only.

Tokens are lower-cased runs of letters and digits. A seed looks at five of up to
eight consecutive tokens and ignores the rest, so a hit survives substitutions at
ignored positions. The three masks are lossless for the rule below: in any aligned
stretch of 8 to 16 tokens in which at least 80 % agree, one mask fits on agreeing
tokens alone (a test tries every pattern). Items of fewer tokens than a mask spans
are hashed whole and must occur whole.

Hits say on which diagonal (document position minus item position) to look. There,
item and document are compared token by token: the item counts as contained when a
stretch of min(16, item length) tokens agrees in at least 80 %. A fixed-size bit map
of the item hashes drops document positions that can match nothing before any join;
it only ever passes too many. Items and hits join on hashes.

Such a stretch holds its hit, so what a hit proves depends only on the 15 tokens before
and after it. Positions with equal surroundings in one text prove the same; the first
stands for all, on both sides, before the join: a text of one repeated word, of a
repeated line or passage has as many hits as different surroundings. Hits are verified
on blocks of 64 tokens with those margins, and no document array is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 2, 3, 4))
SPAN = 8
WINDOW = 16
AGREE = 0.8
_MAP_BITS = 20
BROADCAST_KEYS = 500_000
BLOCK = 64


def tokens(text: Column) -> Column:
    """Hashes of a text's tokens in order; null or no token: empty array."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(t: Column, i: Column, mask: tuple[int, ...], k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(t, i + F.lit(o)) for o in mask])


def _whole(t: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(100 + n), *[F.get(t, i + F.lit(o)) for o in range(n)])


def _pair(t: Column, i: Column) -> Column:
    return F.xxhash64(F.lit(50), F.get(t, i), F.get(t, i + F.lit(1)))


def _positions(n: Column, span: int) -> Column:
    """0 .. n - span, empty when the tokens are fewer."""
    return F.when(n >= span, F.sequence(F.lit(0), n - F.lit(span))).otherwise(F.array().cast("array<int>"))


def _held(x: Column) -> Column:
    """Evaluated once a row: a plain projection would be put into each place, and each lambda, that refers to it."""
    return F.explode(F.array(x))


def _spaced(mask: tuple[int, ...], k: int):
    """Span and hash of a spaced seed."""
    return mask[-1] + 1, lambda t, i: _seed(t, i, mask, k)


def _contiguous(n: int):
    """Span and hash of a whole short item."""
    return n, lambda t, i: _whole(t, i, n)


def _around(t: Column, i: Column) -> Column:
    """Hash of all tokens that a stretch over position i can hold, and of how many stand before i."""
    first = F.greatest(i - F.lit(WINDOW - 1), F.lit(0))
    return F.xxhash64(i - first, F.slice(t, first + 1, i - first + F.lit(WINDOW)))


def _seeds(positions: Column, t: Column, f) -> Column:
    """(at, h, around) of the given positions."""
    return F.transform(positions, lambda i: F.struct(i.alias("at"), f(t, i).alias("h"), _around(t, i).alias("around")))


def needed(length: Column) -> Column:
    """Tokens that must agree within the compared stretch: all of an item shorter than a mask's span."""
    w = F.least(length, F.lit(WINDOW))
    return F.when(length < SPAN, length).otherwise(F.ceil(w * F.lit(AGREE)).cast("int"))


def matches(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Contained items: ``_key`` (hash of the text), ``item_id``, ``agreeing`` (most agreeing tokens of a stretch), ``stretch``."""
    it = items.select("item_id", _held(tokens(F.col("text"))).alias("it")).where(F.size("it") > 0).withColumn("n", F.size("it"))
    short = sorted(r[0] for r in it.where(F.col("n") < SPAN).select("n").distinct().collect())  # seven values at most
    spans = [_spaced(mask, k) for k, mask in enumerate(MASKS)]
    seeds = [_seeds(F.when(F.col("n") >= SPAN, _positions(F.col("n"), s)).otherwise(F.array().cast("array<int>")), F.col("it"), f) for s, f in spans]
    seeds += [F.when(F.col("n") == n, _seeds(F.array(F.lit(0)), F.col("it"), _contiguous(n)[1])).otherwise(F.array().cast("array<struct<at:int,h:bigint,around:bigint>>")) for n in short]
    pairs = F.transform(_positions(F.col("n"), 2), lambda i: F.struct(F.lit(-1).alias("at"), _pair(F.col("it"), i).alias("h"), F.lit(0).cast("long").alias("around")))
    seeds.append(pairs)  # at -1: they only fill the bit map
    seeded = it.select("item_id", "it", "n", F.explode(F.concat(*seeds)).alias("s")).groupBy("item_id", F.col("s.h").alias("h"), F.col("s.around").alias("around")).agg(F.min("s.at").alias("item_at")).drop("around")
    # the bit map: 2^20 bits in 2^14 longs at most, however many items
    cell = F.shiftrightunsigned(F.col("h"), 64 - _MAP_BITS)
    rows = seeded.select(F.shiftright(cell, 6).cast("int").alias("w"), (cell % 64).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).collect()
    full = [0] * (1 << (_MAP_BITS - 6))
    for r in rows:
        full[r["w"]] = r["v"]
    # a literal: folded once, where a parsed or joined map would be looked up through more layers for each position
    # from one string, as an expression for each long, kept by each plan, takes much of the driver's memory
    bits = F.split(F.lit(",".join(map(str, full))), ",").cast("array<bigint>") if rows else None
    doc = docs.select(F.xxhash64(F.lit(5), text_col).alias("_key"), _held(tokens(F.col(text_col))).alias("dt"))
    empty = "_key long, item_id long, agreeing int, stretch int"
    if bits is None:
        return docs.sparkSession.createDataFrame([], empty)

    def passes(h: Column) -> Column:
        c = F.shiftrightunsigned(h, 64 - _MAP_BITS)
        return F.get(bits, F.shiftright(c, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (c % 64).cast("int"))) != 0

    n = F.size("dt")
    tests = [*spans, *[_contiguous(k) for k in short]]

    def tested(span: int, f) -> Column:
        at = F.filter(F.col("pairs"), lambda i: i + F.lit(span) <= n) if span > 1 else _positions(n, 1)
        return F.transform(at, lambda i: F.struct(i.alias("at"), f(F.col("dt"), i).alias("h")))

    # every seed of two tokens or more looks at the first two: most positions end there
    doc = doc.withColumn("pairs", _held(F.filter(_positions(n, 2), lambda i: passes(_pair(F.col("dt"), i)))))
    # one look at the map for all tests, as each place that names it holds a copy
    found = F.filter(F.concat(*[tested(s, f) for s, f in tests]), lambda x: passes(x["h"]))
    hits = F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), _around(F.col("dt"), x["at"]).alias("around")))
    hit = doc.withColumn("hits", _held(hits)).where(F.size("hits") > 0).select("_key", "hits")
    seeded = seeded.where("item_at >= 0")
    at = hit.select("_key", F.explode("hits").alias("x")).groupBy("_key", F.col("x.h").alias("h"), F.col("x.around").alias("around")).agg(F.min("x.at").alias("doc_at"))
    block = F.floor(F.col("doc_at") / BLOCK).cast("int").alias("block")
    diagonals = cut(at.join(seeded, "h").select("_key", "item_id", block, (F.col("doc_at") - F.col("item_at")).alias("d")).distinct())
    # only texts on a diagonal are tokenized again; their keys are broadcast while they are few
    keys = diagonals.select("_key").distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = docs.select(F.xxhash64(F.lit(5), text_col).alias("_key"), F.col(text_col).alias("_text")).join(keys, "_key", "left_semi")
    kept = texts.groupBy("_key").agg(F.first("_text").alias("_text")).select("_key", _held(tokens(F.col("_text"))).alias("dt"))
    return verify(diagonals, kept, it)


def blocks(docs: DataFrame) -> DataFrame:
    """``_key, block, from, dt``: each text's tokens in blocks, with the margins that a stretch over a block's tokens can reach; ``from``: the first one's position."""
    first = lambda b: F.greatest(b * F.lit(BLOCK) - F.lit(WINDOW - 1), F.lit(0))
    last = lambda b: (b + 1) * F.lit(BLOCK) + F.lit(WINDOW - 1)
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("dt") - 1) / BLOCK).cast("int")), lambda b: F.struct(b.alias("block"), first(b).alias("from"), F.slice("dt", first(b) + 1, last(b) - first(b)).alias("dt")))
    return docs.where(F.size("dt") > 0).select("_key", F.explode(cuts).alias("c")).select("_key", "c.*")


def verify(diagonals: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Best stretch of each (text, item) over the blocks of its diagonals, where it agrees enough."""
    pair = diagonals.join(blocks(docs), ["_key", "block"]).join(items, "item_id")
    low = F.greatest(F.col("block") * BLOCK - (WINDOW - 1) - F.col("d"), F.lit(0))
    high = F.least((F.col("block") + 1) * BLOCK + (WINDOW - 2) - F.col("d"), F.col("n") - 1)
    at = lambda i: i + F.col("d") - F.col("from")
    equal = F.transform(F.sequence(low, high), lambda i: F.when((at(i) >= 0) & (F.get("dt", F.greatest(at(i), F.lit(0))) == F.get("it", i)), 1).otherwise(0))
    # running sums: a stretch's count is a difference of two
    sums = F.aggregate("eq", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("eq") - F.col("w")), lambda i: F.get("sums", i + F.col("w")) - F.get("sums", i)))
    scored = pair.withColumn("eq", _held(equal)).withColumn("w", F.least(F.col("n"), F.lit(WINDOW))).select("_key", "item_id", "n", "w", "eq").where(F.size("eq") >= F.col("w"))
    scored = scored.withColumn("sums", _held(sums)).select("_key", "item_id", "n", "w", _held(best).alias("best"))
    kept = scored.where(F.col("best") >= needed(F.col("n")))
    return kept.groupBy("_key", "item_id").agg(F.max("best").alias("agreeing"), F.max("w").alias("stretch"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``contaminated``, ``n_items``, ``item_ids`` (ascending), ``agreeing`` (0: none).

    Null and empty texts, and null or token-less items, match nothing; repeated
    documents each return; repeated items count once per id; an empty table on either
    side gives no hits; other columns are ignored.
    """
    by_text = matches(docs, items, text_col).groupBy("_key").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("agreeing").alias("agreeing"))
    return (
        docs.select(F.col(id_col), F.xxhash64(F.lit(5), text_col).alias("_key"))
        .join(by_text, "_key", "left")
        .select(id_col, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("agreeing", F.lit(0)).alias("agreeing"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that contain no item, with all their columns, whatever their names.

    Null and empty texts contain none and stay; repeated rows stay or go together; an
    empty table, of documents or of items, takes nothing away.
    """
    key = free_name(docs, "_key")
    hit = matches(docs.select(text_col), items, text_col).select(F.col("_key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(F.lit(5), text_col)).join(hit, key, "left_anti").drop(key)
