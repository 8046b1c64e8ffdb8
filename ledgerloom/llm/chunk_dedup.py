"""Repeated passages by content-defined chunking with a gear rolling hash.

The hash of a position is h = (h << 1) + G[byte] in 16 bits, so it depends on the last
16 bytes alone; a chunk ends where h falls below a threshold, at least ``MIN_CHUNK``
bytes after its start, and at ``MAX_CHUNK`` bytes in any case. Inserting text moves only
the boundaries next to it. Chunks are told apart by a 64-bit digest of their bytes.
Digests are counted with partial aggregation; a digest found in two documents marks its
chunks, and neighbouring marked chunks join into islands.

Two neighbours belong to one island only if another document holds both in a row, so
quotations from different documents stay apart where they meet. To the right, agreement
beyond the next boundary would have made that chunk part of the island; to the left,
boundaries can be out of step. So an island goes whose words, those of the next chunk and
those of ``BEFORE`` bytes before it are too few, unless so many bytes agree there.

A passage seldom starts or ends at a boundary, so islands are seeds: at
both ends the bytes around are compared with those of another document that holds the
chunk there (the one of the smallest id), which also confirms the chunk itself, and the
passage is extended as far as both agree, in whole words. Rounds compare ``CONTEXT`` bytes
a side, then ``WIDER`` times as many for the ends that still agreed there, until none is
left, so no extension has a limit. The
words of the extended passage are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_clean, free_name

MIN_CHUNK, MAX_CHUNK = 16, 128
CUT_ONE_IN = 32
#: Passages of over 50 words are meant: five words of slack where an end meets no further agreement.
MIN_WORDS = 45
#: Bytes compared beyond an island, on either side, in the first round, and how many times as many in each further one.
CONTEXT, WIDER = MAX_CHUNK, 8
#: Bytes before a chunk whose hash travels with it; agreement over fewer adds at most half as many words, rounded up.
BEFORE = 16
#: A fixed-size bit map of the digests that repeat lets few of the others travel; at some 10^7 of them it lets most through, and the join alone decides.
MAP_BITS = 24
#: Ends up to which what a round asks for is broadcast, instead of dealing the texts.
FEW_ENDS = 100_000
_LAST = (1 << 63) - 1  # stands for a null id: last in order
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_table() -> np.ndarray:
    return np.random.default_rng(16).integers(0, 1 << 16, 256).astype(np.uint16)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling: four shifted sums make 16 steps."""
    h = gear[data]
    for step in (1, 2, 4, 8):
        g = h.copy()
        g[step:] += h[:-step] << np.uint16(step)
        h = g
    return h


def boundaries(data: np.ndarray, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes; the last is its length."""
    n = len(data)
    if not n:
        return []
    ends, start = [], 0
    for c in (np.flatnonzero(gear_hashes(data, gear) < (1 << 16) // CUT_ONE_IN) + 1).tolist():
        while c - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if c - start >= MIN_CHUNK:
            ends.append(c)
            start = c
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def _bit_map(digests: DataFrame) -> np.ndarray:
    """Which values of the first ``MAP_BITS`` bits the column ``h`` has: 2 MB, whatever the number of rows."""
    cell = F.shiftrightunsigned("h", 64 - MAP_BITS)
    words = digests.select(F.shiftright(cell, 6).cast("int").alias("w"), (cell % 64).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.view(np.uint64)


def _chunker(positions: bool, bit_map=None):
    gear = gear_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            names = b.schema.names
            rows, ids, texts = (b.column(names.index(x)) for x in ("_row", "_id", "text"))
            size, at, h, s, e, w, x, p = [], [], [], [], [], [], [], []

            def flush():
                take = np.repeat(np.asarray(at, np.int64), size)
                cols = [pa.array(np.array(h, dtype=np.uint64).view(np.int64)), rows.take(pa.array(take)), ids.take(pa.array(take))]
                cols += [pa.array(np.asarray(s, np.int32)), pa.array(np.asarray(e, np.int32)), pa.array(np.asarray(w, np.int32)), pa.array(np.asarray(x, np.int32)), pa.array(np.array(p, dtype=np.uint64).view(np.int64))] if positions else []
                out = pa.RecordBatch.from_arrays(cols, names=["h", "_row", "_id", "s", "e", "w", "x", "p"] if positions else ["h", "_row", "_id"])
                if bit_map is not None:
                    cell = np.array(h, np.uint64) >> np.uint64(64 - MAP_BITS)
                    out = out.filter(pa.array((bit_map.value[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)))
                for part in (size, at, h, s, e, w, x, p):
                    part.clear()
                return out

            for i in range(b.num_rows):
                t = texts[i].as_buffer() if texts[i].is_valid else None
                if t is None or not t.size:
                    continue
                data = np.frombuffer(t, np.uint8)
                ends = boundaries(data, gear)
                raw, start = t.to_pybytes(), 0
                starts = [0, *ends[:-1]]
                h += [digest(raw[i:j]) for i, j in zip(starts, ends, strict=True)]
                if positions:
                    # a word belongs to the chunk that holds its first byte
                    space = _SPACE[data]
                    first = ~space & np.concatenate(([True], space[:-1]))
                    upto = np.concatenate(([0], np.cumsum(first)))
                    s += starts
                    e += ends
                    words = (upto[ends] - upto[starts]).tolist()
                    w += words
                    x += [*words[1:], 0]
                    p += [digest(raw[max(0, i - BEFORE) : i]) for i in starts]
                size.append(len(ends))
                at.append(i)
                if len(h) > 500_000:
                    yield flush()
            if h:
                yield flush()

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col)).alias("_row"), F.coalesce(F.col(id_col), F.lit(_LAST)).alias("_id"), F.col(text_col).cast("binary").alias("text"))


_PIECE = "_row long, s int, e int, side int, piece binary"


def _contexts(context: int):
    """The bytes asked for: up to ``context`` beyond a chunk, and the chunk. ``side`` 0: before its end, 1: after its start."""

    def batch(out: list[list]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["_row", "s", "e", "side", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts, asks = (b.column(b.schema.names.index(x)) for x in ("_row", "text", "asked"))
            out: list[list] = [[], [], [], [], []]
            held = 0
            for i in range(b.num_rows):
                row, text = rows[i].as_py(), texts[i].as_py()
                for a in asks[i].as_py():
                    s, e, side = a["s"], a["e"], a["side"]
                    piece = text[max(0, s - context) : e] if side == 0 else text[s : e + context]
                    for x, y in zip(out, (row, s, e, side, piece), strict=True):
                        x.append(y)
                    held += len(piece)
                    if held > 16 << 20:
                        yield batch(out)
                        out, held = [[], [], [], [], []], 0
            yield batch(out)

    return run


def agreement(own: bytes, other: bytes, size: int, side: int) -> tuple[int, int]:
    """Bytes and words by which a passage goes on beyond a chunk of ``size`` bytes; -1, 0 if the chunks differ.

    Whole words only: what agrees ends with the text or with white space on its far side.
    """
    if side == 0:
        own, other = own[::-1], other[::-1]
    n = min(len(own), len(other))
    a, b = np.frombuffer(own, np.uint8, n), np.frombuffer(other, np.uint8, n)
    off = np.flatnonzero(a != b)
    k = int(off[0]) if len(off) else n
    if k < size:
        return -1, 0
    beyond = np.frombuffer(own, np.uint8)[size : k + 1]  # with the byte after it, if there is one
    space = _SPACE[beyond]
    whole = k == len(own) or bool(space[-1])
    if k > size and not whole:
        at = np.flatnonzero(space[: k - size])
        k = size + int(at[-1]) if len(at) else size
    inside = space[: k - size]
    if not len(inside):
        return 0, 0
    # a word counts where its first byte is; to the left that is the last one met
    before = np.append(inside[1:], True) if side == 0 else np.append(_SPACE[own[size - 1]], inside[:-1])
    return k - size, int((~inside & before).sum())


def _extended(keyed: DataFrame, ends: DataFrame) -> DataFrame:
    """What agrees beyond each end (``g``: bytes, words), compared in rounds of wider contexts; each row of ``ends`` once."""
    context, done = CONTEXT, []
    while True:
        few = ends.limit(FEW_ENDS + 1).count()
        if done and not few:
            return reduce(DataFrame.unionAll, done)
        asked = ends.select("_row", "s", "e", "side").union(ends.select("m_row", "m_s", "m_e", "side")).distinct().groupBy("_row").agg(F.collect_list(F.struct("s", "e", "side")).alias("asked"))
        asked = F.broadcast(asked) if few <= FEW_ENDS else asked
        told = cut_clean(keyed.select("_row", "text").join(asked, "_row").mapInArrow(_contexts(context), _PIECE).dropDuplicates(["_row", "s", "e", "side"]))

        @F.pandas_udf("bytes int, words int")
        def grown(own: pd.Series, other: pd.Series, size: pd.Series, side: pd.Series) -> pd.DataFrame:
            got = [agreement(*x) for x in zip(own, other, size, side, strict=True)]
            return pd.DataFrame({"bytes": [g[0] for g in got], "words": [g[1] for g in got]})

        mates = told.select(F.col("_row").alias("m_row"), F.col("s").alias("m_s"), F.col("e").alias("m_e"), "side", F.col("piece").alias("m_piece"))
        both = ends.join(told, ["_row", "s", "e", "side"]).join(mates, ["m_row", "m_s", "m_e", "side"])
        # equal pieces that are as long as a round's can be may go on
        on = (F.octet_length("piece") == F.col("e") - F.col("s") + F.lit(context)) & (F.col("piece") == F.col("m_piece"))
        both = cut_clean(both.select(*ends.columns, grown("piece", "m_piece", F.col("e") - F.col("s"), "side").alias("g"), on.alias("on")))
        done.append(both.where("not on").select("_row", "island", "side", (F.col("m_id") < F.col("_id")).alias("later"), "g"))
        ends = both.where("on").drop("g", "on")
        context *= WIDER


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of at least ``min_words`` words that also occur in another document.

    One row per passage: ``_row`` (hash of id and text), ``first_byte``, ``end_byte``,
    ``words``, ``first_id`` (smallest id of any document that holds one of its chunks),
    ``later`` (stretches of it that a document of a smaller id holds: what can go).
    """
    keyed = _keyed(docs, id_col, text_col)
    seen = keyed.mapInArrow(_chunker(False), "h long, _row long, _id long")
    holder = F.struct("_id", "_row")
    shared = cut_clean(seen.groupBy("h").agg(F.min(holder).alias("a"), F.max(holder).alias("b")).where("a._row <> b._row"))
    bit_map = docs.sparkSession.sparkContext.broadcast(_bit_map(shared))
    chunks = keyed.mapInArrow(_chunker(True, bit_map), "h long, _row long, _id long, s int, e int, w int, x int, p long")
    mate = F.when(F.col("a._row") == F.col("_row"), F.col("b")).otherwise(F.col("a"))
    marked = cut_clean(chunks.join(shared, "h").select("h", "_row", "_id", "s", "e", "w", "x", F.xxhash64("h", "p").alias("p"), F.col("a._id").alias("first_id"), mate.alias("mate"), F.col("_row").isin(F.col("a._row"), F.col("b._row")).alias("asked_of")).distinct())
    order = Window.partitionBy("_row").orderBy("s")
    # neighbours that another document holds in a row, too, have a joint
    pair = F.when(F.lag("e").over(order) == F.col("s"), F.xxhash64(F.lag("h").over(order), "h"))
    beside = marked.select("_row", "s", pair.alias("pair")).where("pair is not null")
    joints = beside.groupBy("pair").agg(F.min("_row").alias("lo"), F.max("_row").alias("hi")).where("lo <> hi").select("pair")
    # narrow rows alone are dealt by pair; a mark before a chunk says that it belongs to the one before it
    marks = beside.join(joints, "pair", "left_semi").select("_row", "s", F.lit(0).alias("kind"))
    lined = marked.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("_row").orderBy("s", "kind")
    joined = F.coalesce((F.lag("kind").over(order) == 0) & (F.lag("s").over(order) == F.col("s")), F.lit(False))
    runs = lined.withColumn("new", ((F.col("kind") == 1) & ~joined).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("kind = 1")
    edge = F.struct("s", "e", "h", "mate")
    islands = cut_clean(
        runs.groupBy("_row", "_id", "island")
        .agg(F.min(edge).alias("left"), F.max(edge).alias("right"), F.sum("w").cast("int").alias("w"), F.min(F.struct("s", "p")).alias("p"), (F.sum("w") + F.max_by("x", "s") + (BEFORE + 1) // 2).alias("most"), F.min("first_id").alias("first_id"), F.sort_array(F.collect_list(F.struct("s", "e", (F.col("first_id") < F.col("_id")).alias("later")))).alias("pieces"))
    )
    # what agrees to the right ends within the next chunk; fewer words than asked for, unless a document that holds the first chunk agrees before it
    before = marked.groupBy("p").agg(F.min("_row").alias("lo"), F.max("_row").alias("hi")).where("lo <> hi").select("p")
    islands = cut_clean(islands.where(F.col("most") >= min_words).drop("p", "most").unionByName(islands.where(F.col("most") < min_words).withColumn("p", F.col("p.p")).join(before, "p", "left_semi").drop("p", "most")))
    # both ends with the same chunk of another document
    ends = islands.select("_row", "_id", "island", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("x")), F.struct(F.lit(1).alias("side"), F.col("right").alias("x")))).alias("y")).select("_row", "_id", "island", "y.side", "y.x.s", "y.x.e", "y.x.h", F.col("y.x.mate._row").alias("m_row"), F.col("y.x.mate._id").alias("m_id"))
    places = marked.where("asked_of").groupBy("h", F.col("_row").alias("m_row")).agg(F.min("s").alias("m_s"))
    ends = cut_clean(ends.join(places, ["h", "m_row"]).withColumn("m_e", F.col("m_s") + F.col("e") - F.col("s")))
    both = _extended(keyed, ends)
    on = lambda side, what: F.max(F.when(F.col("side") == side, what))
    per = both.where("g.bytes >= 0").groupBy("_row", "island").agg(*[on(side, what).alias(f"{name}{side}") for side in (0, 1) for name, what in (("n", F.col("g.bytes")), ("w", F.col("g.words")), ("later", F.col("later")))])
    none = F.lit(0)
    out = islands.join(per, ["_row", "island"]).select(
        "_row", "first_id", "pieces",
        (F.col("left.s") - F.coalesce("n0", none)).alias("first_byte"), (F.col("right.e") + F.coalesce("n1", none)).alias("end_byte"),
        (F.col("w") + F.coalesce("w0", none) + F.coalesce("w1", none)).alias("words"),
        F.array(F.struct((F.col("left.s") - F.coalesce("n0", none)).alias("s"), F.col("left.s").alias("e"), F.coalesce("later0", F.lit(False)).alias("later")), F.struct(F.col("right.e").alias("s"), (F.col("right.e") + F.coalesce("n1", none)).alias("e"), F.coalesce("later1", F.lit(False)).alias("later"))).alias("more"),
    )
    later = F.sort_array(F.transform(F.filter(F.concat("pieces", "more"), lambda x: x["later"] & (x["e"] > x["s"])), lambda x: F.struct(x["s"].alias("first_byte"), x["e"].alias("end_byte"))))
    return out.where(F.col("words") >= min_words).select("_row", "first_byte", "end_byte", "words", F.nullif(F.col("first_id"), F.lit(_LAST)).alias("first_id"), later.alias("later"))


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_passages``, ``repeated_words``, ``repeated_bytes``, ``passages``, ``repeats``.

    ``passages`` lists (first_byte, end_byte, words, first_id) in order; ``repeats`` is
    true if there is one. Null and empty texts have none; repeated rows are the same
    document and do not repeat each other; null ids are last in order; an empty table
    gives no rows; other columns are ignored.
    """
    per = (
        repeated_passages(docs, id_col, text_col, min_words)
        .groupBy("_row")
        .agg(
            F.count(F.lit(1)).alias("n_passages"),
            F.sum("words").alias("repeated_words"),
            F.sum(F.col("end_byte") - F.col("first_byte")).alias("repeated_bytes"),
            F.sort_array(F.collect_list(F.struct("first_byte", "end_byte", "words", "first_id"))).alias("passages"),
        )
    )
    base = docs.select(F.col(id_col), F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col)).alias("_row"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n_bytes"))
    zero = F.lit(0).cast("long")
    return base.join(per, "_row", "left").select(
        id_col,
        "n_bytes",
        F.coalesce("n_passages", zero).alias("n_passages"),
        F.coalesce("repeated_words", zero).alias("repeated_words"),
        F.coalesce("repeated_bytes", zero).alias("repeated_bytes"),
        F.coalesce("passages", F.array().cast("array<struct<first_byte:int,end_byte:int,words:int,first_id:bigint>>")).alias("passages"),
        F.col("n_passages").isNotNull().alias("repeats"),
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without what a document of a smaller id holds of their repeated passages; all columns stay, whatever their names.

    Null and empty texts stay as they are; repeated rows are cut alike; documents of one
    id do not cut each other; null ids are last in order; an empty table gives no rows. A
    cut never parts a character: its ends move into the cut, to where characters start.
    """
    key, cuts = free_name(docs, "_row"), free_name(docs, "_cuts")
    spans = repeated_passages(docs, id_col, text_col, min_words).groupBy("_row").agg(F.sort_array(F.flatten(F.collect_list("later"))).alias(cuts)).where(F.size(cuts) > 0).withColumnRenamed("_row", key)

    @F.pandas_udf("string")
    def without(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, found, strict=True):
            if spans is None or text is None:
                out.append(text)
                continue
            raw, at, kept = text.encode(), 0, []
            inner = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80  # noqa: E731, B023  within a character
            joined: list[list[int]] = []
            for x in spans:
                if joined and x["first_byte"] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], x["end_byte"])
                else:
                    joined.append([x["first_byte"], x["end_byte"]])
            for s, e in joined:
                while inner(s):
                    s += 1
                while inner(e):
                    e -= 1
                if s < e:
                    kept.append(raw[at:s])
                    at = e
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    marked = docs.withColumn(key, F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col)))
    joined = marked.join(spans, key, "left")
    return joined.withColumn(text_col, without(F.col(text_col), F.col(cuts))).select(*[F.col(f"`{c}`") for c in docs.columns])
