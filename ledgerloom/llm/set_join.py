"""All pairs of texts whose sets of word shingles have at least a given Jaccard similarity.

Exact but for 64-bit hashes and bounds that chance breaks for under one pair in 10^8: a
set's shingles are ordered by hash, and of two sets of similarity t each has a common
shingle among its first n - ceil(t * n) + 1 (prefix filter). Sets that share such a shingle
meet in a bucket; there a pair goes only if the sizes rule it out, or the parities of both
sets' shingles over ``_BINS`` bins, which differ in at most as many bins as the sets in
shingles. Of a long set the parities are those of a share of its shingles, chosen by hash,
and differ in more bins than that share of the most shingles that may differ only by far
more than chance. What is left goes on to parities over four bins a shingle; those that agree or differ well beyond what chance can explain
settle a pair. The rest is compared shingle by shingle.

Groups need links that connect them, not all pairs: a first round compares neighbours in
an order that differs by bucket, a second one all pairs that the first has not connected. Buckets over ``block``
rows are cut into parts that meet pairwise in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

SEED = 42
_BINS = 512
#: Sets up to this size have parities of all of their shingles in the buckets, larger ones of half, a quarter and so on.
_SPARSE = 512
#: Sets of more shingles are compared by wide parities before their texts travel.
_LONG = 128
_MEMO = 100_000
#: Rows of a bucket that stand in one order in the first round; their number costs nothing but neighbours.
_NEIGHBOURS = 1024
BROADCAST_NODES = 500_000
_ROUNDING = 1e-9


def shingle_set(text: bytes | None, words: int, memo: dict) -> np.ndarray:
    """Sorted hashes of the different word shingles; fewer words than a shingle: one of them all."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(memo) > _MEMO:
        memo.clear()
    for x in set(w).difference(memo):
        memo[x] = xxhash.xxh64_intdigest(x, SEED)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    k = min(words, len(w))
    z = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        z = z * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(z)]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(z ^ (z >> np.uint64(31)))


def prefix_length(n: int, similarity: float) -> int:
    """So many first shingles of a set of n hold one of any set of at least that similarity."""
    return n - int(np.ceil(similarity * n - _ROUNDING)) + 1


def set_sketch(text: Column, words: int, similarity: float) -> Column:
    """``node`` (hash of the set; null: no words), ``n``, ``bits`` (parities) and ``prefix`` of a text."""

    @F.pandas_udf("node long, n int, bits binary, prefix array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        memo: dict = {}
        out = []
        for t in texts:
            s = shingle_set(t, words, memo)
            if not len(s):
                out.append((None, 0, None, None))
                continue
            node = int.from_bytes(xxhash.xxh64_digest(s.tobytes(), SEED), "little", signed=True)
            out.append((node, len(s), sparse_parities(s), s[: prefix_length(len(s), similarity)].view(np.int64).copy()))
        return pd.DataFrame({"node": pd.array([x[0] for x in out], dtype="Int64"), "n": [x[1] for x in out], "bits": [x[2] for x in out], "prefix": [x[3] for x in out]})

    return run(text.cast("binary"))


def parities(s: np.ndarray, bins: int) -> bytes:
    """Whether an odd number of a set's shingles falls into each bin."""
    return np.packbits((np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8), bitorder="little").tobytes()


def level(n):
    """Halvings after which a set of n has at most ``_SPARSE`` shingles left."""
    return np.ceil(np.log2(np.maximum(n, _SPARSE) / _SPARSE)).astype(np.int64)


def sparse_parities(s: np.ndarray) -> bytes:
    """Parities of the share of a set that its level leaves, and of half that: sets of like sizes have a level in common."""
    k = int(level(len(s)))
    return b"".join(parities(s[(s >> np.uint64(20)) & np.uint64((1 << x) - 1) == 0], _BINS) for x in (k, k + 1))


def wide_bins(n: int) -> int:
    return 1 << max(4 * n - 1, _BINS).bit_length()


def settled(a: bytes, b: bytes, total: int, similarity: float) -> int:
    """1: alike, 0: not, -1: open, by two sets' parities; the wider one is folded, as bins that share their last bits fall together."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    off = int(np.bitwise_count(x ^ y).sum())
    if off > total * (1 - similarity) / (1 + similarity) + _ROUNDING:
        return 0
    return 1 if off <= surely_alike(total, similarity, 8 * len(x)) else -1


def surely_alike(total, similarity: float, bins: int = _BINS):
    """Differing bins up to which sets of ``total`` shingles together are taken to reach the similarity.

    Sets that just miss it differ in d = total * (1 - t) / (1 + t) shingles. Pairs of
    these meet in a bin about Poisson-distributed, mean d^2 / (2 * bins), and each hides two.
    """
    d = total * (1 - similarity) / (1 + similarity)
    met = d * d / (2 * bins)
    return d - 2 * (met + 6.5 * np.sqrt(met) + 6)


def _pairs(similarity: float, neighbours: bool):
    """A function of batches sorted by (h, block) that yields candidate pairs (a, b, sure) within each (h, block)."""
    apart = (1 - similarity) / (1 + similarity)

    def compare(d: pd.DataFrame) -> pd.DataFrame:
        k = d[["h", "block"]].to_numpy(np.int64)
        key = np.concatenate(([0], np.cumsum((k[1:] != k[:-1]).any(axis=1))))
        node, comp, n, side = (d[c].to_numpy(np.int64) for c in ("node", "comp", "n", "side"))
        bits = np.frombuffer(b"".join(d["bits"]), dtype="<u8").reshape(len(d), 2, -1)
        own = level(n)
        found, held = [], 0
        s, i = 1, np.arange(len(key) - 1)
        while len(i):
            i = i[i + s < len(key)]
            # unless only neighbours are asked for, rows stand in order of size: once one is too large, so are all further ones
            i = i[(key[i] == key[i + s]) & (np.minimum(n[i], n[i + s]) >= similarity * np.maximum(n[i], n[i + s]) - _ROUNDING)]
            t = i[((side[i] != side[i + s]) | (side[i] == 0)) & (comp[i] != comp[i + s])]
            for at in range(0, len(t), 50_000):
                x = t[at : at + 50_000]
                both, at_level = n[x] + n[x + s], np.maximum(own[x], own[x + s])
                off = np.bitwise_count(bits[x, at_level - own[x]] ^ bits[x + s, at_level - own[x + s]]).sum(axis=1)
                most = apart * both / 2.0**at_level
                near = off <= np.where(at_level == 0, most + _ROUNDING, most + 6.5 * np.sqrt(most) + 6)
                x, sure = x[near], (off[near] <= surely_alike(both[near], similarity)) & (at_level[near] == 0)
                found.append(np.stack([np.minimum(node[x], node[x + s]), np.maximum(node[x], node[x + s]), sure], axis=1))
                held += len(x)
            if held > 1_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = 0
            if neighbours:
                break
            s += 1
        got = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1], "sure": got[:, 2] == 1})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for d in batches:
            if rest is not None:
                d = pd.concat([rest, d], ignore_index=True)
            if not len(d):
                continue
            k = d[["h", "block"]].to_numpy(np.int64)
            last = np.flatnonzero((k != k[-1]).any(axis=1))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            rest = d.iloc[cut_at:].reset_index(drop=True)
            if cut_at:
                yield compare(d.iloc[:cut_at])
        if rest is not None and len(rest):
            yield compare(rest)

    return run


def candidate_pairs(nodes: DataFrame, similarity: float, neighbours: bool, block: int) -> DataFrame:
    """Different pairs (a, b, sure) of ``nodes`` of different ``comp`` that may reach the similarity; with ``neighbours`` only those that are next to each other in an order of each bucket's own."""
    rows = nodes.select("node", "comp", "n", "bits", F.explode("shared").alias("x")).select("node", "comp", "n", "bits", "x.h", F.ceil(F.col("x.rows") * 2 / block).alias("parts"), (F.col("x.rows") <= block).alias("whole"))
    # each bucket is cut in a way of its own, so that what one parts another joins
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "h", "node"), F.col("parts")))
    own = F.struct((F.col("part") * F.col("parts") + F.col("part") + 1).alias("block"), F.lit(0).alias("side"))
    # part p meets every part q: within its own block all rows compare, elsewhere only across the two parts
    meets = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda q: F.struct((F.least(q, F.col("part")) * F.col("parts") + F.greatest(q, F.col("part")) + 1).alias("block"), F.when(q == F.col("part"), 0).when(F.col("part") < q, 1).otherwise(2).alias("side")),
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).alias("side")))
    blocks = F.when(F.col("whole"), whole).otherwise(F.array(own) if neighbours else meets)
    dealt = rows.select("node", "comp", "n", "bits", "h", F.explode(blocks).alias("y")).select("node", "comp", "n", "bits", "h", "y.block", "y.side")
    dealt = dealt.repartition("h", "block").sortWithinPartitions("h", "block", F.xxhash64("h", "node") if neighbours else F.col("n"), "node")
    return dealt.mapInPandas(_pairs(similarity, neighbours), "a long, b long, sure boolean").distinct()


def verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b, sure) whose shingle sets reach the similarity; ``texts`` gives ``node``, ``text`` of a table of nodes."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        memo: dict = {}
        out, was, p = [], None, None
        for s, t in zip(x, y, strict=True):
            if s != was:
                was, p = s, shingle_set(s, words, memo)
            q = shingle_set(t, words, memo)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= similarity * (len(p) + len(q) - both) - _ROUNDING)
        return pd.Series(out, dtype=bool)

    pairs = cut(pairs)
    open_ = pairs.where("not sure").select("a", "b")
    asked = open_.select(F.col("a").alias("node")).union(open_.select("b")).distinct()
    # texts of open pairs alone travel; their nodes are broadcast while they are few
    if asked.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        asked = F.broadcast(asked)

    @F.pandas_udf("n int, wide binary")
    def widened(texts: pd.Series) -> pd.DataFrame:
        memo: dict = {}
        sets = [shingle_set(t, words, memo) for t in texts]
        return pd.DataFrame({"n": [len(s) for s in sets], "wide": [parities(s, wide_bins(len(s))) if len(s) > _LONG else None for s in sets]})

    @F.pandas_udf("int")
    def judged(wa: pd.Series, wb: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None or y is None else settled(x, y, t, similarity) for x, y, t in zip(wa, wb, total, strict=True)], dtype="int32")

    told = cut(texts(asked).dropDuplicates(["node"]).select("node", "text", widened(F.col("text").cast("binary")).alias("w")))

    def side(name: str, *columns: str) -> DataFrame:
        return told.select(F.col("node").alias(name), *[F.col(c).alias(f"{c.split('.')[-1]}_{name}") for c in columns])

    # long texts travel only where their parities leave a pair open
    by_parity = open_.join(side("a", "w.n", "w.wide"), "a").join(side("b", "w.n", "w.wide"), "b").select("a", "b", judged("wide_a", "wide_b", F.col("n_a") + F.col("n_b")).alias("j"))
    by_parity = cut(by_parity.where("j <> 0"))
    by_text = by_parity.where("j = -1").select("a", "b").join(side("a", "text"), "a").join(side("b", "text"), "b").where(alike(F.col("text_a").cast("binary"), F.col("text_b").cast("binary"))).select("a", "b")
    return pairs.where("sure").select("a", "b").union(by_parity.where("j = 1").select("a", "b")).union(by_text)


def similar_components(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float, block: int = 3072) -> DataFrame:
    """``node``, ``component`` of every node that a chain of pairs of at least that similarity links to another.

    ``nodes``: the columns of ``set_sketch``, each node once; ``texts`` gives ``node``,
    ``text`` of a table of nodes, which may be marked for broadcast.
    """
    met = nodes.select("node", F.explode("prefix").alias("h")).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("rows > 1")
    shared = met.groupBy("node").agg(F.collect_list(F.struct("h", "rows")).alias("shared"))
    ready = cut(nodes.select("node", "n", "bits").join(shared, "node"))
    first = cut(verified(candidate_pairs(ready.withColumn("comp", F.col("node")), similarity, True, min(block, _NEIGHBOURS)), texts, words, similarity))
    comps = connected_components(first).select("node", F.col("component").alias("comp"))
    # of the buckets only those that hold different components are of use now
    joined = cut(ready.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    held = joined.select("node", "comp", F.explode("shared").alias("x")).select("node", "comp", "x.*")
    live = held.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
    shared = held.join(live, "h", "left_semi").groupBy("node").agg(F.collect_list(F.struct("h", "rows")).alias("shared"))
    left = cut(joined.drop("shared").join(shared, "node"))
    second = verified(candidate_pairs(left, similarity, False, block), texts, words, similarity)
    # the second round's links join whole components: they are few, and only their names change
    named = left.select("node", "comp")
    links = second.join(named.withColumnRenamed("node", "a").withColumnRenamed("comp", "x"), "a").join(named.withColumnRenamed("node", "b").withColumnRenamed("comp", "y"), "b").select("x", "y")
    merged = connected_components(links).select(F.col("node").alias("comp"), "component")
    # a node that only the second round links is a component of its own until then
    every = comps.unionByName(merged.join(comps.select("comp").distinct(), "comp", "left_anti").select(F.col("comp").alias("node"), "comp"))
    return every.join(merged, "comp", "left").select("node", F.coalesce("component", "comp").alias("component"))
