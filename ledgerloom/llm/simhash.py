"""SimHash near-duplicates through pivot distance tables.

A fingerprint's table row holds its Hamming distances to many references: a base
fingerprint, the base with one segment of bits flipped (a reference per segment),
and random ones. Flipping a segment changes the distance by an amount that depends
on the bits of that segment alone, so two fingerprints that differ in k bits agree
on the distance differences of all but k segments. Segments are dealt into groups;
for each choice of groups that leaves k out, rows that share those differences meet
in a bucket. Within a bucket pairs are discarded when any coordinate of their tables
differs by more than k, and the survivors verified on the bits. Nothing is missed,
whatever the number of groups; it only sets the size of buckets.

Exact copies collapse to one fingerprint before that. Buckets over ``block`` rows are
cut into blocks that meet pairwise in tasks of their own. A bucket yields the links
that connect its members, not all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, small_batches
from .components import connected_components
from .set_join import BROADCAST_NODES, set_sketch, similar_components

SEED = 42
_SEGMENT_BITS = 2
_COORDINATES = 12


def _references() -> tuple[np.ndarray, np.ndarray]:
    """Base and flipped references; random references of the coordinate filter."""
    rng = np.random.default_rng(20240229)
    base = int(rng.integers(0, 2**63))
    mask = (1 << _SEGMENT_BITS) - 1
    flipped = [base ^ (mask << i) for i in range(0, 64, _SEGMENT_BITS)]
    return np.array([base, *flipped], dtype=np.uint64), rng.integers(0, 2**63, _COORDINATES).astype(np.uint64) << np.uint64(1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# ------------------------------------------------------------------ fingerprints


def sketch_bytes(text: bytes | None, words: int, distinct: bool, lanes: int) -> bytes:
    """SimHash of a text's word shingles, 64 bits a lane, little-endian.

    Fewer words than a shingle: one shingle of them all; none: zero. ``distinct``
    counts each different shingle once.
    """
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return bytes(8 * lanes)
    s = b" ".join(w)
    if len(w) <= words:
        parts = [s]
    else:
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        parts = [s[a:b] for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    if distinct:
        parts = list(set(parts))
    digest, n, total = xxhash.xxh64_intdigest, len(parts), np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter((digest(x, SEED) for x in parts[at : at + 65536]), dtype=np.uint64)
        for lane in range(lanes):
            if lane:  # further lanes: the hash mixed again
                z = h + np.uint64(0x9E3779B97F4A7C15 * lane & 0xFFFFFFFFFFFFFFFF)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(31)
            else:
                z = h
            total[64 * lane : 64 * lane + 64] += np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n, bitorder="little").tobytes()


def _sketch(words: int, distinct: bool, lanes: int):
    if lanes == 1:

        @F.pandas_udf("long")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(np.frombuffer(b"".join(sketch_bytes(t, words, distinct, 1) for t in texts), dtype="<i8"))
    else:

        @F.pandas_udf("binary")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([sketch_bytes(t, words, distinct, lanes) for t in texts], dtype=object)

    return run


def simhash(text: Column, words: int = 3, distinct: bool = False) -> Column:
    """64-bit SimHash of a text column as a long."""
    return _sketch(words, distinct, 1)(text.cast("binary"))


def wide_simhash(text: Column, words: int = 5, lanes: int = 4) -> Column:
    """SimHash of ``64 * lanes`` bits as binary."""
    return _sketch(words, False, lanes)(text.cast("binary"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ------------------------------------------------------------------ the pivot index


def with_pivot_keys(nodes: DataFrame, max_bits: int, groups: int) -> DataFrame:
    """``nodes`` (with ``fp``) once for each bucket ``key``: a choice of ``groups - max_bits`` groups and the distance differences of their segments."""
    if groups <= max_bits:
        raise ValueError("groups must exceed max_bits")
    refs = [F.lit(_signed(int(x))) for x in _references()[0]]
    dealt = np.array_split(np.arange(len(refs) - 1), groups)

    def code(g: np.ndarray) -> Column:
        return sum(((F.bit_count(F.col("fp").bitwiseXOR(refs[j + 1])) - F.col("_base") + _SEGMENT_BITS) * F.lit((2 * _SEGMENT_BITS + 1) ** i) for i, j in enumerate(g.tolist())), F.lit(0).cast("long"))

    # a step of its own for each level, so that distances and codes are computed once
    base = nodes.withColumn("_base", F.bit_count(F.col("fp").bitwiseXOR(refs[0])))
    coded = base.withColumn("_codes", F.array(*[code(g) for g in dealt]))
    chosen = F.array(*[F.array(F.lit(k), *map(F.lit, c)) for k, c in enumerate(itertools.combinations(range(groups), groups - max_bits))])
    keys = F.transform(chosen, lambda c: F.xxhash64(F.get(c, 0), *[F.get("_codes", F.get(c, i + 1)) for i in range(groups - max_bits)]))
    return coded.select(*nodes.columns, F.explode(keys).alias("key"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest of its component, for pairs of nodes."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        m, was = np.minimum(low[x], low[y]), low.copy()
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        low = low[low]
        if (low == was).all():
            break
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def _linker(max_bits: int, wide_bits: int | None):
    """A function of key-sorted batches that yields links (a, b) within each key."""
    coordinates = _references()[1]

    def compare(key: np.ndarray, side: np.ndarray, fp: np.ndarray, wide: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        table = np.bitwise_count(fp[:, None] ^ coordinates[None, :]).astype(np.int8)
        a, b, held = [], [], 0
        s, i = 1, np.arange(len(key) - 1)
        while len(i):
            i = i[i + s < len(key)]
            i = i[key[i] == key[i + s]]  # a key's rows stand together: once two rows are apart, so are all further ones
            t = i[(side[i] != side[i + s]) | (side[i] == 0)]
            for c in range(_COORDINATES):
                if not len(t):
                    break
                t = t[np.abs(table[t, c] - table[t + s, c]) <= max_bits]
            t = t[np.bitwise_count(fp[t] ^ fp[t + s]) <= max_bits]
            if wide is not None and len(t):
                t = t[np.bitwise_count(wide[t] ^ wide[t + s]).sum(axis=1) <= wide_bits]
            a.append(fp[t].view(np.int64) if wide is None else t)
            b.append(fp[t + s].view(np.int64) if wide is None else t + s)
            held += len(t)
            if held > 2_000_000:
                x, y = _forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x)
            s += 1
        return _forest(np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def links(d: pd.DataFrame) -> pd.DataFrame:
            fp = d["fp"].to_numpy(np.int64).view(np.uint64)
            wide = np.frombuffer(b"".join(d["wide"]), dtype="<u8").reshape(len(d), -1) if wide_bits is not None else None
            x, y = compare(d["key"].to_numpy(np.int64), d["side"].to_numpy(np.int8), fp, wide)
            if wide is not None:
                node = d["node"].to_numpy(np.int64)
                x, y = node[x], node[y]
            return pd.DataFrame({"a": x, "b": y})

        for d in batches:
            if rest is not None:
                d = pd.concat([rest, d], ignore_index=True)
            if not len(d):
                continue
            k = d[["key", "block"]].to_numpy(np.int64)
            last = np.flatnonzero((k != k[-1]).any(axis=1))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            rest = d.iloc[cut_at:].reset_index(drop=True)
            if cut_at:
                yield from by_block(d.iloc[:cut_at], links)
        if rest is not None and len(rest):
            yield from by_block(rest, links)

    def by_block(d: pd.DataFrame, links) -> Iterator[pd.DataFrame]:
        # rows of one key and block stand together; give each such run a key of its own
        k = d[["key", "block"]].to_numpy(np.int64)
        d = d.assign(key=np.concatenate(([0], np.cumsum((k[1:] != k[:-1]).any(axis=1)))))
        out = links(d.reset_index(drop=True))
        if len(out):
            yield out

    return run


def bucket_links(nodes: DataFrame, max_bits: int, groups: int, wide_bits: int | None = None, block: int = 4096) -> DataFrame:
    """Links (a, b) that connect all rows whose fingerprints differ in at most ``max_bits`` bits.

    ``nodes``: ``fp`` long, distinct; with ``wide_bits`` also ``node`` long and ``wide``
    binary, and then links join nodes whose wide sketches also differ in at most that
    many bits. Buckets over ``block`` rows are cut by a hash into parts of about half
    that; each pair of parts is a block of its own, so no task holds a whole hot bucket.
    """
    keep = ["fp"] + (["node", "wide"] if wide_bits is not None else [])
    own = F.col("fp") if wide_bits is None else F.col("node")
    # dealt out anew: the nodes are few bytes and would otherwise make few, slow tasks
    spread = cut(nodes.select(*keep).repartition(max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)))
    keyed = with_pivot_keys(spread, max_bits, groups)
    hot = cut(with_pivot_keys(spread.select("fp"), max_bits, groups).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    if hot.isEmpty():
        ready = keyed.select(*keep, "key", F.lit(0).alias("block"), F.lit(0).alias("side"))
    else:
        salts = 16
        part = F.pmod(F.xxhash64(F.lit(7), own), F.col("parts"))
        hot = hot.select("key", F.ceil(F.col("n") * 2 / block).alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64(F.lit(11), own), F.lit(salts)).cast("int")).join(hot, ["key", "salt"], "left").withColumn("part", part)
        # part p meets every part q: block lo * parts + hi; within its own block all rows compare, elsewhere only across the two parts
        blocks = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).alias("side")))).otherwise(
            F.transform(
                F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
                lambda q: F.struct((F.least(q, F.col("part")) * F.col("parts") + F.greatest(q, F.col("part")) + 1).alias("block"), F.when(q == F.col("part"), 0).when(F.col("part") < q, 1).otherwise(2).alias("side")),
            )
        )
        ready = joined.select(*keep, "key", F.explode(blocks).alias("x")).select(*keep, "key", "x.block", "x.side")
    dealt = ready.repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInPandas(_linker(max_bits, wide_bits), "a long, b long")


# ------------------------------------------------------------------ operators


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, groups: int = 6, block: int = 4096) -> DataFrame:
    """One row per document: id, ``fingerprint`` (hex), ``component_id``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id reachable. Null and empty texts have the zero
    fingerprint and link like others; null ids never name a component unless all its
    ids are null; repeated rows each return; an empty table returns no rows; other
    columns are ignored.
    """
    fps = cut(docs.select(F.col(id_col).alias("_id"), simhash(F.col(text_col), words).alias("fp")))
    distinct = fps.groupBy("fp").agg(F.min("_id").alias("low"))
    comps = connected_components(bucket_links(distinct.select("fp"), max_bits, groups, block=block))
    member = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    named = member.join(member.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("_id").alias(id_col), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def near_duplicate_roots(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = 3072) -> DataFrame:
    """``_row`` (hash of id and text) and ``root`` of every document that has words.

    Documents link when their sets of shingles of ``words`` words have a Jaccard
    similarity of at least ``similarity``; a group is what such links connect.
    """
    row = F.xxhash64(F.lit(3), "doc_id", "text").alias("_row")
    # texts without words are alike only in having none
    sketched = docs.select("doc_id", row, set_sketch(F.col("text"), words, similarity).alias("x")).where("x.node is not null").select("doc_id", "_row", "x.*")
    with small_batches(docs.sparkSession):
        seen = cut(sketched)
    nodes = cut(seen.groupBy("node").agg(F.min(F.struct("_row", "n", "bits", "prefix")).alias("x")).select("node", "x.*"))
    wanted = nodes.select("_row", "node")

    def texts(asked: DataFrame) -> DataFrame:
        rows = cut(wanted.join(asked, "node"))
        few = rows.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        return docs.select(row, "text").join(F.broadcast(rows) if few else rows, "_row").select("node", "text")

    comps = similar_components(nodes.drop("_row"), texts, words, similarity, block)
    return seen.select("doc_id", "_row", "node").join(comps, "node", "left").select("doc_id", "_row", "node", F.coalesce("component", "node").alias("root"))


def fingerprint_roots(docs: DataFrame, words: int = 3, max_bits: int = 2, groups: int = 6, block: int = 4096) -> DataFrame:
    """``doc_id``, ``_row`` (hash of id and text) and ``root`` of every document that has words; documents link by their fingerprints, as in ``simhash_classes``."""
    rows = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # texts without words are alike only in having none
    fps = cut(rows.select("doc_id", F.xxhash64(F.lit(3), "doc_id", "text").alias("_row"), simhash(F.col("text"), words).alias("fp")))
    comps = connected_components(bucket_links(fps.select("fp").distinct(), max_bits, groups, block=block)).withColumnRenamed("node", "fp")
    return fps.join(comps, "fp", "left").select("doc_id", "_row", F.coalesce("component", "fp").alias("root"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Documents without near-duplicates by the similarity of their shingles; see ``near_duplicate_roots`` and ``first_of_groups``."""
    return first_of_groups(docs, near_duplicate_roots(docs.select("doc_id", "text"), words, similarity))


def drop_similar_fingerprints(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """Documents without those whose fingerprints link them to an earlier one; see ``fingerprint_roots`` and ``first_of_groups``."""
    return first_of_groups(docs, fingerprint_roots(docs.select("doc_id", "text"), words, max_bits))


def first_of_groups(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each group of documents the one with the smallest (doc_id, text hash) stays.

    Null ids sort last; of rows that share id and text the one with the smallest hash of
    its columns stays; null and empty texts and others without words all stay; all columns
    come along, whatever their names; an empty table gives no rows.
    """
    roots = cut(roots)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")
    stays = roots.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row")).distinct()
    key = free_name(docs, "_row")
    goes = roots.select("_row").distinct().join(stays, "_row", "left_anti").withColumnRenamed("_row", key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(key, F.xxhash64(F.lit(3), "doc_id", "text"))
    left = marked.join(goes, key, "left_anti")
    # rows of one id and text: one stays, and only they can share a key
    repeated = cut(roots.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("_row").alias(key)))
    if repeated.isEmpty():
        return left.select(*columns)
    alone = left.join(repeated, key, "left_anti")
    first = left.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(free_name(docs, "_all")))
    return alone.select(*columns).unionByName(first.select(f"{free_name(docs, '_all')}.*"))
