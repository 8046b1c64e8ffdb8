"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors collapse to one first. Each of ``trees`` trees splits its node at the
median of a random projection; a band of ``spill`` of the node's vectors on either side
of the median goes both ways. Split values of a node come from a sample of at most
``sample`` of its vectors, drawn on the executors; every vector is routed. Leaves over
``block`` vectors are split again in further rounds until none is left or splitting no
longer helps; those left over ``block`` are cut into parts that meet pairwise in tasks
of their own. Within a leaf all pairs are compared in double precision. A pair that
shares several leaves counts in the one with the smallest code, which each side can tell
from its list of leaves, so links are counted without shipping pairs; each leaf sends
per vector its number of new links and one link towards its leaf's component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components
from .simhash import _forest

TREES, LEAF, BLOCK, SAMPLE, SPILL, DEPTH = 8, 512, 2048, 4096, 0.05, 7
#: Models that go to all tasks; each is at most 14 KB.
MODELS = 1000


def _mix(code: np.ndarray, path: np.ndarray) -> np.ndarray:
    z = code.astype(np.uint64) + (path.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.int64)


def _directions(code: int, depth: int, dim: int) -> np.ndarray:
    return np.random.default_rng(code & 0x7FFFFFFFFFFFFFFF).standard_normal((depth, dim))


def fit_node(code: int, x: np.ndarray, depth: int, spill: float) -> np.ndarray:
    """Bands (low, high) of the splits below a node: levels x paths x 2, paths in binary."""
    bands = np.zeros((depth, 1 << depth, 2))
    proj = x @ _directions(code, depth, x.shape[1]).T
    path = np.zeros(len(x), np.int64)
    for level in range(depth):
        for p in range(1 << level):
            v = proj[path == p, level]
            if len(v):
                bands[level, p] = np.quantile(v, [0.5 - spill, 0.5 + spill])
        mid = bands[level, path].mean(axis=1)
        path = 2 * path + (proj[:, level] > mid)
    return bands


def route(code: int, bands: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaf codes, a row once for each leaf that it falls into."""
    depth = len(bands)
    proj = x @ _directions(code, depth, x.shape[1]).T
    row, path = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level in range(depth):
        v, (low, high) = proj[row, level], bands[level, path].T
        left, right = v <= high, (v >= low) & (high > low) | (v > high)
        row, path = np.concatenate([row[left], row[right]]), np.concatenate([2 * path[left], 2 * path[right] + 1])
    return row, _mix(np.full(len(row), code), path)


def _fitter(spill: float, least: float | None):
    """A node's model from its sample: the depth, then the bands.

    With ``least``, none for a node in whose sample over a tenth of the pairs link: splits
    would only part links there, and the node is left to be cut into parts instead.
    """

    def run(d: pd.DataFrame) -> pd.DataFrame:
        c, depth = int(d["leaf"].iloc[0]), int(d["depth"].iloc[0])
        x = _unit(d["embedding"])
        if least is not None and len(x) and (x[:1024] @ x[:1024].T >= least).mean() > 0.1:
            return pd.DataFrame({"leaf": np.zeros(0, np.int64), "model": np.zeros(0, object)})
        bands = fit_node(c, x, depth, spill)
        return pd.DataFrame({"leaf": [c], "model": [np.concatenate(([float(depth)], bands.ravel())).tobytes()]})

    return run


def _route_node(code: int, model: bytes, embeddings: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(model)
    depth = int(raw[0])
    return route(code, raw[1:].reshape(depth, 1 << depth, 2), _unit(embeddings))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _router(models: dict[int, bytes]):
    """Replaces codes that have a model by the codes of the leaves below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if not len(d):
                continue
            owner = np.repeat(np.arange(len(d)), [len(c) for c in d["codes"]])
            code = np.concatenate(d["codes"].to_numpy()).astype(np.int64)
            rows, leaves = [], []
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            for at in np.split(order, cuts):
                c = int(code[at[0]])
                if c not in models:
                    rows.append(owner[at])
                    leaves.append(code[at])
                    continue
                r, leaf = _route_node(c, models[c], d["embedding"].iloc[owner[at]])
                rows.append(owner[at][r])
                leaves.append(leaf)
            row, leaf = np.concatenate(rows), np.concatenate(leaves)
            at = np.lexsort((leaf, row))
            yield d.assign(codes=list(np.split(leaf[at], np.cumsum(np.bincount(row, minlength=len(d)))[:-1])))

    return run


def _route_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (node, embedding, leaf, model) to the codes of their leaves below; a row without a model keeps its code."""
    for d in batches:
        for c, at in d.groupby("leaf", sort=False).indices.items():
            part = d.iloc[at]
            node, model = part["node"].to_numpy(np.int64), part["model"].iloc[0]
            if model is None:
                yield pd.DataFrame({"node": node, "code": np.full(len(node), c, np.int64)})
            else:
                r, leaf = _route_node(int(c), model, part["embedding"])
                yield pd.DataFrame({"node": node[r], "code": leaf})


def route_rows(rows: DataFrame, models: DataFrame, few: int = MODELS) -> DataFrame:
    """``rows`` with the codes that have a model replaced by those of the leaves below.

    At most ``few`` models, a few KB each, go to the tasks; more are joined to the
    vectors of their nodes.
    """
    if models.limit(few + 1).count() <= few:
        return rows.mapInPandas(_router({r["leaf"]: bytes(r["model"]) for r in models.collect()}), rows.schema)
    each = rows.select("node", "embedding", F.explode("codes").alias("leaf")).join(models, "leaf", "left")
    codes = each.mapInPandas(_route_joined, "node long, code long").groupBy("node").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return rows.drop("codes").join(codes, "node").select(*rows.columns)


def _compare(least: float):
    """New links per vector of a leaf, and a link towards the smallest vector of its component."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        node, side, leaf = d["node"].to_numpy(np.int64), d["side"].to_numpy(), int(d["leaf"].iloc[0])
        none = pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        x = _unit(d["embedding"])
        near = x @ x.T >= least
        near &= (side[:, None] != side[None, :]) | (side[:, None] == 0)
        np.fill_diagonal(near, False)
        if not near.any():
            return none
        # pairs that also meet in a leaf of a smaller code are counted there
        codes = [c[c < leaf] for c in d["codes"]]
        other, at = np.unique(np.concatenate(codes), return_inverse=True)
        if len(other):
            held = np.zeros((len(d), len(other)), np.float32)
            held[np.repeat(np.arange(len(d)), [len(c) for c in codes]), at] = 1
            near &= held @ held.T == 0
        i, j = np.nonzero(near)
        if not len(i):
            return none
        links = np.bincount(i, weights=d["copies"].to_numpy(np.float64)[j], minlength=len(d)).astype(np.int64)
        a, b = _forest(node[i], node[j])
        some = links > 0
        root = dict(zip(a.tolist(), b.tolist(), strict=True))
        return pd.DataFrame({"node": node[some], "links": links[some], "root": np.array([root.get(n, n) for n in node[some].tolist()], np.int64)})

    return run


def leaves(nodes: DataFrame, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, spill: float = SPILL, least: float = 0.95, few: int = MODELS) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (node, embedding, copies) with ``codes``, its leaves over all trees, and the sizes of the leaves."""
    dims = F.size("embedding")
    # trees of their own for each number of components
    rows = nodes.withColumn("codes", F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.xxhash64(t, dims)))
    tried = None
    for turn in itertools.count():
        sizes = cut(rows.select(F.explode("codes").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")))
        # a node is split once: its children have codes of their own, and one that was left whole stays whole
        big = sizes.where(F.col("n") > (leaf if turn == 0 else block))
        big = cut(big if tried is None else big.join(tried, "leaf", "left_anti"))
        if big.isEmpty():
            break
        depth = F.greatest(F.lit(1), F.least(F.lit(DEPTH), F.ceil(F.log2(F.col("n") / leaf)))).cast("int").alias("depth")
        drawn = rows.select("embedding", "node", F.explode("codes").alias("leaf")).join(big.select("leaf", (F.lit(float(sample)) / F.col("n")).alias("rate"), depth), "leaf")
        drawn = drawn.where(F.pmod(F.xxhash64(F.lit(5), "node", "leaf"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).select("embedding", "leaf", "depth")
        models = cut(drawn.groupBy("leaf").applyInPandas(_fitter(spill, None if turn == 0 else least), "leaf long, model binary"))
        tried = big.select("leaf") if tried is None else cut(tried.union(big.select("leaf")))
        if models.isEmpty():
            break
        rows = cut(route_rows(rows, models, few))
    return rows, sizes


def embedding_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, few: int = MODELS) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors link at a cosine of at least ``least``. Null vectors, zero vectors and those
    with null or non-finite components link with nothing; vectors of different lengths do
    not link; equal vectors link with each other; repeated rows count as vectors; null ids
    name a component only where all its ids are null; an empty table gives no rows.
    """
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    base = vectors.select(F.col(id_col).alias("_id"), F.when(fine, F.transform(v, lambda x: x + F.lit(0).cast("float"))).alias("embedding"))
    base = base.withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    nodes = cut(base.where("node is not null").groupBy("node").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")))
    rows, sizes = leaves(nodes.select("node", "embedding", "copies"), trees, leaf, block, sample, least=least, few=few)
    each = rows.select("node", "embedding", "copies", "codes", F.explode("codes").alias("leaf"))
    parts = sizes.where(F.col("n") > block).select("leaf", F.ceil(F.col("n") * 2 / block).alias("parts"))
    if parts.isEmpty():
        dealt = each.withColumn("block", F.lit(0).cast("long")).withColumn("side", F.lit(0))
    else:
        part = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts"))
        met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.struct((F.least(q, F.col("part")) * F.col("parts") + F.greatest(q, F.col("part")) + 1).alias("block"), F.when(q == F.col("part"), 0).when(F.col("part") < q, 1).otherwise(2).alias("side")))
        one = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).alias("side")))
        dealt = each.join(parts, "leaf", "left").withColumn("part", part).withColumn("x", F.explode(F.when(F.col("parts").isNull(), one).otherwise(met))).select("node", "embedding", "copies", "codes", "leaf", "x.block", "x.side")
    found = cut(dealt.groupBy("leaf", "block").applyInPandas(_compare(least), "node long, links long, root long"))
    comps = connected_components(found.select("node", "root"))
    member = nodes.select("node", "low", "copies").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = member.groupBy("component").agg(F.min("low").alias("component_id"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = member.join(low, "component").join(links, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = base.select("_id", "node").join(known, "node", "left")
    name = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.coalesce(F.col("_id") == name, F.lit(True)).alias("kept"))
