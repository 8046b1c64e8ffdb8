"""Quality by histogram gradient-boosted trees over document statistics.

Tasks turn whole texts into some thirty statistics of their characters, words and lines.
Trees are grown on at most ``MOST_LABELLED`` labelled documents of each class, chosen by a
hash of the id: features are cut into at most ``BINS`` bins by quantiles, each node's split
is the best of the histograms of gradients and hessians, a child's histogram is its
parent's less its sibling's. The trees are then flattened into arrays - feature, threshold,
left, right, value - which a batch of documents walks down together, level by level.
Scoring covers all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, small_batches

MOST_LABELLED = 20_000
FOLDS = 3
BINS = 64
TREES, DEPTH, RATE, L2, LEAST_ROWS = 80, 4, 0.15, 1.0, 8

#: Byte classes, by code; all other bytes belong to letters beyond ASCII.
_CLASS = np.full(256, 7, np.uint8)
for _k, _chars in enumerate((b" \t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"#$%&*|<>{}[]\\^~_=+@/")):
    _CLASS[list(_chars)] = _k
_LINE_END = re.compile(r"[.!?:;\"')\]]\s*$")
FEATURES = (
    "chars", "words", "lines", "space_share", "lower_share", "upper_share", "digit_share", "stop_share", "shout_share", "symbol_share", "other_share", "quote_share",
    "word_mean", "word_sd", "word_longest", "short_words", "long_words", "distinct_words", "top_word", "top_three_words", "repeated_pairs", "same_as_before", "shouted_words", "capital_words", "symbol_words", "bare_symbols", "digit_words",
    "line_mean", "distinct_lines", "ended_lines", "worst_line_repeats", "sentence_words", "entropy",
)


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of a text; null and empty texts have zeros."""
    t = text or ""
    if not t:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
    kind = np.bincount(_CLASS[raw], minlength=8) / len(raw)
    seen = np.bincount(raw, minlength=256)
    p = seen[seen > 0] / len(raw)
    words = t.split()
    n = max(len(words), 1)
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    count = Counter(words)
    top = [c for _, c in count.most_common(3)]
    lines = [x for x in t.split("\n") if x.strip()]
    m = max(len(lines), 1)
    sentences = sum(t.count(c) for c in ".!?")
    alone = sum(c for w, c in count.items() if not any(map(str.isalnum, w)))
    return [
        np.log1p(len(t)), np.log1p(len(words)), np.log1p(len(lines)), kind[0], kind[1], kind[2], kind[3], kind[4], kind[5], kind[6], kind[7], (seen[34] + seen[39] + seen[40] + seen[41]) / len(raw),
        size.mean(), size.std(), np.log1p(size.max()), (size <= 2).mean(), (size >= 12).mean(), len(count) / n, (top[0] if top else 0) / n, sum(top) / n, 1 - len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1) if n > 1 else 0.0, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(c for w, c in count.items() if len(w) > 1 and w.isupper()) / n, sum(c for w, c in count.items() if w[0].isupper()) / n, sum(c for w, c in count.items() if w[-1] in "#$%&*|!" and len(w) > 1) / n, alone / n, sum(c for w, c in count.items() if any(map(str.isdigit, w))) / n,
        np.log1p(len(t) / m), len(set(lines)) / m, sum(bool(_LINE_END.search(x[-8:])) for x in lines) / m, Counter(lines).most_common(1)[0][1] / m if lines else 0.0, np.log1p(len(words) / (sentences + 1)), float(-(p * np.log2(p)).sum()),
    ]


# ------------------------------------------------------------------ growing trees


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Upper edges of each feature's bins: halfway between neighbouring quantiles of its different values."""
    out = []
    for c in x.T:
        v = np.unique(c)
        v = v if len(v) <= BINS else np.unique(np.quantile(c, np.linspace(0, 1, BINS), method="nearest"))
        out.append((v[:-1] + v[1:]) / 2)
    return out


def _histogram(binned: np.ndarray, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Sums of gradients, hessians and rows by (feature, bin)."""
    f = binned.shape[1]
    at = (binned[rows].astype(np.int64) + np.arange(f) * BINS).ravel()
    each = lambda w: np.bincount(at, weights=w, minlength=f * BINS).reshape(f, BINS)
    return np.stack([each(np.repeat(grad[rows], f)), each(np.repeat(hess[rows], f)), each(None)])


def _best_split(h: np.ndarray) -> tuple[float, int, int]:
    """Gain, feature and last bin of the left side of the best split of a histogram."""
    left = h.cumsum(axis=2)
    total = left[:, :, -1:]
    right = total - left
    gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - total[0] ** 2 / (total[1] + L2)
    gain = np.where((left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS), gain, -np.inf)
    best = int(gain.argmax())
    return float(gain.ravel()[best]), best // BINS, best % BINS


def _grow(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray]) -> tuple[list[list[float]], np.ndarray]:
    """Nodes ``[feature, threshold, left, right, value]`` (leaves point at themselves) and each row's value."""
    nodes: list[list[float]] = []
    value = np.zeros(len(grad))

    def add(rows: np.ndarray) -> int:
        v = -RATE * grad[rows].sum() / (hess[rows].sum() + L2)
        nodes.append([0, np.inf, len(nodes), len(nodes), v])
        value[rows] = v
        return len(nodes) - 1

    every = np.arange(len(grad))
    level = [(add(every), every, _histogram(binned, every, grad, hess))]
    for _ in range(DEPTH):
        below = []
        for at, rows, h in level:
            gain, f, b = _best_split(h)
            if gain <= 1e-6:
                continue
            left = binned[rows, f] <= b
            lo, hi = rows[left], rows[~left]
            few = _histogram(binned, min(lo, hi, key=len), grad, hess)
            many = h - few
            i, j = add(lo), add(hi)
            nodes[at][:4] = [f, edges[f][b], i, j]
            below += [(i, lo, few if len(lo) <= len(hi) else many), (j, hi, many if len(lo) <= len(hi) else few)]
        level = below
    return nodes, value


def grow(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees on features and labels (0, 1) as flat arrays; ``root`` holds each tree's first node."""
    edges = bin_edges(x)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    z, flat, root = np.full(len(y), base), [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        nodes, value = _grow(binned, p - y, np.maximum(p * (1 - p), 1e-6), edges)
        root.append(len(flat))
        flat += [[f, t, a + root[-1], b + root[-1], v] for f, t, a, b, v in nodes]
        z += value
    a = np.array(flat, np.float64)
    return {"base": base, "root": np.array(root), "feature": a[:, 0].astype(np.int64), "threshold": a[:, 1], "left": a[:, 2].astype(np.int64), "right": a[:, 3].astype(np.int64), "value": a[:, 4]}


def predict(x: np.ndarray, trees: dict) -> np.ndarray:
    """Probability of class 1: all rows walk down all trees together."""
    rows = np.arange(len(x))[:, None]
    at = np.broadcast_to(trees["root"], (len(x), len(trees["root"])))
    for _ in range(DEPTH):
        at = np.where(x[rows, trees["feature"][at]] <= trees["threshold"][at], trees["left"][at], trees["right"][at])
    z = trees["base"] + trees["value"][at].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# ------------------------------------------------------------------ over tables


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> dict:
    """Fit on (doc_id, text) and (doc_id, quality); an id with conflicting labels counts as low quality, null labels not at all."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("y"))
    order = F.xxhash64(F.lit(23), "doc_id")
    chosen = known.where("y = 1").orderBy(order, "doc_id").limit(most).unionByName(known.where("y = 0").orderBy(order, "doc_id").limit(most))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"h": d["h"], "y": d["y"], "x": [statistics(t) for t in d["text"]]})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("text").alias("h"), "y", "text")  # at most 2 * most ids
    with small_batches(docs.sparkSession):
        got = rows.mapInPandas(features, "h long, y int, x array<double>").toPandas()  # at most 2 * most rows of statistics, and copies of an id's
    got = got.sort_values(["h", "y"], kind="stable").drop_duplicates("h")  # copies of a text are one piece of evidence
    y = got["y"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        only = 4.0 if not len(y) or y[0] == 1 else -4.0
        return {"base": only, "root": np.zeros(1, np.int64), "feature": np.zeros(1, np.int64), "threshold": np.full(1, np.inf), "left": np.zeros(1, np.int64), "right": np.zeros(1, np.int64), "value": np.zeros(1)}
    return grow(np.stack(list(got["x"])).astype(np.float64), y)


def score(text: Column, trees: dict) -> Column:
    """Score in 0 to 1 of a text column; null counts as empty."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES)), trees))

    return run(text)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, ``held_out``, ``score``, ``predicted`` of every document.

    Labels of ids whose crc32 leaves 1 when divided by three are held out. Null and empty
    texts have the score of a text whose statistics are all zero; repeated rows each return;
    without labels of both classes all documents have one score (0.98 where no label is
    known); an empty table gives no rows. Other columns play no part.
    """
    held = crc32_mod(F.col("doc_id"), FOLDS) == 1
    trees = fit(docs, labels.where(~held), most)
    out = docs.select("doc_id", held.alias("held_out"), score(F.col("text"), trees).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, least: float = 0.5) -> DataFrame:
    """Documents with a score of ``least`` or more, with all their columns, whatever their names; edge cases as in ``quality_scores``."""
    trees = fit(docs, labels.where(crc32_mod(F.col("doc_id"), FOLDS) != 1), most)
    return docs.where(score(F.col("text"), trees) >= least)
