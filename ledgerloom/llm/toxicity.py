"""Toxicity by weak supervision.

Voters: lexicons of words and word beginnings that occur far more often in toxic
documents, dealt into several by kind; one for several finds, one that objects when no
lexicon finds anything; one for texts of which lexicon words make up a share, and one that
objects to a lesser share, as in long texts a word begins so by chance; patterns (shouting,
exclamation, symbol noise); and the human label. A generative model with a hidden class
gives each voter a probability of each vote under each class, by EM; voters whose residuals
correlate share their weight, which is estimated anew every few rounds. The human label
keeps its whole weight, and its accuracy has a prior. Posterior labels train a logistic
classifier over lexicon terms and votes, which scores texts.

Lexicons and classifier are fitted on at most ``MOST_LABELLED`` labelled documents of
each class, chosen by a hash of the id; their terms and votes have no cap of their own.
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

from .common import crc32_mod, cut

MOST_LABELLED = 10_000
SUPPORT = 3
RATIO = 6.0
#: Least n * KL(share of toxic documents among a term's, share overall): chance terms stay under it.
EVIDENCE = 10.0
PREFIXES = (4, 5, 6)
STRIPES = 3
FOLDS = 5
#: Prior accuracy of human labels, which counts as much as the labels themselves.
GOLD = 0.95
_MEMO = 100_000
_WORDS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *[f"{word[:k]}*" for k in PREFIXES if len(word) > k]]


def doc_terms(text: str | None) -> set:
    """Different terms of a text."""
    out: set = set()
    for w in set(_WORDS.findall((text or "").lower())):
        out.update(terms_of(w))
    return out


def known_terms(text: str | None, known: dict, memo: dict) -> tuple[list[int], float]:
    """Numbers of the known terms that a text holds, and the share of its words that have one."""
    count = Counter(_WORDS.findall((text or "").lower()))
    out: set = set()
    hits = 0
    for w, n in count.items():
        hit = memo.get(w)
        if hit is None:
            if len(memo) > _MEMO:
                memo.clear()
            hit = memo[w] = tuple(known[t] for t in terms_of(w) if t in known)
        if hit:
            out.update(hit)
            hits += n
    return sorted(out), hits / max(count.total(), 1)


def pattern_votes(text: str | None) -> list[int]:
    """Shouting, exclamation, symbol noise: 1 or 0 (abstains)."""
    t = text or ""
    n = max(len(t), 1)
    upper = sum(map(str.isupper, t[:1])) if n < 20 else len(re.findall(r"[A-ZÀ-Þ]", t))
    return [int(upper > 0.5 * n), int(t.count("!") > 0.02 * n), int(len(re.findall(r"[#$%&*]", t)) > 0.1 * n)]


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        c: Counter = Counter()
        for t in d["text"]:
            c.update(doc_terms(t))
        yield pd.DataFrame({"term": [str(k) for k in c], "n": np.fromiter(c.values(), np.int64, len(c))})


def evidence(toxic, clean, share: float):
    """n * KL(share of toxic documents among these, share overall); 0 if it isn't higher."""
    toxic, clean = np.asarray(toxic, np.float64), np.asarray(clean, np.float64)
    n = toxic + clean
    p = toxic / np.maximum(n, 1)
    rest = np.where(p < 1, (1 - p) * np.log(np.maximum(1 - p, 1e-300) / (1 - share)), 0.0)
    return np.where(p > share, n * (p * np.log(np.maximum(p, 1e-300) / share) + rest), 0.0)


def cover(found: list[list[int]], gold: np.ndarray, clean: np.ndarray, share: float) -> list[int]:
    """Terms picked by their evidence over toxic documents that no earlier pick occurs in, while it suffices."""
    at = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.fromiter((k for f in found for k in f), np.int64)
    at, col = at[gold[at] == 1], col[gold[at] == 1]
    taken: list[int] = []
    while len(at):
        a = np.bincount(col, minlength=len(clean)).astype(np.float64)
        live = np.flatnonzero(a >= SUPPORT)
        if not len(live):
            break
        e = evidence(a[live], clean[live], share)
        best = int(live[np.argmax(e)])
        if e.max() <= EVIDENCE:
            break
        taken.append(best)
        gone = np.isin(at, at[col == best])
        at, col = at[~gone], col[~gone]
    return taken


def _lexicons(terms: list[str]) -> dict:
    """Terms dealt to lexicons by kind, in turn."""
    placed: Counter = Counter()
    lexicon = []
    for t in terms:
        k = 0 if not t.endswith("*") else PREFIXES.index(len(t) - 1) + 1
        lexicon.append(k * STRIPES + placed[k] % STRIPES)
        placed[k] += 1
    n = (len(PREFIXES) + 1) * STRIPES
    return {"known": {t: i for i, t in enumerate(terms)}, "lexicon": lexicon, "n_lexicons": n, "n_votes": n + 7, "cut": 0.0}


def _vote(row: np.ndarray, hit: list[int], share: float, model: dict) -> None:
    """Votes of the lexicons, of several finds, against, of the share and against it."""
    n = model["n_lexicons"]
    for k in hit:
        row[model["lexicon"][k]] = 1
    row[n] = 1 if len(hit) >= 3 else 0
    row[n + 1] = -1 if not hit else 0
    row[n + 2] = 1 if hit and share >= model["cut"] else 0
    row[n + 3] = -1 if hit and share < model["cut"] else 0


def _rows(model: dict):
    known = model["known"]

    def run(texts) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        memo: dict = {}
        found, shares, votes = [], np.zeros(len(texts)), np.zeros((len(texts), model["n_votes"]), np.int8)
        for i, t in enumerate(texts):
            hit, shares[i] = known_terms(t, known, memo)
            found.append(hit)
            votes[i, model["n_lexicons"] + 4 :] = pattern_votes(t)
            _vote(votes[i], hit, shares[i], model)
        return found, shares, votes

    return run


def best_cut(shares: np.ndarray, gold: np.ndarray) -> float:
    """The share that parts toxic from clean documents with the fewest errors, halfway between its neighbours; of documents that hold any term."""
    s, g = shares[shares > 0], gold[shares > 0]
    if not len(s) or g.min() == g.max():
        return 0.0
    at = np.unique(s)
    edges = np.concatenate([[0.0], (at[:-1] + at[1:]) / 2, [np.inf]])
    order = np.argsort(s, kind="stable")
    s, g = s[order], g[order]
    below = np.searchsorted(s, edges)
    toxic = np.concatenate([[0], np.cumsum(g)])
    errors = toxic[below] + (len(s) - below) - (toxic[-1] - toxic[below])
    return float(edges[int(errors.argmin())])


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1, vote probabilities (voter, class, vote + 1) and voter weights.

    ``gold`` (0 or 1) votes last. A voter's weight is one over one plus the absolute
    correlations of its residual with those of the other voters, but for the gold label's,
    which is one; the classes' shares are those of the gold labels.
    """
    v = np.concatenate([votes, np.where(gold[:, None] > 0, 1, -1)], axis=1).astype(np.int64)
    n, m = v.shape
    share = np.clip(gold.mean(), 1e-3, 1 - 1e-3)
    q = np.where(gold > 0, GOLD, 1 - GOLD)
    weight = np.ones(m)
    probs = np.zeros((m, 2, 3))
    for step in range(rounds):
        for y, w in ((0, 1 - q), (1, q)):
            for k in range(3):
                probs[:, y, k] = ((v == k - 1) * w[:, None]).sum(axis=0) + 0.5
            right = 2 * y
            accuracy = (probs[-1, y, right] + GOLD * w.sum()) / (2 * w.sum() + 1)
            probs[-1, y] = 1e-9
            probs[-1, y, right], probs[-1, y, 2 - right] = accuracy, 1 - accuracy
        probs /= probs.sum(axis=2, keepdims=True)
        ratio = np.log(probs[:, 1] / probs[:, 0])
        score = np.log(share / (1 - share)) + (ratio[np.arange(m)[None, :], v + 1] * weight).sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if step % 5 == 4:
            mean = probs @ np.array([-1.0, 0.0, 1.0])
            res = v - (q[:, None] * mean[:, 1] + (1 - q)[:, None] * mean[:, 0])
            sd = res.std(axis=0)
            z = res / np.where(sd > 1e-9, sd, 1)
            rho = np.abs(z.T @ z) / n
            np.fill_diagonal(rho, 0)
            rho[:, -1] = 0
            weight = 1 / (1 + np.where(rho > 0.1, rho, 0).sum(axis=1))
            weight[-1] = 1.0
    return q, probs, weight


def _logistic(rows: list[list[int]], n: int, target: np.ndarray, weight: np.ndarray, steps: int = 400, l2: float = 1e-3) -> np.ndarray:
    """Weights and, last, the intercept of a logistic model on binary features, by full-batch Adam."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((k for r in rows for k in r), np.int64)
    w, m, s = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, weights=w[col], minlength=len(rows)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / weight.sum()
        grad = np.append(np.bincount(col, weights=g[at], minlength=n), g.sum()) + l2 * np.append(w[:-1], 0) / 100
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> dict:
    """Fit on (doc_id, text) and (doc_id, toxic); conflicting labels of an id count as toxic, null ones not at all."""
    known_ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(17), "doc_id")
    chosen = known_ids.where("toxic = 1").orderBy(order, "doc_id").limit(most).unionByName(known_ids.where("toxic <> 1").orderBy(order, "doc_id").limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * most ids
    # copies of a text are one piece of evidence
    rows = cut(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    t1, t0 = sizes.get(True, 0), sizes.get(False, 0)
    if not t1 or not t0:
        return {"known": {}, "lexicon": [], "n_lexicons": 0, "n_votes": 7, "cut": 0.0, "w": [0.0] * 7 + [4.0 if t1 and not t0 else -4.0], "probs": None}
    share = t1 / (t1 + t0)

    def counts(where: str, name: str) -> DataFrame:
        return rows.where(where).select("text").mapInPandas(_count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias(name))

    # both tests are made where the counts are: only the terms that pass come to the driver, which the sample's size bounds
    both = counts("toxic = 1", "n1").where(F.col("n1") >= SUPPORT).join(counts("toxic <> 1", "n0"), "term", "left").fillna({"n0": 0})
    odds = ((F.col("n1") + 0.1) / (t1 + 1)) / ((F.col("n0") + 0.1 * t0 / t1) / (t0 + 1))
    p = F.col("n1") / (F.col("n1") + F.col("n0"))
    proof = (F.col("n1") + F.col("n0")) * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    passed = both.withColumn("odds", odds).where((F.col("odds") >= RATIO) & (p > share)).where(proof >= EVIDENCE).collect()
    first, n0 = {r["term"]: r["n1"] for r in passed}, {r["term"]: r["n0"] for r in passed}
    strong = sorted(first, key=lambda t: (-first[t] * np.log(((first[t] + 0.1) / (t1 + 1)) / ((n0[t] + 0.1 * t0 / t1) / (t0 + 1))), t))
    model = _lexicons(strong)

    def features(model: dict) -> pd.DataFrame:
        make = _rows(model)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                found, shares, votes = make(list(d["text"]))
                yield pd.DataFrame({"h": d["h"], "toxic": d["toxic"].astype("int32"), "found": found, "share": shares, "votes": [x.tobytes() for x in votes]})

        out = rows.select("h", "toxic", "text").mapInPandas(run, "h long, toxic int, found array<int>, share double, votes binary").toPandas()  # at most 2 * most rows of features
        return out.sort_values("h").reset_index(drop=True)

    got = features(model)
    gold = (got["toxic"].to_numpy() == 1).astype(np.int64)
    # only terms that explain toxic documents which stronger terms leave unexplained: a word that is merely common in them explains none
    found = [[int(k) for k in f] for f in got["found"]]
    taken = cover(found, gold, np.array([n0.get(t, 0) for t in strong], np.float64), share)
    # and those about as frequent as the picked ones and hardly ever elsewhere: other words of the same kind
    usual = float(np.median([first[strong[k]] for k in taken])) if taken else np.inf
    taken += [k for k, t in enumerate(strong) if k not in set(taken) and first[t] >= usual / 2 and n0.get(t, 0) <= 0.02 * first[t] and evidence(first[t], n0.get(t, 0), share) >= 2 * EVIDENCE]
    model = _lexicons([strong[k] for k in taken])
    got = features(model)
    shares = got["share"].to_numpy()
    model["cut"] = best_cut(shares, gold)
    found = [[int(k) for k in f] for f in got["found"]]
    votes = np.stack([np.frombuffer(x, np.int8) for x in got["votes"]]).copy()
    for i, f in enumerate(found):
        _vote(votes[i], f, shares[i], model)
    q, probs, weight = label_model(votes, gold)
    n = len(taken)
    x = [[*f, *(n + np.flatnonzero(v)).tolist()] for f, v in zip(found, votes, strict=True)]
    balance = np.where(gold == 1, 0.5 / max(gold.sum(), 1), 0.5 / max((1 - gold).sum(), 1)) * len(gold)
    model |= {"w": _logistic(x, n + model["n_votes"], q, np.sqrt(balance)).tolist(), "probs": probs, "weight": weight}
    return model


def score(text: Column, model: dict) -> Column:
    """Score in 0 to 1 of a text column; null counts as empty."""
    make, w, n = _rows(model), np.array(model["w"]), len(model["known"])

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        found, _, votes = make(list(texts))
        z = np.array([w[f].sum() if f else 0.0 for f in found]) + (votes != 0) @ w[n:-1] + w[-1]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return run(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, ``held_out``, ``score``, ``predicted`` of every document.

    Labels of ids whose crc32 is a multiple of five are held out. Null and empty texts
    have the score of a text without terms; repeated rows each return; without labels of
    both classes all documents have one score; an empty table gives no rows.
    """
    held = crc32_mod(F.col("doc_id"), FOLDS) == 0
    model = fit(docs, labels.where(~held), most)
    out = docs.select("doc_id", held.alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Documents with a score under 0.5, with all their columns, whatever their names.

    Null and empty texts have the score of a text without terms; repeated rows stay or go
    together; without labels of both classes all documents have one score; an empty table
    gives no rows.
    """
    model = fit(docs, labels.where(crc32_mod(F.col("doc_id"), FOLDS) != 0), most)
    return docs.where(score(F.col("text"), model) < 0.5)
