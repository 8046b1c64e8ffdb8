"""Language-model scores by a hierarchical Pitman-Yor model.

Symbols are the ``heads`` most frequent words, the end of a document, and one class of
all other words. Each symbol seen as context has a restaurant; they share the parent
restaurant of no context, whose base is uniform. The context of a token is the nearest
head before it in its document, or the start. Words of the class come from a
Pitman-Yor restaurant of their own, with all training counts of all words and a base
that never repeats, so each known word has one table there and a word never seen has
the mass of a new table.

Counts cover all training documents and are made with partial aggregation. Seating is
sampled by Gibbs: given the parent's predictive and the rest of its restaurant, the
number of tables that serve a dish with c customers has probability proportional to
S_d(c, t) * prod_i(theta + d * (T + i)) * p^t, with S_d the generalized Stirling numbers;
counts over ``EXACT`` are seated in growing groups of customers. A restaurant's dishes are
drawn one after the other, and a sweep starts from the stored seating of the one before.
Restaurants are dealt to tasks in blocks; after each sweep the parent is reseated from the tables of all restaurants, and
the concentration resampled by auxiliary variables. Predictive probabilities are averaged
over the last sweeps into one table of at most
(heads + 2)^2 numbers, whatever the corpus: the bound on what is broadcast.

Counts of all words reach the documents without a broadcast: documents are dealt into
groups, each group asks for its different words once, and the answers meet the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, cut

HEADS, FOLDS, HELD = 2048, 7, 2
EXACT, SWEEPS, KEPT, BLOCK = 512, 6, 3, 128
GROUP_BYTES = 24 << 20
END = np.int64(-1)  # stands for the end token; no word's hash is taken to be it


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words' hashes, each token's place among them, and the tokens before each document (n + 1 numbers)."""
    import pyarrow.compute as pc
    import xxhash

    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[\x09-\x0d ]+")
    offsets = words.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, 1) for w in names), np.uint64, len(names)).view(np.int64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    if "" in names:  # before a leading and after a trailing separator
        real = at != names.index("")
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        at = at[real]
    return hashes, at, offsets


def _slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most)))
        yield batch.slice(at, to - at)
        at = to


def _sum_by(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    u, at = np.unique(k, return_inverse=True)
    return u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [], [], 0
    for whole in batches:
        for b in _slices(whole, "text"):
            hashes, at, _ = tokenize(b.column("text"))
            c = np.bincount(at, minlength=len(hashes))
            keys += [hashes[c > 0], np.array([END])]
            counts += [c[c > 0], np.array([b.num_rows])]
            held += len(hashes)
            if held > 1_500_000:
                k, c = _sum_by(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["h", "c"])
                    keys, counts, held = [], [], 0
    if keys:
        k, c = _sum_by(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["h", "c"])


def _symbols(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places in the sorted heads, or the class's number len(heads)."""
    at = np.searchsorted(heads, hashes)
    return np.where(heads[np.minimum(at, len(heads) - 1)] == hashes, at, len(heads))


def _sequence(hashes: np.ndarray, at: np.ndarray, offsets: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol and context of each token with the ends put in, its document, and which tokens are words."""
    n = len(offsets) - 1
    k = len(heads)
    size = np.diff(offsets) + 1
    total = int(size.sum())
    last = np.cumsum(size) - 1
    word = np.ones(total, bool)
    word[last] = False
    symbol = np.empty(total, np.int64)
    symbol[word] = _symbols(hashes, heads)[at]
    symbol[last] = np.searchsorted(heads, END)
    doc = np.repeat(np.arange(n), size)
    # the nearest head before each token, by a running maximum of places
    place = np.where(symbol < k, np.arange(total), -1)
    before = np.concatenate(([-1], np.maximum.accumulate(place)[:-1])) if total else place
    first = (last - size + 1)[doc]
    context = np.where(before >= first, symbol[np.maximum(before, 0)], k)  # the class's number as context: the start
    return symbol, context, doc, word


def _pair_counts(heads: np.ndarray):
    width = len(heads) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for whole in batches:
            for b in _slices(whole, "text"):
                symbol, context, _, _ = _sequence(*tokenize(b.column("text")), heads)
                k, c = np.unique(context * width + symbol, return_counts=True)
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > 4_000_000:
                    k, c = _sum_by(keys, counts)
                    keys, counts = [k], [c]
        if keys:
            k, c = _sum_by(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["cell", "c"])

    return run


# ------------------------------------------------------------------ seating


def log_stirling(d: float, most: int) -> np.ndarray:
    """log S_d(c, t) for c, t up to ``most``; -inf above the diagonal."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = out[c] + np.log(np.maximum(c - d * t, 0))
            out[c + 1] = np.logaddexp(np.concatenate(([-np.inf], out[c, :-1])), np.where(np.isnan(stay), -np.inf, stay))
    return out


def sample_tables(c: np.ndarray, p: np.ndarray, others: np.ndarray, theta: float, d: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers, each of another restaurant, given base probabilities and the tables of the restaurant's other dishes."""
    t = np.ones(len(c), np.int64)
    exact, least = len(stirling) - 1, 1
    if exact >= 2:  # the most frequent case, by its odds
        i, least = np.flatnonzero(c == 2), 2
        odds = np.exp(stirling[2, 2] - stirling[2, 1]) * (theta + d * (others[i] + 1)) * p[i]
        t[i] += rng.random(len(i)) < odds / (1 + odds)
    # dishes of like sizes together, so that few columns stay empty
    for most in (*[x for x in (4, 16, 64) if x < exact], exact):
        i = np.flatnonzero((c > least) & (c <= most))
        least = most
        if len(i):
            grow = np.cumsum(np.log(theta + d * (others[i, None] + np.arange(most))), axis=1)
            logit = stirling[c[i], 1 : most + 1] + grow + np.arange(1, most + 1) * np.log(p[i, None])
            t[i] = 1 + np.argmax(logit + rng.gumbel(size=logit.shape), axis=1)
    many = np.flatnonzero(c > exact)
    if len(many):
        n, k = np.ones(len(many)), np.ones(len(many))
        left = c[many] - 1.0
        while (left > 0).any():
            m = np.minimum(left, np.maximum(1, n // 32))
            new = (theta + d * (others[many] + k)) * p[many]
            k += rng.binomial(m.astype(np.int64), new / (new + n - d * k))
            n += m
            left -= m
        t[many] = k
    return t


def resample(t: np.ndarray, c: np.ndarray, p: np.ndarray, u_at: np.ndarray, theta: float, d: float, stirling: np.ndarray, rng: np.random.Generator) -> None:
    """One Gibbs sweep in place: a restaurant's dishes one after the other, each given the tables that the others have now; restaurants, which don't touch each other, side by side."""
    whole = np.bincount(u_at, weights=t)
    live = rng.permutation(np.flatnonzero(c > 1))  # a single customer has one table
    if not len(live):
        return
    by = np.argsort(u_at[live], kind="stable")
    live = live[by]
    starts = np.flatnonzero(np.diff(u_at[live], prepend=-1))
    turn = np.arange(len(live)) - np.repeat(starts, np.diff(np.append(starts, len(live))))
    live = live[np.argsort(turn, kind="stable")]
    for i in np.split(live, np.cumsum(np.bincount(turn))[:-1]):
        new = sample_tables(c[i], p[i], np.maximum(whole[u_at[i]] - t[i], 0), theta, d, stirling, rng)
        whole[u_at[i]] += new - t[i]
        t[i] = new


#: A block of restaurants between sweeps: its cells and customers, and the tables of each cell after the last sweeps.
_BLOCK = "block long, cells binary, counts binary, tables array<binary>, sent binary, y double, logx double"


def _sweep(width: int, p0: np.ndarray, theta: float, number: int, d: float, stirling: np.ndarray):
    """One sweep over each block, from where the last one left it; the block's random numbers are its own and the sweep's, so a task that is repeated does the same again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                cell, c = np.frombuffer(row.cells, np.int64), np.frombuffer(row.counts, np.int64)
                near, u_at = np.unique(cell // width, return_inverse=True)
                w = cell % width
                past = list(row.tables) if row.tables is not None else []
                t = np.frombuffer(past[-1], np.int64).copy() if past else np.ones(len(c), np.int64)
                rng = np.random.default_rng([17, number, int(near[0])])
                resample(t, c, p0[w], u_at, theta, d, stirling, rng)
                customers, tables = np.bincount(u_at, weights=c), np.bincount(u_at, weights=t)
                # auxiliary variables of the concentration
                big = customers > 1
                x = rng.beta(theta + 1, customers[big] - 1)
                y = sum(int((rng.random(int(k) - 1) < theta / (theta + d * np.arange(1, int(k)))).sum()) for k in tables[big])
                kept = [*past, t.tobytes()][-KEPT:]
                yield pd.DataFrame({"block": [row.block], "cells": [row.cells], "counts": [row.counts], "tables": [kept], "sent": [np.bincount(w, weights=t, minlength=width).tobytes()], "y": [float(y)], "logx": [float(np.log(x).sum())]})

    return run


def _predict(width: int, params: list[tuple[np.ndarray, float]], d: float):
    """Averages over the seatings that were kept, which were made under the last of ``params``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                cell, c = np.frombuffer(row.cells, np.int64), np.frombuffer(row.counts, np.int64)
                near, u_at = np.unique(cell // width, return_inverse=True)
                w, total = cell % width, 0.0
                for (p0, theta), held in zip(params, row.tables, strict=True):
                    t = np.frombuffer(held, np.int64)
                    customers, tables = np.bincount(u_at, weights=c), np.bincount(u_at, weights=t)
                    p = ((theta + d * tables) / (theta + customers))[:, None] * p0[None, :]
                    p[u_at, w] += (c - d * t) / (theta + customers)[u_at]
                    total = total + p
                for u, p in zip(near.tolist(), total / len(params), strict=True):
                    yield pd.DataFrame({"u": [u], "p": [p.astype(np.float32).tobytes()]})

    return run


def fit(docs: DataFrame, heads: int = HEADS) -> dict:
    """Fit on the texts of ``docs``: a model of bounded size, and ``counts``, a table of all words' counts."""
    texts = docs.select("text")
    counts = cut(texts.mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n = n or 0
    top = counts.where(F.col("h") != int(END)).orderBy(F.desc("c"), "h").limit(heads).collect()
    head = np.sort(np.array([END, *[r["h"] for r in top]], np.int64))
    width = len(head) + 1
    ends = counts.where(F.col("h") == int(END)).agg(F.sum("c")).first()[0] or 0
    rare_n, rare_v = n - sum(r["c"] for r in top) - ends, v - len(top) - (1 if ends else 0)
    cells = texts.mapInArrow(_pair_counts(head), "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))

    def pack(d: pd.DataFrame) -> pd.DataFrame:  # a block of restaurants has at most BLOCK * (heads + 2) dishes
        d = d.sort_values("cell")
        return pd.DataFrame({"block": [int(d["block"].iloc[0])], "cells": [d["cell"].to_numpy(np.int64).tobytes()], "counts": [d["c"].to_numpy(np.int64).tobytes()], "ones": [int((d["c"] == 1).sum())], "twos": [int((d["c"] == 2).sum())]})

    blocks = cut(cells.withColumn("block", F.floor(F.col("cell") / (width * BLOCK))).groupBy("block").applyInPandas(pack, "block long, cells binary, counts binary, ones long, twos long"))
    ones, twos = blocks.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("twos"), F.lit(0))).first()
    d = float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))
    stirling = log_stirling(d, EXACT)
    rng = np.random.default_rng(11)
    uniform = np.full(width, 1 / width)
    p0, theta, params = uniform, 10.0, []
    top_t, top_stirling = np.ones(width, np.int64), log_stirling(0.5, EXACT)
    state = blocks.select("block", "cells", "counts", F.lit(None).cast("array<binary>").alias("tables"))
    for number in range(SWEEPS):
        # the seating goes on from the last sweep's, which is stored
        swept = cut(state.select("block", "cells", "counts", "tables").mapInPandas(_sweep(width, p0, theta, number, d, stirling), _BLOCK))
        got = swept.select("sent", "y", "logx").collect()  # a row a block
        if not got:
            break
        params.append((p0, theta))
        state = swept
        # the parent's restaurant: customers are the tables below; discount one half, concentration one; its seating goes on, too
        c = np.sum([np.frombuffer(r["sent"]) for r in got], axis=0).astype(np.int64)
        live = np.flatnonzero(c > 0)
        t = np.minimum(top_t[live], c[live])
        resample(t, c[live], uniform[live], np.zeros(len(live), np.int64), 1.0, 0.5, top_stirling, rng)
        top_t[live] = t
        tables = np.zeros(width)
        tables[live] = t
        p0 = (c - 0.5 * tables) / (1 + c.sum()) + (1 + 0.5 * tables.sum()) / (1 + c.sum()) / width
        theta = float(np.clip(rng.gamma(1 + sum(r["y"] for r in got), 1 / (0.1 - sum(r["logx"] for r in got))), 1e-2, 1e4))
    table = np.tile(np.log10(p0).astype(np.float32), (width, 1))  # a context never seen has the parent's predictive
    if params:
        for r in state.select("block", "cells", "counts", "tables").mapInPandas(_predict(width, params[-KEPT:], d), "u long, p binary").collect():  # at most heads + 2 rows
            table[r["u"]] = np.log10(np.frombuffer(r["p"], np.float32))
    once = counts.agg(F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("c") == 2).cast("long")), F.lit(0))).first()
    d_rare = float(np.clip(once[0] / max(once[0] + 2 * once[1], 1), 0.05, 0.95))
    return {"heads": head, "table": table, "n": int(n), "v": int(v), "rare": (max(rare_n, 0), max(rare_v, 0), d_rare), "counts": counts}


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of each group in a partition."""
    seen: dict[int, list[np.ndarray]] = {}
    for whole in batches:
        for b in _slices(whole, "text"):
            group = b.column("pid").to_numpy()
            hashes, at, offsets = tokenize(b.column("text"))
            of = np.repeat(group, np.diff(offsets))
            for g in np.unique(group):
                seen.setdefault(int(g), []).append(hashes[np.unique(at[of == g])])
    for g, parts in seen.items():
        h = np.unique(np.concatenate([*parts, np.array([END])]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), g, np.int64)), pa.array(h)], names=["pid", "h"])


def _scorer(model: dict, table):
    heads, n, v = model["heads"], model["n"], model["v"]
    rare_n, rare_v, d = model["rare"]

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        # a group whose words have no count at all, or no documents
        known = words.column("h").to_numpy() if words.num_rows else np.array([END])
        count = words.column("c").to_numpy() if words.num_rows else np.array([0])
        order = np.argsort(known)
        known, count = known[order], count[order]
        logp = table.value
        out = []
        for b in docs.combine_chunks().to_batches():
            for part in _slices(b, "text"):
                hashes, at, offsets = tokenize(part.column("text"))

                def counted(h):
                    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    return np.where(known[k] == h, count[k], 0)

                symbol, context, doc, word = _sequence(hashes, at, offsets, heads)
                c = np.empty(len(symbol), np.int64)
                c[word] = counted(hashes)[at]
                c[~word] = counted(np.array([END]))[0]
                m = part.num_rows
                base = np.bincount(doc, weights=np.log10((c + 1) / (n + v + 1)), minlength=m)
                p = logp[context, symbol].astype(np.float64)
                rare = symbol == len(heads)
                p[rare] += np.log10(np.where(c[rare] > 0, c[rare] - d, 1 + d * rare_v) / (1 + rare_n))
                out.append(
                    pa.table(
                        {
                            "doc_id": part.column("doc_id"),
                            "held_out": part.column("held_out"),
                            "n_tokens": np.bincount(doc, minlength=m),
                            "n_known": np.bincount(doc, weights=c > 0, minlength=m).astype(np.int64),
                            "train_tokens": np.full(m, n, np.int64),
                            "base_score": base,
                            "score": np.bincount(doc, weights=p, minlength=m),
                        }
                    )
                )
        if not out:
            return pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        return pa.concat_tables(out)

    return run


def lm_scores(docs: DataFrame, heads: int = HEADS) -> DataFrame:
    """doc_id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every document.

    Ids whose crc32 leaves 2 modulo 7 are held out of training. Null and empty texts
    have the end token alone; repeated rows each count and each return; without training
    text every token is unknown; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    held = crc32_mod(F.col("doc_id"), FOLDS) == HELD
    rows = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model = fit(rows.where("not held_out"), heads)
    counts = model.pop("counts")
    table = spark.sparkContext.broadcast(model.pop("table"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = int(max(1, size // GROUP_BYTES + 1))
    dealt = rows.withColumn("pid", F.pmod(F.xxhash64(F.lit(23), "doc_id", F.octet_length("text")), F.lit(groups))).repartition(groups, "pid")
    asked = dealt.select("pid", "text").mapInArrow(_asked, "pid long, h long")
    told = asked.join(counts, "h").select("pid", "h", "c")
    return dealt.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(_scorer(model, table), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
