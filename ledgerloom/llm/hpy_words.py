"""Language-model scores by a hierarchical Pitman-Yor model of all words.

Every word that the training texts hold, and the start of a document, is a context with a
restaurant of its own; every word and the end of a document is a dish; no word is merged
with another or left out. All restaurants share the parent restaurant of no context,
whose base never repeats: each known word has one table there, and all words never seen
share the mass of a new table.

A text's tokens meet their contexts in one shuffle: a batch of documents sends each block
of contexts its (context, word, document) triples, packed. The blocks are stored once,
dealt by block, and stay there: what changes, the parent's probabilities and the seating,
comes to them. In a round each block seats its restaurants anew given the parent's
predictive, by ``SWEEPS`` Gibbs sweeps that go on from the round before, and tells the
words' tables, the parent's customers, by ranges of words; each range sums them and
answers each block. At last blocks sum the log10 probabilities by document, and a batch's
sums meet. How often a word is a context is its count, so the base score is made of the
same sums.

A restaurant of over ``TURNS`` dishes with more than one customer draws several of them
side by side. A context of over a fourth of a
block's tokens is dealt into parts by the word; its parts know each other's tables as of
the last round. The ``CODES`` most frequent words travel as two bytes, all others as
their hashes: that changes only the number of bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, cut_clean, planned_once
from .hpy_lm import END, EXACT, FOLDS, HELD, _slices, _word_counts, log_stirling, sample_tables, tokenize

BLOCK_TOKENS = 3_000_000
ROUNDS, SWEEPS, TURNS = 2, 3, 32
CODES = 65_535
START = np.int64(-2)  # stands for the start of a document; no word's hash is taken to be it
_DRAWN = 5_000  # dishes drawn at once: bounds what a draw holds
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    x = h.view(np.uint64) * _MIX
    return x ^ (x >> np.uint64(29))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string."""
    raw = b"".join(struct.pack("<cbq", a.dtype.kind.encode(), a.dtype.itemsize, len(a)) + np.ascontiguousarray(a).tobytes() for a in arrays)
    return struct.pack("<q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], struct.unpack("<q", data[:8])[0], "zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        kind, size, n = struct.unpack_from("<cbq", raw, at)
        at += struct.calcsize("<cbq")
        out.append(np.frombuffer(raw, f"{kind.decode()}{size}", n, at))
        at += size * n
    return out


def _different(x: np.ndarray) -> np.ndarray:
    """Different values, sorted: many of them, for which np.unique's hash table is slow."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _places(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x among sorted values, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_values, x), max(len(sorted_values) - 1, 0))
    return at, (sorted_values[at] == x) if len(sorted_values) else np.zeros(len(x), bool)


# ------------------------------------------------------------------ packing the tokens


def _sorted_tokens(at: np.ndarray, size: np.ndarray, mixed: np.ndarray, parts: np.ndarray, blocks: int) -> tuple[np.ndarray, ...]:
    """Block, context, word and document of each token with the ends put in, sorted by block, context and document.

    A slice's tokens are the most that an encoding task holds: names and blocks take four
    bytes, documents two, and an array goes as soon as it is used.
    """
    total, last, end = int(size.sum()), np.cumsum(size) - 1, len(mixed) - 2
    inside = np.ones(total, bool)
    inside[last] = False
    word = np.full(total, end, np.int32)
    word[inside] = at
    del inside
    context = np.empty(total, np.int32)
    context[1:] = word[:-1]
    context[last - size + 1] = end + 1
    doc = np.repeat(np.arange(len(size), dtype=np.uint16), size)
    # the block of a context, and of each part of a hot one
    block = (mixed % np.uint64(blocks)).astype(np.int32)[context]
    many = np.flatnonzero((parts > 1)[context])
    for s in range(0, len(many), 1 << 18):
        i = many[s : s + (1 << 18)]
        part = (mixed[word[i]] >> np.uint64(17)) % parts[context[i]].astype(np.uint64)
        block[i] = ((mixed[context[i]] + part) % np.uint64(blocks)).astype(np.int32)
    del many
    if blocks * len(mixed) * len(size) >= 1 << 62:
        order = np.lexsort((doc, context, block))
    else:
        key = block.astype(np.int64)
        for x, n in ((context, len(mixed)), (doc, len(size))):
            key *= n
            key += x
        order = np.argsort(key, kind="stable")
        del key
    block = block[order]
    context = context[order]
    word = word[order]
    return block, context, word, doc[order]


def _encoder(coded, hot_words: np.ndarray, hot_parts: np.ndarray, blocks: int):
    """Rows (block, batch, packed): a batch's triples for each block, and for a negative block its documents."""

    def encode(rows: pa.RecordBatch, number: int) -> pa.RecordBatch:
        code_words, codes, _ = coded.value  # sorted hashes, their codes, and the hashes by code
        out: tuple[list, list] = ([], [])
        hashes, at, offsets = tokenize(rows.column("text"))
        size = np.diff(offsets) + 1
        names = np.concatenate((hashes, [END, START]))
        place, found = _places(hot_words, names)
        parts = np.where(found, hot_parts[place], 1) if len(hot_words) else np.ones(len(names), np.int64)
        block, context, word, doc = _sorted_tokens(at, size, _mixed(names), parts, blocks)
        del at
        place, found = _places(code_words, names)
        code = np.where(found, codes[place] if len(codes) else 0, CODES).astype(np.uint16)
        held = np.packbits(rows.column("held_out").to_numpy(zero_copy_only=False))
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for s, e in zip(edges, [*edges[1:], len(block)], strict=True):
            c = context[s:e]
            runs = np.flatnonzero(np.diff(c, prepend=-1))
            w = code[word[s:e]]
            out[0].append(int(block[s]))
            out[1].append(_pack(names[c[runs]], np.diff(np.append(runs, e - s)).astype(np.uint32), w, names[word[s:e][w == CODES]], np.diff(doc[s:e], prepend=np.uint16(0)), held))
        out[0].append(-1 - number % blocks)
        ids = rows.column("doc_id")
        out[1].append(_pack(ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), rows.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8), size.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([number] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary())], names=["block", "batch", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for whole in batches:
            for s in range(0, whole.num_rows, 1 << 16):  # documents of a batch are numbered in two bytes
                for rows in _slices(whole.slice(s, 1 << 16), "text"):
                    yield encode(rows, number)
                    number += 1

    return run


class Block:
    """A block's restaurants: cells (context, word) with the customers that training gives them, sorted; and its tokens, to be scored."""

    def __init__(self, rows: pa.Table, code_hashes: np.ndarray):
        order = np.argsort(rows.column("batch").to_numpy(), kind="stable")
        packed = rows.column("packed").to_pylist()
        self.batches = rows.column("batch").to_numpy()[order].tolist()
        parts = [_unpack(packed[i]) for i in order]
        self.contexts, u = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        used = np.zeros(CODES + 1, bool)
        for p in parts:
            used[p[2]] = True
        used[CODES] = False
        self.words = _different(np.concatenate([code_hashes[used[: len(code_hashes)]], *[p[3] for p in parts]]))
        of_code = np.zeros(CODES + 1, np.int64)
        of_code[: len(code_hashes)] = np.minimum(np.searchsorted(self.words, code_hashes), len(self.words) - 1)
        self.key, self.doc, self.ends, at, trained = [], [], [], 0, []
        for p in parts:
            w = of_code[p[2]]
            w[p[2] == CODES] = np.searchsorted(self.words, p[3])
            key = np.repeat(u[at : at + len(p[0])], p[1]) * len(self.words) + w
            at += len(p[0])
            doc = np.cumsum(p[4], dtype=np.uint16)
            self.key.append(key)
            self.doc.append(doc)
            trained.append(key[np.unpackbits(p[5])[doc] == 0])
        self.cell, self.c = np.unique(np.concatenate(trained), return_counts=True)
        self.u, self.w = self.cell // len(self.words), self.cell % len(self.words)
        self.customers = np.bincount(self.u, weights=self.c, minlength=len(self.contexts))

    def tables(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.u, weights=t, minlength=len(self.contexts))


def _ranges(words: np.ndarray, ranges: int) -> np.ndarray:
    """Ends of each range's words among sorted ones: ranges of equal width."""
    edges = [-(1 << 63) + (1 << 64) * r // ranges for r in range(1, ranges)]
    return np.concatenate((np.searchsorted(words, np.array(edges, np.int64)), [len(words)]))


def auxiliary(c: np.ndarray, t: np.ndarray, theta: float, d: float, rng: np.random.Generator) -> tuple[float, float]:
    """Sums of the auxiliary variables from which the concentration is drawn, over restaurants of c customers and t tables."""
    big = c > 1
    k = t[big].astype(np.int64) - 1
    i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + 1
    return float((rng.random(len(i)) < theta / (theta + d * i)).sum()), float(np.log(np.maximum(rng.beta(theta + 1, c[big] - 1), 1e-300)).sum())


def sweep(t: np.ndarray, c: np.ndarray, p: np.ndarray, u: np.ndarray, whole: np.ndarray, theta: float, d: float, stirling: np.ndarray, rng: np.random.Generator) -> None:
    """One Gibbs sweep in place over dishes of more than one customer; ``whole``: tables of each restaurant, kept up."""
    order = rng.permutation(len(t))
    order = order[np.argsort(u[order], kind="stable")]
    first = np.flatnonzero(np.diff(u[order], prepend=-1))
    turn = (np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))) % TURNS
    order = order[np.argsort(turn, kind="stable")]
    for i in np.split(order, np.cumsum(np.bincount(turn, minlength=TURNS))[:-1]):
        for s in range(0, len(i), _DRAWN):
            j = i[s : s + _DRAWN]
            new = sample_tables(c[j], p[j], np.maximum(whole[u[j]] - t[j], 0), theta, d, stirling, rng)
            np.add.at(whole, u[j], new - t[j])
            t[j] = new


_TOLD = "block long, r int, words binary, n binary"
_ANSWER = pa.schema([("block", pa.int64()), ("r", pa.int32()), ("words", pa.binary()), ("n", pa.binary())])


def _told(number: int, block: Block, t: np.ndarray, more: list[tuple[int, bytes, bytes]], ranges: int) -> pa.Table:
    n = np.bincount(block.w, weights=t, minlength=len(block.words)).astype(np.uint32)
    rows, s = list(more), 0
    for r, e in enumerate(_ranges(block.words, ranges)):
        if e > s:
            rows.append((r, _pack(block.words[s:e]), _pack(n[s:e])))
        s = e
    return pa.Table.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())], schema=_ANSWER)


def _hot_stats(block: Block, hot: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Which contexts are parts of hot ones; and these parts' customers and tables."""
    _, is_hot = _places(hot, block.contexts)
    return is_hot, _pack(block.contexts[is_hot], block.customers[is_hot], block.tables(t)[is_hot])


def _first(coded, hot: np.ndarray, ranges: int):
    """A table for each cell: the seating that rounds start from."""

    def run(rows: pa.Table) -> pa.Table:
        b = Block(rows, coded.value[2])
        t = np.ones(len(b.c), np.int64)
        more = [(-2, b"", _pack(np.array([(b.c == 1).sum(), (b.c == 2).sum()], np.float64))), (-3, b"", _hot_stats(b, hot, t)[1])]
        return _told(rows.column("block")[0].as_py(), b, t, more, ranges)

    return run


def _answers(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """The parent's customers of each of a block's words, and the block's seating after the last round."""
    r = rows.column("r").to_numpy()
    n = rows.column("n").to_pylist()
    state = [n[i] for i in np.flatnonzero(r == -1)]
    return np.concatenate([_unpack(n[i])[0] for i in np.argsort(r, kind="stable") if r[i] >= 0]).astype(np.float64), _unpack(state[0]) if state else None


def _others(block: Block, hot: np.ndarray, hot_c: np.ndarray, hot_t: np.ndarray, own_t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of each context over all of its parts."""
    at, found = _places(hot, block.contexts)
    customers, tables = block.customers.copy(), own_t.astype(np.float64)
    customers[found], tables[found] = hot_c[at[found]], hot_t[at[found]]
    return customers, tables


def _seat(coded, hot: np.ndarray, hot_c: np.ndarray, hot_t: np.ndarray, parent: tuple, theta: float, d: float, number: int, ranges: int):
    """A round over a block; its random numbers are its own and the round's, so a task that is repeated does the same again."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _ANSWER.empty_table()
        b = Block(rows, coded.value[2])
        block = rows.column("block")[0].as_py()
        q, state = _answers(answers)
        p0 = parent_predictive(q, parent)
        t = state[0].astype(np.int64) if state else np.ones(len(b.c), np.int64)
        _, whole = _others(b, hot, hot_c, hot_t, b.tables(t))
        live = np.flatnonzero(b.c > 1)
        stirling, rng = log_stirling(d, EXACT), np.random.default_rng([23, number, block])
        own, total = t[live], np.zeros(len(t), np.int64)
        for _ in range(SWEEPS):
            sweep(own, b.c[live], p0[b.w[live]], b.u[live], whole, theta, d, stirling, rng)
            t[live] = own
            total += t
        is_hot, hot_part = _hot_stats(b, hot, t)
        y, logx = auxiliary(b.customers[~is_hot], b.tables(t)[~is_hot], theta, d, rng)
        more = [(-1, b"", _pack(t.astype(np.uint32), total.astype(np.uint32))), (-2, b"", _pack(np.array([y, logx]))), (-3, b"", hot_part)]
        if hot_part:
            more.append((-4, b"", _pack(b.contexts[is_hot], b.tables(total)[is_hot] / SWEEPS)))
        return _told(block, b, t, more, ranges)

    return run


def _parent(rows: pa.Table) -> pa.Table:
    """The parent's customers of a range's words: each block gets those of its words, in order. Once a range also how many there are, and how many words have one and two."""
    words = [_unpack(x)[0] for x in rows.column("words").to_pylist()]
    counts = [_unpack(x)[0] for x in rows.column("n").to_pylist()]
    all_words, at = np.unique(np.concatenate(words), return_inverse=True)
    c = np.bincount(at, weights=np.concatenate(counts), minlength=len(all_words)).astype(np.int64)
    out = [_pack(x.astype(np.uint32)) for x in np.split(c[at], np.cumsum([len(w) for w in words])[:-1])]
    once = [pa.array([int(x), *[0] * (len(out) - 1)], pa.int64()) for x in (c.sum(), (c == 1).sum(), (c == 2).sum())]
    return pa.Table.from_arrays([rows.column("block"), rows.column("r"), pa.array([b""] * len(out), pa.binary()), pa.array(out, pa.binary()), *once], names=[*_ANSWER.names, "all", "ones", "twos"])


def parent_predictive(c: np.ndarray, parent: tuple[int, int, float]) -> np.ndarray:
    """Of words with c customers there; of none: of all words never seen together."""
    customers, known, d = parent
    return np.where(c > 0, c - d, 1 + d * known) / (1 + customers)


def predictive(c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, p0: np.ndarray, theta: float, d: float) -> np.ndarray:
    return (c - d * t + (theta + d * tables) * p0) / (theta + customers)


def _score(coded, hot: np.ndarray, hot_c: np.ndarray, hot_t: np.ndarray, parent: tuple, theta: float, d: float, n: int, v: int):
    """Rows (batch, packed): sums by document of a block's log10 probabilities, base and known words."""
    schema = pa.schema([("batch", pa.int64()), ("block", pa.int64()), ("packed", pa.binary())])

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        b = Block(rows, coded.value[2])
        q, state = _answers(answers)
        p0 = parent_predictive(q, parent)
        total = state[1] / SWEEPS
        customers, tables = _others(b, hot, hot_c, hot_t, b.tables(total))
        base = np.where(b.contexts == START, 0.0, np.log10((customers + 1) / (n + v + 1)))
        known = (customers > 0) & (b.contexts != START)
        out = []
        for batch, key, doc in zip(b.batches, b.key, b.doc, strict=True):
            at, there = _places(b.cell, key)
            u, w = key // len(b.words), key % len(b.words)
            c, t = (np.where(there, x[at], 0) if len(b.cell) else np.zeros(len(key)) for x in (b.c, total))
            p = np.log10(predictive(c, t, customers[u], tables[u], p0[w], theta, d))
            docs = _different(doc)
            place = np.searchsorted(docs, doc)
            out.append((batch, _pack(docs, np.bincount(place, weights=p), np.bincount(place, weights=base[u]), np.bincount(place, weights=known[u]).astype(np.uint32))))
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([rows.column("block")[0].as_py()] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], schema=schema)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _gather(n: int, v: int, ends: int):
    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        out = []
        packed = sums.column("packed").to_pylist()
        # in order of the blocks, so that runs add alike
        packed = [packed[i] for i in np.argsort(sums.column("block").to_numpy(), kind="stable")]
        for x in docs.column("packed").to_pylist():
            ids, null, held, size = _unpack(x)
            m = len(ids)
            score, base, known = np.zeros(m), np.full(m, np.log10((ends + 1) / (n + v + 1))), np.full(m, int(ends > 0), np.int64)
            for at, p, b, k in map(_unpack, packed):
                score[at] += p
                base[at] += b
                known[at] += k
            out.append(pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "held_out": held.astype(bool), "n_tokens": size, "n_known": known, "train_tokens": np.full(m, n, np.int64), "base_score": base, "score": score}))
        if not out:
            return pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        return pa.concat_tables(out)

    return run


def _by_word(rows, column: str = "n") -> tuple[np.ndarray, ...]:
    """Hot contexts' numbers summed over their parts, sorted by context."""
    parts = [_unpack(r[column]) for r in rows]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return words, *[np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=len(words)) for i in range(1, len(parts[0]))]


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))


def lm_scores(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every document.

    Ids whose crc32 leaves 2 modulo 7 are held out of training. Null and empty texts
    have the end token alone; repeated rows each count and each return; without training
    text every token is unknown; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    held = crc32_mod(F.col("doc_id"), FOLDS) == HELD
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = cut_clean(rows.where("not held_out").select("text").mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("h") == int(END), F.col("c"))), F.lit(0))).first()
    top = counts.orderBy(F.desc("c"), "h").limit(CODES).toArrow()  # at most 65,535 rows: words that travel in two bytes
    code_hashes = top.column("h").to_numpy()
    by_hash = np.argsort(code_hashes)
    coded = spark.sparkContext.broadcast((code_hashes[by_hash], by_hash, code_hashes))
    # contexts of over a fourth of a block: at most four times as many as blocks
    most = max(block_tokens // 4, 1)
    hot = {int(START if r["h"] == int(END) else r["h"]): -(-r["c"] // most) for r in counts.where(F.col("c") > most).collect()}  # starts are as many as ends
    hot_words = np.array(sorted(hot), np.int64)
    hot_parts = np.array([hot[int(w)] for w in hot_words], np.int64)
    blocks = int(n // block_tokens + 1)
    with planned_once(spark):  # the stored rows stay dealt by block
        dealt = cut_clean(rows.mapInArrow(_encoder(coded, hot_words, hot_parts, blocks), "block long, batch long, packed binary").repartition(blocks, "block"))
    tokens = dealt.where("block >= 0")

    def stats(told: DataFrame) -> tuple[np.ndarray, tuple, tuple]:
        got = told.where("r < -1").select("r", "n").collect()  # a few rows a block, of a few numbers each
        sums = np.sum([_unpack(x["n"])[0] for x in got if x["r"] == -2], axis=0) if got else np.zeros(2)
        return sums, _by_word([x for x in got if x["r"] == -3]), _by_word([x for x in got if x["r"] == -4])

    told = cut_clean(tokens.groupBy("block").applyInArrow(_first(coded, hot_words, blocks), _TOLD))
    (ones, twos), (found, hot_c, hot_t), _ = stats(told)
    d = discount(ones, twos)
    theta, rng, mean_t = 10.0, np.random.default_rng(11), hot_t
    for number in range(ROUNDS + 1):
        answered = cut_clean(told.where("r >= 0").groupBy("r").applyInArrow(_parent, _TOLD + ", all long, ones long, twos long"))
        customers, ones, twos = (x or 0 for x in answered.agg(F.sum("all"), F.sum("ones"), F.sum("twos")).first())
        parent = (customers, v, discount(ones, twos))
        answers = answered.drop("all", "ones", "twos").unionByName(told.where("r = -1"))
        if number == ROUNDS:
            break
        told = cut_clean(tokens.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_seat(coded, found, hot_c, hot_t, parent, theta, d, number, blocks), _TOLD))
        (y, logx), (found, hot_c, hot_t), (_, mean_t, *_) = stats(told)
        more = auxiliary(hot_c, hot_t, theta, d, rng)
        theta_scored = theta  # the seating was drawn under it
        theta = float(np.clip(rng.gamma(1 + y + more[0], 1 / (0.1 - logx - more[1])), 1e-2, 1e4))
    scored = tokens.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(coded, found, hot_c, mean_t, parent, theta_scored, d, n, v), "batch long, block long, packed binary")
    return dealt.where("block < 0").select("batch", "packed").groupBy("batch").cogroup(scored.groupBy("batch")).applyInArrow(_gather(n, v, ends), _SCORES)
