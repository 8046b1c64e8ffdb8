"""The language model of all words."""

import re
import zlib
from collections import Counter

import numpy as np

from ledgerloom.llm import hpy_words

SF = "/root/testdata/sf0.001"


def test_counts_and_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, " \n "), (None, "THE the")], "doc_id long, text string"))
    rows = docs.collect()
    words = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in rows]
    out_of = [zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2 for r in rows]
    c = Counter(w for ws, o in zip(words, out_of, strict=True) if not o for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in hpy_words.lm_scores(docs, 2000).collect()}
    assert len(got) == len(rows)
    for r, ws, o in zip(rows, words, out_of, strict=True):
        g, t = got[r["doc_id"]], [*ws, None]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (o, len(t), sum(c[w] > 0 for w in t), n)
        assert abs(g["base_score"] - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * len(t)
    held = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)
    assert hpy_words.lm_scores(docs.limit(0)).count() == 0
    assert hpy_words.lm_scores(docs.where("doc_id = 2")).count() <= 1


def test_rare_words_are_contexts(spark):
    """3,000 pairs of words, none more frequent than another: a text in the order that training has is likelier than the same words in another."""
    rng = np.random.default_rng(3)
    pairs = [(f"a{i}", f"b{i}") for i in range(3000)]
    fits = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(k, " ".join(f"{a} {b}" for a, b in (pairs[j] for j in rng.permutation(3000)[:300]))) for k in fits[:60]]
    some = [pairs[j] for j in rng.permutation(3000)[:200]]
    rows += [(held[0], " ".join(f"{a} {b}" for a, b in some)), (held[1], " ".join(f"{a} {b}" for (a, _), (_, b) in zip(some, some[1:] + some[:1], strict=True)))]
    got = {r["doc_id"]: r for r in hpy_words.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), 3000).collect()}
    assert np.isclose(got[held[0]]["base_score"], got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 200


def test_blocks_and_parts_of_hot_contexts_change_little(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = ({r["doc_id"]: r for r in hpy_words.lm_scores(docs, size).collect()} for size in (10**9, 1000))  # the second deals the most frequent words into parts
    a, b = (np.array([x[k]["score"] / x[k]["n_tokens"] for k in sorted(one)]) for x in (one, many))
    assert np.abs(a - b).mean() < 0.01 * np.abs(a).mean()
    assert all(np.isclose(one[k]["base_score"], many[k]["base_score"], atol=1e-6) and one[k]["n_known"] == many[k]["n_known"] for k in one)


def test_probabilities_sum_to_one():
    c0 = np.array([5, 1, 1, 2])
    parent = (int(c0.sum()), 4, 0.4)
    p0 = hpy_words.parent_predictive(c0.astype(float), parent)
    unseen = hpy_words.parent_predictive(np.zeros(1), parent)[0]
    assert np.isclose(p0.sum() + unseen, 1)
    c, t = np.array([4, 0, 1, 0]), np.array([2, 0, 1, 0])
    p = hpy_words.predictive(c, t, 5, 3, p0, 1.5, 0.3)
    assert np.isclose(p.sum() + hpy_words.predictive(0, 0, 5, 3, unseen, 1.5, 0.3), 1)


def test_packing_returns_what_it_got():
    arrays = [np.arange(5), np.zeros(0, np.float64), np.array([1, 2], np.uint16)]
    for a, b in zip(arrays, hpy_words._unpack(hpy_words._pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_encoding_holds_few_bytes_a_token(monkeypatch):
    """What a task holds while it sorts the tokens of a slice; two such tasks share an executor's memory."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(2000)])
    texts = [" ".join(words[rng.integers(0, 2000, 1000)]) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([k % 7 == 2 for k in range(1000)]), pa.array(texts)], names=["doc_id", "held_out", "text"])
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(hpy_words, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = hpy_words._encoder(SimpleNamespace(value=(none, none, none)), none, none, 10)
    list(run(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 11 and peak < 60 * 1001 * 1000
