import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash as sh


def brute(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t ", "one", "One two", "a b c"]
    for _ in range(25):
        base = list(rng.choice(vocab, 150))
        for j in range(8):
            t = list(base)
            for _ in range(j % 4):
                t[rng.integers(len(t))] = "x" + str(rng.integers(9))
            texts.append(" ".join(t))
    rows = [(i, t, "extra", "zz") for i, t in enumerate(texts)] + [(3, "one", "again", "q"), (None, "One two", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, key string")
    fps = [brute(t) for _, t, _, _ in rows]
    ids = [r[0] for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    low = {}
    for i, r in enumerate(roots(len(rows), links)):
        low.setdefault(r, []).append(i)
    want = sorted(((ids[i] if ids[i] is not None else -1), f"{fps[i]:016x}", min(ids[k] for k in m if ids[k] is not None)) for m in low.values() for i in m)
    for block in (4096, 4):
        got = sorted(((r[0] if r[0] is not None else -1), r[1], r[2]) for r in sh.simhash_classes(df, block=block).collect())
        assert got == want


def test_empty_table(spark):
    assert sh.simhash_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("groups", [6, 8])
def test_pivot_keys_meet_for_every_flip(spark, groups):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    rows = []
    for i, b in enumerate(base):
        for _ in range(5):
            bits = rng.choice(64, 3, replace=False)
            x = (b & (2**64 - 1)) ^ sum(1 << int(k) for k in bits)
            rows.append((i, b, x - 2**64 if x >= 2**63 else x))
    df = spark.createDataFrame(rows, "i int, a long, b long")
    a = sh.with_pivot_keys(df.selectExpr("i", "a", "b", "a AS fp"), 3, groups)
    b = sh.with_pivot_keys(df.selectExpr("i AS i2", "a AS a2", "b AS b2", "b AS fp"), 3, groups).drop("fp")
    met = a.join(b, (a["key"] == b["key"]) & (a["i"] == b["i2"]) & (a["b"] == b["b2"]))
    assert met.select("i", "b").distinct().count() == df.select("i", "b").distinct().count()


def test_drop_near_duplicates(spark):
    words = [f"tok{i}" for i in range(200)]
    a = " ".join(words)
    b = " ".join([*words[:100], "changed", *words[101:]])
    c = " ".join(words[::-1])
    rows = [(5, a, "x"), (2, b, "y"), (7, a, "z"), (9, c, "x"), (11, "", "x"), (12, None, "x"), (9, c, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in sh.drop_near_duplicates(df).collect()) == [2, 9, 11, 12]


@pytest.mark.parametrize("block", [4096, 8])
def test_near_duplicates_equal_brute_force_jaccard(spark, block):
    """Appended text, edits and small texts around a similarity of 0.8; buckets cut into parts."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [None, "", " ", "one", "One  two", "one two", "a b c d e"]
    for k in range(40):
        base = list(rng.choice(vocab, [40, 200, 900][k % 3]))
        line = "this very line stands in every one of the texts here".split()
        texts.append(" ".join(base + line))
        for share in (0.05, 0.1, 0.15, 0.2, 0.24, 0.25, 0.26, 0.3):
            texts.append(" ".join(base + line + list(rng.choice(vocab, int(share * len(base))))))
            edited = base + line
            for at in rng.choice(len(base), max(1, int(share * len(base) / 9)), replace=False):
                edited[at] = "new"
            texts.append(" ".join(edited))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    want = {}
    for i, r in enumerate(roots(len(sets), links)):
        if sets[i]:
            want.setdefault(r, []).append(i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sh.near_duplicate_roots(df, block=block).collect():
        got.setdefault(r.root, []).append(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pipeline_drops_by_fingerprint(spark):
    """The stage links what simhash_classes links, by its index, and keeps the first of each class."""
    import corpus_pipeline

    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n"]
    for _ in range(60):
        base = list(rng.choice(vocab, 120))
        texts += [" ".join(base), " ".join(base), " ".join([*base, "more"]), " ".join(["new", *base[1:]]), " ".join(base[40:])]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    own = sh.simhash_classes(df.where("doc_id > 2")).where("doc_id = component_id").select("doc_id")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").select("doc_id").collect()]
    assert sorted(got) == [0, 1, 2, *sorted(r.doc_id for r in own.collect())]
    assert 60 < len(got) < len(texts) - 60
