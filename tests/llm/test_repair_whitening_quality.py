"""Whitening, conversation repair and the quality classifier against brute force, exact arithmetic and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm import boosting, queries, turn_repair, whitening
from ledgerloom.llm.turn_repair import ASSISTANT, ENDS, START, STATES, SYSTEM, USER

SF = "/root/testdata/sf0.001"

# ------------------------------------------------------------------ conversation repair


def plain_repair(rows):
    """Least (cost, audit) of all edits by filling the whole table, row by row."""
    after, end = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}, {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    best = {START: (0, "")}

    def relax(to, s, label):
        if s not in to or label < to[s]:
            to[s] = label

    def insertions(at):
        for _ in range(6):
            for s, (c, a) in list(at.items()):
                relax(at, end["a" if s == USER else "u"], (c + 3, a + "I"))

    insertions(best)
    for initial, fault in rows:
        new = {}
        for s, (c, a) in best.items():
            relax(new, s, (c + 4, a + "D"))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if initial and initial in after[s]:
                    relax(new, end[initial], (c + more, a + "K"))
                relax(new, end["a" if s == USER else "u"], (c + 3 + more, a + "R"))
        insertions(new)
        best = new
    return min(best[s] for s in (START, ASSISTANT) if s in best)


def plain_report(rows):
    """The contract in plain words, for rows (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = plain_repair(list(zip(initials, faults, strict=True)))
    out, i = [], 0
    for x in audit:
        role, text = (rows[i][1], rows[i][2]) if x != "I" else ("", "")
        i += x != "I"
        if x in "RI":
            role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if x != "D":
            out.append((role, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), wrong, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def test_search_equals_the_full_table():
    random.seed(4)
    names = {"": "", "b": "blank", "d": "duplicate", "t": "truncated"}
    for _ in range(3000):
        rows = [(random.choice("suauax"), random.choice(["", "", "", "b", "d", "t"])) for _ in range(random.randrange(0, 12))]
        want = plain_repair([(r, names[f]) for r, f in rows])
        assert turn_repair.cheapest(rows, START, ENDS)[:2] == want
        k, product = random.randrange(0, len(rows) + 1), None
        for part in (rows[:k], rows[k:]):
            product = turn_repair.multiply(product, turn_repair.block_matrix(part))
        assert min(product[START, e] for e in ENDS if (START, e) in product) == want
    assert all(turn_repair.cheapest([], a, (a,)) == (0, "", a) for a in STATES)


def same_reports(spark, rows, schema="conv_id long, turn long, role string, text string, cost int, at string"):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], schema)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair_damaged(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    want = {k: plain_report(v) for k, v in plain_damage(rows).items()}
    assert got == want
    return df


def test_repair_equals_plain_rules(spark):
    random.seed(9)
    texts = ["Yes.", "no", "Really?! \n", " ", None, "", " ", "é☃. ", "a.b", "Long " * 50 + "end."]
    rows = [(random.choice([None, *range(60)]), random.choice([None, *range(-2, 12)]), random.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool"]), random.choice(texts)) for _ in range(900)]
    rows += [(1000 + k, 0, "user", "only") for k in range(60)]  # some lose all their rows
    df = same_reports(spark, rows)
    assert turn_repair.repair_damaged(df.limit(0)).count() == 0


def test_one_conversation_over_many_tasks_and_blocks(spark):
    random.seed(11)
    rows = [(7, t, random.choice(["user", "assistant"]) if random.random() < 0.2 else ("user", "assistant")[t % 2], random.choice([f"Line {t}.", f"line {t}", "Same."]) + "x" * (t % 7)) for t in range(6000)]
    same_reports(spark, [*rows, (7, None, "system", "S."), (8, 1, "user", "Hi.")])


def test_turns_follow_the_audits(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "assistant", "B."), (1, 2, "user", "c"), (2, 0, "system", "S."), (3, 0, "user", " "), (4, 0, "system", "S."), (4, 1, "user", "U."), (4, 2, "assistant", "A.")]
    fixed = turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    report = {r["conv_id"]: (r["cost"], r["audit"]) for r in fixed.report.collect()}
    by = {}
    for r in fixed.turns.orderBy("conv_id", "run", "step").collect():
        by.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert report[4] == (0, "KKK") and [x[1] for x in by[4]] == ["system", "user", "assistant"]
    assert report[2] == (4, "D") and report[3] == (4, "D") and 2 not in by and 3 not in by
    assert [x[1] for x in by[1]] == ["user", "assistant"] * (len(by[1]) // 2) and "".join(x[0] for x in by[1]) == report[1][1].replace("D", "")


# ------------------------------------------------------------------ whitening


@pytest.mark.parametrize("kind", ["plain", "graded", "rising", "orthonormal", "clusters", "low rank", "nearly one direction"])
@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_singular_values_and_directions(kind, d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(4 * d, d))
    a = {
        "plain": a, "graded": a * np.logspace(0, -6, d), "rising": a * np.logspace(-6, 0, d), "orthonormal": np.linalg.qr(a)[0], "clusters": np.linalg.qr(a)[0] * np.repeat([3.0, 2.0, 1.0], -(-d // 3))[:d],
        "low rank": a * (np.arange(d) < 2), "nearly one direction": a[:, :1] + 1e-4 * a,
    }[kind]
    s, v = whitening.directions(np.linalg.qr(a, mode="r"), 8)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    k = v.shape[1]
    assert k == min(8, d, 2 if kind == "low rank" else d)
    assert np.allclose(s[:k], want[:k], rtol=1e-9) and np.abs(v.T @ v - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(a.T @ (a @ v) - v * s[:k]) < 1e-13 * d * want[0]


def whiten_rows(spark, vectors):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in vectors], "vec_id long, embedding array<double>, n string, component int")
    out = {}
    for r in whitening.whiten(df).collect():
        out.setdefault((r["vec_id"], r["component"]), []).append(r)
    return df, out


def test_whitening_equals_exact_sums_and_eigh(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.2
    vectors = [(i if i else None, v.tolist()) for i, v in enumerate(base)] + [(5, base[5].tolist())]
    odd = [(900, None), (901, [None, *base[0][1:].tolist()]), (902, [float("nan"), *base[0][1:].tolist()]), (903, [float("inf"), *base[0][1:].tolist()]), (904, [])]
    _, out = whiten_rows(spark, vectors + odd)
    x = np.floor(np.array([v for _, v in vectors]) * 1024).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    c = x - x.mean(axis=0)
    cov = c.T @ c / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    w = c @ vec[:, :8] / np.sqrt(e[:8])
    assert set(out) == {(k, j) for k, _ in vectors for j in range(1, 9)} and len(out[5, 1]) == 2
    signs = {}
    for i, (k, _) in enumerate(vectors):
        dev = int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True)))
        for j in range(8):
            r = out[k, j + 1][0]
            assert r["n"] == n and r["deviation"] == dev and abs(r["explained"] - e[j] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-10
            sign = signs.setdefault(j, np.sign(r["whitened"] * w[i, j]))
            assert abs(r["whitened"] - sign * w[i, j]) < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whiten_rows(spark, [])[1] == {} and whiten_rows(spark, [(1, None), (2, [])])[1] == {}
    assert whiten_rows(spark, [(1, [1.0, 2.0])])[1] == {} and whiten_rows(spark, [(k, [0.5, 0.5]) for k in range(9)])[1] == {}
    _, out = whiten_rows(spark, [(k, [float(k), 0.0, 2.0 * k]) for k in range(4)] + [(9, [1.0])])  # one direction; one vector of another length
    assert set(out) == {(k, 1) for k in range(4)}
    # deviations beyond a long are null, all others exact
    _, out = whiten_rows(spark, [(0, [1e12, 1.0]), (1, [2.0, 3.0]), (2, [1.0, 5.0])])
    x = [[int(1024 * c) + 100_000 for c in v] for v in ([10**12, 1], [2, 3], [1, 5])]
    exact = [sum((3 * a - sum(col)) ** 2 for a, col in zip(v, zip(*x, strict=True), strict=True)) for v in x]
    assert [out[k, 1][0]["deviation"] for k in range(3)] == [v if v < 2**63 else None for v in exact] and None in [out[k, 1][0]["deviation"] for k in range(3)]


def test_whitening_of_given_vectors(spark):
    rows = queries.op11_embedding_whitening(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(rows) == 8 * n and {r["n"] for r in rows} == {n} and max(r["identity_error"] for r in rows) < 1e-9
    w = {j: np.array([r["whitened"] for r in rows if r["component"] == j]) for j in (1, 2)}
    assert abs(w[1].std() - 1) < 1e-9 and abs((w[1] * w[2]).mean()) < 1e-9


# ------------------------------------------------------------------ quality


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(2000, 5)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.grow(x, y)

    def walk(row):
        z = trees["base"]
        for at in trees["root"]:
            while trees["left"][at] != at:
                at = trees["left" if row[trees["feature"][at]] <= trees["threshold"][at] else "right"][at]
            z += trees["value"][at]
        return 1 / (1 + np.exp(-z))

    p = boosting.predict(x, trees)
    assert np.allclose(p[:200], [walk(r) for r in x[:200]]) and ((p >= 0.5) == y).mean() > 0.98


def test_split_equals_brute_force():
    rng = np.random.default_rng(6)
    x, grad, hess = rng.integers(0, 20, (400, 3)).astype(float), rng.normal(size=400), rng.uniform(0.1, 1, 400)
    edges = boosting.bin_edges(x)
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)
    gain, f, b = boosting._best_split(boosting._histogram(binned, np.arange(400), grad, hess))
    part = lambda k: grad[k].sum() ** 2 / (hess[k].sum() + boosting.L2)
    every = [(part(x[:, j] <= t) + part(x[:, j] > t) - part(np.full(400, True)), j, t) for j in range(3) for t in edges[j] if min((x[:, j] <= t).sum(), (x[:, j] > t).sum()) >= boosting.LEAST_ROWS]
    best = max(every)
    assert abs(best[0] - gain) < 1e-9 and best[1] == f and best[2] == edges[f][b]


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op13_quality_classifier(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None and r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    bad, good = [p for p, q in held if q == 0], [p for p, q in held if q == 1]
    assert len(bad) > 100 and 1 - np.mean(bad) > 0.97 and np.mean(good) > 0.99


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 200_000), (4, "word " * 200_000), (None, "A sentence."), (5, "é ☃ 中文 ퟿!"), (6, "$$$ %%% ###")]
    docs = spark.createDataFrame([(i, t, 0.5, "y") for i, t in rows], "doc_id long, text string, score double, h string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = boosting.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert boosting.quality_scores(docs.limit(0), labels).count() == 0 and {r["score"] for r in boosting.quality_scores(docs, labels.limit(0)).collect()} == {boosting.predict(np.zeros((1, len(boosting.FEATURES))), boosting.fit(docs, labels.limit(0)))[0]}
    assert boosting.keep_good(docs, labels.limit(0)).columns == docs.columns and boosting.keep_good(docs, labels.limit(0)).count() == len(rows)
    assert len(boosting.statistics("x")) == len(boosting.FEATURES) and np.isfinite([boosting.statistics(t) for _, t in rows]).all()
