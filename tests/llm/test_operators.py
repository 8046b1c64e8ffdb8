"""Operators against brute force on small inputs; nulls, ties, repeats, empty tables, clashing columns."""

import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from ledgerloom.llm import chat, chunk_dedup, decontaminate, embed_dedup, html_extract, hpy_lm, mixing, queries, token_files, toxicity

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ decontamination


def test_masks_are_lossless():
    for n in range(8, 17):
        most = n - int(np.ceil(0.8 * n))
        for bad in itertools.combinations(range(n), most):
            assert any(all(i + o not in bad for o in m) for m in decontaminate.MASKS for i in range(n - m[-1]))


def brute_items(text, items):
    tok = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    d, out = tok(text), []
    for k, t in items:
        w = tok(t)
        n = len(w)
        if not n:
            continue
        s = min(n, 16)
        need = n if n < 8 else int(np.ceil(0.8 * s))
        if any(sum(0 <= a + g < len(d) and d[a + g] == w[a] for a in range(i, i + s)) >= need for g in range(-n, len(d)) for i in range(n - s + 1)):
            out.append(k)
    return sorted(set(out))


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = [f"b{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(v, n))) for i, n in enumerate([3, 5, 8, 9, 12, 15, 16, 30, 60, 7])] + [(50, None), (51, ""), (52, "..."), (0, "only one")]
    docs = []
    for i, t in items[:10]:
        w = t.split()
        for subs in (0, 1, 2, 4, 9):
            x = list(w)
            for p in rng.choice(len(x), min(subs, len(x)), replace=False):
                x[p] = "z"
            docs.append(" ".join([*rng.choice(v, 20), *x, *rng.choice(v, 15)]).replace("b1 ", "B1, "))
        docs += [" ".join(w[: len(w) // 2]), " ".join([*w[:9], *rng.choice(v, 40)])]
    docs += [None, "", docs[0], "Only, one"]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1, "s") for i, t in enumerate(docs)], "doc_id long, text string, item_id int, h string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(df, it).collect()}
    assert got == {(i if i != 3 else None): brute_items(t, items) for i, t in enumerate(docs)}
    assert decontaminate.decontaminate(df, it).count() == sum(not x for x in got.values())
    assert decontaminate.contamination(df, it.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), it).count() == 0


def test_decontamination_of_repeated_words_and_lines(spark):
    """One word or phrase over and over on both sides, and stretches over the seams of blocks."""
    rng = np.random.default_rng(11)
    v = [f"r{i}" for i in range(300)]
    line = list(rng.choice(v, 12))
    items = [(0, "a " * 40), (1, "a b " * 20), (2, "a b c d e " * 6), (3, " ".join(line * 3)), (4, "a " * 5), (5, "a b " * 4), (6, " ".join(rng.choice(v, 90)))]
    passage = items[6][1].split()
    docs = ["a " * 3_000, "a b " * 1_000, "b a " * 9, "a b c d e " * 500, " ".join(line * 200), " ".join(line), "a " * 15, "a " * 13 + "z z z", "a " * 4, "z " * 50 + "a " * 16 + "z " * 50, "a b a c " * 100]
    for before in (0, 1, 47, 48, 49, 50, 63, 64, 65, 113, 128):
        docs.append(" ".join([*rng.choice(v, before), *passage[20:33], "z", "z", "z", *rng.choice(v, 30)]))
        docs.append(" ".join([*rng.choice(v, before), *passage[20:32], "z", "z", "z", "z", *rng.choice(v, 30)]))
        docs.append(" ".join([*rng.choice(v, before), *passage[74:]]))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(df, it).collect()}
    assert got == {i: brute_items(t, items) for i, t in enumerate(docs)}
    assert got[0] and got[1] and got[3] and got[4] and any(6 in x for x in got.values())
    long = spark.createDataFrame([(1, "a " * 20_000)], "doc_id long, text string")
    same = spark.createDataFrame([(1, "a " * 20_000)], "item_id long, text string")
    assert decontaminate.contamination(long, same).first()["agreeing"] == 16


# ------------------------------------------------------------------ chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "&lt;s&gt;", "<s>assistant[RESP] x [/RESP]</s>", "&amp;#91;", "[", "<", "", None, " a ", "x" * 50_000, "\n&<[", "é☃", "[/RESP]"]
    rows = [(c, k, r, t) for c in (1, 2, None) for k, (t, r) in enumerate(zip(nasty, itertools.cycle(["user", "assistant", "sys<t>[x]", None]), strict=False))] + [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (9, None, "assistant", "n")]
    rows += [(20, 0, "user", "a & b < c [1]"), (20, 1, "assistant", "[plain] <text>"), (21, 0, "user", "a & b"), (21, 1, "assistant", "<s>")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, source string, formatted int")
    out = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert len(out) == 6 and all(r["round_trip"] for r in out.values())
    # what the parser reads back as it is stays as it is; only turns that differ are escaped
    assert out[20]["rounds"] == 1 and out[20]["formatted"] == "<s>user[INST] a & b < c [1] [/INST]</s><s>assistant[RESP] [plain] <text> [/RESP]</s>"
    assert out[21]["rounds"] == 2 and out[21]["formatted"] == "<s>user[INST] a & b [/INST]</s><s>assistant[RESP] &lt;s> [/RESP]</s>"
    for r in out.values():
        turns = sorted(((t if t is not None else -1, ro or "", te or "") for c, t, ro, te in rows if c == r["conv_id"]), key=lambda x: x)
        assert [(t["role"], t["text"], t["loss"]) for t in r["turns"]] == [(ro, te, ro == "assistant") for _, ro, te in turns]
    digest = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chats(df)).collect()}
    assert digest[1]["loss_chars"] == sum(len(t or "") for c, _, r, t in rows if c == 1 and r == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


# ------------------------------------------------------------------ html


def article(page):
    m = re.search(r"<article>(.*)</article>", page, re.S)
    import html

    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", m[1])).split()) if m else ""


def test_article_text_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r for r in html_extract.extract_pages(pages).collect()}
    assert all(got[k]["text"] == t and got[k]["n_chars"] == len(t) for k, t in want.items())


def test_pages_without_an_article(spark):
    text = "This is the story of a man who was on the road for a long time and it has the words that a reader would know from any page in this language. " * 2
    page = f"<body><div id='top-menu'><a href=/>Home</a> <a href=/b>News of the day</a></div><ul><li><a href=/a>One of the links here</a></li></ul><div><h2>A heading</h2><p>{text}</p><p>Short one.</p><p>{text}</p></div><div class='comments-list'><p>{text}</p></div><div class=cookie-notice>We use it on this page</div><form><label>Name of the user</label></form><p>&copy; 2020</p></body>"
    assert html_extract.main_text(page) == " ".join(f"A heading {text} Short one. {text}".split())
    for odd in (None, "", "   ", "<", "<p", "<!-- never closed <p>x</p>", "<script>var a='<p>';", "<nav>only a menu</nav>"):
        assert html_extract.main_text(odd) == ""
    assert html_extract.main_text("<main><p>a&nbsp;&amp;\n b<b>old</b><br>c<p>d</main><footer>x") == "a & bold c d"
    df = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_extract.extract_pages(df).collect()] == [(1, None, "", 0)] * 2


def naive_rules(blocks):
    """The two passes in the plainest form, for pages without an article: (text, tag, link share, boilerplate)."""
    first = []
    for text, _, links, boiler in blocks:
        stops = [w for w in text.lower().split() if w.strip(".,;:!?") in html_extract.STOP_WORDS]
        share = len(stops) / len(text.split())
        if boiler or links > 0.4:
            first.append("bad")
        elif len(text) < 70:
            first.append("short" if links == 0 else "bad")
        elif share >= 0.15:
            first.append("good" if len(text) > 200 else "near")
        else:
            first.append("near" if share >= 0.08 else "bad")
    out = []
    for i, (x, (text, tag, _, _)) in enumerate(zip(first, blocks, strict=True)):
        before = next((y for y in reversed(first[:i]) if y in ("good", "bad")), None)
        after = next((y for y in first[i + 1 :] if y in ("good", "bad")), None)
        near = {before, after} - {None}
        if x in ("good", "bad"):
            keep = x == "good"
        elif tag == "h2":
            keep = after == "good"
        elif x == "near":
            keep = "good" in near or not near
        else:
            keep = near == {"good"} or not near and len(blocks) == 1
        if keep:
            out.append(text)
    return " ".join(out)


def test_two_passes_equal_the_plain_rules():
    rng = np.random.default_rng(9)
    plain, stop = ["garden", "window", "harvest", "lantern", "copper", "meadow"], ["the", "of", "and", "to", "in"]
    rules = set()
    for _ in range(400):
        blocks, page = [], ""
        for _ in range(int(rng.integers(1, 9))):
            n, share = int(rng.choice([3, 8, 15, 45])), rng.choice([0, 0.1, 0.4])
            text = " ".join(rng.choice(stop if rng.random() < share else plain) for _ in range(n))
            tag, link, boiler = rng.choice(["p", "h2", "td"]), rng.random() < 0.2, rng.random() < 0.15
            blocks.append((text, tag, float(link), boiler))
            body = f"<a href='/x'>{text}</a>" if link else text
            block = f"<{tag}>{body}</{tag}>"
            page += f"<nav>{block}</nav>" if boiler else block
        assert html_extract.main_text(page) == naive_rules(blocks)
        rules |= {(x, rule) for _, x, rule, _ in html_extract.decisions(page)}
    assert {("bad", "links"), ("short", "length"), ("good", "stop words"), ("near", "stop words"), ("bad", "stop words"), ("bad", "boilerplate")} <= rules


def test_hostile_pages_take_linear_time():
    import time

    for sign in ("<svg", "<a \"", "<div>", "<", "<!--", "</", "<p class=\"", "<p a='", "<x =", "<script>", "&lt;", "<b a=\"b\" "):
        page = sign * (1_000_000 // len(sign))
        began = time.time()
        html_extract.main_text(page)
        assert time.time() - began < 8, sign
    assert html_extract.main_text("a < b and <b>c</b> <3 x") == "a < b and c <3 x"
    assert html_extract.main_text("<main><p title=\"a > b\">Text</p><svg/>after</main>") == "Text after"


# ------------------------------------------------------------------ mixing


def test_mixing_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " w" * int(rng.integers(0, 60)), s, "z") for i, s in enumerate(rng.choice(["a", "b", "c", "d", None], 900, p=[0.05, 0.5, 0.3, 0.1, 0.05]))]
    rows += [(None, "x y", "a", "z"), (5, None, "b", "z"), (7, "x y z", "b", "z"), (7, "x y z", "b", "z"), (8, "", "empty", "z"), (9, "w " * 100_000, "long", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby(got["source"].fillna("~")).agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["most"] / 2 + 1e-6).all()
    assert np.isclose(by["target"].sum(), by["size"].sum())
    again = mixing.mix(df.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_draws_in_proportion_to_size(spark):
    rng = np.random.default_rng(13)
    sizes = [*rng.choice([10, 40], 6000).tolist(), 60_000, 50_000]
    df = spark.createDataFrame([(i, "w " * int(n), s) for s in ("a", "b") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    b = got[got["source"] == "b"]  # 2 of 7 parts of all, so about 0.57 of its own size
    rest = b["target"].iloc[0]
    assert rest < b["size"].sum() and (b["copies"] <= 1).all()
    sure = b[b["size"] >= 50_000]
    assert (sure["copies"] == 1).all()  # they would be drawn with more than 1
    drawn = b[b["size"] < 50_000]
    p = (rest - sure["size"].sum()) / (drawn["size"] ** 2).sum()
    for n in (10, 40):
        k = drawn[drawn["size"] == n]["copies"]
        assert abs(k.mean() - p * n) < 4 * np.sqrt(p * n * max(1 - p * n, 0.01) / len(k)) + 0.01


# ------------------------------------------------------------------ embeddings


@pytest.mark.parametrize(("block", "few"), [(2048, 1000), (70, 1)])
def test_embedding_links_equal_brute_force(spark, block, few):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 24)).astype(np.float32)
    dense = x[0] + 0.05 * rng.standard_normal((90, 24)).astype(np.float32)
    pairs = x[100:200] + 0.25 * rng.standard_normal((100, 24)).astype(np.float32)
    all_ = np.concatenate([x, dense, pairs, x[:5], x[:5]])
    rows = [(i, v.tolist(), 0, "n") for i, v in enumerate(all_)]
    rows += [(5000, None, 0, "n"), (5001, [0.0] * 24, 0, "n"), (5002, [float("nan")] * 24, 0, "n"), (5003, [None] + [1.0] * 23, 0, "n"), (5004, [], 0, "n"), (5005, [1.0, 2.0], 0, "n"), (5006, [2.0, 4.0], 0, "n"), (5007, [float("inf")] * 24, 0, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, codes string")
    got = {r["vec_id"]: r for r in embed_dedup.embedding_classes(df, trees=6, leaf=64, block=block, few=few).collect()}
    y = all_.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    have = np.array([got[i]["n_links"] for i in range(len(all_))])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    assert have[5] == want[5] and got[len(all_) - 1]["component_id"] == got[4]["component_id"]
    for i in (5000, 5001, 5002, 5003, 5004, 5007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[5006]["n_links"], got[5006]["component_id"], got[5006]["kept"]) == (1, 5005, False)
    assert embed_dedup.embedding_classes(df.limit(0)).count() == 0


# ------------------------------------------------------------------ toxicity


def test_toxicity_on_held_out_labels(spark, monkeypatch):
    d = "/root/testdata/sf0.1"  # about 100 held-out toxic documents; sf0.01 has six, two of them in languages with hardly a labelled one

    def held_out():
        labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null")
        h = toxicity.toxicity_scores(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").toPandas()
        a, b = h["score"][h["toxic"] == 1].to_numpy(), h["score"][h["toxic"] == 0].to_numpy()
        return (a[:, None] > b[None]).mean() + (a[:, None] == b[None]).mean() / 2, (a >= 0.5).mean(), (b >= 0.5).mean()

    auc, recall, false = held_out()
    assert auc > 0.94 and recall >= 0.85 and false <= 0.03
    # the label model's posteriors teach the classifier no less than the labels themselves
    fitted = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda votes, gold: (gold.astype(float), *fitted(votes, gold)[1:]))
    _, recall_bare, false_bare = held_out()
    assert recall >= recall_bare - 0.01 and false <= false_bare + 0.005


def test_label_model_weighs_voters():
    rng = np.random.default_rng(8)
    y = (rng.random(4000) < 0.2).astype(int)
    sure = np.where(rng.random(4000) < 0.9, y, 0)
    chance = (rng.random(4000) < 0.2).astype(int)
    gold = np.where(rng.random(4000) < 0.97, y, 1 - y)
    votes = np.stack([sure, sure, sure, chance], axis=1).astype(np.int8)
    q, probs, weight = toxicity.label_model(votes, gold)
    # three copies of a voter share their weight, a voter by chance tells nothing, the human label keeps its weight
    assert weight[:3].max() < 0.6 and weight[-1] == 1.0 and abs(np.log(probs[3, 1, 2] / probs[3, 0, 2])) < 0.3
    assert ((q >= 0.5) == y).mean() > (gold == y).mean()


def test_cut_of_shares_equals_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(50):
        s, g = np.round(rng.random(30), 1), rng.integers(0, 2, 30)
        if g[s > 0].min() == g[s > 0].max():
            continue
        errors = lambda t: ((s[s > 0] >= t) != (g[s > 0] == 1)).sum()
        assert errors(toxicity.best_cut(s, g)) == min(errors(t) for t in [0, *(np.unique(s) + 0.01)])
    assert toxicity.best_cut(np.zeros(3), np.array([0, 1, 1])) == 0.0


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (1, None, "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).count() == 4


# ------------------------------------------------------------------ language model


def test_lm_counts_and_mass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(9001, None, "", "", 0), (9002, " \n ", "", "", 0), (None, "THE the", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = docs.collect()
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for i, r in enumerate(rows)}
    out_of = [zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2 for r in rows]
    from collections import Counter

    c = Counter(w for i, ws in words.items() if not out_of[i] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in hpy_lm.lm_scores(docs, heads=200).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        g, t = got[r["doc_id"]], [*words[i], None]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (out_of[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(g["base_score"] - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * len(t)
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])
    model = hpy_lm.fit(docs.select("text"), heads=50)
    assert np.allclose((10.0 ** model["table"]).sum(axis=1), 1, atol=1e-3)
    rare_n, rare_v, d = model["rare"]
    assert np.isclose((rare_n - d * rare_v + 1 + d * rare_v) / (1 + rare_n), 1)
    assert hpy_lm.lm_scores(docs.limit(0)).count() == 0


def test_seating_matches_enumeration():
    d, theta, p, c, others = 0.4, 1.5, 0.2, 4, 3
    s = hpy_lm.log_stirling(d, 64)
    assert np.isclose(np.exp(s[3, 2]), 3 * (1 - d)) and np.isclose(np.exp(s[3, 1]), (1 - d) * (2 - d))
    logit = np.array([s[c, t] + sum(np.log(theta + d * (others + i)) for i in range(t)) + t * np.log(p) for t in range(1, c + 1)])
    want = np.exp(logit - logit.max())
    want /= want.sum()
    n = 20_000
    t = hpy_lm.sample_tables(np.full(n, c), np.full(n, p), np.full(n, others), theta, d, s, np.random.default_rng(0))
    assert np.allclose(np.bincount(t, minlength=5)[1:] / n, want, atol=0.015)


def test_sweeps_follow_the_joint_distribution():
    """A restaurant of two dishes: seatings of many sweeps against all pairs of table counts, weighed exactly."""
    d, theta, c, p = 0.4, 1.5, np.array([4, 3]), np.array([0.5, 0.2])
    s = hpy_lm.log_stirling(d, 64)
    cells = [(a, b) for a in range(1, 5) for b in range(1, 4)]
    logit = np.array([s[4, a] + s[3, b] + a * np.log(p[0]) + b * np.log(p[1]) + sum(np.log(theta + d * i) for i in range(a + b)) for a, b in cells])
    want = np.exp(logit - logit.max())
    want /= want.sum()
    n, rng = 4000, np.random.default_rng(1)  # restaurants side by side
    t, u_at = np.ones(2 * n, np.int64), np.repeat(np.arange(n), 2)
    for _ in range(12):
        hpy_lm.resample(t, np.tile(c, n), np.tile(p, n), u_at, theta, d, s, rng)
    pairs = t.reshape(-1, 2)
    got = np.array([((pairs[:, 0] == a) & (pairs[:, 1] == b)).mean() for a, b in cells])
    assert np.allclose(got, want, atol=0.03)


def test_articles_keep_all_their_text():
    main = html_extract.main_text
    assert main("<article><h2><a href=/a>Linked heading</a></h2><p><a href=/b>A paragraph of links</a> x</p><ul><li><a href=/c>item</a></ul><p>Text.</p></article>") == "Linked heading A paragraph of links x item Text."
    assert main("<div class='page has-sidebar'><article><p>Text.</p><div class=ad>Buy</div></article><div class=sidebar>Side</div></div>") == "Text."
    assert main("<div class=with-comments><main><p>Text.</p></main><div class=comments><article><p>A comment</p></article></div></div>") == "Text."
    assert main("<main><div class=has-sidebar><article><p>Text.</p></article><p>Side</p></div><p>End.</p></main>") == "Text. End."
    assert main("<div class=comments><article class=comment><p>A comment</p></article></div>") == ""
    for head in ("<head><title>T</title><meta charset=utf-8>", "<html><head><link rel=x><body class=sidebar>", "<head><script>x</script>"):
        assert main(f"{head}<article><p>Text.</p></article>") == "Text."
        assert main(f"{head}<nav>Menu</nav><main><p>Text.</p></main>") == "Text."
    assert main("<head><title>T</title></head><header>Top</header><main>Text.</main>") == "Text."


# ------------------------------------------------------------------ chunks


def test_boundaries_resist_insertions():
    g = chunk_dedup.gear_table()
    a = np.random.default_rng(0).integers(97, 123, 5000).astype(np.uint8)
    h = 0
    for i, b in enumerate(a[:300].tolist()):
        h = ((h << 1) + int(g[b])) & 0xFFFF
        assert h == chunk_dedup.gear_hashes(a[:300], g)[i]
    b = np.concatenate([a[:1000], np.frombuffer(b"inserted", np.uint8), a[1000:]])
    cuts = lambda x: {bytes(x[s:e]) for s, e in itertools.pairwise([0, *chunk_dedup.boundaries(x, g)])}
    assert len(cuts(a) - cuts(b)) <= 3
    assert chunk_dedup.boundaries(np.zeros(0, np.uint8), g) == []


def longest_common(a, b):
    """Words of the longest run that both have."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
        best, row = max(best, max(new)), new
    return best


@pytest.mark.parametrize("letters", ["abcdefgh", "aéßçñ中ü"])
def test_repeated_passages(spark, letters):
    rng = np.random.default_rng(6)
    v = np.array(["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(4000)])
    text = lambda n: " ".join(rng.choice(v, n))
    rows = []
    for k in range(40):  # passages of 51 words in two documents each, of 40 in two others
        p, q = text(51), text(40)
        rows += [f"{text(int(rng.integers(0, 80)))} {p} {text(40)}", f"{text(30)}\n{p}\n{text(int(rng.integers(0, 60)))}", f"{text(25)} {q} {text(20)}", f"{text(5)} {q} {text(30)}"]
    rows = list(enumerate(rows)) + [(900, None), (901, ""), (902, " "), (None, text(50)), (500, five := text(60)), (500, five), (950, text(20_000))]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "doc_id long, text string, words int, h string, _row int")
    got = chunk_dedup.passage_report(df).collect()
    assert len(got) == len(rows)
    words = {i: (t or "").split() for i, t in rows if i is not None and i < 160}
    want = {i for i in words if max(longest_common(words[i], words[j]) for j in range(i // 4 * 4, i // 4 * 4 + 4) if j != i) >= 45}
    assert want == {i for i in range(160) if i % 4 < 2}
    assert {r["doc_id"] for r in got if r["repeats"]} == want
    assert all(r["repeated_words"] == 51 for r in got if r["repeats"])
    cleaned = {r["doc_id"]: r["text"] for r in chunk_dedup.drop_repeats(df.where("doc_id < 160")).collect()}
    for i in range(160):
        a = rows[i][1].split()
        assert cleaned[i].split() == (a[:30] + a[81:] if i % 4 == 1 else a)
    assert chunk_dedup.drop_repeats(df).columns == df.columns
    assert {r["text"] for r in chunk_dedup.drop_repeats(df.where("doc_id >= 900")).collect()} == {t for i, t in rows if i and i >= 900}
    assert chunk_dedup.passage_report(df.limit(0)).count() == 0 and chunk_dedup.drop_repeats(df.limit(0)).count() == 0


def test_agreement_in_whole_words():
    f = chunk_dedup.agreement
    assert f(b"chunk two words x", b"chunk two words y", 5, 1) == (10, 2)
    assert f(b"chunks two", b"chunks two", 5, 1) == (5, 1)
    assert f(b"chunk tw", b"chunk to", 5, 1) == (0, 0)
    assert f(b"chunk", b"chunk and", 5, 1) == (0, 0) and f(b"chunk", b"chank", 5, 1) == (-1, 0)
    assert f(b"xx one two chunk", b"yy one two chunk", 5, 0) == (8, 2)
    assert f(b"one two chunk", b"one two chunk", 5, 0) == (8, 2)


# ------------------------------------------------------------------ token files


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-5, None), (-4, ""), (-4, "dup x it's 12 İ é  tab\tend <|endoftext|>"), (-4, ""), (None, " x "), (-3, "long " * 200_000)], "doc_id long, text string")
    )
    t = Tokenizer.from_file(queries.vocabulary())
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    place = lambda r: ((r["doc_id"] is not None, r["doc_id"] or 0), signed(xxhash.xxh64_intdigest((r["text"] or "").encode(), 42)) if r["text"] is not None else 42)
    rows = [(r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in sorted(docs.collect(), key=place)]
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, queries.vocabulary(), encoding=encoding, file_bytes=100_000)
    got = sorted((tuple(r) for r in token_files.token_digest(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect()), key=lambda r: r[0])
    starts = np.cumsum([0, *[len(i) for _, i in rows]])[:-1].tolist()
    assert got == [(s, d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for s, (d, i) in zip(starts, rows, strict=True)]
    assert token_files.read_token_files(spark, path).select("file").distinct().count() > 1
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(sorted(tmp_path.glob("ids/part-*"))[0]).metadata.row_group(0).column(2)
    assert meta.has_offset_index and (("RLE_DICTIONARY" in meta.encodings) == (encoding == "dictionary"))


def test_words_apart_have_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    rng = np.random.default_rng(8)
    signs = np.array(list("aZhHsS09''``,.!<=&-_~ \t\x0b\x1f\x85\u2028\u0338\u0331\u0307\u20e3éÉİßK中") + ["'ll", "'S", "re,", "it's", "5's", "<|endoftext|>", "<|ENDOFTEXT|>"], dtype=object)
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = [ids for b in token_files._encoder(queries.vocabulary(), 2)(iter([batch])) for ids in b.column(2).to_pylist()]
    assert got == [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark):
    """Each stage's rows against what its operator's report, or a brute-force version, says of the same input."""
    from collections import Counter

    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    clean = stages["toxicity"](spark, docs, SF).cache()
    scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(clean) == ids(scores.where("predicted = 0"))
    unique = stages["near-duplicates"](spark, clean, SF).cache()
    rows = sorted(clean.collect(), key=lambda r: r["doc_id"])

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    assert ids(unique) == Counter(r["doc_id"] for i, r in enumerate(rows) if root[i] == i or not sets[i])
    fresh = stages["decontamination"](spark, unique, SF).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(fresh) == Counter(r["doc_id"] for r in unique.collect() if not brute_items(r["text"], items))
    mixed = stages["mixing"](spark, fresh, SF).cache()
    assert ids(mixed) == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(fresh).collect() if r["copies"]})
    coded = stages["token ids"](spark, mixed, SF).collect()
    t = Tokenizer.from_file(queries.vocabulary())
    size = {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in fresh.collect()}
    assert Counter((r["doc_id"], r["n_tokens"]) for r in coded) == Counter((r["doc_id"], size[r["doc_id"]]) for r in mixed.collect())
    for x in (clean, unique, fresh, mixed):
        assert sorted(x.columns) == sorted(docs.columns) and x.count()
    assert corpus_pipeline.run(spark, SF).count() == len(coded)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_embedding_recall_on_the_tables(spark, sf):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.embedding_classes(table).select("vec_id", "n_links").collect()}
    pdf = table.select("vec_id", "embedding").toPandas()
    fine = pdf["embedding"].map(lambda e: e is not None and len(e) == len(pdf["embedding"].iloc[0]) and np.isfinite(np.asarray(e, np.float64)).all() and np.any(np.asarray(e) != 0))
    ids, x = pdf["vec_id"][fine].to_numpy(), np.stack(pdf["embedding"][fine].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 100 == 0) if sf == "0.1" else np.arange(len(ids))
    want = np.concatenate([(x[asked[i : i + 500]] @ x.T >= 0.95).sum(axis=1) - 1 for i in range(0, len(asked), 500)])
    have = np.array([got[int(i)] for i in ids[asked]])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()


def test_passages_grow_without_limit_and_part_where_documents_do(spark):
    rng, letters = np.random.default_rng(31), list("abcdefghijklmnop")
    gear, least = chunk_dedup.gear_table(), (1 << 16) // chunk_dedup.CUT_ONE_IN

    def free(words):  # words that no chunk ends in
        out = b" "
        while words:
            more = out + "".join(rng.choice(letters, 5)).encode() + b" "
            if (chunk_dedup.gear_hashes(np.frombuffer(more, np.uint8), gear)[len(out) :] >= least).all():
                out, words = more, words - 1
        return out.decode()

    text = lambda n: " ".join("".join(rng.choice(letters, 6)) for _ in range(n))
    # forced ends fall elsewhere in each document, so only the last words hold equal chunks
    long = free(900) + text(40)
    one, two = text(25), text(25)
    rows = [(1, text(30) + long + " " + text(30)), (2, text(37) + "qq" + long + " " + text(30))]
    # 25 words of one document and 25 of another meet: no document holds the 50
    rows += [(3, f"{text(20)} {one} {text(20)}"), (4, f"{text(20)} {two} {text(20)}"), (5, f"{text(20)} {one} {two} {text(20)}")]
    got = {r["doc_id"]: r for r in chunk_dedup.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (1, 2):
        assert got[i]["n_passages"] == 1 and 935 <= got[i]["repeated_words"] <= 941
    assert not any(got[i]["repeats"] for i in (3, 4, 5))


def test_passages_leave_no_shuffle_files_behind(spark):
    import glob
    import os
    import time

    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    size = lambda found: sum(os.path.getsize(f) for f in found if os.path.exists(f))
    rng, letters = np.random.default_rng(3), list("abcdefghijklmnop")
    text = lambda: " ".join("".join(rng.choice(letters, 6)) for _ in range(400))
    rows = [(i, t) for i, t in enumerate([text() for _ in range(60)] * 2)]
    before = files()
    found = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    time.sleep(1)
    # of the chunks' digests, the largest shuffles, nothing stays; counts may leave a few bytes
    assert size(files() - before) < 20_000
    assert found.count() >= 120
