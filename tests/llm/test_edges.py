"""Each operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing names."""

import pytest

from ledgerloom.llm import chat, chunk_dedup, decontaminate, embed_dedup, html_extract, hpy_lm, mixing, queries, set_join, simhash, token_files, toxicity

LONG = "alpha beta gamma delta " * 60_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, _key string, _score double, spans int, _cuts int, size long, fp long"
ROWS = [(1, None), (2, ""), (3, " \n "), (4, LONG), (4, LONG), (None, "one two three"), (5, "one two three"), (5, "é ☃ 中文 words"), (6, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 6 else "s", 0, 7, "k", 0.5, 1, 2, 3, 9) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (5, None), (None, 1), (4, 0)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id long, text string")


def kept(df):
    return sorted((tuple(r)[:2] for r in df.collect()), key=repr)


def untouched(df):
    """Columns of the caller's own, whatever their names."""
    return {tuple(r)[5:] for r in df.collect()} <= {(7, "k", 0.5, 1, 2, 3, 9)}


def test_filters_keep_rows_and_columns(docs, labels, items):
    for out, gone in (
        (toxicity.drop_toxic(docs, labels), []),
        (decontaminate.decontaminate(docs, items), [(None, "one two three"), (5, "one two three")]),
        (simhash.drop_near_duplicates(docs), [(4, LONG), (None, "one two three")]),
        (chunk_dedup.drop_repeats(docs), []),
    ):
        assert out.columns == docs.columns and untouched(out)
        want = list(ROWS)
        for g in gone:
            want.remove(g)
        assert kept(out) == sorted(want, key=repr)


def test_empty_tables(docs, labels, items):
    none = docs.limit(0)
    for out in (toxicity.drop_toxic(none, labels), decontaminate.decontaminate(none, items), simhash.drop_near_duplicates(none), chunk_dedup.drop_repeats(none), simhash.simhash_classes(none), chunk_dedup.passage_report(none), mixing.mix(none), hpy_lm.lm_scores(none), toxicity.toxicity_scores(none, labels)):
        assert out.count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(ROWS)
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(ROWS)


def test_reports_return_every_row(docs, labels, items):
    for out in (simhash.simhash_classes(docs), chunk_dedup.passage_report(docs), mixing.mix(docs), hpy_lm.lm_scores(docs), toxicity.toxicity_scores(docs, labels), decontaminate.contamination(docs, items), token_files.encode_documents(docs, queries.vocabulary())):
        assert out.count() == len(ROWS)


def test_long_pages_chats_and_odd_vectors(spark):
    page = f"<nav>Menu</nav><article><p>{LONG}</p></article>"
    got = html_extract.extract_pages(spark.createDataFrame([(1, "u", page), (2, "u", None)], "page_id long, url string, html string")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, len(LONG.strip())]
    chats = spark.createDataFrame([(1, 0, "user", LONG + "</s>"), (1, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    assert all(r["round_trip"] for r in chat.format_chats(chats).collect())
    v = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, -0.0])], "vec_id long, embedding array<float>")
    assert sorted(r["n_links"] for r in embed_dedup.embedding_classes(v).collect()) == [0, 1, 1]


def test_parities_settle_only_what_they_may():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (100, 700, 3000, 9000):
        for similarity in (0.6, 0.78, 0.79, 0.81, 0.85, 0.95):
            both = int(2 * n * similarity / (1 + similarity))
            s = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
            a, b = s[:n], np.concatenate([s[:both], s[n:]])
            real = both / (len(a) + len(b) - both)
            got = set_join.settled(set_join.parities(a, set_join.wide_bins(n)), set_join.parities(b, 2 * set_join.wide_bins(n)), len(a) + len(b), 0.8)
            assert got == -1 or got == (real >= 0.8)
            if similarity in (0.6, 0.95) and n > 500:
                assert got == (real >= 0.8)


def test_sparse_parities_keep_alike_pairs():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    rows, alike = [], set()
    for k, n in enumerate((60, 500, 520, 1000, 1300, 5000, 20_000)):
        for similarity in (0.3, 0.81, 0.9):
            both = int(np.ceil(2 * n * similarity / (1 + similarity)))
            s = np.unique(rng.integers(0, 1 << 63, 2 * n - both)).astype(np.uint64)
            for name, x in ((0, s[:n]), (1, np.concatenate([s[:both], s[n:]]))):
                node = 100 * k + int(similarity * 10) * 2 + name
                rows.append((100 * k + int(similarity * 10), 0, node, node, len(x), 0, set_join.sparse_parities(x)))
            if similarity > 0.8:
                alike.add(node - 1)
    d = pd.DataFrame(rows, columns=["h", "block", "node", "comp", "n", "side", "bits"]).sort_values(["h", "n"])
    got = set(pd.concat(list(set_join._pairs(0.8, False)(iter([d]))))["a"])
    assert got == alike


def test_names_with_prefix_are_found(docs):
    from ledgerloom.llm.common import free_name

    assert free_name(docs, "_ROW") == "__ROW" and free_name(docs, "new") == "new"
