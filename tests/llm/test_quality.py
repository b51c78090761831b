import re
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_helpers import clashing
from hypothesis import given, settings
from hypothesis import strategies as st

from lexwind.llm import quality
from lexwind.llm.quality import FEATURES, RIDGE, chi_square_quantile, count_texts, keep_usual, robust_outliers
from lexwind.llm.queries import QUERIES


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)) if words else 0, len(lines) - len(set(lines)), len(covered)


def counted(texts):
    out = count_texts(pa.array(texts, pa.string()))
    return list(zip(*(out[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é\x0b\x1c", max_size=60), max_size=6))
def test_counts_by_brute_force(texts):
    assert counted(texts) == [by_hand(t) for t in texts]


def test_counts_of_edges():
    texts = [None, "", " \n ", "a b c d e a b c d e", "x " * 30, "# # #", "l\nl\n\nl \nl", "word " * 5000]
    assert counted(texts) == [by_hand(t) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    ids = np.array([0, 1, 2, 3, 4, 9, 0, 1, 2, 3, 4, 5, 6, 7])
    doc = np.zeros(len(ids), dtype=np.int64)
    monkeypatch.setattr(quality, "MIX", np.uint64(0))  # all windows get the same hash
    assert quality.repeated_words(ids, doc, 1).tolist() == [10]


def clean(i):
    return f"This is line {i} of usual prose about theme {i * 7 % 100} with some words.\nIt goes on for a while, as text number {i} does, and ends."


def junk(i):
    return " ".join(f"word{j}### *** $$$" for j in range(i % 9 + 8))


def table(spark):
    rows = [(i, clean(i), "en" if i % 3 else None, "a") for i in range(400)] + [(1000 + i, junk(i), "en", "a") for i in range(25)]
    rows += [(2000, None, "en", "a"), (2001, "", None, None), (2002, "few words", "fr", "b"), (2003, clean(3), "fr", "b"), (2003, clean(3), "fr", "b"), (None, clean(4), "en", "a"), (2004, "long prose here and there " * 1, "en", "z"), (2005, " ".join(f"w{i}" for i in range(30_000)), "en", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_usual_documents_stay(spark):
    got = robust_outliers(clashing(table(spark))).collect()
    assert len(got) == table(spark).count()
    kept = Counter((("junk" if r.doc_id is not None and 1000 <= r.doc_id < 2000 else "clean" if r.doc_id is None or r.doc_id < 1000 else r.doc_id), r.kept) for r in got)
    assert kept["junk", True] == 0 and kept["clean", False] == 0
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (2000, 2001, 2002, 2004))
    assert kept[2003, True] == 2 and all(r.n_words == 30_000 and not r.base_failed for r in got if r.doc_id == 2005)


def test_keep_usual_keeps_whole_rows(spark):
    docs = clashing(table(spark))
    want = sorted(str(r.doc_id) for r in robust_outliers(docs).where("kept").collect())
    out = keep_usual(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == want


def test_empty_table(spark, empty_docs):
    assert robust_outliers(empty_docs).count() == 0 and keep_usual(empty_docs).count() == 0


def concentrated(x):
    """Mean and covariance of the group by plain concentration steps over its sorted rows, and reweighting."""
    ridge = np.diag(np.square(RIDGE))
    far = lambda m, cov: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov + ridge), x - m)
    middle = np.median(x, axis=0)
    c = (x - middle) / RIDGE
    scale = np.outer(RIDGE, RIDGE)
    begin = [np.diag((1.4826 * np.median(abs(x - middle), axis=0)) ** 2), (c.T @ (c / np.maximum((c**2).sum(axis=1), 1e-9)[:, None])) / len(x) * len(RIDGE) * scale, np.tanh(c).T @ np.tanh(c) / len(x) * scale]
    found = []
    for cov in begin:
        m = middle
        for _ in range(20):
            near = x[np.argsort(far(m, cov), kind="stable")[: max(round(0.7 * len(x)), min(len(x), 8))]]
            m, cov = near.mean(axis=0), np.cov(near.T, bias=True).reshape(len(RIDGE), len(RIDGE)) if len(near) > 1 else np.zeros_like(ridge)
        found.append((np.linalg.slogdet(cov + ridge)[1], m, cov))
    _, m, cov = min(found, key=lambda f: f[0])
    d = far(m, cov)
    inside = x[d <= max(1.0, np.median(d) / chi_square_quantile(0.5)) * chi_square_quantile(0.99)]
    return inside.mean(axis=0), np.cov(inside.T, bias=True).reshape(len(RIDGE), len(RIDGE)) if len(inside) > 1 else np.zeros_like(ridge)


def judged_by_hand(rows):
    """{position: squared distance} of rows (lang, source, features, usual?), with each group leaning on the larger ones."""
    ridge = np.diag(np.square(RIDGE))
    take = lambda keep: np.array([r[2] for r in rows if r[3] and keep(r)]).reshape(-1, len(RIDGE))
    out = {}
    for lang, source in {(r[0], r[1]) for r in rows}:
        groups = [take(lambda r: True), take(lambda r: r[0] == lang), take(lambda r: r[:2] == (lang, source))]
        estimates = [(len(g), *concentrated(g)) for g in groups if len(g)]
        mean, cov = quality.leaning(estimates, 100.0)
        inverse = np.linalg.inv(cov + ridge)
        out |= {i: float((np.array(r[2]) - mean) @ inverse @ (np.array(r[2]) - mean)) for i, r in enumerate(rows) if r[:2] == (lang, source)}
    return out


def test_leaning_is_the_moments_of_pooled_rows():
    draw = np.random.default_rng(5)
    larger, own = draw.normal(size=(100, 6)), draw.normal(size=(40, 6)) + 2
    mean, cov = quality.leaning([(100, larger.mean(axis=0), np.cov(larger.T, bias=True)), (40, own.mean(axis=0), np.cov(own.T, bias=True))], 100.0)
    pooled = np.concatenate((larger, own))
    assert np.allclose(mean, pooled.mean(axis=0)) and np.allclose(cov, np.cov(pooled.T, bias=True))


def test_estimates_by_brute_force(spark):
    """Mean, covariance, distances and verdicts against plain numpy; distances are sorted exactly there, in buckets here."""
    docs = table(spark).where("doc_id is not null and doc_id not in (2003)")
    counts = quality.cut(quality.with_counts(docs, "text", ["doc_id", "lang", "source"]))
    rows, params = quality.fit_outliers(counts)
    one = {r.cell: r for r in params.collect()}
    held = rows.withColumn("usual", ~quality.base_failed()).collect()
    x = np.array([[r[f] for f in FEATURES] for r in held if r.usual and r.lang == "en" and r.source == "a"])
    cell = next(r.cell for r in held if r.lang == "en" and r.source == "a")
    mean, cov = concentrated(x)
    every = concentrated(np.array([[r[f] for f in FEATURES] for r in held if r.usual]))
    lang = concentrated(np.array([[r[f] for f in FEATURES] for r in held if r.usual and r.lang == "en"]))
    n = [sum(r.usual for r in held), sum(r.usual and r.lang == "en" for r in held), len(x)]
    mean, cov = quality.leaning([(n[0], *every), (n[1], *lang), (n[2], mean, cov)], 100.0)
    assert np.allclose(one[cell].mean, mean, atol=0.02)
    assert np.allclose(one[cell].cov, [cov[i, j] for i, j in quality.PAIRS], atol=0.02)
    want = judged_by_hand([(r.lang, r.source, [r[f] for f in FEATURES], r.usual) for r in held])
    limit = chi_square_quantile(0.99999)
    got = {r.doc_id: r for r in robust_outliers(docs).collect()}
    for i, r in enumerate(held):
        if r.usual and not 0.85 < want[i] / limit < 1.15:
            assert got[r.doc_id].kept == (want[i] <= limit), (r.doc_id, want[i], got[r.doc_id].distance ** 2)


def test_query_verdicts_by_brute_force(spark):
    """All verdicts of the query on the small table, but for documents near the limit."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = quality.with_counts(docs, "text", ["doc_id", "lang", "source"]).withColumns(dict(zip(FEATURES, quality.features(), strict=True)))
    held = counts.withColumn("usual", ~quality.base_failed()).collect()
    want = judged_by_hand([(r.lang, r.source, [r[f] for f in FEATURES], r.usual) for r in held])
    limit = chi_square_quantile(0.99999)
    got = {r.doc_id: r.kept for r in QUERIES["op2_robust_outliers"](spark, folder).collect()}
    clear = [(i, r) for i, r in enumerate(held) if r.usual and not 0.8 < want[i] / limit < 1.25]
    assert len(clear) > 0.9 * sum(r.usual for r in held)
    assert all(got[r.doc_id] == (want[i] <= limit) for i, r in clear)


def test_query_counts_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op2_robust_outliers"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        n, chars, symbols, lines, repeats = by_hand(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (r.base_failed and r.kept)
