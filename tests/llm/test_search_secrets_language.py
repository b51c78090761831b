import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import clashing
from pyspark.sql import functions as F

from lexwind.llm import topk
from lexwind.llm.langid import fit, identify, script_of, viterbi
from lexwind.llm.queries import QUERIES
from lexwind.llm.secrets import redact, scan_secrets, written
from lexwind.llm.topk import top_k


def best_by_hand(rows, k):
    fits = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    kept = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, w in kept:
        if q % 20 == 0:
            scored = sorted((-fits(sum(a * b for a, b in zip(w, v, strict=False))), i) for m, i, v in kept if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_search_of_all_kinds(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=8)]) for i in range(260)]
    rows += [(300 + i, rows[0][1]) for i in range(60)] + [(400, None), (420, [None, 1.0]), (440, [float("nan")]), (460, [float("inf")]), (480, []), (500, [1.0, -2.0]), (None, [1.0]), (7, rows[7][1]), (20, rows[20][1])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for sizes in ({}, {"query_group": 4, "shard_rows": 50}):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, F.col("id") % 20 == 0, **sizes).collect())
        assert got == best_by_hand(rows, 20)
    assert top_k(df.where("vec_id < 0"), F.col("id") % 20 == 0).count() == 0
    few = top_k(df.where("vec_id in (0, 1, 2)"), F.col("id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in few) == best_by_hand([r for r in rows if r[0] in (0, 1, 2)], 20)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [1e7, 0.0]), (1, [1e7, 0.0]), (2, [2e7, 0.0]), (3, [5e6, 0.0]), (20, [1e150, 1.0]), (21, [-1e150, 2.0]), (40, [3.0e8, 1.0]), (41, [3.0e8, 2.0]), (42, [3.0e8, 3.0])]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()))
    assert got == best_by_hand(rows, 20)
    first = [r for r in best_by_hand(rows[:4], 20) if r[0] == 0]
    assert [r[2] for r in first] == [2, 1, 3]


def test_rows_that_share_an_id_ask_each(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [2.0, 1.0])]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()))
    assert got == best_by_hand(rows, 20) and len(got) == 9


def table_of(rows, ids, vectors):
    return pa.table({"row": pa.array(rows), "id": pa.array(ids), "w": pa.array(vectors.tolist(), pa.list_(pa.float64()))})


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
@pytest.mark.parametrize("seeded", [False, True])
def test_pruning_keeps_ties_and_equals_a_full_scan(block, seeded):
    draw = np.random.default_rng(block)
    vectors = draw.integers(-40, 40, size=(500, 16)).astype(float)
    vectors[100:200] = vectors[3]
    ids = np.arange(500)[::-1] // 2
    queries = [0, 3, 150, 499]
    every = table_of(np.arange(500), ids, vectors)
    out, read, whole = topk.search_cell(every.take(queries), every, 20, every.slice(0, 60) if seeded else None, block)
    got = {q: [r for r in out.to_pylist() if r["query_row"] == q] for q in queries}
    for q in queries:
        want = sorted((-int(s), int(i)) for r, (s, i) in enumerate(zip((vectors @ vectors[q]).tolist(), ids.tolist(), strict=True)) if r != q)[:20]
        found = sorted((-r["score"], r["vec_id"]) for r in got[q])
        assert [s for s, _ in found[:20]] == [s for s, _ in want] and found[:20] == want
    assert 0 < read <= whole


def test_hopeless_blocks_are_skipped():
    block = topk.Block(np.arange(5), np.arange(5), np.ones((5, 16)))
    q, c, s = block.search(np.array([-1]), np.ones((1, 16)), np.array([17.0]))
    assert not len(q) and block.read == 0 and block.whole == 80
    q, c, s = block.search(np.array([2]), np.ones((1, 16)), np.array([16.0]))
    assert c.tolist() == [0, 1, 3, 4] and s.tolist() == [16.0] * 4
    assert topk.best(np.array([5, 4, 3]), np.array([1, 1, 2]), 2)[0].tolist() == [3, 4]


def test_postings_are_skipped_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    vectors = np.floor(64 * np.array([r.embedding for r in rows], dtype=np.float32).astype(float))
    ids = np.array([r.vec_id for r in rows])
    every = table_of(np.arange(len(ids)), ids, vectors)
    _, read, whole = topk.search_cell(every.filter(pa.array(ids % 20 == 0)), every, 20, every.take(np.arange(0, len(ids), 4)), 256)
    assert read < 0.8 * whole


def spans_by_hand(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


ACCESS = "AKIA" + "B7" * 8
TEXTS = [None, "", "é\U0001f600 Password = 'hunter2hunter'", "secret=token:abcdefgh", "token: abc", "api_key:aaaaaa apikey=bbbbbb API-KEY=cccccc", ACCESS, ACCESS[:19], "AKIA" + ACCESS, "ab12" * 6, "ab12" * 5 + "abc", "password=" + "0a" * 15, "secretsecret==x=====", "token = = aaaaaaa", "passwd:\ttokennn", "a" * 100_000 + " password=abcdef", "token=abcdef " * 300]


def test_base_spans_by_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (2, TEXTS[2]), (None, ACCESS)]
    got = scan_secrets(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).select("doc_id", written("base").alias("b"), written("spans").alias("s")).collect()
    assert sorted(((r.doc_id, r.b) for r in got), key=str) == sorted(((i, spans_by_hand(t)) for i, t in rows), key=str)


def test_weak_parts_need_their_complements(spark):
    weak = "Zk9aB3dE5xQ7wR2tY6uP"
    rows = [(0, f"user: bob42 see http://db.example.com/x key {weak}"), (1, f"user: bob42 key {weak}"), (2, f"see http://a.b/c key {weak}"), (3, f"user: bob42 and token=abcdef {weak}"), (4, f"user: bob42 {'.' * 500} http://db.example.com {weak}"), (5, f"{ACCESS} {weak}")]
    got = {r.doc_id: [s.split(":")[0] for s in r.s.split(",") if s] for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", written("spans").alias("s")).collect()}
    assert got == {0: ["weak_id", "endpoint", "weak_secret"], 1: [], 2: [], 3: ["weak_id", "assign", "weak_secret"], 4: [], 5: ["access", "weak_secret"]}


def test_texts_with_many_parts_give_the_same_spans(spark):
    """The windows over rows against the array functions, on every text and on long mixtures of all of them."""
    weak = "Zk9aB3dE5xQ7wR2tY6uP"
    draw = np.random.default_rng(6)
    pieces = [t for t in TEXTS if t and len(t) < 500] + [f"user: bob42 see http://db.example.com/x key {weak}", f"login=alice {weak}", "s3://bucket/x", "client_id: zzz", "é" * 150, "." * 250, "\U0001f600 "]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(draw.choice(pieces, size=60))) for i in range(40)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    shown = lambda many: sorted(map(str, scan_secrets(df, many=many).select("doc_id", written("base").alias("b"), written("spans").alias("s")).collect()))
    assert shown(10**9) == shown(0) == shown(5)
    assert sum("weak" in x for x in shown(0)) > 20
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    cleaned = lambda many: sorted(map(str, redact(docs, chars_col="n_chars", many=many).collect()))
    assert cleaned(10**9) == cleaned(0)


def test_time_follows_the_number_of_parts(spark):
    import time

    rows = [(1, "token=abcdef " * 32_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    redact(docs).collect()
    began = time.perf_counter()
    found = scan_secrets(docs).select(F.size("spans").alias("n")).first().n
    assert found == 32_000 and time.perf_counter() - began < 20
    assert redact(docs).first().text == "[assign] " * 32_000


def test_redaction(spark):
    docs = clashing(spark.createDataFrame([(1, f"a {ACCESS} é token=abcdef.", 9), (2, None, 0), (3, "clean", 5), (4, "password=" + "0a" * 15, 39)], "doc_id long, text string, n_chars long"))
    out = redact(docs, chars_col="n_chars")
    assert out.columns == docs.columns
    assert [(r.text, r.n_chars) for r in out.orderBy("doc_id").collect()] == [("a [access] é [assign]", 21), (None, 0), ("clean", 5), ("[assign]", 8)]


def test_no_documents(spark, empty_docs):
    assert scan_secrets(empty_docs).count() == 0 and redact(empty_docs).count() == 0
    model = fit(empty_docs, F.lit(True))
    assert identify(empty_docs, model).count() == 0
    one = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert identify(one, model).first()[:3] == (1, "und", 0.0)


def test_secret_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    from hashlib import sha256

    for r in QUERIES["op7_linked_secrets"](spark, "/root/testdata/sf0.001").collect():
        base = spans_by_hand(docs[r.doc_id])
        assert r.base_sha256 == sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k + ":") for k in ("assign", "access", "hex"))


def path_by_hand(scores, penalty):
    state, back = np.zeros(scores.shape[1]), []
    for s in scores:
        move = state[None, :] - penalty * (1 - np.eye(len(state)))
        back.append(move.argmax(axis=1))
        state = move.max(axis=1) + s
    path = [int(state.argmax())]
    for b in back[:0:-1]:
        path.append(int(b[path[-1]]))
    return path[::-1], state.max()


def test_viterbi_by_brute_force():
    draw = np.random.default_rng(2)
    table = draw.normal(size=(50, 3)).astype(np.float32) * 3
    sizes = np.array([40, 17, 17, 3, 1, 0])
    words = draw.integers(0, 50, size=int(sizes.sum()))
    got, at = viterbi(words, sizes, table, 2.5), 0
    for n in sizes.tolist():
        scores, path = table[words[at : at + n]].astype(float), got[at : at + n].tolist()
        value = sum(scores[i, p] for i, p in enumerate(path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        assert not n or value == pytest.approx(path_by_hand(scores, 2.5)[1], abs=1e-3)
        at += n


def test_languages_of_all_kinds(spark):
    en, ru, de = "the quick brown fox jumps over the lazy dog and runs away", "быстрая лиса прыгает через ленивую собаку и бежит", "der schnelle fuchs springt über den faulen hund und läuft weg"
    rows = [(i, {0: en, 1: ru, 2: de}[i % 3], {0: "en", 1: "ru", 2: "de"}[i % 3]) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 ½ !!", "de"), (103, f"{en} {ru}", None), (104, ru.upper(), None), (105, "日本語", None), (106, en + " " + "word " * 30_000, None), (106, en, None), (None, de, "de")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = fit(df, F.col("doc_id") < 60)
    got = identify(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (0, 1, 2, 100, 101, 102, 104, None)] == ["en", "ru", "de", "und", "und", "und", "ru", "de"]
    assert [(s.first, s.last, s.lang) for s in by[103].spans] == [(0, 11, "en"), (12, 19, "ru")]
    assert by[105].score == 0 and by[105].lang_pred in model.langs
    assert script_of("αβγ") == "greek" and script_of("naïve") == "latin" and script_of("漢字") == "han"


def test_language_query_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op8_viterbi_language"](spark, folder).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
