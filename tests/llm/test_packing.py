import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import clashing
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexwind.llm.packing import balance, pack_documents
from lexwind.llm.queries import QUERIES
from lexwind.llm.tokens import encode, load_encoding

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_tokenizers_library(text):
    assert encode(load_encoding(PATH), text) == REFERENCE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b<|endoftext|>", " " * 5000, "x" * 20_000, "日本語 テスト\u0085\xa0 end\n\n", "it's we'LL 123٣", "\U0001f600‍"])
def test_ids_of_hard_texts(text):
    assert encode(load_encoding(PATH), text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_balance_covers_and_fits():
    draw = random.Random(1)
    for n in (1, 2, 50, 700):
        lengths = np.array([draw.randrange(1, 2048) for _ in range(n)])
        pieces = balance(lengths, 2048, 1.0, 1 / 2048)
        sequences = -(-int(lengths.sum()) // 2048)
        used = [0] * sequences
        for item in range(n):
            own = sorted((start, k) for i, start, k, _, _ in pieces if i == item)
            assert [a for a, _ in own] == [sum(k for _, k in own[:j]) for j in range(len(own))] and sum(k for _, k in own) == lengths[item]
        for _, _, k, s, offset in pieces:
            assert offset == used[s]
            used[s] += k
        assert max(used) <= 2048 and sum(used) == lengths.sum()


def test_descending_documents_balance_cost():
    pieces = balance(np.array([1000, 1000, 500, 500, 400, 400]), 2048, 1.0, 1.0)
    by = {}
    for item, _, k, s, _ in pieces:
        by.setdefault(s, []).append(k)
    assert sorted(map(sorted, by.values())) == [[400, 500, 1000], [400, 500, 1000]]


def check(rows, pieces):
    ids = {}
    for doc_id, text in rows:
        ids.setdefault((doc_id, tuple([*REFERENCE.encode(text or "", add_special_tokens=False).ids, 1])), 0)
        ids[doc_id, tuple([*REFERENCE.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    for (doc_id, whole), times in ids.items():
        own = sorted((p.start, p.length, bytes(p.tokens)) for p in pieces if p.doc_id == doc_id and p.doc_tokens == len(whole))
        assert sum(k for _, k, _ in own) == times * len(whole)
        for start, k, data in own:
            assert np.frombuffer(data, "<u4").tolist() == list(whole[start : start + k])
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= 2048
    return fill


def test_rows_of_all_kinds(spark):
    rows = [(1, None), (2, ""), (3, "hello world " * 4000), (3, "other"), (4, "tie"), (5, "tie"), (5, "tie"), (None, "no id"), (6, "<|endoftext|>")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).coalesce(1)
    fill = check(rows, pack_documents(df, PATH).collect())
    assert sum(2048 - n for n in fill.values()) < 2048


def test_windows_and_partitions(spark):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(rows, pack_documents(df, PATH, window_tokens=5000).collect())


def test_empty_table(spark, empty_docs):
    assert pack_documents(empty_docs, PATH).count() == 0


def test_query_by_brute_force(spark):
    pieces = QUERIES["op1_cost_balanced_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    whole = {d.doc_id: np.array([*REFERENCE.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4") for d in docs}
    seen = dict.fromkeys(whole, 0)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(whole[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(whole[p.doc_id])
        seen[p.doc_id] += p.length
    assert all(seen[d] == len(w) for d, w in whole.items())
    assert len({p.sequence_id for p in pieces}) == -(-sum(map(len, whole.values())) // 2048)


def test_white_space_of_a_million_signs_through_all_stages(spark):
    """A text with a run of 1,000,000 white-space signs passes every stage of the pipeline whole; the others are untouched."""
    import corpus_pipeline

    draw = random.Random(3)
    some = lambda: " ".join(f"{draw.choice('bcdfg')}a{draw.choice('lmnprst')}{draw.randrange(900)}" for _ in range(60))
    rows = [(i, some(), "en", "ab"[i % 2], 1) for i in range(40)] + [(100 + k, f"{some()}{sign * 1_000_000}{some()}", "en", "a", 1) for k, sign in enumerate(" \t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        if name in ("simhash_near_dedup", "secret_scans"):
            texts = {r.doc_id: r.text for r in now.collect()}
            assert all(texts[i] == t for i, t, *_ in rows if i in texts)
    long = docs.where("doc_id >= 100")
    pieces = corpus_pipeline.packing(spark, long, "").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t, *_ in rows[40:]:
        mine = sorted((p.start, bytes(p.tokens)) for p in pieces if p.doc_id == i)
        ids = np.frombuffer(b"".join(x for _, x in mine), dtype="<u4").tolist()
        assert ids == [*library.encode(t, add_special_tokens=False).ids, 1]
