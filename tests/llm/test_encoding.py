"""Chunked encoding and the alignment of tokenizers against the libraries and plain loops."""

import hashlib
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from llm_helpers import clashing
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexwind.llm import alignment, chunks
from lexwind.llm.alignment import Pieces, align_documents
from lexwind.llm.chunks import chunk_edges, encode_documents, joined, sizes_of
from lexwind.llm.queries import QUERIES, tokenizer_path
from lexwind.llm.tokens import encode, load_encoding

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
PASSAGE = " ".join(f"wörd{i * i % 97} and então, {i}..." for i in range(150))
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "\n\n\n", "\t \r\n x", "<|endoftext|>", " x <|endoftext|> y<|endoftext|>", "▁mark ▁", "日本語のテキスト 🙂🙂 x", "é" * 50, "\x00\x1f\x1c \x85 \xa0　x",
    PASSAGE, "Intro one. " + PASSAGE, PASSAGE + " and more", PASSAGE[:900] + "EDIT" + PASSAGE[900:], "xyz" * 3000, "x" * 20_000, " " * 20_000 + "a", "ab  " * 4000, "🙂" * 6000, PASSAGE, PASSAGE,
    "don't we'll I'M <s> </s> <unk> <0x41>", PASSAGE.replace(" ", ""), PASSAGE.replace(" ", "\n"), "word " * 3000,
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, PASSAGE), (3, "   "), (15, PASSAGE), (15, PASSAGE)]


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encoded_by_hand(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode())))
    return Counter(out)


def encoded(df):
    return Counter((r.doc_id, r.n_tokens, bytes(r.ids_sha256).hex(), bytes(r.decoded_sha256).hex()) for r in df.collect())


@pytest.mark.parametrize("bits", [2, 6, 10])
def test_chunked_encoding(spark, library, bits):
    df = clashing(spark.createDataFrame(ROWS, "doc_id long, text string"))
    assert encoded(encode_documents(df, A, chunk_bits=bits)) == encoded_by_hand(library, ROWS)


def test_nearly_all_filter_hits_are_false(spark, library):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert encoded(encode_documents(df, A, filter_bits=64)) == encoded_by_hand(library, ROWS)


def test_encoding_of_no_rows(spark, empty_docs):
    assert encode_documents(empty_docs, A).count() == 0
    assert align_documents(empty_docs, A, B).count() == 0


def test_chunks_are_found_again_and_joins_repaired(library):
    shift = ["x" * k + PASSAGE for k in range(0, 40, 7)]
    data = [np.frombuffer(t.encode(), dtype=np.uint8) for t in shift]
    offsets = np.cumsum([0, *map(len, data)])
    edges = chunk_edges(np.concatenate(data), offsets, 8)
    found = [{bytes(np.concatenate(data)[a:b]) for a, b in zip(e, e[1:], strict=False)} for e in edges]
    assert all(len(found[0] & f) >= len(found[0]) - 2 for f in found)
    encoding = load_encoding(A)
    sizes = sizes_of(encoding)
    draw = np.random.default_rng(5)
    for text in [t for t in TEXTS if t]:
        for _ in range(5):
            cuts = sorted({0, len(text), *draw.integers(0, len(text) + 1, 6).tolist()})
            parts = [np.array(encode(encoding, text[a:b]), dtype="<u4") for a, b in zip(cuts, cuts[1:], strict=False)]
            assert joined(encoding, parts, sizes).tolist() == library.encode(text, add_special_tokens=False).ids


def test_shared_chunks_are_encoded_once(spark, monkeypatch, tmp_path):
    """Each worker notes what it encodes: the shared passage's chunks come once, though 40 texts hold them."""
    log = tmp_path / "log"
    log.mkdir()

    def noting(encoding, text, specials=True):
        with open(log / hashlib.sha256(text.encode()).hexdigest(), "a") as f:
            f.write("x")
        return encode(encoding, text, specials)

    monkeypatch.setattr(chunks, "encode", noting)
    rows = [(i, f"{i} start of text {i}. {PASSAGE} end {i}") for i in range(40)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert encode_documents(texts, A, chunk_bits=8).count() == 40
    often = sum(len(f.read_text()) > 1 for f in log.iterdir())
    assert often <= 2 and len(list(log.iterdir())) >= 10


@pytest.mark.parametrize("sign", [" ", "\t", "\n"])
@pytest.mark.parametrize("n", [1_000_000, 3_000_000])
def test_very_long_white_space(library, sign, n):
    encoding, run = load_encoding(A), sign * n
    for text in (run, "a" + run + "b", run + "<|endoftext|>" + run, f"x {run}"):
        assert encode(encoding, text) == library.encode(text, add_special_tokens=False).ids


def test_words_of_pieces():
    pieces, model = Pieces(B, most=50), SentencePieceProcessor(model_file=B)
    assert pieces.apart
    for t in [t for t in TEXTS if t]:
        assert pieces.encode(t) == pieces.encode(t) == model.encode(t, num_threads=1)


def test_new_words_of_many_texts_take_one_call():
    pieces, texts, calls = Pieces(B), [t for t in TEXTS if t], []
    model = pieces.model

    class Counted:
        def encode(self, *args, **more):
            calls.append(args)
            return model.encode(*args, **more)

    pieces.model = Counted()
    ids, whole = pieces.encode_all(texts)
    assert [x.tolist() for x in ids] == [model.encode(t, num_threads=1) for t in texts]
    assert whole == [pieces.gives_back(x.tolist(), t) for x, t in zip(ids, texts, strict=True)] and {*whole} == {True, False}
    assert len(calls) == 1 + sum("▁" in t for t in texts)


def test_words_whose_bytes_are_not_theirs():
    pieces = Pieces(B)
    pieces.bytes[pieces.model.encode("word", num_threads=1)[0]] = b" WORD"
    for _ in range(2):
        assert pieces.encode_all(["a word b", "a b", "word", "a  b"])[1] == [False, True, False, True]


def test_sums_of_keys():
    draw = np.random.default_rng(3)
    for most in (1, 2, 9):
        key, n = draw.integers(0, 50, 400), draw.integers(1, most + 1, 400)
        got = alignment.summed(key, n)
        assert [x.tolist() for x in got] == [np.unique(key).tolist(), np.bincount(key, n)[np.unique(key)].tolist()]
    assert alignment.summed(np.array([5, 2]), np.array([3, 4]))[1].tolist() == [4, 3]


def token_bytes():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    return of


def aligned_by_hand(rows):
    library, model, of = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), token_bytes()
    library.encode_special_tokens = True
    made = []
    for i, t in rows:
        if not t:
            made.append((i, [], [], []))
            continue
        a, b = library.encode(" " + t, add_special_tokens=False).ids, model.encode(t, num_threads=1)
        ta = [bytes(of[c] for c in library.id_to_token(x)) for x in a]
        tb = [bytes([model.id_to_piece(x)[3:5] and int(model.id_to_piece(x)[3:5], 16)]) if model.is_byte(x) else model.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if b"".join(ta) != (" " + t).encode() or b"".join(tb) != (" " + t).encode():
            made.append((i, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        common, groups, ka, kb = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for end in common:
            ga, gb = [], []
            while ka < len(a) and ends_a[ka] <= end:
                ga.append(a[ka])
                ka += 1
            while kb < len(b) and ends_b[kb] <= end:
                gb.append(b[kb])
                kb += 1
            groups.append((ga, gb))
        made.append((i, a, b, groups))
    links = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for *_, groups in made]
    counts = Counter(p for c in links for p in c)
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, a, b, groups), c in zip(made, links, strict=True):
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((i, len(a), len(b), len(groups), c.total(), sum(n for p, n in c.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in c.items()), sha(text.encode()) if a else ""))
    return Counter(out)


def aligned(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, bytes(r.groups_sha256).hex() if r.groups_sha256 else "") for r in df.collect())


SHORT = [(i, t if t is None or len(t) < 9000 else t[:3000]) for i, t in ROWS]


@pytest.mark.parametrize("size", [1, 2000, 1 << 20])
def test_alignment(spark, size):
    df = clashing(spark.createDataFrame(SHORT, "doc_id long, text string"))
    assert aligned(align_documents(df, A, B, batch_bytes=size)) == aligned_by_hand(SHORT)


def test_alignment_counts_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 100)
    df = spark.createDataFrame(SHORT, "doc_id long, text string")
    assert aligned(align_documents(df, A, B)) == aligned_by_hand(SHORT)


def test_runs_across_batches():
    batch = lambda k: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([1] * len(k), pa.int64())], names=["k", "n"])
    got = [(k, n) for x, y in alignment.whole_runs(iter([batch([1, 1, 2]), batch([]), batch([2, 2]), batch([2, 3])])) for k, n in zip(x.tolist(), y.tolist(), strict=True)]
    assert got == [(1, 2), (2, 4), (3, 1)]


def test_encoding_queries_on_given_tables(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in QUERIES["op12_chunked_bpe"](spark, folder).collect())
    assert got == encoded_by_hand(library, rows)
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    got = Counter(tuple(r[c] for c in names) for r in QUERIES["op13_aligned_tokenizers"](spark, folder).collect())
    assert got == aligned_by_hand(rows)
