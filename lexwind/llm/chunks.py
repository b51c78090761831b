"""BPE encoding and decoding with content-defined chunks that are encoded once (operator 12).

A rolling hash over 16 bytes cuts every text where the hash says so, so texts that share a passage share its chunks wherever
it stands. The plan:

1. chunks are counted by a 128-bit hash; a Bloom filter of bounded size knows those that come more than once;
2. a text without such a chunk is encoded where it stands; of the others, runs of chunks of their own are encoded where they
   stand, too, and each shared chunk is encoded once for the whole table and joined back by its hash;
3. a text's pieces meet by the text's hash; each join of pieces is repaired: a window around it is encoded anew, up to the
   next edges on both sides at which the pieces' encoding and any other must agree.

A false hit of the filter costs a way through the shuffle, no more. Texts themselves are never shuffled, only shared chunks
and the ids of texts that have some. Equal texts are one text until the end.

Edges that every encoding has: where a white space follows something else. No pre-token of the pattern goes on from
another sign to white space, the scan looks behind nowhere, and added tokens hold no white space. So ids left of such an edge
don't depend on what is right of it, and the other way round.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwind.llm.common import cut, join_by_frequency, pick, text_batches
from lexwind.llm.tokens import decode, encode, load_encoding

WINDOW, LEAST, MOST, SEEN = 16, 128, 1 << 14, 1 << 16
TEXT = ["t1", "t2"]
PIECES = "t1 long, t2 long, pos int, hash binary, ids binary, n_tokens long, ids_sha256 binary, decoded_sha256 binary"
NAMES = [c.split()[0] for c in PIECES.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]


def byte_values() -> np.ndarray:
    """A well mixed 32-bit value of each byte."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


VALUES = byte_values()


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of the WINDOW bytes that end there: their values, each shifted by its distance, summed up."""
    h = VALUES[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def chunk_edges(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[list[int]]:
    """For each text (data[offsets[i]:offsets[i + 1]]) its start, its cuts and its end.

    A chunk has at most MOST bytes and, unless it is the last, at least LEAST; a cut stands between characters and depends on
    the bytes of its own text alone.
    """
    places = np.flatnonzero(rolling(data) >> np.uint32(32 - bits) == 0) + 1
    places = places[places < len(data)]
    for _ in range(3):
        places = places + ((data[np.minimum(places, len(data) - 1)] & 0xC0) == 0x80)
    places = np.unique(places)
    bounds = np.searchsorted(places, offsets)
    edges = []
    for start, end, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        made = [start]
        for place in [*places[a:b].tolist(), end]:
            while place - made[-1] > MOST:
                forced = made[-1] + MOST
                made.append(forced - int(((data[forced - 2 : forced + 1] & 0xC0) == 0x80)[::-1].cumprod().sum()))
            if place - made[-1] >= LEAST or place == end > made[-1]:
                made.append(place)
        edges.append(made)
    return edges


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunked(column: pa.Array, bits: int) -> tuple[bytes, list[list[int]], list[list[bytes]]]:
    """All texts' bytes, their edges and their chunks' 128-bit hashes."""
    import xxhash

    data, offsets = text_bytes(column)
    whole, edges, of = data.tobytes(), chunk_edges(data, offsets, bits), xxhash.xxh3_128_digest
    return whole, edges, [[of(whole[a:b]) for a, b in zip(e, e[1:], strict=False)] for e in edges]


def places(hashes: list[bytes], size: int) -> np.ndarray:
    """The two bits of each hash in a filter of `size` bits, a power of two."""
    return np.frombuffer(bytearray(b"".join(hashes)), dtype=np.uint64).reshape(-1, 2) & np.uint64(size - 1)


def known(hashes: list[bytes], words: np.ndarray) -> np.ndarray:
    at = places(hashes, len(words) * 64)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)


def filter_of(hashes: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of the hashes as 64-bit words; at most size / 64 words come to the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size // 64, dtype=np.uint64)
        for b in batches:
            at = places(b.column(0).to_pylist(), size).ravel()
            np.bitwise_or.at(held, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        n = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(held[n].view(np.int64))], names=["word", "bits"])

    found = hashes.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(size // 64, dtype=np.uint64)
    held[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return held


def digests(encoding, ids: np.ndarray | list[int]) -> tuple[int, bytes, bytes]:
    """How many ids, the digest of the ids and that of the text they decode to."""
    ids = np.asarray(ids, dtype="<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).digest(), hashlib.sha256(decode(encoding, ids.tolist())).digest()


def joined(encoding, parts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The ids of the whole text from those of its pieces; `sizes` are the bytes of each id."""
    ids = np.concatenate(parts)
    if len(parts) == 1:
        return ids
    text = encoding.decode_bytes(ids.tolist())
    data, ends = np.frombuffer(text, dtype=np.uint8), np.cumsum(sizes[ids])
    inner = ends[:-1]
    before, after = data[inner - 1], data[inner]
    agreed = inner[(before > 0x20) & (before < 0x7F) & ((after == 0x20) | (after >= 0x09) & (after <= 0x0D))]
    agreed = np.concatenate(([0], agreed, [len(data)]))
    joins = ends[np.cumsum([len(p) for p in parts])[:-1] - 1]
    left, right = agreed[np.searchsorted(agreed, joins, side="right") - 1], agreed[np.searchsorted(agreed, joins)]
    out, done, last = [], 0, 0
    for k in range(len(joins)):
        if left[k] == right[k] or right[k] <= done:  # agreed at the join itself, or inside the window before
            continue
        a, b = np.searchsorted(ends, (left[k], right[k]), side="right")
        out += [ids[last:a], np.array(encode(encoding, text[left[k] : right[k]].decode()), dtype=ids.dtype)]
        done, last = right[k], b
    return np.concatenate([*out, ids[last:]])


def sizes_of(encoding) -> np.ndarray:
    made = np.zeros(encoding.n_vocab, dtype=np.int64)
    for token, i in encoding._mergeable_ranks.items():
        made[i] = len(token)
    for token, i in encoding._special_tokens.items():
        made[i] = len(token.encode())
    return made


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


class Fresh:
    """Tells whether a key is new; forgets all when it knows SEEN keys, so a key may be called new again."""

    def __init__(self):
        self.seen: set = set()

    def __call__(self, key) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(key)
        return True


def encode_documents(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_bits: int = 10, filter_bits: int = 1 << 27,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (binary) of every document: the tokenizer's ids, and the text they decode to.

    Null and empty texts have no ids. Texts of any length are encoded whole; one without any white space may be encoded twice.
    Rows that are equal or share an id each give a row, and null ids stay. Extra columns do no harm; an empty table gives no
    rows. `chunk_bits`: a chunk has about 2**chunk_bits bytes. `filter_bits` bounds the filter's size (a power of two, 16 MB by default).
    """
    spark = docs.sparkSession
    text_batches(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    texts = keyed.select(*TEXT, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter(h for hashes in chunked(b.column(2), chunk_bits)[2] for h in hashes)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["hash", "n"])

    shared = cut(texts.mapInArrow(count, "hash binary, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1"))
    n_shared = shared.count()
    size = min(filter_bits, max(1 << 16, 1 << (16 * n_shared).bit_length()))
    words = spark.sparkContext.broadcast(filter_of(shared.select("hash"), size))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(t1, t2, text, edges, hashes, which are shared) of each new text."""
        fresh = Fresh()
        for b in batches:
            whole, edges, hashes = chunked(b.column(2), chunk_bits)
            flat = [h for hs in hashes for h in hs]
            hits, at = known(flat, words.value), 0
            for t1, t2, e, hs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), edges, hashes, strict=True):
                hit = hits[at : at + len(hs)]
                at += len(hs)
                if fresh((t1, t2)):
                    yield t1, t2, whole, e, hs, hit

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shared chunk of each text, with the chunk itself where it is new."""
        names, types = [*TEXT, "pos", "hash", "chunk"], [*TYPES[:4], pa.string()]
        fresh, out, held = Fresh(), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for t1, t2, whole, e, hs, hit in split(batches):
            for k in np.flatnonzero(hit).tolist():
                new = fresh(hs[k])
                out.append((t1, t2, k, hs[k], whole[e[k] : e[k + 1]].decode() if new else None))
                held += 64 + new * (e[k + 1] - e[k])
            if held > 1 << 22:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digests of texts without shared chunks; of the others the ids of each run of chunks of their own."""
        encoding = load_encoding(tokenizer_path)
        out, held = [], 0
        for t1, t2, whole, e, _, hit in split(batches):
            if not hit.any():
                ids = encode(encoding, whole[e[0] : e[-1]].decode())
                out.append((t1, t2, 0, None, None, *digests(encoding, ids)))
                held += 128
            else:
                edge = np.flatnonzero(np.diff(np.concatenate(([True], hit, [True])).astype(np.int8))).tolist()
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    ids = np.array(encode(encoding, whole[e[a] : e[b]].decode()), dtype="<u4").tobytes()
                    out.append((t1, t2, a, None, ids, None, None, None))
                    held += len(ids) + 64
            if held > 1 << 22:
                yield batch_of(out)
                out, held = [], 0
        if out:
            yield batch_of(out)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(tokenizer_path)
        for b in batches:
            ids = [np.array(encode(encoding, t.as_py()), dtype="<u4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), b.column(2)], names=["hash", "ids", "n"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by text and place; rows that come again are the same."""
        encoding = load_encoding(tokenizer_path)
        sizes = sizes_of(encoding)
        key, last, parts, done = None, None, [], []

        def settle() -> None:
            if parts:
                done.append((*key, None, None, None, *digests(encoding, joined(encoding, parts, sizes))))
            parts.clear()

        for b in batches:
            for t1, t2, pos, ids, n, x, y in zip(*(b.column(c).to_pylist() for c in ("t1", "t2", "pos", "ids", "n_tokens", "ids_sha256", "decoded_sha256")), strict=True):
                if (t1, t2) != key:
                    settle()
                    key, last = (t1, t2), None
                if pos == last:
                    continue
                last = pos
                if ids is None:
                    done.append((t1, t2, None, None, None, n, x, y))
                else:
                    parts.append(np.frombuffer(ids, dtype="<u4"))
            if len(done) >= 10_000:
                yield batch_of(done)
                done.clear()
        settle()
        yield batch_of(done)

    met = cut(texts.mapInArrow(occurrences, "t1 long, t2 long, pos int, hash binary, chunk string"))
    often = met.groupBy("hash").agg(F.count("*").alias("n"))
    distinct = met.where("chunk is not null").groupBy("hash").agg(F.first("chunk").alias("chunk"))
    encoded = cut(distinct.join(often, "hash").mapInArrow(once, "hash binary, ids binary, n long"))
    pieces = join_by_frequency(met.drop("chunk"), encoded, "hash", "n")
    made = texts.mapInArrow(own, PIECES).unionByName(pieces, allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = made.drop("hash").repartition(parts, *TEXT).sortWithinPartitions(*TEXT, "pos").mapInArrow(assemble, PIECES)
    copies = keyed.groupBy(*TEXT).agg(F.count("*").alias("n"))
    found = cut(whole.select(*TEXT, "n_tokens", "ids_sha256", "decoded_sha256").join(copies, TEXT))
    return join_by_frequency(keyed.select("doc_id", *TEXT), found, TEXT, "n").drop(*TEXT)
