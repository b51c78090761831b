"""Alignment of two tokenizers by byte offsets, with corpus-wide counts of linked id pairs (operator 13).

Every text is encoded once by both tokenizers. Offsets where tokens of both end cut the tokens into groups; all tokens of one
group are linked. A pair of ids is one whole number, first id * second vocabulary + second id. The plan:

1. a narrow stage encodes, groups and stores for each document its counts and its distinct pairs, as compressed differences;
2. np.unique counts the pairs of a partition's documents; the partial counts are sorted globally by ranges of keys, runs of
   equal keys are summed, and each range becomes a shard: a file of sorted keys and one of counts in the shared folder;
3. the documents' pairs are looked up in the shards by binary search. Shards are mapped into memory, so a task reads the
   pages that it needs and workers of a machine share them.

Texts aren't shuffled. A shard's files have a name of their own for each attempt of a task, and only the names that finished
tasks return are read, so that a task may run again; nothing but these names, one row a range, comes to the driver.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwind.lineage import ensure_checkpoint_dir, forget_later
from lexwind.llm.common import cut, pick, text_batches
from lexwind.llm.tokens import LONG_RUN, encode, load_encoding

MARK, HELD, LONG_WORD = "▁", 1 << 21, 64


class Pieces:
    """A sentencepiece model: ids of texts, bytes of ids.

    Where no piece goes on after a space mark that follows something else, words (with the spaces before them) are encoded
    each for itself with the same result, and those that were met before are looked up.
    """

    def __init__(self, path: str, most: int = 1 << 18):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.model, spec = SentencePieceProcessor(model_file=path), ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        self.apart = normal.name == "identity" and normal.add_dummy_prefix and not normal.remove_extra_whitespaces and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(MARK, " ").encode() for p in spec.pieces]
        self.space, self.most, self.met, self.odd = self.model.piece_to_id(MARK), most, {}, set()

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0][0].tolist()

    def gives_back(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode()

    def encode_all(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether their bytes are those of a space and the text. New words of all texts are encoded in one call."""
        parted = [self.words(t) if self.apart and t and MARK not in t else None for t in texts]
        met, odd = self.met, self.odd
        every = set().union(*(words for words in parted if words is not None))
        if new := list(every.difference(met)):
            if len(met) + len(new) > self.most:
                met.clear()
                odd.clear()
                new = list(every)
            # A space alone is no text to the model, which puts the space itself.
            met.update(zip(new, (x if w else [self.space] for w, x in zip(new, self.model.encode(new, num_threads=1), strict=True)), strict=True))
            odd.update(w for w in new if not self.gives_back(met[w], w))
        out, whole = [], []
        for text, words in zip(texts, parted, strict=True):
            ids = self.model.encode(text, num_threads=1) if words is None else list(chain.from_iterable(map(met.__getitem__, words)))
            out.append(np.array(ids, dtype=np.int64))
            # If each word's bytes are its own, so are the text's; else the whole text is compared.
            whole.append(words is not None and odd.isdisjoint(words if odd else ()) or self.gives_back(ids, text))
        for w in new:
            if len(w) > LONG_WORD:
                del met[w]
                odd.discard(w)
        return out, whole

    @staticmethod
    def words(text: str) -> list[str]:
        """Parts that begin at each space after something else, without their first space."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        words, spaces = [], 0
        for n, part in enumerate(parts):
            if part:
                words.append(" " * spaces + part)
                spaces = 0
            elif n < len(parts) - 1:
                spaces += 1
            else:
                words.append(" " * spaces)
        return words


@functools.lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


class Bytes:
    """A byte-level encoding: ids of texts, bytes of ids. If each byte is a token, the ids' bytes are the text's: the pattern leaves no sign out."""

    def __init__(self, encoding, tokens: list[bytes]):
        self.encoding, self.tokens, self.complete = encoding, tokens, len({t for t in tokens if len(t) == 1}) == 256

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Ids of a space and the text, and whether their bytes are theirs."""
        text = " " + text
        if len(text) < LONG_RUN:
            ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        else:
            ids = np.array(encode(self.encoding, text, specials=False), dtype=np.uint32)
        return ids, self.complete or b"".join(map(self.tokens.__getitem__, ids.tolist())) == text.encode()


@functools.lru_cache(maxsize=2)
def tables(first: str, second: str):
    """Both tokenizers, the lengths of each id's bytes, and each id with what may follow it in a digest."""
    encoding, pieces = load_encoding(first), load_pieces(second)
    a = [b""] * encoding.n_vocab
    for token, i in encoding._mergeable_ranks.items():
        a[i] = token
    sizes = [np.array([len(x) for x in y], dtype=np.int64) for y in (a, pieces.bytes)]
    written = pa.array([b"%d%s" % (i, sign) for sign in (b",", b"|", b";", b"") for i in range(max(len(a), len(pieces.bytes)))], pa.large_binary())
    return Bytes(encoding, a), pieces, sizes, written


def spread(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, n = np.unique(key, return_counts=True)
    return values, n.astype(np.int64)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of each one's numbers, most of which are 1."""
    one = n == 1
    values, counts = counted(key[one])
    if len(values) and one.all():
        return values, counts
    key, n = np.concatenate((values, key[~one])), np.concatenate((counts, n[~one]))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[new], np.add.reduceat(n, new)


class Aligned:
    """Documents' tokens side by side: groups by document, and the distinct pairs of each group with their numbers.

    `a` and `b` hold the ids of each document; both have the same bytes, and none is empty.
    """

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], sizes: list[np.ndarray], written: pa.Array):
        self.n = [np.array([len(x) for x in side], dtype=np.int64) for side in (a, b)]
        self.ids = [np.concatenate(side).astype(np.int64) for side in (a, b)]
        ends = [np.cumsum(size[i]) for size, i in zip(sizes, self.ids, strict=True)]
        self.group = []
        for own, other in (ends, ends[::-1]):
            ended = np.zeros(int(own[-1]) + 1, dtype=bool)
            ended[other] = True
            cut_here = ended[own]
            self.group.append(np.cumsum(cut_here) - cut_here)
        self.groups = np.diff(self.group[0][np.cumsum(self.n[0]) - 1] + 1, prepend=0)  # a document's end is a cut
        self.doc = np.repeat(np.arange(len(a)), self.groups)
        self.vocabulary, self.written = np.int64(len(sizes[1])), written
        self.most = self.vocabulary * len(sizes[0])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links) sorted by document and pair: distinct pairs and how many links each has."""
        shift = np.int64(1 << 24)
        sizes = [np.bincount(g, minlength=len(self.doc)) for g in self.group]
        single = (sizes[0] == 1) & (sizes[1] == 1)  # most groups are a token of either side
        a, b = (i[single[g]] for g, i in zip(self.group, self.ids, strict=True))
        keys, numbers = [self.doc[single] * self.most + a * self.vocabulary + b], [np.ones(len(a), dtype=np.int64)]
        (x, nx), (y, ny) = (counted(g[held] * shift + i[held]) for g, i, held in ((g, i, ~single[g]) for g, i in zip(self.group, self.ids, strict=True)))
        gx, gy = x // shift, y // shift
        per = np.bincount(gy, minlength=len(self.doc))  # distinct second ids of each group
        first = np.cumsum(per) - per
        times = per[gx]
        i, j = np.repeat(np.arange(len(x)), times), np.repeat(first[gx], times) + spread(times)
        keys.append(self.doc[gx[i]] * self.most + (x[i] % shift) * self.vocabulary + y[j] % shift)
        numbers.append(nx[i] * ny[j])
        key, n = summed(np.concatenate(keys), np.concatenate(numbers))
        return key // self.most, key % self.most, n

    def digests(self) -> list[bytes]:
        """Of each document the digest of its groups, written out."""
        (ga, gb), (ia, ib) = self.group, self.ids
        na, nb = np.bincount(ga, minlength=len(self.doc)), np.bincount(gb, minlength=len(self.doc))
        half = len(self.written) // 4
        last_a, last_b = np.concatenate((ga[1:] != ga[:-1], [True])), np.concatenate((gb[1:] != gb[:-1], [True]))
        ends = np.concatenate((self.doc[1:] != self.doc[:-1], [True]))  # a document's last group ends without a sign
        code = np.empty(len(ia) + len(ib), dtype=np.int64)
        code[np.arange(len(ia)) + (np.cumsum(nb) - nb)[ga]] = ia + half * last_a
        code[np.arange(len(ib)) + np.cumsum(na)[gb]] = ib + half * np.where(last_b, np.where(ends[gb], 3, 2), 0)
        signs = self.written.take(pa.array(code))
        at, data = np.frombuffer(signs.buffers()[1], dtype=np.int64), memoryview(signs.buffers()[2])
        edge = at[np.concatenate(([0], np.cumsum(self.n[0] + self.n[1])))].tolist()
        return [hashlib.sha256(data[x:y]).digest() for x, y in zip(edge[:-1], edge[1:], strict=True)]


def packed(pairs: np.ndarray, links: np.ndarray) -> bytes:
    """Sorted pairs as differences, and their links; bytes of the same weight stand together."""
    planes = np.stack([np.diff(pairs, prepend=0), links]).astype("<i8").view(np.uint8).reshape(2, -1, 8)
    return pa.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=16 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(2, 8, n)
    steps, links = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[..., 0]
    return np.cumsum(steps), links


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and numbers of sorted rows with the numbers of equal keys summed up, across batches too."""
    held = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    for b in batches:
        if not b.num_rows:
            continue
        key, n = (np.concatenate(x) for x in zip(held, (b.column(0).to_numpy(), b.column(1).to_numpy()), strict=True))
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, n = key[new], np.add.reduceat(n, new)
        yield key[:-1], n[:-1]
        held = key[-1:], n[-1:]
    yield held


def local(path: str) -> str | None:
    """The path without its scheme if it is in a mounted folder."""
    return path.removeprefix("file://").replace("file:/", "/", 1) if path.startswith(("file:", "/")) else None


def store(path: str, data: bytes) -> None:
    if at := local(path):
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(data)
        return
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    with fs.open_output_stream(at) as f:
        f.write(data)


@functools.lru_cache(maxsize=4096)
def mapped(path: str, kind: str = "<i8") -> np.ndarray:
    """The file's numbers, mapped into memory; from a store that can't be mounted by way of a nameless local file."""
    if at := local(path):
        return np.memmap(at, dtype=kind, mode="r")
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    with tempfile.TemporaryFile() as f, fs.open_input_stream(at) as source:
        while part := source.read(1 << 22):
            f.write(part)
        f.flush()
        return np.memmap(f, dtype=kind, mode="r")


def look_up(keys: np.ndarray, shards: list[tuple[str, int, int]]) -> np.ndarray:
    """The counts of sorted keys; shards are (path, first key, last key) in ascending order."""
    found = np.zeros(len(keys), dtype=np.int64)
    for path, first, last in shards:
        a, b = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
        if a < b:
            found[a:b] = mapped(f"{path}.counts")[np.searchsorted(mapped(f"{path}.keys"), keys[a:b])]
    return found


COUNTS = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]


def align_documents(docs: DataFrame, first: str, second: str, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (binary), n_best, count_sum of every document.

    `first` is a byte-level BPE file of `tokenizers`, `second` a sentencepiece model that puts a space before a text; the first
    one gets that space too, so both cover the same bytes. Strings of special tokens are plain text. A pair's count is the number
    of documents that hold it linked, n_best the number of links whose count is the highest of their first id, count_sum
    the counts of all links.

    Null and empty texts, and texts whose tokens of either side don't give back its bytes, have no tokens: zeros and a null digest.
    Texts of any length are aligned whole. Rows that are equal or share an id each count as a document and give a row;
    null ids stay. Extra columns do no harm; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kept = T.StructType([rows.schema["doc_id"], *COUNTS, T.StructField("groups_sha256", T.BinaryType()), T.StructField("n_pairs", T.LongType()), T.StructField("pairs", T.BinaryType())])
    vocabulary = len(load_pieces(second).bytes)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces, sizes, written = tables(first, second)

        def made(b: pa.RecordBatch) -> pa.RecordBatch:
            held, a_ids, b_ids = [], [], []
            texts = {k: text for k, text in enumerate(b.column(1).to_pylist()) if text}
            for (k, text), y, whole in zip(texts.items(), *pieces.encode_all(list(texts.values())), strict=True):
                x, whole_x = bpe.encode(text)
                if whole and whole_x:
                    held.append(k)
                    a_ids.append(x)
                    b_ids.append(y)
            columns = np.zeros((5, b.num_rows), dtype=np.int64)
            digests: list[bytes | None] = [None] * b.num_rows
            pairs: list[bytes | None] = [None] * b.num_rows
            if held:
                side = Aligned(a_ids, b_ids, sizes, written)
                doc, pair, links = side.pairs()
                edge = np.searchsorted(doc, np.arange(len(held) + 1))
                columns[:, held] = [*side.n, side.groups, np.add.reduceat(links, edge[:-1]), np.diff(edge)]
                for k, digest, x, y in zip(held, side.digests(), edge[:-1], edge[1:], strict=True):
                    digests[k], pairs[k] = digest, packed(pair[x:y], links[x:y])
            out = [b.column(0), *map(pa.array, columns[:4]), pa.array(digests, pa.binary()), pa.array(columns[4]), pa.array(pairs, pa.binary())]
            return pa.RecordBatch.from_arrays(out, names=kept.names)

        for b in batches:
            for part in by_bytes(b, 1, batch_bytes):
                yield made(part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct pairs of the partition's documents with their numbers, as often as HELD of them have come together."""
        total = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = counted(np.concatenate([np.empty(0, dtype=np.int64), *waiting]))
            waiting.clear()
            key, at = np.unique(np.concatenate((total[0], key)), return_inverse=True)
            return key, np.bincount(at, np.concatenate((total[1], n)), minlength=len(key)).astype(np.int64)

        for b in batches:
            waiting += [unpacked(p, n)[0] for n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if n]
            if sum(map(len, waiting)) >= HELD:
                total = merged()
                if len(total[0]) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], names=["pair", "n"])
                    total = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["pair", "n"])

    folder = f"{ensure_checkpoint_dir(spark)}/pairs-{uuid.uuid4().hex}"
    forget_later(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's shard; gives its name, first and last pair, and each first id's highest count in it."""
        runs = [r for r in whole_runs(batches) if len(r[0])]
        names = ["path", "low", "high", "ids", "most"]
        if not runs:
            return
        key, n = (np.concatenate(x) for x in zip(*runs, strict=True))
        path = f"{folder}/{uuid.uuid4().hex}"
        store(f"{path}.keys", key.astype("<i8").tobytes())
        store(f"{path}.counts", n.astype("<i8").tobytes())
        ids = key // vocabulary
        new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        most = np.maximum.reduceat(n, new)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([key[0]]), pa.array([key[-1]]), pa.array([ids[new].tolist()]), pa.array([most.tolist()])], names=names)

    aligned = cut(rows.mapInArrow(align, kept))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = aligned.select("n_pairs", "pairs").mapInArrow(count, "pair long, n long").repartitionByRange(parts, "pair").sortWithinPartitions("pair")
    written = cut(counts.mapInArrow(write, "path string, low long, high long, ids array<long>, most array<long>"))
    shards = [tuple(r) for r in written.orderBy("low").select("path", "low", "high").collect()]
    highest = written.select(F.explode(F.arrays_zip("ids", "most")).alias("x")).groupBy("x.ids").agg(F.max("x.most").alias("most")).toArrow()
    best = np.zeros(int(max(highest["ids"].to_numpy(), default=0)) + 1, dtype=np.int64)
    best[highest["ids"].to_numpy()] = highest["most"].to_numpy()  # one number for each id of the first vocabulary

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("n_pairs").to_numpy()
            both = [unpacked(p, n) for n, p in zip(sizes.tolist(), b.column("pairs").to_pylist(), strict=True) if n]
            n_best = count_sum = np.zeros(b.num_rows)
            if both:
                pair, links = (np.concatenate(x) for x in zip(*both, strict=True))
                doc = np.repeat(np.arange(b.num_rows), sizes)
                key, at = np.unique(pair, return_inverse=True)
                n = look_up(key, shards)
                top = n == best[key // vocabulary]
                n_best, count_sum = (np.add.reduceat(np.append(x, 0), np.cumsum(sizes) - sizes) * (sizes > 0) for x in (links * top[at], links * n[at]))
            out = [*(b.column(c) for c in kept.names[:6]), pa.array(n_best.astype(np.int64)), pa.array(count_sum.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=result.names)

    result = T.StructType([*kept.fields[:6], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return aligned.mapInArrow(sum_up, result)


def by_bytes(b: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose values in a column have about so many bytes together; a row alone may have more."""
    lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths + 64) // most
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
    for x, y in zip(edge[:-1], edge[1:], strict=True) if len(part) else ():
        yield b.slice(x, y - x)
