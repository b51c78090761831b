"""SimHash near-duplicates with pigeonring filtering (operator 4).

A fingerprint has 64 bits, seen as a ring of four segments of 16. If two differ in at most 3 bits, then by the
pigeonring principle some start in the ring has all its chains within their proportional budgets: of the first l
segments from there at most 3 * l / 4 bits differ, that is none in the first, at most 1 in two, at most 2 in three.
So one of the next segment's halves is equal too. Each fingerprint is therefore filed under 8 keys (start, first
segment, one half of the next: 24 bits of content), and within a key the chain of budgets prunes pairs before the
full Hamming check.

Equal fingerprints are one node from the start. Within a key, pairs of up to `SMALL` fingerprints are compared at
once for all keys of a batch; larger keys (groups of near copies) are connected through leaders: everything within 3
bits of a leader hangs on it, and only members of balls that could touch are compared. Links come out as a spanning
forest, never as all pairs. A key of over `MOST` fingerprints is not compared at all: its fingerprints go on, streamed,
to four keys each that add a quarter of the bits not agreed on yet, one of which two fingerprints within 3 bits share
(they have at most three differences for four quarters); this goes on until no key is that large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwind.llm.common import KEYS, cut, join_by_frequency, one_of_each, pick, positional, repeated, row_keys, text_batches
from lexwind.llm.components import connected_components
from lexwind.llm.similar import parities, shingle_set, similar_links

SEGMENTS, BITS, LIMIT, SMALL, MOST = 4, 16, 3, 16, 1 << 14


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[-n:] - 1).tolist()
    counts = np.zeros(64, dtype=np.int64)
    of = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 14):
        hashes = np.array([of(joined[a:b], seed) for a, b in zip(first[at : at + (1 << 14)], last[at : at + (1 << 14)], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int | None = None) -> DataFrame:
    """doc_id, KEYS (of the whole row), node (a hash of the text) and fp (the fingerprint as a signed long).

    With `shingle` also shingles and bits: how many shingles of so many words the text's set has, and their parities.
    """
    text_batches(docs.sparkSession)
    flat = positional(docs)
    text = F.col(f"_c{docs.columns.index(text_col)}")
    rows = flat.select(F.col(f"_c{docs.columns.index(id_col)}").alias("doc_id"), *row_keys(flat), F.xxhash64(text).alias("node"), text.alias("text"))
    held = ["doc_id", *KEYS, "node"]
    more = [T.StructField("shingles", T.LongType()), T.StructField("bits", T.BinaryType())] if shingle else []
    schema = T.StructType([*(rows.schema[c] for c in held), T.StructField("fp", T.LongType()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(4)]
            made = [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))]
            if shingle:
                sets = [shingle_set(t, shingle) for t in texts]
                made += [pa.array([len(x) for x in sets], pa.int64()), pa.array([parities(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def segment(x: np.ndarray, i: int) -> np.ndarray:
    return (x >> np.uint64(BITS * (i % SEGMENTS))) & np.uint64((1 << BITS) - 1)


def chain_holds(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For differences x and starts: are all chains from there within their budgets, and the whole within LIMIT?"""
    held, total = np.ones(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    parts = np.stack([np.bitwise_count(segment(x, i)) for i in range(SEGMENTS)])
    for length in range(1, SEGMENTS + 1):
        total = total + parts[(start + length - 1) % SEGMENTS, np.arange(len(x))]
        held &= total <= LIMIT * length // SEGMENTS
    return held


def leader_links(f: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all of these distinct fingerprints that LIMIT-bit steps among them connect."""
    links: list[tuple[int, int]] = []
    ball, leaders = np.full(len(f), -1), []
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(a: int, b: int, x: int, y: int) -> None:
        if (a := root(a)) != (b := root(b)):
            parent[max(a, b)] = min(a, b)
            links.append((int(f[x]), int(f[y])))

    for i in range(len(f)):
        if ball[i] >= 0:
            continue
        d = np.bitwise_count(f ^ f[i])
        b = len(leaders)
        leaders.append(i)
        parent.append(b)
        near = d <= LIMIT
        for k in np.unique(ball[near & (ball >= 0)]).tolist():
            join(b, k, i, int(np.flatnonzero(near & (ball == k))[0]))
        new = near & (ball < 0)
        ball[new] = b
        links.extend((int(f[i]), int(y)) for y in f[new] if y != f[i])
    at = f[leaders]
    for a in range(len(leaders)):  # balls that could touch: leaders within 3 * LIMIT bits
        close = np.flatnonzero(np.bitwise_count(at ^ at[a]) <= 3 * LIMIT)
        for b in close[close > a].tolist():
            if root(a) == root(b):
                continue
            xs = np.flatnonzero((ball == a) & (np.bitwise_count(f ^ at[b]) <= 2 * LIMIT))
            ys = np.flatnonzero((ball == b) & (np.bitwise_count(f ^ at[a]) <= 2 * LIMIT))
            for x in xs.tolist():
                hit = np.flatnonzero(np.bitwise_count(f[ys] ^ f[x]) <= LIMIT)
                if len(hit):
                    join(a, b, x, int(ys[hit[0]]))
                    break
    return links


def key_links(key: np.ndarray, fp: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Links (n, 2) within the keys; rows sorted by key, each key whole."""
    found = [np.empty((0, 2), dtype=np.uint64)]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(edge)
    size_of = np.repeat(sizes, sizes)
    for lag in range(1, SMALL):
        i = np.flatnonzero((key[lag:] == key[:-lag]) & (size_of[lag:] <= SMALL))
        if not len(i):
            break
        x = fp[i] ^ fp[i + lag]
        held = (x != 0) & (np.bitwise_count(x) <= LIMIT) & ((start[i] < 0) | chain_holds(x, start[i]))
        found.append(np.stack([fp[i][held], fp[i + lag][held]], axis=1))
    for k in np.flatnonzero(sizes > SMALL).tolist():
        found.append(np.array(leader_links(np.unique(fp[edge[k] : edge[k + 1]])), dtype=np.uint64).reshape(-1, 2))
    return np.concatenate(found)


def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, agreed) arrive sorted by key. Gives links (a, b), and of keys of over MOST rows the rows (a, agreed).

    The last key of a batch waits for the next batch, until it has too many rows to be compared.
    """
    def links(key, fp, agreed):
        pairs = key_links(key, fp, start_of(agreed)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=["a", "b", "agreed"])

    def passed_on(fp, agreed):
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(agreed.view(np.int64))], names=["a", "b", "agreed"])

    held: list[tuple[np.ndarray, ...]] = []
    large = None
    for b in batches:
        key, fp, agreed = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy().view(np.uint64)
        if not len(key):
            continue
        if large is not None:
            n = int(np.searchsorted(key, large, side="right"))
            yield passed_on(fp[:n], agreed[:n])
            if n == len(key):
                continue
            key, fp, agreed, large = key[n:], fp[n:], agreed[n:], None
        if held:
            key, fp, agreed = (np.concatenate(x) for x in zip(*held, (key, fp, agreed), strict=True))
            held = []
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        whole = np.repeat(np.diff(edge) <= MOST, np.diff(edge))
        last = int(edge[-2])
        if whole[last]:
            held = [(key[last:], fp[last:], agreed[last:])]
        else:
            large = key[-1]
        if not whole.all():
            yield passed_on(fp[~whole], agreed[~whole])
        whole = np.flatnonzero(whole[: last if held else len(key)])
        if len(whole):
            yield links(key[whole], fp[whole], agreed[whole])
    if held:
        yield links(*held[0])


def start_of(agreed: np.ndarray) -> np.ndarray:
    """The start in the ring to which a mask of agreed bits belongs; -1 if bits were added to it."""
    start = np.full(len(agreed), -1)
    for k, mask in enumerate(ring_masks()):
        start[agreed == mask] = k // 2
    return start


def ring_masks() -> np.ndarray:
    """The bits that two fingerprints of one key agree on, for each start and half of the next segment."""
    return np.array([((0xFFFF << BITS * i) | (0xFF << (BITS * ((i + 1) % SEGMENTS) + 8 * half))) for i in range(SEGMENTS) for half in range(2)], dtype=np.uint64)


def quarters(agreed: int) -> list[int]:
    """The mask with a quarter of the other bits added, for each quarter; alternate bits, so that a quarter spreads over the ring."""
    other = [b for b in range(64) if not agreed >> b & 1]
    return [agreed | sum(1 << b for b in other[k::4]) for k in range(4)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def filed_under(fps: DataFrame, masks: Column) -> DataFrame:
    """(key, fp, agreed): each fingerprint under each of its masks."""
    filed = fps.select("fp", F.explode(masks).alias("agreed"))
    return filed.select(F.xxhash64("agreed", F.col("fp").bitwiseAND(F.col("agreed"))).alias("key"), "fp", "agreed")


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints within 3 bits."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = filed_under(fps, F.array(*[F.lit(signed(int(m))) for m in ring_masks()]))
    links = None
    while True:
        met = cut(filed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(links_of, "a long, b long, agreed long"))
        found = met.where("b is not null").select("a", "b")
        links = found if links is None else links.unionByName(found)
        masks = [r[0] for r in met.where("b is null").select("agreed").distinct().collect()]  # 8 at first, at most four times as many a round
        if not masks:
            return links.distinct()
        more = fps.sparkSession.createDataFrame([(m, [signed(q) for q in quarters(m % (1 << 64))]) for m in masks], "agreed long, masks array<long>")
        large = met.where("b is null").select(F.col("a").alias("fp"), "agreed").join(F.broadcast(more), "agreed")
        filed = filed_under(large.select("fp", "masks"), F.col("masks"))


def verified_links(docs: DataFrame, text_col: str, rows: DataFrame, links: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links between texts (by node) of that similarity: among those within 3 bits, and all others.

    Each fingerprint's texts are compared with its first one, and the first ones of linked fingerprints with each other.
    """
    marks = cut(rows.where("shingles > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("print", "shingles", "bits")]))
    first = marks.groupBy("print").agg(F.min("node").alias("first"))
    equal = marks.join(first, "print").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = (first.select(F.col("print").alias(k), F.col("first").alias(f"_{k}")) for k in ("a", "b"))
    near = links.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    texts = pick(docs, text=text_col).where("text is not null").select(F.xxhash64("text").alias("node"), "text")
    return similar_links(texts, marks.withColumn("fp", F.col("node")), candidates=equal.unionByName(near), similarity=similarity, shingle=shingle)


def linked_rows(docs: DataFrame, id_col: str, text_col: str, similarity: float | None, shingle: int, verify: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows doc_id, KEYS, fp, print, n: distinct rows and how often they come; fp, root, component_id, n: what is linked, and its components).

    print is the fingerprint, and so is fp, unless `verify`: then fp stands for the text (0 for all without words).
    """
    made = fingerprints(docs, id_col, text_col, shingle if similarity is not None else None).withColumn("print", F.col("fp"))
    if verify:
        made = made.withColumn("node", F.when(F.col("shingles") > 0, F.col("node")).otherwise(F.lit(0))).withColumn("fp", F.col("node"))
    rows = cut(made.groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in made.columns if c not in KEYS], F.count("*").alias("n")))
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    if verify:
        prints = rows.where("shingles > 0").select(F.col("print").alias("fp")).distinct()
        links = verified_links(docs, text_col, rows, cut(link_fingerprints(prints)), similarity, shingle)
    else:
        links = link_fingerprints(groups.select("fp"))
    if similarity is not None and not verify:
        links = cut(links)
        texts = pick(docs, text=text_col).where("text is not null").select(F.xxhash64("text").alias("node"), "text")
        marks = cut(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "shingles", "bits")]))
        links = links.unionByName(similar_links(texts, marks, links, similarity=similarity, shingle=shingle))
    if similarity is not None:
        rows = rows.drop("node", "shingles", "bits")
    roots = cut(connected_components(links))
    # A component's root is a node without a row of its own in roots.
    members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    least = members.join(groups.select("fp", "least_id"), "fp").groupBy("root").agg(F.min("least_id").alias("component_id"))
    labelled = members.join(least, "root")
    return rows, cut(groups.join(labelled, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least_id").alias("component_id"), "n"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, shingle: int = 5, verify: bool = False) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id (the smallest doc_id reachable over links of at most 3 bits).

    With `similarity`, texts whose sets of `shingle`-word shingles have at least that Jaccard similarity are linked too,
    all of them, however many bits their fingerprints differ in. With `verify` no others are: links of 3 bits, and texts with equal
    fingerprints, are compared by their shingles too.

    Null texts and texts without words have the fingerprint 0, which links like any other; texts of any length are read
    whole. Repeated rows stay rows of their own in the same component. A null id never is the smallest, unless the
    component has no other. Extra columns do no harm. An empty table gives no rows.
    """
    rows, named = linked_rows(docs, id_col, text_col, similarity, shingle, verify)
    labelled = join_by_frequency(rows.withColumnRenamed("n", "times"), named.drop("root"), "fp", "n")
    return repeated(labelled, "times").select("doc_id", F.col("print").alias("fp"), "component_id")


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, shingle: int = 5, verify: bool = False) -> DataFrame:
    """Of each component (as near_duplicates has them) the row with the smallest id, whole.

    Rows that share an id but differ otherwise are told apart, so each component keeps one row; of several rows with its
    smallest id the one with the least hash of all columns stays, however the table is partitioned. Rows without an id
    stand last. Null and empty texts, and all others without words, are one component. Texts of any length are read whole; an empty table gives no
    rows; extra columns are kept and do no harm.
    """
    rows, named = linked_rows(docs, id_col, text_col, similarity, shingle, verify)
    labelled = join_by_frequency(rows.withColumnRenamed("n", "times"), named.select("fp", "root", "n"), "fp", "n")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *KEYS, "times")).alias("first")
    chosen = cut(labelled.groupBy("root").agg(first).select(*[f"first.{k}" for k in KEYS], F.col("first.times").alias("n")))
    flat = positional(docs)
    return one_of_each(flat.select("*", *row_keys(flat)), chosen).select(*flat.columns).toDF(*docs.columns)
