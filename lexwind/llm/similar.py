"""Exact links of near copies: all pairs of texts whose sets of word shingles have a Jaccard similarity of at least a bound.

If two sets of sizes m <= n share at least the share s of their union, then in any common order of shingles the first
n - ceil(s * n) + 1 of the one and the first m - ceil(s * m) + 1 of the other have one in common, so texts are filed under
those alone (prefix filtering). Rare shingles come first: the frequent ones of a sample stand last by their counts, the
others by their hashes. The sample only decides how many candidates there are, never which links are found. Candidates
must agree in size, in what can follow their shared shingle and in enough parities of their shingles (bits that differ
are at most the shingles that differ); what is left is compared set by set, unless links already connect it.

Texts that share a shingle are compared all with all only in groups of up to SMALL. In a larger group (near copies, shared
passages) each is first compared with one leader, which the shared shingle chooses out of three. Then what the links found so far connect is one component, and only
texts of different components are compared, those of the largest component never with each other. So no link between
components is lost, and a group of near copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwind.llm.common import cut, release
from lexwind.llm.components import connected_components

SAMPLE, FREQUENT, SEEN, PARITIES, SMALL = 20_000, 1 << 17, 1 << 20, 1024, 16


class WordHashes(dict):
    """64-bit hashes of words, kept while they are fewer than `most`."""

    def __init__(self, most: int = 1 << 20):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word, 42)
        return made


KNOWN = WordHashes()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of the text's word shingles, lower-cased as for a fingerprint; empty without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def prefix(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray, share: Fraction) -> np.ndarray:
    """The shingles that a set is filed under, in the common order; `frequent` is sorted, `rank` counts from 1."""
    n = len(hashes)
    most = n + int(share * -n // 1) + 1 if n else 0
    place = np.zeros(n, dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        place = np.where(frequent[at] == hashes, rank[at], 0)
    return hashes[np.argsort(place, kind="stable")[:most]]


def frequent_shingles(texts: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the n texts repeats, sorted by hash, and the place of each by its count."""
    some = texts.where(F.pmod("node", F.lit(1 << 20)) * F.lit(n) < F.lit(SAMPLE << 20)) if n > SAMPLE else texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.concatenate([np.empty(0, dtype=np.uint64), *(shingle_set(t.as_py(), shingle) for t in b.column(1))])
            values, counts = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["shingle", "n"])

    counts = some.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2")
    rows = counts.orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).toArrow()
    hashes = rows["shingle"].to_numpy().view(np.uint64)[::-1]
    order = np.argsort(hashes, kind="stable")
    return hashes[order], order + 1


def parities(hashes: np.ndarray) -> bytes:
    """For each of PARITIES cells whether the number of hashes in it is odd."""
    return np.packbits(np.bincount((hashes % PARITIES).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def keys_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


class Rule:
    """What a pair of sets must meet to be similar, by sizes, places of a shared shingle and parities; in whole numbers."""

    def __init__(self, share: Fraction):
        self.p, self.q = share.numerator, share.denominator

    def sizes(self, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (m * self.q >= n * self.p) & (n * self.q >= m * self.p)

    def places(self, m: np.ndarray, at_m: np.ndarray, n: np.ndarray, at_n: np.ndarray) -> np.ndarray:
        """If the shared shingle is the first that they share."""
        return np.minimum(m - at_m, n - at_n) * (self.p + self.q) >= (m + n) * self.p

    def bits(self, x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
        """`both` are the sums of the sizes."""
        return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) * (self.p + self.q) <= (self.q - self.p) * both


def ordered(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    return [np.minimum(x, y), np.maximum(x, y)]


def pairs_of_small(key: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, rule: Rule) -> Iterator[list[np.ndarray]]:
    """Pairs of nodes that share a key and can be similar; rows sorted by key, size and node, each key whole."""
    i, lag = np.arange(len(key)), 1
    while True:
        i = i[i + lag < len(key)]
        j = i + lag
        near = (key[i] == key[j]) & rule.sizes(n[i], n[j])  # sizes rise, so a row that fails is done
        i, j = i[near], j[near]
        if not len(i):
            return
        held = rule.places(n[i], at[i], n[j], at[j]) & (node[i] != node[j])
        if held.any():
            yield ordered(node[i[held]], node[j[held]])
        lag += 1


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray | pa.Array]]:
    """Batches sorted by their first column, put together so that no key is parted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and b.column(0)[-1] == held[0].column(0)[0]:
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
        last = int(np.searchsorted(t.column(0).to_numpy(), t.column(0)[-1].as_py()))
        if last:
            yield t.slice(0, last)
        held = [t.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def similar_links(texts: DataFrame, marks: DataFrame, links: DataFrame | None = None, *, candidates: DataFrame | None = None, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """Links (a, b) between fingerprints that connect, along with `links`, all texts whose shingle sets are that similar.

    texts: node (a hash of the text) and text, not null; marks: node, fp, shingles (how many), bits (parities). In place of `links`
    there may be `candidates`, pairs (a, b) of nodes that are compared first; those that are similar are among the result. Texts
    without words have no shingles and no links; texts of any length are compared whole; repeated texts are one; of an empty
    table there are no links; extra columns do no harm.
    """
    share = Fraction(str(similarity))
    rule = Rule(share)
    frequent, rank = frequent_shingles(texts, marks.count(), shingle)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, nodes, sizes = [np.empty(0, dtype=np.uint64)], [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if node in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                hashes = shingle_set(text.as_py(), shingle)
                keys.append(prefix(hashes, frequent, rank, share))
                nodes.append(node)
                sizes.append(len(hashes))
            filed = np.array([len(k) for k in keys[1:]], dtype=np.int64)
            at = [np.empty(0, dtype=np.int32), *(np.arange(k, dtype=np.int32) for k in filed)]
            columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, dtype=np.int64), filed), np.repeat(np.array(sizes, dtype=np.int32), filed), np.concatenate(at)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n", "at"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) of small keys and of large keys' leaders; the rows of large keys besides, with b null."""
        names = ["a", "b", "key", "n", "at"]

        def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32())], names=names)

        for t in whole_keys(batches):
            key, node, n, at = (c.to_numpy() for c in t.columns)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node, n, at = key[new], node[new], n[new].astype(np.int64), at[new].astype(np.int64)
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.repeat(np.diff(edge), np.diff(edge))
            few = size <= SMALL
            for a, b in pairs_of_small(key[few], node[few], n[few], at[few], rule):
                yield found(a, b)
            if few.all():
                continue
            lead = np.repeat(edge[:-1] + np.diff(edge) * (1 + key[edge[:-1]].view(np.uint64) % np.uint64(3)).astype(np.int64) // 4, np.diff(edge))
            held = ~few & rule.sizes(n, n[lead]) & rule.places(n, at, n[lead], at[lead]) & (node != node[lead])
            yield found(*ordered(node[held], node[lead[held]]))
            many = np.flatnonzero(~few)
            for x in range(0, len(many), 1 << 16):
                i = many[x : x + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.nulls(len(i), pa.int64()), pa.array(key[i]), pa.array(n[i].astype(np.int32)), pa.array(at[i].astype(np.int32))], names=names)

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bits that differ are at most the shingles that differ, which a similar pair has few of."""
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint64).reshape(-1, PARITIES // 64) for c in (b.column("x"), b.column("y")))
            yield b.select(["a", "b", "fp_a", "fp_b"]).filter(pa.array(rule.bits(x, y, b.column("n").to_numpy())))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = shingle_set(x.as_py(), shingle), shingle_set(y.as_py(), shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both * share.denominator >= (len(x) + len(y) - both) * share.numerator)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    def rooted(roots: DataFrame) -> DataFrame:
        members = roots.select(F.col("node").alias("fp"), "root")
        return cut(marks.join(members, "fp", "left").withColumn("root", F.coalesce("root", "fp")))

    def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Links of the pairs that aren't connected yet and are similar."""
        a, b = (known.select(F.col("node").alias(k), F.col("fp").alias(f"fp_{k}"), F.col("shingles").alias(f"n_{k}"), F.col("bits").alias(v), F.col("root").alias(f"root_{k}")) for k, v in (("a", "x"), ("b", "y")))
        met = pairs.join(a, "a").join(b, "b").where("root_a != root_b").select("a", "b", "fp_a", "fp_b", (F.col("n_a") + F.col("n_b")).alias("n"), "x", "y")
        likely = cut(met.mapInArrow(rule_out, "a long, b long, fp_a long, fp_b long"))
        # Texts are shuffled rather than their hashes, which don't compress.
        whole = texts.join(keys_of(likely), "node", "left_semi").dropDuplicates(["node"])
        both = likely.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b").select("fp_a", "fp_b", "x", "y")
        return cut(both.mapInArrow(compare, "a long, b long").distinct())

    near = None
    if candidates is not None:
        links = near = verified(candidates.distinct(), marks.withColumn("root", F.col("fp")))
    filed = texts.mapInArrow(file, "key long, node long, n int, at int")
    met = cut(filed.repartition(parts, "key").sortWithinPartitions("key", "n", "node").mapInArrow(pair, "a long, b long, key long, n int, at int"))
    release(texts.sparkSession)
    first = verified(met.where("b is not null").select("a", "b").distinct(), rooted(connected_components(links)))
    release(texts.sparkSession)
    large = met.where("b is null").select("key", F.col("a").alias("node"), "n", "at")
    found = first if near is None else near.unionByName(first)
    if large.isEmpty():
        return found
    known = rooted(connected_components(links.unionByName(first)))
    # A key matters only if its texts are of several components; how many aren't of the largest one is counted first.
    sizes = large.join(known.select("node", "root"), "node").groupBy("key", "root").agg(F.count("*").alias("n"))
    parted = cut(sizes.groupBy("key").agg((F.sum("n") - F.max("n")).alias("others")).where("others > 0").select("key"))
    rest = large.join(known.select("node", "root", "bits"), "node").join(parted, "key", "left_semi").select("key", "node", "n", "at", "root", "bits")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of different components within a key; the rows of the largest component are not compared with each other."""
        for t in whole_keys(batches):
            key, node, n, at, root = (c.to_numpy() for c in t.columns[:5])
            n, at = n.astype(np.int64), at.astype(np.int64)
            bits = np.frombuffer(b"".join(t.column(5).to_pylist()), dtype=np.uint64).reshape(-1, PARITIES // 64)
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            for first_, last in zip(edge[:-1], edge[1:], strict=True):
                names, counts = np.unique(root[first_:last], return_counts=True)
                largest = names[counts.argmax()]
                out = [[np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]]
                for i in (first_ + np.flatnonzero(root[first_:last] != largest)).tolist():
                    j = np.arange(first_, last)
                    j = j[(root[j] != root[i]) & ((root[j] == largest) | (j > i))]
                    j = j[rule.sizes(n[j], n[i]) & rule.places(n[j], at[j], n[i], at[i])]
                    j = j[rule.bits(bits[j], bits[i], n[j] + n[i])]
                    for side, x in zip(out, ordered(node[j], np.full(len(j), node[i])), strict=True):
                        side.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["a", "b"])

    more = cut(rest.repartition(parts, "key").sortWithinPartitions("key", "n", "node").mapInArrow(cross, "a long, b long").distinct())
    release(texts.sparkSession)
    if more.isEmpty():
        return found
    second = verified(more, known)
    release(texts.sparkSession)
    return found.unionByName(second)
