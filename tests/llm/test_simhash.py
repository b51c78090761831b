import random
import re

import numpy as np
import pytest
import xxhash
from llm_helpers import clashing

from lexwind.llm.components import connected_components
from lexwind.llm.queries import QUERIES
from lexwind.llm.simhash import chain_holds, fingerprint, keep_representatives, leader_links, link_fingerprints, near_duplicates


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints):
    """prints: {node: fingerprint}; the smallest node of each node's component."""
    label = {n: n for n in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[a] > label[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "a b c", "A b C d E", "É é word " * 9, "x " * 40_000])
def test_fingerprint_by_hand(text):
    assert fingerprint(text) == by_hand(text)


def test_chain_of_budgets_never_loses_a_pair():
    draw = random.Random(3)
    for _ in range(3000):
        x = 0
        for _ in range(draw.randrange(1, 4)):
            x |= 1 << draw.randrange(64)
        hold = chain_holds(np.full(4, x, dtype=np.uint64), np.arange(4))
        starts = [i for i in range(4) if hold[i]]
        assert starts and all(x >> (16 * i) & 0xFFFF == 0 for i in starts)


def close_prints(draw, n, centres, flips):
    base = [draw.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = draw.choice(base)
        for _ in range(draw.randrange(flips)):
            x ^= 1 << draw.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("n", "centres", "flips"), [(1, 1, 1), (40, 1, 4), (120, 3, 7), (300, 5, 9)])
def test_leaders_connect_what_all_pairs_connect(n, centres, flips):
    prints = close_prints(random.Random(n), n, centres, flips)
    links = leader_links(np.array(prints, dtype=np.uint64))
    assert all((a ^ b).bit_count() <= 3 for a, b in links) and len(links) < max(2, 2 * n)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == groups_by_hand({p: p for p in prints})


def test_links_over_keys_by_brute_force(spark):
    draw = random.Random(8)
    prints = close_prints(draw, 260, 2, 6) + [draw.getrandbits(64) for _ in range(300)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = {r.node: r.root for r in connected_components(link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    want = groups_by_hand({s: p for s, p in zip(signed, prints, strict=True)})
    assert {s: roots.get(s, s) for s in signed} == want


def test_long_chains_are_one_component(spark):
    edges = spark.range(200).selectExpr("(id * 37) % 200 as a", "((id * 37) % 200 + 1) as b")
    assert {r.root for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.where("a < 0")).count() == 0


@pytest.mark.parametrize("held", [1 << 17, 150, 7])
def test_components_by_brute_force(spark, held):
    draw = random.Random(5)
    edges = [(draw.randrange(-300, 300), draw.randrange(-300, 300)) for _ in range(240)] + [(1 << 62, k) for k in range(1000, 1040)] + [(2000, 2000)]
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), held).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == {x: y for x, y in label.items() if x != y}


def test_small_graphs_take_few_stages(spark):
    edges = spark.range(2000).selectExpr("id AS a", "id + 1 AS b").repartition(4)
    spark.sparkContext.setJobGroup("small graph", "")
    connected_components(edges)
    spark.sparkContext.setJobGroup("others", "")
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("small graph") for s in tracker.getJobInfo(j).stageIds}
    assert len(stages) <= 10


ROWS = [(5, None), (4, ""), (9, "  "), (3, "same text here today"), (7, "same text here today"), (7, "same text here today"), (1, "SAME text here today"), (2, "quite another thing entirely"), (None, "same text here today"), (None, "only without id at all"), (None, "only without id at all"), (8, "long " * 50_000)]


def test_rows_of_all_kinds(spark):
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(clashing(spark.createDataFrame(ROWS, "doc_id long, text string"))).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (9, 4), (3, 1), (7, 1), (7, 1), (1, 1), (2, 2), (None, 1), (None, None), (None, None), (8, 8)], key=str)


def test_one_of_each_group_stays(spark):
    docs = clashing(spark.createDataFrame(ROWS, "doc_id long, text string"))
    out = keep_representatives(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in out.collect()), key=str) == sorted([(4, ""), (1, "SAME "), (2, "quite"), (8, "long "), (None, "only ")], key=str)


def test_empty_table(spark, empty_docs):
    assert near_duplicates(empty_docs).count() == 0 and keep_representatives(empty_docs).count() == 0


def test_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    prints = {d: by_hand(t) for d, t in docs.items()}
    want = groups_by_hand(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_pigeonring_simhash"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in docs}


def test_large_keys_are_split(spark, monkeypatch):
    """With keys of at most 20 fingerprints, groups of near copies go on to quarters of their bits and lose no link."""
    from lexwind.llm import simhash

    monkeypatch.setattr(simhash, "MOST", 20)
    draw = random.Random(9)
    prints = close_prints(draw, 400, 2, 7) + [draw.getrandbits(64) for _ in range(100)]
    keys = np.repeat(np.arange(3), [10, 90, 15])
    import pyarrow as pa

    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(np.array(prints[:115], dtype=np.uint64).view(np.int64)[a:b]), pa.array(np.zeros(115, dtype=np.int64)[a:b])], names=["key", "fp", "agreed"])
    for cuts in ([0, 115], [0, 5, 15, 40, 41, 100, 103, 115]):
        out = list(simhash.links_of(batch(a, b) for a, b in zip(cuts, cuts[1:], strict=False)))
        assert sum(x.num_rows for x in out if x.column(2).null_count == 0 and x.num_rows) == 90
    monkeypatch.undo()
    assert all(len({q for q in simhash.quarters(int(m))}) == 4 for m in simhash.ring_masks())


def test_split_keys_give_the_same_components(spark):
    """The same links whether or not keys are split: MOST is set where the workers read it."""
    import pyarrow as pa

    from lexwind.llm import simhash

    draw = random.Random(10)
    prints = sorted(set(close_prints(draw, 300, 2, 6)))
    fps = np.array(prints, dtype=np.uint64)
    links, agreed, most = [], [int(m) for m in simhash.ring_masks()], simhash.MOST
    try:
        simhash.MOST = 12
        rows = [(m, int(f)) for f in prints for m in agreed]
        rounds = 0
        while rows:
            rounds += 1
            rows.sort(key=lambda r: (r[0], r[0] & r[1], r[1]))
            key = np.cumsum([0] + [int(a[0] != b[0] or a[0] & a[1] != b[0] & b[1]) for a, b in zip(rows, rows[1:], strict=False)])
            batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array([f for _, f in rows], dtype=np.uint64).view(np.int64)), pa.array(np.array([m for m, _ in rows], dtype=np.uint64).view(np.int64))], names=["key", "fp", "agreed"])
            rows = []
            for out in simhash.links_of(iter([batch.slice(0, 700), batch.slice(700)])):
                for a, b, m in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    if m is None:
                        links.append((a % (1 << 64), b % (1 << 64)))
                    else:
                        rows += [(q, a % (1 << 64)) for q in simhash.quarters(m % (1 << 64))]
    finally:
        simhash.MOST = most
    assert rounds > 2 and all((a ^ b).bit_count() <= 3 for a, b in links)
    label = {int(f): int(f) for f in fps}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert label == groups_by_hand({p: p for p in prints})


@pytest.mark.parametrize("order", [0, 1, 2])
def test_rows_that_share_an_id_are_told_apart(spark, order):
    one, other = "a text of its own about the sea and ships", "quite another text that speaks of mountains only"
    rows = [(7, one), (7, other), (3, one)]
    rows = rows[order:] + rows[:order]
    out = keep_representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + order)).collect()
    assert sorted(map(tuple, out)) == [(3, one), (7, other)]
    out = keep_representatives(spark.createDataFrame([r for r in rows if r[0] == 7], "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == [(7, one), (7, other)]


def test_representatives_are_the_same_after_repartitioning(spark):
    draw = random.Random(12)
    texts = [" ".join(f"w{draw.randrange(40)}" for _ in range(12)) for _ in range(30)]
    rows = [(draw.randrange(8), draw.choice(texts), draw.choice("ab"), {"k": draw.randrange(2)}) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, more map<string,int>")
    kept = [sorted(map(str, keep_representatives(df.repartition(n)).collect())) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == len({r[1] for r in rows})
