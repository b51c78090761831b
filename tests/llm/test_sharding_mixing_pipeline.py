import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_helpers import clashing
from pyspark.sql import functions as F

from lexwind.llm.mixing import materialise, mix_documents, mix_rows, pivotal, round_chunk, source_targets
from lexwind.llm.queries import QUERIES
from lexwind.llm.sharding import kd_shards, write_shards

FOLDER = "/root/testdata/sf0.001"


def check_shards(rows, got, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_of_all_kinds(spark):
    draw = random.Random(6)
    rows = [(i, "x" * draw.randrange(2000), draw.choice(["en", "fr", None]), draw.choice(["hot"] * 5 + ["b", "c", None])) for i in range(1500)]
    rows += [(2000 + i, "copy of a text", "en", "hot") for i in range(200)] + [(3000, None, None, None), (3001, "", "", ""), (None, "no id", "en", "b"), (5, "again", "en", "b"), (5, "again", "en", "b")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = kd_shards(df, levels=3).collect()
    check_shards([r[:2] for r in rows], got, 8)
    loads = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) < 0.03 * sum(loads) / 8 + 4000
    assert len({r.shard for r in got if r.doc_id and 2000 <= r.doc_id < 2200}) == 1


def test_a_heavy_group_is_dealt(spark):
    rows = [(i, "the same text" * 20, "en", "a") for i in range(600)] + [(1000 + i, f"text {i}" * 5, "en", "a") for i in range(100)]
    got = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), levels=2).collect()
    loads = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    assert max(loads) < 1.05 * sum(loads) / 4


def test_few_and_no_documents(spark, empty_docs, tmp_path):
    assert kd_shards(empty_docs).count() == 0
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], empty_docs.schema)
    assert [(r.shard in range(16), r.slot) for r in kd_shards(one).collect()] == [(True, 0)]
    write_shards(one, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "a"


def test_every_row_is_written_once(spark, tmp_path):
    rows = [(None, "no id", "en", "s", 1)] * 5 + [(1, "one", "en", "s", 2), (1, "one", "en", "t", 3), (1, "two", None, None, None)] + [(2, "hot", "en", "s", 4)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    write_shards(docs, str(tmp_path / "out"), levels=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text", "lang", "source", "_shard").collect())) == sorted(str(r).replace("shard=", "_shard=") for r in docs.collect())
    for s in range(4):
        slots = sorted(r.slot for r in back.where(F.col("shard") == s).collect())
        assert slots == list(range(len(slots)))


def leaves_by_hand(points, levels):
    """A plain k-d tree: points (weight, coordinates by dimension), split at the weighted median along the widest position."""
    if not levels:
        return [points]
    width = [max(p[1][d] >> 32 for p in points) - min(p[1][d] >> 32 for p in points) if points else 0 for d in range(3)]
    d = width.index(max(width))
    line = sorted({p[1][d] for p in points})
    total, below, at = sum(p[0] for p in points), 0, None
    for x in line:
        w = sum(p[0] for p in points if p[1][d] == x)
        if 2 * (below + w) >= total:
            at = x if 2 * (below + w) - total <= total - 2 * below else x - 1
            break
        below += w
    return [leaf for half in ([p for p in points if p[1][d] <= at], [p for p in points if p[1][d] > at]) for leaf in leaves_by_hand(half, levels - 1)]


def test_tree_by_brute_force(spark):
    from lexwind.llm.sharding import DIMENSIONS, assign_leaves

    draw = random.Random(7)
    points = [(i, draw.randrange(1, 500), float(draw.randrange(6)), float(draw.randrange(3)), draw.random() * 12, draw.getrandbits(32)) for i in range(900)]
    df = spark.createDataFrame(points, "g long, w long, x_lang double, x_source double, x_size double, h long").withColumn("n", F.lit(1))
    got = {}
    for r in assign_leaves(df, 3).collect():
        got.setdefault(r.node, set()).add(r.g)
    column = {"x_lang": 2, "x_source": 3, "x_size": 4}
    ends = {d: (min(p[column[d]] for p in points), max(p[column[d]] for p in points)) for d in DIMENSIONS}
    place = lambda p, d: (int((p[column[d]] - ends[d][0]) / (ends[d][1] - ends[d][0]) * ((1 << 20) - 1)) << 32) + p[5]
    leaves = leaves_by_hand([(p[1], [place(p, d) for d in DIMENSIONS], p[0]) for p in points], 3)
    assert [got.get(k, set()) for k in range(8)] == [{p[2] for p in leaf} for leaf in leaves]


def test_names_that_begin_alike_are_told_apart(spark):
    rows = [(i, f"text number {i} " * 10, "en", f"https://web.org/{'abcd'[i % 4]}") for i in range(400)] + [(1000 + i, "some text " * 10, "en", None) for i in range(2)]
    got = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), levels=2).collect()
    check_shards([r[:2] for r in rows], got, 4)
    source = {r[0]: r[3] for r in rows}
    assert sum(len({source[r.doc_id] for r in got if r.shard == s} - {None}) for s in range(4)) <= 9  # two sources a half and one at the cut; by hash alone it would be 16


def test_shard_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op9_kd_tree_shards"](spark, FOLDER).collect()
    check_shards(docs, got, 16)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def targets_by_hand(sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, fixed = dict.fromkeys(sizes, 0.0), {s for s in sizes if not sizes[s]}
    while True:
        left = sum(sizes.values()) - sum(target[s] for s in fixed)
        open_ = [s for s in sizes if s not in fixed]
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] = left * weights[s] / total
        over = {s for s in open_ if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        for s in over:
            target[s] = 3.0 * sizes[s]
        fixed |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 7}, {"a": 0, "b": 0}, {"x": 5}, {"a": 1, "b": 2, "c": 3, "d": 10_000, "e": 0, "é": 4, "Z": 900}, {None: 3}])
def test_targets_by_brute_force(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = targets_by_hand(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_pivotal_keeps_sums_and_chances():
    draw = np.random.default_rng(3)
    size, p = draw.integers(1, 60, size=31).astype(float), draw.uniform(0.01, 0.99, size=31)
    mean = np.zeros(31)
    for _ in range(4000):
        out = pivotal(size, p, draw.random(31))
        assert math.isclose((out * size).sum(), (p * size).sum(), rel_tol=1e-9) and ((out > 0) & (out < 1)).sum() <= 1 and out.min() >= 0 and out.max() <= 1
        mean += out / 4000
    assert np.abs(mean - p).max() < 0.04
    assert pivotal(np.array([5.0]), np.array([0.5]), np.array([0.1])).tolist() == [0.5]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_of_all_kinds(spark):
    rows = [(i, "w " * (i % 50), ["hot", "b", "c", None, "é"][0 if i % 3 else i % 5]) for i in range(3000)]
    rows += [(1, "again and again", "b"), (1, "again and again", "b"), (None, "no id here", "b"), (9000, None, "b"), (9001, "", None), (9002, "long " * 30_000, "c")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mix_documents(df, chunk_rows=100, fan_in=4).collect()
    assert sorted(((r.doc_id, r.size, r.source) for r in got), key=str) == sorted(((i, words(t), s) for i, t, s in rows), key=str)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets_by_hand(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, want[s], abs_tol=1e-6) and r.source_size == sizes[s] and 0 <= r.copies <= 3 for r in own)
        assert abs(sum(r.copies * r.size for r in own) - want[s]) <= max(r.size for r in own)
    again = mix_documents(df.repartition(5), chunk_rows=100, fan_in=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = materialise(df, mix_rows(df))
    assert mixed.columns == df.columns
    taken = {}
    for r in mix_documents(df).collect():
        taken[r.doc_id, r.source, r.size] = taken.get((r.doc_id, r.source, r.size), 0) + r.copies
    for r in mixed.collect():
        taken[r.doc_id, r.source, words(r.text)] -= 1
    assert not any(taken.values())


def test_equal_rows_are_one_entry(spark):
    """A row with a third of all copies, and a document whose copies are dealt over the tasks."""
    rows = [(1, "the same text", "a")] * 4000 + [(i, f"another text {i}", "ab"[i % 2]) for i in range(2, 4000)] + [(-1, "the same text", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_documents(df, chunk_rows=100).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 1 for r in got) == 4000
    mixed = mix_rows(df, chunk_rows=100)
    one = mixed.where("doc_id = 1").collect()
    assert len(one) == 1 and one[0].times == 4000
    rate = one[0].target / one[0].source_size
    assert abs(one[0].whole * 4000 + one[0].more - 4000 * rate) <= 1
    assert materialise(df, mixed).where("doc_id = 1").count() == one[0].whole * 4000 + one[0].more
    again = mix_documents(df.repartition(7), chunk_rows=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_by_brute_force(spark):
    """The whole reduction tree against a slow one, on rows of one source with chunks of 40 and three left-overs a node."""
    import pyarrow as pa
    import math as m

    rows = [(i, "w " * (i * 7 % 40), "a") for i in range(300)] + [(1000 + i, "x " * 90, "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.copies for r in mix_documents(df, chunk_rows=40, fan_in=3).collect()}
    keys = {r.doc_id: r.key for r in df.select("doc_id", F.xxhash64(F.xxhash64("doc_id", "text", "source"), F.xxhash64(F.lit(1), "doc_id", "text", "source"), F.lit(20)).alias("key")).collect()}
    size = {i: words(t) for i, t, _ in rows}
    want, per = {}, {s: sum(size[i] for i, _, x in rows if x == s) for s in "ab"}
    targets = targets_by_hand(per)
    for s in "ab":
        own = [i for i, _, x in rows if x == s]
        rate = min(targets[s] / per[s], 3.0)
        whole = m.floor(rate + 1e-9)
        part = rate - whole if rate - whole > 1e-9 else 0.0
        want |= {i: whole if size[i] else 0 for i in own}
        p = {i: part for i in own if size[i] and part}
        chunks = m.ceil(len(own) / 40)
        at = {i: keys[i] % chunks for i in p}
        deepest = m.ceil(300 / 40)
        while p:
            left = {}
            for c in sorted(set(at[i] for i in p)):
                order = sorted((i for i in p if at[i] == c), key=lambda i: (-size[i], keys[i]))
                draws = [((keys[i] % 2**64 * 0x9E3779B97F4A7C15 % 2**64) >> 11) / 2**53 for i in order]
                for i, x in zip(order, pivotal(np.array([size[i] for i in order], dtype=float), np.array([p[i] for i in order]), np.array(draws)).tolist(), strict=True):
                    if x in (0.0, 1.0):
                        want[i] += int(x)
                    else:
                        left[i] = x
            p = left
            if deepest == 1:
                break
            deepest = m.ceil(deepest / 3)
            at = {i: at[i] // 3 for i in p}
        for i, x in p.items():
            want[i] += (keys[i] & ((1 << 52) - 1)) / 2**52 < x
    assert got == want
    assert round_chunk(pa.table({"size": [3, 5], "key": [1, 2], "p": [0.5, 0.5]})).num_rows == 2


def test_empty_mix(spark, empty_docs):
    assert mix_documents(empty_docs).count() == 0 and materialise(empty_docs, mix_rows(empty_docs)).count() == 0


def test_mix_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = QUERIES["op10_pivotal_mixing"](spark, FOLDER).collect()
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    want = targets_by_hand(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and math.isclose(r.target, want[r.source], abs_tol=1e-6)
    largest = {s: max(words(r.text) for r in docs if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_pipeline_by_brute_force(spark):
    """Each stage on its own input: what it keeps, and that its decisions take effect."""
    import corpus_pipeline
    from test_search_secrets_language import spans_by_hand
    from test_simhash import by_hand as print_of
    from test_similar import similar

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "source_mixing", "packing"]
    after = {n: None for n in stage}
    for n, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, FOLDER)
        if n != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after[n] = docs.collect()
    kept = {r.doc_id for r in QUERIES["op2_robust_outliers"](spark, FOLDER).where("kept").collect()}
    assert {r.doc_id for r in after["quality_rules"]} == kept
    texts = {r.doc_id: r.text for r in after["quality_rules"]}
    prints = {d: print_of(t) for d, t in texts.items()}
    component = {d: d for d in texts}
    edges = [(a, b) for a in texts for b in texts if a < b and ((prints[a] ^ prints[b]).bit_count() <= 3 or similar(texts[a], texts[b]))]
    while any(component[a] != component[b] for a, b in edges):
        for a, b in edges:
            component[a] = component[b] = min(component[a], component[b])
    assert sorted(r.doc_id for r in after["simhash_near_dedup"]) == sorted(set(component.values()))
    before = {r.doc_id: r.text for r in after["simhash_near_dedup"]}
    for r in after["secret_scans"]:
        assert (r.text == before[r.doc_id]) == (not spans_by_hand(before[r.doc_id])) and not spans_by_hand(r.text) and r.n_chars == len(r.text)
    mix = {r.doc_id: r.copies for r in mix_documents(spark.createDataFrame(after["secret_scans"], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    times = {}
    for r in after["source_mixing"]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {d: c for d, c in mix.items() if c}
    packed = {}
    for r in after["packing"]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    tokens = {r.doc_id: r.doc_tokens for r in after["packing"]}
    assert packed == {d: tokens[d] * times[d] for d in times}


def test_pipeline_runs_and_handles_odd_rows(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    rows = [(None, "some text " * 20, None, None, None), (1, None, None, "s", 0), (1, "some other text, with words " * 9, "en", "s", 1), (1, "some other text, with words " * 9, "en", "s", 1), (2, "", "en", "s", 0)]
    for n, data in (("odd", rows), ("none", [])):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("Kept", F.lit(1)).write.parquet(str(tmp_path / n / "documents.parquet"))
        corpus_pipeline.run(spark, str(tmp_path / n)).collect()
