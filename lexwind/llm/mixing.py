"""Mixing sources to target weights by pivotal dependent rounding (operator 10).

Each source's target is its share of all words; dividing by what the source holds gives the copies a document gets in
expectation. The whole part is given at once. The fractional parts are rounded dependently: two documents of a source
are paired and probability mass moves between them in a random direction, weighted by their sizes so that the
expected words stay the same, until one of them is 0 or 1; the other goes on to the next pair. Every chance so stays
as it was, and the words taken stay at the target but for the last document left over.

Equal rows are paired with each other first: of n rows with the chance p, floor(n * p) get their copy and one is left
over with the fraction, so a row that comes very often is one entry from there on. The rest is a reduction tree: sources
are cut into chunks of bounded size by the hash of the row, every chunk is rounded in one task down to a single left-over
document, and the left-overs are rounded together, level by level, until a source has one, which a fair draw decides.
Draws are hashes of the rows, so reruns agree however rows are partitioned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexwind.llm.common import KEYS, attach, cut, one_of_each, positional, repeated, row_keys

#: The words of the mix contract: anything but a space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, n (rows), source_size, target for a table (source, size).

    Sources in code point order, nulls last, get the weights in turn and share all words. A target stops at `most`
    times its source's size and the excess is shared by weight among the others until none is above: that is the one
    level at which min(most * size, level * weight) add up to all words, found on sources ordered by size over weight.
    A row a source passes through one task, which is what ordering them takes: sources are names of collections, some
    millions at most, not addresses. With a column `times` a row counts so often.
    """
    times = F.col("times") if "times" in sizes.columns else F.lit(1)
    per = sizes.groupBy("source").agg(F.coalesce(F.sum(F.col("size") * times), F.lit(0)).cast("long").alias("source_size"), F.count("*").alias("n"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    per = (
        per.withColumn("capped_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("rank", F.row_number().over(fill))
        .withColumn("first_open", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("rank"))).over(every))
        .withColumn("level", F.max(F.when(F.col("rank") == F.col("first_open"), F.col("level"))).over(every))
    )
    open_target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return per.select("source", "n", "source_size", F.when(F.col("rank") < F.col("first_open"), F.col("cap")).otherwise(F.coalesce(open_target, F.col("cap"))).alias("target"))


def pivotal(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Round probabilities strictly inside (0, 1), in order; at most one is left over unrounded.

    A step moves mass between the current and the next document so that size * p of both stays in sum; the draw
    chooses the direction with the chances that keep each expectation.
    """
    p = p.astype(float).copy()
    i = 0
    for j in range(1, len(p)):
        if p[i] in (0.0, 1.0):
            i = j
            continue
        wi, wj = size[i], size[j]
        to_full, to_none = (1 - p[i]) * wi, p[i] * wi
        up, down = min(to_full, p[j] * wj), min(to_none, (1 - p[j]) * wj)
        if draws[j] * (up + down) < down:
            p[i], p[j] = (1.0, p[j] - up / wj) if to_full <= p[j] * wj else (p[i] + up / wi, 0.0)
        else:
            p[i], p[j] = (0.0, p[j] + down / wj) if to_none <= (1 - p[j]) * wj else (p[i] - down / wi, 1.0)
        for k in (i, j):
            if not 1e-12 < p[k] < 1 - 1e-12:
                p[k] = float(round(p[k]))
        if p[i] in (0.0, 1.0):
            i = j
    return p


def mix_rows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 20, chunk_rows: int = 2_000, fan_in: int = 1_000,
) -> DataFrame:
    """One row per distinct row of `docs`: KEYS, doc_id, size, source, source_size, target, times, whole, more.

    The row comes `times` times; each of these gets `whole` copies, and `more` of them get one besides.
    """
    flat = positional(docs)
    doc_id, text, source = (F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col, source_col))
    sized = flat.select(*row_keys(flat), doc_id.alias("doc_id"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), source.alias("source"))
    rows = cut(sized.groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source")], F.count("*").alias("times")))
    per = source_targets(rows, weights, most)
    per = cut(per.withColumn("chunks", F.ceil(F.col("n") / F.lit(chunk_rows)).cast("long")).drop("n"))
    joined = attach(rows, per, ["source"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    whole = F.floor(rate + F.lit(1e-9))
    part = F.when((F.col("size") > 0) & (rate - whole > 1e-9), rate - whole).otherwise(F.lit(0.0))
    joined = joined.withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(F.lit(0)).cast("long")).withColumn("p", part * F.col("times"))
    # Of equal rows all but one are rounded by pairing them with each other.
    joined = joined.withColumn("more", F.floor(F.col("p") + F.lit(1e-12)).cast("long"))
    joined = joined.withColumn("p", F.when(F.col("p") - F.col("more") > 1e-9, F.col("p") - F.col("more")).otherwise(F.lit(0.0)))
    joined = joined.withColumn("key", F.xxhash64(*KEYS, F.lit(seed)))
    sure = joined.where("p = 0").drop("p", "key", "chunks")
    unsure = joined.where("p > 0")
    # A hot source has as many chunks as its rows need; a small one has one.
    most_chunks = per.agg(F.max("chunks")).first()[0] or 1
    done = [sure]
    unsure = unsure.withColumn("chunk", F.pmod("key", "chunks")).drop("chunks")
    while True:
        rounded = cut(unsure.groupBy("source", "chunk").applyInArrow(round_chunk, unsure.schema))
        done.append(rounded.where("p = 0 or p = 1").withColumn("more", F.col("more") + F.col("p").cast("long")).drop("p", "key", "chunk"))
        left = rounded.where("p > 0 and p < 1")
        if most_chunks == 1:
            break
        most_chunks = math.ceil(most_chunks / fan_in)
        unsure = left.withColumn("chunk", F.floor(F.col("chunk") / F.lit(fan_in)).cast("long"))
    draw = (F.col("key").bitwiseAND((1 << 52) - 1)) / F.lit(float(1 << 52))
    done.append(left.withColumn("more", F.col("more") + F.when(draw < F.col("p"), 1).otherwise(0)).drop("p", "key", "chunk"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*KEYS, "doc_id", "size", "source", "source_size", "target", "times", "whole", "more")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies. Options are those of `mix_rows`.

    A null text has size 0; a document of size 0 gets no copy. Texts of any length are counted whole. The null source is a
    source of its own. Repeated rows are documents of their own, with copies that may differ by one; rows that share only
    the id are told apart. Extra columns do no harm. An empty table gives no rows.
    """
    rows = mix_rows(docs, **options)
    kinds = F.array(F.struct(F.col("more").alias("times"), (F.col("whole") + 1).alias("copies")), F.struct((F.col("times") - F.col("more")).alias("times"), F.col("whole").alias("copies")))
    kept = [*KEYS, "doc_id", "size", "source", "source_size", "target"]
    split = rows.select(*kept, F.explode(kinds).alias("kind")).select(*kept, "kind.times", "kind.copies")
    return repeated(split, "times").select("doc_id", "size", "source", "source_size", "target", "copies")


def round_chunk(rows: pa.Table) -> pa.Table:
    """Pivotal rounding of one source's chunk, from the largest document to the smallest, so a small one is left over."""
    rows = rows.sort_by([("size", "descending"), ("key", "ascending")])
    mixed = (rows["key"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    p = pivotal(rows["size"].to_numpy().astype(float), rows["p"].to_numpy(), mixed.astype(float) / float(1 << 53))
    return rows.set_column(rows.column_names.index("p"), "p", pa.array(p))


def materialise(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `docs`, each repeated as often as the mix says; `rows` are those that `mix_rows` gives for the same table.

    Of equal rows one stands for all, so only it is repeated; a row with very many copies is dealt over the tasks first.
    Nulls, empty and very long texts and extra columns stay as they are; an empty table gives no rows.
    """
    taken = cut(rows.select(*KEYS, (F.col("times") * F.col("whole") + F.col("more")).alias("_copies"), F.col("times").alias("n")).where("_copies > 0"))
    flat = positional(docs)
    return repeated(one_of_each(flat.select("*", *row_keys(flat)), taken), "_copies").select(*flat.columns).toDF(*docs.columns)
