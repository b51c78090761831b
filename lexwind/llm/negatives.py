"""Hard-negative mining by a full sort of each anchor's scores (operator 11).

Anchors and candidates are dealt into cells (group of anchors, shard of candidates) of bounded bytes by the hash of their
row numbers, so no label, id or group of equal vectors decides what a task holds. Two rounds go over the cells:

1. each anchor's best rows of its own label, k best a cell, merged by a window: its positives;
2. in a cell each anchor's integer scores are sorted together with the ids (best score first, then the smaller id), a binary
   search finds each positive's upper limit, and from there the k first rows of other labels above the lower limit are
   read; again a window merges the cells.

A cell's lists are k rows a positive at most, so what is shuffled is the cells' inputs and these lists. Anchors are
repeated once a shard and candidates once a group of anchors; both counts grow with the bytes a cell holds.

Weights and scores are whole numbers in doubles, which is exact while no sum can reach 2**53; anchors that could reach it
are scored with unbounded integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexwind.llm.common import cut, pick
from lexwind.llm.topk import EXACT, matrix, weights

LONG = 1 << 63
POSITIVES = "anchor long, anchor_id long, vec_id long, score long"
NEGATIVES = "anchor long, anchor_id long, nth int, vec_id long, score long, positive_id long, positive_score long"


class Shard:
    """Candidates of a cell in the order of their ids, and the scores of anchors over them."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table):
        candidates = candidates.sort_by([("id", "ascending"), ("row", "ascending")])
        self.width = max(matrix(t["w"]).shape[1] for t in (anchors, candidates))
        self.asked, self.vectors = matrix(anchors["w"], self.width), matrix(candidates["w"], self.width)
        self.ids, self.rows = candidates["id"].to_numpy(), candidates["row"].to_numpy()
        self.own, self.names = anchors["row"].to_numpy(), anchors["id"].to_numpy()
        labels = pa.chunked_array([*anchors["label"].chunks, *candidates["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        self.label, self.labels = labels[: anchors.num_rows], labels[anchors.num_rows :]
        largest = np.abs(self.vectors).max(axis=0, initial=0)
        with np.errstate(over="ignore"):
            self.exact = np.abs(self.asked) @ largest < EXACT

    def scores(self, anchors: np.ndarray, candidates: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        """Integer scores of the anchors; beyond 64 bits the nearest number that fits."""
        with np.errstate(over="ignore", invalid="ignore"):
            made = self.asked[anchors] @ self.vectors[candidates].T
        rows = []
        for i, row in zip(anchors.tolist(), made, strict=True):
            if self.exact[i]:
                rows.append(row.astype(np.int64))
                continue
            q = [(k, int(x)) for k, x in enumerate(self.asked[i].tolist()) if x]
            rows.append(np.array([max(-LONG, min(LONG - 1, sum(x * int(v[k]) for k, x in q))) for v in self.vectors[candidates]], dtype=np.int64))
        return rows


def in_steps(n: int, width: int, cells: int = 1 << 22) -> list[np.ndarray]:
    """Runs of 0..n-1, each so short that a matrix of `width` columns has about `cells` cells."""
    step = max(1, cells // max(1, width))
    return [np.arange(a, min(n, a + step)) for a in range(0, n, step)]


def best_first(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by score, best first, then by id."""
    return np.lexsort((ids, ~scores))


def positives_of(anchors: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """Each anchor's k best other rows of its label in this cell."""
    out: list[list] = [[], [], [], []]
    if anchors.num_rows and candidates.num_rows:
        cell = Shard(anchors, candidates)
        for label in np.unique(cell.label).tolist():
            mine, same = np.flatnonzero(cell.label == label), np.flatnonzero(cell.labels == label)
            for step in in_steps(len(mine), len(same)):
                for i, scores in zip(mine[step].tolist(), cell.scores(mine[step], same), strict=True):
                    other = cell.rows[same] != cell.own[i]
                    s, at = scores[other], same[other]
                    if len(s) > k:
                        held = s >= np.partition(s, len(s) - k)[len(s) - k]
                        s, at = s[held], at[held]
                    first = best_first(s, cell.ids[at])[:k]
                    for column, values in zip(out, ([cell.own[i]] * len(first), [cell.names[i]] * len(first), cell.ids[at[first]], s[first]), strict=True):
                        column.extend(values)
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor", "anchor_id", "vec_id", "score"])


def window(scores: np.ndarray, positive: int, k: int, low: int, of: int) -> slice:
    """Of scores sorted best first the places of the first k that are at most `positive` and have of * score >= low * positive."""
    first = int(np.searchsorted(~scores, ~np.int64(positive)))
    last = first
    while last < min(len(scores), first + k) and of * int(scores[last]) >= low * positive:
        last += 1
    return slice(first, last)


def negatives_of(anchors: pa.Table, candidates: pa.Table, k: int, low: int, of: int) -> pa.Table:
    """For each anchor and positive the first k rows of other labels within the limits in this cell."""
    out: list[list] = [[] for _ in range(7)]
    if anchors.num_rows and candidates.num_rows:
        cell = Shard(anchors, candidates)
        positives = anchors["positives"].to_pylist()
        for step in in_steps(anchors.num_rows, candidates.num_rows):
            for i, scores in zip(step.tolist(), cell.scores(step), strict=True):
                other = np.flatnonzero(cell.labels != cell.label[i])
                order = other[best_first(scores[other], cell.ids[other])]
                ids, scores = cell.ids[order], scores[order]
                for p in positives[i]:
                    part = window(scores, p["score"], k, low, of)
                    n = part.stop - part.start
                    same = (cell.own[i], cell.names[i], p["nth"])
                    for column, values in zip(out, (*([x] * n for x in same), ids[part], scores[part], [p["vec_id"]] * n, [p["score"]] * n), strict=True):
                        column.extend(values)
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
    return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[c.split()[0] for c in NEGATIVES.split(", ")])


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", k_positives: int = 5,
    k: int = 5, low: int = 80, of: int = 100, scale: float = 256.0, cell_bytes: int = 16 << 20, least_rows: int = 1024,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    `is_anchor` is a condition on the columns id and label. An anchor's positives are its k_positives best other rows of its
    label; for each, the k best rows of other labels with low * positive <= of * negative <= of * positive (`low` and `of` are
    whole numbers). Best means the higher score, then the smaller id.

    Rows without an id or a label take no part, nor do null vectors and those with null or non-finite components. Every row
    stands for itself: of rows that share an id, or are equal, each is an anchor and a candidate of the others. Vectors of
    unequal length count as filled up with zeros. Scores beyond 64 bits count as the nearest number that fits. Positives
    below 0 have no negatives, since no score lies between the limits; those of 0 have the scores of 0. With fewer positives or negatives
    all are returned; an anchor without either gives no rows, as does an empty table. Extra columns do no harm.
    """
    rows = pick(vectors, id=id_col, label=label_col, v=vector_col).select(F.col("id").cast("long").alias("id"), "label", weights("v", scale).alias("w"))
    rows = cut(rows.where("id is not null and label is not null and w is not null").withColumn("row", F.monotonically_increasing_id()))
    asking = rows.where(is_anchor)
    n, n_anchors, width = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("w"))).first()
    each = 8 * max(1, width or 0) + 64
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / least_rows)))
    groups, shards = max(1, math.ceil(n_anchors * each / cell_bytes)), max(tasks, math.ceil(n * each / cell_bytes))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    def dealt(anchors: DataFrame):
        asked = anchors.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))).withColumn("s", every(shards))
        named = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of both sides must not be the same ones
        held = named.withColumn("s", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards))).withColumn("g", every(groups))
        return asked.groupBy("g", "s").cogroup(held.groupBy("g", "s"))

    def nth(*keys: str) -> Column:
        return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id"))

    found = dealt(asking).applyInArrow(lambda a, c: positives_of(a, c, k_positives), POSITIVES)
    best = found.withColumn("nth", nth("anchor")).where(F.col("nth") <= k_positives)
    chosen = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("nth", "vec_id", "score")).alias("positives"))
    anchors = cut(asking.join(chosen, "row"))
    met = dealt(anchors).applyInArrow(lambda a, c: negatives_of(a, c, k, low, of), NEGATIVES)
    ranked = met.withColumn("rank", nth("anchor", "nth")).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
