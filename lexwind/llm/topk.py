"""Exact top-k search by integer inner product with MaxScore (operator 6).

Vectors become integer weights of terms (one term a dimension). Inside a block of candidates every term's weights lie in
[low, high], so a query's score is a base (each query weight times the bound that gives least) plus impacts of at least
0, each bounded by |query weight| * (high - low). MaxScore sorts the terms by bound. The non-essential ones are the
longest run of least bounds that together can't lift the base to the query's threshold; the postings of the others, the
essential terms, are traversed, and the non-essential ones are probed from the largest bound on, only for candidates
that still compete. The threshold is the query's k-th best score so far, so it rises from block to block; ties at the
threshold stay in. It doesn't begin at nothing: a bounded sample of `seed_rows` candidates is scored exactly for every
query, and its k-th best score is a threshold that the result can't fall below.

Queries and candidates are dealt into groups by the hash of their row numbers. Each cell (query group, shard) is one task's
work of bounded size: candidates are repeated once a query group, queries once a shard. The cells' k best are merged by a
window that keeps k rows a query before the shuffle.

Weights and scores are whole numbers held in doubles, which is exact while no sum can reach 2**53; queries that could
reach it are scored with unbounded integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexwind.llm.common import cut, pick

#: Sums of whole numbers below this are exact in doubles, and numbers from here on have no fraction.
EXACT = 1 << 53
NOTHING = (np.empty(0, dtype=np.int64), np.empty(0))


def weights(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component as a double; null if the vector or one of its components is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(scale)
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, whole))


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of lists as a matrix of at least `width` columns; what is missing is zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), -1).astype(float)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then by id."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Block:
    """Candidates of a shard: postings by term (one row a dimension), each term's bounds, and counts of what was read."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors, self.postings = rows, ids, vectors, np.ascontiguousarray(vectors.T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)
        self.read = self.whole = 0

    def search(self, own: np.ndarray, queries: np.ndarray, threshold: np.ndarray, few: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all that reaches its query's threshold; positions in `queries` and in this block.

        `own` are the queries' own row numbers, which are left out.
        """
        d = queries.shape[1]
        self.whole += len(queries) * self.postings.size
        low, high = queries * self.low, queries * self.high
        least, most = np.minimum(low, high), np.maximum(low, high)
        base, bound = least.sum(axis=1), most - least
        terms = np.argsort(-bound, axis=1)
        place = np.empty_like(terms)
        np.put_along_axis(place, terms, np.arange(d)[None, :], axis=1)
        rest = np.cumsum(np.take_along_axis(bound, terms, axis=1)[:, ::-1], axis=1)[:, ::-1]  # what the terms from here on can add to the base
        essential = (base[:, None] + rest >= threshold[:, None]).sum(axis=1)
        asking = np.flatnonzero((essential > 0) | (base >= threshold))  # of the others no candidate can reach the threshold
        queries, most, place, essential, threshold = queries[asking], most[asking], place[asking], essential[asking], threshold[asking]
        # Essential postings are traversed for all queries at once; a term that isn't essential to a query has the weight 0 in it.
        seen = place < essential[:, None]
        self.read += int(essential.sum()) * len(self.ids)
        partial = (queries * seen) @ self.postings
        while True:
            others = np.where(seen, 0.0, most).sum(axis=1)  # the most that unseen terms can give
            live = partial + others[:, None] >= threshold[:, None]
            if seen.all() or live.mean() < few:
                break
            more = ~seen & (place < (seen.sum(axis=1) + 8)[:, None])  # while many compete, the next terms are probed for all at once
            self.read += int((more.sum(axis=1) * live.sum(axis=1)).sum())
            partial += (queries * more) @ self.postings
            seen |= more
        q, c = np.nonzero(live)
        score = partial[q, c]
        if not seen.all():
            self.read += int((~seen).sum(axis=1)[q].sum())
            score = score + np.einsum("ij,ij->i", np.where(seen, 0.0, queries)[q], self.vectors[c])
        stays = (score >= threshold[q]) & (self.rows[c] != own[asking][q])
        return asking[q[stays]], c[stays], score[stays]


def search_blocks(blocks: list[Block], own: np.ndarray, queries: np.ndarray, threshold: np.ndarray, k: int, together: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best (ids, scores) of each query over all blocks; thresholds rise from block to block."""
    held = [NOTHING] * len(queries)
    threshold = threshold.copy()
    for a in range(0, len(queries), together):
        part = slice(a, a + together)
        for block in blocks:
            q, c, score = block.search(own[part], queries[part], threshold[part])
            edge = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else []
            for first, last in zip(edge, [*edge[1:], len(q)], strict=True) if len(q) else ():
                i = a + int(q[first])
                ids, scores = held[i]
                held[i] = best(np.concatenate((ids, block.ids[c[first:last]])), np.concatenate((scores, score[first:last])), k)
                if len(held[i][1]) >= k:
                    threshold[i] = max(threshold[i], held[i][1][-1])
    return held


def search_exactly(own: int, query: np.ndarray, k: int, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[list[int], list[int]]:
    """The k best with unbounded integers. Scores beyond 64 bits count as the nearest number that fits, so they tie."""
    q = [(i, int(x)) for i, x in enumerate(query.tolist()) if x]
    fits = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    scored = sorted((-fits(sum(x * int(v[i]) for i, x in q)), i) for r, i, v in zip(rows.tolist(), ids.tolist(), vectors, strict=True) if r != own for i in [i])
    return [i for _, i in scored[:k]], [-s for s, _ in scored[:k]]


def search_cell(queries: pa.Table, candidates: pa.Table, k: int, seeds: pa.Table | None = None, block: int = 1024) -> tuple[pa.Table, int, int]:
    """(query_row, query_id, vec_id, score of the k best of each query; postings read; postings there are)."""
    found: list[tuple] = []
    read = whole = 0
    if queries.num_rows and candidates.num_rows:
        width = max(matrix(t["w"]).shape[1] for t in (queries, candidates, *([seeds] if seeds else [])))
        asked, vectors = matrix(queries["w"], width), matrix(candidates["w"], width)
        rows, ids = candidates["row"].to_numpy(), candidates["id"].to_numpy()
        # Rows whose largest weight has the same term stand together, which narrows a block's bounds.
        strongest = np.abs(vectors).argmax(axis=1) if width else np.zeros(len(rows), dtype=np.int64)
        order = np.lexsort((rows, vectors[np.arange(len(rows)), strongest] if width else rows, strongest))
        rows, ids, vectors = rows[order], ids[order], vectors[order]
        largest = np.abs(vectors).max(axis=0)
        first = np.full(len(asked), -math.inf)
        if seeds is not None and seeds.num_rows > k:
            sample = matrix(seeds["w"], width)
            largest = np.maximum(largest, np.abs(sample).max(axis=0))
            with np.errstate(over="ignore", invalid="ignore"):
                scores = asked @ sample.T
            scores[queries["row"].to_numpy()[:, None] == seeds["row"].to_numpy()[None, :]] = -math.inf
            first = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        with np.errstate(over="ignore"):
            exact = np.abs(asked) @ largest < EXACT
        blocks = [Block(rows[a : a + block], ids[a : a + block], vectors[a : a + block]) for a in range(0, len(rows), block)]
        own, names = queries["row"].to_numpy(), queries["id"].to_numpy()
        small = np.flatnonzero(exact)
        for i, held in zip(small.tolist(), search_blocks(blocks, own[small], asked[small], first[small], k), strict=True):
            found.append((int(own[i]), int(names[i]), held[0].tolist(), [int(s) for s in held[1].tolist()]))
        for i in np.flatnonzero(~exact).tolist():
            found.append((int(own[i]), int(names[i]), *search_exactly(int(own[i]), asked[i], k, rows, ids, vectors)))
        read, whole = sum(b.read for b in blocks), sum(b.whole for b in blocks)
    flat = lambda make: pa.array([x for f in found for x in make(f)], pa.int64())
    out = pa.table({"query_row": flat(lambda f: [f[0]] * len(f[2])), "query_id": flat(lambda f: [f[1]] * len(f[2])), "vec_id": flat(lambda f: f[2]), "score": flat(lambda f: f[3])})
    return out, read, whole


def top_k(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0,
    query_group: int = 4096, shard_rows: int = 8192, seed_rows: int = 512,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows other than its own, ties to the smaller id.

    `is_query` is a condition on the column id. Ids are whole numbers; rows without one take no part, nor do null vectors
    and those with null or non-finite components. Every row asks and answers for itself: of rows with the same id each is a
    query and each a candidate of the others. Vectors of unequal length count as filled up with zeros. Scores beyond 64 bits
    count as the nearest number that fits. With fewer than k candidates all are returned; an empty table gives no rows.
    The sample that seeds the thresholds is `seed_rows` rows at most; it changes how much is read, never a result.
    """
    rows = pick(vectors, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), weights("v", scale).alias("w")).where("id is not null and w is not null")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    asking = rows.where(is_query)
    n, n_queries = rows.count(), asking.count()
    seeds = rows.orderBy(F.xxhash64("row")).limit(seed_rows).select("row", "w").toArrow()
    groups, shards = max(1, math.ceil(n_queries / query_group)), max(1, math.ceil(n / shard_rows))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    asked = asking.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))).withColumn("s", every(shards))
    held = rows.withColumn("s", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards))).withColumn("g", every(groups))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        return search_cell(q, c, k, seeds)[0]

    found = asked.groupBy("g", "s").cogroup(held.groupBy("g", "s")).applyInArrow(search, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
