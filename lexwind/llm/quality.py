"""Quality rules by robust multivariate outliers (operator 2).

Every document gets counts, then a vector of transformed rates (FEATURES). For each language and source the minimum
covariance determinant (MCD) estimate describes the usual documents; a document whose Mahalanobis distance from it
exceeds a chi-square quantile is rejected.

MCD: from three deterministic robust starts (median and MAD; median and the covariance of directions; median and the
covariance of tanh scores), concentration steps take the mean and covariance of the `support` share of rows nearest by the
previous estimate, until no determinant falls any more (or `most_steps`). Each step is one pass over the small feature
table: Spark sums moments by cell, start and distance bucket (32 buckets a doubling), so that no group is ever gathered
in a task, however many rows it holds; the share then follows from the bucket sums. The start with the smallest
determinant wins, its covariance is made consistent by the median distance, and one reweighting step ends the estimate.
A ridge on the variances keeps groups regular in which most rates are zero.

Estimates are made for each language and source, for each language and for everything, and small groups lean on larger
ones without a threshold: a language takes in `prior_rows` pseudo-rows of everything, and a language and source so many of
its language, so that a group of a few rows is judged by its language and one of a million by itself.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwind.llm.common import attach, cut, pick, positional, text_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats", "f_upper", "f_marks")
#: Added to the variances: a standard deviation that any feature has at least.
RIDGE = (0.08, 0.25, 0.35, 0.6, 0.3, 0.4)
WINDOW = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
BUCKETS = 32
FINE = 64
D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document the words inside windows of WINDOW words that are found twice or more in it."""
    m = len(ids) - WINDOW + 1
    if m <= 0:
        return np.zeros(n_docs, dtype=np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * MIX
    mixed ^= mixed >> np.uint64(29)
    key = doc[:m].astype(np.uint64)
    for k in range(WINDOW):
        key = (key * np.uint64(0xD6E8FEB86659FD93)) ^ mixed[k : k + m]
        key ^= key >> np.uint64(32)
    at = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    at = at[np.argsort(key[at], kind="stable")]
    a, b = at[:-1], at[1:]
    alike = key[a] == key[b]
    exact = doc[a] == doc[b]
    for k in range(WINDOW):
        exact &= ids[a + k] == ids[b + k]
    hit = np.zeros(m, dtype=bool)
    both = alike & exact
    hit[a[both]] = hit[b[both]] = True
    for d in np.unique(doc[a[alike & ~exact]]).tolist() + np.unique(doc[b[alike & ~exact]]).tolist():  # two windows share a hash
        own = np.flatnonzero((doc[:m] == d) & (doc[WINDOW - 1 :] == d))
        seen: dict[tuple, list[int]] = defaultdict(list)
        for p in own.tolist():
            seen[tuple(ids[p : p + WINDOW].tolist())].append(p)
        for places in seen.values():
            hit[places] = len(places) > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(WINDOW):
        covered[k : k + m] |= hit
    return np.bincount(doc[covered], minlength=n_docs)


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of a batch; null counts as empty."""
    n = len(texts)
    out = {c: np.zeros(n, dtype=np.int64) for c in COUNTS}
    ids: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    flat: list[np.ndarray] = []
    for k, value in enumerate(texts):
        text = value.as_py() or ""
        raw = text.encode("utf-8", "replace")
        out["n_symbols"][k] = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
        words = raw.split()  # bytes: splits at the ASCII white space only
        if not words:
            continue
        out["n_words"][k] = len(words)
        out["word_chars"][k] = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
        out["n_upper"][k] = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        out["n_marks"][k] = len(raw) - len(raw.translate(None, b"!?.,;:\"'()[]{}-_=+/\\@^~`0123456789"))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out["n_dup_lines"][k] = len(lines) - len(set(lines))
        flat.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)))
    if flat:
        doc = np.repeat(np.arange(n), out["n_words"])
        out["n_repeat_words"] = repeated_words(np.concatenate(flat), doc, n)
    return out


def with_counts(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and COUNTS of the text."""
    text_batches(rows.sparkSession)
    columns = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                counts = count_texts(part.column(columns.index(text)))
                arrays = [part.column(columns.index(c)) for c in keep] + [pa.array(v) for v in counts.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *COUNTS])

    return rows.select(*columns).mapInArrow(run, schema)


def features() -> list[Column]:
    """Rates a word, damped by 20 words so that short texts aren't extreme, on a logarithmic scale."""
    words = F.col("n_words") + F.lit(20.0)
    rate = lambda c, scale: F.log1p(F.col(c) * F.lit(float(scale)) / words)
    length = F.log((F.col("word_chars") + F.lit(100.0)) / words)
    return [f.alias(n) for f, n in zip((length, rate("n_symbols", 20), rate("n_dup_lines", 100), rate("n_repeat_words", 100), rate("n_upper", 10), rate("n_marks", 5)), FEATURES, strict=True)]


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def distance(mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; `inverse` holds the upper triangle, off-diagonal entries doubled."""
    centred = [F.col(f) - mean[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + centred[i] * centred[j] * inverse[k]
    return total


def chi_square_quantile(q: float, d: int = D) -> float:
    """Wilson and Hilferty's approximation."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * d))) ** 3


PARAMS = T.StructType([
    T.StructField("cell", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("log_det", T.DoubleType()),
    T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType())), T.StructField("cov", T.ArrayType(T.DoubleType())),
])


def described(cell: str, start: int, n: int, mean: np.ndarray, cov: np.ndarray) -> dict:
    ridged = cov + np.diag(np.square(RIDGE))
    inverse = np.linalg.inv(ridged)
    packed = [float(inverse[i, j] * (1 if i == j else 2)) for i, j in PAIRS]
    return {"cell": cell, "start": start, "n": n, "log_det": float(np.linalg.slogdet(ridged)[1]), "mean": mean.tolist(), "inverse": packed, "cov": [float(cov[i, j]) for i, j in PAIRS]}


def moments_of(g: dict[str, np.ndarray], share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of bucket sums, each counted by its share."""
    n = float((g["n"] * share).sum())
    mean = np.array([float((g[f"s{i}"] * share).sum()) / n for i in range(D)])
    cov = np.zeros((D, D))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = float((g[f"s{i}_{j}"] * share).sum()) / n - mean[i] * mean[j]
    return mean, cov


def nearest(g: dict[str, np.ndarray], wanted: float) -> np.ndarray:
    """Of each bucket, in order of distance, the share that belongs to the nearest `wanted` rows."""
    n = g["n"].astype(float)
    before = np.cumsum(n) - n
    return np.clip((wanted - before) / n, 0, 1)


def concentrate(g: dict[str, np.ndarray], support: float) -> tuple[np.ndarray, np.ndarray]:
    """Moments of the share of rows that is nearest. Buckets come in order of distance."""
    total = int(g["n"].sum())
    return moments_of(g, nearest(g, max(support * total, min(total, D + 2))))


def reweight(g: dict[str, np.ndarray], inner: float) -> tuple[np.ndarray, np.ndarray]:
    """Make the distances consistent by their median, then take mean and covariance of the rows within the inner quantile."""
    middle = int(np.searchsorted(np.cumsum(g["n"]), g["n"].sum() / 2))
    scale = max(1.0, 2.0 ** (float(g["bucket"][middle]) / BUCKETS) / chi_square_quantile(0.5))
    return moments_of(g, (2.0 ** (g["bucket"] / BUCKETS) <= scale * chi_square_quantile(inner)).astype(float))


def params_table(rows: list[dict]) -> pa.Table:
    kinds = {"cell": pa.string(), "start": pa.int32(), "n": pa.int64(), "log_det": pa.float64(), "mean": pa.list_(pa.float64()), "inverse": pa.list_(pa.float64()), "cov": pa.list_(pa.float64())}
    return pa.table({k: pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()})


def bucket_sums(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Moments by cell, start and bucket of distance under the parameters."""
    near = attach(rows, params.select("cell", "start", "mean", "inverse"), ["cell"], "inner").withColumn("bucket", F.floor(F.log2(distance(F.col("mean"), F.col("inverse")) + F.lit(1e-9)) * BUCKETS).cast("int"))
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i, j in PAIRS]
    return near.groupBy("cell", "start", "bucket").agg(F.count("*").alias("n"), *sums)


def step(rows: DataFrame, params: DataFrame, of, *args: float) -> DataFrame:
    def update(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        g = {c: t[c].to_numpy() for c in t.column_names if c != "cell"}
        return params_table([described(t["cell"][0].as_py(), int(g["start"][0]), int(g["n"].sum()), *of(g, *args))])

    return cut(bucket_sums(rows, params).groupBy("cell", "start").applyInArrow(update, PARAMS))


def medians(rows: DataFrame, names: list[str]) -> DataFrame:
    """cell, n and the medians of the named columns (to 1/FINE), found on counts a cell and step of the scale."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(c) * FINE).alias("at")) for i, c in enumerate(names)])
    counts = rows.select("cell", F.explode(steps).alias("s")).groupBy("cell", "s").count().select("cell", "s.i", "s.at", "count")
    scale = Window.partitionBy("cell", "i")
    reached = counts.withColumn("below", F.sum("count").over(scale.orderBy("at"))).withColumn("n", F.sum("count").over(scale)).where(F.col("below") * 2 >= F.col("n"))
    middle = reached.groupBy("cell", "i").agg(F.min("at").alias("at"), F.max("n").alias("n"))
    return middle.groupBy("cell").agg(F.max("n").alias("n"), *[((F.max(F.when(F.col("i") == i, F.col("at"))) + 0.5) / FINE).alias(c) for i, c in enumerate(names)])


def starts(rows: DataFrame) -> DataFrame:
    """Deterministic estimates a cell around the median: with the MAD, with the covariance of directions, with that of tanh scores."""
    middle = cut(medians(rows, list(FEATURES)).withColumnsRenamed({f: f"m{i}" for i, f in enumerate(FEATURES)}))
    placed = attach(rows, middle, ["cell"], "inner")
    centred = placed.select("cell", *[((F.col(f) - F.col(f"m{i}")) / F.lit(RIDGE[i])).alias(f"c{i}") for i, f in enumerate(FEATURES)])
    norm = F.greatest(sum((F.col(f"c{i}") * F.col(f"c{i}") for i in range(D)), F.lit(0.0)), F.lit(1e-9))
    directions = centred.groupBy("cell").agg(
        *[F.avg(F.col(f"c{i}") * F.col(f"c{j}") / norm).alias(f"s{i}_{j}") for i, j in PAIRS], *[F.avg(F.tanh(f"c{i}") * F.tanh(f"c{j}")).alias(f"t{i}_{j}") for i, j in PAIRS])
    deviations = medians(centred.select("cell", *[F.abs(f"c{i}").alias(f"d{i}") for i in range(D)]), [f"d{i}" for i in range(D)]).drop("n")
    spread = middle.join(directions, "cell").join(deviations, "cell")  # a row a cell on each side

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ridge = np.array(RIDGE)
        for b in batches:
            made = []
            for r in b.to_pylist():
                mean = np.array([r[f"m{i}"] for i in range(D)])
                mad = np.array([1.4826 * r[f"d{i}"] for i in range(D)]) * ridge
                sign, soft = np.zeros((D, D)), np.zeros((D, D))
                for i, j in PAIRS:
                    sign[i, j] = sign[j, i] = r[f"s{i}_{j}"] * D * ridge[i] * ridge[j]
                    soft[i, j] = soft[j, i] = r[f"t{i}_{j}"] * ridge[i] * ridge[j]
                made += [described(r["cell"], k, r["n"], mean, cov) for k, cov in enumerate((np.diag(mad**2), sign, soft))]
            yield from params_table(made).to_batches()

    return cut(spread.mapInArrow(begin, PARAMS))


LEVELS = ("cell", "cell_lang", "cell_all")


def name_cells(rows: DataFrame) -> DataFrame:
    """Adds LEVELS: the names of a row's groups by language and source, by language, and of everything."""
    label = lambda by, *c: F.to_json(F.struct(F.lit(by).alias("by"), *c))
    return rows.withColumns(dict(zip(LEVELS, (label(2, "lang", "source"), label(1, "lang"), label(0)), strict=True)))


def leaning(estimates: list[tuple[float, np.ndarray, np.ndarray]], prior_rows: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the last group (rows, mean, covariance), each taking in pseudo-rows of the one before it."""
    _, mean, cov = estimates[0]
    for n, own, own_cov in estimates[1:]:
        w = n / (n + prior_rows)
        apart = own - mean
        mean, cov = w * own + (1 - w) * mean, w * own_cov + (1 - w) * cov + w * (1 - w) * np.outer(apart, apart)
    return mean, cov


def lean_on_larger(cells: DataFrame, params: DataFrame, prior_rows: float) -> DataFrame:
    """The final parameters of each language and source: its estimate and those of its larger groups, put together."""
    held = cells
    for k, level in enumerate(LEVELS):
        own = params.select(F.col("cell").alias(level), *[F.col(c).alias(f"{c}{k}") for c in ("n", "mean", "cov")])
        held = attach(held, own, [level])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for r in b.to_pylist():
                found = []
                for k in reversed(range(len(LEVELS))):
                    if r[f"n{k}"]:
                        cov = np.zeros((D, D))
                        for (i, j), v in zip(PAIRS, r[f"cov{k}"], strict=True):
                            cov[i, j] = cov[j, i] = v
                        found.append((r[f"n{k}"], np.array(r[f"mean{k}"]), cov))
                if found:
                    made.append(described(r["cell"], 0, r["n0"] or 0, *leaning(found, prior_rows)))
            yield from params_table(made).to_batches()

    return cut(held.mapInArrow(put_together, PARAMS))


def fit_outliers(
    counts: DataFrame, *, support: float = 0.7, most_steps: int = 20, settled: float = 0.05, inner: float = 0.99, prior_rows: float = 100.0,
) -> tuple[DataFrame, DataFrame]:
    """(rows with their cell, final parameters a cell) from a table of lang, source and COUNTS.

    Documents that fail the base rules take no part in the estimates. Steps end when no logarithm of a determinant has
    fallen by over `settled`.
    """
    rows = cut(name_cells(counts.withColumns(dict(zip(FEATURES, features(), strict=True)))))
    cells = cut(rows.select(*LEVELS).distinct())
    usual = rows.where(~base_failed()).select(F.explode(F.array(*LEVELS)).alias("cell"), *FEATURES)
    params = starts(usual)
    for _ in range(most_steps):
        before = params.select("cell", "start", F.col("log_det").alias("was"))
        params = step(usual, params, concentrate, support)
        fell = params.join(before, ["cell", "start"]).agg(F.max(F.col("was") - F.col("log_det"))).first()[0]
        if fell is None or fell <= settled:
            break
    best = params.groupBy("cell").agg(F.min_by(F.struct(*PARAMS.names[1:]), F.struct("log_det", "start")).alias("best")).select("cell", "best.*")
    return rows, lean_on_larger(cells, step(usual, cut(best), reweight, inner), prior_rows)


def judge(rows: DataFrame, params: DataFrame, quantile: float) -> DataFrame:
    """Adds base_failed, distance and kept. A cell without an estimate (all its rows failed the base rules) keeps nothing more."""
    judged = attach(rows, params.select("cell", "mean", "inverse"), ["cell"]).withColumn("base_failed", base_failed())
    judged = judged.withColumn("distance", F.sqrt(F.greatest(distance(F.col("mean"), F.col("inverse")), F.lit(0.0)))).drop("mean", "inverse")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(chi_square_quantile(quantile)), F.lit(True)))


def robust_outliers(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", quantile: float = 0.99999, **fit: float) -> DataFrame:
    """One row per document: doc_id, lang, source, COUNTS, FEATURES, cell, base_failed, distance, kept.

    A null or empty text has no words and fails the base rules; texts of any length are counted whole. Null languages and
    sources are groups of their own. Repeated rows count as often as they come; rows at equal distances are treated alike.
    Extra columns do no harm. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col)
    counts = cut(with_counts(rows, "text", ["doc_id", "lang", "source"]))
    return judge(*fit_outliers(counts, **fit), quantile)


def keep_usual(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", quantile: float = 0.99999, **fit: float) -> DataFrame:
    """The rows of `docs` that `robust_outliers` keeps, whole, repeated ones as often as they come.

    Counts are taken a second time on the way, which spares shuffling and storing texts. Rows with null or empty texts
    go; other nulls and extra columns stay as they are; an empty table gives no rows.
    """
    flat = positional(docs)
    text, lang, source = (f"_c{docs.columns.index(c)}" for c in (text_col, lang_col, source_col))
    light = with_counts(flat.select(text, lang, source), text, [lang, source]).withColumnsRenamed({lang: "lang", source: "source"})
    rows, params = fit_outliers(cut(light), **fit)
    cells = cut(rows.select("lang", "source", "cell").distinct())
    again = with_counts(flat, text, flat.columns).withColumns(dict(zip(FEATURES, features(), strict=True)))
    again = again.withColumns({"lang": F.col(lang), "source": F.col(source)})
    kept = judge(attach(again, cells, ["lang", "source"], "inner"), params, quantile).where("kept")
    return kept.select(*flat.columns).toDF(*docs.columns)
