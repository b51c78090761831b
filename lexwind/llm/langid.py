"""Language identification of mixed-language text (operator 8).

Words are runs of letters with the marks that combine with them (vowel signs, accents); a run of over 64 (glued text,
scripts without spaces) is several words, one for every 64. They are scored by hashed character n-grams (naive Bayes); the script of a word's letters narrows the
languages that may take it. A Viterbi pass over the words of a text, with a penalty for every switch, labels spans; the
language with the most letters in its spans is the text's, and its share of the letters is the score. A word counts
with the mean score of its n-grams times half of its letters plus one, of which at most 11 letters count: longer
words say more, but a single long one can't outvote a sentence.

The model is fitted on at most `sample_docs` labelled documents a language (distinct ids and texts, chosen by their hash);
n-gram counts are summed by Spark and only the finished table (languages times 2**16 numbers) reaches the driver. Prediction is
one narrow Arrow stage: distinct words are scored once a task, and the Viterbi steps run for all texts of a batch side
by side.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwind.llm.common import attach, cut, pick, text_batches

BUCKETS = 1 << 16
NEVER = np.float32(-1e9)

# First code point and script of the letter ranges that are told apart, by the Unicode blocks.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
STARTS = [a for a, _ in SCRIPT_RANGES]
PIECE = 64


def mark_class() -> str:
    """The characters that combine with letters, as ranges of a regular expression's class."""
    marks = [i for i in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(i)).startswith("M")]
    first = [m for m, before in zip(marks, [-1, *marks], strict=False) if m != before + 1]
    last = [m for m, after in zip(marks, [*marks[1:], -1], strict=True) if after != m + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True))


LETTERS = re.compile(rf"[^\W\d_]+(?:[{mark_class()}]+[^\W\d_]*)*")


def script_of(letters: str) -> str:
    """The script of most letters; of equals the first."""
    if max(letters) < "\u0370":
        return "latin"
    return Counter(SCRIPT_RANGES[bisect_right(STARTS, ord(c)) - 1][1] for c in letters).most_common(1)[0][0]


def grams(letters: str) -> list[int]:
    """Buckets of a word's 2- to 4-grams (UTF-8, with its ends marked) and of the word."""
    w = f"^{letters.lower()}$".encode()
    n = len(w)
    found = [w[a : a + 2] for a in range(n - 1)] + [w[a : a + 3] for a in range(n - 2)] + [w[a : a + 4] for a in range(n - 3)]
    return [crc32(g) & (BUCKETS - 1) for g in found] + [crc32(b"=" + w) & (BUCKETS - 1)]


def all_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of many words one after another, and how many each word has."""
    found = [grams(w) for w in words]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(sizes.sum())), sizes


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # (BUCKETS, languages), float32
    scripts: dict[str, np.ndarray]  # languages that may take a word of the script, as a mask
    usual: int  # the language of most training words

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; zeros for a script that no language was learned with."""
        buckets, sizes = all_grams(words)
        sums = np.add.reduceat(self.log_prob[buckets], np.cumsum(sizes) - sizes, axis=0)
        chars = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        scores = (sums / sizes[:, None] * (np.minimum(chars + 1, 12) / 2)[:, None]).astype(np.float32)
        none = np.zeros(len(self.langs), dtype=bool)
        may = np.array([self.scripts.get(script_of(w), none) for w in words])
        return np.where(may, scores, np.where(may.any(axis=1)[:, None], NEVER, np.float32(0)))


def words_of(text: str) -> list[str]:
    """Runs of letters and their marks, longer ones in pieces of 64; signs that only count as numbers make no word."""
    found = [w for w in LETTERS.findall(text) if w.isalpha() or any(map(str.isalpha, w))]
    if found and max(map(len, found)) > PIECE:
        found = [w[a : a + PIECE] for w in found for a in range(0, len(w), PIECE)]
    return found


def fit(docs: DataFrame, may_learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 1000, least_share: float = 0.01) -> Model:
    """Fit on texts with a language where `may_learn` (a condition on the column doc_id) holds.

    Null texts teach nothing, nor do rows without an id or a language; repeated rows count once; very long texts are read
    whole. An empty table gives a model without languages, which calls every text `und`.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.where(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).withColumn("draw", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    learners = rows.select("lang", "draw").distinct()
    # Rows are ranked only below a hash threshold that lets about twice the sample through, however frequent a language is.
    sizes = cut(learners.groupBy("lang").agg(F.count("*").alias("n")))
    through = F.pmod("draw", F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("n") < 2 * sample_docs + 100
    near = attach(learners, sizes, ["lang"], "inner").where(through)
    order = Window.partitionBy("lang").orderBy("draw")
    chosen = cut(near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample_docs).select("lang", "draw"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text or ""))
        langs, buckets_, scripts_, values = [], [], [], []
        for lang, words in seen.items():
            sums, scripts, listed = np.zeros(BUCKETS), Counter(), list(words)
            for at in range(0, len(listed), 10_000):
                part = listed[at : at + 10_000]
                buckets, sizes = all_grams(part)
                sums += np.bincount(buckets, weights=np.repeat([words[w] for w in part], sizes), minlength=BUCKETS)
            for w, n in words.items():
                scripts[script_of(w)] += n
            for k in np.flatnonzero(sums).tolist():
                langs.append(lang)
                buckets_.append(k)
                scripts_.append("")
                values.append(int(sums[k]))
            for s, n in scripts.items():
                langs.append(lang)
                buckets_.append(-1)
                scripts_.append(s)
                values.append(n)
        columns = [pa.array(langs, pa.string()), pa.array(buckets_, pa.int32()), pa.array(scripts_, pa.string()), pa.array(values, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "script", "n"])

    # The sample is at most sample_docs rows a language; of equal rows one stays.
    sample = attach(rows, chosen, ["lang", "draw"], "inner").groupBy("lang", "draw").agg(F.first("text").alias("text")).select("text", "lang")
    counts = cut(sample.mapInArrow(count, "lang string, bucket int, script string, n long").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")))
    # One row a language comes to the driver, with at most BUCKETS numbers and one for each script.
    tables = counts.where("bucket >= 0").groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    return build(tables.orderBy("lang").toArrow(), counts.where("bucket < 0").groupBy("lang", "script").agg(F.sum("n").alias("n")).collect(), least_share)


def build(tables: pa.Table, seen: list, least_share: float) -> Model:
    """tables: lang and counts (bucket and n) by language; seen: rows lang, script, n."""
    langs = sorted(tables["lang"].to_pylist())
    table = np.full((BUCKETS, len(langs)), 0.05)
    for lang, row in zip(tables["lang"].to_pylist(), tables["counts"], strict=True):
        table[row.values.field("bucket").to_numpy(), langs.index(lang)] += row.values.field("n").to_numpy()
    log_prob = np.log(table / table.sum(axis=0)).astype(np.float32) if langs else table.astype(np.float32)
    totals = np.zeros(len(langs))
    for r in seen:
        totals[langs.index(r.lang)] += r.n
    scripts: dict[str, np.ndarray] = {}
    for r in seen:
        if r.n >= least_share * totals[langs.index(r.lang)]:
            scripts.setdefault(r.script, np.zeros(len(langs), dtype=bool))[langs.index(r.lang)] = True
    return Model(langs, log_prob, scripts, int(totals.argmax()) if langs else -1)


def viterbi(words: np.ndarray, sizes: np.ndarray, table: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word; texts lie one after another in `words`, longest first, and step side by side."""
    n_langs = table.shape[1]
    path = np.zeros(len(words), dtype=np.int16)
    offsets = np.cumsum(sizes) - sizes
    back = np.zeros((len(words), n_langs), dtype=np.int16)
    own = np.arange(n_langs, dtype=np.int16)
    active = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")  # texts longer than t
    state = np.zeros((len(sizes), n_langs), dtype=np.float32)
    for t, n in enumerate(active.tolist()):
        at = offsets[:n] + t
        s = state[:n]
        best = s.argmax(axis=1)
        top = s[np.arange(n), best] - penalty
        stay = s >= top[:, None]
        back[at] = np.where(stay, own, best[:, None].astype(np.int16))
        s = np.where(stay, s, top[:, None]) + table[words[at]]
        state[:n] = s - s.max(axis=1)[:, None]
    now = state.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = offsets[:n] + t
        path[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return path


def identify(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = 6.0, block_words: int = 1 << 20, cache_words: int = 400_000,
) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (share of the letters), spans (first and last word, lang).

    `und` with score 0 and no span if the text is null or has no letters, or if nothing could be learned. Letters of
    a script that no language was learned with take the language around them, or the usual one with score 0. Repeated
    rows are labelled each for itself; equal scores go to the first language in code point order; extra columns do no
    harm; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        scores = np.zeros((0, len(model.langs)), dtype=np.float32)
        names = pa.array(model.langs, pa.string())
        for b in gathered(batches):
            chars = np.array([len(t.as_py() or "") for t in b.column(1)], dtype=np.int64)
            order = np.argsort(-chars, kind="stable")
            block, size = [], 0
            for k in order.tolist():
                block.append(k)
                size += chars[k] // 6
                if size >= block_words:
                    scores, made = label(b, block, known, scores, names)
                    yield made
                    block, size = [], 0
            if block:
                scores, made = label(b, block, known, scores, names)
                yield made

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches put together up to a size, so that texts of like length step side by side."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) >= 24 * block_words:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def label(b: pa.RecordBatch, block: list[int], known: dict[str, int], scores: np.ndarray, names: pa.Array) -> tuple[np.ndarray, pa.RecordBatch]:
        n_langs = len(model.langs)
        if len(known) > cache_words:
            known.clear()
            scores = scores[:0]
        flat, letters, first = [], [], len(known)
        for k in block:
            words = words_of(b.column(1)[k].as_py() or "") if n_langs else []
            for w in words:
                if w not in known:
                    known[w] = len(known)
            flat.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
            letters.append(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        new_words = list(islice(known, first, None))
        scores = np.concatenate([scores, *(model.score(new_words[at : at + 10_000]) for at in range(0, len(new_words), 10_000))])
        sizes = np.array([len(x) for x in flat], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        block = [block[i] for i in order]
        words, weight = (np.concatenate([np.empty(0, dtype=np.int64), *(x[i] for i in order)]).astype(np.int64) for x in (flat, letters))
        sizes = sizes[order]
        doc = np.repeat(np.arange(len(block)), sizes)
        share = np.zeros((len(block), max(1, n_langs)))
        path = np.zeros(0, dtype=np.int16)
        certain = np.zeros(0, dtype=bool)
        if len(words):
            path = viterbi(words, sizes, scores, penalty)
            certain = scores[words].any(axis=1)
            np.add.at(share, (doc[certain], path[certain]), weight[certain])
        total = share.sum(axis=1)
        best = np.where(total > 0, share.argmax(axis=1), model.usual)
        score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0)
        lang = [model.langs[i] if n else "und" for i, n in zip(best.tolist(), sizes.tolist(), strict=True)]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(path)), dtype=bool), (path[1:] != path[:-1]) | (doc[1:] != doc[:-1]))))
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = np.concatenate((new[1:], [len(path)]))[: len(new)] - 1
        per_doc = np.bincount(doc[new], minlength=len(block)) if len(new) else np.zeros(len(block), dtype=np.int64)
        spans = pa.StructArray.from_arrays([pa.array(new - base[new]), pa.array(last - base[last]), names.take(pa.array(path[new]))], names=["first", "last", "lang"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_doc))), pa.int32()), spans)
        made = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(block)), pa.array(lang), pa.array(score), lists], names=schema.names)
        return scores, made

    return rows.mapInArrow(run, schema)
