"""Hard negatives against a plain loop."""

import math
from collections import Counter

import numpy as np
import pytest
from llm_helpers import clashing
from pyspark.sql import functions as F

from lexwind.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label string"


def by_hand(rows, every, k_positives=5, k=5, scale=256):
    fits = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    kept = [(n, i, [math.floor(scale * x) for x in v], y) for n, (i, v, y) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, a, w, label in kept:
        if a % every:
            continue
        scored = sorted((-fits(sum(p * q for p, q in zip(w, v, strict=False))), i, y) for m, i, v, y in kept if m != n)
        for p, positive, _ in [s for s in scored if s[2] == label][:k_positives]:
            found = [(i, -s) for s, i, y in scored if y != label and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out.update((a, positive, r + 1, i, -p, s) for r, (i, s) in enumerate(found))
    return out


def mined(df, every, **sizes):
    return Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in hard_negatives(df, F.col("id") % every == 0, **sizes).collect())


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    made = [(i, [float(x) for x in draw.normal(size=4) + 1], "abc"[min(2, int(draw.integers(0, 6)) // 2)]) for i in range(200)]
    hot = [(500 + i, made[0][1], "ab"[i % 2]) for i in range(90)]  # ties of a third of all rows
    odd = [(10, None, "a"), (20, [1.0, None], "a"), (30, [float("nan")], "b"), (40, [float("inf")], "b"), (None, [1.0], "a"), (50, [1.0, 2.0], None), (60, [], "a"), (70, [3.0], "b"), (80, [0.0] * 6, "c"), (0, made[0][1], "a"), (0, made[0][1], "a"), (90, [-5.0] * 4, "a"), (90, [1e300, 1.0], "lonely")]
    return made + hot + odd


@pytest.mark.parametrize("sizes", [{}, {"cell_bytes": 1500}, {"cell_bytes": 1 << 30, "least_rows": 1 << 30}])
def test_negatives_of_all_kinds(spark, rows, sizes):
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    wanted = by_hand(rows, 10)
    assert len(wanted) > 300
    assert mined(df, 10, **sizes) == wanted


def test_scores_beyond_doubles(spark):
    rows = [(i, [float(1 << 40) + i * 17, float(i)], "ab"[i % 2]) for i in range(24)] + [(30, [1e30, 5.0], "a"), (31, [1e30, 7.0], "b"), (32, [1e290, 0.0], "b")]
    assert mined(spark.createDataFrame(rows, SCHEMA), 6) == by_hand(rows, 6)


def test_few_rows_and_none(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert not mined(df.where("vec_id < 0"), 10)
    assert not mined(df.where("vec_id = 0"), 10) - by_hand([r for r in rows if r[0] == 0], 10)
    few = [r for r in rows if r[0] in (100, 101, 102, 103)]
    assert mined(spark.createDataFrame(few, SCHEMA), 10) == by_hand(few, 10)
    assert not mined(spark.createDataFrame([(i, [1.0], "a") for i in range(20)], SCHEMA), 10)
