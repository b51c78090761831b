"""Operators that spread one group over tasks, against the plain loops that they replace."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexwind.operators import batching as B
from lexwind.operators import metrics as X


@pytest.fixture(autouse=True)
def spread(spark):
    """Small ranges stay ranges of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def greedy(frames, budget, most):
    """Batch and place of each item in turn: it joins the open batch if the running sum allows, else opens one."""
    batch, pos, number, held, used = [], [], 0, 0, 0.0
    for f in frames:
        if held and not (used + f <= budget and (most == 0 or held < most)):
            number, held, used = number + 1, 0, 0.0
        batch.append(number)
        pos.append(held)
        held, used = held + 1, used + f
    return batch, pos


def rows_by_hand(rows, budget, most, drop_last=False):
    """(group, batch, pos, id) of rows (id, frames, group)."""
    out = []
    for group in {r[2] for r in rows}:
        mine = sorted((f if f is not None and f == f else 0.0, i) for i, f, g in rows if g == group)
        batch, pos = greedy([f for f, _ in mine], budget, most)
        out += [(group, b, p, i) for (_, i), b, p in zip(mine, batch, pos, strict=True) if not (drop_last and b == batch[-1])]
    return sorted(out, key=repr)


def planned(df, *args, **more):
    return sorted(((r.g, r.batch_id, r.pos, r.id) for r in B.frame_batches(df, "id", "f", "g", *args, **more).collect()), key=repr)


@pytest.mark.parametrize(("budget", "most", "range_rows"), [(300, 7, 16), (300, 0, 64), (2.5, 0, 1000), (50, 1000, 5)])
def test_batches_of_any_group(spark, budget, most, range_rows):
    draw = np.random.default_rng(3)
    rows = [(i, float(draw.integers(0, 90)), [0, 0, 0, 1, None][int(draw.integers(0, 5))]) for i in range(400)]
    rows += [(1000 + i, 0.0, 0) for i in range(60)] + [(2000, 99_999.0, 0), (2001, None, 1), (2002, float("nan"), 1), (2003, 0.25, 7)]
    df = spark.createDataFrame(rows, "id long, f double, g int").repartition(3)
    for drop in (False, True):
        assert planned(df, budget, most, drop, range_rows=range_rows) == rows_by_hand(rows, budget, most, drop)


def test_batches_of_one_group_and_none(spark):
    rows = [(i, 1.0 + i % 13, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, f double, g int")
    plan = B.frame_batches(df, "id", "f", "g", 100, 9, range_rows=200)
    assert sorted(((r.g, r.batch_id, r.pos, r.id) for r in plan.collect()), key=repr) == rows_by_hand(rows, 100, 9)
    assert planned(df.where("id < 0"), 100, 9) == []


def test_no_task_holds_more_than_its_range(spark):
    df = spark.range(4000).select("id", (F.col("id") % 50).cast("double").alias("f"), F.lit(0).alias("g")).repartition(4)
    sizes = B.frame_batches(df, "id", "f", "g", 500, range_rows=250).groupBy(F.spark_partition_id()).count()
    assert sizes.count() > 1


def average_by_hand(rows, decay):
    out, now = [], {}
    for g, o, v in sorted((r for r in rows if r[2] is not None), key=lambda r: (str(r[0]), r[1])):
        now[g] = v if g not in now else decay * now[g] + (1 - decay) * v
        out.append((g, o, round(now[g], 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("groups", [1, 3, 500])
def test_average_of_any_group(spark, groups):
    rows = [(i % groups, i, float((i * 37) % 101)) for i in range(3000)] + [(None, 1, 5.0), (None, 2, 7.0), (0, 9999, None)]
    df = spark.createDataFrame(rows, "g int, o long, v double").repartition(5)
    got = X.moving_average(df, "g", "o", "v", 0.9)
    assert sorted(((r.g, r.o, round(r.ema, 9)) for r in got.collect()), key=repr) == average_by_hand(rows, 0.9)
    if groups == 1:
        assert got.groupBy(F.spark_partition_id()).count().count() > 1
    assert X.moving_average(df.where("o < 0"), "g", "o", "v").count() == 0


def test_places_are_permutations(spark):
    sizes = spark.range(1, 1001).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("k"))
    for seed in (0, 3):
        placed = sizes.select("n", "k", B.shuffled_place(F.col("k"), F.col("n"), seed).alias("p"))
        bad = placed.groupBy("n").agg(F.countDistinct("p").alias("d"), F.min("p").alias("a"), F.max("p").alias("b")).where("d != n or a != 0 or b != n - 1")
        assert bad.count() == 0
    one, two = ([r[0] for r in spark.range(1000).select(B.shuffled_place(F.col("id"), 1000, s)).collect()] for s in (1, 2))
    assert one != two and sum(a == b for a, b in zip(one, two, strict=True)) < 20
    assert abs(np.corrcoef(one, range(1000))[0, 1]) < 0.15
