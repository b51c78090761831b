"""Aggregates over training metrics."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexwind.operators.batching import in_ranges


def usable(*values: str) -> Column:
    """None of the columns is null, NaN or infinite."""
    out = F.lit(True)
    for v in values:
        out = out & F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return out


def accumulated_losses(metrics: DataFrame, batch: str = "batch", loss: str = "loss", group_size: int = 4, by: str | None = None) -> DataFrame:
    """Mean loss of each group of `group_size` batches. A bad batch clears what its group has gathered; no row if nothing is left.

    The last group may be short.
    """
    keys = ([by] if by else []) + ["group_id"]
    rows = metrics.withColumn("group_id", F.floor(F.col(batch) / group_size)).withColumn("_ok", usable(loss))
    last_bad = F.coalesce(F.max(F.when(~F.col("_ok"), F.col(batch))).over(Window.partitionBy(*keys)), F.lit(-1))
    return rows.withColumn("_bad", last_bad).where(F.col("_ok") & (F.col(batch) > F.col("_bad"))).groupBy(*keys).agg(F.avg(loss).alias("mean_loss"), F.count("*").alias("n_batches"))


def mean_loss(losses: DataFrame, loss: str = "mean_loss") -> DataFrame:
    """Sum over count, 0 if there is none."""
    return losses.agg((F.coalesce(F.sum(loss), F.lit(0.0)) / F.greatest(F.count(loss), F.lit(1))).alias("epoch_loss"))


def norm_of_norms(df: DataFrame, norm: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.sqrt(F.sum(F.col(norm) * F.col(norm))).alias("total_norm"))


def throughput(samples: Column, elapsed: Column) -> Column:
    return samples / F.greatest(elapsed, F.lit(1e-9))


def remaining(epoch_seconds: Column, epochs_left: Column) -> Column:
    """Hours and minutes as text."""
    total = F.floor(epoch_seconds * epochs_left / 60)
    return F.format_string("%dh %dm", F.floor(total / 60), total % 60)


def moving_average(df: DataFrame, by: str, order: str, value: str, decay: float = 0.9999) -> DataFrame:
    """Exponential moving average in order within each group: the first value, then decay * before + (1 - decay) * value.

    A scan: rows are dealt by ranges of the order, so a group of any size spreads over tasks. What a range does to the average that comes in is one
    affine map (factor, offset); the maps, one row a range, are composed, and then each range follows its rows. Null values are
    left out.
    """
    rows = df.select(F.col(by).alias("_by"), F.col(order).alias("_order"), F.col(value).cast("double").alias("value")).where("value is not null")
    ranged = in_ranges(rows, "_by", "_order")
    kind = rows.schema["_by"].dataType.simpleString()

    def average(values: list[float], before: float | None) -> list[float]:
        step = lambda now, v: decay * now + (1 - decay) * v
        return list(accumulate(values, step)) if before is None else list(accumulate(values, step, initial=before))[1:]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a range: its first and last group, and of its last group in it the average alone, and as a map of what came before."""
        task, ends, now, factor, offset = None, None, None, 1.0, 0.0
        for b in batches:
            for part in equal_runs(b):
                key, values = part.column("_by")[0], part.column("value").to_pylist()
                if task is None:
                    task, ends = part.column("_task")[0].as_py(), [key, key]
                if key != ends[1]:
                    ends[1], now, factor, offset = key, None, 1.0, 0.0
                now, offset, factor = average(values, now)[-1], average(values, offset)[-1], factor * decay ** len(values)
        if task is not None:
            columns = [[task], [ends[0].as_py()], [ends[1].as_py()], [now], [factor], [offset]]
            types = [pa.int64(), ends[0].type, ends[0].type, *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["task", "first", "last", "alone", "factor", "offset"])

    before: dict[int, float | None] = {}
    key, now, any_ = None, 0.0, False
    for r in sorted(ranged.mapInArrow(summary, f"task long, first {kind}, last {kind}, alone double, factor double, offset double").collect(), key=lambda r: r["task"]):
        comes_in = now if any_ and r["first"] == key else None
        before[r["task"]] = comes_in
        goes_on = comes_in is not None and r["first"] == r["last"]
        key, now, any_ = r["last"], r["factor"] * now + r["offset"] if goes_on else r["alone"], True

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = now = None
        for n, part in enumerate(p for b in batches for p in equal_runs(b)):
            group = part.column("_by")[0]
            if n == 0:
                now = before[part.column("_task")[0].as_py()]
            elif group != key:
                now = None
            made = average(part.column("value").to_pylist(), now)
            key, now = group, made[-1]
            yield pa.RecordBatch.from_arrays([part.column("_by"), part.column("_order"), pa.array(made, pa.float64())], names=["_by", "_order", "ema"])

    found = ranged.mapInArrow(follow, f"_by {kind}, _order {rows.schema['_order'].dataType.simpleString()}, ema double")
    return found.select(F.col("_by").alias(by), F.col("_order").alias(order), "ema")


def equal_runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, sorted by its first column, in parts of equal values there."""
    if b.num_rows:
        ends = pc.run_end_encode(b.column(0)).run_ends.to_pylist()
        for start, end in zip([0, *ends], ends, strict=False):
            yield b.slice(start, end - start)
