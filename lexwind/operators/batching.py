"""Splits, shards and batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwind.exprs import opaque
from lexwind.functions.tokens import padded
from lexwind.lineage import cut


def portable_key(id_: Column, seed: int = 42) -> Column:
    """A number that orders ids as if shuffled; plain arithmetic, so that any engine can repeat it."""
    return F.pmod(F.pmod(F.pmod(id_.cast("long"), F.lit(2147483648)) * F.lit(2654435761) + F.lit(seed).cast("long") * F.lit(40503), F.lit(4294967296)) * F.lit(1103515245) + F.lit(12345), F.lit(2147483648))


def train_val_split(df: DataFrame, id_: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split: exactly floor(n * share) rows are `val` (none if that is under 2), the others `train`.

    The share's boundary is found on counts of key ranges, so that only one range of keys is ranked, not the table.
    """
    n = df.count()
    wanted = int(n * share)
    if wanted < 2:
        return df.withColumn("split", F.lit("train"))
    keyed = df.withColumn("_key", portable_key(F.col(id_), seed))
    cells = keyed.groupBy(F.shiftright("_key", 19).alias("cell")).count().collect()  # at most 4096 rows
    below = 0
    for r in sorted(cells):
        if below + r["count"] >= wanted:
            break
        below += r["count"]
    edge = keyed.where(F.shiftright("_key", 19) == r["cell"]).select("_key", id_).orderBy("_key", id_).limit(wanted - below).agg(F.max(F.struct("_key", id_)).alias("last"))
    last = edge.first()["last"]
    val = (F.col("_key") < last[0]) | ((F.col("_key") == last[0]) & (F.col(id_) <= last[1]))
    return keyed.withColumn("split", F.when(val, F.lit("val")).otherwise(F.lit("train"))).drop("_key")


def spread(df: DataFrame, key: str, most: int = 1024) -> DataFrame:
    """The rows dealt by key over tasks of about `most` rows, eight at least.

    For few bytes that dear work or large values are made of, which Spark would leave to one task. The key is opaque, or else
    filters on what is made would run below the shuffle, and make it there.
    """
    return df.repartition(max(8, -(-df.count() // most)), key).withColumn(key, opaque(F.col(key)))


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """The rows dealt by range, sorted and stored, with _task (the range) and _at (a number that rises with the order)."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    return ranged.withColumn("_task", F.shiftright("_at", 33))


def global_row_number(df: DataFrame, *order: str) -> DataFrame:
    """Adds n = 1, 2, ... by the order, without one task that sorts everything.

    Rows are dealt by range, sorted and stored; each task's first number follows from the counts of the tasks before it.
    """
    ranged = in_ranges(df, *order)
    counts = ranged.groupBy("_task").agg(F.count("*").alias("_rows"))  # one row a task
    before = counts.select("_task", (F.sum("_rows").over(Window.orderBy("_task")) - F.col("_rows")).alias("_before"))
    return ranged.join(F.broadcast(before), "_task").withColumn("n", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_task", "_at", "_before")


def least_before(df: DataFrame, value: Column, order: str, out: str) -> DataFrame:
    """Adds the least value of all rows before by the order, without one task that holds everything; null for the first."""
    ranged = in_ranges(df, order).withColumn("_value", value)
    counts = ranged.groupBy("_task").agg(F.min("_value").alias("_least"))  # one row a task
    before = counts.select("_task", F.min("_least").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.min("_value").over(Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(before), "_task").withColumn(out, F.least(own, F.col("_before"))).drop("_task", "_at", "_value", "_before")


def fixed_batches(df: DataFrame, order: str, size: int, drop_last: bool = False) -> DataFrame:
    """Adds batch_id and pos; `drop_last` leaves out an incomplete last batch."""
    numbered = global_row_number(df, order)
    out = numbered.withColumns({"batch_id": F.floor((F.col("n") - 1) / size), "pos": (F.col("n") - 1) % size}).drop("n")
    return out.where(F.col("batch_id") < numbered.count() // size) if drop_last else out


def shard_rows(df: DataFrame, order: str, world: int) -> DataFrame:
    """Adds rank and pos: every world-th row to a rank; ranks are filled up to equal sizes with the rows from the first on again."""
    numbered = global_row_number(df, order)
    total = numbered.count()
    places = F.sequence(F.col("n") - 1, F.lit(-(-total // world) * world - 1).cast("long"), F.lit(max(total, 1)).cast("long"))
    dealt = numbered.withColumn("_place", F.explode(places))
    return dealt.withColumns({"rank": F.col("_place") % world, "pos": F.floor(F.col("_place") / world)}).drop("n", "_place")


def offsets(ranged: DataFrame, *sums: Column) -> dict[int, tuple[int, ...]]:
    """For each range (_task) what the ranges before it sum up to; one row a range comes to the driver."""
    totals = ranged.groupBy("_task").agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(sums)]).collect()
    before, out = (0,) * len(sums), {}
    for r in sorted(totals):
        out[r["_task"]] = before
        before = tuple(x + y for x, y in zip(before, r[1:], strict=True))
    return out


def running_totals(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """The rows of in_ranges with, for each sum, the total of all rows before in the whole order; in place of _task and _at."""
    named = ranged.withColumns({name: value.cast("long") for name, value in sums.items()})
    before, names = offsets(named, *sums.values()), list(sums)
    kept = [c for c in named.columns if c not in ("_task", "_at")]
    schema = named.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = now or list(before[b.column("_task")[0].as_py()])
            made = {}
            for k, name in enumerate(names):
                x = b.column(name).to_numpy()
                made[name] = pa.array(np.cumsum(x) - x + now[k])
                now[k] += int(x.sum())
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in kept], names=kept)

    return named.mapInArrow(run, schema)


#: A millionth of a frame: lengths are compared and summed as whole numbers of these.
MICRO = 1_000_000


def exits(first: int, following: np.ndarray) -> np.ndarray:
    """For each place of a range that begins at `first` the place at which its chain of batches leaves the range."""
    to, end = following.copy(), first + len(following)
    while (inside := np.flatnonzero(to < end)).size:
        to[inside] = to[to[inside] - first]
    return to


def reached(edges: DataFrame) -> DataFrame:
    """place: all that the chain of edges (place, to) from place 0 comes to, by pointer doubling."""
    jumps, found, n = cut(edges), edges.where("place = 0").select("place"), 1
    while True:
        more = found.join(jumps, "place").select(F.col("to").alias("place"))
        found = cut(found.unionByName(more).distinct())
        before, n = n, found.count()
        if n == before:
            return found
        jumps = cut(jumps.join(jumps.select(F.col("place").alias("to"), F.col("to").alias("_far")), "to").select("place", F.col("_far").alias("to")))


def batch_starts(following: DataFrame, range_rows: int, n: int) -> DataFrame:
    """(range, place) of each batch's first sample, from rows (range, place, to): where the batch would end if one began there.

    Only a range is ever followed in one task: a chain's way through it, from where it comes in to where it leaves. The
    places where chains can come in are few, a batch's length for each range, and the one chain that counts is found among
    them by pointer doubling. `n` is the number of rows; where they are one range, its first place is the only way in.
    """

    def leave(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        return pa.table({"place": pa.array(np.unique(exits(t["place"][0].as_py(), t["to"].to_numpy())))})

    def step(key: tuple, entries: pa.Table, t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        places, first = np.unique(entries["place"].to_numpy()), key[0].as_py() * range_rows
        held = places[places < first + t.num_rows]
        return pa.table({"place": pa.array(held), "to": pa.array(exits(first, t["to"].to_numpy())[held - first])})

    def walk(key: tuple, entries: pa.Table, t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        to, first, found = t["to"].to_numpy().tolist(), key[0].as_py() * range_rows, []
        place = min(entries["place"].to_pylist(), default=first + len(to))
        while place < first + len(to):
            found.append(place)
            place = to[place - first]
        return pa.table({"range": pa.array([key[0].as_py()] * len(found), pa.int64()), "place": pa.array(found, pa.int64())})

    def ranged(places: DataFrame) -> DataFrame:
        return places.withColumn("range", F.floor(F.col("place") / range_rows))

    zero = following.sparkSession.range(1).select(F.col("id").alias("place"))
    by_range = following.groupBy("range")
    if n > range_rows:
        entries = cut(following.groupBy("range").applyInArrow(leave, "place long").unionByName(zero).distinct())
        zero = reached(ranged(entries).groupBy("range").cogroup(by_range).applyInArrow(step, "place long, to long"))
    return cut(ranged(zero).groupBy("range").cogroup(by_range).applyInArrow(walk, "range long, place long"))


def frame_batches(df: DataFrame, id_: str, frames: str, by: str, budget: float, most: int = 0, drop_last: bool = False, range_rows: int = 1 << 17) -> DataFrame:
    """Plan of batches within each group of `by`: by, batch_id, pos, id, frames.

    Samples in order of frames (ties by id) fill batches of a frame budget and a number of samples; one that exceeds
    the budget alone is a batch of its own. `drop_last` leaves out the last batch, whatever its size. Lengths count to a
    millionth, null and NaN as 0.

    Groups may have any size. Running totals by ranges give each sample the place at which a batch from there would end:
    among all running totals, sorted together with the limits, a limit stands behind the totals that it allows. Then
    batch_starts() follows the chain of batches through ranges of `range_rows` places.
    """
    length = F.coalesce(F.nanvl(F.col("frames"), F.lit(0.0)), F.lit(0.0))
    rows = df.select(F.col(by).alias("_by"), F.col(id_).alias("_id"), F.col(frames).cast("double").alias("frames"))
    ranged = in_ranges(rows.withColumn("_length", length).withColumn("_units", F.round(length * MICRO).cast("long")), "_by", "_length", "_id")
    placed = cut(running_totals(ranged, {"place": F.lit(1), "total": F.col("_units")}))
    limits = placed.select("_by", (F.col("total") + round(budget * MICRO)).alias("value"), F.lit(1).alias("kind"), "place")
    points = placed.select("_by", (F.col("total") + F.col("_units")).alias("value"), F.lit(0).alias("kind"), "place")
    sorted_ = in_ranges(points.unionByName(limits), "_by", "value", "kind", "place")
    counted = running_totals(sorted_, {"allowed": 1 - F.col("kind")}).where("kind = 1")
    to = F.greatest(F.col("place") + 1, F.least("allowed", F.col("place") + most) if most else F.col("allowed"))
    in_range = F.floor(F.col("place") / range_rows).alias("range")
    following = cut(counted.select(in_range, "place", to.alias("to")))
    n_rows = following.count()
    if not n_rows:
        return rows.select(F.col("_by").alias(by), F.lit(0).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("pos"), F.col("_id").alias(id_), "frames")
    starts = batch_starts(following, range_rows, n_rows)
    # One row a range: how many batches began before it, and where the last of them did.
    tally = starts.groupBy("range").agg(F.count("*").alias("n"), F.max("place").alias("last")).collect()
    before, last, opened = {}, 0, 0
    counts = {r["range"]: r for r in tally}
    for k in range(max(counts) + 1):
        before[k] = (opened, last)
        if k in counts:
            opened, last = opened + counts[k]["n"], counts[k]["last"]

    def settle(key: tuple, begun: pa.Table, t: pa.Table) -> pa.Table:
        n, carried = before.get(key[0].as_py(), (opened, last))
        edge, place = np.sort(begun["place"].to_numpy()), t["place"].to_numpy()
        at = np.searchsorted(edge, place, side="right")
        start = np.where(at > 0, edge[np.maximum(at, 1) - 1] if len(edge) else 0, carried)
        return pa.table({"_by": t["_by"], "batch": pa.array(at + n), "pos": pa.array(place - start), "_id": t["_id"], "frames": t["frames"]})

    schema = T.StructType([rows.schema["_by"], T.StructField("batch", T.LongType()), T.StructField("pos", T.LongType()), rows.schema["_id"], T.StructField("frames", T.DoubleType())])
    held = placed.select(in_range, "place", "_by", "_id", "frames")
    plan = cut(starts.groupBy("range").cogroup(held.groupBy("range")).applyInArrow(settle, schema))
    groups = plan.groupBy(F.col("_by").alias("_group")).agg(F.min("batch").alias("_least"), F.max("batch").alias("_most"))
    few = groups.limit(50_001).count() <= 50_000  # then a broadcast leaves the rows where they are, however many a group has
    joined = plan.join(F.broadcast(groups) if few else groups, F.col("_by").eqNullSafe(F.col("_group")))
    if drop_last:
        joined = joined.where("batch < _most")
    return joined.select(F.col("_by").alias(by), (F.col("batch") - F.col("_least")).alias("batch_id"), "pos", F.col("_id").alias(id_), "frames")


def frame_batches_streamed(df: DataFrame, id_: str, frames: str, budget: float, most: int = 0) -> DataFrame:
    """The same plan over a whole table of any size: each range of lengths is packed by a task of its own, in bounded memory.

    Batches don't cross the ranges, so each task may leave one batch less than full. Ids are the task's number times
    2**40 plus a running number.
    """
    rows = df.select(id_, F.col(frames).cast("double").alias("frames")).repartitionByRange("frames", id_).sortWithinPartitions("frames", id_).withColumn("task", F.spark_partition_id())
    schema = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("pos", T.LongType()), rows.schema[id_], T.StructField("frames", T.DoubleType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, used = 0, 0, 0.0
        for b in batches:
            ids, pos = [], []
            for f, task in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and not (used + f <= budget and (most == 0 or held < most)):
                    number, held, used = number + 1, 0, 0.0
                ids.append((task << 40) + number)
                pos.append(held)
                held, used = held + 1, used + f
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int64()), b.column(0), b.column(1)], names=schema.names)

    return rows.mapInArrow(pack, schema)


def shuffled_place(number: Column, n: Column | int, seed: int, rounds: int = 64) -> Column:
    """Where 0..n-1 stand after a shuffle that the seed chooses: a permutation for every n, one expression a row, no sort.

    In each round the numbers x and (k - x) mod n are partners, and a bit of their larger one decides whether they
    change places. Plain arithmetic, so that any engine can repeat it.
    """
    n = (F.lit(n) if isinstance(n, int) else n).cast("long")

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(mixed(r, seed), n) - x, n)
        return F.when(F.shiftright(mixed(F.greatest(x, partner) * F.lit(64) + r, seed), 16).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(rounds).cast("long")), number.cast("long"), step)


def mixed(x: Column, seed: int) -> Column:
    """A number below 2**31 from a number and a seed."""
    m = F.lit(2147483648)
    return F.pmod(F.pmod(F.pmod(x, m) * F.lit(1103515245) + F.lit(12345 + seed * 40503), m) * F.lit(1664525) + F.lit(1013904223), m)


def epoch_order(batches: DataFrame, epoch: int, batch: str = "batch_id") -> DataFrame:
    """Adds place (from 1): where each batch stands in the order that the epoch's number seeds; the same for each run.

    Batches are numbered by ranges; their places follow from their numbers, so nothing is sorted by the shuffled order.
    """
    numbered = global_row_number(batches, batch)
    return numbered.withColumn("place", shuffled_place(F.col("n") - 1, numbered.count(), epoch) + 1).drop("n")


def collate(df: DataFrame, batch: str, order: str, ids: str) -> DataFrame:
    """Adds text_ids (filled with -1 to the batch's longest), mask and lengths; one row a sample, in order within its batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return df.withColumn("length", F.size(ids)).withColumn("longest", longest).withColumns({
        "text_ids": padded(F.col(ids), F.col("longest"), -1),
        "mask": F.transform(F.sequence(F.lit(1), F.greatest(F.col("longest"), F.lit(1))), lambda i: i <= F.col("length")),
    })


def collate_mels(df: DataFrame, batch: str, mel: str) -> DataFrame:
    """Fills every mel row (array of arrays) with 0.0 up to the batch's longest; adds mel_length."""
    longest = F.max(F.size(F.get(F.col(mel), F.lit(0)))).over(Window.partitionBy(batch))
    return df.withColumn("mel_length", F.size(F.get(F.col(mel), F.lit(0)))).withColumn("_longest", longest).withColumn(
        mel, F.transform(mel, lambda row: padded(row, F.col("_longest"), 0.0))).drop("_longest")
