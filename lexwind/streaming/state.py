"""Stateful operators over streams: speaker numbers, batches that stay open between arrivals, every n-th save.

Each keeps a small state for a key (a source, a split, a model) in Spark's state store, so a stream that starts again from its
checkpoint goes on where it stopped. Rows of one arrival are taken in their order; a key's rows of one arrival are held by
one task, so an arrival's size (maxFilesPerTrigger, maxBytesPerTrigger) bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """These operators need the state store that has states of several kinds; set it before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Numbers(StatefulProcessor):
    """0, 1, ... to the keys of a source in order of first appearance."""

    def __init__(self, key: str, order: str, missing: str):
        self.key, self.order, self.missing = key, order, missing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", T.StructType([T.StructField("key", T.StringType())]), T.StructType([T.StructField("id", T.LongType())]))
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        n = (self.count.get() or (0,))[0]
        for row in sorted(rows, key=lambda r: r[self.order]):
            name = (self.missing if row[self.key] is None else row[self.key],)
            if not self.ids.containsKey(name):
                self.ids.updateValue(name, (n,))
                n += 1
            yield Row(**row.asDict(), speaker_id=self.ids.getValue(name)[0])
        self.count.update((n,))

    def close(self) -> None:
        pass


class OpenBatches(StatefulProcessor):
    """Samples join the split's open batch while its budget lasts; a batch that nothing has joined for `idle` milliseconds is closed."""

    def __init__(self, columns: list[str], budget: float, most: int, idle: int):
        self.columns, self.budget, self.most, self.idle = columns, budget, most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kind = T.StructType([T.StructField("number", T.LongType()), T.StructField("held", T.LongType()), T.StructField("used", T.DoubleType())])
        self.open = handle.getValueState("open", kind)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        number, held, used = self.open.get() or (0, 0, 0.0)
        by, id_, frames = self.columns
        for row in sorted(rows, key=lambda r: (r[frames], r[id_])):
            if held and not (used + row[frames] <= self.budget and (self.most == 0 or held < self.most)):
                number, held, used = number + 1, 0, 0.0
            yield Row(**{by: key[0], "batch_id": number, "pos": held, id_: row[id_], frames: row[frames]})
            held, used = held + 1, used + row[frames]
        self.open.update((number, held, used))
        if self.idle:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        number, held, _ = self.open.get() or (0, 0, 0.0)
        if held:
            self.open.update((number + 1, 0, 0.0))
        return iter(())

    def close(self) -> None:
        pass


class EveryNth(StatefulProcessor):
    """Every n-th row of a key, counted over all arrivals."""

    def __init__(self, order: str, n: int):
        self.order, self.n = order, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        seen = (self.count.get() or (0,))[0]
        for row in sorted(rows, key=lambda r: r[self.order]):
            seen += 1
            if seen % self.n == 0:
                yield row
        self.count.update((seen,))

    def close(self) -> None:
        pass


def number_speakers(stream: DataFrame, source: str, key: str = "client_id", order: str = "idx", missing: str = "unknown") -> DataFrame:
    """The rows with speaker_id, by first appearance in their source; null keys count as one key. Equal to dense_ids_by_appearance over all
    arrivals if later arrivals come later in the order."""
    out = T.StructType([*stream.schema.fields, T.StructField("speaker_id", T.LongType())])
    return stream.groupBy(source).transformWithState(Numbers(key, order, missing), out, "Append", "None")


def batch_arrivals(stream: DataFrame, id_: str, frames: str, by: str, budget: float, most: int = 0, idle: int = 0) -> DataFrame:
    """by, batch_id, pos, id, frames: frame_batches over a stream, where each arrival is ordered by frames and then by id.

    With `idle`, a batch is closed when nothing has come for so many milliseconds.
    """
    rows = stream.select(by, id_, F.col(frames).cast("double").alias(frames))
    out = T.StructType([rows.schema[by], T.StructField("batch_id", T.LongType()), T.StructField("pos", T.LongType()), rows.schema[id_], rows.schema[frames]])
    return rows.groupBy(by).transformWithState(OpenBatches([by, id_, frames], budget, most, idle), out, "Append", "ProcessingTime" if idle else "None")


def pushed_arrivals(stream: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Every n-th save of a model is pushed; the count goes on from arrival to arrival."""
    return stream.groupBy(by).transformWithState(EveryNth(order, n), stream.schema, "Append", "None")
