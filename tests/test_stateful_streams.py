"""Streams with state give what the batch operators give, over several arrivals and after a restart."""

import shutil

import pytest

from lexwind.operators.batching import frame_batches
from lexwind.operators.ingest import dense_ids_by_appearance
from lexwind.operators.registry import every_nth
from lexwind.streaming.state import batch_arrivals, number_speakers, pushed_arrivals, use_state_store


@pytest.fixture
def arrivals(spark, tmp_path):
    """run(rows, schema, make): all output rows after three arrivals, each taken by a query of its own from one checkpoint."""
    use_state_store(spark)

    def run(parts, schema, make):
        source, out, at = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
        source.mkdir()
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                shutil.copy(f, source / f"{k}.parquet")
            stream = make(spark.readStream.schema(schema).parquet(str(source)))
            query = stream.writeStream.format("parquet").option("checkpointLocation", str(at)).option("path", str(out)).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        return spark.read.parquet(str(out))

    return run


def thirds(rows):
    n = len(rows) // 3
    return rows[:n], rows[n : 2 * n], rows[2 * n :]


def test_speakers_are_numbered_on(spark, arrivals):
    rows = [("cv", i, None if i % 11 == 0 else f"c{i * i % 17}") for i in range(60)]
    schema = "source string, idx long, client_id string"
    got = arrivals(thirds(rows), schema, lambda s: number_speakers(s, "source"))
    wanted = dense_ids_by_appearance(spark.createDataFrame(rows, schema), "client_id", "idx")
    assert {(r.idx, r.speaker_id) for r in got.collect()} == {(r.idx, r.speaker_id) for r in wanted.collect()}


def test_batches_stay_open_between_arrivals(spark, arrivals):
    rows = [(i, float(1 + i // 4), "ab"[i % 2]) for i in range(90)]
    schema = "id long, f double, g string"
    got = arrivals(thirds(rows), schema, lambda s: batch_arrivals(s, "id", "f", "g", 60, 7))
    wanted = frame_batches(spark.createDataFrame(rows, schema), "id", "f", "g", 60, 7)
    assert {(r.g, r.batch_id, r.pos, r.id) for r in got.collect()} == {(r.g, r.batch_id, r.pos, r.id) for r in wanted.collect()}


def test_pushes_are_counted_on(spark, arrivals):
    rows = [("voice", i) for i in range(40)]
    got = arrivals(thirds(rows), "model string, step long", lambda s: pushed_arrivals(s, "model", "step", 3))
    wanted = every_nth(spark.createDataFrame(rows, "model string, step long"), "step", 3)
    assert {r.step for r in got.collect()} == {r.step for r in wanted.collect()}


def test_an_idle_batch_is_closed(spark, tmp_path):
    use_state_store(spark)
    schema, source, out = "id long, f double, g string", tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def arrive(k):
        spark.createDataFrame([(k, 1.0, "a")], schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            shutil.copy(f, source / f"{k}.parquet")

    arrive(0)
    stream = batch_arrivals(spark.readStream.schema(schema).parquet(str(source)), "id", "f", "g", 60, 0, idle=500)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(out)).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for n in (1, 2):
            for _ in range(60):  # until the row is out, at most a minute
                query.awaitTermination(1)
                if out.exists() and list(out.glob("*.parquet")) and spark.read.schema("id long").parquet(str(out)).count() == n:
                    break
            query.awaitTermination(8)
            if n == 1:
                arrive(1)
    finally:
        query.stop()
    assert sorted((r.id, r.batch_id) for r in spark.read.parquet(str(out)).collect()) == [(0, 0), (1, 1)]
