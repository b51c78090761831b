"""Archives by ranges, sinks that commit, and the dictionary that is kept."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexwind.functions.audio import decoded, write_wav
from lexwind.operators.dictionary import extend_dictionary, read_dictionary, versions
from lexwind.operators.ingest import dense_ids_by_appearance
from lexwind.operators.preparation import clean_archive
from lexwind.sources import archives
from lexwind.sources.archives import TarSource, lines_of, member_contents, tar_index
from lexwind.sources.corpora import metadata_document
from lexwind.sources.sinks import write_checkpoints, write_files, write_json_array


def pack(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return str(path)


def tone(n, step=9):
    return write_wav(0.3 * np.sin(np.arange(n) / step), 24_000)


TABLE = "client_id\tpath\tsentence\r\nc1\ta.mp3\t5 мод\r\n\nc2\tgone.mp3\tсайн уу\nc1\tb.mp3\tю\nc3\tb.mp3\tсайн байна\nc4\tc.mp3\tсайн байна\nc5\td.mp3\tHello\n"


@pytest.mark.parametrize("mode", ["w", "w:gz"])
def test_archive_to_clips(spark, tmp_path, mode):
    """WAV bytes stand in for MP3, since no ffmpeg is at hand."""
    path = pack(tmp_path / "a.tar", [("cv/train.tsv", TABLE.encode()), ("cv/clips/a.mp3", tone(14_400)), ("cv/clips/xb.mp3", tone(14_400)), ("cv/clips/c.mp3", b"no sound"), ("cv/clips/d.mp3", tone(14_400))], mode)
    got = {r.idx: r for r in clean_archive(spark, path, read=decoded).collect()}
    assert {i: (r.status, r.speaker_id, r.text) for i, r in got.items()} == {
        0: ("ok", 0, "таван мод"), 1: ("failed", 1, "сайн уу"), 2: ("unnamed", None, None), 3: ("ok", 2, "сайн байна"), 4: ("failed", 3, "сайн байна"), 5: ("filtered", 4, "")}
    assert got[0].audio_path == "cv_000000.wav" and 12_000 <= len(got[0].samples) <= 14_400 and got[1].samples is None
    assert len(clean_archive(spark, path, read=decoded, most=1).collect()) == 1


@pytest.mark.parametrize("modes", [("w", "w"), ("w:gz", "w")])
def test_archives_with_equal_ordinals(spark, tmp_path, modes):
    line = "client_id\tpath\tsentence\nc{0}\tq.mp3\tсайн байна\n"
    paths = [pack(tmp_path / f"{k}.tar", [("cv/train.tsv", line.format(k).encode()), ("cv/clips/q.mp3", tone(14_400 + 4_800 * k, 9 + k))], mode) for k, mode in enumerate(modes)]
    got = sorted(clean_archive(spark, ",".join(paths), read=decoded).collect(), key=lambda r: r.idx)
    assert [(r.idx, r.client_id, r.speaker_id, r.status, r.audio_path) for r in got] == [(0, "c0", 0, "ok", "cv_000000.wav"), (1, "c1", 1, "ok", "cv_000001.wav")]
    assert len(got[0].samples) <= 14_400 < len(got[1].samples) <= 19_200


def test_an_archive_without_metadata(spark, tmp_path):
    with pytest.raises(ValueError, match="No TSV"):
        clean_archive(spark, pack(tmp_path / "a.tar", [("cv/clips/a.mp3", b"1")]), read=decoded)


@pytest.mark.parametrize("mode", ["w", "w:bz2"])
def test_members_are_read_by_ranges(spark, tmp_path, mode):
    members = [(f"d/{i}.bin", bytes([i % 251]) * (1000 + i)) for i in range(60)]
    index = tar_index(spark, pack(tmp_path / "b.tar", members, mode))
    wanted = index.where("ordinal % 3 = 1").withColumn("extra", F.col("ordinal") * 2)
    got = member_contents(wanted, range_bytes=8000).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.name, bytes(r.content), r.extra) for r in got} == {(n, c, 2 * i) for i, (n, c) in enumerate(members) if i % 3 == 1}
    assert (len({r.task for r in got}) > 1) == (mode == "w")
    twice = member_contents(wanted.unionByName(wanted))
    assert twice.count() == 2 * len(got)


def test_filters_reach_the_archive(spark, tmp_path):
    path = pack(tmp_path / "c.tar", [("a.tsv", b"1"), ("b.mp3", b"2"), ("c.tsv", b"3")])
    spark.dataSource.register(TarSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("tar_members").option("pushdown", "true").load(path)
        assert [(r.ordinal, bytes(r.content)) for r in rows.where(F.endswith("name", F.lit(".tsv")) & (F.col("ordinal") > 0)).collect()] == [(2, b"3")]
        assert [r.name for r in rows.where(F.col("name").isin("b.mp3", "x")).collect()] == ["b.mp3"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = archives.PushingTarReader({"path": path})
    left = list(reader.pushFilters([archives.StringEndsWith(("name",), ".tsv"), archives.StringEndsWith(("archive",), ".tsv")]))
    assert len(left) == 1 and [r[2] for r in reader.read(reader.partitions()[0])] == ["a.tsv", "c.tsv"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_lines_of_parts(size):
    text = "a\tb\r\nö x\x85y\r\n\r\nlast\rone"
    data = text.encode()
    assert list(lines_of(data[i : i + size] for i in range(0, len(data), size))) == text.splitlines()


def test_files_are_all_there_or_none(spark, tmp_path):
    rows = spark.range(200).select(F.format_string("s_%06d.wav", "id").alias("n"), F.encode(F.repeat(F.col("id").cast("string"), 50), "UTF-8").alias("c")).repartition(4)
    folder = tmp_path / "wavs"
    write_files(rows, str(folder), "n", "c")
    assert len(list(folder.glob("*.wav"))) == 200 and (folder / "_SUCCESS").exists() and not list(folder.glob("_hidden*"))
    assert (folder / "s_000007.wav").read_bytes() == b"7" * 50
    broken = rows.withColumn("c", F.when(F.col("n") == "s_000150.wav", F.raise_error(F.lit("killed")).cast("binary")).otherwise(F.col("c")))
    other = tmp_path / "broken"
    with pytest.raises(Exception, match="killed"):
        write_files(broken, str(other), "n", "c")
    assert not [p for p in other.rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="same file name"):
        write_files(rows.withColumn("n", F.lit("same.wav")), str(other), "n", "c")
    assert not list(other.glob("*.wav"))


def test_one_json_array_of_many_rows(spark, tmp_path):
    rows = spark.range(100_000).select(F.col("id").alias("idx"), F.format_string("s_%d.wav", "id").alias("audio_path"), F.lit("сайн").alias("text")).repartition(7)
    write_json_array(rows, str(tmp_path / "m" / "metadata.json"), "idx")
    made = (tmp_path / "m" / "metadata.json").read_text()
    assert made == metadata_document(rows, "idx").first().json
    assert json.loads(made)[99_999] == {"audio_path": "s_99999.wav", "text": "сайн"}
    assert [p.name for p in (tmp_path / "m").iterdir()] == ["metadata.json"]
    write_json_array(rows.where("idx < 0"), str(tmp_path / "m" / "none.json"), "idx")
    assert json.loads((tmp_path / "m" / "none.json").read_text()) == []


def test_retention_is_part_of_the_commit(spark, tmp_path):
    folder = tmp_path / "ckpt"
    (folder).mkdir()
    (folder / "other_step_00000001.pt").write_bytes(b"x")
    for first in (0, 3):
        write_checkpoints(spark.range(first, first + 3).select(F.col("id").alias("step"), F.lit(b"w").alias("content")), str(folder), "voice", "step", "content", keep=2)
    assert sorted(p.name for p in folder.glob("*.pt")) == ["other_step_00000001.pt", "voice_step_00000004.pt", "voice_step_00000005.pt"]


def test_dictionary_goes_on(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("client", F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")))
    half = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    path = str(tmp_path / "speakers")
    parts = [extend_dictionary(events.where(c), path, "client", "event_id").select("event_id", "speaker_id").collect() for c in (F.col("event_id") <= half, F.col("event_id") > half)]
    wanted = dense_ids_by_appearance(events, "client", "event_id").select("event_id", F.col("speaker_id").cast("long"))
    assert {tuple(r) for p in parts for r in p} == {tuple(r) for r in wanted.collect()}
    known = len(versions(spark, path))
    extend_dictionary(events, path, "client", "event_id").count()
    assert len(versions(spark, path)) == known
    ids = sorted(r.id for r in read_dictionary(spark, path).collect())
    assert ids == list(range(len(ids))) and read_dictionary(spark, path, 1).count() < len(ids) + 1
