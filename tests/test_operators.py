import io
import json
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexwind.functions import audio as A
from lexwind.functions import maths as M
from lexwind.functions.sql import register
from lexwind.operators import batching as B
from lexwind.operators import ingest as I
from lexwind.operators import metrics as X
from lexwind.operators import registry as R
from lexwind.operators.synthesis import synthesis_plan
from lexwind.sources import corpora as C
from lexwind.streaming.clean import clean_stream, first_rows


def test_text_column():
    class Table:
        columns = ["a", "sentence", "text"]

    assert I.text_column(Table) == "text"
    Table.columns = ["a"]
    with pytest.raises(ValueError, match="the table has: a"):
        I.text_column(Table)


def test_reasons_in_order(spark):
    rows = spark.createDataFrame([(None, "x"), (2.0, "  "), (0.5, "x"), (31.0, "x"), (1.0, "x"), (30.0, None)], "d double, t string")
    assert [r[0] for r in rows.select(I.reject_reason(F.col("d"), F.col("t"))).collect()] == ["no_audio", "empty_text", "too_short", "too_long", None, "empty_text"]
    with pytest.raises(ValueError, match="No sample"):
        I.require_rows(rows.where("d > 99"))


def test_members_by_suffix(spark):
    members = spark.createDataFrame([(0, "cv/xa.mp3"), (1, "cv/clips/b.mp3"), (2, "q/a.mp3"), (3, "cv/clips/a.mp3.txt")], "ordinal long, name string")
    rows = spark.createDataFrame([("a.mp3",), ("b.mp3",), ("c.mp3",), (None,), ("",)], "path string")
    assert {r.path: r.member for r in I.join_members(rows, members, prefixes=("cv/clips/", "")).collect()} == {"a.mp3": "cv/xa.mp3", "b.mp3": "cv/clips/b.mp3", "c.mp3": None, None: None, "": None}


def test_speakers_by_appearance(spark):
    rows = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "i long, client string")
    assert [r.speaker_id for r in I.dense_ids_by_appearance(rows, "client", "i").orderBy("i").collect()] == [0, 1, 2, 0]


def test_split_is_exact(spark):
    for n, wanted in ((1000, 100), (19, 0), (20, 2), (25, 2), (0, 0)):
        assert B.train_val_split(spark.range(n), "id").where("split = 'val'").count() == wanted


def test_frame_batches_cover_and_respect_the_budget(spark):
    rows = spark.range(500).select("id", (F.pmod(F.col("id") * 37, F.lit(101)) + 0.5).alias("f"), (F.col("id") % 2).alias("g"))
    for plan, keys in ((B.frame_batches(rows, "id", "f", "g", 300, 7), ["g", "batch_id"]), (B.frame_batches_streamed(rows, "id", "f", 300, 7), ["batch_id"])):
        assert sorted(r.id for r in plan.collect()) == list(range(500))
        sums = plan.groupBy(*keys).agg(F.sum("frames").alias("s"), F.count("*").alias("n"))
        assert all(r.n <= 7 and (r.s <= 300 or r.n == 1) for r in sums.collect())
    whole = B.frame_batches(rows, "id", "f", "g", 300, 7)
    dropped = B.frame_batches(rows, "id", "f", "g", 300, 7, drop_last=True)
    assert dropped.count() == whole.count() - sum(r.n for r in whole.groupBy("g", "batch_id").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("n", "batch_id").alias("n")).collect())
    alone = B.frame_batches(spark.createDataFrame([(1, 999.0, 0), (2, 1.0, 0)], "id long, f double, g int"), "id", "f", "g", 300)
    assert {r.id: r.batch_id for r in alone.collect()} == {2: 0, 1: 1}


def test_global_numbers_and_batches(spark):
    got = B.global_row_number(spark.range(0, 1000).repartition(7), "id").collect()
    assert all(r.n == r.id + 1 for r in got)
    assert B.fixed_batches(spark.range(10), "id", 4, drop_last=True).count() == 8
    mels = spark.createDataFrame([(0, [[1.0], [2.0]]), (0, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])], "b int, mel array<array<double>>")
    assert sorted((r.mel_length, r.mel[0]) for r in B.collate_mels(mels, "b", "mel").collect()) == [(1, [1.0, 0.0, 0.0]), (3, [1.0, 2.0, 3.0])]


def test_synthesis_plan(spark):
    q = spark.createDataFrame([(1, "Нэг хоёр. Гурав дөрөв тав зургаа."), (2, ""), (3, "а")], "r long, t string")
    plan = synthesis_plan(q, "r", "t", most_chars=15).orderBy("r", "idx").collect()
    assert [(p.r, p.idx) for p in plan] == [(1, 0), (1, 1), (1, 2), (3, 0)]
    assert plan[1].sample_offset == plan[0].samples + 6000
    assert plan[3].frames == 50


def test_registry(spark):
    assert spark.range(1).select(R.step_path("voice", F.lit(7)), R.parsed_step(F.lit("a/voice_step_00000010.pt")), R.parsed_step(F.lit("voice_best.pt"))).first()[:] == ("voice_step_00000007.pt", 10, None)
    names = ["README.md", "config.json", "voice_best.pt", "voice_step_00000010.pt", "voice_step_00000020.pt", "voice_step_00000030.pt", "tb_logs/x"]
    remote = spark.createDataFrame([(n,) for n in names], "path string")
    local = spark.createDataFrame([("out/voice_step_00000020.pt",), ("out/voice_step_00000030.pt",)], "path string")
    assert [r.path for r in R.stale_remote(remote, local, "voice").collect()] == ["voice_step_00000010.pt"]
    assert R.to_load(spark.createDataFrame([], "path string, step long, is_best boolean")).first()[:] == (None, 0)
    assert "| dim | ? |" in R.model_card({}, "m")


def test_metrics(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 2.0, float("nan"), 4.0, 5.0, float("inf"), 7.0, 8.0, 9.0])], "batch long, loss double")
    assert [(r.group_id, r.mean_loss) for r in X.accumulated_losses(rows).orderBy("group_id").collect()] == [(0, 4.0), (1, 7.5), (2, 9.0)]
    bad = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "batch long, loss double")
    assert X.accumulated_losses(bad, group_size=2).count() == 0
    assert X.mean_loss(bad.where("batch > 5"), "loss").first()[0] == 0.0


def test_audio(spark):
    t = np.arange(48_000) / 24_000
    tone = (0.3 * np.sin(2 * np.pi * 220 * t)).astype(np.float32)
    assert A.log_mel(tone).shape == (100, 188)
    quiet = np.concatenate([np.zeros(24_000, np.float32), tone, np.zeros(24_000, np.float32)])
    assert 48_000 <= len(A.trimmed_silence(quiet)) <= 48_000 + 6 * 1024
    raw = A.write_wav(tone, 24_000)
    rows = spark.createDataFrame([(raw,), (b"no wav",), (None,)], "b binary").select(A.wav_seconds(F.col("b")).alias("s"), A.decode_audio(F.col("b"), 12_000).alias("x")).collect()
    assert [r.s for r in rows] == [2.0, None, None]
    assert len(rows[0].x) == 24_000 and abs(max(rows[0].x) - 0.3) < 0.02 and rows[1].x is None
    r = spark.range(1).select(M.peak_normalized(F.array(F.lit(0.5), F.lit(-0.25))), M.peak_normalized(F.array(F.lit(0.0))), F.size(M.sine()), A.concat_with_pause(F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0))), 8, 0.25)).first()
    assert r[0][0] == pytest.approx(1, abs=1e-5) and r[1] == [0.0] and r[2] == 48_000 and r[3] == [1.0, 0.0, 0.0, 2.0]


def test_pluggable_audio(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "x array<float>")

    def fails(x):
        raise RuntimeError

    r = rows.select(A.denoise(F.col("x"), lambda x: x * 2).alias("a"), A.denoise(F.col("x"), fails).alias("b"), A.resample(F.col("x"), 8000, 16_000).alias("c"), A.decode_mp3(F.lit(b"no mp3"), ffmpeg="no-such-program").alias("d")).collect()
    assert (r[0].a, r[0].b, len(r[0].c), r[0].d, r[1].a) == ([2.0, 4.0], [1.0, 2.0], 4, None, None)
    assert C.presets("/x")["mbspeech"].text_column == "sentence_norm" and C.load_config("/none.json") is None
    with pytest.raises(ValueError, match="unequal"):
        C.from_lists(spark, ["a"], [], strict=True)


def test_learning_rate_ends(spark):
    r = spark.range(1).select(*[M.learning_rate(F.lit(s), 1e-4, 100, 1100) for s in (0, 100, 1100)]).first()
    assert [round(x, 12) for x in r] == [1e-8, 1e-4, 1e-6] and math.isclose(r[1], 1e-4)


def test_sources(spark, tmp_path):
    register(spark)
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, body in (("cv/train.tsv", b"client_id\tpath\tsentence\nc1\ta.mp3\tx"), ("cv/clips/a.mp3", b"123"), ("cv/validated.tsv", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    members = spark.read.format("tar_members").load(str(tmp_path / "a.tar.gz"))
    assert [(r.ordinal, r.name, len(r.content)) for r in members.orderBy("ordinal").collect()] == [(0, "cv/train.tsv", 34), (1, "cv/clips/a.mp3", 3), (2, "cv/validated.tsv", 0)]
    assert C.archive_metadata(members).first().name == "cv/train.tsv"
    (tmp_path / "t.tsv").write_text('filename\ttext\na.mp3\tsay "hi\n')
    assert C.read_tsv(spark, str(tmp_path / "t.tsv")).select("path", "sentence").first()[:] == ("a.mp3", 'say "hi')
    (tmp_path / "m.json").write_text(json.dumps([{"audio_path": "a", "text": "x", "speaker_id": 1, "attr_tokens": ["[MALE]"]}, {"audio_path": "b", "text": "y", "attr_tokens": "[YOUNG]", "lang": "kz"}]))
    assert [(r.lang, r.attr_tokens) for r in C.read_metadata(spark, str(tmp_path / "m.json")).orderBy("audio_path").collect()][0] == ("mn", ["[MALE]"])
    made = C.from_lists(spark, ["a", "b"], ["x", "y", "z"], [1, 2])
    assert made.count() == 2
    document = C.metadata_document(made, "idx").first().json
    assert json.loads(document)[1] == {"audio_path": "b", "text": "y", "speaker_id": 2}
    both = made.write.parquet(str(tmp_path / "c" / "train")), made.write.parquet(str(tmp_path / "c" / "dev"))
    assert both and C.load_split(spark, str(tmp_path / "c"), "train+dev").count() == 4
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips" / "q.wav").write_bytes(b"qq")
    rows = spark.createDataFrame([((bytearray(b"in"), "x"),), ((None, str(tmp_path / "clips" / "q.wav")),), ((None, "gone"),)], "audio struct<bytes:binary,path:string>")
    assert sorted(str(bytes(r.content)) if r.content else "" for r in C.resolved_audio(rows, C.binary_files(spark, str(tmp_path / "clips"))).collect()) == ["", "b'in'", "b'qq'"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("Сайн  БАЙНА",), ("уу",)], "text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = clean_stream(spark, str(tmp_path / "in"), "text string")
    assert sorted(r.cleaned for r in first_rows(stream, 10, "cleaned_rows").collect()) == ["сайн байна", "уу"]


def test_shards_of_few_rows_are_equal(spark):
    from lexwind.operators.batching import shard_rows

    got = shard_rows(spark.createDataFrame([(1,), (2,)], "k long"), "k", 7).collect()
    assert sorted((r["rank"], r.pos, r.k) for r in got) == [(i, 0, 1 + i % 2) for i in range(7)]
    assert shard_rows(spark.createDataFrame([], "k long"), "k", 3).count() == 0


def test_a_source_that_breaks_on_reading_is_skipped(spark):
    from pyspark.sql import functions as F

    from lexwind.operators.ingest import union_sources

    good = spark.createDataFrame([("a",)], "text string")
    both, errors = union_sources([(0, lambda: good), (1, lambda: good.select(F.raise_error(F.lit("broken")).cast("string").alias("text")))])
    assert [tuple(r) for r in both.collect()] == [("a", 0)] and len(errors) == 1 and "broken" in errors[0]


def test_model_card_reads_the_model():
    from lexwind.operators.registry import model_card

    card = model_card({"model": {"dim": 512}, "n_mels": 80}, "voice")
    assert "| dim | 512 |" in card and "| depth | ? |" in card and "| vocab_size | 65 |" in card and "| sample_rate | 24000 Hz |" in card and "| mel_bins | 80 |" in card
    assert "| heads | ? |" in model_card(None, "voice")


def test_running_best_over_ranges(spark):
    from lexwind.operators.registry import every_nth, with_best

    losses = [(i, float((i * 37) % 101) - 3) for i in range(300)]
    got = {r.epoch: (r.best_before, r.is_new_best) for r in with_best(spark.createDataFrame(losses, "epoch long, val_loss double").repartition(5), "epoch").collect()}
    best = None
    for i, v in losses:
        assert got[i] == (best, v > 0 and (best is None or v < best))
        best = v if v > 0 and (best is None or v < best) else best
    assert sorted(r.epoch for r in every_nth(spark.createDataFrame(losses, "epoch long, val_loss double"), "epoch", 7).collect()) == list(range(6, 300, 7))
