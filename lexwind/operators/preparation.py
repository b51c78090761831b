"""Whole jobs over speech corpora: preparing a source, cleaning an archive, and the table that training reads.

Filters on text stand before the audio functions, so that only what passes them is decoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwind.exprs import opaque, trimmed
from lexwind.functions import audio as A
from lexwind.functions.maths import SAMPLE_RATE
from lexwind.functions.text import clean_text
from lexwind.functions.tokens import encode_text, padded, stretch_ids
from lexwind.lineage import by_shuffle, cut
from lexwind.operators.batching import frame_batches, global_row_number, spread
from lexwind.operators.ingest import clip_status, dense_ids_by_appearance, head, join_members, prepared, usable_audio
from lexwind.sources.archives import member_contents, metadata_rows, tar_index
from lexwind.sources.corpora import archive_metadata, wav_name

#: Bytes and a rate to samples, or None.
Read = Callable[[bytes, int], object]


def prepare_corpus(
    rows: DataFrame, *, idx: str = "idx", text: str = "text", content: str = "content", lang: str | Column = "mn", speaker_id: int = 0,
    most: int | None = None, rate: int = SAMPLE_RATE, read: Read = A.decoded, model=None,
) -> DataFrame:
    """idx, audio_path, text (cleaned), speaker_id, samples of the rows of a source that pass preparation.

    Raw and cleaned texts have two characters at least, trimmed audio 1024 samples; what can't be decoded goes. Names keep
    the number of the source's row. Unite several sources with `union_sources`.
    """
    raw = head(rows.select(idx, text, content), idx, most).where(F.length(trimmed(F.col(text))) >= 2)
    cleaned = clean_text(raw, text, lang, "_cleaned").where(F.length("_cleaned") >= 2)
    made = cleaned.withColumn("samples", A.voice(F.col(content), rate, read, model))
    passed = made.where(prepared(F.col(text), F.col("_cleaned"), F.size("samples")))
    return passed.select(idx, wav_name(F.col(idx)).alias("audio_path"), F.col("_cleaned").alias("text"), F.lit(speaker_id).alias("speaker_id"), "samples")


def clean_clips(
    rows: DataFrame, members: DataFrame, *, lang: str = "mn", rate: int = SAMPLE_RATE, read: Read = A.decoded_mp3, model=None,
    contents: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All rows of an archive's metadata with what became of them: idx, client_id, speaker_id, audio_path, text, samples, status.

    rows: idx, path, sentence, client_id; members: ordinal, name, content. The status is ok, failed (no member or no audio),
    filtered or unnamed; samples are those of ok rows. Speaker ids go by first appearance among the named rows.

    Rows and members of several archives have a column archive besides; a row then finds members of its own archive alone.
    `contents` adds content to rows of found members, given their columns; without it content is a column of members.
    """
    by = ("archive",) if "archive" in rows.columns and "archive" in members.columns else ()
    kept = ["idx", "client_id", "speaker_id", "text", "path", "sentence"]
    named = F.coalesce((F.col("path") != "") & (F.length(trimmed(F.col("sentence"))) >= 2), F.lit(False))
    unnamed = rows.where(~named).withColumns({"speaker_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}).select(*kept)
    speakers = spread(dense_ids_by_appearance(rows.where(named), "client_id", "idx"), "idx")
    texts = cut(clean_text(speakers, "sentence", lang, "text").withColumn("speaker_id", F.col("speaker_id").cast("long")).select(*kept, *by))
    clip = F.contains("name", F.lit("/clips/")) & F.endswith("name", F.lit(".mp3"))
    folder = members.where(clip).groupBy(*by).agg(F.min_by(F.regexp_replace("name", "[^/]*$", ""), "ordinal").alias("_folder"))
    spoken = texts.where(F.length("text") >= 2)
    spoken = spoken.join(folder, list(by), "left") if by else spoken.crossJoin(F.broadcast(folder))  # one row
    found = cut(join_members(spoken, members.select(*by, "ordinal", "name"), "path", [F.coalesce("_folder", F.lit("clips/"))], by))
    met = found.where("ordinal is not null")
    played = contents(met.select("idx", *by, "ordinal")) if contents else met.select("idx", *by, "ordinal").join(by_shuffle(members.select(*by, "ordinal", "content")), [*by, "ordinal"])
    heard = played.select("idx", A.voice(F.col("content"), rate, read, model).alias("samples"))
    heard = heard.withColumn("_n", F.when(F.col("samples").isNotNull(), F.size("samples")))  # counted here: who needs no samples moves none
    every = found.select(*kept, "member").join(by_shuffle(heard), "idx", "left").unionByName(texts.where(F.coalesce(F.length("text") < 2, F.lit(True))).select(*kept).unionByName(unnamed), allowMissingColumns=True)
    status = clip_status(F.col("path"), F.col("sentence"), F.col("text"), F.col("member").isNotNull(), F.col("_n"), F.col("_n") / F.lit(float(rate)))
    out = every.withColumn("status", status)
    return out.select("idx", "client_id", "speaker_id", wav_name(F.col("idx"), "cv").alias("audio_path"), "text", F.when(F.col("status") == "ok", F.col("samples")).alias("samples"), "status")


def clean_archive(spark: SparkSession, path: str, *, most: int | None = None, **options) -> DataFrame:
    """clean_clips of a tar archive or several (comma-separated): each one's metadata file is chosen and parsed, and its rows find its clips.

    idx counts the rows of all archives in turn. The archives are indexed once; then only the metadata and the clips that rows
    have found are read, each from its place.
    """
    index = cut(tar_index(spark, path))
    chosen = archive_metadata(index.select("archive", "ordinal", "name"), ("archive",)).where("name is not null")
    tables = index.join(chosen, ["archive", "name"])
    rows = metadata_rows(tables.groupBy("archive", "name").agg(F.max(F.struct("ordinal", "place", "offset", "size", "packed")).alias("m")).select("archive", "m.*"))
    if tables.isEmpty():
        raise ValueError("No TSV metadata in the archive")
    rows = global_row_number(rows, "place", "line").withColumn("idx", F.col("n") - 1).drop("n", "place", "line")
    where = index.select("archive", "ordinal", "offset", "size", "packed")
    return clean_clips(head(rows, "idx", most), index, contents=lambda met: member_contents(met.join(where, ["archive", "ordinal"])), **options)


def training_samples(
    rows: DataFrame, id_: str, *, text: str = "text", lang: str | Column = "mn", content: str = "content", attributes: str | None = None,
    rate: int = SAMPLE_RATE, shortest: float = 1.0, read: Read = A.decoded, strict: bool = False,
) -> DataFrame:
    """id, text, mel (mels by frames), text_ids (stretched to the frames), mask, frames of every usable row.

    Audio that is too short, not finite or can't be decoded is left out, or an error if `strict`.
    """
    made = rows.withColumn("_samples", A.voice(F.col(content), rate, read, trim=False))
    usable = F.coalesce(usable_audio(F.col("_samples"), rate, shortest), F.lit(False))
    if strict:
        usable = F.when(usable, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("Audio is not usable in row "), F.col(id_).cast("string"))).cast("boolean"))
    made = made.where(usable).withColumn("mel", A.mel_spectrogram(F.col("_samples"), rate))
    # Features are stored before the texts are cleaned: Spark plans Python functions below the cleaning stages very slowly.
    heard = cut(made.select(id_, text, *([attributes] if attributes else []), *([] if isinstance(lang, str) else [lang.alias("_lang")]), "mel"))
    spoken = lang if isinstance(lang, str) else F.col("_lang")
    heard = clean_text(heard.withColumn("frames", F.size(F.get("mel", F.lit(0)))), text, spoken, "_cleaned")
    ids = opaque(encode_text(F.col("_cleaned"), spoken, F.col(attributes) if attributes else None))
    made = heard.withColumn("_ids", ids)
    return made.select(id_, text, "mel", stretch_ids(F.col("_ids"), F.col("frames")).alias("text_ids"), F.array_repeat(F.lit(True), F.col("frames")).alias("mask"), "frames")


def training_batches(samples: DataFrame, id_: str, *, budget: float, most: int = 0, split: str | None = None, drop_last: bool = False) -> DataFrame:
    """The samples in batches of a frame budget: batch_id, pos, id, mel, text_ids, mask (padded to the batch's longest), mel_length.

    Samples are ordered by length, so they are padded little. `split` names a column whose values are batched apart. The samples
    are stored first, since the plan of batches and the batches both read them and features are dear.
    """
    samples = cut(samples)
    by = split or "_all"
    rows = samples if split else samples.withColumn("_all", F.lit(0))
    plan = frame_batches(rows, id_, "frames", by, budget, most, drop_last)
    longest = plan.groupBy(by, "batch_id").agg(F.max("frames").cast(rows.schema["frames"].dataType).alias("_longest"))
    placed = rows.join(by_shuffle(plan.join(longest, [by, "batch_id"]).select(by, "batch_id", "pos", id_, "_longest")), [by, id_])
    out = placed.select(
        by, "batch_id", "pos", id_, F.transform("mel", lambda row: padded(row, F.col("_longest"), 0.0).cast("array<float>")).alias("mel"),
        padded(F.col("text_ids"), F.col("_longest"), -1).alias("text_ids"), padded(F.col("mask"), F.col("_longest"), False).alias("mask"), F.col("frames").alias("mel_length"))
    return out if split else out.drop("_all")

