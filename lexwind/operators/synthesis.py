"""Planning of synthesis requests: chunks, durations, seeds, frames and sample offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexwind.functions.maths import HOP, SAMPLE_RATE, chunk_weight, target_frames
from lexwind.functions.text import clean_text, foreign_letters, split_chunks
from lexwind.functions.tokens import encode_text


def synthesis_plan(
    requests: DataFrame, request: str, text: str, *, most_chars: int = 120, pause: float = 0.25, duration: str | None = None, seed: str | None = None, speed: str | None = None,
    lang: str | None = None, reference_text: str | None = None, reference_frames: str | None = None,
) -> DataFrame:
    """One row per chunk: request, idx, chunk, weight, duration (its share, or null), seed, frames, samples, sample_offset.

    Chunks share an explicit duration by weight. Without one their frames follow from a reference voice, its frames times the
    chunk's tokens over those of its text, or else from their characters. A pause of int(rate * pause) samples lies between
    chunks. With `lang` also tokens (of the cleaned chunk, language tag included) and foreign (letters that the language lacks).
    """
    if reference_text and not lang:
        raise ValueError("Tokens of a reference need a language")
    rows = requests.select(request, text, *[F.col(c) for c in (duration, seed, speed, reference_text, reference_frames) if c])
    if reference_text:
        rows = clean_text(rows, reference_text, lang, "_reference").withColumn("_reference", F.size(encode_text(F.col("_reference"), lang)))
    chunks = rows.select(*[c for c in rows.columns if c != text], F.posexplode(split_chunks(F.col(text), most_chars)).alias("idx", "chunk")).withColumn("weight", chunk_weight(F.col("chunk")))
    whole, before = Window.partitionBy(request), Window.partitionBy(request).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    share = F.col(duration) * F.col("weight") / F.sum("weight").over(whole) if duration else F.lit(None).cast("double")
    chunks = chunks.withColumn("share", share).withColumn("chunk_seed", (F.col(seed) + F.col("idx")) if seed else F.lit(None).cast("long"))
    if lang:
        chunks = clean_text(chunks, "chunk", lang, "_cleaned").withColumns({"tokens": F.size(encode_text(F.col("_cleaned"), lang)), "foreign": foreign_letters(F.col("chunk"), lang)})
    tokens = F.col("tokens") if lang else F.col("weight")
    voice = {"reference_tokens": F.col("_reference"), "reference_frames": F.col(reference_frames)} if reference_text else {}
    chunks = chunks.withColumn("frames", target_frames(tokens, chars=F.col("weight"), duration=F.col("share"), speed=F.col(speed) if speed else None, **voice))
    gap = max(0, int(SAMPLE_RATE * pause))
    chunks = chunks.withColumn("samples", F.col("frames") * HOP)
    offset = F.coalesce(F.sum(F.col("samples") + gap).over(before), F.lit(0))
    more = ["tokens", "foreign"] if lang else []
    return chunks.select(request, "idx", "chunk", "weight", F.col("share").alias("duration"), F.col("chunk_seed").alias("seed"), "frames", "samples", offset.alias("sample_offset"), *more)
