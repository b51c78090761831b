"""Readers and writers of speech corpora."""

from __future__ import annotations

import csv
import json
import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwind.sources.sinks import pretty_json


@dataclass(frozen=True)
class Preset:
    """A corpus in Parquet, one folder a split."""

    path: str
    text_column: str
    audio_column: str = "audio"
    speaker_id: int = 0
    lang: str = "mn"


def presets(root: str) -> dict[str, Preset]:
    return {
        "common_voice": Preset(f"{root}/common_voice", "sentence", speaker_id=0),
        "mbspeech": Preset(f"{root}/mbspeech", "sentence_norm", speaker_id=1),
    }


def load_split(spark: SparkSession, path: str, split: str | None = None, streaming: bool = False) -> DataFrame:
    """One split, or the union of several joined by +. As a stream, files are read as they come."""
    if split and "+" in split:
        return reduce(lambda a, b: a.unionByName(b), [load_split(spark, path, s, streaming) for s in split.split("+")])
    where = f"{path}/{split}" if split else path
    if streaming:
        return spark.readStream.schema(spark.read.parquet(where).schema).parquet(where)
    return spark.read.parquet(where)


def from_lists(spark: SparkSession, audio_paths: list[str], texts: list[str], speaker_ids: list[int] | None = None, strict: bool = False) -> DataFrame:
    """A table of parallel lists; of unequal lengths the shortest wins, or they are an error if `strict`. speaker_id only if there are any."""
    lengths = {len(x) for x in (audio_paths, texts, *([speaker_ids] if speaker_ids else []))}
    if strict and len(lengths) > 1:
        raise ValueError(f"Lists of unequal lengths: {sorted(lengths)}")
    rows = list(zip(range(len(audio_paths)), audio_paths, texts, *([speaker_ids] if speaker_ids else []), strict=False))
    return spark.createDataFrame(rows, "idx long, audio_path string, text string" + (", speaker_id int" if speaker_ids else ""))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content, undecoded."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def resolved_audio(rows: DataFrame, files: DataFrame, audio: str = "audio") -> DataFrame:
    """Adds content: the embedded bytes, else those of the file at the path, else null."""
    named = files.select(F.regexp_replace("path", "^file:", "").alias("_path"), F.col("content").alias("_content"))
    joined = rows.withColumn("_wanted", F.when(F.col(f"{audio}.bytes").isNull(), F.regexp_replace(F.col(f"{audio}.path"), "^file:", ""))).join(named, F.col("_wanted") == F.col("_path"), "left")
    return joined.withColumn("content", F.coalesce(F.col(f"{audio}.bytes"), F.col("_content"))).drop("_wanted", "_path", "_content")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Header names the columns; all are strings. path and sentence are added from their alternative names."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    for name, other in (("path", "filename"), ("sentence", "text")):
        if name not in rows.columns and other in rows.columns:
            rows = rows.withColumn(name, F.col(other))
    return rows


def member_rows(member: DataFrame) -> DataFrame:
    """idx, path, sentence, client_id of a member (one row with content) that is a TSV file with a header; null where it has no such column.

    path and sentence may go by the names filename and text. Lines end as in any text file; blank ones don't count.
    """
    text = F.decode("content", "UTF-8")
    lines = member.select(F.filter(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: x != "").alias("lines"))
    header = (lines.select(F.get("lines", F.lit(0))).first() or [None])[0] or ""
    columns = next(csv.reader([header], delimiter="\t"), [])
    schema = ", ".join(f"c{i} string" for i in range(max(1, len(columns))))
    rows = lines.select(F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("idx", "line"))
    rows = rows.select(F.col("idx").cast("long").alias("idx"), F.from_csv("line", schema, {"sep": "\t"}).alias("r"))

    def column(*names: str) -> Column:
        return next((F.col(f"r.c{columns.index(n)}") for n in names if n in columns), F.lit(None).cast("string"))

    return rows.select("idx", column("path", "filename").alias("path"), column("sentence", "text").alias("sentence"), column("client_id").alias("client_id"))


def attribute_list(value: Column) -> Column:
    """Attribute tokens of JSON text: a list, or one string; anything else is empty."""
    listed = F.from_json(value, "array<string>")
    single = F.when(value.rlike(r"^\s*[^\[{]"), F.array(F.regexp_replace(value, '^"|"$', "")))
    return F.coalesce(F.when(value.rlike(r"^\s*\["), listed), single, F.array().cast("array<string>"))


def read_metadata(spark: SparkSession, path: str, lang: str = "mn") -> DataFrame:
    """audio_path, text, speaker_id, lang (with a default) and attr_tokens (array) of a JSON array of records."""
    schema = "audio_path string, text string, speaker_id int, lang string, attr_tokens string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumns({"lang": F.coalesce("lang", F.lit(lang)), "attr_tokens": attribute_list(F.col("attr_tokens"))})


def write_metadata(df: DataFrame, path: str) -> None:
    """Records as JSON lines, in as many files as the table has partitions; non-ASCII text stays as it is."""
    df.write.mode("overwrite").json(path)


def metadata_document(df: DataFrame, order: str) -> DataFrame:
    """One row with all records as one indented JSON array; for small exports, as it gathers the table. `write_json_array` has no such bound."""
    pretty = pretty_json([c for c in df.columns if c != order])
    gathered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), pretty.alias("j")))), lambda x: x["j"])
    return df.agg(F.concat(F.lit("[\n"), F.array_join(gathered, ",\n"), F.lit("\n]")).alias("json"))


def wav_name(index: Column, prefix: str = "sample") -> Column:
    """Names keep the source row's number, so gaps stay where rows were dropped."""
    return F.format_string(f"{prefix}_%06d.wav", index)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_checkpoint(df: DataFrame, path: str) -> None:
    """Append registry rows, a folder a step."""
    df.write.mode("append").partitionBy("step").parquet(path)


def load_config(path: str) -> dict | None:
    """JSON, or YAML where a reader is installed; None if there is no such file."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def first_setting(*values: str | None, names: tuple[str, ...] = ()) -> str | None:
    """The first non-empty of the values, then of the named environment variables."""
    return next((v for v in (*values, *(os.environ.get(n) for n in names)) if v), None)


def archive_metadata(members: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """name: the last validated.tsv or train.tsv before the first clip, else the first other .tsv; one row, or one for each of `by`."""
    name = F.col("name")
    clip = F.contains(name, F.lit("/clips/")) & F.endswith(name, F.lit(".mp3"))
    first_clip = members.groupBy(*by).agg(F.min(F.when(clip, F.col("ordinal"))).alias("clip"))
    chosen = F.endswith(name, F.lit("validated.tsv")) | F.endswith(name, F.lit("train.tsv"))
    other = F.endswith(name, F.lit(".tsv")) & ~F.contains(F.lower(name), F.lit("validated"))
    tables = members.where(F.endswith(name, F.lit(".tsv")))  # few, so the join below is small
    placed = tables.join(first_clip, list(by)) if by else tables.crossJoin(F.broadcast(first_clip))
    seen = chosen & (F.col("clip").isNull() | (F.col("ordinal") < F.col("clip")))
    return placed.groupBy(*by).agg(F.coalesce(F.max_by(F.when(seen, name), F.when(seen, F.col("ordinal"))), F.min_by(F.when(other, name), F.when(other, F.col("ordinal")))).alias("name"))
