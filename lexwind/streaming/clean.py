"""The stateless text operators over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwind.functions.text import basic_clean, clean_text
from lexwind.functions.tokens import encode_text


def clean_stream(spark: SparkSession, folder: str, schema: str, text: str = "text", lang: str = "mn", whole: bool = True) -> DataFrame:
    """Adds cleaned and ids to rows of Parquet files as they arrive; no state, so no watermark is needed.

    The cleaning is the whole one, abbreviations and numbers included, unless `whole` is false.
    """
    rows = spark.readStream.schema(schema).parquet(folder)
    cleaned = clean_text(rows, text, lang, "cleaned") if whole else rows.withColumn("cleaned", basic_clean(F.col(text)))
    return cleaned.withColumn("ids", encode_text(F.col("cleaned"), lang))


def first_rows(stream: DataFrame, n: int, name: str) -> DataFrame:
    """The first rows of a bounded stream, by way of a memory table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).limit(n)
