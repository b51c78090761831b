"""A dictionary of dense numbers that is kept from run to run.

Each run adds a version: a folder with the keys that were new, numbered on from the last version. A version is written under a
hidden name and renamed when it is whole, so a run that dies leaves the dictionary as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwind.lineage import cut, delete_folder, file_names, rename_folder
from lexwind.operators.batching import global_row_number

SCHEMA = "key string, id long"


def versions(spark: SparkSession, path: str) -> list[str]:
    return sorted(n for n in file_names(spark, path) if n.startswith("version-"))


def read_dictionary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """key and id of all versions, or of those up to `version` (from 1)."""
    held = versions(spark, path)[:version]
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/{n}" for n in held]) if held else spark.createDataFrame([], SCHEMA)


def extend_dictionary(rows: DataFrame, path: str, key: str, order: str, out: str = "speaker_id", missing: str = "unknown") -> DataFrame:
    """The rows with their key's number; keys that the dictionary lacks get the next numbers in order of first appearance.

    Null keys count as one key. New keys are found by an anti-join and numbered by ranges; only the count of the known ones
    comes to the driver. Two runs at once can't both add the same version: the later one is an error and changes nothing.
    """
    spark = rows.sparkSession
    known = read_dictionary(spark, path)
    named = rows.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit(missing)))
    first = named.groupBy(F.col("_key").alias("key")).agg(F.min(order).alias("_first")).join(known, "key", "left_anti")
    base, number = known.count(), len(versions(spark, path)) + 1
    new = cut(global_row_number(first, "_first").select("key", (F.col("n") - 1 + base).alias("id")))
    if not new.isEmpty():
        hidden = f"{path}/_hidden-{uuid.uuid4().hex}"
        new.write.parquet(hidden)
        if not rename_folder(spark, hidden, f"{path}/version-{number:08d}"):
            delete_folder(spark, hidden)
            raise RuntimeError(f"Another run has added version {number} of {path}")
    everything = read_dictionary(spark, path).select(F.col("key").alias("_key"), F.col("id").alias(out))
    return named.join(everything, "_key").drop("_key")
