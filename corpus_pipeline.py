"""A training corpus in five stages, each one operator over all that the stage before it kept.

run(spark, sf_dir) applies STAGES to the table documents. Every stage's result is written as Parquet to the shared folder and
read again, so a lost executor costs no more than one stage's lost tasks. A stage's input and what it stored on the way are
deleted once its result is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwind.lineage import delete_folder, ensure_checkpoint_dir, passing_cuts
from lexwind.llm.mixing import materialise, mix_rows
from lexwind.llm.packing import pack_documents
from lexwind.llm.quality import keep_usual
from lexwind.llm.queries import tokenizer_path
from lexwind.llm.secrets import redact
from lexwind.llm.simhash import keep_representatives

# What holds for all stages: documents come with nulls in any column, empty and very long texts, ties, repeated rows and
# rows that share an id. No stage fails on them, an empty table passes through all of them, and extra columns are kept
# up to the last stage, which returns pieces.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the base rules or the outlier test reject go, among them those without a text."""
    return keep_usual(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near-duplicates the document with the smallest id stays, one for each group.

    Links are all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: those within 3 bits are
    compared first, the others are found by an exact join. Nothing else goes, however near its fingerprint is.
    """
    return keep_representatives(docs, similarity=0.8, shingle=5, verify=True)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: found spans are replaced by their kinds; n_chars follows. Texts without one stay as they are."""
    return redact(docs, chars_col="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every document comes as often as the mix takes it. Documents without words are not taken."""
    return materialise(docs, mix_rows(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the training sequences' pieces, with their token ids. A null text is the end id alone."""
    return pack_documents(docs, tokenizer_path()).drop("cost")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: SQL can't express the robust estimates, the near-duplicate components or the tokens; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with passing_cuts(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if read:
            delete_folder(spark, read)
        read = f"{folder}/{name}"
        docs = spark.read.parquet(read)
    return docs.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
