"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwind.llm import oracle
from lexwind.llm.alignment import align_documents
from lexwind.llm.chat import format_chat, read_back
from lexwind.llm.chunks import encode_documents
from lexwind.llm.langid import fit, identify
from lexwind.llm.mixing import mix_documents
from lexwind.llm.negatives import hard_negatives
from lexwind.llm.packing import pack_documents
from lexwind.llm.quality import robust_outliers
from lexwind.llm.secrets import scan_secrets, written
from lexwind.llm.sharding import kd_shards
from lexwind.llm.simhash import near_duplicates
from lexwind.llm.topk import top_k
from lexwind.llm.urls import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = robust_outliers(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


#: The rules of the URL query: verdict and host with path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op3_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs of all pages that were fetched without encryption."""
    pages = table(spark, sf_dir, "pages")
    judged = filter_urls(pages, pages.select("url").where(F.startswith("url", F.lit("http://"))), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_duplicates(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    back = read_back(format_chat(turns.unionByName(more)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op6_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op8_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labelled = identify(docs, fit(docs, ~held_out))
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(table(spark, sf_dir, "documents"), levels=4)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_documents(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op11_sorted_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


def op12_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return made.select("doc_id", "n_tokens", *[F.lower(F.hex(c)).alias(c) for c in ("ids_sha256", "decoded_sha256")])


def op13_aligned_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    digest = F.coalesce(F.lower(F.hex("groups_sha256")), F.lit("")).alias("groups_sha256")
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_cost_balanced_packing, op2_robust_outliers, op3_blocked_bloom_urls, op4_pigeonring_simhash, op5_budgeted_chat_windows,
    op6_maxscore_top_k, op7_linked_secrets, op8_viterbi_language, op9_kd_tree_shards, op10_pivotal_mixing,
    op11_sorted_hard_negatives, op12_chunked_bpe, op13_aligned_tokenizers, pipeline,
)}

#: DuckDB SQL where SQL can express the whole result. The others are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op3_blocked_bloom_urls": oracle.URLS,
    "op5_budgeted_chat_windows": oracle.CHAT,
    "op6_maxscore_top_k": oracle.TOP_K,
    "op7_linked_secrets": oracle.SECRETS,
    "op11_sorted_hard_negatives": oracle.HARD_NEGATIVES,
}
