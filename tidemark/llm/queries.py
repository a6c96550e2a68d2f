"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontaminate, line_dedup, lm_score, minhash, periodic_runs, phrases, quality, sharding, suffix_dedup, token_counts, token_files
from tidemark.llm.common import table
from tidemark.session import new_table_path

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, folder, "benchmark").select("item_id", "text"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), RANKS, PATTERN)


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score_documents(table(spark, folder, "documents").select("doc_id", "text"))


def op5_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), shingle=4)


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat token files of all documents, searched for end ids; ``doc_id`` labels the n-th document of a file."""
    path = new_table_path(spark, "flat-tokens")
    token_counts.flat_files(table(spark, folder, "documents").select("doc_id", "text"), RANKS, PATTERN, path)
    files = spark.read.parquet(path)
    counts = token_counts.count_tokens(files)
    return counts.join(token_counts.labels(files), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_chats(turns.unionByName(chat.planted_conversation(spark)))
    read = formatted.select(
        "conv_id", chat.read_back(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").alias("chars"),
    )
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table_path(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents").select("doc_id", "text"), TOKENIZER, path)
    sums = token_files.checksums(spark, path)
    index = token_files.read_index(spark, path)
    return index.join(sums, ["part", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of every language of all documents."""
    mined = phrases.mine_phrases(table(spark, folder, "documents").select("lang", "text"))
    return phrases.top_phrases(mined).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of all documents, a tenth of them made periodic first."""
    docs = periodic_runs.plant_runs(table(spark, folder, "documents"))
    found = periodic_runs.find_runs(docs).withColumn("longest", periodic_runs.longest_run(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.expr("longest.length * 1000 div longest.period").alias("exponent_milli"),
        F.sha2(periodic_runs.run_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of equal weight, and where a 41st would leave them."""
    rows = sharding.manifest(table(spark, folder, "documents").select("doc_id", "text"), 40, 41)
    moved = rows.withColumn("law", F.lit("key"))
    return moved.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontaminate, op2_byte_bpe, op3_quality_rules, op4_lm_score, op5_minhash_dedup, op6_line_dedup, op7_token_counts, op8_chat_format, op9_token_files,
        op10_suffix_dedup, op11_phrases, op12_periodic_runs, op13_sharding,
    )
}
