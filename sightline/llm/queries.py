"""Queries of the training-data operators over the test tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread

from .bpe import bpe_encode
from .common import table
from .compression_quality import fold, quality_scores, train
from .conversations import conversation_digests, repair_conversations
from .decontaminate import find_leaks
from .license_scan import license_scan
from .oracles import ORACLES
from .pii import KINDS, base_digest, count_kind, pii_spans
from .log_bilinear import held_out, lm_scores
from .near_duplicates import near_duplicates
from .perplexity import perplexity_quality, rule_counts
from .repeats import repeated_spans
from .secrets import KINDS as SECRET_KINDS
from .secrets import joined, secret_spans
from .snapshot_diff import snapshot_diff
from .token_counts import token_counts


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections").withColumnRenamed("id", "doc_id")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("first")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [count_kind("base", k).alias(f"n_{k}") for k in KINDS]
    found = pii_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(base_digest("base"), 256).alias("base_sha256"), base_digest("spans").alias("spans"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold(F.col("doc_id")) != 1))
    return quality_scores(docs, model).select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("lang")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", *[count_kind("base", k).alias(f"n_{k}") for k in SECRET_KINDS[:3]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def damaged(talks: DataFrame) -> DataFrame:
    """The conversations that op11 repairs: crc32 of `conv_id:turn` modulo 20 says what happened to a row; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    m = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = talks.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), m.alias("m"))
    return rows.where("m <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("m") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("m") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    reports, edits = repair_conversations(damaged(talks))
    digests = conversation_digests(edits)
    every = talks.select("conv_id").distinct()
    found = every.join(reports, every["conv_id"].eqNullSafe(reports["conv"]), "left").drop("conv").join(digests, every["conv_id"].eqNullSafe(digests["conv"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scores(docs, held_out(docs["doc_id"])).withColumnsRenamed({"id": "doc_id", "held": "held_out"})


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The later snapshot that op13 compares with: crc32 of the decimal doc_id modulo 10 says what happened to a row."""
    docs = docs.select("doc_id", "text", "lang", "source", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(9)).alias("m"))
    keys = F.when(F.col("m").isin(3, 4), F.array(-1 - F.col("doc_id"))).when(F.col("m") == 5, F.array("doc_id", -1 - F.col("doc_id"))).otherwise(F.array("doc_id"))
    return docs.where("m <> 0").select(
        F.explode(keys).alias("doc_id"),
        F.when(F.col("m") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("m") == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("m") == 2, F.col("lang")).when(F.col("m") != 4, F.col("source")).alias("source"),
    )


def op13_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return snapshot_diff(docs, later_snapshot(docs), "doc_id", ["text", "lang", "source"])


def base_op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii(spark, sf_dir).drop("spans")


def base_op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def base_op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_lm_scores(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


def base_op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_secrets(spark, sf_dir).drop("spans")


QUERIES = {"op1_license_scan": op1_license_scan, "op2_near_duplicates": op2_near_duplicates, "op3_pii": op3_pii, "op4_repeats": op4_repeats, "op5_bpe": op5_bpe, "op6_quality": op6_quality, "op7_token_counts": op7_token_counts, "op8_perplexity": op8_perplexity, "op9_secrets": op9_secrets, "op10_decontaminate": op10_decontaminate, "op11_conversation_repair": op11_conversation_repair, "op12_lm_scores": op12_lm_scores, "op13_snapshot_diff": op13_snapshot_diff}
#: The operators' queries without the columns that SQL cannot express.
QUERIES |= {"base_op1_license": base_op1_license, "base_op3_pii": base_op3_pii, "base_op8_rules": base_op8_rules, "base_op9_secrets": base_op9_secrets, "base_op12_lm": base_op12_lm}

__all__ = ["QUERIES", "ORACLES"]
