"""The operators of this subpackage on the given tables, with fixed result columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rota.llm import (
    chat, collocations, credentials, decontam, hamming, hilbert, licenses, packing, privacy, quality, simhash, spans,
    substrings, whitening,
)
from rota.llm.frames import ID
from rota.sources.tables import read_table

VOCABULARY = {"path": public_tokenizers.path("byte_bpe_50k.json"),
              "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
              "pattern": public_tokenizers.PATTERN}
DIMS, NEAREST, QUERY_STEP = 64, 10, 100


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(read_table(spark, sf_dir, "documents"), shards=8)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col(ID).alias("doc_id"),
                       F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.dedup_substrings(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read_table(spark, sf_dir, "documents"),
                                   read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"),
                        F.coalesce(F.array_max("hits.coverage"), F.lit(0.0)).alias("coverage"),
                        F.col("hits.item_id").alias("item_ids"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan_secrets(read_table(spark, sf_dir, "documents"))
    return _span_digest(found, credentials.BASE)


def _span_digest(found: DataFrame, kinds) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col(ID).alias("doc_id"), *[count(k).alias(f"n_{k}") for k in kinds],
                        F.sha2(spans.spans_text(F.col("base")), 256).alias("base_sha256"),
                        spans.spans_text(F.col("spans")).alias("spans"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding"), DIMS).alias("code"))
    found = hamming.top_k(codes.where(F.col("id") % QUERY_STEP == 0), codes, NEAREST, DIMS)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(read_table(spark, sf_dir, "documents"),
                                   read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(read_table(spark, sf_dir, "documents"), VOCABULARY))


def op10_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.scan_private(read_table(spark, sf_dir, "documents"))
    return _span_digest(found, ("email", "ip", "card", "phone"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # The contract's own conversation, whose texts look like markers.
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_digests(chat.format_chats(turns.unionByName(probe)))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and loss flags say."""
    rows = formatted.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "trained", chat.loss_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"),
                       F.length("trained").cast("long").alias("loss_chars"),
                       F.sha2(F.col("trained"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"),
                       "valid", "refused_at")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_hilbert_shards, op2_simhash, op3_substrings, op4_decontaminate, op5_secrets,
        op6_licenses, op7_hamming_top_k, op8_quality, op9_packing, op10_privacy,
        op11_collocations, op12_chat_format, op13_whitening)}
