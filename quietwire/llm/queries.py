"""Registered queries of the training-data operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quietwire.llm import chat, crosstok, jaccard, kneser_ney, line_dedup, merkle, mixing, packing, pii, spotsigs
from quietwire.llm import suffix_tree, topk, toxicity
from quietwire.llm.common import bounded_batches, short_lived_shuffles


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, folder, "documents"), words=4, percent=85)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "n_links")


def op2_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    short_lived_shuffles(spark)
    found = kneser_ney.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.drop("word_bits", "word_least", "word_most")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = toxicity.train(documents, table(spark, folder, "labels"), ~held_out)
    return toxicity.score(documents, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        "offending",
    )


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.without_repeats(table(spark, folder, "documents")).select(
        "doc_id", "lines_dropped", "lines_near", F.sha2("text", 256).alias("kept_sha256")
    )


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    pieces = packing.token_pieces(documents, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op8_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    bounded_batches(spark)
    short_lived_shuffles(spark)
    return suffix_tree.score_texts(table(spark, folder, "documents"), held_out)


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, folder, "documents"))


def op10_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], given.schema)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat.digest_chats(chat.format_chats(given.unionByName(own), ranks, pattern), ranks, pattern)


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return crosstok.align_documents(table(spark, folder, "documents"), a, b)


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, folder, "documents").select("doc_id", "text")))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_line_dedup": op5_line_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_mixing": op7_mixing,
        "op8_suffix_tree": op8_suffix_tree,
        "op9_fingerprints": op9_fingerprints,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_token_alignment": op11_token_alignment,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_pii": op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_top_k": topk.TOP_K_SQL,
        "op7_mixing": mixing.MIXING_SQL,
        "op12_merkle_manifest": merkle.MANIFEST_SQL,
        "op13_pii": pii.PII_SQL,
    }
