"""From raw documents to packed sequences: the stages of a training-data pipeline.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quietwire.llm import jaccard, kneser_ney, line_dedup, mixing, packing
from quietwire.llm.common import bounded_batches, kept, short_lived_shuffles

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like the trusted ones; rejected documents go."""
    bounded_batches(spark)
    short_lived_shuffles(spark)
    return kneser_ney.accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those with nothing left go.

    ``n_chars``, where there is one, follows the text.
    """
    bounded_batches(spark)
    clashing = {c: f"__own_{c}" for c in ("lines_dropped", "lines_near") if c in docs.columns}
    out = line_dedup.without_repeats(docs.withColumnsRenamed(clashing))
    empty = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~((F.col("lines_dropped") > 0) & empty) | F.col("text").isNull())
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("lines_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*(F.col(clashing.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more)."""
    bounded_batches(spark)
    return jaccard.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    bounded_batches(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
