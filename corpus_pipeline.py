"""From raw documents to packed sequences: five stages, each on all rows that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from graphloom.llm import langid, line_dedup, mixing, packing, simhash
from graphloom.session import cut_few, stored
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Null texts and texts without a letter go."""
    return langid.accepted(docs, langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without line chunks that occurred before; documents that lose all their words go."""
    found = line_dedup.dedup_lines(docs)
    return found.where((F.col("n_removed_lines") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts alike by 0.8 in five-word shingles; documents without
    id stay."""
    found = simhash.similar_groups(docs)
    gone = found.where("id <> component").select(F.col("id").alias("_nd_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_nd_id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target has them; those that the mix leaves out go."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), keep=cut_few)


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, fingerprints and tokenizers have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``; each stage's rows are stored before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
