"""A training corpus from the documents: filter by quality, drop repeated lines and near copies,
take out secrets, and pack what is left into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import batches, jaccard, line_dedup, packing, quality, secret_scan
from quire.session import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, gives to quality 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(docs, quality.fit(docs, labels))
    return scored.where("predicted = 1").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three documents hold, but for the last of them."""
    kept = line_dedup.drop_repeated_lines(docs)
    return _counted(kept).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar ones: five-word shingles,
    similarity 0.8 or more."""
    found = jaccard.similar_documents(docs, words=5, share=(80, 100))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        batches.known("doc_id").alias("_gone")
    )
    return docs.join(gone, batches.known("doc_id") == F.col("_gone"), "left_anti").select(docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a note in place of each secret."""
    return _counted(secret_scan.find_secrets(docs, redacted="text")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and where they are in sequences of 1,024 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.token_pieces(docs, path))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", remove_secrets),
    ("packing", pack_sequences),
]

#: The stages have no common SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = batches.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, counts the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long"))
