"""A training corpus from raw documents: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage takes what its predecessor kept, as Parquet; all but the last return the columns of documents, whatever else
these are called, and a row that repeats comes back as often unless the stage says otherwise.  Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import minhash, packing, pii, quality, toxicity
from corvane.llm.queries import tokenizer_path
from corvane.llm.scratch import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the thresholds of their language and source.

    A null, empty or short text fails the base rules and goes; a null language or source is a group of its own.
    """
    return quality.kept_documents(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the cutoff; a third of the labels is never learnt from.

    A null or empty text has the curve's value at zero.  Without labels of both classes every document has the prior as its score.
    """
    usable = F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1
    return toxicity.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles with a similarity of 0.8 or more.

    The smallest id of a group stays, once even if its row repeats.  Texts without words and rows with a null id belong to no group and stay.
    """
    return minhash.kept_documents(docs, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; null and empty texts as they are."""
    return pii.masked_documents(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and offset that each takes; a null or empty text is the end token alone."""
    pieces = packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json"))
    return packing.packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("minhash", without_copies),
    ("pii", without_personal_data),
    ("packing", into_sequences),
]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return docs
