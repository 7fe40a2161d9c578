"""From raw documents to packed training sequences, in five stages of the training-data operators.

Each stage takes what its predecessor kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import mixing, packing, quality, simhash, substrings
from earshot.llm.common import shared_folder, shuffle_width


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least 0.3."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of similar texts: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 13 or more words that an earlier document holds; n_chars follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = substrings.remove_repeats(docs, length=13, rejoin=False, carry=others or None)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*(columns.get(c, F.col(f"rest.{c}")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies that temper the sources' shares to the power 0.7, in a global random order."""
    copies = mixing.replicate(docs, temperature=0.7, epochs=1.0)
    return mixing.shuffled(copies, shuffle_width(spark)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens, every source at its share in each."""
    return packing.pack(docs, window=4096)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("near-duplicate removal", drop_near_copies),
    ("substring deduplication", remove_repeated_passages),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the classifier nor the tokenizer; the tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of documents.parquet; each stage is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
