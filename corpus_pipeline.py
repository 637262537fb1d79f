"""From raw documents to packed token sequences, stage by stage.

Each stage takes the documents its predecessor kept, written as Parquet in between, and calls one
operator of ``strataflow.llm``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import language, mixing, packing, pii, simhash
from strataflow.llm.common import shared_folder, ship
from strataflow.llm.queries import tokenizer_path

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those no learned language explains better than the rest together."""
    ship(spark)
    model = language.train(docs.filter(~language.held_out()))
    named = language.identify(docs, model)
    return named.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= 0.5)).select(*DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component: that of smallest id, nulls last, then of smallest text hash."""
    ship(spark)
    chosen = simhash.representatives(docs)
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(chosen["doc_id"]) & (hashed["_hash"] == chosen["text_hash"])
    # Only rows of equal id and text are still there more than once.
    return hashed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "_hash"]).select(*DOCUMENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in angle brackets in place of each span of personal data; no document is dropped."""
    ship(spark)
    masked = pii.find_and_mask(docs.select(*DOCUMENT), pii.train(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The production mix: a document appears once for each pass that takes words of it."""
    ship(spark)
    return mixing.mixed_documents(docs.select(*DOCUMENT))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids and places in sequences: the sequences can be built from these alone."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained models and fingerprints are beyond SQL: the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
