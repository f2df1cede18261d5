"""A corpus pipeline: documents in, sampled token sequences out.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept;
what it returns is written as Parquet and read again by the next one.  All stages but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import exact, mixing, odd_sketch, pieces, toxicity
from textwarden.llm.queries import VOCABULARY_PATH, id_remainder
from textwarden.llm.workers import reachable
from textwarden.operators.staging import shared_folder

#: Near duplicates share 0.8 of their five-word shingles.
NEAR = odd_sketch.Settings(words=5, least=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored toxic."""
    labels = reachable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every text; half of them is the history that is indexed."""
    reachable(spark)
    return exact.keep_first(docs, id_remainder("doc_id", 2) == 0)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    reachable(spark)
    return odd_sketch.keep_one(docs, NEAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words in the shares of their sources; a row for each pass over a document."""
    taken = mixing.mix_documents(docs)
    return taken.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every text."""
    reachable(spark)
    return pieces.encode(docs, pieces.read_vocabulary(VOCABULARY_PATH)).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", clean),
    ("exact dedup", distinct),
    ("near dedup", unlike),
    ("source mixing", mixed),
    ("sentence pieces", segmented),
]
#: SQL has no words for the model, the noise and the draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, with Parquet in the shared folder between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
