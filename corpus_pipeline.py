"""Training-data pipeline over ``documents``: each stage's rows are written and read by the next.

Stages: the quality classifier rejects documents, repeated lines go, one document of each group of near
duplicates stays, documents are repeated until languages meet their target shares, and texts are
segmented into pieces. Documents without an id pass all stages that compare ids. Languages are the
sources mixed here, as the texts tell them apart; none is used at a rate below 1, so no document that
reaches the mixing is lost by it.

A stage sets the session's bytes of an Arrow batch to those of one block of texts: Spark's default lets a
batch grow to 64 MB, in the JVM and in the Python worker, and executors keep what earlier stages took.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import line_dedup, mixing, near_dup, resampling, segmentation
from reviewmill.llm.joins import without_ids
from reviewmill.llm.queries import MODEL
from reviewmill.llm.words import BLOCK_BYTES
from reviewmill.scale import ensure_checkpoint_dir


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, whose texts go to Python workers in batches of about ``BLOCK_BYTES``; the rows are the same."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0")
    drawn = resampling.resample(docs, good)
    return without_ids(docs, drawn.where("NOT kept").select("doc_id"), "doc_id")


@in_small_batches
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = line_dedup.dropped_lines(docs)
    left = line_dedup.without_lines(docs, line_dedup.by_document(dropped))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.first_of_each(docs, near_dup.classes(docs))


@in_small_batches
def mixed_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return mixing.copies(docs, mixing.mix(docs, labelled, least=1.0))


@in_small_batches
def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Executors still hold what earlier stages took, so less is kept here than by the query alone.
    return segmentation.encode(docs, MODEL, k=2, kept=segmentation.KEPT // 4, returned=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("minhash_near_dedup", near_duplicates),
    ("mixing", mixed_languages),
    ("segmentation", segmentations),
]

# Classifier scores, sketches and lattices are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages write lies in the shared folder of checkpoints."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
