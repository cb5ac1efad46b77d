"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept, its result written as Parquet and read again.
All but the last return the columns of documents; rows that a filter rejects are gone.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm import classifier, decontaminate, linedup, neardup, packing
from pixelframe.llm.common import documents, table
from pixelframe.session import ensure_checkpoint_dir

SIMILAR = 80  # percent of shared shingles; op8's 85 belongs to its query


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a repeated three-line window covers go from the text; n_chars follows."""
    return linedup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each near-duplicate group, linked from SIMILAR percent on, stays."""
    return neardup.one_of_each(docs, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # models, near-duplicate groups and tokens are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
