"""A training-data pipeline over `documents`: five stages, each one of the corpus operators.

Every stage but the last returns rows with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import exact_dedup, mixing, packing, quality, simhash
from palisade.llm.common import documents, stored

#: Bytes of texts that a task hands to Python at once: the JVM holds such a batch in native memory, the worker as Arrow and as Python objects.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own; the rows in a batch change no result."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the quality classifier on the labelled rows of docs and drop the rows that it rejects.

    Null and empty texts are scored as texts of no words; equal texts go or stay together.
    """
    _small_batches(spark)
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, up to white space, the one with the smallest doc_id stays; null texts count as empty, a null doc_id as the largest."""
    _small_batches(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose fingerprints are linked, the one with the smallest doc_id stays; texts without words are one group."""
    _small_batches(spark)
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes twice or three times stand there as often; texts without words are left out, a null source is one of its own."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; null texts are packed as empty ones, each row by itself."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
