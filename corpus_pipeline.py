"""The corpus pipeline: documents in, token ids of clean, distinct documents out.

Stages, each on all rows that its predecessor kept, written as Parquet between:

1. ``quality``: documents that the classifier finds of low quality or toxic (or without text) go;
2. ``near_duplicates``: of each group of documents joined at the Jaccard threshold the lowest doc_id stays;
3. ``decontaminate``: documents that leak a benchmark item go;
4. ``redact_secrets``: secrets in a text are replaced by their kind; n_chars follows;
5. ``encode``: byte-level BPE, with a decoding round trip.

All but the last return the columns of ``documents`` that they were given; extra columns, whatever their names, pass through.

Defined results: null and empty texts go in stage 1, so that no later stage meets one; a text without a word is classified like others
and is no near duplicate, but of equal ones of one doc_id one stays; a document without a doc_id is
classified, scanned, redacted and encoded like any other, and is no near duplicate of another, but of equal rows without one
(the same set of grams) one stays; of repeated rows of one doc_id that have the same set of grams one stays, of those with different texts
that are near duplicates of nothing lower all stay; ties go to the lowest doc_id; texts of any length are used whole; an empty table
of documents gives an empty result, an empty ``labels`` rejects nothing with words, an empty ``benchmark`` nothing at all.

A stage's folder under the shared checkpoint folder is removed when the next but one has been written; the last one's input stays, for
the result reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import bpe, decontamination, jaccard, quality, secret_scan
from wordloom.llm._spark import ensure_checkpoint_dir, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled rows of ``docs``; keep what is not rejected."""
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = docs.withColumn("text", secret_scan.redacted(docs["text"]))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact_secrets", redact_secrets), ("encode", encode)]

#: the stages' models are not SQL; tests/llm/test_pipeline.py holds run() against the operators' brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what is between them lies in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            _remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
