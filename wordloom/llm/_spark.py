"""Session helpers of the operators: where to keep tables, and broadcasts of checked size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of an Arrow batch, unless the session says otherwise: 10,000 texts at once, in the JVM and in Python, are a large part of a small executor
BATCH_ROWS = 2_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """BATCH_ROWS rows a batch where the session has Spark's default."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir.  Where none is named: in local mode, where there is one machine, a new temporary folder; on a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="wordloom-")
        sc.setCheckpointDir(named)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if a kept ``df`` has at most ``rows`` narrow rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def text_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the columns an operator needs, under its own names, whatever else ``docs`` holds."""
    small_batches(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
