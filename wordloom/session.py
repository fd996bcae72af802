"""Where intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where none is named: in local mode, where there is one machine, a new temporary folder; on a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="wordloom-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once, its lineage cut; it survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, rows: int = 0) -> DataFrame:
    """``df`` written once as Parquet beside the checkpoints and read back; files of ``rows`` rows at most, if not 0."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
