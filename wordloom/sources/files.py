"""Text sources by line, and tables kept as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: magic numbers and version of the model tables
BIGRAM_MAGIC, TRIGRAM_MAGIC, VERSION = 0x4247524D, 0x54524743, 1
CONTEXT = {"bigram": ["prev_id"], "trigram": ["w1", "w2"]}
PHRASE = T.StructType([T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


def wordlist(spark: SparkSession, path: str) -> DataFrame:
    """The lines (``line``) of a combined word list, gzip or plain."""
    return spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line): the lines with their number from 0, blank ones counted; of several files in the order of their names.

    A block's rows are read in order by one task, so a line's number is its place in its block and the lines of the
    blocks before; no sort and no single task.  A row for each block comes to the driver.
    """
    rows = spark.read.text(path, lineSep="\n").select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    blocks = rows.groupBy("file_path", "file_block_start").agg(F.min("at").alias("least"), F.count("*").alias("n")).collect()
    begin, total = [], 0
    for r in sorted(blocks):
        begin.append((r["file_path"], r["file_block_start"], total - r["least"]))
        total += r["n"]
    own = spark.createDataFrame(begin, "file_path string, file_block_start long, shift long")
    return rows.join(F.broadcast(own), ["file_path", "file_block_start"]).select((F.col("at") + F.col("shift")).alias("line_no"), "line")


def corpus(spark: SparkSession, path: str, limit_millions: int | None = None, partitions: int | None = None) -> DataFrame:
    """(doc_id, text) with a row for each line; ``limit_millions`` takes the first so many million lines.  A gzip file is one task, so its lines are spread at once."""
    if limit_millions is None:
        df = spark.read.text(path, lineSep="\n").select(F.monotonically_increasing_id().alias("doc_id"), F.regexp_replace("value", "\r$", "").alias("text"))
    else:
        df = numbered_lines(spark, path).toDF("doc_id", "text").filter(F.col("doc_id") < limit_millions * 1_000_000)
    return df.repartition(partitions) if partitions else df


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """(word, word_id, prob, flags, packed) in order of words, as Parquet, and the vocabulary beside it."""
    lexicon.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/words")
    own = lexicon.sparkSession.read.parquet(f"{path}/words")
    own.repartitionByRange("word_id").sortWithinPartitions("word_id").select("word").write.mode("overwrite").text(f"{path}/vocab", lineSep="\n")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/words")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word_id, word) of a vocabulary: a word's id is the number of its line."""
    return numbered_lines(spark, path).toDF("word_id", "word")


def _last(parts: Column, key: str) -> Column:
    own = F.filter(parts, lambda p: p.startswith(f"{key}="))
    return F.when(F.size(own) > 0, F.substring(F.element_at(own, -1), len(key) + 2, 2_000_000_000))


def parse_combined(lines: DataFrame) -> DataFrame:
    """(word, prob) of each word line; of repeated keys the last counts, of what is no 16-bit number 0, and 255 is the most."""
    parts = F.filter(F.split("l", ","), lambda p: p.contains("="))
    rows = lines.select(F.trim("line").alias("l")).filter(F.col("l").startswith("word=")).select(_last(parts, "word").alias("word"), _last(parts, "f").alias("f"))
    n = F.when(F.col("f").rlike(r"^\+?[0-9]+$"), F.expr("try_cast(f AS bigint)"))
    prob = F.when(n <= 65535, F.least(n, F.lit(255))).otherwise(0).cast("int")
    return rows.filter("word <> ''").select("word", prob.alias("prob"))


def parse_phrases(lines: DataFrame) -> DataFrame:
    """(line_no, text) of JSON lines {text, source}; blank lines count but have no row, a malformed line is an error."""
    own = lines.filter(F.trim("line") != "")
    return own.select("line_no", F.from_json("line", PHRASE, {"mode": "FAILFAST"}).getField("text").alias("text"))


def write_model(df: DataFrame, path: str, kind: str, vocab_size: int, top_n: int) -> None:
    """A bigram or trigram table in order of its contexts, so that a lookup reads few row groups, and a one-row table ``meta`` beside it."""
    spark, context = df.sparkSession, CONTEXT[kind]
    df.repartitionByRange(*context).sortWithinPartitions(*context, "rank").write.mode("overwrite").parquet(f"{path}/edges")
    edges = spark.read.parquet(f"{path}/edges").count()
    magic = {"bigram": BIGRAM_MAGIC, "trigram": TRIGRAM_MAGIC}[kind]
    spark.createDataFrame([(magic, VERSION, vocab_size, edges, top_n)], "magic long, version int, vocab_size long, edges long, top_n int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_model(spark: SparkSession, path: str, kind: str, optional: bool = False) -> DataFrame | None:
    """The edges of a model; a wrong magic number is an error, a missing optional model None."""
    try:
        meta = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException:
        if optional:
            return None
        raise
    if meta["magic"] != {"bigram": BIGRAM_MAGIC, "trigram": TRIGRAM_MAGIC}[kind] or meta["version"] != VERSION:
        raise ValueError(f"{path} is no {kind} model of version {VERSION}")
    return spark.read.parquet(f"{path}/edges")


def write_history(words: DataFrame, edges: DataFrame, path: str) -> None:
    words.write.mode("overwrite").parquet(f"{path}/user_word")
    edges.write.mode("overwrite").parquet(f"{path}/user_edge")


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(words, edges); empty where there is no history yet, an error where it can't be read."""
    from ..operators.history import EDGE, WORD

    out = []
    for name, schema in (("user_word", WORD), ("user_edge", EDGE)):
        try:
            out.append(spark.read.parquet(f"{path}/{name}"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out.append(spark.createDataFrame([], schema))
    return out[0], out[1]


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_report` wrote; empty values stay empty."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\u0000").schema(schema).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; every value quoted where it needs it."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
