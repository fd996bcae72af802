"""Checks of lexicons and n-gram tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import unpack


def integrity(lexicon: DataFrame) -> DataFrame:
    """One row: words, and how many have a packed id that is another's, or an id that two words have."""
    own = lexicon.select("word", "word_id", unpack(F.col("packed"))["word_id"].alias("packed_id"))
    back = own.alias("a").join(own.alias("b"), F.col("a.packed_id") == F.col("b.word_id"), "left").select(F.col("a.word").alias("w"), F.col("a.word_id").alias("i"), F.col("b.word").alias("v"))
    per = back.groupBy("w", "i").agg(F.count("v").alias("found"), F.max(F.when(F.col("v") == F.col("w"), 1).otherwise(0)).alias("same"))
    return per.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.when(F.col("same") == 0, 1).otherwise(0)), F.lit(0)).alias("wrong"), F.coalesce(F.sum(F.when(F.col("found") > 1, 1).otherwise(0)), F.lit(0)).alias("shared_ids"))


def invariants(table: DataFrame, context: list[str], nxt: str, top_n: int = 10, vocab_size: int | None = None) -> DataFrame:
    """One row: edges, and how many break the order of weights, repeat a successor, have a rank over ``top_n`` or an id out of range."""
    w = Window.partitionBy(*context).orderBy("rank")
    own = table.withColumn("_up", (F.col("weight") > F.lag("weight").over(w)).cast("int")).withColumn("_again", (F.count("*").over(Window.partitionBy(*context, nxt)) > 1).cast("int"))
    out = F.lit(0) if vocab_size is None else F.greatest(*[((F.col(c) < 0) | (F.col(c) >= vocab_size)).cast("int") for c in (*context, nxt)], F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return own.agg(F.count("*").alias("edges"), total("_up").alias("order_errors"), total("_again").alias("repeated_successors"), total((F.col("rank") > top_n).cast("int")).alias("rank_errors"), total(out).alias("range_errors"))


def list_lengths(vocab: DataFrame, table: DataFrame) -> DataFrame:
    """(word_id, len): successors of each word of the vocabulary, 0 for none."""
    n = table.groupBy(F.col("prev_id").alias("word_id")).agg(F.count("*").alias("n"))
    return vocab.select("word_id").join(n, "word_id", "left").select("word_id", F.coalesce("n", F.lit(0)).alias("len"))


def coverage(lengths: DataFrame) -> DataFrame:
    """One row: words, how many have successors, and that as a percentage."""
    some = F.coalesce(F.sum((F.col("len") > 0).cast("long")), F.lit(0))
    return lengths.agg(F.count("*").alias("words"), some.alias("covered"), F.round(some * 100.0 / F.count("*"), 6).alias("percent"))


def histogram(lengths: DataFrame, top_n: int = 10) -> DataFrame:
    """(bucket, words): words by the length of their list, all over ``top_n`` in the last bucket."""
    return lengths.groupBy(F.least("len", F.lit(top_n)).cast("int").alias("bucket")).agg(F.count("*").alias("words"))


def percentiles(lengths: DataFrame) -> DataFrame:
    """One row p10, median, p90 of lists that aren't empty: the values at places n/10, n/2, 9n/10 of the sorted lengths, from 0; zeros if there are none.

    Places are found in the counts by length, of which there are no more than a list is long.
    """
    by = lengths.filter("len > 0").groupBy("len").agg(F.count("*").alias("c"))
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda place: F.coalesce(F.min(F.when(F.col("upto") > place, F.col("len"))), F.lit(0)).cast("long")
    n = F.col("n")
    return run.agg(at(F.floor(n * 0.1)).alias("p10"), at(F.floor(n / 2)).alias("median"), at(F.floor(n * 0.9)).alias("p90"))


def probe(words: DataFrame, lexicon: DataFrame, table: DataFrame, how: str = "canonical") -> DataFrame:
    """(key, next_word, cnt, rank, weight): the successors of each probed word (column ``key``), nulls for none."""
    from .lexicon import lookup

    own = lookup(lexicon, words, how).select("key", F.col("word_id").alias("prev_id"))
    hits = own.join(table, "prev_id", "left").join(lexicon.select(F.col("word_id").alias("next_id"), F.col("word").alias("next_word")), "next_id", "left")
    return hits.select("key", "next_word", "cnt", "rank", "weight")
