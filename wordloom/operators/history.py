"""Personal histories: what users wrote, with counts that decay when they are read.

State is (count, last use) alone, so histories merge by sums and maxima.  The clock is an argument.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edge_score, token_lines, word_score
from ..functions.scores import U32

#: private ids begin here and end before CAP
FIRST_ID, CAP = 0x80000000, 0xFFFFFFF0
WORD = "user_id long, word string, word_id long, freq long, accept long, last_used long"
EDGE = "user_id long, prev_id long, next_id long, count long, last_used long"


def resolved(messages: DataFrame, known: DataFrame, private: DataFrame | None = None) -> DataFrame:
    """(user_id, now, seq, pos, token, word_id, own): tokens of (user_id, seq, now, text) with global ids from ``known`` (lower, word_id), else private ids.

    A user's private words are numbered in order of their first use, after those of ``private`` (user_id, word, word_id).
    """
    t = token_lines(messages, "history", keys=("user_id", "seq", "now")).select("user_id", "seq", "now", F.posexplode("tokens").alias("pos", "token"))
    t = t.join(known.select(F.col("lower").alias("token"), F.col("word_id").alias("known_id")), "token", "left")
    fresh = t.filter("known_id IS NULL").groupBy("user_id", "token").agg(F.min(F.struct("seq", "pos")).alias("at"))
    base = F.lit(FIRST_ID)
    if private is not None:
        had = private.select("user_id", F.col("word").alias("token"), F.col("word_id").alias("had_id"))
        fresh = fresh.join(had.select("user_id", "token"), ["user_id", "token"], "left_anti").join(had.groupBy("user_id").agg((F.max("had_id") + 1).alias("base")), "user_id", "left")
        base = F.coalesce("base", base)
    w = Window.partitionBy("user_id").orderBy("at", "token")
    fresh = fresh.withColumn("own_id", base + F.row_number().over(w) - 1).select("user_id", "token", "own_id").filter(F.col("own_id") < CAP)
    if private is not None:
        fresh = fresh.union(had)
    t = t.join(fresh, ["user_id", "token"], "left")
    return t.select("user_id", "seq", "now", "pos", "token", F.coalesce("known_id", "own_id").alias("word_id"), F.col("known_id").isNull().alias("own"))


def learn(messages: DataFrame, known: DataFrame, private: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(words, edges) that the messages add.  A message is one chain; only private words have word stats; a word without an id left breaks the chain."""
    return learned(resolved(messages, known, private))


def learned(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, edges) of the tokens that :func:`resolved` gives."""
    words = t.filter("own AND word_id IS NOT NULL").groupBy("user_id", F.col("token").alias("word"), "word_id").agg(F.count("*").alias("freq"), F.lit(0).cast("long").alias("accept"), F.max("now").alias("last_used"))
    w = Window.partitionBy("user_id", "seq").orderBy("pos")
    pairs = t.select("user_id", "now", F.lag("word_id").over(w).alias("prev_id"), F.col("word_id").alias("next_id")).filter("prev_id IS NOT NULL AND next_id IS NOT NULL")
    edges = pairs.groupBy("user_id", "prev_id", "next_id").agg(F.count("*").alias("count"), F.max("now").alias("last_used"))
    return words, edges


def followed(uses: DataFrame, bucket: int = 3600) -> DataFrame:
    """(user_id, prev_id, next_id, at) of neighbours among a user's (user_id, id, at, seq), in order of (at, seq); none across an id that is null.

    Neighbours are found within buckets of so many seconds, and the last id of a bucket is handed to the user's next one, so that
    a user with a large share of all rows is many tasks.
    """
    own = uses.withColumn("_b", F.floor(F.col("at") / bucket))
    last = own.groupBy("user_id", "_b").agg(F.max_by(F.struct("id"), F.struct("at", "seq")).alias("_last"))
    before = last.select("user_id", "_b", F.lag("_last").over(Window.partitionBy("user_id").orderBy("_b")).getField("id").alias("_before"))
    w = Window.partitionBy("user_id", "_b").orderBy("at", "seq")
    own = own.withColumn("_r", F.row_number().over(w)).withColumn("_lag", F.lag("id").over(w)).join(before, ["user_id", "_b"])
    pairs = own.select("user_id", F.when(F.col("_r") == 1, F.col("_before")).otherwise(F.col("_lag")).alias("prev_id"), F.col("id").alias("next_id"), "at")
    return pairs.filter("prev_id IS NOT NULL AND next_id IS NOT NULL")


def merge_words(*parts: DataFrame) -> DataFrame:
    """Stats summed, saturating at 32 bits, with the last use."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    cap = lambda c: F.least(F.sum(c), F.lit(U32)).alias(c)
    return every.groupBy("user_id", "word", "word_id").agg(cap("freq"), cap("accept"), F.max("last_used").alias("last_used"))


def merge_edges(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("user_id", "prev_id", "next_id").agg(F.least(F.sum("count"), F.lit(U32)).alias("count"), F.max("last_used").alias("last_used"))


def accept(words: DataFrame, accepted: DataFrame) -> DataFrame:
    """``words`` after suggestions were taken: (user_id, word_id, now) each add 3 to freq and 1 to accept."""
    a = accepted.groupBy("user_id", "word_id").agg(F.count("*").alias("k"), F.max("now").alias("at"))
    out = words.join(a, ["user_id", "word_id"], "left")
    k = F.coalesce("k", F.lit(0))
    return out.select("user_id", "word", "word_id", F.least(F.col("freq") + 3 * k, F.lit(U32)).alias("freq"), F.least(F.col("accept") + k, F.lit(U32)).alias("accept"), F.greatest("last_used", "at").alias("last_used"))


def predict(edges: DataFrame, now: int, top_n: int = 20, prev: DataFrame | None = None) -> DataFrame:
    """(user_id, prev_id, next_id, score, rank): the successors of each context (of those in ``prev``) with the highest decayed scores."""
    own = edges if prev is None else edges.join(prev, ["user_id", "prev_id"], "left_semi")
    own = own.withColumn("score", edge_score(F.col("count"), F.col("last_used"), now))
    w = Window.partitionBy("user_id", "prev_id").orderBy(F.desc("score"), "next_id")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n).select("user_id", "prev_id", "next_id", "score", "rank")


def pruned(edges: DataFrame, now: int, over: int = 2000, keep: int = 40) -> DataFrame:
    """``edges`` where a context with more than ``over`` successors keeps its ``keep`` best by decayed score."""
    w = Window.partitionBy("user_id", "prev_id")
    own = edges.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(edge_score(F.col("count"), F.col("last_used"), now)), "next_id")))
    return own.filter((F.col("_n") <= over) | (F.col("_r") <= keep)).drop("_n", "_r")


def update(words: DataFrame, edges: DataFrame, messages: DataFrame, known: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(words, edges) after the messages: what they add is merged in, and contexts that have grown too wide at ``now`` are pruned."""
    more, new = learn(messages, known, words.select("user_id", "word", "word_id"))
    return merge_words(words, more), pruned(merge_edges(edges, new), now)


def lookup(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(key columns, word, word_id) of ``keys``: by (user_id, word) or (user_id, word_id); those without a private word have nulls."""
    by = [c for c in ("user_id", "word", "word_id") if c in keys.columns]
    return keys.join(words.select("user_id", "word", "word_id"), by, "left")


def prefix(words: DataFrame, start: str, now: int, limit: int = 10) -> DataFrame:
    """(user_id, word, word_id, score, rank): each user's private words that begin with ``start``, normalized; none if nothing is left of it."""
    one = words.sparkSession.createDataFrame([(0, 0, 0, start)], "user_id long, seq long, now long, text string")
    norm = token_lines(one, "history", keys=("user_id",)).select(F.array_join("tokens", "").alias("s")).first()["s"]
    own = words.filter(F.col("word").startswith(norm) & F.lit(norm != "")).withColumn("score", word_score(F.col("freq"), F.col("accept"), F.col("last_used"), now))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "word")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("user_id", "word", "word_id", "score", "rank")
