"""Bigram counts and histories from streams.

Counts are a streaming aggregation.  A history is learned batch by batch: each micro-batch writes what it adds under its
own number, every EVERY batches also a snapshot of all so far.  A batch reads the last snapshot before it and the batches since,
never its own number or later ones, so a batch that is run again replaces itself.  Trackers keep the bounded successors
of each context as the stream's own state.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import token_lines
from ..operators import history, ngrams
from ..session import stored

#: batches between snapshots
EVERY = 20
TABLES = ("user_word", "user_edge")


def bigram_stream(stream: DataFrame, mode: str = "corpus_en", text: str = "text") -> DataFrame:
    """(prev, next, cnt) of a streaming table of texts; write it in mode ``complete`` or ``update``."""
    return ngrams.bigram_counts(token_lines(stream, mode, text, keys=()))


def _written(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the batches or snapshots under ``path`` that were written to their end."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{TABLES[-1]}")  # the last that is written
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    own = [n for n in names if n.startswith(f"{kind}=")]
    return sorted(int(n.split("=")[1]) for n in own if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{TABLES[-1]}/{n}/_SUCCESS")))


def history_state(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(words, edges) of the batches under ``path``, or of those before one of them."""
    ok = lambda numbers: [n for n in numbers if before is None or n < before]
    base = max(ok(_written(spark, path, "upto")), default=None)
    parts = [f"upto={base}"] if base is not None else []
    parts += [f"batch={n}" for n in ok(_written(spark, path, "batch")) if base is None or n > base]
    out = []
    for name, schema, merge in zip(TABLES, (history.WORD, history.EDGE), (history.merge_words, history.merge_edges)):
        own = [spark.read.schema(schema).parquet(f"{path}/{name}/{p}") for p in parts]
        out.append(merge(reduce(DataFrame.unionByName, own)) if own else spark.createDataFrame([], schema))
    return out[0], out[1]


def learn_batch(batch: DataFrame, number: int, known: DataFrame, path: str, every: int = EVERY, over: int = 2000, keep: int = 40) -> None:
    """Learn the messages of one batch into the history under ``path``; run again, it replaces what it wrote."""
    spark = batch.sparkSession
    had, _ = history_state(spark, path, number)
    uses = stored(history.resolved(batch, known, had.select("user_id", "word", "word_id")))  # both tables are made of it
    for name, df in zip(TABLES, history.learned(uses)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    if (number + 1) % every == 0:
        words, edges = history_state(spark, path, number + 1)
        now = batch.agg(F.max("now")).first()[0]
        edges = edges if now is None else history.pruned(edges, now, over, keep)
        for name, df in zip(TABLES, (words, edges)):
            df.write.mode("overwrite").parquet(f"{path}/{name}/upto={number}")


def learn_stream(stream: DataFrame, known: DataFrame, path: str, every: int = EVERY) -> DataStreamWriter:
    """A writer that learns messages (user_id, seq, now, text) into the history under ``path``; start it with a checkpoint location of its own."""
    return stream.writeStream.foreachBatch(lambda batch, number: learn_batch(batch, number, known, path, every))


def track_stream(stream: DataFrame, over: int = 2000, keep: int = 40) -> DataFrame:
    """(user_id, prev_id, next_id, count, last_used) of a stream of uses (user_id, prev_id, next_id, now): the successors of each context that its uses touch, after them.

    The state of a context is at most ``over`` successors: when there are more, the ``keep`` best by decayed score stay.
    Write it in mode ``update``: a later row of a successor replaces an earlier one, and one that is missing was pruned.
    """
    import math

    def score(stat: tuple[int, int], now: int) -> int:
        eff = stat[0] * 2.0 ** (-max(0, now - stat[1]) / (7 * 86_400.0))
        return int(min(65_535.0, max(0.0, math.log1p(eff) * 10_000)))

    def run(key, batches, state: GroupState):
        ids, counts, used = state.get if state.exists else ([], [], [])
        own = {i: (c, u) for i, c, u in zip(ids, counts, used)}
        uses = pd.concat(list(batches)).sort_values(["now", "next_id"])
        for nxt, now in zip(uses["next_id"].tolist(), uses["now"].tolist()):
            c, u = own.get(nxt, (0, 0))
            own[nxt] = (min(c + 1, 0xFFFFFFFF), max(u, now))
            if len(own) > over:
                own = dict(sorted(own.items(), key=lambda x: (-score(x[1], now), x[0]))[:keep])
        state.update((list(own), [x[0] for x in own.values()], [x[1] for x in own.values()]))
        rows = [(key[0], key[1], i, c, u) for i, (c, u) in own.items()]
        yield pd.DataFrame(rows, columns=["user_id", "prev_id", "next_id", "count", "last_used"])

    own = stream.select(*(F.col(c).cast("long").alias(c) for c in ("user_id", "prev_id", "next_id", "now"))).groupBy("user_id", "prev_id")
    return own.applyInPandasWithState(run, history.EDGE, "ids array<long>, counts array<long>, used array<long>", "update", GroupStateTimeout.NoTimeout)
