"""A corpus as numbers: its pieces are cut once and coded chunk by chunk, and n-grams are counted on ids.

A chunk is some whole texts, CHUNK bytes or one text, with a dictionary of its own.  What a piece means (its written form, its
token, its id) is worked out for the distinct pieces of the corpus, with the functions of :mod:`wordloom.functions`.  Counts of a task
are made by sorting numbers, so what is shuffled is partial counts of ids, not words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..session import stored
from . import lexicon, ngrams

#: bytes of a chunk's texts, chunks of a file, ids that are counted at once, and rows of a batch that is returned
CHUNK, CHUNKS, RUN, ROWS = 12 << 20, 8, 1 << 22, 1 << 18
CODED = "chunk long, lines long, words array<struct<piece:string,n:long>>, codes binary, ends binary"
_ARROW = pa.schema([("chunk", pa.int64()), ("lines", pa.int64()), ("words", pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())]))), ("codes", pa.binary()), ("ends", pa.binary())])
#: Unicode's white space in UTF-8: of one byte, what follows E2 80, and the rest
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_AFTER_E280 = np.zeros(256, bool)
_AFTER_E280[[*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]] = True
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def _spaced(text: bytes) -> np.ndarray:
    """The bytes of UTF-8 with a blank in each byte of wide white space."""
    for wide in _WIDE:
        if wide in text:
            text = text.replace(wide, b" " * len(wide))
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(data[:-2] == 0xE2)
    at = at[(data[at + 1] == 0x80) & _AFTER_E280[data[at + 2]]]
    if len(at):
        data = data.copy()
        data[at] = data[at + 1] = data[at + 2] = 32
    return data


def _row(chunk: int, texts: list) -> pa.RecordBatch:
    data = _spaced(b"\n".join(texts) + b"\n")
    line = np.flatnonzero(data == 10)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside[1:-1]]))).dictionary_encode()
    codes, ends = pieces.indices.to_numpy().astype(np.int32), np.searchsorted(start, line).astype(np.int32)
    ends = ends[np.diff(ends, prepend=0) > 0]
    used = np.bincount(codes, minlength=len(pieces.dictionary))
    words = pa.StructArray.from_arrays([pieces.dictionary.cast(pa.string()), pa.array(used, pa.int64())], ["piece", "n"])
    own = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(line)]), own, pa.array([codes.tobytes()], pa.binary()), pa.array([ends.tobytes()], pa.binary())], schema=_ARROW)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, held, n = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for x in batch.column(0):
            if x.is_valid:
                held.append(x.as_buffer())
                n += held[-1].size + 1
                if n >= CHUNK:
                    yield _row(chunk, held)
                    chunk, held, n = chunk + 1, [], 0
    if held:
        yield _row(chunk, held)


@dataclass
class Coded:
    """``chunks`` (chunk, lines, words, codes, ends): the pieces of texts by number, and where lines end."""

    chunks: DataFrame

    @property
    def words(self) -> DataFrame:
        """(chunk, at, piece, n): the distinct pieces of each chunk by number, and how often it has them."""
        return self.chunks.select("chunk", F.posexplode("words").alias("at", "w")).select("chunk", "at", "w.piece", "w.n")

    @cached_property
    def pieces(self) -> DataFrame:
        """(piece, n): the distinct pieces, and how often the corpus has them; written once."""
        return stored(self.words.groupBy("piece").agg(F.sum("n").alias("n")))


def coded(docs: DataFrame, text: str = "text") -> Coded:
    return Coded(stored(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_encode, CODED), CHUNKS))


def _resolve(left: pa.Table, right: pa.Table) -> pa.Table:
    """The ids of a chunk in order, -1 for what has none and at the end of each line."""
    out = []
    for chunk, codes, ends in zip(*(left.column(c) for c in ("chunk", "codes", "ends"))):
        own, to = np.frombuffer(codes.as_buffer(), np.int32), np.frombuffer(ends.as_buffer(), np.int32)
        ids = np.full(int(own.max()) + 1 if len(own) else 0, -1, np.int32)
        known = right.column("word_id").to_numpy()
        if len(known) and known.max() >= 1 << 31:
            raise ValueError("ids of words are under 2 ** 31")
        ids[right.column("at").to_numpy()] = known
        placed = np.full(len(own) + len(to), -1, np.int32)
        placed[np.arange(len(own)) + np.repeat(np.arange(len(to)), np.diff(to, prepend=0))] = ids[own]
        out.append((chunk.as_py(), placed.tobytes()))
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "ids": pa.array([b for _, b in out], pa.binary())})


def ids(own: Coded, names: DataFrame, mode: str = "corpus_en") -> DataFrame:
    """(chunk, ids): the corpus in ids of ``names`` (lower, word_id), in which no token occurs twice; written once."""
    tokens = own.pieces.select("piece", normalize(F.col("piece"), mode).alias("lower")).filter("lower <> ''")
    known = tokens.join(names.select("lower", "word_id"), "lower").select("piece", "word_id")
    found = own.words.join(known.hint("shuffle_hash"), "piece").select(F.col("chunk").alias("of"), "at", "word_id")
    return stored(own.chunks.select("chunk", "codes", "ends").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_resolve, "chunk long, ids binary"), CHUNKS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Some RUN ids at a time, of whole chunks."""
    held, n = [], 0
    for batch in batches:
        for x in batch.column(0):
            held.append(np.frombuffer(x.as_buffer(), np.int32))
            n += len(held[-1])
            if n >= RUN:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def _batches(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for k in range(0, n, ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + ROWS].astype(np.int64)) for c in columns.values()], names=list(columns))


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def pair_counts(own: DataFrame) -> DataFrame:
    """(prev_id, next_id, cnt, followed) of a corpus in ids: how often a pair stands in a line, and how often a third id follows it; partitioned by prev_id."""

    def run(batches):
        for x in _runs(batches):
            a, b = x[:-1], x[1:]
            then = np.concatenate([x[2:] >= 0, [False]])
            ok = (a >= 0) & (b >= 0)
            if not ok.any():
                continue
            key = np.sort(a[ok].astype(np.uint64) << np.uint64(33) | b[ok].astype(np.uint64) << np.uint64(1) | then[ok].astype(np.uint64))
            followed, key = (key & np.uint64(1)).astype(np.int64), key >> np.uint64(1)
            at = _starts(key)
            yield from _batches(prev_id=key[at] >> np.uint64(32), next_id=key[at] & np.uint64(0xFFFFFFFF), cnt=np.diff(at, append=len(key)), followed=np.add.reduceat(followed, at))

    part = own.select("ids").mapInArrow(run, "prev_id long, next_id long, cnt long, followed long")
    return part.repartition("prev_id").groupBy("prev_id", "next_id").agg(F.sum("cnt").alias("cnt"), F.sum("followed").alias("followed"))


def top_pairs(pairs: DataFrame, k: int = 5000) -> DataFrame:
    """(w1, w2, cnt) of :func:`pair_counts`: the k pairs that a known word follows most often, ties in order of ids."""
    return pairs.filter("followed > 0").select(F.col("prev_id").alias("w1"), F.col("next_id").alias("w2"), F.col("followed").alias("cnt")).orderBy(F.desc("cnt"), "w1", "w2").limit(k)


def trigram_counts(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """(w1, w2, next_id, cnt) of a corpus in ids, after the ``pairs`` (w1, w2) alone; these come to the driver."""
    keys = np.array(sorted((r["w1"] << 32) | r["w2"] for r in pairs.select("w1", "w2").collect()), np.int64)
    begins = np.unique(keys >> 32)

    def run(batches):
        one = np.zeros(int(begins[-1]) + 2 if len(begins) else 2, bool)
        one[begins] = True
        for x in _runs(batches):
            a, b, c = x[:-2], x[1:-1], x[2:]
            at = np.flatnonzero((b >= 0) & (c >= 0) & one[np.minimum(a, len(one) - 1)] & (a >= 0))
            key = a[at].astype(np.int64) << 32 | b[at]
            place = np.searchsorted(keys, key)
            hit = np.flatnonzero(place < len(keys))
            hit = hit[keys[place[hit]] == key[hit]]
            if not len(hit):
                continue
            own = np.sort(place[hit].astype(np.int64) << 32 | c[at[hit]])
            first = _starts(own)
            pair = keys[own[first] >> 32]
            yield from _batches(w1=pair >> 32, w2=pair & 0xFFFFFFFF, next_id=own[first] & 0xFFFFFFFF, cnt=np.diff(first, append=len(own)))

    part = own.select("ids").mapInArrow(run, "w1 long, w2 long, next_id long, cnt long")
    return part.groupBy("w1", "w2", "next_id").agg(F.sum("cnt").alias("cnt"))


def bigrams_pruned(docs: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What :func:`ngrams.bigrams_pruned` finds in the lines of ``docs`` in order of ``key``.

    Texts are put in order before they are cut, so the numbers of chunks tell the order.  Of each chunk the successors of a wide
    context are one row, in order; ids are in byte order of tokens, so trackers break ties as they do on words.  The ids of wide
    contexts, each of which has over 100n pairs, come to the driver.
    """
    own = coded(docs.select(key, text).repartitionByRange(key).sortWithinPartitions(key), text)
    names = lexicon.dense_ids(own.pieces.select(normalize(F.col("piece")).alias("lower")).filter("lower <> ''").distinct(), "lower")
    all_ids = ids(own, names)
    pairs = stored(pair_counts(all_ids).drop("followed"))
    wide = np.array(sorted(r["prev_id"] for r in pairs.groupBy("prev_id").count().filter(F.col("count") > 100 * n).select("prev_id").collect()), np.int64)

    def cut(batches):
        of = np.zeros(int(wide[-1]) + 2 if len(wide) else 2, bool)
        of[wide] = True
        for batch in batches:
            for chunk, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(x.as_buffer(), np.int32)
                a, b = x[:-1], x[1:]
                at = np.flatnonzero((a >= 0) & (b >= 0) & of[np.minimum(a, len(of) - 1)])
                if not len(at):
                    continue
                at = at[np.argsort(a[at], kind="stable")]
                prev, nxt = a[at], b[at]
                first = _starts(prev)
                to = pa.array(np.append(first, len(at)) * 4, pa.int32())
                lists = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, to.buffers()[1], pa.py_buffer(np.ascontiguousarray(nxt))])
                yield pa.RecordBatch.from_arrays([pa.array(prev[first].astype(np.int64)), pa.array(np.full(len(first), chunk)), lists], names=["prev_id", "chunk", "nexts"])

    def replay(batches):
        prev, tracker = None, ngrams.Tracker(n)

        def row():
            counts = tracker.counts
            return pa.RecordBatch.from_arrays([pa.array([prev] * len(counts), pa.int64()), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["prev_id", "next_id", "cnt"])

        for batch in batches:
            for p, nexts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != prev:
                    if prev is not None:
                        yield row()
                    prev, tracker = p, ngrams.Tracker(n)
                tracker.add(np.frombuffer(nexts.as_buffer(), np.int32).tolist())
        if prev is not None:
            yield row()

    ordered = all_ids.select("chunk", "ids").mapInArrow(cut, "prev_id long, chunk long, nexts binary").repartition("prev_id").sortWithinPartitions("prev_id", "chunk")
    replayed = ordered.select("prev_id", "nexts").mapInArrow(replay, "prev_id long, next_id long, cnt long")
    of = docs.sparkSession.createDataFrame([(int(w),) for w in wide], "prev_id long")
    out = ngrams.top_n(pairs.join(of, "prev_id", "left_anti").unionByName(replayed), ["prev_id"], "next_id", n)
    for word in ("prev", "next"):
        out = out.join(names.select(F.col("word_id").alias(f"{word}_id"), F.col("lower").alias(word)), f"{word}_id")
    return out.select("prev", "next", "cnt", "rank", "weight")
