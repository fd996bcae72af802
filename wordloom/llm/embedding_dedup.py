"""Embedding near-dedup by collision-counting projections.

Vectors are put on the unit sphere; a pair is a near duplicate at cosine THRESHOLD or more.

1. *Cells.*  So that not all pairs are counted, a few projections, cut into shifted steps, make cells of about CELL
   vectors.  One such table parts some near pairs, so there are as many tables as RECALL needs: their number follows from
   the axes of a cell, which are logarithmic in the vectors (14 tables for a million vectors, 59 for a thousand million).
   A pair is counted in the first table where it meets.  A cell of more than ROOM vectors is cut into
   blocks, each two of which are a task.
2. *Collision counts.*  In a cell the vectors are sorted on LINES other random projections.  A vector's
   query-centred window on a line is a range of ranks; a pair collides there if one's rank lies in the other's range.
   Pairs whose collisions reach a count, first over EARLY lines, then over all, are verified by their cosine.

Tables and counts are calibrated on random pairs at the threshold, by length of the vectors and with a fixed seed: each of the
three steps may lose its share of ``1 - RECALL``, so that such a pair is found with
probability RECALL or more at every size of the table; nearer ones more surely.

Equal vectors are one point.  :func:`classes` gives a row for each id, :func:`near_pairs` the pairs.

Defined results: null and empty vectors, those with null, NaN or infinite parts and zero vectors have no partners: they are classes of
their own with no links; vectors of different lengths are never partners; rows with a null id are left out; an id in several rows is one
member with the links of all its vectors, and never its own partner; an empty table gives an empty result; other columns are
not looked at.  Every vector is a query; nothing is capped.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._links import LINKS, Tally, classes_of
from ._spark import kept, read, small_or_shuffled
from ._text import mix

THRESHOLD = 0.95
RECALL = 0.95
LINES = 32
#: lines that are counted before the first pairs are let go
EARLY = 8
#: half width of the windows on a line, in standard deviations of the difference of a pair at the threshold
LINE_WINDOW = 1.5
#: width of the steps of an axis, in standard deviations of a unit vector's projection
STEP = 2.0
#: vectors for a cell to hold, about, and at most in a task's block
CELL, ROOM = 1_000, 8_192
#: large cells that are broadcast at most; beyond it they are joined by shuffle
BROADCAST = 500_000
TRIALS = 4_000
PAIRS = "a long, b long, cosine double"
_U = np.uint64


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    d = np.random.default_rng([seed, dim]).standard_normal((dim, n))
    return d / np.linalg.norm(d, axis=0)


def sigma(dim: int, t: float) -> float:
    """Spread of the projected difference of unit vectors at cosine t on a random line."""
    return sqrt(2 * (1 - t) / dim)


@lru_cache(maxsize=64)
def trials(dim: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at cosine t."""
    r = np.random.default_rng([3, dim])
    x, y = r.standard_normal((2, TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(y, axis=1, keepdims=True)
    return x, t * x + sqrt(1 - t * t) * np.divide(y, length, out=np.zeros_like(y), where=length > 1e-12)


@lru_cache(maxsize=64)
def counts(dim: int, t: float) -> tuple[int, int]:
    """The collisions on EARLY and on LINES lines that all but a share of the trials reach."""
    x, y = trials(dim, t)
    hit = np.abs((x - y) @ directions(dim, LINES, 2)) <= LINE_WINDOW * sigma(dim, t)
    early, every = np.sort(hit[:, :EARLY].sum(axis=1)), np.sort(hit.sum(axis=1))
    share = int(TRIALS * (1 - RECALL) / 3)
    return int(early[share]), int(every[share])


def keys(x: np.ndarray, axes: int, tables: int, first: int = 0) -> np.ndarray:
    """The cell of each vector in each table from ``first`` on."""
    out = np.zeros((len(x), tables - first), dtype=np.uint64)
    dim = x.shape[1]
    for k in range(first, tables):
        r = np.random.default_rng([5, dim, k])
        d = r.standard_normal((dim, axes))
        at = np.floor((x @ (d / np.linalg.norm(d, axis=0))) * sqrt(dim) / STEP + r.random(axes)).astype(np.int64).view(np.uint64)
        for a in range(axes):
            out[:, k - first] = mix(out[:, k - first] * _U(31) + at[:, a] + _U(a + 1))
    return out


@lru_cache(maxsize=64)
def tables(dim: int, axes: int, t: float) -> int:
    """The tables after which all but a share of the trials have met."""
    if not axes:
        return 1
    x, y = trials(dim, t)
    n, apart = 0, np.ones(len(x), dtype=bool)
    while apart.mean() > (1 - RECALL) / 3:
        left = np.flatnonzero(apart)
        apart[left] = (keys(x[left], axes, n + 1, n) != keys(y[left], axes, n + 1, n))[:, 0]
        n += 1
    return n


def cell_pairs(x: np.ndarray, table: int, axes: int, left: np.ndarray, right: np.ndarray, t: float, block: int = 256):
    """(i, j, cosine) of the near pairs of a vector of ``left`` and one of ``right`` that meet in no table before."""
    n, dim = x.shape
    s = sigma(dim, t)
    p = x @ directions(dim, LINES, 2)
    rank, low, high = (np.empty((LINES, n), np.int16 if n < 2**15 else np.int32) for _ in range(3))
    for k in range(LINES):
        o = np.argsort(p[:, k], kind="stable")
        line = p[o, k]
        rank[k, o] = np.arange(n)
        low[k] = np.searchsorted(line, p[:, k] - LINE_WINDOW * s, side="left")
        high[k] = np.searchsorted(line, p[:, k] + LINE_WINDOW * s, side="right")
    early, final = counts(dim, t)
    earlier = keys(x, axes, table)
    same = left is right
    r_rank = rank[:, right]
    for a in range(0, len(left), block):
        own = left[a : a + block]
        from_ = a if same else 0  # of a block with itself only the later ones
        count = np.zeros((len(own), len(right) - from_), dtype=np.uint8)
        for k in range(EARLY):
            r = r_rank[k, None, from_:]
            count += (r >= low[k, own, None]) & (r < high[k, own, None])
        i, j = np.nonzero(count >= early)
        c = count[i, j].astype(np.int32)
        i, j = own[i], right[j + from_]
        if same:
            ok = i < j
            i, j, c = i[ok], j[ok], c[ok]
        for k in range(EARLY, LINES):
            c += (rank[k, j] >= low[k, i]) & (rank[k, j] < high[k, i])
        i, j = i[c >= final], j[c >= final]
        cos = np.einsum("ij,ij->i", x[i], x[j])
        ok = (cos >= t - 1e-7) & ~(earlier[i] == earlier[j]).any(axis=1)
        yield i[ok], j[ok], cos[ok]


def _points(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(member, id) of the whole vectors and (id, head, holders, v) of the different ones; id is a hash of the vector."""
    every = vectors.select(vectors[vec_id].cast("long").alias("member"), vectors[embedding].cast("array<float>").alias("v")).filter("member IS NOT NULL")
    whole = every.filter("forall(v, y -> y IS NOT NULL AND NOT isnan(y) AND abs(y) < float('Infinity')) AND exists(v, y -> y <> 0)").withColumn("id", F.xxhash64("v"))
    members = kept(whole.select("member", "id").distinct())
    first = members.groupBy("id").agg(F.min("member").alias("head"), F.count("*").alias("holders"))
    return members, kept(first.join(whole.groupBy("id").agg(F.min("v").alias("v")), "id"))


def linked(points: DataFrame, whole: bool, t: float, cell: int, room: int) -> DataFrame:
    n = points.count()
    axes = max(0, ceil(log2(max(1.0, n / cell))))
    vectors = points.select("id", "head", "v")

    def unit(batch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """length -> (rows, unit vectors)"""
        v = batch.column("v")
        size, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
        start = np.concatenate([[0], np.cumsum(size)])
        out = {}
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            x = flat[start[rows][:, None] + np.arange(dim)].astype(np.float64)
            out[dim] = rows, x / np.linalg.norm(x, axis=1, keepdims=True)
        return out

    def cells(batches, slim):
        for batch in batches:
            for dim, (rows, x) in unit(batch).items():
                every = keys(x, axes, tables(dim, axes, t))
                for k in range(every.shape[1]):
                    own = [pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), k, np.int32)), pa.array(every[:, k].view(np.int64))]
                    names = ["dim", "tab", "cell"]
                    if slim:
                        yield pa.RecordBatch.from_arrays(own, names)
                    else:
                        part = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*own, *part.columns], names + part.schema.names)

    place = ["dim", "tab", "cell"]
    large = vectors.mapInArrow(lambda b: cells(b, True), "dim int, tab int, cell long").groupBy(place).count().filter(F.col("count") > room)
    large = small_or_shuffled(kept(large.select(*place, F.ceil(F.col("count") / room).alias("blocks"))), BROADCAST)
    members = vectors.mapInArrow(lambda b: cells(b, False), "dim int, tab int, cell long, id long, head long, v array<float>").join(large, place, "left")
    members = members.withColumn("block", F.expr("pmod(id, coalesce(blocks, 1))")).withColumn("other", F.explode(F.expr("sequence(0L, coalesce(blocks, 1L) - 1L)")))
    members = members.select(*place, "id", "head", "v", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("head", "ascending"), ("id", "ascending")])
        tally = Tally(table["id"].to_numpy(), table["head"].to_numpy(), whole)
        if table.num_rows > 1:
            (_, x), *_ = unit(table.to_batches()[0]).values()
            block = table["block"].to_numpy()
            left, right = np.flatnonzero(block == table["low"][0].as_py()), np.flatnonzero(block == table["high"][0].as_py())
            if table["low"][0].as_py() == table["high"][0].as_py():
                right = left
            for i, j, c in cell_pairs(x, table["tab"][0].as_py(), axes, left, right, t):
                tally.add(i, j, c)
        return tally.table("cosine")

    return kept(members.groupBy(*place, "low", "high").applyInArrow(run, PAIRS if whole else LINKS))


def near_pairs(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", t: float = THRESHOLD, cell: int = CELL, room: int = ROOM) -> DataFrame:
    """(vec_a, vec_b, cosine), vec_a < vec_b: near pairs of different vectors by the first id of each, and further ids of a vector with its first, at 1."""
    members, points = _points(vectors, vec_id, embedding)
    first = points.select("id", "head")
    near = linked(points, True, t, cell, room).join(first.toDF("a", "vec_a"), "a").join(first.toDF("b", "vec_b"), "b").select("vec_a", "vec_b", "cosine")
    same = members.join(first, "id").select(F.col("head").alias("vec_a"), F.col("member").alias("vec_b"), F.lit(1.0).alias("cosine"))
    out = near.union(same).select(F.least("vec_a", "vec_b").alias("vec_a"), F.greatest("vec_a", "vec_b").alias("vec_b"), "cosine")
    return out.filter("vec_a < vec_b").groupBy("vec_a", "vec_b").agg(F.round(F.max("cosine"), 6).alias("cosine"))


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", t: float = THRESHOLD, cell: int = CELL, room: int = ROOM) -> DataFrame:
    """(vec_id, class_id, links) of each id: the lowest id of all that are joined with it, directly or through others, and its links: the other ids of its vector and the other vectors near it."""
    members, points = _points(vectors, vec_id, embedding)
    told = linked(points, False, t, cell, room)
    every = vectors.select(vectors[vec_id].cast("long").alias("id")).filter("id IS NOT NULL")
    return classes_of(members, points.drop("v"), told, every).withColumnRenamed("id", "vec_id")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "embeddings"))
