"""What pairs of near duplicates come to: how many partners each point has, and the classes that they form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import kept

LINKS = "id long, head long, near long, root long"


class Tally:
    """Of a task's points, in the order of their heads: the partners of each and the least head they lead to; or, if ``whole``, all pairs."""

    def __init__(self, ids: np.ndarray, heads: np.ndarray, whole: bool):
        self.ids, self.heads, self.whole, self.pairs = ids, heads, whole, []
        self.near, self.label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

    def add(self, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
        """The pairs (i, j); none may be told twice."""
        if self.whole:
            self.pairs.append((np.minimum(self.ids[i], self.ids[j]), np.maximum(self.ids[i], self.ids[j]), value))
            return
        self.near += np.bincount(i, minlength=len(self.ids)) + np.bincount(j, minlength=len(self.ids))
        while True:
            a, b = self.label[i], self.label[j]
            if (a == b).all():
                return
            least = np.minimum(a, b)
            np.minimum.at(self.label, a, least)
            np.minimum.at(self.label, b, least)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def table(self, value: str) -> pa.Table:
        if self.whole:
            cols = zip(*self.pairs, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
            return pa.table(dict(zip(("a", "b", value), (np.concatenate(c) for c in cols))))
        own = np.flatnonzero(self.near)
        return pa.table({"id": self.ids[own], "head": self.heads[own], "near": self.near[own], "root": self.heads[self.label[own]]})


def classes_of(members: DataFrame, points: DataFrame, told: DataFrame, every: DataFrame) -> DataFrame:
    """(id, class_id, links) of each row of ``every`` (id): from (member, id) of ``members``, (id, head, holders) of ``points`` and LINKS rows.

    The class is the lowest member of all that are joined, directly or through others; links are the other members of
    a member's points and the other points within reach of them.  Members of several points tie the classes of these.
    """
    near = told.groupBy("id").agg(F.sum("near").alias("near"))
    several = members.groupBy("member").count().filter("count > 1").select("member")
    ties = members.join(several, "member", "left_semi").join(points, "id").select(F.col("member").alias("a"), F.col("head").alias("b"))
    root = components(told.select(F.col("head").alias("a"), F.col("root").alias("b")).union(ties)).select(F.col("v").alias("head"), "root")
    info = points.join(near, "id", "left").join(root, "head", "left").select("id", F.coalesce("root", "head").alias("class_id"), (F.col("holders") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    by = members.join(info, "id").groupBy("member").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    out = every.distinct().join(by.withColumnRenamed("member", "id"), "id", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def components(edges: DataFrame, driver: int = 250_000) -> DataFrame:
    """(v, root) for each vertex of the edges (a, b): root is the least vertex of its component.

    Up to ``driver`` edges are joined on the driver; more in rounds, each of which hooks every
    vertex to its least neighbour, follows the hooks to their ends and contracts.
    """
    spark = edges.sparkSession
    edges = kept(edges.select("a", "b").filter("a <> b").distinct())
    maps: list[DataFrame] = []
    while (left := edges.count()) > driver:
        both = edges.union(edges.select("b", "a"))
        hook = kept(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("to")))
        while True:
            further = kept(hook.join(hook.toDF("to", "next"), "to").select("v", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")))
            hook = further.select("v", "to")
            if further.filter("moved").isEmpty():
                break
        maps.append(hook)
        edges = edges.join(hook.toDF("a", "ra"), "a").join(hook.toDF("b", "rb"), "b")
        edges = kept(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct())
    out = spark.createDataFrame(pa.table(_united(edges.toArrow() if left else None)), "v long, root long")
    for m in reversed(maps):
        out = m.join(out.toDF("to", "root"), "to", "left").select("v", F.coalesce("root", "to").alias("root"))
    return out


def _united(edges: pa.Table | None) -> dict:
    if edges is None:
        return {"v": pa.array([], pa.int64()), "root": pa.array([], pa.int64())}
    v, at = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    a, b = at[: edges.num_rows], at[edges.num_rows :]
    root = np.arange(len(v))
    while True:
        least = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
        if (root == was).all():
            return {"v": pa.array(v), "root": pa.array(v[root])}
