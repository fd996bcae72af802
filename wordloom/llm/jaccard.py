"""N-gram Jaccard join: an exact metric-space join with pivots, Voronoi regions and triangle-inequality windows.

A document is the set of its word 5-grams (a shorter text: the one gram of all its
words).  ``1 - Jaccard`` is a metric; every pair of different sets within ``r = 1 - t`` is found.  Equal sets are
one point of the space, so copies are collapsed first and tied to the first document that holds the set.
:func:`classes` gives a row for each document (its class and number of links), :func:`join` the pairs of sets.

1. *Document pivots.*  Where many sets share their least gram (dense places) the grams that most of a sample of them have are a pivot.
   A point within RHO of a pivot has the region of its nearest pivot as home.  A partner
   of a home point is within ``RHO + r < 1`` of the pivot; the distances and sizes of the home points there are narrow that
   to what a partner of one of them can have, and every point in that window is
   replicated to the region.  A region joins its home points with all it holds, recursively: the home points of a large region are cut
   into rings around its pivot and rings into blocks of at most ROOM points, the others likewise; a block of home points and
   another block, if the triangle inequality lets their rings meet, are a task; in a task cells of further pivots take
   the points whose distances that inequality allows.
2. *Gram pivots.*  The other points are nearly 1 from all documents, where document pivots
   prune nothing.  There the pivots are single grams in one global order, light grams
   first.  Of a set of ``n`` grams at most ``n - ceil(t n)`` may be missing from a partner, so
   the windows are its first ``n - ceil(t n) + 1`` grams: a pair within ``r`` meets in the region of
   its first common gram.  The common grams of a pair are counted over all regions;
   ``counted + remaining`` bounds the intersection, and what passes is verified on whole sets.

Both parts are exact for any choice of pivots, order and bounds of what is broadcast or sampled (PIVOTS, PIVOT_GRAMS, SAMPLE, HEAVY_GRAMS, REPEATS,
ASKED, ``components``'s ``driver``): these decide how a pair is found, never whether.  Sets and grams are told apart by
64-bit hashes.  Tasks tell how many partners a set has and where they lead, so what is shuffled
does not grow with the pairs of a dense place.

Defined results: null and empty texts (and texts without a word) have no partners: they are classes of their own with no links;
rows whose doc_id is null are left out; a doc_id that occurs in several rows is joined by each of its texts
and never with itself; an empty table gives an empty result; texts are used whole; other
columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._links import LINKS, Tally, classes_of, components
from ._spark import kept, read, small_or_shuffled, text_documents
from ._text import hash_ngrams, hashed, mix

GRAM = 5
THRESHOLD = 0.5
#: radius of the home regions; RHO + 1 - THRESHOLD must be under 1
RHO = 0.4
#: sets that share their least gram before one of them is a pivot
DENSE = 24
#: pivots, and pivots' grams, at most, all told (they are broadcast); fewer pivots are still exact
PIVOTS, PIVOT_GRAMS = 4096, 1_000_000
#: sets of a dense place whose common grams are its pivot
SAMPLE = 9
#: sets and frequent grams, at most, that are multiplied as a matrix of floats
CELLS = 2_000_000
#: sets that share a window gram before it is heavy
HEAVY = 32
#: heavy grams at most (they are broadcast): beyond it HEAVY is raised
HEAVY_GRAMS = 1_000_000
#: ids of repeated rows that are broadcast at most; beyond it they go by a shuffled join
REPEATS = 2_000_000
#: documents whose sets are asked for that are broadcast at most; beyond it they are joined by shuffle
ASKED = 500_000
LEAF = 512
#: points of a region that one task holds, and rings that a larger one is cut into
ROOM, RINGS = 2_048, 10
_FLUSH = 1_000_000
_NONE = np.zeros(0, dtype=np.uint64)
PAIRS = "a long, b long, jaccard double"
_U = np.uint64


def sets(arr, n: int = GRAM):
    """(row, sorted distinct gram hashes) of each text."""
    for row, _, _, _, first, h in hashed(arr):
        g = hash_ngrams(h, n)
        for i in range(len(first) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= n:
                s = np.sort(g[a : b - n + 1])
                new = np.empty(len(s), dtype=bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield row + i, s[new]
            else:
                yield row + i, hash_ngrams(h[a:b], b - a) if b > a else _NONE


def set_id(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        x = np.array([s.sum(dtype=np.uint64)], dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(len(s))
    return int(mix(x).view(np.int64)[0])


def need(t: float, n) -> np.ndarray:
    """Grams that a set of n grams and its partner have in common at least."""
    return np.ceil(t * np.asarray(n) - 1e-9).astype(np.int64)


class Lookup:
    """Which of many hashes are in a sorted array; a bitmap turns most away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(16, int(len(keys) * 16).bit_length())
        self.mask = _U((1 << min(bits, 26)) - 1)
        self.map = np.zeros(int(self.mask) + 1, dtype=bool)
        self.map[(keys & self.mask).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in g, positions in keys) of what is in both."""
        if not len(self.keys) or not len(g):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.map[(g & self.mask).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        ok = self.keys[k] == g[at]
        return at[ok], k[ok]


# ---------------------------------------------------------------- the points


def points(docs: DataFrame, n: int = GRAM) -> DataFrame:
    """(doc_id, set_id, n, least) of each document that has a gram; each once."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rows = [(ids[i], set_id(s), len(s), int(s[:1].view(np.int64)[0])) for i, s in sets(batch.column("text"), n) if len(s)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["doc_id", "set_id", "n", "least"])

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, set_id long, n int, least long").distinct()


def different_sets(pts: DataFrame) -> DataFrame:
    """(set_id, head, holders, n, least): the first document and the number of documents of each set."""
    return pts.groupBy("set_id").agg(F.min("doc_id").alias("head"), F.count("*").alias("holders"), F.first("n").alias("n"), F.first("least").alias("least"))


def first_rows(docs: DataFrame, pts: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those of documents that hold no set first."""
    heads = found.select(F.col("head").alias("doc_id")).distinct()
    other = kept(pts.select("doc_id").distinct().join(heads, "doc_id", "left_anti"))
    if other.count() <= REPEATS:
        return docs.join(F.broadcast(other), "doc_id", "left_anti")
    return docs.join(heads, "doc_id", "left_semi")


class _Pivots:
    def __init__(self, parts: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        every = np.concatenate([*parts, _NONE])
        owner = np.repeat(np.arange(len(parts)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.keys, self.begin, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.owner, self.lookup = owner[order], Lookup(self.keys)

    def distances(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance) of the pivots less than 1 away."""
        _, k = self.lookup.find(s)
        if not len(k):
            return k, np.zeros(0)
        count, begin = self.count[k], self.begin[k]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        p = np.flatnonzero(common)
        return p, 1 - common[p] / (self.sizes[p] + len(s) - common[p])

    def home(self, p: np.ndarray, d: np.ndarray, rho: float) -> tuple[int, float]:
        """The nearest of the pivots at these distances and its distance, or -1 if it is over ``rho`` away."""
        if not len(p):
            return -1, 1.0
        k = int(np.lexsort((p, d))[0])
        return (int(p[k]) if d[k] <= rho else -1), float(d[k])


def _pivots(docs: DataFrame, found: DataFrame, n: int, dense: int, rho: float, room: int) -> _Pivots | None:
    """Of each dense place the grams that most of SAMPLE of its sets have: nearer to copies with other words than these are to each other."""
    counts = found.groupBy("least").agg(F.count("*").alias("c")).filter(F.col("c") >= dense)
    places = kept(counts.orderBy(F.desc("c"), "least").limit(PIVOTS))
    ranked = found.join(F.broadcast(places), "least").withColumn("k", F.row_number().over(Window.partitionBy("least").orderBy("set_id"))).filter(F.col("k") <= SAMPLE)
    rows = ranked.orderBy(F.desc("c"), "least", "k").select("least", "set_id", "head", "n").toPandas()  # PIVOTS * SAMPLE rows at most
    rows = rows[rows["n"].cumsum() <= 4 * room]
    if not len(rows):
        return None
    wanted = dict(zip(rows["set_id"].tolist(), rows["head"].tolist()))

    def run(batches):
        for batch in batches:
            out = {k: s.tobytes() for _, s in sets(batch.column("text"), n) if len(s) and (k := set_id(s)) in wanted}
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["set_id", "grams"])

    own = docs.join(F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in set(wanted.values())], "doc_id long")), "doc_id")  # PIVOTS * SAMPLE at most
    got = own.mapInArrow(run, "set_id long, grams binary").distinct().toArrow()
    grams = {k: np.frombuffer(b.as_buffer(), dtype=np.uint64) for k, b in zip(got["set_id"].to_pylist(), got["grams"])}
    parts = []
    for _, own in rows.groupby("least", sort=False):
        held = [grams[k] for k in own["set_id"] if k in grams]
        if held:
            g, c = np.unique(np.concatenate(held), return_counts=True)
            parts.append(g[2 * c > len(held)] if (2 * c > len(held)).any() else held[0])
    size = np.array([len(p) for p in parts])
    parts = [p for p, ok in zip(parts, np.cumsum(size) <= room) if ok]
    size, free, chosen = size[: len(parts)], np.ones(len(parts), dtype=bool), []
    for q, common in common_counts(parts, np.arange(len(parts))):  # densest first; none within rho of an earlier one
        if free[q]:
            chosen.append(q)
            free &= 1 - common / (size + size[q] - common) > rho
    return _Pivots([parts[q] for q in chosen]) if chosen else None


def _by_head(table: pa.Table, names: list[str]):
    """The columns of a task's rows by (head, set_id), one row for each set."""
    x = table.select(names).to_pandas().sort_values(["head", "set_id"], kind="stable").drop_duplicates("set_id")
    return [x[c].to_numpy() for c in names[:-1]] + [[np.frombuffer(g, dtype=np.uint64) for g in x[names[-1]]]]


# ---------------------------------------------------------------- regions of document pivots


class _Homes:
    """Of the home points of each region, by ring around its pivot: their distances and sizes, from least to most; what no partner of theirs can have has no place in the region."""

    def __init__(self, rings, regions: int, t: float):
        self.far = np.tile(np.array([np.inf, -np.inf, np.inf, -np.inf]), (regions, RINGS, 1))
        self.far[rings["region"], rings["ring"]] = rings[["near", "far", "least", "most"]].to_numpy() * [1, 1, t, 1 / t] + np.array([t - 1, 1 - t, 0, 0]) + np.array([-1e-9, 1e-9, -1e-9, 1e-9])

    def window(self, p: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        near, far, least, most = np.moveaxis(self.far[p], 2, 0)
        return ((near <= d[:, None]) & (d[:, None] <= far) & (least <= n) & (n <= most)).any(axis=1)


def _homes(docs: DataFrame, pivots: _Pivots, n: int, t: float, rho: float) -> _Homes:
    cast = docs.sparkSession.sparkContext.broadcast(pivots)
    kinds = {"region": np.int32, "ring": np.int32, "near": np.float64, "far": np.float64, "least": np.int32, "most": np.int32}

    def run(batches):
        pv, told = cast.value, {}
        for batch in batches:
            for _, s in sets(batch.column("text"), n):
                region, d = pv.home(*pv.distances(s), rho)
                if region >= 0:
                    x = told.setdefault((region, min(RINGS - 1, int(d * RINGS))), [d, d, len(s), len(s)])
                    x[:] = min(x[0], d), max(x[1], d), min(x[2], len(s)), max(x[3], len(s))
        rows = [(*k, *x) for k, x in told.items()]
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=k)) for c, k in zip(cols, kinds.values())], list(kinds))

    rows = docs.mapInArrow(run, "region int, ring int, near double, far double, least int, most int")
    rings = rows.groupBy("region", "ring").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.min("least").alias("least"), F.max("most").alias("most"))
    return _Homes(rings.toPandas(), len(pivots.sizes), t)  # PIVOTS * RINGS rows at most


def _memberships(docs: DataFrame, pivots: _Pivots, n: int, t: float, rho: float) -> DataFrame:
    """(region, set_id, head, home, d, grams): a point in its home region and in each later one (or, without a home, in each) of which a home point can be within r; home is its own region, -1 if it has none."""
    cast = docs.sparkSession.sparkContext.broadcast((pivots, _homes(docs, pivots, n, t, rho)))

    def run(batches):
        (pv, homes), seen = cast.value, set()
        for batch in batches:
            ids, rows = batch.column("doc_id").to_numpy(zero_copy_only=False), []
            for at, s in sets(batch.column("text"), n):
                p, d = pv.distances(s)
                if not len(p):
                    continue
                home, _ = pv.home(p, d, rho)
                near = (p >= home) & homes.window(p, d, len(s))  # of two regions that both have a pair, the lower one tells it
                if near.any() and (key := (int(ids[at]), set_id(s))) not in seen:
                    seen.add(key)
                    raw = s.tobytes()
                    rows += [(int(q), key[1], key[0], home, float(x), raw) for q, x in zip(p[near], d[near])]
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["region", "set_id", "head", "home", "d", "grams"])

    return docs.mapInArrow(run, "region int, set_id long, head long, home int, d double, grams binary")


def common_counts(parts: list[np.ndarray], queries: np.ndarray):
    """(query, common grams with each part) for each query.  Grams that many parts have are counted by a product of matrices, the others one by one."""
    size = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), size)
    every = np.concatenate([*parts, _NONE])
    order = np.argsort(every, kind="stable")
    owner = owner[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = every[order][1:] != every[order][:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(order)))
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    start = np.concatenate([[0], np.cumsum(size)])
    dense = np.flatnonzero(count > max(16, len(parts) // 16)) if len(queries) >= 32 else np.zeros(0, np.int64)
    dense = dense[np.argsort(-count[dense], kind="stable")][: CELLS // max(1, len(parts))]
    rare = np.ones(len(begin), dtype=bool)
    rare[dense] = False
    table = np.zeros((len(parts), len(dense)), dtype=np.float32)
    for k, g in enumerate(dense):
        table[owner[begin[g] : begin[g] + count[g]], k] = 1
    step = max(1, CELLS // 4 // max(1, len(parts)))
    for low in range(0, len(queries), step):
        lot = queries[low : low + step]
        base = (table[lot] @ table.T).astype(np.int64) if len(dense) else None  # exact: whole numbers under 2 ** 24
        for row, q in enumerate(lot):
            k = where[start[q] : start[q + 1]]
            k = k[rare[k] & (count[k] > 1)]
            c, b = count[k], begin[k]
            at = np.repeat(b - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            common = np.bincount(owner[at], minlength=len(parts))
            if base is not None:
                common += base[row]
            common[q] = size[q]
            yield q, common


def region_pairs(parts: list[np.ndarray], home: np.ndarray, t: float, leaf: int = LEAF):
    """(i, partners j, jaccard) of the pairs within r of which i is a home point; recursive and exact.  A pair of home points comes both ways."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    mine = np.flatnonzero(home)
    if len(mine) <= leaf:
        for q, common in common_counts(parts, mine):
            j = np.flatnonzero(common >= t / (1 + t) * (size + size[q]) - 1e-9)
            j = j[j != q]
            yield int(q), j, common[j] / (size[j] + size[q] - common[j])
        return
    r = 1 - t
    heads = mine[np.linspace(0, len(mine) - 1, max(2, min(64, len(mine) // leaf))).astype(int)]
    d = np.empty((len(heads), len(parts)))
    for k, (q, common) in enumerate(common_counts(parts, heads)):
        d[k] = 1 - common / np.maximum(size + size[q] - common, 1)
    cell = d.argmin(axis=0)
    if 2 * max(np.bincount(cell[mine], minlength=len(heads))) > len(mine):  # the pivots hardly part them
        yield from region_pairs(parts, home, t, len(mine))
        return
    for k in range(len(heads)):
        own = home & (cell == k)
        if own.any():
            least, most = size[own].min(), size[own].max()
            window = own | ((d[k] <= d[k][own].max() + r + 1e-9) & (d[k] >= d[k][own].min() - r - 1e-9) & (size >= t * least - 1e-9) & (size <= most / t + 1e-9))
            at = np.flatnonzero(window)
            for i, j, s in region_pairs([parts[x] for x in at], own[at], t, leaf):
                yield int(at[i]), at[j], s


def _blocks(members: DataFrame, t: float, room: int) -> DataFrame:
    """``members`` with (low, high, block): the home points of a region of over ``room`` points are cut into blocks, and so are the others, which
    come after; over ``room`` home points first into rings around its pivot.  A home point goes to the task of its own block and each other one,
    another point to those of its own block and each block of home points, if the triangle inequality lets their rings meet: what
    is compared grows with the home points, whatever their number beside them."""
    rings = F.least(F.lit(RINGS - 1), F.floor(F.col("d") * RINGS)).cast("int")
    sizes = members.groupBy("region", rings.alias("ring"), (F.col("home") == F.col("region")).alias("own")).count().toPandas()  # 2 * PIVOTS * RINGS rows at most
    plan = {}
    for region, x in sizes.groupby("region"):
        count = np.zeros((2, RINGS), dtype=np.int64)  # home points, others
        count[1 - x["own"].astype(int), x["ring"]] = x["count"]
        ringed = bool(count[0].sum() > room)
        if not ringed:
            count[:, 0] = count.sum(axis=1)
            count[:, 1:] = 0
        plan[int(region)] = (bool(count.sum() > room), ringed, np.concatenate([[0], np.cumsum(-(-count // room))]))
    cast = members.sparkSession.sparkContext.broadcast(plan)
    reach = int((1 - t + 1e-9) * RINGS) + 1

    def run(batches):
        for batch in batches:
            region, home, d, ids = (batch.column(c).to_numpy() for c in ("region", "home", "d", "set_id"))
            row, own, other = [], [], []
            for k in range(len(region)):
                cut, ringed, first = cast.value[int(region[k])]
                if not cut:
                    mine, others = 0, [0]
                else:
                    ring = min(RINGS - 1, int(d[k] * RINGS)) if ringed else 0
                    low, high = max(0, ring - reach), min(RINGS, ring + reach + 1)
                    spot = ring if home[k] == region[k] else RINGS + ring
                    mine = int(first[spot]) + int(mix(ids[k : k + 1].view(np.uint64))[0] % _U(first[spot + 1] - first[spot]))
                    others = [*range(int(first[low]), int(first[high]))]
                    if spot < RINGS:
                        others += range(int(first[RINGS + low]), int(first[RINGS + high]))
                row += [k] * len(others)
                own += [mine] * len(others)
                other += others
            own, other = np.array(own, dtype=np.int64), np.array(other, dtype=np.int64)
            out = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(x) for x in (np.minimum(own, other), np.maximum(own, other), own))], [*out.schema.names, "low", "high", "block"])

    return members.mapInArrow(run, "region int, set_id long, head long, home int, d double, grams binary, low long, high long, block long")


def _joined_regions(members: DataFrame, t: float, room: int, whole: bool) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        region, high = table["region"][0].as_py(), table["high"][0].as_py()
        ids, heads, homes, block, parts = _by_head(table, ["set_id", "head", "home", "block", "grams"])
        tally, home = Tally(ids, heads, whole), homes == region
        if table["low"][0].as_py() == high:
            for i, j, s in region_pairs(parts, home, t):
                ok = ~home[j] | (i < j)
                tally.add(np.full(ok.sum(), i), j[ok], s[ok])
            return tally.table("jaccard")
        size, other = np.array([len(p) for p in parts], dtype=np.int64), block == high
        for i, common in common_counts(parts, np.flatnonzero(~other)):  # the lower block is of home points
            j = np.flatnonzero(other & (common >= t / (1 + t) * (size + size[i]) - 1e-9))
            tally.add(np.full(len(j), i), j, common[j] / (size[j] + size[i] - common[j]))
        return tally.table("jaccard")

    return _blocks(kept(members), t, room).groupBy("region", "low", "high").applyInArrow(run, PAIRS if whole else LINKS)


# ---------------------------------------------------------------- regions of gram pivots


def gram_keys(g: np.ndarray, parts: int) -> np.ndarray:
    """The part of each gram and 32 more bits of it."""
    m = mix(g)
    return (m >> _U(32)) % _U(parts) << _U(32) | m & _U(0xFFFFFFFF)


def _order(s: np.ndarray, heavy: Lookup | None, p: int, parts: int) -> tuple[np.ndarray, int]:
    """The first p grams of a set, light ones first, and where the last stands in the order (32 bits)."""
    if heavy is not None:
        at, _ = heavy.find(gram_keys(s, parts))
        if len(at):
            light = np.ones(len(s), dtype=bool)
            light[at] = False
            own = s[light]
            if len(own) < p:
                return np.concatenate([own, s[at][: p - len(own)]]), 0xFFFFFFFF
            return own[:p], min(int(own[p - 1] >> _U(32)), 0xFFFFFFFE)
    return s[:p], min(int(s[p - 1] >> _U(32)), 0xFFFFFFFE)


#: of a point in a part: its set, its grams in all, its last window gram, the part of its first one, its grams here
_HEAD = np.dtype([("id", "<i8"), ("size", "<u4"), ("last", "<u4"), ("to", "<u2"), ("here", "<u4")])


def _windows(docs: DataFrame, n: int, t: float, rho: float, pivots, heavy: np.ndarray | None, parts: int) -> DataFrame:
    """(part, head, body): packed window grams (32 bits each) of the points without a home; without ``heavy`` the grams alone, to be counted.

    Grams of a part that are equal in 32 bits are taken for one: that can only add candidates, which are verified.
    """
    sc = docs.sparkSession.sparkContext
    cast = sc.broadcast((pivots, None if heavy is None else Lookup(heavy)))
    names = ["part", "head", "body"]

    def pack(todo, counting):
        key = gram_keys(np.concatenate([x[0] for x in todo]), parts)
        part = key >> _U(32)
        order = np.argsort(part.astype(np.uint16), kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        low = key[order].astype(np.uint32)
        own = np.flatnonzero(cut[1:] > cut[:-1])
        heads = [b""] * len(own)
        if not counting:
            doc = np.repeat(np.arange(len(todo)), [len(x[0]) for x in todo])[order]
            info = np.empty(len(todo), dtype=_HEAD)
            info["id"], info["size"], info["last"] = ([x[k] for x in todo] for k in (1, 2, 3))
            info["to"] = part[np.concatenate([[0], np.cumsum([len(x[0]) for x in todo])[:-1]])]
            for k, p in enumerate(own):
                u, here = np.unique(doc[cut[p] : cut[p + 1]], return_counts=True)
                head = info[u]
                head["here"] = here
                heads[k] = head.tobytes()
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(heads, pa.binary()), pa.array([low[cut[p] : cut[p + 1]].tobytes() for p in own], pa.binary())], names)

    def run(batches):
        pv, hv = cast.value
        todo, held, seen = [], 0, set()
        for batch in batches:
            for _, s in sets(batch.column("text"), n):
                if not len(s) or (key := set_id(s)) in seen:
                    continue
                seen.add(key)
                if pv is not None:
                    _, d = pv.distances(s)
                    if len(d) and d.min() <= rho:
                        continue
                window, last = _order(s, hv, len(s) - int(need(t, len(s))) + 1, parts)
                todo.append((window, key, len(s), last))
                held += len(window)
                if held >= _FLUSH:
                    yield pack(todo, heavy is None)
                    todo, held = [], 0
        if todo:
            yield pack(todo, heavy is None)

    return docs.mapInArrow(run, "part int, head binary, body binary")


def _heavy(windows: DataFrame, parts: int, least: int, most: int) -> np.ndarray:
    """Sorted keys of the grams that more than ``least`` points have in their windows; ``least`` is raised until they are at most ``most``."""

    def run(batches):
        by: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for p, b in zip(batch.column("part").to_pylist(), batch.column("body")):
                by.setdefault(p, []).append(np.frombuffer(b.as_buffer(), dtype=np.uint32))
        for p in sorted(by):
            g = np.sort(np.concatenate(by.pop(p))).astype(np.uint64) | _U(p << 32)
            begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            c = np.diff(np.append(begin, len(g)))
            ok = c > least
            yield pa.RecordBatch.from_arrays([pa.array(g[begin[ok]].view(np.int64)), pa.array(c[ok].astype(np.int64))], ["g", "c"])

    counts = kept(windows.repartition(parts, "part").mapInArrow(run, "g long, c long"))
    sizes = counts.groupBy("c").count().orderBy(F.desc("c")).toPandas()  # a row for each size there is
    total, cut = 0, least
    for c, k in zip(sizes["c"], sizes["count"]):
        total += k
        if total > most:
            cut = int(c)
            break
    return np.sort(counts.filter(F.col("c") > cut).select("g").toArrow().column("g").to_numpy().view(np.uint64))


def group_pairs(g: np.ndarray, doc: np.ndarray, size: np.ndarray, t: float, room: int = 1_000_000):
    """Pairs (lower, higher) of docs that share a gram, once for each gram, in bounded lots; sizes that can't match are left out."""
    order = np.lexsort((doc, g))
    g, doc = g[order], doc[order]
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(g)))
    lot, held = [], 0

    def fit(a, b):
        ok = (np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - 1e-9) & (a != b)
        return np.stack([a[ok], b[ok]])

    for c in np.unique(count[count > 1]).tolist():
        at = begin[count == c]
        step = max(1, room // (c * c))
        for low in range(0, len(at), step):
            m = doc[at[low : low + step, None] + np.arange(c)]
            rows = range(c - 1) if c > 1500 else [None]
            for i in rows:
                if i is None:
                    x, y = np.triu_indices(c, 1)
                    pair = fit(m[:, x].ravel(), m[:, y].ravel())
                else:
                    pair = fit(np.repeat(m[:, i], c - 1 - i), m[:, i + 1 :].ravel())
                lot.append(pair)
                held += pair.shape[1]
                if held >= room:
                    yield np.concatenate(lot, axis=1)
                    lot, held = [], 0
    if held:
        yield np.concatenate(lot, axis=1)


def _counted(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the sums of their counts."""
    key, to = np.unique(key, return_inverse=True)
    return key, np.bincount(to, weights=c, minlength=len(key)).astype(np.int64)


def _candidates(windows: DataFrame, parts: int, t: float) -> DataFrame:
    """(a, b), a < b, of the pairs whose common window grams leave the threshold possible.

    A pair is counted where the first window gram of its lower set belongs: near copies share it as a rule, so
    that what is told of a set is told to few parts.
    """

    def run(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for p, h, b in zip(batch.column("part").to_pylist(), batch.column("head"), batch.column("body")):
                by.setdefault(p, []).append((h.as_py(), b.as_py()))
        for p in sorted(by):
            lots = by.pop(p)
            head = np.concatenate([np.frombuffer(h, _HEAD) for h, _ in lots])
            g = np.concatenate([np.frombuffer(b, np.uint32) for _, b in lots])
            del lots
            _, one, to = np.unique(head["id"], return_index=True, return_inverse=True)
            doc, info = np.repeat(to, head["here"]), head[one]
            size, held, room = info["size"].astype(np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64)), _FLUSH
            for a, b in group_pairs(g, doc, size, t):
                new = _counted(np.minimum(a, b) * len(info) + np.maximum(a, b), np.ones(len(a)))
                held = _counted(np.concatenate([held[0], new[0]]), np.concatenate([held[1], new[1]]))
                if len(held[0]) > room:
                    yield pack(info, *held)
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(held[0]):
                yield pack(info, *held)

    def pack(info, key, c):
        a, b = key // len(info), key % len(info)
        part = info["to"][a]
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        own = np.flatnonzero(cut[1:] > cut[:-1])
        heads, bodies, kinds = [], [], []
        for k in own:
            o = order[cut[k] : cut[k + 1]]
            u, local = np.unique(np.concatenate([a[o], b[o]]), return_inverse=True)
            small = len(u) <= 65_536 and c[o].max() < 256
            heads.append(info["id"][u].tobytes() + info["size"][u].tobytes() + info["last"][u].tobytes())
            bodies.append(local.astype(np.uint16 if small else np.uint32).tobytes() + c[o].astype(np.uint8 if small else np.uint32).tobytes())
            kinds.append(small)
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(kinds, pa.bool_()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["part", "small", "head", "body"])

    def total(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for p, *x in zip(*(batch.column(c).to_pylist() for c in ("part", "small", "head", "body"))):
                by.setdefault(p, []).append(x)
        for p in sorted(by):
            ids, size, last, a, b, c, at = [], [], [], [], [], [], 0
            for small, h, x in by.pop(p):
                k, m = len(h) // 16, len(x) // (5 if small else 12)
                ids.append(np.frombuffer(h[: 8 * k], np.int64))
                size.append(np.frombuffer(h[8 * k : 12 * k], np.uint32))
                last.append(np.frombuffer(h[12 * k :], np.uint32))
                local = np.frombuffer(x, np.uint16 if small else np.uint32, 2 * m).astype(np.int64) + at
                a.append(local[:m])
                b.append(local[m:])
                c.append(np.frombuffer(x, np.uint8 if small else np.uint32, m, 4 * m if small else 8 * m))
                at += k
            ids, one, to = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
            size, last = np.concatenate(size)[one].astype(np.int64), np.concatenate(last)[one]
            pair, common = _counted(to[np.concatenate(a)] * len(ids) + to[np.concatenate(b)], np.concatenate(c))
            a, b = pair // len(ids), pair % len(ids)
            left = need(t, size) - 1  # grams after the window
            rest = np.where(last[a] < last[b], left[a], np.where(last[b] < last[a], left[b], np.maximum(left[a], left[b])))
            ok = common + rest >= t / (1 + t) * (size[a] + size[b]) - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]])], ["a", "b"])

    got = windows.repartition(parts, "part").mapInArrow(run, "part int, small boolean, head binary, body binary")
    return got.repartition(parts, "part").mapInArrow(total, "a long, b long")


def _verified(docs: DataFrame, found: DataFrame, pairs: DataFrame, n: int, t: float, whole: bool, room: int = 2_000) -> DataFrame:
    """The pairs whose whole sets pass.  Each set goes once to its component of pairs; a component of more than ``room`` sets is cut into blocks of lower partners."""
    home = kept(components(pairs))
    blocks = home.groupBy("root").agg(F.ceil(F.count("*") / room).alias("blocks"))
    home = home.join(blocks, "root").select(F.col("v").alias("a"), F.struct("root", F.expr("pmod(xxhash64(v), blocks)").alias("block")).alias("spot"))
    spots = pairs.join(home, "a").select("spot", F.explode(F.array(F.struct(F.col("a").alias("set_id"), F.lit(True).alias("own")), F.struct(F.col("b").alias("set_id"), F.lit(False).alias("own")))).alias("s"))
    spots = spots.groupBy("spot", "s.set_id").agg(F.max("s.own").alias("own")).join(found.select("set_id", "head"), "set_id")
    asked = kept(spots.groupBy(F.col("head").alias("doc_id")).agg(F.collect_list(F.struct("set_id", "spot.root", "spot.block", "own")).alias("asked")))

    def grams(batches):
        for batch in batches:
            ids, want, out = batch.column("doc_id").to_pylist(), batch.column("asked").to_pylist(), []
            for i, s in sets(batch.column("text"), n):
                if len(s):
                    key = set_id(s)
                    out += [(w["root"], w["block"], key, ids[i], w["own"], s.tobytes()) for w in want[i] if w["set_id"] == key]
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["root", "block", "set_id", "head", "own", "grams"])

    held = docs.join(small_or_shuffled(asked, ASKED), "doc_id").mapInArrow(grams, "root long, block long, set_id long, head long, own boolean, grams binary")

    def run(table: pa.Table) -> pa.Table:
        ids, heads, own, parts = _by_head(table, ["set_id", "head", "own", "grams"])
        size, tally = np.array([len(p) for p in parts]), Tally(ids, heads, whole)
        for q, common in common_counts(parts, np.flatnonzero(own)):
            s = common / (size + size[q] - common)
            j = np.flatnonzero((s >= t - 1e-12) & (ids > ids[q]))
            tally.add(np.full(len(j), q), j, s[j])
        return tally.table("jaccard")

    return held.groupBy("root", "block").applyInArrow(run, PAIRS if whole else LINKS)


# ---------------------------------------------------------------- the join


def linked(docs: DataFrame, whole: bool, n: int = GRAM, t: float = THRESHOLD, rho: float = RHO, dense: int = DENSE, heavy: int = HEAVY, parts: int | None = None, room: int = ROOM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The points, the different sets, and the pairs of sets: all of them (a, b, jaccard), or by set how many and where they lead (id, head, near, root)."""
    if rho + 1 - t >= 1:
        raise ValueError("rho must be under t")
    docs = text_documents(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    pts = kept(points(docs, n))
    found = kept(different_sets(pts))
    total = found.agg(F.sum("n")).first()[0] or 0
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(1, min(65_000, max(width, int(total * (1 - t) / 1_500_000) + 1)))
    docs = first_rows(docs, pts, found)
    pivots = _pivots(docs, found, n, dense, rho, PIVOT_GRAMS)
    told = []
    if pivots is not None:
        told.append(_joined_regions(_memberships(docs, pivots, n, t, rho), t, room, whole))
    top = _heavy(_windows(docs, n, t, rho, pivots, None, parts), parts, heavy, HEAVY_GRAMS)
    pairs = kept(_candidates(_windows(docs, n, t, rho, pivots, top, parts), parts, t))
    told.append(_verified(docs, found, pairs, n, t, whole))
    return pts, found, kept(reduce(DataFrame.union, told))


def join(docs: DataFrame, n: int = GRAM, t: float = THRESHOLD, **how) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: all pairs of different sets by the first document that holds each, and each further document of a set with its first, at 1."""
    pts, found, pairs = linked(docs, True, n, t, **how)
    first = found.select("set_id", "head")
    a, b = first.toDF("a", "doc_a"), first.toDF("b", "doc_b")
    near = pairs.join(a, "a").join(b, "b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")
    same = pts.join(first, "set_id").select(F.col("head").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.union(same).filter("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


def classes(docs: DataFrame, n: int = GRAM, t: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, class_id, links) of each document: the lowest doc_id of all that are joined with it, directly or through others, and
    its links: the other documents of its set and the other sets within reach.  A doc_id with several texts is one document with the links of all."""
    pts, found, told = linked(docs, False, n, t, **how)
    every = docs.select(docs["doc_id"].cast("long").alias("id")).filter("id IS NOT NULL")
    points = found.select(F.col("set_id").alias("id"), "head", "holders")
    return classes_of(pts.select(F.col("doc_id").alias("member"), F.col("set_id").alias("id")), points, told, every).withColumnRenamed("id", "doc_id")


def one_of_each(docs: DataFrame, n: int = GRAM, t: float = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs``, all its columns, without those whose doc_id is joined, directly or through others, with a lower one; of several rows of one doc_id (or without one) that have the same set of grams, or the same text without a word, one stays."""
    drop = classes(docs.select("doc_id", "text"), n, t, **how).filter("class_id <> doc_id").select("doc_id")
    left = docs.join(small_or_shuffled(kept(drop), REPEATS), "doc_id", "left_anti")
    again = kept(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    ids = small_or_shuffled(kept(again.filter("doc_id IS NOT NULL")), REPEATS)
    rows = left.join(ids, "doc_id", "left_semi").union(left.filter("doc_id IS NULL"))
    alone = left.join(ids, "doc_id", "left_anti").filter("doc_id IS NOT NULL")

    @F.arrow_udf("long")
    def same(text: pa.Array) -> pa.Array:
        return pa.array([set_id(s) if len(s) else None for _, s in sets(text, n)], pa.int64())

    key = same(F.col("text").cast("string"))
    marked = rows.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col("doc_id").alias("i"), F.col("text").cast("string").alias("t"), key.alias("k"))
    one = marked.groupBy("i", "k", F.when(F.col("k").isNull(), F.col("t"))).agg(F.min_by("r", F.struct("t", F.to_json("r"))).alias("r"))  # in part where rows are read
    first = one.select("r.*")
    return alone.select(docs.columns).union(first.select(docs.columns))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
