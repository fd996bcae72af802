"""Quality classifier: histogram gradient-boosted trees over document statistics.

``features`` turns each text into a fixed vector of statistics with vectorised
byte and word counts.  Two classifiers (low quality, toxic) are trained on the
driver from at most ``max_train`` labelled rows (those of lowest hash of doc_id:
a documented bound; everything else covers all data).  One statistic is the
share of words in a lexicon, which is itself fitted on those labelled rows: the
LEXICON_WORDS words and word beginnings that tell most of those whose document frequency is far higher among positives.  Trained trees
are flattened into arrays (feature, bin threshold, left child, leaf value) that
whole batches of documents traverse together in numpy.

Defined results: a null or empty text has all statistics 0, both scores null and is
not kept; repeated rows are scored alike; an empty table gives an empty result; a
document labelled twice counts with its lowest quality and highest toxicity; labels
that are null are not trained on; without labels of both kinds a score is 0 (nothing
is rejected).  A row without a doc_id is scored like any other, a label without one is not used.  Whole texts are read
whatever their length; other columns are not looked at, and :func:`kept_documents` returns them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import kept, read, text_documents
from ._text import chunks, fold, hash_words, hashed, mix, word_bounds

#: labelled rows that are trained on, at most
MAX_TRAIN = 20_000
LEXICON_WORDS = 128
N_BINS = 64

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence end, 7 comma-like, 8 high byte
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 32, 13]], _CLASS[10] = 4, 5
_CLASS[[33, 46, 63]], _CLASS[[44, 45, 39, 58, 59, 34, 40, 41]] = 6, 7
_CLASS[128:] = 8
_CLASSES = 9
#: statistics, in order
NAMES = (
    ["log_bytes", "log_words", "word_bytes", "long_words", "distinct", "top_word", "repeat_word", "lines_per_word", "bare_words", "bang", "pipe"]
    + [f"share_{c}" for c in ("symbol", "lower", "upper", "digit", "space", "newline", "stop", "comma", "high")]
    + ["repeat_line", "lexicon_low", "lexicon_toxic"]
)
_LONG = 24
#: the lexicon holds words, and word beginnings of so many bytes
PREFIXES = (5, 6, 7, 8)


def word_keys(folded: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray):
    """(index of the word, key) of each word and of its beginnings."""
    yield np.arange(len(h)), h
    for size in PREFIXES:
        own = np.flatnonzero(end - start > size)
        yield own, mix(hash_words(folded, start[own], start[own] + size) ^ np.uint64(size))


def statistics(arr, lexicons: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of NAMES for each text."""
    out = np.zeros((len(arr), len(NAMES)), dtype=np.float32)
    for row, offsets, data in chunks(arr):
        n = len(offsets) - 1
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        by_class = np.bincount(doc * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float64)
        bang = np.bincount(doc[data == 33], minlength=n)
        pipe = np.bincount(doc[data == 124], minlength=n)
        folded = fold(data)
        start, end, first = word_bounds(folded, offsets)
        h = hash_words(folded, start, end)
        words = np.diff(first)
        wdoc = np.repeat(np.arange(n), words)
        length = (end - start).astype(np.float64)
        total = np.maximum(words, 1)
        order = np.lexsort((h, wdoc))
        hs, ds = h[order], wdoc[order]
        new = np.ones(len(hs), dtype=bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        distinct = np.bincount(ds[new], minlength=n)
        runs = np.diff(np.append(np.flatnonzero(new), len(hs)))
        top = np.zeros(n)
        np.maximum.at(top, ds[new], runs)
        again = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
        f = out[row : row + n]
        f[:, 0], f[:, 1] = np.log1p(size), np.log1p(words)
        f[:, 2] = np.bincount(wdoc, weights=length, minlength=n) / total
        f[:, 3] = np.bincount(wdoc[length > _LONG], minlength=n) / total
        f[:, 4], f[:, 5] = distinct / total, top / total
        f[:, 6] = np.bincount(wdoc[1:][again], minlength=n) / total
        f[:, 7] = by_class[:, 5] / total
        f[:, 8] = np.bincount(wdoc[length <= 2], minlength=n) / total
        f[:, 9], f[:, 10] = bang / total, pipe / total
        f[:, 11 : 11 + _CLASSES] = by_class / np.maximum(size, 1)[:, None]
        at = np.flatnonzero(data == 10)  # a line is the words between two line feeds
        line = np.searchsorted(at, start)
        if len(h):
            edge = np.ones(len(h), dtype=bool)
            edge[1:] = (line[1:] != line[:-1]) | (wdoc[1:] != wdoc[:-1])
            begin = np.flatnonzero(edge)
            lh, ld = np.add.reduceat(h * (np.uint64(2) * (np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))).astype(np.uint64) + np.uint64(1)), begin), wdoc[begin]
            o = np.lexsort((lh, ld))
            dup = (lh[o][1:] == lh[o][:-1]) & (ld[o][1:] == ld[o][:-1])
            f[:, 20] = np.bincount(ld[o][1:][dup], minlength=n) / np.maximum(np.bincount(ld, minlength=n), 1)
        hit = [np.zeros(len(h), dtype=bool) for _ in lexicons]
        for own, keys in word_keys(folded, start, end, h):
            for k, lexicon in enumerate(lexicons):
                if len(lexicon):
                    at = np.minimum(np.searchsorted(lexicon, keys), len(lexicon) - 1)
                    hit[k][own[lexicon[at] == keys]] = True
        for k in range(len(lexicons)):
            f[:, 21 + k] = np.bincount(wdoc[hit[k]], minlength=n) / total
    return out


# ---------------------------------------------------------------- training


@dataclass
class Trees:
    """Boosted trees in arrays; a leaf's children are itself."""

    edges: list[np.ndarray] = field(default_factory=list)
    feature: np.ndarray | None = None  # trees x nodes
    threshold: np.ndarray | None = None
    left: np.ndarray | None = None
    value: np.ndarray | None = None
    base: float = 0.0
    depth: int = 0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros(x.shape, np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of each row: all trees and all rows step down together."""
        if self.feature is None:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        b = self.bins(x)
        t = np.arange(len(self.feature))
        node = np.zeros((len(x), len(t)), dtype=np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = self.left[t, node]
            right = b[rows, self.feature[t, node]] > self.threshold[t, node]
            node = np.where(go == node, node, go + right)
        return 1 / (1 + np.exp(-(self.base + self.value[t, node].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: int = 10) -> Trees:
    """Gradient-boosted trees on binned features; splits maximise the second-order gain of the log loss, ties by lowest feature and bin."""
    model = Trees(depth=depth)
    if not len(y) or y.min() == y.max():
        model.base = -20.0 if not len(y) or y.max() == 0 else 20.0
        return model
    q = np.linspace(0, 1, N_BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], q, method="lower")) for j in range(x.shape[1])]
    b = model.bins(x).astype(np.int64)
    n, m = b.shape
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    model.feature, model.threshold = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    model.left, model.value = np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.zeros(shape)
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model.base = float(np.log(p0 / (1 - p0)))
    score = np.full(n, model.base)
    flat = b + np.arange(m) * N_BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node, free, level = np.zeros(n, dtype=np.int64), 1, [0]
        for _ in range(depth):
            following = []
            for k in level:
                own = np.flatnonzero(node == k)
                if len(own) < 2 * least:
                    continue
                cells = flat[own].ravel()
                hist = [np.bincount(cells, weights=np.repeat(w[own], m), minlength=m * N_BINS).reshape(m, N_BINS).cumsum(axis=1) for w in (g, h)]
                count = np.bincount(cells, minlength=m * N_BINS).reshape(m, N_BINS).cumsum(axis=1)
                G, H = g[own].sum(), h[own].sum()
                gain = hist[0] ** 2 / (hist[1] + l2) + (G - hist[0]) ** 2 / (H - hist[1] + l2) - G * G / (H + l2)
                gain[(count < least) | (len(own) - count < least)] = -1
                j, c = divmod(int(gain.argmax()), N_BINS)
                if gain[j, c] <= 1e-6:
                    continue
                model.feature[t, k], model.threshold[t, k], model.left[t, k] = j, c, free
                node[own] = free + (b[own, j] > c)
                following += [free, free + 1]
                free += 2
            level = following
        G, H = np.bincount(node, weights=g, minlength=nodes), np.bincount(node, weights=h, minlength=nodes)
        model.value[t] = -rate * G / (H + l2)
        score += model.value[t][node]
    return model


@dataclass
class Model:
    lexicons: tuple[np.ndarray, np.ndarray]
    low: Trees
    toxic: Trees

    def score(self, arr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low-quality score, toxicity score, empty) of each text."""
        low, toxic, empty = (np.zeros(len(arr)) for _ in range(3))
        for at in range(0, len(arr), 2048):
            x = statistics(arr[at : at + 2048], self.lexicons)
            low[at : at + len(x)], toxic[at : at + len(x)], empty[at : at + len(x)] = self.low.predict(x), self.toxic.predict(x), x[:, 0] == 0
        return low, toxic, empty.astype(bool)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Train both classifiers on at most ``max_train`` labelled documents."""
    labelled = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("q").alias("q"), F.max("t").alias("t"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    text = kept(text_documents(docs).join(F.broadcast(labelled), "doc_id"))  # at most max_train rows, read from documents once

    def words(batches):
        for batch in batches:
            texts = batch.column("text")
            q, t = batch.column("q").to_numpy(), batch.column("t").to_numpy()
            keep = []
            for _, folded, start, end, first, h in hashed(texts):
                parts = list(word_keys(folded, start, end, h))
                at, keys = np.concatenate([a for a, _ in parts]), np.concatenate([k for _, k in parts])
                doc = np.searchsorted(first, at, side="right") - 1
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(1, len(first) - 1))
                keep += [np.unique(k) for k in np.split(keys[order], cut)][: len(first) - 1]
            size = [len(k) for k in keep]
            h = np.concatenate([*keep, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(q, size).astype(np.int32)), pa.array(np.repeat(t, size).astype(np.int32))], ["h", "q", "t"])

    sizes = text.agg(F.count("*").alias("n"), F.sum(1 - F.col("q")).alias("low"), F.sum("t").alias("toxic")).first()
    df = kept(text.mapInArrow(words, "h long, q int, t int").groupBy("h").agg(F.count("*").alias("n"), F.sum(1 - F.col("q")).alias("low"), F.sum("t").alias("toxic")).filter("low >= 5 OR toxic >= 5"))
    lexicons = []
    for kind in ("low", "toxic"):
        pos, neg = sizes[kind] or 0, sizes["n"] - (sizes[kind] or 0)
        p, q = (F.col(kind) + 0.5) / (pos + 1), (F.col("n") - F.col(kind) + 0.5) / (neg + 1)
        top = df.filter((F.col(kind) >= max(5, 0.01 * pos)) & (p > 8 * q)).orderBy((F.log(p / q) * F.col(kind)).desc(), "h").limit(LEXICON_WORDS).select("h")
        lexicons.append(np.sort(np.array([r.h for r in top.collect()], dtype=np.int64).view(np.uint64)))
    lexicons = tuple(lexicons)

    def stats(batches):
        for batch in batches:
            x = statistics(batch.column("text"), lexicons)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("q"), batch.column("t"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))], ["doc_id", "q", "t", "x"])

    rows = text.mapInArrow(stats, "doc_id long, q int, t int, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float32).reshape(len(rows), len(NAMES))
    return Model(lexicons, train(x, 1.0 - rows["q"].to_numpy(dtype=float)), train(x, rows["t"].to_numpy(dtype=float)))


def scorer(model: Model):
    """A column function text -> struct(low, toxic, keep)."""

    @F.arrow_udf("struct<low: double, toxic: double, keep: boolean>")
    def score(text: pa.Array) -> pa.Array:
        low, toxic, empty = model.score(text)
        keep = (low < 0.5) & (toxic < 0.5) & ~empty
        return pa.StructArray.from_arrays([pa.array(low, mask=empty), pa.array(toxic, mask=empty), pa.array(keep)], ["low", "toxic", "keep"])

    return score


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, low_quality, toxic, keep) of each row of ``docs``."""
    score = scorer(fit(docs, labels, max_train))
    s = text_documents(docs).select("doc_id", score("text").alias("s"))
    return s.select("doc_id", F.round("s.low", 6).alias("low_quality"), F.round("s.toxic", 6).alias("toxic"), F.col("s.keep").alias("keep"))


def kept_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs``, all its columns, that are not rejected."""
    score = scorer(fit(docs, labels, max_train))
    return docs.filter(score(docs["text"].cast("string"))["keep"])


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
