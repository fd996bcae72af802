"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit verification.

A document leaks an item of L words if some run of its words is within ``floor(EDIT * L)``
word edits (insert, delete, substitute) of the item.

1. *Windows.*  An item-sized window can only match if it has the q-grams that the
   pigeonhole principle leaves untouched by k edits: one exact run of
   ``ceil((L - k) / (k + 1))`` words, and ``L - q + 1 - k q`` q-grams within k diagonals.  All
   windows of all documents are held against this; it loses no match, and only the windows that pass are embedded (embedding
   all windows of each item length would take some thousand times the time).
2. *CGK random walks* map each window and item to strings of which the Hamming
   distance follows the edit distance: at step j the walk writes the word it is on, and goes on
   if a random function of (j, word) says so.
3. *Bit sampling.*  Each of R walks is sampled at a few steps; a window looks its R signatures up in the buckets of the items of its
   length, and all items that it finds are candidates.  R is set for each item length so that
   items with the most edits allowed, of one kind or mixed, collide at one of their windows with
   probability TARGET (measured on a sample of at most TRIALS items of the length, fixed seed, a miss counted as a miss).  Where
   WALKS_MOST walks do not reach it, and over
   LONGEST words, nothing is sampled: all windows that pass 1 are candidates.
4. *Verification.*  Bit-parallel edit distance of the item to the best run around the window.

Defined results: null, empty and wordless texts leak nothing; items without words and
items with a null id or text are not searched; an empty table gives an empty result (documents)
or one without leaks (benchmark); repeated rows are each reported; of several matches of
an item in a document the nearest, then the first, is given; texts are searched whole; other columns
play no part.  ``item_id`` ties do not matter: every item is searched for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import kept, read, text_documents
from ._text import hash_ngrams, hashed, mix
from .jaccard import Lookup

EDIT = 0.2
TARGET = 0.99
SAMPLES = 2
WALKS_MOST = 64
#: words of the longest items that are sampled; longer ones would take more walks than verifying their windows costs
LONGEST = 64
#: trials of each kind of edit and item length
TRIALS = 100
#: items, and bytes of their texts, that are broadcast and held in a worker at once, about; more are searched in so many passes
ITEMS_AT_ONCE, BYTES_AT_ONCE = 100_000, 64_000_000
_U = np.uint64
_PAD = _U(0x5851F42D4C957F2D)


def allowed(length: int) -> int:
    return int(EDIT * length + 1e-9)


class Walks:
    """R random walks, each sampled at SAMPLES of its steps."""

    def __init__(self, walks: int = WALKS_MOST, samples: int = SAMPLES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.walks = walks
        self.at = rng.random((walks, samples))
        self.key = rng.integers(1, 2**63, walks, dtype=np.uint64)

    def first(self, n: int) -> Walks:
        """Only the first n of these walks."""
        out = Walks(0)
        out.walks, out.at, out.key = n, self.at[:n], self.key[:n]
        return out

    def signatures(self, windows: np.ndarray) -> np.ndarray:
        """rows x walks: hashes of the sampled words of windows of one length."""
        rows, length = windows.shape
        at = np.sort((self.at * 2 * length).astype(np.int64), axis=1)
        padded = np.concatenate([windows, np.full((rows, 1), _PAD)], axis=1)
        where = np.zeros((rows, self.walks), dtype=np.int64)
        out = np.zeros((rows, self.walks), dtype=np.uint64)
        row = np.arange(rows)[:, None]
        for j in range(int(at.max()) + 1):
            word = padded[row, where]
            for hit in (at == j).T:
                out[:, hit] = mix(out[:, hit] * _U(31) + word[:, hit])
            go = mix(word ^ (self.key + _U(j * 0x9E3779B1))) & _U(1)
            where = np.minimum(where + go.astype(np.int64), length)
        return out


def edited(words: np.ndarray, k: int, rng, kinds=(0, 1, 2)) -> list:
    """``words`` after k random edits of the kinds: 0 substitutes, 1 inserts, 2 deletes."""
    w = list(words)
    for _ in range(k):
        kind, at = kinds[rng.integers(len(kinds))], int(rng.integers(len(w)))
        new = _U(rng.integers(1, 2**63))
        if kind == 0:
            w[at] = new
        elif kind == 1:
            w.insert(at, new)
        elif len(w) > 1:
            del w[at]
    return w


def edit(words: np.ndarray, k: int, rng) -> np.ndarray:
    """``words`` after k random edits, cut or filled to its length."""
    w = edited(words, k, rng)
    w += [_U(rng.integers(1, 2**63)) for _ in range(len(words) - len(w))]
    return np.array(w[: len(words)], dtype=np.uint64)


def walks_needed(items: list[np.ndarray], target: float = TARGET, trials: int = TRIALS) -> int | None:
    """Twice the walks after which ``target`` of the edited items of one length have collided with their item, for each kind of edit; None if WALKS_MOST are too few.

    Twice, as the share is known from few trials only.
    """
    index, length, k = Index(list(range(len(items))), items, exhaustive=True), len(items[0]), allowed(len(items[0]))
    walks, rng, most = Walks(), np.random.default_rng([11, length]), 1
    signed = walks.signatures(np.stack(items))
    for kinds in ((2,), (1,), (0,), (0, 1, 2)):
        texts, own = [], np.arange(trials) % len(items)
        for i in own:
            around = rng.integers(1, 2**63, (2, length), dtype=np.uint64)
            texts.append(np.concatenate([around[0], np.array(edited(items[i], k, rng, kinds), dtype=np.uint64), around[1]]))
        h, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        doc, item, diag = index.windows(h, first)
        mine = item == own[doc]
        doc, item, diag = doc[mine], item[mine], diag[mine]
        same = walks.signatures(cut_windows(h, first, doc, diag, length)) == signed[item]
        after = np.full(trials, WALKS_MOST + 1)
        np.minimum.at(after, doc, np.where(same.any(axis=1), same.argmax(axis=1) + 1, WALKS_MOST + 1))
        most = max(most, int(np.sort(after)[min(trials - 1, int(np.ceil(target * trials)))]))
        if 2 * most > WALKS_MOST:
            return None
    return 2 * most


def calibrated(items: list[np.ndarray], target: float = TARGET, trials: int = TRIALS) -> int:
    """The most walks that any length of the items needs; WALKS_MOST if one of them needs more."""
    lengths: dict = {}
    for w in items:
        lengths.setdefault(len(w), []).append(w)
    return max(walks_needed(x[:trials], target, trials) or WALKS_MOST for x in lengths.values())


def cut_windows(h: np.ndarray, first: np.ndarray, doc: np.ndarray, diag: np.ndarray, length: int) -> np.ndarray:
    """The words of windows of one length; those outside the window's text are padding."""
    at = diag[:, None] + np.arange(length)
    inside = (at >= first[doc][:, None]) & (at < first[doc + 1][:, None])
    return np.where(inside, h[np.clip(at, 0, len(h) - 1)], _PAD)


def best_run(item: dict, length: int, text: list, k: int) -> tuple[int, int] | None:
    """(distance, end) of the run of ``text`` nearest to an item given as word -> bits of its places; None if over k."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    pv, mv, score, best = full, 0, length, (k + 1, 0)
    for at, w in enumerate(text):
        eq = item.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best[0]:
            best = (score, at + 1)
    return best if best[0] <= k else None


class Index:
    """The items of a pass: their grams by size, signatures and bit patterns."""

    def __init__(self, ids: list[int], items: list[np.ndarray], exhaustive: bool = False):
        self.ids, self.items = ids, items
        self.length = np.array([len(w) for w in items], dtype=np.int64)
        self.k = np.array([allowed(len(w)) for w in items], dtype=np.int64)
        self.q = -(-(self.length - self.k) // (self.k + 1))
        self.least = np.maximum(1, self.length - self.q + 1 - self.k * self.q)
        #: walks by item length; windows of items of other lengths are not sampled
        self.walks = {}
        #: items by bucket: one table of the signatures of all walks, by item length
        self.buckets = {}
        self.bits = []
        for w in items:
            b: dict = {}
            for i, x in enumerate(w.tolist()):
                b[x] = b.get(x, 0) | 1 << i
            self.bits.append(b)
        if not exhaustive:
            every = Walks()
            for length in np.unique(self.length[self.length <= LONGEST]).tolist():
                own = np.flatnonzero(self.length == length)
                need = walks_needed([items[i] for i in own[:TRIALS]])
                if need is None:
                    continue
                walks = self.walks[length] = every.first(need)
                key = self.buckets_of(walks.signatures(np.stack([items[i] for i in own])))
                item = np.repeat(own, walks.walks)
                order = np.argsort(key.ravel(), kind="stable")
                keys, begin, count = np.unique(key.ravel()[order], return_index=True, return_counts=True)
                self.buckets[length] = (Lookup(keys), begin, count, item[order])
        self.grams = {}
        for q in np.unique(self.q).tolist():
            own = np.flatnonzero(self.q == q)
            g = [hash_ngrams(items[i], q) for i in own]
            item, off = np.repeat(own, [len(x) for x in g]), np.concatenate([np.arange(len(x)) for x in g])
            every = np.concatenate(g)
            order = np.argsort(every, kind="stable")
            keys, begin, count = np.unique(every[order], return_index=True, return_counts=True)
            self.grams[q] = (Lookup(keys), begin, count, item[order], off[order])

    def windows(self, h: np.ndarray, first: np.ndarray):
        """(text, item, diagonal from the chunk's start) of the windows that pass the gram counts."""
        out = []
        for q, (lookup, begin, count, item, off) in self.grams.items():
            pos, k = lookup.find(hash_ngrams(h, q))
            if not len(pos):
                continue
            doc = np.searchsorted(first, pos, side="right") - 1
            ok = pos + q <= first[doc + 1]
            pos, k, doc = pos[ok], k[ok], doc[ok]
            c = count[k]
            at = np.repeat(begin[k] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            i, diag, doc = item[at], np.repeat(pos, c) - off[at], np.repeat(doc, c)
            order = np.lexsort((diag, i, doc))
            i, diag, doc = i[order], diag[order], doc[order]
            new = np.ones(len(i), dtype=bool)
            new[1:] = (i[1:] != i[:-1]) | (doc[1:] != doc[:-1])
            band = (np.cumsum(new) - 1) * (4 * len(h) + 4096) + diag + len(h)  # diagonals of one text and item are near each other only
            reach = self.k[i]
            near = np.searchsorted(band, band + reach, side="right") - np.searchsorted(band, band - reach, side="left")
            keep = near >= self.least[i]
            keep[1:] &= (band[1:] != band[:-1]) | ~keep[:-1]
            out.append((doc[keep], i[keep], diag[keep]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    @staticmethod
    def buckets_of(signatures: np.ndarray) -> np.ndarray:
        """A bucket for each walk and signature."""
        return mix(signatures ^ mix(np.arange(1, signatures.shape[1] + 1, dtype=np.uint64)))

    def candidates(self, h: np.ndarray, first: np.ndarray, doc, item, diag) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, diagonal), in that order: what the windows find in the buckets of their length; those of lengths that are not sampled keep the item whose grams they have."""
        length = self.length[item]
        plain = ~np.isin(length, list(self.walks))
        out = [(doc[plain], item[plain], diag[plain])]
        for n in np.unique(length[~plain]).tolist():
            own = length == n
            w = np.unique(np.stack([doc[own], diag[own]], axis=1), axis=0)
            lookup, begin, count, items = self.buckets[n]
            for low in range(0, len(w), 4096):
                part = w[low : low + 4096]
                key = self.buckets_of(self.walks[n].signatures(cut_windows(h, first, part[:, 0], part[:, 1], n)))
                at, k = lookup.find(key.ravel())
                c = count[k]
                hit = items[np.repeat(begin[k] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())] if len(k) else k
                at = np.repeat(at // key.shape[1], c)
                out.append((part[at, 0], hit, part[at, 1]))
        found = np.unique(np.stack([np.concatenate(x) for x in zip(*out)], axis=1), axis=0)
        return found[:, 0], found[:, 1], found[:, 2]

    def matches(self, arr):
        """(row, item, edits, first word, words) of the best match of each text and item."""
        for row, _, _, _, first, h in hashed(arr):
            doc, item, diag = self.candidates(h, first, *self.windows(h, first))
            best: dict = {}
            words: dict = {}
            done: dict = {}
            for d, i, s in zip(doc.tolist(), item.tolist(), diag.tolist()):
                k, length = int(self.k[i]), int(self.length[i])
                if s <= done.get((d, i), -(2**62)):  # the run around an earlier window holds this one's
                    continue
                low, high = max(int(first[d]), s - 2 * k), min(int(first[d + 1]), s + length + 4 * k)
                done[d, i] = s + 2 * k
                if d not in words:
                    words = {d: h[first[d] : first[d + 1]].tolist()}
                text = words[d][low - int(first[d]) : high - int(first[d])]
                m = best_run(self.bits[i], length, text, k)
                if m:
                    key = (m[0], low + m[1] - int(first[d]))
                    best[d, i] = min(best.get((d, i), key), key)
            for (d, i), (edits, end) in best.items():
                yield row + d, i, edits, max(0, end - int(self.length[i])), int(self.length[i])


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", exhaustive: bool = False):
    """The indexes of the passes, one after the other; a pass has about ITEMS_AT_ONCE items and BYTES_AT_ONCE bytes of text."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).dropna().distinct()
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    passes = max(1, -(-size["n"] // ITEMS_AT_ONCE), -(-(size["b"] or 0) // BYTES_AT_ONCE))
    for k in range(passes):
        own = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).orderBy("i", "t").toArrow()
        ids, items = [], []
        for row, _, _, _, first, h in hashed(own.column("t")):
            for j in range(len(first) - 1):
                if first[j + 1] > first[j]:
                    ids.append(own.column("i")[row + j].as_py())
                    items.append(h[first[j] : first[j + 1]])
        yield k == passes - 1, Index(ids, items, exhaustive)


def leaks(docs: DataFrame, benchmark: DataFrame, exhaustive: bool = False) -> DataFrame:
    """(doc_id, item_id, edits, first_word, words) for each document and item it leaks; ``exhaustive`` skips the sampling.  A pass is one broadcast and one job."""
    docs, out = text_documents(docs), None
    for last, index in indexes(benchmark, exhaustive=exhaustive):
        cast = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, cast=cast):
            ix = cast.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[r], ix.ids[i], e, s, n) for r, i, e, s, n in ix.matches(batch.column("text"))]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "edits", "first_word", "words"])

        found = docs.mapInArrow(run, "doc_id long, item_id long, edits long, first_word long, words long")
        found = found if last else kept(found)
        out = found if out is None else out.union(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all its columns, that leak no item.  A pass is one broadcast and one job."""
    for last, index in indexes(benchmark):
        cast = docs.sparkSession.sparkContext.broadcast(index)

        docs = docs.filter(_clean(cast)(docs["text"].cast("string")))
        docs = docs if last else kept(docs)
    return docs


def _clean(cast):
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        ok = np.ones(len(text), dtype=bool)
        for r, *_ in cast.value.matches(text):
            ok[r] = False
        return pa.array(ok)

    return clean


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
