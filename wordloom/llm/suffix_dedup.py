"""Suffix-array dedup: passages of at least 50 words that stand in two documents or more.

Deep-shallow sorting orders the suffixes: multikey quicksort (three-way by the word at one depth,
all groups at once) to a shallow depth, then a blind trie for each group that is still together.  Suffixes
are compared for MIN_WORDS words; a passage of any length is the union of the repeated windows in it.

A suffix is sorted where its *anchor* is: the least hash of the 26-word grams that begin in its first
25 words.  Equal windows have equal anchors, so partitions by anchor are independent.  Only anchors that
two documents have are sorted at all, and their words travel once for all suffixes of the anchor:

    texts -> (anchor, doc) -> anchors of two documents -> join to the texts by doc_id -> words
          -> deep-shallow sort by anchor -> repeated windows -> union by document

Equal strings of an anchor travel once for each lot of a task, so a passage that a third of all documents have costs 16 bytes for each of
them.  Nothing is broadcast.  Words are told apart by 32 bits of a hash among suffixes of one 64-bit anchor.

Defined results: null, empty and short texts have no passages; rows of one doc_id count as one document,
so repeats inside it are none; rows with a null doc_id are left out; an empty table gives an empty
result; texts are searched whole; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import read, text_documents
from ._text import hash_ngrams, hashed, mix

MIN_WORDS = 50
ANCHOR = 26
#: words that multikey quicksort looks at
SHALLOW = 8
_FLUSH = 400_000
#: occurrences whose suffixes are looked at together
BLOCK = 50_000
_U = np.uint64


def anchors(h: np.ndarray, first: np.ndarray, width: int = MIN_WORDS):
    """(text, suffix position, anchor position, anchor hash) of each window of ``width`` words."""
    k = min(ANCHOR, width)
    span = width - k + 1
    g = hash_ngrams(h, k)
    if len(g) < span:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    start = np.arange(len(g) - span + 1)
    doc = np.searchsorted(first, start, side="right") - 1
    ok = start + width <= first[doc + 1]
    start, doc = start[ok], doc[ok]
    # the least of `span` values from each place, by doubling; among equal ones the first
    low, at, size = g.copy(), np.arange(len(g)), 1
    while size < span:
        step = min(size, span - size)
        better = low[step:] < low[:-step]
        low[:-step] = np.where(better, low[step:], low[:-step])
        at[:-step] = np.where(better, at[step:], at[:-step])
        size += step
    return doc, start, at[start], g[at[start]]


def _pack(key: np.ndarray, parts: int):
    part = (mix(key) >> _U(20)) % _U(parts)
    order = np.argsort(part.astype(np.uint16 if parts < 65536 else np.uint32), kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    return order, [(k, cut[k], cut[k + 1]) for k in range(parts) if cut[k] < cut[k + 1]]


def _shared_anchors(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """(doc_id, anchors): for each document those of its anchors that another document has."""

    def emit(batches):
        lot, held = [], 0

        def flush():
            key, ids = (np.concatenate([x[i] for x in lot]) for i in (0, 1))
            order, cuts = _pack(key, parts)
            key, ids = key[order], ids[order]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cuts], pa.int32()), pa.array([key[a:b].tobytes() + ids[a:b].tobytes() for _, a, b in cuts], pa.binary())], ["part", "body"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, _, _, _, first, h in hashed(batch.column("text")):
                doc, _, at, key = anchors(h, first, width)
                one = np.ones(len(at), dtype=bool)
                one[1:] = at[1:] != at[:-1]
                lot.append((key[one], ids[row + doc[one]]))
                held += int(one.sum())
                if held >= 4 * _FLUSH:
                    yield flush()
                    lot, held = [], 0
        if held:
            yield flush()

    def share(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for p, b in zip(batch.column("part").to_pylist(), batch.column("body").to_pylist()):
                by.setdefault(p, []).append(b)
        for p in sorted(by):
            bodies = by.pop(p)
            key = np.concatenate([np.frombuffer(b[: len(b) // 2], np.uint64) for b in bodies])
            ids = np.concatenate([np.frombuffer(b[len(b) // 2 :], np.int64) for b in bodies])
            order = np.lexsort((ids, key))
            key, ids = key[order], ids[order]
            one = np.ones(len(key), dtype=bool)
            one[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            key, ids = key[one], ids[one]
            two = np.zeros(len(key), dtype=bool)
            same = key[1:] == key[:-1]
            two[1:] |= same
            two[:-1] |= same
            key, ids = key[two], ids[two]
            order = np.argsort(ids, kind="stable")
            key, ids = key[order], ids[order]
            begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            end = np.append(begin[1:], len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[begin]), pa.array([key[a:b].tobytes() for a, b in zip(begin, end)], pa.binary())], ["doc_id", "anchors"])

    got = docs.mapInArrow(emit, "part int, body binary").repartition(parts, "part").mapInArrow(share, "doc_id long, anchors binary")
    return got.groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors"))


def string_ids(words: np.ndarray, key: np.ndarray, n: np.ndarray, size: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each occurrence of an anchor: of the anchor, its number of suffixes and their words in order."""
    if not len(n):
        return np.zeros(0, dtype=np.uint64)
    place = (np.arange(len(words)) - np.repeat(begin, size)).astype(np.uint64)
    return np.add.reduceat(mix(words.astype(np.uint64) + (place << _U(32))), begin) + mix(key ^ n.astype(np.uint64))


def _words(docs: DataFrame, shared: DataFrame, width: int, parts: int) -> DataFrame:
    """(part, places, strings, body): for each shared anchor of a document its suffixes' places and their words; equal strings of a lot travel once."""

    def emit(batches):
        lot, held = [], 0

        def flush():
            key, ids, low, n, size = (np.concatenate([x[i] for x in lot]) for i in range(5))
            words = np.concatenate([x[5] for x in lot])
            begin = np.cumsum(size) - size
            whole = string_ids(words, key, n, size, begin)
            _, one, to = np.unique(whole, return_index=True, return_inverse=True)
            order, cuts = _pack(key, parts)
            cols = []
            for k, a, b in cuts:
                o = order[a:b]
                strings, local = np.unique(to[o], return_inverse=True)
                f = one[strings]
                s = size[f]
                at = np.repeat(begin[f] - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(s.sum())
                places = ids[o].tobytes() + low[o].astype(np.uint32).tobytes() + local.astype(np.uint32).tobytes()
                cols.append((k, places, whole[f].tobytes() + key[f].tobytes() + n[f].astype(np.uint32).tobytes(), words[at].tobytes()))
            k, *binary = zip(*cols)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *(pa.array(c, pa.binary()) for c in binary)], ["part", "places", "strings", "body"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            have = [np.sort(np.frombuffer(b"".join(x), np.uint64)) for x in batch.column("anchors").to_pylist()]
            for row, _, _, _, first, h in hashed(batch.column("text")):
                doc, start, at, key = anchors(h, first, width)
                new = np.ones(len(at), dtype=bool)
                new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                n = np.diff(np.append(begin, len(at)))
                d, low, k = doc[begin], start[begin], key[begin]
                ok = np.zeros(len(begin), dtype=bool)
                edge = np.searchsorted(d, np.arange(len(first)))
                for i in range(len(first) - 1):
                    own = have[row + i]
                    x = k[edge[i] : edge[i + 1]]
                    if len(own) and len(x):
                        ok[edge[i] : edge[i + 1]] = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
                d, low, k, n = d[ok], low[ok], k[ok], n[ok]
                if not len(k):
                    continue
                size = n + width - 1
                take = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                lot.append((k, ids[row + d], low - first[d], n, size, (h[take] >> _U(32)).astype(np.uint32)))
                held += len(take)
                if held >= 4 * _FLUSH:
                    yield flush()
                    lot, held = [], 0
        if held:
            yield flush()

    return docs.join(shared, "doc_id").mapInArrow(emit, "part int, places binary, strings binary, body binary")


# ---------------------------------------------------------------- deep-shallow sorting


def multikey(words: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes (their places in ``words``) by group and their first ``depth`` words; (order, group of each in that order).

    A segment is split three ways by its pivot's word at the depth that it has reached: less, equal, which goes one word
    deeper, and greater.  All segments are split at once, round by round; those of one suffix drop out, those that
    have reached ``depth`` are done.
    """
    small = np.int32 if len(at) < 2**29 else np.int64
    order = np.argsort(group, kind="stable").astype(small)
    segment = group[order]
    level = np.zeros(len(order), dtype=small)
    place = np.searchsorted(segment, segment).astype(small)  # where an element's segment begins in the sorted whole
    del segment
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(place)))
        ended = np.repeat((size == 1) | (level[begin] == depth), size)
        full = np.repeat((size > 1) & (level[begin] == depth), size)
        done.append((order[full], place[full]))
        order, level, place = order[~ended], level[~ended], place[~ended]
        if not len(order):
            break
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        size = np.diff(np.append(begin, len(place)))
        word = words[at[order] + level]
        three = np.sort(np.stack([word[begin], word[begin + size // 2], word[begin + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        side = (word >= pivot).astype(np.int8) + (word > pivot)
        del word, pivot
        by = np.argsort(np.repeat(np.arange(len(begin), dtype=small), size) * small(3) + side, kind="stable")
        less, same = np.add.reduceat(side == 0, begin), np.add.reduceat(side == 1, begin)
        order, level, place, side = order[by], level[by], place[by], side[by]
        place += np.repeat(less.astype(small), size) * (side > 0)
        place += np.repeat(same.astype(small), size) * (side > 1)
        level += side == 1
    order, place = (np.concatenate(x) for x in zip(*done))
    by = np.argsort(place, kind="stable")
    return order[by], np.unique(place[by], return_inverse=True)[1]


class BlindTrie:
    """Suffixes of ``width`` words by the words where they branch; a leaf holds those that are equal."""

    def __init__(self, words: np.ndarray, width: int):
        self.words, self.width, self.root = words, width, None

    def insert(self, at: int) -> None:
        if self.root is None:
            self.root = [at]
            return
        words, node = self.words, self.root
        while isinstance(node, tuple):  # blind: only the branching words are looked at
            kids = node[1]
            node = kids.get(int(words[at + node[0]])) or next(iter(kids.values()))
        other = node[0]
        differ = np.flatnonzero(words[at : at + self.width] != words[other : other + self.width])
        if not len(differ):
            node.append(at)
            return
        lcp, above, node = int(differ[0]), None, self.root
        while isinstance(node, tuple) and node[0] < lcp:
            above, node = node, node[1][int(words[at + node[0]])]
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][int(words[at + lcp])] = [at]
            return
        fork = (lcp, {int(words[other + lcp]): node, int(words[at + lcp]): [at]})
        if above is None:
            self.root = fork
        else:
            above[1][int(words[at + above[0]])] = fork

    def leaves(self):
        """The groups of equal suffixes, in order."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][w] for w in sorted(node[1], reverse=True)]
            else:
                yield node


def equal_suffixes(words: np.ndarray, at: np.ndarray, group: np.ndarray, width: int) -> list[np.ndarray]:
    """Indexes into ``at`` of each set of two or more suffixes of a group whose first ``width`` words are equal, in order."""
    order, group = multikey(words, at, group, min(SHALLOW, width))
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(group)))
    out = []
    two = begin[size == 2]  # a trie of two leaves is one comparison
    for low in range(0, len(two), 20_000):
        i, j = order[two[low : low + 20_000]], order[two[low : low + 20_000] + 1]
        same = (words[at[i, None] + np.arange(width)] == words[at[j, None] + np.arange(width)]).all(axis=1)
        out += list(np.stack([i[same], j[same]], axis=1))
    for b, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
        own = order[b : b + n]
        places: dict[int, list] = {}
        trie = BlindTrie(words, width)
        for x in own.tolist():
            p = int(at[x])
            if p in places:
                places[p].append(x)
            else:
                places[p] = [x]
                trie.insert(p)
        for leaf in trie.leaves():
            hit = [x for p in leaf for x in places[p]]
            if len(hit) > 1:
                out.append(np.array(hit))
    return out


def runs_of(ids, low, n, suffix, lowest, highest, runner) -> pa.RecordBatch:
    """(doc_id, low, high, other) of occurrences of ``n`` suffixes from position ``low``, the first of which is ``suffix``: runs that other documents have."""
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    src, doc, pos = np.repeat(suffix, n) + step, np.repeat(ids, n), np.repeat(low, n) + step
    other = np.where(lowest[src] != doc, lowest[src], runner[src])
    hit = lowest[src] != highest[src]
    doc, pos, other = doc[hit], pos[hit], other[hit]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (other[1:] != other[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(pos[begin]), pa.array(pos[end] if len(doc) else pos), pa.array(other[begin])], ["doc_id", "low", "high", "other"])


def _repeated(words: DataFrame, width: int, parts: int) -> DataFrame:
    """(doc_id, low, high, other): runs of suffix positions whose windows another document has, and the least such document."""

    def run(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for p, *x in zip(*(batch.column(c).to_pylist() for c in ("part", "places", "strings", "body"))):
                by.setdefault(p, []).append(x)
        for p in sorted(by):
            places, strings, w, at = [], [], [], 0
            for x, q, b in by.pop(p):
                m, k = len(x) // 16, len(q) // 20
                places.append((np.frombuffer(x[: 8 * m], np.int64), np.frombuffer(x[8 * m : 12 * m], np.uint32), np.frombuffer(x[12 * m :], np.uint32).astype(np.int64) + at))
                strings.append((np.frombuffer(q[: 8 * k], np.uint64), np.frombuffer(q[8 * k : 16 * k], np.uint64), np.frombuffer(q[16 * k :], np.uint32)))
                w.append(np.frombuffer(b, np.uint32))
                at += k
            ids, low, local = (np.concatenate([x[i] for x in places]) for i in range(3))
            whole, key, n = (np.concatenate([x[i] for x in strings]) for i in range(3))
            w, low, n = np.concatenate(w), low.astype(np.int64), n.astype(np.int64)
            size = n + width - 1
            begin = np.cumsum(size) - size
            # occurrences with the same words throughout are one string to sort
            _, one, to = np.unique(whole, return_index=True, return_inverse=True)
            to = to[local]
            order = np.lexsort((ids, to))
            t, i = to[order], ids[order]
            least, most = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
            edge = np.searchsorted(t, np.arange(len(one)))
            if len(one):
                least, most = i[edge], i[np.append(edge[1:], len(i)) - 1]
            second = np.full(len(one), -1, dtype=np.int64)  # index of the least id over the least
            bigger = np.flatnonzero(i != least[t]) if len(t) else np.zeros(0, np.int64)
            u, f = np.unique(t[bigger], return_index=True)
            second[u] = bigger[f]
            # suffixes of the different strings
            at = np.repeat(begin[one], n[one]) + (np.arange(n[one].sum()) - np.repeat(np.cumsum(n[one]) - n[one], n[one]))
            owner = np.repeat(np.arange(len(one)), n[one])
            _, group = np.unique(key[one][owner], return_inverse=True)
            lowest, highest = least[owner].copy(), most[owner].copy()
            runner = np.where(second[owner] >= 0, i[np.maximum(second[owner], 0)] if len(i) else 0, np.iinfo(np.int64).max)
            for own in equal_suffixes(w, at, group, width):
                every = np.concatenate([lowest[own], runner[own]])
                a = lowest[own].min()
                more = every[(every > a) & (every != np.iinfo(np.int64).max)]
                lowest[own], highest[own] = a, highest[own].max()
                runner[own] = more.min() if len(more) else np.iinfo(np.int64).max
            # back to the occurrences
            first_suffix = np.cumsum(n[one]) - n[one]
            for k in range(0, len(to), BLOCK):
                yield runs_of(ids[k : k + BLOCK], low[k : k + BLOCK], n[one][to[k : k + BLOCK]], first_suffix[to[k : k + BLOCK]], lowest, highest, runner)

    return words.repartition(parts, "part").mapInArrow(run, "doc_id long, low long, high long, other long")


def passages(docs: DataFrame, width: int = MIN_WORDS, parts: int | None = None) -> DataFrame:
    """(doc_id, first_word, words, other_doc_id): the maximal runs of words covered by windows of ``width`` words that other documents have too; other_doc_id is the least document that has a window of the run."""
    docs = text_documents(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    if parts is None:
        spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, min(65_000, max(spread, size // 24_000_000 + 1)))
    shared = _shared_anchors(docs, width, parts)
    runs = _repeated(_words(docs, shared, width, parts), width, parts)
    w = Window.partitionBy("doc_id").orderBy("low", "high")
    end = F.max(F.col("high") + width).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(F.col("low") <= end, 0).otherwise(1))
    runs = runs.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("doc_id", "k").agg(F.min("low").alias("first_word"), (F.max("high") + width - F.min("low")).alias("words"), F.min("other").alias("other_doc_id"))
    return out.drop("k")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"))
