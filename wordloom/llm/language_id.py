"""Language ID by multilingual mixture inference.

Each language has a hashed byte-trigram model, trained on at most MAX_TRAIN labelled
documents (those of lowest hash of doc_id: a documented bound; inference covers every document and
whole texts).  A word's likelihood in a language is that of its trigrams.  A document is a
mixture: its words are drawn from languages in unknown shares, which expectation-maximisation
estimates, round by round until no share moves by TOLERANCE.  The set of languages is selected by penalised likelihood: from all languages, the one of
least share is dropped, the rest fitted again, down to one; the set with the best ``log likelihood - PENALTY / 2
* log(words) * languages`` stays.

Defined results: null, empty and wordless texts have no language (null) and no shares; rows with a
null label are scored but not trained on; repeated rows are scored alike; without any label every language is null;
a row without a doc_id is scored and not trained on; an empty table gives an empty result; of equal shares the language first by name leads; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import read
from ._text import chunks, fold, word_bounds

MAX_TRAIN = 4_000
BUCKETS = 1 << 15
PENALTY = 4.0
#: rounds of expectation-maximisation end where no share moves by more than TOLERANCE, or at ROUNDS
TOLERANCE, ROUNDS = 1e-4, 500
#: pseudo counts of a trigram bucket
SMOOTH = 0.2


def gram_ids(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each word, its edges marked, one for each of its bytes; and the first of each word."""
    size = end - start
    begin = np.cumsum(size) - size
    at = np.repeat(start - begin, size) + np.arange(size.sum())
    b = folded[at].astype(np.uint32)
    left = np.where(np.arange(len(at)) == np.repeat(begin, size), np.uint32(1), folded[at - 1].astype(np.uint32))
    last = np.repeat(begin + size - 1, size)
    right = np.where(np.arange(len(at)) == last, np.uint32(2), folded[np.minimum(at + 1, len(folded) - 1)].astype(np.uint32))
    x = (left << np.uint32(16) | b << np.uint32(8) | right) * np.uint32(0x9E3779B1)
    return (x >> np.uint32(17)).astype(np.int64), begin


def segmented(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, begin, axis=-1) if len(begin) else np.zeros((*x.shape[:-1], 0), x.dtype)


def maximised(share: np.ndarray, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The shares (texts x languages) that expectation-maximisation leads to from ``share``; texts that have settled are not worked on further."""
    share, own = share.copy(), np.arange(len(share))
    words = np.diff(first)
    doc = np.repeat(own, words)
    for k in range(ROUNDS):
        now = share[own]
        weight = now[doc].T * p
        weight /= np.maximum(weight.sum(axis=0), 1e-300)
        share[own] = segmented(weight, first[:-1]).T / words[:, None]
        moving = np.abs(share[own] - now).max(axis=1) > TOLERANCE
        if not moving.any():
            break
        if moving.sum() < 0.75 * len(own):
            p, own, words = p[:, moving[doc]], own[moving], words[moving]
            first = np.concatenate([[0], np.cumsum(words)])
            doc = np.repeat(np.arange(len(own)), words)
    return share


def mixtures(ll: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Shares (texts x languages) and log likelihood by the selected sets; ``ll`` is languages x words, ``first`` the first word of each text with words (and the end)."""
    langs, n = len(ll), len(first) - 1
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    top = ll.max(axis=0)
    p = np.exp(np.maximum(ll - top, -700))
    base = segmented(top, first[:-1])
    allowed = np.ones((n, langs), dtype=bool)
    best, score, loglik = np.zeros((n, langs)), np.full(n, -np.inf), np.zeros(n)
    for size in range(langs, 0, -1):
        share = maximised(allowed / size, p, first) if size > 1 else allowed.astype(float)
        total = np.maximum((share[doc].T * p).sum(axis=0), 1e-300)
        like = base + segmented(np.log(total), first[:-1])
        value = like - penalty / 2 * np.log(words + 1) * size
        ok = value > score
        best[ok], score[ok], loglik[ok] = share[ok], value[ok], like[ok]
        allowed[np.arange(n), langs - 1 - np.where(allowed, share, np.inf)[:, ::-1].argmin(axis=1)] = False  # of equal ones the last
    return best, loglik


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        c = counts + SMOOTH
        self.logp = np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)

    def infer(self, arr):
        """(first row, shares, log likelihood, words) by chunk."""
        for row, offsets, data in chunks(arr):
            folded = fold(data)
            start, end, first = word_bounds(folded, offsets)
            words = np.diff(first)
            share, loglik = np.zeros((len(words), len(self.languages))), np.zeros(len(words))
            own = words > 0
            if own.any() and self.languages:
                g, begin = gram_ids(folded, start, end)
                ll = np.stack([segmented(p[g], begin) for p in self.logp]).astype(np.float64)
                share[own], loglik[own] = mixtures(ll, np.append(first[:-1][own], first[-1]))
            yield row, share, loglik, words


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Trigram counts of each language from the bounded sample."""
    labelled = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    ids = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for row, offsets, data in chunks(batch.column("text")):
                folded = fold(data)
                start, end, first = word_bounds(folded, offsets)
                if not len(start):
                    continue
                g, begin = gram_ids(folded, start, end)
                cut = np.append(begin, len(g))[first]
                for i in range(len(first) - 1):
                    if cut[i] < cut[i + 1]:
                        total.setdefault(langs[row + i], np.zeros(BUCKETS, np.int64))[:] += np.bincount(g[cut[i] : cut[i + 1]], minlength=BUCKETS)
        for lang, c in total.items():
            own = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.astype(np.int32)), pa.array(c[own])], ["lang", "bucket", "n"])

    got = labelled.join(F.broadcast(ids), "doc_id").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # max_train ids
    languages = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        counts[np.searchsorted(languages, got["lang"].to_pylist()), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, max_train: int = MAX_TRAIN, model: Model | None = None) -> DataFrame:
    """(doc_id, language, languages, shares, log_likelihood, n_words) of each row of ``docs``."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    model = model or train(own, max_train)
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = cast.value
        names = np.array(m.languages, dtype=object)
        for batch in batches:
            top, sets, shares, like, count = [], [], [], [], []
            for _, share, loglik, words in m.infer(batch.column("text")):
                for s, x, n in zip(share, loglik, words):
                    order = np.argsort(-s, kind="stable")
                    order = order[s[order] > 0]
                    ok = len(order) > 0
                    top.append(names[order[0]] if ok else None)
                    sets.append(names[order].tolist() if ok else None)
                    shares.append(np.round(s[order], 4).tolist() if ok else None)
                    like.append(round(float(x), 3) if ok else None)
                    count.append(int(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(top, pa.string()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(like, pa.float64()), pa.array(count, pa.int64())],
                ["doc_id", "language", "languages", "shares", "log_likelihood", "n_words"],
            )

    return own.select("doc_id", "text").mapInArrow(run, "doc_id long, language string, languages array<string>, shares array<double>, log_likelihood double, n_words long")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
