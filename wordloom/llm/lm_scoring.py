"""Subword lattice likelihood: the probability of a document summed over all its segmentations.

The pieces and their scores are those of a public vocabulary file (never trained).  Its scores
are merge ranks, so a piece's prior is Zipf's law of its rank.  The weights are the prior and the pieces' expected
counts in the whole corpus under it: all distinct words are gathered with their counts, and
forward-backward over each word's lattice gives the counts of its pieces (a posterior mean with PRIOR
observations of the prior).  ``score(docs, weight=None)`` weights by the vocabulary's scores alone; then a document's score
does not depend on the others.

A document is its words (maximal runs without white space), each beginning with the vocabulary's word
mark.  No piece crosses a word mark, so the sum over segmentations of a document is the product of that of its words.  The
forward recursion runs in log space; the sums of prefixes are shared by all words that begin
alike.  A character that is no piece is the product of its byte pieces.

Defined results: a null text has null scores, a text without words log probability 0 and null bits
a byte; rows without a doc_id are scored like others; repeated rows are scored alike; an empty table gives an empty result; texts and words of any length are scored
whole; no other columns are looked at.
"""

from __future__ import annotations

import os
from collections import Counter, defaultdict
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import read, text_documents

MODEL = os.environ.get("WORDLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: observations that the vocabulary's own scores count as
PRIOR = 100_000.0
_WORDS = 250_000
_PREFIXES = 500_000
_LONG = 48


def prior(path: str) -> dict[str, float]:
    """Log probability of each piece by the vocabulary's scores; byte pieces are named by their bytes' numbers."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out, last = {}, sp.get_piece_size()
    for i in range(last):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        name = sp.id_to_piece(i)
        rank = last if sp.is_byte(i) else 1.0 - sp.get_score(i)
        out[name] = 1.0 / (rank + 2.0)
    total = sum(out.values())
    return {k: log(v / total) for k, v in out.items()}


class Lattice:
    """Forward and backward sums over the segmentations of words."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        #: what can stand at the end of a piece
        self.ends = {p[k:] for p in scores for k in range(len(p))}
        self.bytes = [scores.get(f"<0x{b:02X}>", -30.0) for b in range(256)]
        self.known: dict[str, float] = {"": 0.0}
        self.words: dict[str, float] = {}
        self.before: dict[str, float] = {}
        self.probability = {p: exp(s) for p, s in scores.items()}

    def fallback(self, c: str) -> float:
        return sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))

    def arcs(self, w: str, i: int):
        """(start, log weight) of the pieces that end at i."""
        scores, ends, out, j = self.scores, self.ends, [], i - 1
        while j >= 0:
            p = w[j:i]
            s = scores.get(p)
            if s is not None:
                out.append((j, s))
            elif j == i - 1:
                out.append((j, self.fallback(p)))
            if p not in ends:
                break
            j -= 1
        return out

    def forward(self, w: str) -> list[float]:
        a = [0.0]
        for i in range(1, len(w) + 1):
            a.append(log_sum([a[j] + s for j, s in self.arcs(w, i)]))
        return a

    def log_probability(self, word: str) -> float:
        """The log of the summed probability of all segmentations of a word."""
        have = self.words.get(word)
        if have is not None:
            return have
        have = self.before.get(word)
        if have is None:
            w = MARK + word
            have = self.forward(w)[-1] if len(w) > _LONG else self.shared_forward(w)
        if len(self.words) > _WORDS:  # words that were met since the last turn stay
            self.before, self.words = self.words, {}
        self.words[word] = have
        return have

    def shared_forward(self, w: str) -> float:
        """The forward recursion from the longest prefix that any word before had."""
        known, score, ends = self.known, self.scores.get, self.ends
        if len(known) > _PREFIXES:
            known.clear()
            known[""] = 0.0
        n = i = len(w)
        while w[:i] not in known:
            i -= 1
        while i < n:
            i += 1
            j = i - 1
            p = w[j]
            s = score(p)
            total = known[w[:j]] + (self.fallback(p) if s is None else s)
            while j and p in ends:
                j -= 1
                p = w[j:i]
                s = score(p)
                if s is not None:
                    x = known[w[:j]] + s
                    total = x + log1p(exp(total - x)) if x > total else total + log1p(exp(x - total))
            known[w[:i]] = total
        return known[w]

    def expected(self, word: str, times: float, into: dict) -> None:
        """Add the expected counts of the pieces of a word; by products where they can't underflow, else by logs."""
        w = MARK + word
        n = len(w)
        if n > _LONG:
            return self.expected_by_logs(w, times, into)
        probability, ends = self.probability.get, self.ends
        a, arcs = [1.0], []
        for i in range(1, n + 1):
            j = i - 1
            p = w[j]
            x = probability(p)
            if x is None:
                x = exp(self.fallback(p))
            arcs.append((j, i, p, x))
            total = a[j] * x
            while j and p in ends:
                j -= 1
                p = w[j:i]
                x = probability(p)
                if x is not None:
                    arcs.append((j, i, p, x))
                    total += a[j] * x
            a.append(total)
        if a[n] < 1e-280:
            return self.expected_by_logs(w, times, into)
        b = [0.0] * n + [times / a[n]]
        scores = self.scores
        for j, i, p, x in reversed(arcs):
            x *= b[i]
            b[j] += x
            if p in scores:
                into[p] += a[j] * x
            else:
                for c in p.encode("utf-8", "surrogatepass"):
                    into[f"<0x{c:02X}>"] += a[j] * x

    def expected_by_logs(self, w: str, times: float, into: dict) -> None:
        a = self.forward(w)
        n = len(w)
        b = [-1e300] * n + [0.0]
        total = a[n]
        for i in range(n, 0, -1):
            later = b[i]
            if later == -1e300:
                continue
            for j, s in self.arcs(w, i):
                x = s + later
                y = b[j]
                b[j] = x if y == -1e300 else (x + log(1 + exp(y - x)) if x > y else y + log(1 + exp(x - y)))
                p = w[j:i]
                share = times * exp(a[j] + x - total)
                if p in self.scores:
                    into[p] += share
                else:
                    for c in p.encode("utf-8", "surrogatepass"):
                        into[f"<0x{c:02X}>"] += share


def log_sum(x: list[float]) -> float:
    if len(x) == 1:
        return x[0]
    m = max(x)
    return m + log(sum([exp(v - m) for v in x]))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, counted in part where they are read."""

    def run(batches):
        c: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                if t:
                    c.update(t.split())
                    if len(c) > _WORDS:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
                        c.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame, path: str = MODEL, weight: float = PRIOR) -> dict[str, float]:
    """Log probabilities of the pieces from the whole corpus; as many as the vocabulary has, whatever the corpus."""
    scores = prior(path)
    cast = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        lattice, into = Lattice(cast.value), defaultdict(float)
        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                lattice.expected(w, n, into)
        yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.float64())], ["piece", "n"])

    rows = word_counts(docs).mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(rows["piece"].to_pylist(), rows["n"].to_pylist()))
    total = sum(counts.values()) + weight
    return {p: log((counts.get(p, 0.0) + weight * exp(s)) / total) for p, s in scores.items()}


def score(docs: DataFrame, path: str = MODEL, weight: float | None = PRIOR) -> DataFrame:
    """(doc_id, log_probability, n_words, n_bytes, bits_per_byte) of each row of ``docs``; without ``weight`` by the vocabulary's scores alone, whatever the other rows."""
    docs = text_documents(docs)
    cast = docs.sparkSession.sparkContext.broadcast(prior(path) if weight is None else fitted(docs, path, weight))
    state: dict = {}

    def run(batches):
        lattice = state.setdefault("lattice", Lattice(cast.value))
        of = lattice.log_probability
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                if t is None:
                    rows.append((None,) * 4)
                    continue
                words, size = t.split(), len(t.encode("utf-8", "surrogatepass"))
                total = sum(map(of, words))
                rows.append((round(total, 4), len(words), size, round(-total / log(2) / size, 6) if words else None))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.int64(), pa.int64(), pa.float64())))], ["doc_id", "log_probability", "n_words", "n_bytes", "bits_per_byte"])

    return docs.mapInArrow(run, "doc_id long, log_probability double, n_words long, n_bytes long, bits_per_byte double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
