from collections import defaultdict
from math import exp, log

import pytest

from wordloom.llm import lm_scoring as L

TOY = {k: log(v) for k, v in {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.15, "ab": 0.2, "ba": 0.05, "▁ab": 0.1, "bab": 0.05, "<0xC3>": 0.02, "<0xA9>": 0.03}.items()}


def segmentations(w, scores):
    if not w:
        yield ()
    for k in range(1, len(w) + 1):
        p = w[:k]
        if p in scores:
            s = scores[p]
        elif k == 1:
            s = sum(scores.get(f"<0x{b:02X}>", -30.0) for b in p.encode())
        else:
            continue
        for rest in segmentations(w[k:], scores):
            yield ((p, s), *rest)


@pytest.mark.parametrize("word", ["a", "ab", "abab", "babab", "aé", "éz", "b" * 9, "abba"])
def test_sum_over_all_segmentations(word):
    lattice = L.Lattice(TOY)
    every = list(segmentations(L.MARK + word, TOY))
    want = log(sum(exp(sum(s for _, s in x)) for x in every))
    assert lattice.log_probability(word) == pytest.approx(want) == lattice.forward(L.MARK + word)[-1]
    got, logs = defaultdict(float), defaultdict(float)
    lattice.expected(word, 2.0, got)
    lattice.expected_by_logs(L.MARK + word, 2.0, logs)
    assert dict(got) == pytest.approx(dict(logs))
    for p in TOY:
        if not p.startswith("<"):
            n = sum(exp(sum(s for _, s in x) - want) * sum(q == p for q, _ in x) for x in every)
            assert got.get(p, 0.0) == pytest.approx(2 * n, abs=1e-9)


def test_scores_of_documents(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (4, ""), (5, " \n "), (6, "zqxj kwvy"), (None, "the"), (7, "x" * 5000), (8, "word " * 30_000), (9, "日本 ​ é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "'p' AS piece")
    got = {r.doc_id: r for r in L.score(df).collect()}
    assert len(got) == len(rows) and got[1][1:] == got[2][1:]
    assert got[3].log_probability is None and got[3].n_words is None
    assert got[4].log_probability == got[5].log_probability == 0 and got[4].bits_per_byte is None
    assert got[6].bits_per_byte > got[1].bits_per_byte > 0
    lattice = L.Lattice(L.fitted(df.select("doc_id", "text")))
    for i, text in rows:
        if text:
            assert got[i].log_probability == pytest.approx(sum(lattice.forward(L.MARK + w)[-1] for w in text.split()), abs=1e-3, rel=1e-6)
    assert sum(map(exp, lattice.scores.values())) == pytest.approx(1)
    assert L.score(df.limit(0)).count() == 0


def test_scores_by_the_vocabulary_alone(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the cat sat on a mat")], "doc_id long, text string")
    lattice = L.Lattice(L.prior(L.MODEL))
    for docs in (df, df.filter("doc_id = 1")):
        got = {r.doc_id: r.log_probability for r in L.score(docs, weight=None).collect()}
        assert got[1] == pytest.approx(lattice.forward("▁the")[-1] + lattice.forward("▁cat")[-1], abs=1e-3)
