import random

import numpy as np

from wordloom.llm import language_id as L

SEEDS = {"aa": "ka ri tok vel mun sha", "bb": "zig plo wem xor quin jaf", "cc": "ödn eüs grä thö fiß ülm"}


def text(r, lang, n):
    parts = SEEDS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_mixtures(spark):
    r = random.Random(1)
    rows = [(i, text(r, lang, r.randint(5, 80)), lang) for i, lang in enumerate(list(SEEDS) * 60)]
    rows += [(1000 + i, text(r, lang, 40), None) for i, lang in enumerate(list(SEEDS) * 20)]
    rows += [(2000 + i, text(r, a, 60) + " " + text(r, b, 30), None) for i, (a, b) in enumerate([("aa", "bb"), ("cc", "aa"), ("bb", "cc")] * 5)]
    rows += [(3000, None, None), (3001, "", "aa"), (3002, "?!", None), (None, text(r, "aa", 9), None), (0, rows[0][1], "aa"), (3003, text(r, "bb", 50_000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS bucket", "2 AS n")
    got = {}
    for x in L.identify(df, max_train=150).collect():
        got[x.doc_id] = x
    assert len(got) == len({i for i, *_ in rows})
    names = list(SEEDS)
    assert sum(got[1000 + i].languages == [names[i % 3]] for i in range(60)) >= 58
    for i in range(15):
        a, b = [("aa", "bb"), ("cc", "aa"), ("bb", "cc")][i % 3]
        x = got[2000 + i]
        assert x.languages == [a, b] and abs(x.shares[0] - 2 / 3) < 0.05
    assert all(got[i].language is None and got[i].shares is None for i in (3000, 3001, 3002))
    assert got[3003].languages == ["bb"] and got[3003].n_words == 50_000
    assert L.identify(df.limit(0)).count() == 0
    assert {x.language for x in L.identify(df.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang")).collect()} == {None}


def test_em_reaches_the_likelihood_of_brute_force():
    r = np.random.default_rng(0)
    ll = np.log(r.random((3, 60)))
    ll[0, :40] += 3
    ll[1, 40:] += 3
    share, like = L.mixtures(ll, np.array([0, 60]))
    grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 51) for b in np.linspace(0, 1 - a, 51)]
    best = {}
    for g in grid:
        v = np.log(np.maximum(g @ np.exp(ll), 1e-300)).sum()
        s = frozenset(np.flatnonzero(g > 1e-9).tolist())
        best[s] = max(best.get(s, -np.inf), v)
    penalised = {s: v - L.PENALTY / 2 * np.log(61) * len(s) for s, v in best.items()}
    assert frozenset(np.flatnonzero(share[0]).tolist()) == max(penalised, key=penalised.get)
    assert like[0] >= best[frozenset(np.flatnonzero(share[0]).tolist())] - 0.5


def test_em_ends_where_it_settles():
    """A mixture of two near languages, which a dozen rounds do not settle, and of all sizes at once."""
    r = np.random.default_rng(5)
    n = [1, 3, 200, 4000]
    first = np.concatenate([[0], np.cumsum(n)])
    ll = np.log(0.8 + 0.4 * r.random((2, first[-1])))
    p = np.exp(ll - ll.max(axis=0))
    got = L.maximised(np.full((4, 2), 0.5), p, first)
    for i in range(4):
        x = p[:, first[i] : first[i + 1]]
        grid = np.linspace(0, 1, 2001)
        like = [np.log(np.maximum(g * x[0] + (1 - g) * x[1], 1e-300)).sum() for g in grid]
        mine = np.log(got[i, 0] * x[0] + got[i, 1] * x[1]).sum()
        assert mine >= max(like) - 0.05 and abs(got[i].sum() - 1) < 1e-9


def test_of_equal_languages_the_first_leads(spark):
    rows = [(k, "ka ri tok vel mun sha " * 3, lang) for k, lang in enumerate(("bb", "aa", "cc"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x.language for x in L.identify(df).collect()} == {"aa"}


def test_word_likelihoods_are_sums_of_trigrams(spark):
    """The model against counts and sums of one trigram after another."""
    docs = [(1, "abc abd", "xx"), (2, "zab", "yy"), (3, "abc", "xx")]
    model = L.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    counts = {lang: np.zeros(L.BUCKETS) for lang in ("xx", "yy")}

    def buckets(word):
        b = [1, *word.encode(), 2]
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 17 for i in range(len(b) - 2)]

    for _, t, lang in docs:
        for w in t.split():
            for k in buckets(w):
                counts[lang][k] += 1
    (_, _, like, n), *_ = model.infer(L.pa.array(["abd zab"]))
    want = {lang: sum(np.log((c[k] + L.SMOOTH) / (c.sum() + L.SMOOTH * L.BUCKETS)) for w in ("abd", "zab") for k in buckets(w)) for lang, c in counts.items()}
    assert model.languages == ["xx", "yy"] and n[0] == 2 and like[0] >= max(want.values()) - 1e-3
    (_, share, like, _), *_ = L.Model(["xx"], np.array([counts["xx"]])).infer(L.pa.array(["abd zab"]))
    assert abs(like[0] - want["xx"]) < 1e-3
