import random

import numpy as np

from wordloom.llm import decontamination as D
from wordloom.llm._text import word_list


def nearest(item, text):
    """Edit distance of ``item`` to the nearest run of ``text``."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def fixture(seed=5):
    r = random.Random(seed)
    common = ["the", "of", "and", "a"]
    word = lambda: r.choice(common) if r.random() < 0.4 else f"w{r.randint(0, 300)}"
    text = lambda n: [word() for _ in range(n)]
    items = [text(n) for n in (1, 3, 5, 6, 10, 14, 15, 20, 37, 60) for _ in range(3)]
    docs = [text(r.randint(0, 200)) for _ in range(40)]
    for item in items:
        for k in range(0, D.allowed(len(item)) + 2):
            w = list(item)
            for _ in range(k):
                at = r.randrange(len(w))
                kind = r.randrange(3)
                if kind == 0:
                    w[at] = "changed%d" % r.randrange(99)
                elif kind == 1:
                    w.insert(at, "added%d" % r.randrange(99))
                elif len(w) > 1:
                    del w[at]
            docs.append(text(r.randint(0, 30)) + w + text(r.randint(0, 30)))
    return [" ".join(x) for x in items], [" ".join(d) for d in docs]


def test_leaks_are_brute_force(spark):
    items, docs = fixture()
    want = set()
    for i, item in enumerate(items):
        w = word_list(item)
        for d, doc in enumerate(docs):
            e = nearest(w, word_list(doc))
            if e <= D.allowed(len(w)):
                want.add((d, i, e))
    docs_df = spark.createDataFrame([*enumerate(docs), (900, None), (901, ""), (None, docs[-1])], "doc_id long, text string").selectExpr("*", "3 AS item_id", "'x' AS words")
    bench = spark.createDataFrame([*enumerate(items), *enumerate(items[:3]), (None, "a b c"), (70, None), (71, ""), (72, "!")], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    rows = D.leaks(docs_df, bench, exhaustive=True).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in rows if r.doc_id is not None} == want
    sampled = {(r.doc_id, r.item_id, r.edits) for r in D.leaks(docs_df, bench).collect() if r.doc_id is not None}
    assert sampled <= want and len(sampled) >= 0.95 * len(want)
    left = D.clean_documents(docs_df, bench)
    assert left.columns == docs_df.columns
    assert {r.doc_id for r in left.collect()} == {*range(len(docs)), 900, 901} - {d for d, *_ in sampled}


def test_empty_tables(spark):
    none_docs, none_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert D.leaks(none_docs, none_items).count() == 0
    assert D.clean_documents(some, none_items).count() == 1
    assert D.leaks(none_docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_long_text_and_repeats(spark):
    r = random.Random(1)
    filler = " ".join(f"z{r.randint(0, 10**6)}" for _ in range(200_000))
    item = " ".join(f"item{i}" for i in range(30))
    df = spark.createDataFrame([(1, filler + " " + item + " " + filler + " " + item), (1, item), (2, filler)], "doc_id long, text string")
    got = D.leaks(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.first_word, x.edits) for x in got) == [(1, 0, 0), (1, 200_000, 0)]


def test_recall_of_the_sampling():
    rng = np.random.default_rng(2)
    items = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (20, 40, 60) for _ in range(40)]
    walks = D.Walks(D.calibrated(items))
    hit = 0
    for w in items:
        s = walks.signatures(np.stack([w, D.edit(w, D.allowed(len(w)), rng)]))
        hit += (s[0] == s[1]).any()
    assert hit >= 0.93 * len(items)


def test_first_text_of_a_chunk_that_begins_inside_an_item():
    words = [f"item{i}" for i in range(40)]
    _, h = next((first, h) for *_, first, h in D.hashed(D.pa.array([" ".join(words)])))
    for missing in (1, 2, 5):
        for ex in (True, False):
            got = list(D.Index([7], [h], ex).matches(D.pa.array([" ".join(words[missing:] + ["after"] * 9)])))
            assert [(r, i, e) for r, i, e, *_ in got] == [(0, 0, missing)]


def test_long_items_with_edits_of_one_kind():
    rng = np.random.default_rng(4)
    for length in (100, 250, 800):
        items = [rng.integers(1, 2**63, length, dtype=np.uint64) for _ in range(10)]
        texts = [[*rng.integers(1, 2**63, 30, dtype=np.uint64), *D.edited(w, D.allowed(length), rng, (kind,)), *rng.integers(1, 2**63, 30, dtype=np.uint64)] for w in items for kind in (0, 1, 2)]
        index, h, first = D.Index(list(range(10)), items), np.array(sum(texts, []), dtype=np.uint64), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        doc, item, diag = index.windows(h, first)
        doc, item, diag = index.candidates(h, first, doc, item, diag)
        assert {(d, i) for d, i in zip(doc.tolist(), item.tolist())} >= {(d, d // 3) for d in range(30)}


def test_a_missed_target_is_not_accepted(monkeypatch):
    rng = np.random.default_rng(6)
    items = [rng.integers(1, 2**63, 50, dtype=np.uint64) for _ in range(5)]
    monkeypatch.setattr(D, "WALKS_MOST", 1)
    assert D.walks_needed(items) is None and not D.Index([1], items[:1]).walks


def test_passes_find_what_one_pass_finds(spark, monkeypatch):
    docs, bench = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    bench = bench.union(spark.createDataFrame([(900, None), (901, ""), (None, "no id")], bench.schema))
    one = sorted(map(tuple, D.leaks(docs, bench).collect()))
    clean = sorted(r.doc_id for r in D.clean_documents(docs, bench).collect())
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 15)
    assert sorted(map(tuple, D.leaks(docs, bench).collect())) == one and len(one) > 0
    assert sorted(r.doc_id for r in D.clean_documents(docs, bench).collect()) == clean


def test_windows_find_other_items_of_their_bucket():
    rng = np.random.default_rng(9)
    a = rng.integers(1, 2**63, 40, dtype=np.uint64)
    b = D.edit(a, 3, rng)
    text = np.concatenate([rng.integers(1, 2**63, 20, dtype=np.uint64), a, rng.integers(1, 2**63, 20, dtype=np.uint64)])
    index, first = D.Index([1, 2], [a, b]), np.array([0, len(text)])
    doc, item, diag = index.windows(text, first)
    own = item == 0
    assert set(index.candidates(text, first, doc[own], item[own], diag[own])[1].tolist()) == {0, 1}
