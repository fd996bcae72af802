import random

import numpy as np
import pytest

from wordloom.llm import suffix_dedup as S
from wordloom.llm._text import word_list


def brute(rows, width):
    at = {}
    for i, t in rows:
        if i is not None:
            w = word_list(t)
            for p in range(len(w) - width + 1):
                at.setdefault(tuple(w[p : p + width]), set()).add(i)
    out = set()
    for i, t in rows:
        if i is None:
            continue
        w = word_list(t)
        run = None
        for p in range(len(w) - width + 1):
            ids = at[tuple(w[p : p + width])]
            if len(ids) < 2:
                continue
            other = min(ids - {i})
            if run and p <= run[1]:
                run = (run[0], p + width, min(run[2], other))
            else:
                if run:
                    out.add((i, run[0], run[1] - run[0], run[2]))
                run = (p, p + width, other)
        if run:
            out.add((i, run[0], run[1] - run[0], run[2]))
    return out


def fixture():
    r = random.Random(2)
    text = lambda n: [f"w{r.randint(0, 500)}" for _ in range(n)]
    a, b, c = text(50), text(49), text(300)
    docs = [text(r.randint(0, 150)) for _ in range(20)]
    docs += [text(r.randint(0, 60)) + x + text(r.randint(0, 60)) for x in (a, a, a, b, b, c, c, a + c, c[20:180])]
    docs += [c, c, c[:60], text(10) + ["same"] * 300, ["same"] * 120, ["same"] * 20, a + a, text(5000) + a + c + text(3000)]
    base = text(400)
    docs += [[("x%d" % r.randint(0, 9)) if r.random() < 0.02 else w for w in base] for _ in range(8)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    only = text(80)
    return rows + [(500, " ".join(only)), (500, " ".join(only)), (None, " ".join(only)), (501, None), (502, ""), (None, None)]


@pytest.mark.parametrize("width", [50, 12])
def test_passages_are_brute_force(spark, width):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS low", "2 AS anchors", "3 AS part", "4 AS k")
    got = {(r.doc_id, r.first_word, r.words, r.other_doc_id) for r in S.passages(df, width, parts=5).collect()}
    assert got == brute(rows, width)


def test_empty_table(spark):
    assert S.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deep_shallow_order():
    r = np.random.default_rng(4)
    words = r.integers(0, 2, 4000).astype(np.uint32)
    at = r.choice(3900, 300, replace=False)
    width = 20
    got = [sorted(at[x].tolist()) for x in S.equal_suffixes(words, at, np.zeros(300, np.int64), width)]
    by = {}
    for p in at.tolist():
        by.setdefault(tuple(words[p : p + width]), []).append(p)
    assert sorted(got) == sorted(sorted(v) for v in by.values() if len(v) > 1)
    trie = S.BlindTrie(words, width)
    for p in at.tolist():
        trie.insert(p)
    assert [tuple(words[leaf[0] : leaf[0] + width]) for leaf in trie.leaves()] == sorted(by)


def test_multikey_quicksort_is_a_sort():
    r = np.random.default_rng(8)
    for alphabet, n, depth in ((2, 500, 6), (50, 900, 3), (1, 40, 4), (2**32, 300, 8), (3, 1, 5), (3, 0, 5)):
        words = r.integers(0, alphabet, 1200, dtype=np.uint64).astype(np.uint32)
        at, group = r.integers(0, 1100, n), r.integers(0, 3, n)
        order, got = S.multikey(words, at, group, depth)
        key = [(int(group[i]), *words[at[i] : at[i] + depth].tolist()) for i in range(n)]
        want = sorted(key)
        want = [k for k in want if want.count(k) > 1]
        assert [key[i] for i in order.tolist()] == want
        assert got.tolist() == [sorted(set(want)).index(k) for k in want]
