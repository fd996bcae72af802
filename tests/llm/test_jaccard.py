import random

import numpy as np
import pytest

from wordloom.llm import jaccard as J
from wordloom.llm._text import word_list


def grams(text, n=5):
    w = word_list(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, t=0.5, n=5):
    by = {}
    for i, x in rows:
        s = frozenset(grams(x, n))
        if i is not None and s:
            by.setdefault(s, set()).add(i)
    out = {}
    keys = list(by)
    for k, a in enumerate(keys):
        for i in by[a]:
            if i != min(by[a]):
                out[min(by[a]), i] = 1.0
        for b in keys[k + 1 :]:
            j = len(a & b) / len(a | b)
            x, y = sorted((min(by[a]), min(by[b])))
            if j >= t and x != y:
                out[x, y] = max(out.get((x, y), 0), round(j, 6))
    return out


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda k: [r.choice(words) for _ in range(k)]
    passage = text(40)
    docs = []
    for _ in range(25):
        docs.append(text(r.randint(1, 120)))
    for base_size, copies in ((80, 60), (200, 30), (30, 12), (7, 6)):
        base = text(base_size)
        for _ in range(copies):
            docs.append([r.choice(words) if r.random() < 0.05 else w for w in base])
    docs += [text(20) + passage + text(20) for _ in range(45)] + [passage + [r.choice(words)] for _ in range(20)]
    docs += [docs[30]] * 5 + [["one"]] * 3 + [text(20_000)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    return rows + [(9001, None), (9002, ""), (None, rows[30][1]), rows[30], rows[30], (31, rows[60][1]), (9003, "!?"), (9004, "ONE")]


def brute_classes(rows, t=0.5, n=5):
    """doc_id -> (class, links): from the sets alone."""
    holders, parent, links = {}, {}, {}
    for i, x in rows:
        if i is not None:
            parent.setdefault(i, i)
            s = frozenset(grams(x, n))
            if s:
                holders.setdefault(s, set()).add(i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def tie(ids):
        r = [find(i) for i in ids]
        for x in r:
            parent[x] = min(r)

    for s, own in holders.items():
        near = [o for o in holders if o is not s and len(s & o) >= t * len(s | o)]
        tie(own.union(*(holders[o] for o in near)))
        for i in own:
            links[i] = links.get(i, 0) + len(own) - 1 + len(near)
    return {i: (find(i), links.get(i, 0)) for i in parent}


HOW = [{}, {"dense": 5, "heavy": 4}, {"dense": 10**9, "heavy": 3, "parts": 3}, {"dense": 2, "heavy": 10**9}, {"dense": 3, "room": 7}]


@pytest.mark.parametrize("how", HOW)
def test_classes_are_brute_force(spark, how):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS n", "2 AS set_id", "3 AS head", "text AS grams", "'x' AS root")
    got = J.classes(df, **how)
    assert got.columns == ["doc_id", "class_id", "links"]
    assert sorted((r.doc_id, r.class_id, r.links) for r in got.collect()) == sorted((i, *x) for i, x in brute_classes(rows).items())


@pytest.mark.parametrize("broadcast", [False, True])
def test_classes_with_many_copies_and_shared_ids(spark, monkeypatch, broadcast):
    """Half of the rows are one text, some of one doc_id; a doc_id with several texts ties their classes."""
    if not broadcast:
        monkeypatch.setattr(J, "REPEATS", -1)
        monkeypatch.setattr(J, "ASKED", -1)
    rows = [r for r in corpus(5) if r[0] is None or r[0] < 60]
    a, b = rows[26][1], rows[0][1]
    rows += [(1000 + i, a) for i in range(100)] + [(2000, a)] * 30 + [(2000, b)] * 3 + [(2001, b), (2001, None)]
    got = J.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == sorted((i, *x) for i, x in brute_classes(rows).items())


@pytest.mark.parametrize("how", HOW)
def test_join_is_brute_force(spark, how):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS n", "2 AS set_id", "3 AS a", "text AS grams", "'x' AS region")
    got = {(r.doc_a, r.doc_b): r.jaccard for r in J.join(df, **how).collect()}
    assert got == brute(rows)


def test_large_components_are_verified_in_blocks(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(J, "_verified", lambda *x, f=J._verified: f(*x, room=3))
    got = {(r.doc_a, r.doc_b): r.jaccard for r in J.join(spark.createDataFrame(rows, "doc_id long, text string"), dense=10**9).collect()}
    assert got == brute(rows)


def test_regions_recurse(spark):
    r = np.random.default_rng(1)
    base = [r.integers(0, 2**60, 60) for _ in range(6)]
    parts = [np.unique(np.where(r.random(60) < 0.12, r.integers(0, 2**60, 60), base[i % 6])).astype(np.uint64) for i in range(150)]
    home = np.array([i % 3 > 0 for i in range(150)])
    got = {(i, j) for i, b, _ in J.region_pairs(parts, home, 0.5, leaf=8) for j in b.tolist()}
    want = {(i, j) for i in range(150) for j in range(150) if i != j and home[i] and len(np.intersect1d(parts[i], parts[j])) >= 0.5 * len(np.union1d(parts[i], parts[j]))}
    assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want}


def test_one_of_each_keeps_columns_and_rows_without_partners(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source", "7 AS v", "8 AS root")
    left = J.one_of_each(df)
    assert left.columns == df.columns
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted([i for i, _ in rows if i is None or find(i) == i], key=lambda i: (i is None, i or 0))
    assert sorted([x.doc_id for x in left.collect()], key=lambda i: (i is None, i or 0)) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(df).count() == 0 and J.one_of_each(df).count() == 0 and J.classes(df).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (None, "x y")], "doc_id long, text string")
    assert sorted(map(tuple, J.classes(none).collect())) == [(1, 1, 0), (2, 2, 0)]


@pytest.mark.parametrize("driver", [10**6, 0])
def test_components_of_a_path(spark, driver):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.v: r.root for r in J.components(e, driver).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_one_of_each_keeps_one_of_repeated_rows(spark):
    a, b, c = ("one two three four five six seven", "other words that are not in the first text", "eins zwei drei vier fuenf sechs sieben")
    rows = [(1, a), (1, a), (1, a.upper()), (1, b), (2, b + " at all"), (3, c), (None, c), (None, c), (None, a), (None, None), (None, None), (4, ""), (4, ""), (4, "!"), (5, "x y")]
    df = spark.createDataFrame([("s", i, t) for i, t in rows], "source string, doc_id long, text string")
    left = J.one_of_each(df.repartition(3))
    assert left.columns == df.columns
    got = sorted((x.doc_id or 0, (x.text or "").lower()) for x in left.collect())
    assert got == sorted([(1, a), (1, b), (3, c), (0, c), (0, a), (0, ""), (4, ""), (4, "!"), (5, "x y")])


def test_points_without_a_home_meet_home_points_alone(spark):
    """A region with few home points and many others: what is copied grows with neither their product nor the others' square."""
    homes, others = list(range(3)), list(range(10, 210))
    rows = [(0, i, i, 0 if i < 10 else -1, 0.1 if i < 10 else 0.3 + 0.002 * (i % 100), b"") for i in homes + others]
    members = spark.createDataFrame(rows, "region int, set_id long, head long, home int, d double, grams binary")
    got = J._blocks(members, 0.5, 20).collect()
    tasks = {}
    for x in got:
        tasks.setdefault((x.low, x.high), {}).setdefault(x.block, set()).add(x.set_id)
    met = [tuple(sorted((i, j))) for (a, b), t in tasks.items() for i in t.get(a, ()) for j in t.get(b, ()) if a != b or i < j]
    assert sorted(met) == sorted([(i, j) for i in homes for j in others] + [(0, 1), (0, 2), (1, 2)])
    assert len(got) <= len(others) + len(homes) * (len(tasks) + 1)
    assert all(len(s) <= 40 for t in tasks.values() for s in t.values())


def test_regions_hold_what_a_home_point_can_reach(spark):
    """A shared line that dense short texts consist of does not draw all longer texts that hold it into their region."""
    r = random.Random(2)
    word = lambda: f"v{r.randrange(10**9)}"
    line = [word() for _ in range(24)]
    rows = [(i, " ".join(line + [word()])) for i in range(30)] + [(100 + i, " ".join(line + [word() for _ in range(90)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pts = J.points(df)
    found = J.different_sets(pts)
    pivots = J._pivots(df, found, 5, 20, 0.4, 10**6)
    held = J._memberships(df, pivots, 5, 0.5, 0.4).filter("head >= 100")
    assert held.count() == 0
    assert sorted((x.doc_id, x.class_id, x.links) for x in J.classes(df, dense=20).collect()) == sorted((i, *x) for i, x in brute_classes(rows).items())


def test_common_grams_are_counted_by_matrix_and_one_by_one():
    r = np.random.default_rng(7)
    base = r.integers(0, 2**62, 80).astype(np.uint64)
    parts = [np.unique(np.where(r.random(80) < 0.2, r.integers(0, 2**62, 80).astype(np.uint64), base) if i % 3 else r.choice(base, 5)) for i in range(90)]
    for queries in (np.arange(90), np.arange(4)):
        got = {int(q): c.tolist() for q, c in J.common_counts(parts, queries)}
        assert got == {int(q): [len(np.intersect1d(parts[q], p)) for p in parts] for q in queries}
