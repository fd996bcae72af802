import numpy as np
import pytest

from wordloom.llm import embedding_dedup as E


def near_vectors(n, dim, seed=3, low=0.94):
    """n random vectors and as many at a cosine of ``low`` to 1 to them."""
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    d = r.standard_normal((n, dim))
    d -= (d * base).sum(axis=1, keepdims=True) * base
    c = r.uniform(low, 1.0, (n, 1))
    return np.concatenate([base, c * base + np.sqrt(1 - c * c) * d / np.linalg.norm(d, axis=1, keepdims=True)]).astype(np.float32)


def cosines(x):
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    return u @ u.T


def awkward(spark):
    x = np.concatenate([near_vectors(300, 32), near_vectors(5, 32)[:5] * 3])
    inf = float("inf")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (9000, x[7].tolist()), (9001, None), (9002, []), (9003, [0.0] * 32), (9004, [float("nan")] * 32), (9005, [1.0, None]), (None, x[3].tolist()), (9006, [1.0, 0.0]), (9007, [2.0, 0.0]), (9008, [inf] * 2)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cell", "'q' AS v", "2 AS id", "3 AS head", "4 AS member")


@pytest.mark.parametrize("how", [{}, {"cell": 100}, {"cell": 200, "room": 40}])
def test_near_pairs_against_brute_force(spark, how):
    x, df = awkward(spark)
    c = cosines(x)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if c[i, j] >= 0.95} | {(7, 9000), (9006, 9007)}
    got = {(p.vec_a, p.vec_b): p.cosine for p in E.near_pairs(df, **how).collect()}
    assert set(got) <= want and len(got) >= 0.95 * len(want)
    assert {(7, 9000), (9006, 9007)} <= set(got)
    assert all(abs(v - c[i, j]) < 1e-5 for (i, j), v in got.items() if j < len(x))


@pytest.mark.parametrize("how", [{}, {"cell": 150, "room": 50}])
def test_classes_follow_the_pairs(spark, how):
    """Classes and links are those of the pairs that are found, of which there are as many as RECALL asks."""
    _, df = awkward(spark)
    pairs = [(p.vec_a, p.vec_b) for p in E.near_pairs(df, **how).collect()]
    parent, links = {}, {}

    def find(i):
        while parent.get(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        r = sorted((find(a), find(b)))
        parent[r[1]] = r[0]
        for i in (a, b):
            links[i] = links.get(i, 0) + 1
    near7 = links[7] - 1  # partners of the vector that 7 and 9000 share
    links[9000] = near7 + 1
    ids = {r.vec_id for r in df.collect()} - {None}
    got = E.classes(df, **how)
    assert got.columns == ["vec_id", "class_id", "links"]
    assert sorted(map(tuple, got.collect())) == sorted((i, find(i), links.get(i, 0)) for i in ids)


@pytest.mark.parametrize("axes", [6, 12, 16])
def test_recall_at_many_axes(spark, axes):
    """Pairs just at the threshold, as many axes as thousands of millions of vectors would get."""
    x = near_vectors(600, 64, seed=axes)
    d = np.random.default_rng(100 + axes).standard_normal((600, 64))
    d -= (d * x[:600]).sum(axis=1, keepdims=True) * x[:600]
    x[600:] = 0.9501 * x[:600] + np.sqrt(1 - 0.9501**2) * d / np.linalg.norm(d, axis=1, keepdims=True)
    c = cosines(x)
    want = {(i, j) for i, j in zip(*np.nonzero(c >= 0.95)) if i < j}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(p.vec_a, p.vec_b) for p in E.near_pairs(df, cell=len(x) / 2**axes).collect()}
    assert len(want) >= 590 and got <= want and len(got) >= 0.93 * len(want)


def test_many_equal_vectors_and_none(spark):
    df = spark.range(500).selectExpr("id AS vec_id", "array(1.0f, 2.0f) AS embedding")
    assert {(r.vec_a, r.vec_b, r.cosine) for r in E.near_pairs(df).collect()} == {(0, i, 1.0) for i in range(1, 500)}
    assert {tuple(r) for r in E.classes(df).collect()} == {(i, 0, 499) for i in range(500)}
    assert E.near_pairs(df.limit(0)).count() == 0 and E.classes(df.limit(0)).count() == 0
