import numpy as np
import pyarrow as pa

from wordloom.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_flat_trees_are_the_trees_walked_one_by_one():
    r = np.random.default_rng(1)
    x = r.random((600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = Q.train(x, y, trees=20)

    def walk(row):
        b = [int(np.searchsorted(e, v, side="left")) for e, v in zip(m.edges, row)]
        total = m.base
        for t in range(len(m.feature)):
            k = 0
            while m.left[t, k] != k:
                k = m.left[t, k] + (b[m.feature[t, k]] > m.threshold[t, k])
            total += m.value[t, k]
        return 1 / (1 + np.exp(-total))

    got = m.predict(x)
    assert np.allclose(got, [walk(v) for v in x])
    held = r.random((400, 5)).astype(np.float32)
    assert (((held[:, 0] > 0.5) ^ (held[:, 1] > 0.3)) == (m.predict(held) > 0.5)).mean() > 0.9
    assert np.all(Q.train(x, np.zeros(600)).predict(x) < 1e-6)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = Q.classify(docs, seen).join(held.withColumnRenamed("toxic", "is_toxic"), "doc_id").collect()
    assert np.mean([(r.low_quality < 0.5) == (r.quality == 1) for r in rows]) > 0.9
    assert np.mean([(r.toxic >= 0.5) == (r.is_toxic == 1) for r in rows]) > 0.9


def test_awkward_rows(spark):
    rows = [(1, "plain words here"), (1, "plain words here"), (2, None), (3, ""), (None, "no id at all"), (4, "w " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS keep", "2 AS toxic", "'s' AS source")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(rows) and len({r[1:] for r in got if r.doc_id == 1}) == 1
    assert all(r.low_quality is None and not r.keep for r in got if r.doc_id in (2, 3))
    assert Q.kept_documents(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert {r.doc_id for r in Q.kept_documents(docs, none).collect()} == {1, None, 4}
    assert Q.classify(docs.limit(0), labels).count() == 0


def test_statistics_of_a_batch_are_those_of_each_text():
    texts = ["a b a", "", "Über alles!\nÜber alles!", "x|y|z 123", "é" * 50]
    lex = (np.array([], dtype=np.uint64),) * 2
    every = Q.statistics(pa.array(texts), lex)
    assert np.allclose(every, np.concatenate([Q.statistics(pa.array([t]), lex) for t in texts]))
    assert (every[1] == 0).all()
