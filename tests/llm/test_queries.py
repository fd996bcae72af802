import duckdb
import pytest
from compare import differences, views

from wordloom.llm import _sql, queries
from wordloom.llm import embedding_dedup as E
from wordloom.llm import jaccard as J
from wordloom.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), views(SF), queries.ORACLES[name]) is None


def test_sql_of_awkward_rows(spark):
    """The SQL, on rows that the tables do not hold."""
    from test_embedding_dedup import awkward
    from test_jaccard import corpus

    rows = [(i, t) for i, t in corpus() if t is None or len(t) < 20_000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert differences(J.classes(df), con, _sql.JACCARD) is None
    assert differences(S.passages(df.filter("doc_id IS NULL OR doc_id <> 31")), con, _sql.PASSAGES.replace("text IS NOT NULL)", "text IS NOT NULL AND doc_id <> 31)")) is None
    _, vectors = awkward(spark)
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(r.vec_id, r.embedding) for r in vectors.collect()])
    want = {r[0]: r for r in con.execute(_sql.EMBEDDINGS).fetchall()}
    got = {r.vec_id: tuple(r) for r in E.classes(vectors).collect()}
    assert set(got) == set(want) and sum(got[i] == want[i] for i in got) >= 0.95 * len(got)
