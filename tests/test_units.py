"""Literal cases that the tables do not hold."""

import gzip

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordloom import functions as fn
from wordloom.operators import history, lexicon, ngrams, suggest, validate
from wordloom.sources import corpus, numbered_lines, parse_combined, parse_phrases, read_history, read_lexicon, read_model, read_vocabulary, wordlist, write_history, write_lexicon, write_model, write_report
from wordloom.streaming import bigram_stream, history_state, learn_batch, learn_stream, track_stream

NOW = 1_706_745_600


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("mode,raw,want", [("corpus_en", "Don't!", ["don't"]), ("corpus_en", "42", [""]), ("corpus_en", "x́", ["x"]), ("syllable", "Tôi,", ["tôi,"]), ("history", "don’t", ["don't"]), ("history", "é", ["é"]), ("history", "ΑΣ", ["ασ"]), ("history", "a 42 b", ["a", "b"]), ("corpus_en", "a b", ["a", "b"]), ("corpus_en", "", [])])
def test_tokens(spark, mode, raw, want):
    assert [r.token for r in fn.tokens(docs(spark, raw), mode).orderBy("pos").collect()] == want


def test_lines_end_at_line_feeds(spark):
    t = fn.tokens(docs(spark, "a b\r\nc\rd", None))
    assert [(r.line_no, r.pos, r.token) for r in t.orderBy("line_no", "pos").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")]


def test_chains(spark):
    pairs = lambda mode, x: {(r.prev, r.next) for r in ngrams.bigram_counts(fn.token_lines(docs(spark, x), mode)).collect()}
    assert pairs("corpus_en", "a 42 b\nc") == set()
    assert pairs("history", "a 42 b") == {("a", "b")}
    names = lexicon.syllables(docs(spark, "tôi yêu")).select(F.col("text").alias("lower"), "word_id")
    assert ngrams.bigrams(fn.token_lines(docs(spark, "tôi, yêu"), "syllable"), names).count() == 0
    assert ngrams.bigrams(fn.token_lines(docs(spark, "tôi yêu"), "syllable"), names).count() == 1


@pytest.mark.parametrize("c,m,want", [(1, 1, 0), (2, 2, 45425), (3, 3, 65535), (1, 9, 0), (0, 5, 0)])
def test_quantize(spark, c, m, want):
    assert one(spark, fn.quantize(F.lit(c), F.lit(m))) == want


def test_weights_of_powers_are_those_of_sql(spark):
    import duckdb

    pairs = [(b**p, b**q) for b in range(2, 60) for q in (2, 3, 5, 6, 9, 10, 15) for p in range(q + 1) if b**q < 1 << 40]
    con = duckdb.connect()
    ln = {n: con.execute("SELECT ln(?::DOUBLE)", [n]).fetchone()[0] for n in {x for pair in pairs for x in pair}}
    want = {(c, m): int(min(1.0, ln[c] / max(ln[m], 1.0)) * 65535) for c, m in pairs}
    df = spark.createDataFrame(pairs, "c long, m long")
    assert {(r.c, r.m): r.w for r in df.withColumn("w", fn.quantize(F.col("c"), F.col("m"))).collect()} == want
    assert want[3, 243] == 13107


@pytest.mark.parametrize("c,want", [(1, 6931), (2, 10986), (700, 65525), (701, 65535)])
def test_edge_score(spark, c, want):
    assert one(spark, fn.edge_score(F.lit(c), F.lit(NOW), NOW)) == want


def test_decay(spark):
    assert one(spark, fn.decay(F.lit(604800), 604800.0)) == 0.5 and one(spark, fn.decay(F.lit(-5), 604800.0)) == 1 and one(spark, fn.decay(F.lit(5), 0.0)) == 0


def test_pack(spark):
    assert one(spark, fn.pack(F.lit(222), F.lit(1), F.lit(70000))) == 4587520478


def test_parse_combined(spark):
    lines = ["dictionary=main:en,locale=en", "# x", "", "  word=a,f=300", "word=b,f=70000", "word=c,f=-1", "word=d,f=abc", "word=e,f=+5,flags=", "word=f,f=1,f=2", "word=,f=9", "word=A,f=7", "word=a,f=9", " bigram=q,f=3", "word=g", "word=h,word=i,f=4", "word=j,f=99999999999999999999"]
    got = parse_combined(spark.createDataFrame([(x,) for x in lines], "line string"))
    lex = {r.word: (r.prob, r.flags, r.word_id) for r in lexicon.build_lexicon(got).collect()}
    assert lex == {w: (p, int(p == 0), k) for k, (w, p) in enumerate(sorted({"a": 255, "b": 0, "c": 0, "d": 0, "e": 5, "f": 2, "A": 7, "g": 0, "i": 4, "j": 0}.items()))}


def test_wordlist_and_corpus_files(spark, tmp_path):
    p = tmp_path / "w.combined.gz"
    with gzip.open(p, "wt") as f:
        f.write("dictionary=x\n word=a,f=3\r\n word=b\rc,f=2\n")
    assert [(r.word, r.prob) for r in parse_combined(wordlist(spark, str(p))).collect()] == [("a", 3), ("b\rc", 2)]
    assert corpus(spark, str(p)).count() == 3 and corpus(spark, str(p), limit_millions=0).count() == 0


def test_canonical(spark):
    lex = lexicon.build_lexicon(spark.createDataFrame([("US", 200), ("us", 100), ("Ab", 5), ("aB", 5), ("AB", 4)], "word string, prob int"))
    word = {r.word_id: r.word for r in lex.collect()}
    got = {rule: {r.lower: word[r.word_id] for r in lexicon.canonical(lex, rule).collect()} for rule in ("exact_first", "max_prob")}
    assert got == {"exact_first": {"us": "us", "ab": "Ab"}, "max_prob": {"us": "US", "ab": "Ab"}}
    keys = spark.createDataFrame([("us",), ("zz",)], "key string")
    assert {r.key: r.word for r in lexicon.lookup(lex, keys, "first").collect()} == {"us": "US", "zz": None}
    assert {r.key: r.word for r in lexicon.lookup(lex, keys, "canonical").collect()} == {"us": "us", "zz": None}


def test_phrases(spark):
    lines = spark.createDataFrame(list(enumerate(['{"text": "A b", "source": "s"}', " ", '{"text": "a b"}', '{"text": "c"}'])), "line_no long, line string")
    assert {r.text: r.word_id for r in lexicon.phrases(parse_phrases(lines)).collect()} == {"a b": 0, "c": 3}
    with pytest.raises(Exception, match="MALFORMED"):
        parse_phrases(spark.createDataFrame([(0, "{oops")], "line_no long, line string")).collect()


def test_dense_ids_over_partitions(spark):
    got = lexicon.dense_ids(spark.range(5000).selectExpr("string(id) AS w").repartition(7), "w").collect()
    assert [r.word_id for r in sorted(got, key=lambda r: r.w)] == list(range(5000))
    assert lexicon.dense_ids(spark.range(0).selectExpr("string(id) AS w"), "w").count() == 0


def test_index_percentiles(spark):
    p = validate.percentiles(spark.createDataFrame([(i, i) for i in range(11)], "word_id long, len long")).first()
    assert (p.p10, p["median"], p.p90) == (2, 6, 10)
    assert tuple(validate.percentiles(spark.createDataFrame([(1, 0)], "word_id long, len long")).first()) == (0, 0, 0)


def test_invariants_find_errors(spark):
    t = spark.createDataFrame([(1, 2, 1, 5), (1, 3, 2, 9), (1, 3, 3, 1), (4, 99, 11, 1)], "prev_id long, next_id long, rank int, weight int")
    assert tuple(validate.invariants(t, ["prev_id"], "next_id", 10, 50).first()) == (4, 1, 2, 1, 1)
    lex = spark.createDataFrame([("a", 0, 0), ("b", 1, 0), ("c", 1, 1 << 16)], "word string, word_id long, packed long")
    assert tuple(validate.integrity(lex).first()) == (3, 1, 1)


def _model(spark):
    words = ["the", "to", "x", "y", "q", "r"]
    lex = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, word_id long")
    names = lex.select(F.col("word").alias("lower"), "word_id")
    bi = spark.createDataFrame([(4, n, k, 10 - k) for k, n in enumerate([2, 0, 3, 1], 1)], "prev_id long, next_id long, rank int, weight int")
    tri = spark.createDataFrame([(5, 4, 3, 1, 65535)], "w1 long, w2 long, next_id long, rank int, weight int")
    return lex, names, bi, tri


def test_back_off_and_gating(spark):
    lex, names, bi, tri = _model(spark)
    q = spark.createDataFrame([(1, "r q"), (2, "Q?"), (3, "q !"), (4, ""), (5, "zz")], "query_id long, text string")
    ask = lambda *a, **k: [(r.query_id, r.model_used, r.word) for r in suggest.suggest(q, names, lex, bi, *a, **k).orderBy("query_id", "rank").collect()]
    two = [(2, "Bigram", w) for w in ("x", "the", "y", "to")]
    assert ask(tri) == [(1, "Trigram", "y"), *two]
    assert ask() == [(1, "Bigram", w) for w in ("x", "the", "y", "to")] + two
    assert ask(tri, suggest.BOOST_EN)[1:] == [(2, "Bigram", w) for w in ("the", "to", "x", "y")]
    rep = {r.query_id: (r.model_used, r.top_suggestions) for r in suggest.report(q, suggest.suggest(q, names, lex, bi, tri), ["query_id"]).collect()}
    assert rep[1] == ("Trigram", "y(65535)") and rep[2] == ("Bigram", "x(9), the(8), y(7), to(6)") and rep[3] == rep[4] == rep[5] == ("None", "")


def test_expanding_prefixes(spark):
    got = suggest.expand_prefixes(docs(spark, "a b  c d", "one", ""), ["doc_id"]).orderBy("step").collect()
    assert [(r.step, r.context, r.last_word) for r in got] == [(1, "a", "a"), (2, "a b", "b"), (3, "a b c", "c")]


def test_report_of_prefixes(spark):
    lex, names, bi, tri = _model(spark)
    texts = ["r q", "r q x", "q Q? r  q\nthe end", "!! q q", "one", "", None, "zz r", "q r q x"]
    q = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "q q")], "query_id long, text string")
    for lexicon_, t in ((lex, tri), (lex, None), (lex.filter("word <> 'y'"), tri)):
        steps = suggest.expand_prefixes(q, ["query_id"])
        want = suggest.report(steps, suggest.suggest(steps.withColumnRenamed("context", "text"), names, lexicon_, bi, t, suggest.BOOST_EN, keys=["query_id", "step"]), ["query_id", "step"])
        got = suggest.prefix_report(q, names, lexicon_, bi, t, suggest.BOOST_EN)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = {r.step: (r.context, r.last_word, r.model_used, r.top_suggestions) for r in suggest.prefix_report(q, names, lex, bi, tri).filter("query_id = 1").collect()}
    assert one == {1: ("r", "r", "None", ""), 2: ("r q", "q", "Trigram", "y(65535)")}


def test_pruned_tracker(spark):
    n = 1
    text = "\n".join(f"p w{i:03d}" for i in range(100)) + "\np w000\np w000\np w007" + "\np new1\np w007\np w007\nq z"
    got = {(r.prev, r.next, r.cnt) for r in ngrams.bigrams_pruned(fn.token_lines(docs(spark, text.replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace("7", "h").replace("8", "i").replace("9", "j"))), n).collect()}
    counts = ngrams.tracked([x.split()[1] for x in text.split("\n")[:-1]], n)
    assert counts["w000"] == 3 and counts["w007"] == 4 and len(counts) < 100
    assert got == {("p", "waah", 4), ("q", "z", 1)}


def test_pruned_trackers_over_ordered_chunks(spark):
    import random

    from wordloom.operators import coded

    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdeé", k=r.choice([1, 2, 4])))
    texts = ["\n".join(" ".join(x for _ in range(8) for x in (r.choice(["p", "Q", "p'"]), word(), "7" * (r.random() < 0.1))) for _ in range(r.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame(r.sample(list(enumerate(texts)), 60), "doc_id long, text string").repartition(5)
    rows = lambda x: sorted(map(tuple, x.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 2):
            want, counts = rows(ngrams.bigrams_pruned(fn.token_lines(df), n)), rows(ngrams.top_n(ngrams.bigram_counts(fn.token_lines(df)), ["prev"], "next", n))
            assert rows(coded.bigrams_pruned(df, n)) == want
            assert n > 1 or want != counts  # something was pruned
        assert rows(coded.bigrams_pruned(df, 1000)) == rows(ngrams.bigrams_pruned(fn.token_lines(df), 1000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_model_files(spark, tmp_path):
    t = spark.createDataFrame([(1, 2, 3, 1, 9)], "prev_id long, next_id long, cnt long, rank int, weight int")
    write_model(t, str(tmp_path / "m"), "bigram", 5, 10)
    assert read_model(spark, str(tmp_path / "m"), "bigram").collect() == t.collect()
    with pytest.raises(ValueError):
        read_model(spark, str(tmp_path / "m"), "trigram")
    assert read_model(spark, str(tmp_path / "none"), "trigram", optional=True) is None
    write_report(spark.createDataFrame([(1, 'say "a, b"')], "i long, s string"), str(tmp_path / "csv"))
    assert pd.concat(pd.read_csv(f) for f in (tmp_path / "csv").glob("*.csv"))["s"].tolist() == ['say "a, b"']


def test_saved_lexicon_and_line_numbers(spark, tmp_path):
    lex = lexicon.build_lexicon(spark.createDataFrame([("b", 3), ("a", 0), ("é", 2)], "word string, prob int"))
    write_lexicon(lex, str(tmp_path / "l"))
    assert sorted(read_lexicon(spark, str(tmp_path / "l")).collect()) == sorted(lex.collect())
    assert sorted(map(tuple, read_vocabulary(spark, str(tmp_path / "l" / "vocab")).collect())) == [(0, "a"), (1, "b"), (2, "é")]
    folder = tmp_path / "lines"
    folder.mkdir()
    want = [f"line {k}" * (k % 5 != 0) for k in range(5000)]
    (folder / "a.txt").write_text("\n".join(want[:3000]) + "\n")
    (folder / "b.txt").write_text("\n".join(want[3000:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = [r.line for r in numbered_lines(spark, str(folder)).orderBy("line_no").collect()]
        assert got == want and numbered_lines(spark, str(folder)).agg(F.max("line_no")).first()[0] == 4999
        assert {r.text for r in corpus(spark, str(folder), limit_millions=1).collect()} == set(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = lexicon.phrases(parse_phrases(spark.createDataFrame([(0, '{"text": "A b", "source": "x"}'), (1, " "), (2, '{"text": "a b", "source": "y"}'), (3, '{"text": "c", "source": "z"}')], "line_no long, line string")))
    assert {r.text: r.word_id for r in got.collect()} == {"a b": 0, "c": 3}


def test_index_and_display(spark):
    vocab = spark.createDataFrame([(k, f"w{k}") for k in range(6)], "word_id long, word string")
    t = spark.createDataFrame([(1, 2, 1), (1, 9, 2), (4, 0, 1)], "prev_id long, next_id long, rank int")
    assert sorted(map(tuple, ngrams.edge_index(vocab, t).collect())) == [(0, 0, 0), (1, 0, 2), (2, 16, 0), (3, 16, 0), (4, 16, 1), (5, 24, 0)]
    assert sorted((r.next_id, r.next_word) for r in lexicon.named(t, vocab).collect()) == [(0, "w0"), (2, "w2"), (9, "<unknown>")]
    assert lexicon.named(t, vocab, unknown=None).count() == 2
    starts = spark.createDataFrame([("",), ("w",), ("w1",), ("x",), ("w1",), (None,)], "start string")
    assert {r.start: r.matches for r in lexicon.prefix_counts(vocab, starts).collect()} == {"": 6, "w": 6, "w1": 1, "x": 0}


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    path, known = str(tmp_path / "h"), _known(spark)
    batches = [_said(spark, "gox hello world"), _said(spark, "gox gox new"), _said(spark, "world new newer")]
    state = lambda: [sorted(map(tuple, x.collect())) for x in history_state(spark, path)]
    for n, b in enumerate(batches):
        learn_batch(b, n, known, path, every=2)
        once = state()
        learn_batch(b, n, known, path, every=2)
        assert state() == once
    for n in (1, 2):  # from the middle on
        learn_batch(batches[n], n, known, path, every=2)
    assert state() == once
    assert {(w, f) for _, w, _, f, _, _ in once[0]} == {("gox", 3), ("new", 2), ("newer", 1)}


def test_a_batch_is_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    batch = _said(spark, "gox hello world", "new gox")
    learn_batch(batch.coalesce(1).mapInArrow(counted, batch.schema), 0, _known(spark), str(tmp_path / "h"))
    assert read.value == 2 * 2  # its uses are joined to the private words they begin, and never made again for the edges
    words, edges = history_state(spark, str(tmp_path / "h"))
    assert {r.word: r.freq for r in words.collect()} == {"gox": 2, "new": 1} and edges.count() == 3


def test_snapshots_are_pruned(spark, tmp_path):
    path = str(tmp_path / "h")
    learn_batch(_said(spark, *(["hello my"] * 3 + ["hello name", "hello is", "hello hello"])), 0, _known(spark), path, every=1, over=3, keep=1)
    assert [(r.prev_id, r.next_id, r["count"]) for r in history_state(spark, path)[1].collect()] == [(100, 102, 3)]


def test_tracked_stream_is_bounded(spark, tmp_path):
    src = str(tmp_path / "uses")
    uses = [(1, 5, 7, NOW)] * 3 + [(1, 5, k, NOW + k) for k in range(10, 15)] + [(2, 5, 7, NOW)]
    spark.createDataFrame(uses, "user_id long, prev_id long, next_id long, now long").coalesce(1).write.parquet(src)
    stream = track_stream(spark.readStream.schema("user_id long, prev_id long, next_id long, now long").parquet(src), over=4, keep=2)
    q = stream.writeStream.outputMode("update").format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.user_id, r.next_id): r["count"] for r in spark.table("tracked").collect()}
    # the fifth successor of user 1 leaves the two best, which the last one joins
    assert got == {(1, 7): 3, (1, 10): 1, (1, 14): 1, (2, 7): 1} or got == {(1, 7): 3, (1, 13): 1, (1, 14): 1, (2, 7): 1}


def test_history_update_and_lookup(spark):
    none = spark.createDataFrame([], history.WORD), spark.createDataFrame([], history.EDGE)
    words, edges = history.update(*none, _said(spark, "hello gox", "gox gox"), _known(spark), NOW)
    assert {(r.prev_id, r.next_id): r["count"] for r in edges.collect()} == {(100, history.FIRST_ID): 1, (history.FIRST_ID, history.FIRST_ID): 1}
    found = history.lookup(words, spark.createDataFrame([(1, "gox"), (1, "no")], "user_id long, word string")).collect()
    assert {(r.word, r.word_id) for r in found} == {("gox", history.FIRST_ID), ("no", None)}
    assert history.lookup(words, spark.createDataFrame([(1, history.FIRST_ID)], "user_id long, word_id long")).first().word == "gox"
    full = spark.createDataFrame([(1, "w", 5, 4294967295, 4294967295, NOW)], history.WORD)
    taken = history.accept(full, spark.createDataFrame([(1, 5, NOW + 1)], "user_id long, word_id long, now long")).first()
    assert (taken.freq, taken.accept) == (4294967295, 4294967295)


def _said(spark, *texts):
    return spark.createDataFrame([(1, k, NOW + k, t) for k, t in enumerate(texts)], "user_id long, seq long, now long, text string")


def _known(spark):
    return spark.createDataFrame([("hello", 100), ("world", 101), ("my", 102), ("name", 103), ("is", 104)], "lower string, word_id long")


def test_history(spark, tmp_path):
    words, edges = history.learn(_said(spark, "Hello World", "My name is Gox", "My name is Gox", "I don’t know", "nhỉiii"), _known(spark))
    w = {r.word: r for r in words.collect()}
    assert [w[x].word_id - history.FIRST_ID for x in ("gox", "i", "don't", "know", "nhỉiii")] == [0, 1, 2, 3, 4]
    assert w["gox"].freq == 2 and "hello" not in w
    e = {(r.prev_id, r.next_id): r["count"] for r in edges.collect()}
    assert e[100, 101] == 1 and e[104, history.FIRST_ID] == 2
    top = history.predict(edges, NOW + 10).filter("prev_id = 104").collect()
    assert [(r.next_id, r.rank) for r in top] == [(history.FIRST_ID, 1)] and top[0].score > history.predict(edges, NOW + 10).filter("prev_id = 100").first().score
    assert [r.word for r in history.prefix(words, "NHỈI", NOW + 9).collect()] == ["nhỉiii"] and history.prefix(words, "42", NOW).count() == 0
    write_history(words, edges, str(tmp_path / "h"))
    w2, e2 = read_history(spark, str(tmp_path / "h"))
    assert sorted(history.predict(e2, NOW + 10).collect()) == sorted(history.predict(edges, NOW + 10).collect()) and w2.count() == words.count()
    assert [x.count() for x in read_history(spark, str(tmp_path / "none"))] == [0, 0]
    more, _ = history.learn(_said(spark, "new gox"), _known(spark), words.select("user_id", "word", "word_id"))
    assert {r.word: r.word_id - history.FIRST_ID for r in more.collect()} == {"new": 5, "gox": 0}
    assert {r.word: r.freq for r in history.merge_words(words, more).collect()}["gox"] == 3
    taken = history.accept(words, spark.createDataFrame([(1, history.FIRST_ID, NOW + 50)], "user_id long, word_id long, now long"))
    assert [(r.freq, r.accept, r.last_used) for r in taken.filter("word = 'gox'").collect()] == [(5, 1, NOW + 50)]


def test_neighbours_across_buckets(spark):
    import random

    r = random.Random(4)
    rows = [(u, r.choice([None, 1, 2, 3]), r.randint(0, 500), k) for k, u in enumerate([1] * 200 + [2] * 20 + [3])]
    want = []
    for u in (1, 2, 3):
        own = sorted([x for x in rows if x[0] == u], key=lambda x: x[2:])
        want += [(u, a[1], b[1], b[2]) for a, b in zip(own, own[1:]) if a[1] and b[1]]
    df = spark.createDataFrame(rows, "user_id long, id long, at long, seq long")
    for bucket in (1, 60, 10_000):
        assert sorted(map(tuple, history.followed(df, bucket).collect())) == sorted(want)


def test_history_pruning(spark):
    e = spark.createDataFrame([(1, 1, k, k, NOW) for k in range(1, 8)] + [(1, 2, 9, 1, NOW)], history.EDGE)
    assert sorted(r.next_id for r in history.pruned(e, NOW, over=5, keep=2).collect()) == [6, 7, 9]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    _said(spark, "Hello World gox", "gox is new").write.parquet(str(src))
    stream = spark.readStream.schema("user_id long, seq long, now long, text string").parquet(str(src))
    q = bigram_stream(stream).writeStream.outputMode("complete").format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.prev, r.next, r.cnt) for r in spark.table("pairs").collect()} == {("hello", "world", 1), ("world", "gox", 1), ("gox", "is", 1), ("is", "new", 1)}
    state = str(tmp_path / "state")
    q = learn_stream(stream, _known(spark), state).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    _said(spark, "gox newer").write.mode("append").parquet(str(src))
    q = learn_stream(stream, _known(spark), state).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    words, edges = history_state(spark, state)
    assert {r.word: (r.word_id - history.FIRST_ID, r.freq) for r in words.collect()} == {"gox": (0, 3), "new": (1, 1), "newer": (2, 1)}
    assert edges.count() == 5


def test_corpus_in_ids(spark):
    from wordloom.operators import coded

    nel, nb, thin = chr(0x85), chr(0xA0), chr(0x2009)
    texts = ["The cat's 42 sat\r\n the Cat sat" + nel + "on", None, "", "a" + nb + "b" + thin + "c" + chr(0x3000) + "d\n\n", "x\x1cy z\x1fz\n\n", "Ünï ünï ΑΣ ας", "the cat's sat the cat's sat on"]
    df = docs(spark, *texts)
    own = coded.coded(df)
    assert own.chunks.agg(F.sum("lines")).first()[0] == sum(t.count("\n") + 1 for t in texts if t is not None)
    for mode in ("corpus_en", "syllable"):
        if mode == "syllable":
            names = lexicon.syllables(df.select("text")).select(F.col("text").alias("lower"), "word_id")
        else:
            assert sorted(lexicon.piece_forms(own.pieces).collect()) == sorted(lexicon.surface_forms(df).collect())
            names = lexicon.canonical(lexicon.build_lexicon(lexicon.surface_forms(df)))
        ids, lines = coded.ids(own, names, mode), fn.token_lines(df, mode)
        rows = lambda x: sorted(map(tuple, x.collect()))
        want = ngrams.encoded(ngrams.bigram_counts(lines), names, {"next": "next_id", "prev": "prev_id"}).select("prev_id", "next_id", "cnt")
        assert rows(coded.pair_counts(ids).drop("followed")) == rows(want) != []
        tri = ngrams.trigram_ids(lines, names)
        for k in (1, 3, 100):
            pairs = ngrams.top_pairs(tri, k)
            assert rows(coded.top_pairs(coded.pair_counts(ids), k)) == rows(pairs)
            assert rows(coded.trigram_counts(ids, pairs)) == rows(tri.join(pairs.select("w1", "w2"), ["w1", "w2"], "left_semi"))


def test_a_saved_model_writes_what_is_asked_for(spark, tmp_path):
    from wordloom.plans import model

    df = docs(spark, "a b a b c\nthe end", "b a b")
    own = model.Building(df, str(tmp_path / "m"))
    assert own.lexicon.count() == 5
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["lexicon"]
    assert own.bigram.count() == 4
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["bigram", "lexicon", "names"]
    model.build(df, str(tmp_path / "n"))
    got = model.read(spark, str(tmp_path / "n"))
    assert sorted(got.bigram.collect()) == sorted(own.bigram.collect()) and sorted(got.trigram.collect()) == sorted(own.trigram.collect()) != []
