"""One query for each family of operators, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pack, token_lines, tokens, unpack, word_score
from ..operators import coded, history, lexicon, ngrams, suggest, validate
from ..session import checkpoint_dir, kept, read
from ..sources import corpus, numbered_lines, parse_combined, parse_phrases, read_history, read_report, read_vocabulary, wordlist, write_history, write_report
from ..streaming import bigram_stream, history_state, learn_stream, track_stream
from . import model
from .model import MAX_PAIRS, TOP_N

#: the clock of all decayed scores, 2024-02-01 UTC
NOW = 1_706_745_600

PROBES = ("the", "to", "of", "die", "der", "le", "la", "que", "zzz")

COMBINED_LINES = """
CASE p_partkey % 11 WHEN 0 THEN '# ' || p_name WHEN 1 THEN ' shortcut=' || p_name
ELSE '  word=' || split_part(p_name, ' ', 1) || CASE p_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN split_part(p_name, ' ', 2) ELSE CAST(p_partkey % 97 AS VARCHAR(20)) END || ',f=' ||
  CASE p_partkey % 7 WHEN 0 THEN '300' WHEN 1 THEN '70000' WHEN 2 THEN '-1' WHEN 3 THEN 'abc' WHEN 4 THEN '+5' WHEN 5 THEN '1,f=2' ELSE CAST(p_partkey % 256 AS VARCHAR(20)) END || ',flags=,originalFreq=9' END
"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text")


def _model(spark: SparkSession, sf: str, mode: str = "corpus_en") -> model.Building:
    return model.saved(spark, f"{sf}/documents.parquet", lambda: documents(spark, sf), mode)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads back."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _coded(spark: SparkSession, sf: str) -> coded.Coded:
    return coded.coded(documents(spark, sf))


def base_lexicon(spark: SparkSession, sf: str, own: coded.Coded | None = None) -> DataFrame:
    return lexicon.build_lexicon(lexicon.piece_forms((own or _coded(spark, sf)).pieces))


def base_names(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.canonical(base_lexicon(spark, sf))


def base_ids(spark: SparkSession, sf: str, mode: str = "corpus_en", rule: str = "exact_first") -> DataFrame:
    """The documents in ids of their canonical words or, in mode ``syllable``, of their pieces as a syllable dictionary."""
    own = _coded(spark, sf)
    if mode == "syllable":
        names = lexicon.syllables(own.pieces.select(F.col("piece").alias("text"))).select(F.col("text").alias("lower"), "word_id")
    else:
        names = lexicon.canonical(base_lexicon(spark, sf, own), rule)
    return coded.ids(own, names, mode)


def base_bigrams(ids: DataFrame) -> DataFrame:
    return ngrams.top_n(coded.pair_counts(ids).drop("followed"), ["prev_id"], "next_id", TOP_N)


def base_pairs(ids: DataFrame) -> DataFrame:
    return coded.top_pairs(coded.pair_counts(ids), MAX_PAIRS)


def base_trigrams(ids: DataFrame) -> DataFrame:
    return ngrams.top_n(coded.trigram_counts(ids, base_pairs(ids)), ["w1", "w2"], "next_id", TOP_N)


def token_counts(spark, sf):
    return tokens(documents(spark, sf)).filter("token <> ''").groupBy("token").agg(F.count("*").alias("cnt"))


def token_counts_syllable(spark, sf):
    return tokens(documents(spark, sf), "syllable").groupBy("token").agg(F.count("*").alias("cnt"))


def token_counts_history(spark, sf):
    return tokens(read(spark, sf, "conversations"), "history", keys=("conv_id", "turn")).groupBy("token").agg(F.count("*").alias("cnt"))


def lexicon_build(spark, sf):
    return base_lexicon(spark, sf)


def combined_parse(spark, sf):
    lines = read(spark, sf, "part").select(F.expr(COMBINED_LINES).alias("line"))
    return lexicon.build_lexicon(parse_combined(lines))


def pack_unpack(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 256).cast("int").alias("prob"), (F.col("p_size") % 2).cast("int").alias("flags"))
    v = pack(F.col("prob"), F.col("flags"), F.col("p_partkey"))
    back = unpack(F.col("packed"))
    return p.select("p_partkey", v.alias("packed")).select("p_partkey", "packed", *(c.cast("long").alias(k) for k, c in back.items()))


def canonical_exact_first(spark, sf):
    return base_names(spark, sf)


def canonical_max_prob(spark, sf):
    return lexicon.canonical(base_lexicon(spark, sf), "max_prob")


def _phrase_lines(spark, sf):
    part = read(spark, sf, "part")
    return part.select((F.col("p_partkey") - 1).alias("line_no"), F.to_json(F.struct(F.col("p_name").alias("text"), F.col("p_brand").alias("source"))).alias("line"))


def phrase_dict(spark, sf):
    return lexicon.phrases(parse_phrases(_phrase_lines(spark, sf)))


def syllable_dict(spark, sf):
    return lexicon.syllables(parse_phrases(_phrase_lines(spark, sf)))


def bigram_counts(spark, sf):
    return ngrams.bigram_counts(token_lines(documents(spark, sf)))


def bigram_topn_weighted(spark, sf):
    return ngrams.top_n(bigram_counts(spark, sf), ["prev"], "next", TOP_N)


def bigram_ids(spark, sf):
    return base_bigrams(base_ids(spark, sf))


def bigram_max_prob(spark, sf):
    return base_bigrams(base_ids(spark, sf, rule="max_prob"))


def bigram_syllable(spark, sf):
    return base_bigrams(base_ids(spark, sf, "syllable"))


def trigram_pairs_topk(spark, sf):
    return base_pairs(base_ids(spark, sf))


def trigram_topn(spark, sf):
    return base_trigrams(base_ids(spark, sf))


def trigram_syllable(spark, sf):
    return base_trigrams(base_ids(spark, sf, "syllable"))


def build_counters(spark, sf):
    """One row: lines, bigrams, distinct pairs and contexts of the corpus."""
    own = kept(bigram_counts(spark, sf))
    n = documents(spark, sf).select(F.size(F.split("text", "\n")).alias("n")).agg(F.sum("n").alias("lines"))
    rows = own.agg(F.sum("cnt").alias("bigrams"), F.count("*").alias("pairs"), F.count_distinct("prev").alias("contexts")).unionByName(n, allowMissingColumns=True)
    return rows.agg(*(F.max(c).alias(c) for c in ("lines", "bigrams", "pairs", "contexts")))


def bigram_pruned(spark, sf):
    return coded.bigrams_pruned(documents(spark, sf), TOP_N)


def _turns(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", "text")


def suggest_bigram(spark, sf):
    m = _model(spark, sf)
    return suggest.suggest(_turns(spark, sf), m.names, m.lexicon, m.bigram, keys=["conv_id", "turn"], lower=True)


def suggest_hybrid(spark, sf):
    m = _model(spark, sf)
    return suggest.suggest(_turns(spark, sf), m.names, m.lexicon, m.bigram, m.trigram, keys=["conv_id", "turn"])


def suggest_gated(spark, sf):
    m = _model(spark, sf)
    return suggest.suggest(_turns(spark, sf), m.names, m.lexicon, m.bigram, m.trigram, suggest.BOOST_EN, keys=["conv_id", "turn"])


def suggest_syllable(spark, sf):
    """By the last syllable as it is written, punctuation and all."""
    m = _model(spark, sf, "syllable")
    return suggest.suggest(_turns(spark, sf), m.names, m.lexicon, m.bigram, keys=["conv_id", "turn"], mode="syllable")


def suggest_syllable_gated(spark, sf):
    """Syllables with back-off and the Vietnamese list first."""
    m = _model(spark, sf, "syllable")
    return suggest.suggest(_turns(spark, sf), m.names, m.lexicon, m.bigram, m.trigram, suggest.BOOST_VI, keys=["conv_id", "turn"], mode="syllable")


def batch_prefixes(spark, sf):
    return suggest.expand_prefixes(_turns(spark, sf), ["conv_id", "turn"])


def batch_report(spark, sf):
    """Every expanding prefix of every turn with the model that answers it and its five suggestions."""
    m = _model(spark, sf)
    return suggest.prefix_report(_turns(spark, sf), m.names, m.lexicon, m.bigram, m.trigram, suggest.BOOST_EN, keys=["conv_id", "turn"])


def prefix_search(spark, sf):
    return lexicon.prefix(_model(spark, sf).lexicon, "Th")


def prefix_matches(spark, sf):
    starts = spark.createDataFrame([("pre",), ("an",), ("Th",), ("zzzz",)], "start string")
    return lexicon.prefix_counts(_model(spark, sf).lexicon, starts)


def _probes(spark):
    return spark.createDataFrame([(w,) for w in PROBES], "key string")


def exact_lookup(spark, sf):
    return lexicon.lookup(_model(spark, sf).lexicon, _probes(spark), "exact")


def first_lookup(spark, sf):
    return lexicon.lookup(_model(spark, sf).lexicon, _probes(spark), "first")


def history_word_score(spark, sf):
    """A purchase is an accepted suggestion, every other event a use."""
    e = read(spark, sf, "events")
    freq = F.sum(F.when(F.col("event_type") == "purchase", 3).otherwise(1))
    acc = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    own = e.groupBy("user_id").agg(freq.alias("freq"), acc.alias("accept"), F.max(F.unix_timestamp("ts")).alias("last_used"))
    return own.select("user_id", "freq", "accept", "last_used", word_score(F.col("freq"), F.col("accept"), F.col("last_used"), NOW).alias("score"), word_score(F.col("freq"), F.lit(0), F.col("last_used"), NOW).alias("base_score"))


def _event_pairs(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("at"))
    kinds = F.create_map(*(x for k, v in (("signup", 0), ("purchase", 1), ("error", 2), ("view", 3), ("click", 4)) for x in (F.lit(k), F.lit(v))))
    return history.followed(e.withColumn("id", kinds[F.col("event_type")].cast("long")))


def _event_edges(spark, sf):
    return _event_pairs(spark, sf).groupBy("user_id", "prev_id", "next_id").agg(F.count("*").alias("count"), F.max("at").alias("last_used"))


def history_edge_score(spark, sf):
    from ..functions import edge_score

    return _event_edges(spark, sf).withColumn("score", edge_score(F.col("count"), F.col("last_used"), NOW))


def history_predict(spark, sf):
    return history.predict(_event_edges(spark, sf), NOW)


def _messages(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("user_id"), F.col("turn").alias("seq"), (F.lit(NOW) - 86_400 * (F.col("turn") % 30)).alias("now"), "text")


def _learned(spark, sf):
    """Global words are those that the documents have in lower case."""
    return history.learn(_messages(spark, sf), _known(spark, sf))


def _known(spark, sf):
    return _model(spark, sf).lexicon.filter("word = lower(word) AND prob >= 20").select(F.col("word").alias("lower"), "word_id")


def history_learn_words(spark, sf):
    return _learned(spark, sf)[0]


def history_learn_edges(spark, sf):
    return _learned(spark, sf)[1]


def history_prefix(spark, sf):
    return history.prefix(_learned(spark, sf)[0], "Th", NOW)


def history_accept(spark, sf):
    """Private words after those that begin a message were accepted."""
    uses = kept(history.resolved(_messages(spark, sf), _known(spark, sf)))
    return history.accept(_learned(spark, sf)[0], uses.filter("own AND pos = 0").select("user_id", "word_id", "now"))


def history_merge(spark, sf):
    """A history merged with another that is three thousand million times as strong: counts stay within 32 bits."""
    words = _learned(spark, sf)[0]
    return history.merge_words(words, words.withColumn("freq", F.col("freq") * 3_000_000_000))


def history_prune(spark, sf):
    return history.pruned(_event_edges(spark, sf), NOW, 3, 2)


def history_lookup(spark, sf):
    """The private ids of some words by user, and back from these to words."""
    words = kept(_learned(spark, sf)[0])
    keys = words.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, PROBES))).alias("word"))
    found = history.lookup(words, keys).filter("word_id IS NOT NULL")
    return history.lookup(words, found.select("user_id", "word_id"))


def history_saved(spark, sf):
    """The edges of a history that was written and read back."""
    path = _folder(spark, "history")
    write_history(*_learned(spark, sf), path)
    return read_history(spark, path)[1]


def val_integrity(spark, sf):
    return validate.integrity(_model(spark, sf).lexicon)


def val_invariants(spark, sf):
    m = _model(spark, sf)
    return validate.invariants(m.bigram, ["prev_id"], "next_id", TOP_N, m.lexicon.count())


def _lengths(spark, sf):
    m = _model(spark, sf)
    return validate.list_lengths(m.lexicon, m.bigram)


def val_coverage(spark, sf):
    return validate.coverage(_lengths(spark, sf))


def val_histogram(spark, sf):
    return validate.histogram(_lengths(spark, sf), TOP_N)


def val_percentiles(spark, sf):
    return validate.percentiles(_lengths(spark, sf))


def val_probe(spark, sf):
    m = _model(spark, sf)
    return validate.probe(_probes(spark), m.lexicon, m.bigram)


def lexicon_saved(spark, sf):
    return _model(spark, sf).lexicon


def vocabulary_saved(spark, sf):
    """Words by the numbers of their lines in the vocabulary file."""
    m = _model(spark, sf)
    m.lexicon.schema  # writes it
    return read_vocabulary(spark, f"{m.path}/lexicon/vocab")


def bigram_saved(spark, sf):
    return _model(spark, sf).bigram


def trigram_saved(spark, sf):
    return _model(spark, sf).trigram


def bigram_index(spark, sf):
    m = _model(spark, sf)
    return ngrams.edge_index(m.lexicon, m.bigram)


def bigram_display(spark, sf):
    """Successors by name for a vocabulary that lacks the words that occur once."""
    m = _model(spark, sf)
    return lexicon.named(m.bigram, m.lexicon.filter("prob > 1")).select("prev_id", "rank", "next_id", "next_word", "weight")


def wordlist_file(spark, sf):
    """A combined word list from gzip files."""
    path = _folder(spark, "wordlist")
    read(spark, sf, "part").select(F.expr(COMBINED_LINES).alias("line")).write.option("compression", "gzip").text(path)
    return lexicon.build_lexicon(parse_combined(wordlist(spark, path)))


def corpus_file(spark, sf):
    """Bigrams of a corpus that was written as gzip text, a line for each line."""
    path = _folder(spark, "corpus")
    documents(spark, sf).select("text").write.option("compression", "gzip").text(path, lineSep="\n")
    return ngrams.bigram_counts(token_lines(corpus(spark, path, limit_millions=1_000_000)))


def phrase_file(spark, sf):
    """Phrases from a file of JSON lines, by the numbers of its lines; every seventh is blank."""
    path = _folder(spark, "phrases")
    own = _phrase_lines(spark, sf).repartitionByRange("line_no").sortWithinPartitions("line_no")
    own.select(F.when(F.col("line_no") % 7 == 6, "").otherwise(F.col("line"))).write.text(path)
    return lexicon.phrases(parse_phrases(numbered_lines(spark, path)))


def report_file(spark, sf):
    path = _folder(spark, "report")
    df = batch_report(spark, sf)
    write_report(df, path)
    return read_report(spark, path, df.schema.simpleString()[7:-1].replace(":", " "))


def _stream(spark, sf, table):
    """All files of a table as a stream that ends."""
    own = read(spark, sf, table)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{sf}/{table}.parquet")
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = spark.readStream.schema(own.schema)
    return stream.parquet(f"{sf}/{table}.parquet") if whole else stream.option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def _ended(spark, writer, name):
    writer.option("checkpointLocation", _folder(spark, name)).trigger(availableNow=True).start().awaitTermination()


def stream_bigrams(spark, sf):
    """Bigram counts of the documents as a stream, as they stand at its end."""
    path = _folder(spark, "stream")
    stream = bigram_stream(_stream(spark, sf, "documents"))
    _ended(spark, stream.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.parquet(f"{path}/{n:09d}")), "offsets")
    return spark.read.parquet(f"{path}/*").groupBy("prev", "next").agg(F.max("cnt").alias("cnt"))


def stream_learn(spark, sf):
    """Edges of histories learned from the conversations as a stream."""
    path = _folder(spark, "learned")
    c = _stream(spark, sf, "conversations")
    messages = c.select(F.col("conv_id").alias("user_id"), F.col("turn").alias("seq"), (F.lit(NOW) - 86_400 * (F.col("turn") % 30)).alias("now"), "text")
    _ended(spark, learn_stream(messages, _known(spark, sf), path), "offsets")
    return history_state(spark, path)[1]


def stream_tracked(spark, sf):
    """Bounded successors of each event kind of each user, as the stream's state holds them at its end."""
    path = _folder(spark, "tracked")
    uses = _folder(spark, "uses")
    _event_pairs(spark, sf).select("user_id", "prev_id", "next_id", F.col("at").alias("now")).write.parquet(uses)
    stream = track_stream(spark.readStream.schema(spark.read.parquet(uses).schema).parquet(uses))
    _ended(spark, stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.parquet(f"{path}/{n:09d}")), "offsets")
    return history.merge_edges(spark.read.parquet(f"{path}/*").groupBy("user_id", "prev_id", "next_id").agg(F.max("count").alias("count"), F.max("last_used").alias("last_used")))


QUERIES = {
    f.__name__: f
    for f in (
        token_counts, token_counts_syllable, token_counts_history, lexicon_build, combined_parse, pack_unpack, canonical_exact_first, canonical_max_prob, phrase_dict, syllable_dict,
        bigram_counts, bigram_topn_weighted, bigram_ids, bigram_max_prob, bigram_syllable, trigram_pairs_topk, trigram_topn, trigram_syllable, build_counters, bigram_pruned,
        suggest_bigram, suggest_hybrid, suggest_gated, batch_prefixes, batch_report, prefix_search, prefix_matches, exact_lookup, first_lookup,
        suggest_syllable, suggest_syllable_gated, lexicon_saved, vocabulary_saved, bigram_saved, trigram_saved, bigram_index, bigram_display, wordlist_file, corpus_file, phrase_file, report_file,
        history_word_score, history_edge_score, history_predict, history_learn_words, history_learn_edges, history_prefix, history_accept, history_merge, history_prune, history_lookup, history_saved,
        stream_bigrams, stream_learn, stream_tracked,
        val_integrity, val_invariants, val_coverage, val_histogram, val_percentiles, val_probe,
    )
}


def entry(spark: SparkSession) -> DataFrame:
    """The first ten successors of each word of the smallest documents, with weights."""
    return bigram_topn_weighted(spark, "/root/testdata/sf0.001")
