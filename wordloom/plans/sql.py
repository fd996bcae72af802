"""The catalog's queries as SQL for another engine (DuckDB), from the same tables."""

from __future__ import annotations

from .catalog import COMBINED_LINES, NOW, PROBES
from .model import MAX_PAIRS, TOP_N

_BOOST_VI = "('là','của','và','có','những','trong','được','một','cho','với')"
_BOOST = "('to','for','are','is','of','the','a','in','on','that')"

LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
RAW = LINES + """, split AS (SELECT doc_id, line_no, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS l FROM lines),
raw AS (SELECT doc_id, line_no, generate_subscripts(l, 1) AS pos, unnest(l) AS piece FROM split)"""


def toks(mode: str = "corpus_en") -> str:
    token = "lower(piece)" if mode == "syllable" else "nullif(regexp_replace(lower(piece), '[^\\p{L}'']', '', 'g'), '')"
    return RAW + f", toks AS (SELECT doc_id, line_no, pos, {token} AS token FROM raw)"


LEXICON = """forms AS (SELECT regexp_replace(piece, '[^\\p{L}'']', '', 'g') AS word FROM raw),
counted AS (SELECT word, least(255, count(*))::INT AS prob FROM forms WHERE word <> '' GROUP BY word),
lex AS (SELECT word, (row_number() OVER (ORDER BY word) - 1)::BIGINT AS word_id, prob, CASE WHEN prob = 0 THEN 1 ELSE 0 END AS flags FROM counted)"""
PACKED = "(prob::BIGINT | (flags::BIGINT << 8) | (word_id << 16))"


def names(rule: str = "exact_first") -> str:
    order = {"exact_first": "(word <> lower(word)), -prob, word_id", "max_prob": "-prob, word_id"}[rule]
    return f"names AS (SELECT lower(word) AS lower, word_id FROM lex QUALIFY row_number() OVER (PARTITION BY lower(word) ORDER BY {order}) = 1)"


SYLLABLES = """names AS (SELECT lower, (row_number() OVER (ORDER BY lower) - 1)::BIGINT AS word_id FROM
 (SELECT DISTINCT trim(lower(piece), '-') AS lower FROM raw) WHERE regexp_matches(lower, '^[\\p{L}-]+$'))"""
PAIRS = """pairs AS (SELECT prev, token AS next, count(*) AS cnt FROM
 (SELECT token, lag(token) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS prev FROM toks) WHERE prev IS NOT NULL AND token IS NOT NULL GROUP BY ALL)"""
IDS = "pair_ids AS (SELECT a.word_id AS prev_id, b.word_id AS next_id, sum(cnt)::BIGINT AS cnt FROM pairs JOIN names a ON a.lower = prev JOIN names b ON b.lower = next GROUP BY ALL)"
TRI = """tri_ids AS (SELECT a.word_id AS w1, b.word_id AS w2, c.word_id AS next_id, count(*) AS cnt FROM
 (SELECT token, lag(token, 1) OVER w AS t2, lag(token, 2) OVER w AS t1 FROM toks WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos))
 JOIN names a ON a.lower = t1 JOIN names b ON b.lower = t2 JOIN names c ON c.lower = token GROUP BY ALL),
top_pairs AS (SELECT w1, w2, sum(cnt)::BIGINT AS cnt FROM tri_ids GROUP BY ALL ORDER BY cnt DESC, w1, w2 LIMIT %d)""" % MAX_PAIRS


def weighted(source: str, context: str, nxt: str) -> str:
    return f"""SELECT {context}, {nxt}, cnt, rank::INT AS rank,
 floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ln(cnt::DOUBLE) / greatest(ln((max(cnt) OVER (PARTITION BY {context}))::DOUBLE), 1.0::DOUBLE))) * 65535)::INT AS weight
 FROM (SELECT *, row_number() OVER (PARTITION BY {context} ORDER BY cnt DESC, {nxt}) AS rank FROM {source}) WHERE rank <= {TOP_N}"""


BASE = f"WITH {toks()}, {LEXICON}, {names()}, {PAIRS}, {IDS}"
BIGRAM = f"bigram AS ({weighted('pair_ids', 'prev_id', 'next_id')})"
TRIGRAM = f"trigram AS ({weighted('(SELECT * FROM tri_ids SEMI JOIN top_pairs USING (w1, w2))', 'w1, w2', 'next_id')})"


def suggested(queries: str, keys: str, tri: bool, gated: bool | str, lower: bool = False, syllable: bool = False) -> str:
    hits = "SELECT c.*, 'Bigram' AS model_used, next_id, rank, weight FROM ctx c JOIN bigram b ON b.prev_id = c.b2"
    if tri:
        hits = "SELECT c.*, 'Trigram' AS model_used, next_id, rank, weight FROM ctx c JOIN trigram t ON t.w1 = c.b1 AND t.w2 = c.b2 UNION ALL " + hits + " WHERE NOT EXISTS (SELECT 1 FROM trigram t WHERE t.w1 = c.b1 AND t.w2 = c.b2)"
    first = f"CASE WHEN word IN {gated if isinstance(gated, str) else _BOOST} THEN 0 ELSE 1 END" if gated else "0"
    token, lex = ("lower(x)", "(SELECT lower AS word, word_id FROM names) lex") if syllable else ("regexp_replace(lower(x), '[^\\p{L}'']', '', 'g')", "lex")
    shown = "lower(word)" if lower else "word"
    return f"""asked AS ({queries}),
cut AS (SELECT {keys}, text, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x: {token}) AS l FROM asked),
ctx AS (SELECT {keys}, text, b.word_id AS b2, a.word_id AS b1 FROM cut LEFT JOIN names b ON b.lower = l[-1] LEFT JOIN names a ON len(l) > 1 AND a.lower = l[-2]),
hits AS ({hits}),
placed AS (SELECT {keys}, text, model_used, row_number() OVER (PARTITION BY {keys} ORDER BY {first}, rank) AS place, {shown} AS word, weight FROM hits JOIN {lex} ON lex.word_id = next_id),
answers AS (SELECT {keys}, model_used, place::INT AS rank, word, weight, floor(weight / 65535.0::DOUBLE * 100)::INT AS confidence, text || ' ' || word AS completed FROM placed WHERE place <= 5)"""


TURNS = "SELECT conv_id, turn, text FROM conversations"
STEPS = """steps AS (SELECT conv_id, turn, step::INT AS step, array_to_string(l[1:step], ' ') AS context, l[step] AS last_word FROM
 (SELECT conv_id, turn, l, unnest(range(1, len(l))) AS step FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l FROM conversations)))"""
_SCORE = "floor(least(65535.0::DOUBLE, greatest(0.0::DOUBLE, {x})))::INT"
_DECAYED = f"pow(2.0::DOUBLE, -greatest({NOW} - last_used, 0) / {{h}}::DOUBLE)"
WORD_SCORE = _SCORE.format(x=f"ln(1 + freq * {_DECAYED.format(h=1209600)}) * 10000 + {{a}} * 3000")
EDGE_SCORE = _SCORE.format(x=f'ln(1 + "count" * {_DECAYED.format(h=604800)}) * 10000')
EDGES = """kinds AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 4 END::BIGINT AS id FROM events),
edges AS (SELECT user_id, prev_id, id AS next_id, count(*) AS "count", max(s) AS last_used FROM
 (SELECT *, lag(id) OVER (PARTITION BY user_id ORDER BY s, event_id) AS prev_id FROM kinds) WHERE prev_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL)"""
_HLIST = "list_filter(list_transform(list_filter(string_split_regex(nfc_normalize(text), '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(lower(translate(x, '’‘', '''''')), '[^\\p{L}'']', '', 'g')), lambda x: x <> '')"
LEARNED = f"""WITH {RAW}, {LEXICON}, known AS (SELECT word, word_id FROM lex WHERE word = lower(word) AND prob >= 20),
msgs AS (SELECT conv_id AS user_id, turn AS seq, {NOW} - 86400 * (turn % 30) AS now, {_HLIST} AS l FROM conversations),
said AS (SELECT user_id, seq, now, generate_subscripts(l, 1) AS pos, unnest(l) AS token FROM msgs),
firsts AS (SELECT user_id, token, min((seq, pos)) AS begun FROM said ANTI JOIN known ON known.word = token GROUP BY ALL),
own AS (SELECT user_id, token, 2147483648 + row_number() OVER (PARTITION BY user_id ORDER BY begun, token) - 1 AS own_id FROM firsts),
ided AS (SELECT s.*, coalesce(k.word_id, o.own_id) AS id, k.word_id IS NULL AS private FROM said s LEFT JOIN known k ON k.word = s.token LEFT JOIN own o ON o.user_id = s.user_id AND o.token = s.token),
user_word AS (SELECT user_id, token AS word, id AS word_id, count(*) AS freq, 0::BIGINT AS accept, max(now) AS last_used FROM ided WHERE private GROUP BY ALL),
user_edge AS (SELECT user_id, prev_id, id AS next_id, count(*) AS "count", max(now) AS last_used FROM
 (SELECT *, lag(id) OVER (PARTITION BY user_id, seq ORDER BY pos) AS prev_id FROM ided) WHERE prev_id IS NOT NULL GROUP BY ALL)"""
LENGTHS = "lens AS (SELECT lex.word_id, count(b.next_id) AS len FROM lex LEFT JOIN bigram b ON b.prev_id = lex.word_id GROUP BY ALL)"
_KEYS = ", ".join(f"('{w}')" for w in PROBES)

ORACLES = {
    "token_counts": f"WITH {toks()} SELECT token, count(*) AS cnt FROM toks WHERE token IS NOT NULL GROUP BY token",
    "token_counts_syllable": f"WITH {toks('syllable')} SELECT token, count(*) AS cnt FROM toks GROUP BY token",
    "token_counts_history": f"SELECT token, count(*) AS cnt FROM (SELECT unnest({_HLIST}) AS token FROM conversations) GROUP BY token",
    "lexicon_build": f"WITH {RAW}, {LEXICON} SELECT *, {PACKED} AS packed FROM lex",
    "combined_parse": f"""WITH src AS (SELECT trim({COMBINED_LINES}) AS line FROM part), kv AS (SELECT list_filter(string_split(line, ','), lambda x: contains(x, '=')) AS l FROM src WHERE starts_with(line, 'word=')),
 got AS (SELECT substr(list_filter(l, lambda x: starts_with(x, 'word='))[-1], 6) AS word, substr(list_filter(l, lambda x: starts_with(x, 'f='))[-1], 3) AS f FROM kv),
 num AS (SELECT word, CASE WHEN regexp_matches(f, '^\\+?[0-9]+$') AND try_cast(ltrim(f, '+') AS BIGINT) <= 65535 THEN least(255, try_cast(ltrim(f, '+') AS BIGINT)) ELSE 0 END AS prob FROM got WHERE word <> ''),
 lex AS (SELECT word, (row_number() OVER (ORDER BY word) - 1)::BIGINT AS word_id, prob::INT AS prob, CASE WHEN prob = 0 THEN 1 ELSE 0 END AS flags FROM (SELECT word, max(prob) AS prob FROM num GROUP BY word))
 SELECT *, {PACKED} AS packed FROM lex""",
    "pack_unpack": "SELECT p_partkey, (p_partkey % 256) | ((p_size % 2)::BIGINT << 8) | (p_partkey << 16) AS packed, p_partkey % 256 AS prob, (p_size % 2)::BIGINT AS flags, p_partkey AS word_id FROM part",
    "canonical_exact_first": f"WITH {RAW}, {LEXICON}, {names()} SELECT * FROM names",
    "canonical_max_prob": f"WITH {RAW}, {LEXICON}, {names('max_prob')} SELECT * FROM names",
    "phrase_dict": "SELECT lower(trim(p_name)) AS text, min(p_partkey - 1) AS word_id, 128 AS prob, 0 AS flags FROM part WHERE trim(p_name) <> '' GROUP BY 1",
    "syllable_dict": "SELECT text, row_number() OVER (ORDER BY text) - 1 AS word_id, 128 AS prob FROM (SELECT DISTINCT trim(unnest(string_split_regex(lower(p_name), '\\s+')), '-') AS text FROM part) WHERE regexp_matches(text, '^[\\p{L}-]+$')",
    "bigram_counts": f"WITH {toks()}, {PAIRS} SELECT * FROM pairs",
    "bigram_topn_weighted": f"WITH {toks()}, {PAIRS} {weighted('pairs', 'prev', 'next')}",
    "bigram_ids": f"{BASE} {weighted('pair_ids', 'prev_id', 'next_id')}",
    "bigram_max_prob": f"WITH {toks()}, {LEXICON}, {names('max_prob')}, {PAIRS}, {IDS} {weighted('pair_ids', 'prev_id', 'next_id')}",
    "bigram_syllable": f"WITH {toks('syllable')}, {SYLLABLES}, {PAIRS}, {IDS} {weighted('pair_ids', 'prev_id', 'next_id')}",
    "trigram_pairs_topk": f"WITH {toks()}, {LEXICON}, {names()}, {TRI} SELECT * FROM top_pairs",
    "trigram_topn": f"WITH {toks()}, {LEXICON}, {names()}, {TRI}, {TRIGRAM} SELECT * FROM trigram",
    "trigram_syllable": f"WITH {toks('syllable')}, {SYLLABLES}, {TRI}, {TRIGRAM} SELECT * FROM trigram",
    "build_counters": f"WITH {toks()}, {PAIRS} SELECT (SELECT count(*) FROM lines) AS lines, sum(cnt)::BIGINT AS bigrams, count(*) AS pairs, count(DISTINCT prev) AS contexts FROM pairs",
    "suggest_bigram": f"{BASE}, {BIGRAM}, {suggested(TURNS, 'conv_id, turn', False, False, True)} SELECT * FROM answers",
    "suggest_hybrid": f"{BASE}, {TRI}, {BIGRAM}, {TRIGRAM}, {suggested(TURNS, 'conv_id, turn', True, False)} SELECT * FROM answers",
    "suggest_gated": f"{BASE}, {TRI}, {BIGRAM}, {TRIGRAM}, {suggested(TURNS, 'conv_id, turn', True, True)} SELECT * FROM answers",
    "batch_prefixes": f"WITH {STEPS} SELECT * FROM steps",
    "batch_report": f"""{BASE}, {TRI}, {BIGRAM}, {TRIGRAM}, {STEPS}, {suggested('SELECT conv_id, turn, step, context AS text FROM steps', 'conv_id, turn, step', True, True)},
 shown AS (SELECT conv_id, turn, step, min(model_used) AS model_used, string_agg(word || '(' || weight || ')', ', ' ORDER BY rank) AS top_suggestions FROM answers GROUP BY ALL)
 SELECT steps.*, coalesce(model_used, 'None') AS model_used, coalesce(top_suggestions, '') AS top_suggestions FROM steps LEFT JOIN shown USING (conv_id, turn, step)""",
    "prefix_search": f"WITH {RAW}, {LEXICON} SELECT word, word_id, prob, flags FROM lex WHERE starts_with(word, 'Th') ORDER BY word LIMIT 10",
    "prefix_matches": f"WITH {RAW}, {LEXICON} SELECT start, count(word) AS matches FROM (VALUES ('pre'), ('an'), ('Th'), ('zzzz')) t(start) LEFT JOIN lex ON starts_with(word, start) GROUP BY start",
    "exact_lookup": f"WITH {RAW}, {LEXICON} SELECT key, word, word_id, prob, flags FROM (VALUES {_KEYS}) t(key) LEFT JOIN lex ON word = key",
    "first_lookup": f"WITH {RAW}, {LEXICON}, f AS (SELECT lower(word) AS low, min(word_id) AS i FROM lex GROUP BY 1) SELECT key, word, word_id, prob, flags FROM (VALUES {_KEYS}) t(key) LEFT JOIN f ON low = key LEFT JOIN lex ON word_id = i",
    "history_word_score": f"""WITH w AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END)::BIGINT AS freq, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS accept, max(floor(epoch(ts))::BIGINT) AS last_used
 FROM events GROUP BY user_id) SELECT *, {WORD_SCORE.format(a='accept')} AS score, {WORD_SCORE.format(a='0')} AS base_score FROM w""",
    "history_edge_score": f"WITH {EDGES} SELECT *, {EDGE_SCORE} AS score FROM edges",
    "history_predict": f"""WITH {EDGES}, s AS (SELECT *, {EDGE_SCORE} AS score FROM edges), r AS (SELECT user_id, prev_id, next_id, score, row_number() OVER (PARTITION BY user_id, prev_id ORDER BY score DESC, next_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 20""",
    "history_learn_words": f"{LEARNED} SELECT * FROM user_word",
    "history_learn_edges": f"{LEARNED} SELECT * FROM user_edge",
    "history_prefix": f"""{LEARNED}, s AS (SELECT user_id, word, word_id, {WORD_SCORE.format(a='accept')} AS score FROM user_word WHERE starts_with(word, 'th')),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, word)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
    "val_integrity": f"""WITH {RAW}, {LEXICON} 
 SELECT count(*) AS words, count(*) FILTER (b.word IS DISTINCT FROM a.word) AS wrong, (SELECT count(*) - count(DISTINCT word_id) FROM lex) AS shared_ids FROM (SELECT *, ({PACKED} >> 16) AS packed_id FROM lex) a LEFT JOIN lex b ON b.word_id = a.packed_id""",
    "suggest_syllable": f"WITH {toks('syllable')}, {SYLLABLES}, {PAIRS}, {IDS}, {BIGRAM}, {suggested(TURNS, 'conv_id, turn', False, False, syllable=True)} SELECT * FROM answers",
    "suggest_syllable_gated": f"WITH {toks('syllable')}, {SYLLABLES}, {PAIRS}, {IDS}, {TRI}, {BIGRAM}, {TRIGRAM}, {suggested(TURNS, 'conv_id, turn', True, _BOOST_VI, syllable=True)} SELECT * FROM answers",
    "bigram_index": f"{BASE}, {BIGRAM}, {LENGTHS} SELECT word_id, (coalesce(sum(len) OVER (ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8)::BIGINT AS \"offset\", len FROM lens",
    "bigram_display": f"{BASE}, {BIGRAM} SELECT prev_id, rank, next_id, coalesce(word, '<unknown>') AS next_word, weight FROM bigram LEFT JOIN (SELECT word_id, word FROM lex WHERE prob > 1) ON word_id = next_id",
    "phrase_file": """WITH l AS (SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS line_no FROM part)
 SELECT lower(trim(p_name)) AS text, min(line_no) AS word_id, 128 AS prob, 0 AS flags FROM l WHERE trim(p_name) <> '' AND (p_partkey - 1) % 7 <> 6 GROUP BY 1""",
    "history_accept": f"""{LEARNED}, a AS (SELECT user_id, id AS word_id, count(*) AS k, max(now) AS used FROM ided WHERE private AND pos = 1 GROUP BY ALL)
 SELECT w.user_id, word, w.word_id, least(freq + 3 * coalesce(k, 0), 4294967295)::BIGINT AS freq, least(accept + coalesce(k, 0), 4294967295)::BIGINT AS accept, greatest(last_used, used) AS last_used FROM user_word w LEFT JOIN a ON a.user_id = w.user_id AND a.word_id = w.word_id""",
    "history_merge": f"{LEARNED} SELECT user_id, word, word_id, least(freq + freq * 3000000000, 4294967295)::BIGINT AS freq, accept, last_used FROM user_word",
    "history_prune": f"""WITH {EDGES}, s AS (SELECT *, {EDGE_SCORE} AS score FROM edges), r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id, prev_id ORDER BY score DESC, next_id) AS r FROM s WINDOW w AS (PARTITION BY user_id, prev_id))
 SELECT user_id, prev_id, next_id, "count", last_used FROM r WHERE n <= 3 OR r <= 2""",
    "history_lookup": f"{LEARNED} SELECT user_id, word, word_id FROM user_word WHERE word IN ({', '.join(repr(w) for w in PROBES)})",
    "stream_tracked": f"WITH {EDGES} SELECT * FROM edges",
    "val_invariants": f"""{BASE}, {BIGRAM}, o AS (SELECT *, weight > lag(weight) OVER (PARTITION BY prev_id ORDER BY rank) AS up FROM bigram)
 SELECT count(*) AS edges, count(*) FILTER (up) AS order_errors, count(*) - count(DISTINCT (prev_id, next_id)) AS repeated_successors, count(*) FILTER (rank > {TOP_N}) AS rank_errors,
 count(*) FILTER (prev_id >= (SELECT count(*) FROM lex) OR next_id >= (SELECT count(*) FROM lex)) AS range_errors FROM o""",
    "val_coverage": f"{BASE}, {BIGRAM}, {LENGTHS} SELECT count(*) AS words, count(*) FILTER (len > 0) AS covered, round(count(*) FILTER (len > 0) * 100.0::DOUBLE / count(*), 6) AS percent FROM lens",
    "val_histogram": f"{BASE}, {BIGRAM}, {LENGTHS} SELECT least(len, {TOP_N})::INT AS bucket, count(*) AS words FROM lens GROUP BY 1",
    "val_percentiles": f"""{BASE}, {BIGRAM}, {LENGTHS}, s AS (SELECT list(len ORDER BY len) AS l FROM lens WHERE len > 0)
 SELECT l[1 + floor(len(l) * 0.1::DOUBLE)::INT] AS p10, l[1 + len(l) // 2] AS median, l[1 + floor(len(l) * 0.9::DOUBLE)::INT] AS p90 FROM s""",
    "val_probe": f"""{BASE}, {BIGRAM} SELECT key, n.word AS next_word, cnt, rank, weight FROM (VALUES {_KEYS}) t(key) LEFT JOIN names ON names.lower = key LEFT JOIN bigram ON prev_id = names.word_id LEFT JOIN lex n ON n.word_id = next_id""",
}
ORACLES |= {new: ORACLES[old] for new, old in (
    ("lexicon_saved", "lexicon_build"), ("bigram_saved", "bigram_ids"), ("trigram_saved", "trigram_topn"), ("wordlist_file", "combined_parse"), ("corpus_file", "bigram_counts"), ("report_file", "batch_report"),
    ("history_saved", "history_learn_edges"), ("stream_bigrams", "bigram_counts"), ("stream_learn", "history_learn_edges"),
)}
ORACLES["vocabulary_saved"] = f"WITH {RAW}, {LEXICON} SELECT word_id, word FROM lex"
