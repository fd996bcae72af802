"""DuckDB SQL for the operators whose whole result SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_LOWER = "".join(chr(ord(c) + 32) for c in _UPPER)

#: texts(doc_id, w): the words of each text
TEXTS = f"""texts AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
 FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""

#: from members(member, id), points(id, head, holders), near(a, b) and every(id): the class and links of each
CLASSES = """
twoway AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
degree AS (SELECT a AS id, count(*) AS n FROM twoway GROUP BY a),
edges AS (SELECT DISTINCT x.head AS a, y.head AS b FROM twoway JOIN points x ON x.id = twoway.a JOIN points y ON y.id = twoway.b
 UNION SELECT head, member FROM members JOIN points USING (id) UNION SELECT member, head FROM members JOIN points USING (id)),
reach AS (SELECT member AS v, member AS root FROM members UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.v AND r.root < e.b),
class AS (SELECT v, min(root) AS root FROM reach GROUP BY v),
linked AS (SELECT member, sum(holders - 1 + coalesce(degree.n, 0)) AS links FROM members JOIN points USING (id) LEFT JOIN degree USING (id) GROUP BY member)
SELECT DISTINCT every.id AS {id}, coalesce(root, every.id) AS class_id, coalesce(links, 0)::BIGINT AS links FROM every LEFT JOIN class ON v = every.id LEFT JOIN linked ON member = every.id"""

JACCARD = (
    f"""WITH RECURSIVE {TEXTS},
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM texts WHERE len(w) > 0),
named AS (SELECT s, row_number() OVER () AS id, min(doc_id) AS head, count(*) AS holders FROM sets GROUP BY s),
points AS (SELECT id, head, holders, len(s) AS n FROM named),
members AS (SELECT doc_id AS member, id FROM sets JOIN named USING (s)),
grams AS (SELECT id, unnest(s) AS g FROM named),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
near AS (SELECT a, b FROM common JOIN points x ON x.id = a JOIN points y ON y.id = b WHERE 3 * c >= x.n + y.n),
every AS (SELECT doc_id AS id FROM documents WHERE doc_id IS NOT NULL),"""
    + CLASSES.format(id="doc_id")
)

PASSAGES = f"""WITH {TEXTS},
windows AS (SELECT DISTINCT doc_id, p - 1 AS p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM texts WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)),
second AS (SELECT h, low, min(doc_id) AS next FROM windows JOIN least USING (h) WHERE doc_id <> low GROUP BY ALL),
hits AS (SELECT doc_id, p, min(CASE WHEN doc_id = low THEN next ELSE low END) AS other FROM windows JOIN second USING (h) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked)
SELECT doc_id, min(p) AS first_word, max(p) + 50 - min(p) AS words, min(other) AS other_doc_id FROM runs GROUP BY doc_id, k"""

#: exact, where the operator has a recall
EMBEDDINGS = (
    """WITH RECURSIVE whole AS (SELECT vec_id AS member, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
named AS (SELECT v, row_number() OVER () AS id, min(member) AS head, count(DISTINCT member) AS holders FROM whole GROUP BY v),
points AS (SELECT id, head, holders FROM named),
members AS (SELECT DISTINCT member, id FROM whole JOIN named USING (v)),
near AS (SELECT x.id AS a, y.id AS b FROM named x JOIN named y ON x.id < y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v::DOUBLE[], y.v::DOUBLE[]) >= 0.95 - 1e-7),
every AS (SELECT vec_id AS id FROM embeddings WHERE vec_id IS NOT NULL),"""
    + CLASSES.format(id="vec_id")
)
