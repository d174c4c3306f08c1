"""DuckDB SQL of the queries that SQL can express in full.

The learned verdicts (1, 2, 3, 7, 9, 10) cannot be put in SQL, nor the
bisected weights (8) and the eigenvectors (12). Chat formatting (5) is stated
from the input turns, spelling variants (11) by patterns with one place left
open, and the two joins (6, 13) by counting shared shingles of all pairs.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP4 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT cast(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
patterns AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) t),
sizes AS (SELECT DISTINCT k FROM patterns),
windows AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k) t),
found AS (SELECT doc_id, windows.k, i, item FROM windows JOIN patterns ON windows.k = patterns.k AND windows.p = patterns.p),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS word FROM found) t GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM found GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  cast(coalesce(n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CONTROL = r"\\|<\|[^|<>]*\|>|</?s>|\[/?INST\]|<</?SYS>>"

_OP5 = f"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length('<|turn|><|text|><|end|>') + length(role) + length(text)
    + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def _join(percent: int, kept: bool) -> str:
    words = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_of AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_of JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= {percent} * (na.n + nb.n - k)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id WHERE root < b),
roots AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT doc_id, cast(coalesce(n, 0) AS BIGINT) AS n_shingles, root AS component_id{", doc_id = root AS kept" if kept else ""}
FROM roots LEFT JOIN n USING (doc_id)
"""


_OP11 = f"""
WITH RECURSIVE steps(b, k, c) AS (SELECT cast(range AS UBIGINT), 0, cast(range AS UBIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, cast(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT b, c FROM steps WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM
  (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents) t GROUP BY doc_id, run),
keyed AS (SELECT row_number() OVER () AS id, run, n, hex(encode(coalesce(cast(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
walk(id, h, k, c) AS (SELECT id, h, 0, cast(4294967295 AS UBIGINT) FROM keyed
  UNION ALL SELECT id, h, walk.k + 1, xor(crc.c, walk.c >> 8) FROM walk JOIN crc ON crc.b = xor(walk.c & 255, cast(
    16 * strpos('0123456789ABCDEF', substr(h, 2 * walk.k + 1, 1)) + strpos('0123456789ABCDEF', substr(h, 2 * walk.k + 2, 1)) - 17 AS UBIGINT))
  WHERE walk.k < length(h) // 2),
hashed AS (SELECT run, n, cast(xor(c, cast(4294967295 AS UBIGINT)) AS BIGINT) AS h FROM keyed JOIN walk USING (id)
  WHERE walk.k = length(walk.h) // 2),
noisy AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, cast(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, left(word, i - 1) AS x, substr(word, i + 1) AS y
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) t),
short AS (SELECT DISTINCT holes.word, holes.n, words.word AS other, words.n AS m FROM holes JOIN words ON words.word = x || y),
pairs AS (SELECT p.word, q.word AS other, q.n AS m FROM holes p JOIN holes q ON p.x = q.x AND p.y = q.y AND p.word <> q.word
  UNION ALL SELECT word, other, m FROM short UNION ALL SELECT other, word, n FROM short),
ranked AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near,
  row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM pairs),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (word)),
chain(word, root, depth) AS (SELECT word, word, 0 FROM formed
  UNION ALL SELECT chain.word, formed.form, depth + 1 FROM chain JOIN formed ON formed.word = root WHERE formed.form IS NOT NULL),
ends AS (SELECT word, root FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY depth DESC) AS place FROM chain) t WHERE place = 1)
SELECT word, form, root, n, cast(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN ends USING (word)
"""

ORACLES = {"op4_decontamination": _OP4, "op5_chat_format": _OP5, "op6_jaccard_join": _join(90, kept=False),
           "op11_spelling_variants": _OP11, "op13_minhash_near_dedup": _join(85, kept=True)}
