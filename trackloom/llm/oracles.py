"""SQL of the operators whose results SQL determines."""

from __future__ import annotations

# The table of the CRC-32 polynomial and a check sum of a list of bytes with it.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i))"""


def crc32_sql(bytes_sql: str, table: str = "t") -> str:
    """CRC-32 of an expression that gives a list of bytes as BIGINT."""
    return (f"xor(list_reduce(list_prepend(4294967295, {bytes_sql}), "
            f"lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)")


_ASCII = "list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)"
# The UTF-8 bytes of a text.
_UTF8 = ("list_transform(range(1, length(hex(encode({0}))), 2), "
         "lambda k: ('0x' || substr(hex(encode({0})), k, 2))::BIGINT)")

# A forward pass over the rows of all conversations, one row a round: the least (cost,
# edits) for every state, 0 nothing, 1 after s, 2 after u, 3 after a.
REPAIR_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql(_ASCII.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS draw
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, range(CASE draw WHEN 3 THEN 2 ELSE 1 END) WHERE draw <> 0),
faulty AS (
  SELECT *, substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM damaged),
lines AS (
  SELECT conv_id, turn, role, text, initial, i,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM faulty),
-- Insertions that can be of use between two rows, and what a row's edit does.
gap(p, q, edits, cost) AS (
  VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 2), (1, 2, 'I', 2), (3, 2, 'I', 2),
    (2, 3, 'I', 2), (0, 3, 'II', 4), (1, 3, 'II', 4)),
follow(p, q, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS p, {{'cost': 0::BIGINT, 'edits': ''}} AS value FROM conversations
  UNION ALL
  SELECT b.conv_id, l.i, e.q, min({{'cost': b.value.cost + g.cost + e.cost, 'edits': b.value.edits || g.edits || e.edit}})
  FROM best b JOIN gap g ON g.p = b.p
  JOIN lines l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.i = b.i + 1
  JOIN (
    SELECT p, q, 'D' AS edit, 3 AS cost, NULL AS initial, NULL AS truncated FROM gap WHERE edits = ''
    UNION ALL SELECT p, q, 'K', t, initial, t FROM follow, range(2) AS r(t)
    UNION ALL SELECT p, q, 'R', 2 + t, NULL, t FROM follow, range(2) AS r(t) WHERE initial <> 's') e
  ON e.p = g.q AND (e.initial IS NULL OR e.initial = l.initial)
    AND (e.truncated IS NULL OR (e.truncated = (l.fault IS NOT NULL)::INT AND coalesce(l.fault, '') NOT IN ('blank', 'duplicate')))
  GROUP BY b.conv_id, l.i, e.q),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM lines GROUP BY conv_id),
audits AS (
  SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
    coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
    min({{'cost': b.value.cost + g.cost, 'edits': b.value.edits || g.edits}}) AS value
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
  JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = coalesce(s.n, 0)
  JOIN gap g ON g.p = b.p AND g.q IN (0, 3)
  GROUP BY ALL),
edits AS (
  SELECT conv_id, k, substr(value.edits, k, 1) AS edit,
    k - length(replace(substr(value.edits, 1, k), 'I', '')) AS inserts
  FROM (SELECT conv_id, value, unnest(range(1, length(value.edits) + 1)) AS k FROM audits)),
kept AS (
  SELECT e.conv_id, e.k, e.edit, l.role, l.initial, CASE WHEN e.edit = 'I' THEN '' ELSE l.text END AS text,
    row_number() OVER (PARTITION BY e.conv_id ORDER BY k) AS place
  FROM edits e LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND e.edit <> 'I' AND l.i = e.k - e.inserts
  WHERE e.edit <> 'D'),
written AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY k) AS body
  FROM (SELECT *, max((place = 1 AND edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY conv_id) AS led FROM kept)
  GROUP BY conv_id)
SELECT a.conv_id, gaps, blank, duplicate, truncated, illegal, a.value.cost AS cost, a.value.edits AS audit,
  sha256(coalesce(w.body, '')) AS repaired_sha256
FROM audits a LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""

_REPEATED = """
windows AS (
  SELECT row_id, i, array_to_string(words[i:i + 4], ' ') AS part
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 3)) AS i FROM cut WHERE len(words) >= 5)),
again AS (
  SELECT row_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY row_id, part) > 1),
repeated AS (
  SELECT row_id, sum(least(5, coalesce(next - i, 5))) AS n_repeat_words
  FROM (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS next FROM again) GROUP BY row_id)"""

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

QUALITY_SQL = rf"""
WITH {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
{_REPEATED},
base AS (
  SELECT c.row_id, c.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: translate(x, {_WHITE}, '') <> ''))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: translate(x, {_WHITE}, '') <> ''))) AS n_dup_lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM cut c LEFT JOIN repeated r USING (row_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
tokens AS (
  SELECT row_id, unnest(t) AS token, unnest(range(len(t))) AS place
  FROM (SELECT row_id, regexp_extract_all(lower(text),
    '[a-z0-9_\x80-\x{{FFFF}}]+|[^\x20\x09-\x0Da-z0-9_\x80-\x{{FFFF}}]+') AS t FROM docs)),
sums AS (SELECT token, {crc32_sql(_UTF8.format("token"))} AS h
  FROM (SELECT DISTINCT token FROM tokens), crc),
hashed AS (
  SELECT row_id, h, lead(h) OVER (PARTITION BY row_id ORDER BY place) AS following FROM tokens JOIN sums USING (token)),
grams AS (
  SELECT row_id, h % 16384 AS bucket FROM hashed
  UNION ALL SELECT row_id, (h * 1000003 + following) % 16384 FROM hashed WHERE following IS NOT NULL),
worst AS (
  SELECT doc_id, min(quality) AS quality, max(coalesce(toxic, 0)) AS toxic,
    {crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)", "any_value(t)")} AS draw
  FROM labels, crc WHERE doc_id IS NOT NULL GROUP BY doc_id),
sample AS (
  SELECT doc_id, kind FROM (
    SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY draw, doc_id) AS place
    FROM (SELECT doc_id, draw, CASE WHEN quality = 0 THEN 'poor' WHEN quality = 1 AND toxic = 0 AND draw % 4 = 0 THEN 'good'
      WHEN quality = 1 AND toxic = 0 THEN 'fit' END AS kind FROM worst))
  WHERE place <= CASE kind WHEN 'fit' THEN 20000 ELSE 5000 END AND kind IS NOT NULL),
counts AS (
  SELECT b AS bucket, count(g.bucket) AS raw, count(CASE WHEN s.kind = 'fit' THEN 1 END) AS target
  FROM range(16384) AS r(b) LEFT JOIN grams g ON g.bucket = b LEFT JOIN docs d USING (row_id) LEFT JOIN sample s USING (doc_id)
  GROUP BY b),
weights AS (
  SELECT bucket, ln((target + 1.0) / ((SELECT sum(target) FROM counts) + 16384.0))
    - ln((raw + 1.0) / ((SELECT sum(raw) FROM counts) + 16384.0)) AS weight FROM counts),
scores AS (
  SELECT j.*, coalesce(s.score, 0) AS score
  FROM judged j LEFT JOIN (SELECT row_id, avg(weight) AS score FROM grams JOIN weights USING (bucket) GROUP BY row_id) s USING (row_id)),
steps AS (
  SELECT floor(score * 256) AS step, count(*) FILTER (kind = 'good') AS good, count(*) FILTER (kind = 'poor') AS poor
  FROM scores JOIN sample USING (doc_id) WHERE kind <> 'fit' AND NOT base_failed GROUP BY 1),
cuts AS (
  SELECT step, coalesce(lag(step) OVER w + 1, step) AS low, sum(good) OVER () AS goods, sum(poor) OVER () AS poors,
    sum(good) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
    coalesce(sum(poor) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM steps WINDOW w AS (ORDER BY step)),
threshold AS (
  SELECT floor((low + step) / 2) / 256 AS least FROM cuts WHERE goods > 0 AND poors > 0
  ORDER BY above * poors + below * goods DESC, step LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND score >= coalesce((SELECT least FROM threshold), score) AS kept
FROM scores
"""

_RUN = _UTF8.format("(coalesce(doc_id::VARCHAR, '') || ':' || run)")

VARIANT_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
drawn AS (SELECT run, n, {crc32_sql(_RUN)} AS h FROM runs, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
      ELSE run END AS word, n FROM drawn)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.head || g.tail
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.head || g.tail),
best AS (SELECT word, count(*) AS n_near, min({{'n': -other_n, 'form': other}}) AS best FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * n THEN best.form END AS form,
    CASE WHEN -best.n >= 2 * n THEN -best.n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
