"""DuckDB SQL of the queries that came last, written by another way than the operators go."""

CHAT_SQL = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 6 + CAST(regexp_matches(role, '^(System|User|Assistant)') AS INT) + len(regexp_replace(role, '[^:]', '', 'g')) END + 8 AS around,
    list_transform([text, CASE WHEN role IN ('system', 'user', 'assistant') THEN '' ELSE role END], lambda x: len(x) + len(regexp_replace(x, '[^\\]', '', 'g'))
      + coalesce(list_sum(list_transform(regexp_extract_all(x, '#{3,}'), lambda m: len(m) - 2)), 0) + len(regexp_extract_all(x, '</turn>|<\|endoftext\|>'))) AS inside
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(around + list_sum(inside)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) y USING (lang, source) LEFT JOIN (SELECT lang, v FROM v) z USING (lang)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), q AS (
  SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q FROM kept k JOIN v USING (lang)
), f AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pairs.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM f QUALIFY part = 'pair' OR rank <= 200
"""

#: Equal lengths meet by a pattern with one character hidden, others by a deletion; checksums go byte by byte.
SPELLING_SQL = r"""
WITH RECURSIVE table_ AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM (SELECT unnest(range(256))::BIGINT AS i)
), r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), h AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM (SELECT doc, run, count(*) AS times FROM r WHERE len(run) >= 6 GROUP BY doc, run) x, table_
), w AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN run[: h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word, times FROM h) x
  WHERE len(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), places AS (
  SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w
), hidden AS (
  SELECT word, n, word[: i - 1] || '?' || word[i + 1 :] AS pattern FROM places
), deleted AS (
  SELECT DISTINCT word, n, word[: i - 1] || word[i + 1 :] AS short FROM places
), shorter AS (
  SELECT d.word AS long, d.n AS long_n, w.word AS short, w.n AS short_n FROM deleted d JOIN w ON w.word = d.short
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM hidden a JOIN hidden b ON a.pattern = b.pattern AND a.word <> b.word
  UNION ALL SELECT long, short, short_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter
), best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n FROM w LEFT JOIN best b ON b.word = w.word
), ways AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT ways.word, forms.word, forms.form FROM ways JOIN forms ON forms.word = ways.next
)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways r ON r.word = f.word AND r.next IS NULL
"""
