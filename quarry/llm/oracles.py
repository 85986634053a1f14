"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
one AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM lists) GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM (SELECT lang, q.a AS w1, q.b AS w2 FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS q FROM lists)) GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM (SELECT lang, q.a AS w1, q.b AS w2, q.c AS w3 FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}})) AS q FROM lists)) GROUP BY ALL HAVING count(*) >= 10),
around AS (SELECT lang, u, v, max(f) AS most FROM (SELECT lang, w1 AS u, w2 AS v, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT two.lang, w1 || ' ' || w2 AS phrase, two.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM two JOIN one x ON x.lang = two.lang AND x.p = w1 JOIN one y ON y.lang = two.lang AND y.p = w2
  LEFT JOIN around ON around.lang = two.lang AND u = w1 AND v = w2
  WHERE two.f >= 10 AND (most IS NULL OR 100 * most < 50 * two.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
  FROM three t JOIN one x ON x.lang = t.lang AND x.p = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.p = t.w3
), scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP13_RANKED = rf"""
WITH terms AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), docs AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM terms WHERE len(w) > 0),
stats AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM docs),
asked AS (
  SELECT item_id, word, count(*) AS often FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), postings AS (SELECT r, word, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS word FROM terms) SEMI JOIN asked USING (word) GROUP BY ALL),
weights AS (SELECT word, floor(1000 * ln((2 * (SELECT nd FROM stats) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM postings GROUP BY word),
scores AS (
  SELECT item_id, r, sum(often * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * (SELECT nd FROM stats)) // (SELECT nl FROM stats)))))::BIGINT AS score
  FROM asked JOIN weights USING (word) JOIN postings USING (word) JOIN docs USING (r) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores JOIN docs USING (r) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

OP12_REPEATS = r"""
WITH lists AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM lists),
windows AS (SELECT r, p, md5(array_to_string(w[p : p + 34], ' ')) AS d FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM lists)),
repeated AS (SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY d) > 1),
covered AS (SELECT words.r, words.p, word, max(repeated.p) OVER (PARTITION BY words.r ORDER BY words.p) AS last FROM words LEFT JOIN repeated ON repeated.r = words.r AND repeated.p = words.p),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM covered WHERE last IS NULL OR last <= p - 35 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM lists LEFT JOIN kept USING (r)
"""
