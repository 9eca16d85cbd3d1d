"""DuckDB SQL for those registered queries that SQL can express on whole tables."""

from __future__ import annotations

from . import urls

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE_WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_SPACE_WORD}')) AS ls FROM documents),
  g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
  c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g),
  r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM c, range(0, 5) AS x(j) WHERE k > 1 GROUP BY 1),
  s AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
  f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_dup_lines > 3 * n_lines AS soft FROM s),
  h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR soft) AS k FROM f GROUP BY 1),
  m AS (SELECT sum(k) / sum(n) AS m FROM h),
  v AS (SELECT any_value(m) AS m, sum(n * (k / n - m) * (k / n - m)) / sum(n) AS v FROM h, m),
  p AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e4) ELSE 1e4 END AS z FROM v),
  i AS (SELECT host, n, m, z, (k + m * z) / (n + z) AS rate FROM h, p),
  j AS (SELECT host, rate - 0.5 > 2 * sqrt(rate * (1 - rate) / (n + z + 1)) AS dropped, rate > m AND rate - m >= 0.674 * sqrt(rate * (1 - rate) / (n + z + 1)) AS strict FROM i)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT dropped AND NOT (strict AND soft) AS kept FROM f JOIN j USING (host)
"""

_rules = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in urls.RULES)
URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
  f AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(h) DESC) AS k FROM p, (VALUES {_rules}) AS t(rule, h, start, verdict) WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id AND k = 1
"""

_words = lambda c: rf"regexp_extract_all(translate(coalesce({c}, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item_id, {_words('text')} AS w FROM benchmark),
  bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS s FROM b WHERE len(w) > 0)),
  dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw))),
  m AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, win)),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY 1),
  it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_links = lambda percent: rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_SPACE_WORD}') AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= {percent} * (x.n + y.n - k)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
"""  # noqa: E731
JACCARD = _links(85) + "SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY 1, 2"
MINHASH = _links(80) + "SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY 1, 2"

# crc32 by its table of 256, which is made from the polynomial; near words by what is left without one code point
SPELLING = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
  o AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
  u AS (SELECT i, run, count(*) AS k, hex(encode(i || ':' || run)) AS x FROM o WHERE length(run) >= 7 GROUP BY 1, 2),
  h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h FROM u, t),
  w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND n >= 2),
  d AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS s FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS p FROM w)),
  e AS (SELECT a.word AS a, b.word AS b, b.n AS bn FROM d a JOIN d b ON a.s = b.s AND a.p = b.p AND a.word <> b.word UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.s = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.s = w.word),
  f AS (SELECT a, count(*) AS n_near, max(bn) AS m FROM e GROUP BY 1),
  g AS (SELECT f.a, n_near, m, min(b) AS form FROM f JOIN e ON e.a = f.a AND bn = m GROUP BY 1, 2, 3),
  r AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN form END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN g ON a = word),
  c(word, root) AS (SELECT word, word FROM r UNION ALL SELECT c.word, r.form FROM c JOIN r ON c.root = r.word WHERE r.form IS NOT NULL)
SELECT r.word, r.form, c.root, r.n, r.n_near, r.form_n FROM r JOIN c ON c.word = r.word JOIN r z ON z.word = c.root AND z.form IS NULL
"""

_assigned = lambda books: f"""
  SELECT vec_id, label, p, x, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT v.*, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM v JOIN {books} USING (p)) GROUP BY ALL"""  # noqa: E731
_means = lambda books, found: f"""
  SELECT p, e, coalesce(m, c) AS c FROM {books} LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS m FROM (SELECT p, e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM {found}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM v))) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (p, e)"""  # noqa: E731
CODES = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
  v AS MATERIALIZED (SELECT vec_id, label, p, list_slice(x, p * len(x) // 16 + 1, (p + 1) * len(x) // 16) AS x FROM k, (SELECT unnest(range(16)) AS p)),
  b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY 1 LIMIT 64)),
  a0 AS MATERIALIZED ({_assigned('b0')}), b1 AS MATERIALIZED ({_means('b0', 'a0')}), a1 AS MATERIALIZED ({_assigned('b1')}), b2 AS MATERIALIZED ({_means('b1', 'a1')}), a2 AS MATERIALIZED ({_assigned('b2')}),
  r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY 1, 2),
  s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM r, s
"""

ORACLES = {"op2_quality_rules": QUALITY, "op5_url_filters": URLS, "op7_decontamination": CONTAMINATION, "op9_jaccard_join": JACCARD, "op11_spelling_variants": SPELLING, "op12_minhash": MINHASH, "op13_vector_codes": CODES}
