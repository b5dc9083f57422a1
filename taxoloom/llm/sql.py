"""The SQL of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op10_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents),
g AS (
  SELECT doc_id, plain,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY plain) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g
"""

ORACLE["op7_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, w, least(len(w), 13) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM iw)),
occ AS (
  SELECT d.doc_id, d.i, win.n, win.item_id FROM (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (
      SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win))) d
  JOIN win ON win.n = d.n AND win.s = d.s),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits ON hits.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""

ORACLE["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least ON win.s = least.s WHERE first_id < win.doc_id)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

ORACLE["op4_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + least(len(w), 5) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

ORACLE["op8_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || CAST(doc_id AS VARCHAR)) AS place FROM documents),
s AS (
  SELECT source, size, 2 * size AS most, k, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source)),
b AS (SELECT sum(size)::BIGINT * 150 / 100 AS budget FROM s),
r AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS given,
         sum(w) OVER (ORDER BY most::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS opened FROM s),
level AS (
  SELECT max(x) AS x FROM (
    SELECT (budget - given)::DOUBLE / opened AS x, most, w FROM r, b) WHERE most > w * x),
t AS (SELECT source, size AS source_size, k, least(most::DOUBLE, w * x) AS target FROM s, level),
q AS (
  SELECT d.*, source_size, k, target, sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, pass, CASE WHEN target > 0 THEN (pass * source_size + upto)::DOUBLE / target ELSE 0.0 END AS finish FROM q, (VALUES (0), (1)) v(pass)),
f AS (SELECT *, sum(size) OVER (ORDER BY finish, k, pass, place, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM p)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN spent <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM f, b GROUP BY doc_id, size, source_size, target
"""

ORACLE["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (
  SELECT lang, s, count(*) AS f FROM (
    SELECT lang, w[i : i + m - 1] AS s FROM (
      SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(m)))
  GROUP BY lang, s HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.s, c.f AS a, x.f AS l, y.f AS r, k,
         CAST((CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(s))) AS k FROM c WHERE len(s) > 1) c
  JOIN c x ON x.lang = c.lang AND x.s = c.s[1:k] JOIN c y ON y.lang = c.lang AND y.s = c.s[k + 1 : len(c.s)]),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, s ORDER BY score, k) AS first FROM cuts) WHERE first = 1),
around AS (
  SELECT lang, s, max(f) AS most FROM (
    SELECT lang, s[1:2] AS s, f FROM c WHERE len(s) = 3 UNION ALL SELECT lang, s[2:3], f FROM c WHERE len(s) = 3)
  GROUP BY lang, s),
kept AS (
  SELECT best.lang, array_to_string(best.s, ' ') AS phrase, a, l, r, score
  FROM best LEFT JOIN around ON around.lang = best.lang AND around.s = best.s WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT kept.*, n, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM kept JOIN tot ON tot.lang = kept.lang) WHERE rank <= 2000
"""

ORACLE["op11_byte_repeats"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
marked AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM late)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM marked GROUP BY doc_id, island),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM spans),
cut AS (
  SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop,
         string_agg(substr(h, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) AS kept
  FROM gaps JOIN d ON d.doc_id = gaps.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE concat(kept, substr(h, 2 * stop + 1)) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""
