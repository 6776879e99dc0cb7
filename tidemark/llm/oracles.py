"""SQL counterparts (DuckDB) of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

# lines: words with a digit are fields; a template is the exact token list, one with an open run behind two leading tokens,
# or one that is open where its token stands in fewer than five documents with its leaf (token count and leading tokens), as far as their lines
# share one of run + 1 blocks of tokens with five documents; equal texts count once
ORACLE["op2_line_templates"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
t AS (
  SELECT doc_id, text, pos, line,
    list_filter(string_split_regex(regexp_replace(line, '[^\s0-9]*[0-9]\S*', '<*>', 'g'), '\s+'), lambda x: x <> '') AS w FROM l),
s AS (
  SELECT *, len(w) AS n, CAST(floor(len(w) * 0.2) AS INT) AS run, array_to_string(w, ' ') AS exact FROM t),
f AS (SELECT s.*, md5(text) AS source, CAST(n AS VARCHAR) || '|' || array_to_string(w[1:2], ' ') AS path FROM s WHERE n > 0),
live AS (
  SELECT * FROM f WHERE path IN (SELECT path FROM f GROUP BY path HAVING count(DISTINCT source) >= 5)),
x AS (
  SELECT doc_id, pos, source, unnest(list_concat(['e|' || exact],
    CASE WHEN run > 0 AND n > 2 THEN list_transform(range(CAST(ceil((n - 2) / run) AS INT)),
      lambda k: n || '|' || k || '|' || array_to_string(w[1:k * run + 2], ' ') || chr(3) || array_to_string(w[(k + 1) * run + 3:n], ' ')) ELSE [] END)) AS template
  FROM live),
bl AS (
  SELECT doc_id, pos, source, unnest(list_transform(range(run + 1), lambda k: path || '|' || k || '|' ||
    array_to_string(w[3 + k * (n - 2) // (run + 1):2 + (k + 1) * (n - 2) // (run + 1)], ' '))) AS block FROM live WHERE run > 0 AND n > 2),
grown AS (
  SELECT DISTINCT doc_id, pos FROM bl WHERE block IN (SELECT block FROM bl GROUP BY block HAVING count(DISTINCT source) >= 5)),
tk AS (
  SELECT doc_id, pos, source, path, run, unnest(w) AS tok, generate_subscripts(w, 1) AS place FROM live JOIN grown USING (doc_id, pos)),
const AS (SELECT path, place, tok, true AS known FROM tk GROUP BY path, place, tok HAVING count(DISTINCT source) >= 5),
learned AS (
  SELECT doc_id, pos, source, 'l|' || path || '|' || string_agg(CASE WHEN place > 2 AND known IS NULL THEN chr(4) ELSE tok END, ' ' ORDER BY place) AS template
  FROM tk LEFT JOIN const USING (path, place, tok) GROUP BY doc_id, pos, source, path, run
  HAVING count(*) FILTER (place > 2 AND known IS NULL) BETWEEN 1 AND run),
y AS (SELECT * FROM x UNION ALL SELECT doc_id, pos, source, template FROM learned),
r AS (SELECT template FROM y GROUP BY template HAVING count(DISTINCT source) >= 5),
gone AS (SELECT DISTINCT doc_id, pos FROM y WHERE template IN (SELECT template FROM r))
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
"""

# overlaps: no seeds, every alignment with enough equal tokens is looked at, then runs of 13 aligned tokens with 80 % agreement
ORACLE["op3_spaced_seed_decontamination"] = r"""
WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\s!-/:-@\[-`{-~]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\s!-/:-@\[-`{-~]+'), lambda x: x <> '') AS w FROM benchmark),
dt AS (SELECT id, unnest(w) AS k, generate_subscripts(w, 1) AS i FROM d),
bt AS (SELECT id, least(13, len(w)) AS need, unnest(w) AS k, generate_subscripts(w, 1) AS i FROM b),
h AS (
  SELECT dt.id AS doc_id, bt.id AS item_id, dt.i - bt.i AS shift FROM dt JOIN bt USING (k)
  GROUP BY dt.id, bt.id, dt.i - bt.i, need HAVING count(*) >= need * 0.8),
a AS (
  SELECT h.*, d.w AS dw, b.w AS bw, greatest(shift, 0) AS f, least(len(d.w), shift + len(b.w)) - greatest(shift, 0) AS overlap, least(13, len(b.w)) AS need
  FROM h JOIN d ON d.id = h.doc_id JOIN b ON b.id = h.item_id),
s AS (SELECT *, list_transform(range(1, overlap + 1), lambda j: CAST(dw[f + j] = bw[f - shift + j] AS INT)) AS same FROM a WHERE overlap >= need)
SELECT doc_id, item_id, shift, overlap, list_sum(same)::BIGINT AS equal FROM s
WHERE len(list_filter(range(1, overlap - need + 2), lambda i: list_sum(same[i:i + need - 1]) >= need * 0.8)) > 0
"""

# repetition: n-grams of five to ten words that stood earlier in the text, and lines equal to an earlier one
ORACLE["op11_repetition_coverage"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
s AS (SELECT r, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT r, count(*) AS n_lines, sum(length(line)) AS line_chars, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
lr AS (SELECT r, line, count(*) - 1 AS more FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
lc AS (SELECT r, sum(more * length(line)) AS dup_line_chars FROM lr GROUP BY r),
wd AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
ld AS (SELECT r, i, x, lead(x, 1) OVER p AS x1, lead(x, 2) OVER p AS x2, lead(x, 3) OVER p AS x3, lead(x, 4) OVER p AS x4, lead(x, 5) OVER p AS x5, lead(x, 6) OVER p AS x6, lead(x, 7) OVER p AS x7, lead(x, 8) OVER p AS x8, lead(x, 9) OVER p AS x9 FROM wd WINDOW p AS (PARTITION BY r ORDER BY i)),
h AS (
  SELECT r, 5 AS n, i, hash(x, x1, x2, x3, x4) AS gram FROM ld WHERE x4 IS NOT NULL UNION ALL
  SELECT r, 6 AS n, i, hash(x, x1, x2, x3, x4, x5) AS gram FROM ld WHERE x5 IS NOT NULL UNION ALL
  SELECT r, 7 AS n, i, hash(x, x1, x2, x3, x4, x5, x6) AS gram FROM ld WHERE x6 IS NOT NULL UNION ALL
  SELECT r, 8 AS n, i, hash(x, x1, x2, x3, x4, x5, x6, x7) AS gram FROM ld WHERE x7 IS NOT NULL UNION ALL
  SELECT r, 9 AS n, i, hash(x, x1, x2, x3, x4, x5, x6, x7, x8) AS gram FROM ld WHERE x8 IS NOT NULL UNION ALL
  SELECT r, 10 AS n, i, hash(x, x1, x2, x3, x4, x5, x6, x7, x8, x9) AS gram FROM ld WHERE x9 IS NOT NULL),
k AS (SELECT r, n, unnest(spots) AS i, head FROM (SELECT r, n, list(i) AS spots, min(i) AS head FROM h GROUP BY r, n, gram HAVING count(*) > 1)),
cov AS (SELECT r, n, unnest(range(i, i + n)) AS p, i > head AS later FROM k),
cp AS (SELECT r, n, p, bool_or(later) AS later FROM cov GROUP BY r, n, p),
ch AS (SELECT cp.r, n, length(x) AS len, later FROM cp JOIN wd ON wd.r = cp.r AND wd.i = p),
x AS (SELECT r, count(*) FILTER (n = 8) AS n_repeat_words,
  coalesce(sum(len) FILTER (later AND n = 5), 0)::BIGINT AS c5, coalesce(sum(len) FILTER (later AND n = 6), 0)::BIGINT AS c6,
  coalesce(sum(len) FILTER (later AND n = 7), 0)::BIGINT AS c7, coalesce(sum(len) FILTER (later AND n = 8), 0)::BIGINT AS c8,
  coalesce(sum(len) FILTER (later AND n = 9), 0)::BIGINT AS c9, coalesce(sum(len) FILTER (later AND n = 10), 0)::BIGINT AS c10 FROM ch GROUP BY r),
a AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(line_chars, 0)::BIGINT AS line_chars,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(c5, 0) AS repeat_chars_5, coalesce(c6, 0) AS repeat_chars_6, coalesce(c7, 0) AS repeat_chars_7, coalesce(c8, 0) AS repeat_chars_8,
    coalesce(c9, 0) AS repeat_chars_9, coalesce(c10, 0) AS repeat_chars_10
  FROM d JOIN s USING (r) LEFT JOIN l USING (r) LEFT JOIN lc USING (r) LEFT JOIN x USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR (n_dup_lines >= 3 AND (100 * n_dup_lines > 30 * n_lines OR 100 * dup_line_chars > 20 * line_chars))
    OR 100 * repeat_chars_5 > 15 * word_chars OR 100 * repeat_chars_6 > 14 * word_chars OR 100 * repeat_chars_7 > 13 * word_chars
    OR 100 * repeat_chars_8 > 12 * word_chars OR 100 * repeat_chars_9 > 11 * word_chars OR 100 * repeat_chars_10 > 10 * word_chars) AS kept
FROM a
"""

# audit: counts per part and mask of failed filters, then every order and step by bits of the mask
ORACLE["op12_filter_interactions"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
q AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(first < doc_id, false) AS INT) AS mask
  FROM w LEFT JOIN q USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(range(5)) AS i),
p AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
st AS (
  SELECT array_to_string(list_transform(o, lambda i: chr(CAST(65 + i AS INT))), '') AS filter_order, k AS step, CAST(1 << o[k] AS INT) AS own,
    coalesce(list_sum(list_transform(o[1:k - 1], lambda i: 1 << i)), 0)::INT AS before FROM p, (SELECT unnest(range(1, 6)) AS k)),
r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, own,
    coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM c, st GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""

# repair: crc32 bit by bit, then the cheapest and ASCII-least edits from the last row back, one struct (cost, edits) per state
ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
z AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda ch: CAST(ord(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, i: xor(d >> 1, (d & 1) * 3988292384))), 4294967295::BIGINT) % 20 AS r FROM k),
e AS (SELECT conv_id, turn, CASE r WHEN 4 THEN 'user' ELSE role END AS role, CASE r WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE r WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM z WHERE r <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, substr(role, 1, 1) AS c,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM e),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM n),
f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lead(c) OVER (PARTITION BY conv_id ORDER BY i) AS c2 FROM m),
t AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (c2 IS NOT NULL AND c || c2 NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
b(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, {'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''} FROM t
  UNION ALL
  SELECT conv_id, i, list_min([w0, {'c': 3 + u.c, 'a': 'I' || u.a}]), list_min([w1, {'c': 3 + u.c, 'a': 'I' || u.a}]), u, a FROM (
    SELECT *, list_min([w2, {'c': 3 + w3.c, 'a': 'I' || w3.a}]) AS u, list_min([w3, {'c': 3 + w2.c, 'a': 'I' || w2.a}]) AS a FROM (
      SELECT conv_id, i,
        list_min(CASE WHEN gone THEN [d0] ELSE [d0, {'c': 3 + x + v2.c, 'a': 'R' || v2.a}, CASE c WHEN 's' THEN {'c': x + v1.c, 'a': 'K' || v1.a} WHEN 'u' THEN {'c': x + v2.c, 'a': 'K' || v2.a} END] END) AS w0,
        list_min(CASE WHEN gone THEN [d1] ELSE [d1, {'c': 3 + x + v2.c, 'a': 'R' || v2.a}, CASE c WHEN 'u' THEN {'c': x + v2.c, 'a': 'K' || v2.a} END] END) AS w1,
        list_min(CASE WHEN gone THEN [d2] ELSE [d2, {'c': 3 + x + v3.c, 'a': 'R' || v3.a}, CASE c WHEN 'a' THEN {'c': x + v3.c, 'a': 'K' || v3.a} END] END) AS w2,
        list_min(CASE WHEN gone THEN [d3] ELSE [d3, {'c': 3 + x + v2.c, 'a': 'R' || v2.a}, CASE c WHEN 'u' THEN {'c': x + v2.c, 'a': 'K' || v2.a} END] END) AS w3
      FROM (
        SELECT f.conv_id, f.i, f.c, f.fault IN ('blank', 'duplicate') AS gone, CASE f.fault WHEN 'truncated' THEN 3 ELSE 0 END AS x, v1, v2, v3,
          {'c': 4 + v0.c, 'a': 'D' || v0.a} AS d0, {'c': 4 + v1.c, 'a': 'D' || v1.a} AS d1, {'c': 4 + v2.c, 'a': 'D' || v2.a} AS d2, {'c': 4 + v3.c, 'a': 'D' || v3.a} AS d3
        FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)))),
s AS (SELECT conv_id, CAST(v0.c AS BIGINT) AS cost, v0.a AS audit FROM b WHERE i = 1),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS p FROM s WHERE audit <> ''),
o AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS k FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
g AS (SELECT o.conv_id, p, edit, k, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text, CASE edit WHEN 'K' THEN f.role END AS role,
  max(CASE WHEN edit = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id) AS has FROM o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i),
h AS (SELECT conv_id, sha256(string_agg(coalesce(role, CASE (k - has) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p)) AS sha FROM g WHERE edit <> 'D' GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id
  LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM q.conv_id
"""
