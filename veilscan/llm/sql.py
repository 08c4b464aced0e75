"""SQL for the oracle: the operators that SQL can express, written independently of the Spark code."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
s AS (SELECT doc_id, i FROM k JOIN m USING (h) WHERE least < doc_id),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM s, range(0, 50) AS r(j)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
c AS (SELECT x.doc_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL), '') AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, source, text, len(w) AS n_words, w FROM d),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM x WHERE len(w) >= 3),
t2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM t2, range(0, 3) AS s(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM x),
l1 AS (SELECT doc_id, source, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM l),
l2 AS (SELECT doc_id, source, text, line, len(v) AS words, CASE WHEN len(v) <= 12 THEN regexp_replace(array_to_string(v, ' '), '[0-9]+', '0', 'g') ELSE array_to_string(v, ' ') END AS normal FROM l1 WHERE len(v) > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l2 GROUP BY doc_id),
f AS (SELECT source, normal FROM l2 JOIN (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source) USING (source) GROUP BY source, normal HAVING count(DISTINCT text) >= 20 AND count(DISTINCT text) > 0.05 * any_value(texts)),
q AS (SELECT doc_id, sum(words) AS lost FROM l2 JOIN f USING (source, normal) GROUP BY doc_id),
b AS (SELECT x.doc_id, n_words, len(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM x LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_words - lost < 0.3 * n_words AS kept, CAST(lost AS BIGINT) AS n_removed_words FROM b
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i, w FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
c AS (SELECT doc_id AS id, doc_id AS reached FROM d UNION SELECT id, b FROM c JOIN e ON reached = a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id FROM d JOIN c ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, [CAST('0x' || substring(x, 8 * i + 1, 8) AS BIGINT) FOR i IN range(0, 4)] AS h FROM d),
k AS (SELECT doc_id, text, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
m AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
  100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text), regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > least, false)] AS fails FROM d JOIN m USING (text) LEFT JOIN l ON l.doc_id = d.doc_id),
x AS (SELECT chr(CAST(65 + i AS INT)) AS c, i + 1 AS i FROM range(5) AS r(i)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS ids FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT part, filter_order, good, toxic, n, fails, ids, coalesce(list_position([fails[i] FOR i IN ids], true), 6) AS first FROM g, o),
s AS (SELECT part, filter_order, step, ids[step] AS letter, first, fails[ids[step]] AS fails, len([y FOR y IN fails IF y]) AS n_fails, good, toxic, n FROM r, range(1, 6) AS t(step)),
c AS (SELECT part, filter_order, CAST(step AS INT) AS step, letter, CAST(sum(n) FILTER (first > step) AS BIGINT) AS kept, CAST(sum(n) FILTER (first = step) AS BIGINT) AS removed, CAST(sum(n) FILTER (fails AND first < step) AS BIGINT) AS redundant,
  CAST(sum(n) FILTER (fails AND n_fails = 1) AS BIGINT) AS unique_fails, CAST(sum(n) FILTER (first = step AND good) AS BIGINT) AS good_lost, CAST(sum(n) FILTER (first = step AND toxic) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley FROM c
"""

MIX_TARGETS = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS total FROM d GROUP BY source),
w AS (SELECT source, total, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT 0 AS i, 0.0::DOUBLE AS level UNION ALL
  SELECT i + 1, (SELECT (sum(total) - coalesce(sum(3 * total) FILTER (3 * total < level * weight), 0)) / sum(weight) FILTER (total > 0 AND 3 * total >= level * weight) FROM w) FROM l WHERE i < 40)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, round(least(3 * total, weight * (SELECT max(level) FROM l)), 3) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
"""

SECRET_COUNTS = r"""
SELECT doc_id, CAST(len([x FOR x IN regexp_extract_all(coalesce(text, ''), '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) IF length(x) >= 6]) AS BIGINT) AS n_assign,
  CAST(len([x FOR x IN regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') IF length(x) >= 20]) AS BIGINT) AS n_access, CAST(len([x FOR x IN regexp_extract_all(coalesce(text, ''), '[0-9a-f]+') IF length(x) >= 24]) AS BIGINT) AS n_hex FROM documents
"""

ORACLE = {"mix_targets": MIX_TARGETS, "secret_counts": SECRET_COUNTS, "op2_recompression_dedup": OP2, "op3_line_frequency": OP3, "op7_ngram_jaccard": OP7, "op12_infilling_scan": OP12, "op13_filter_replay": OP13}
