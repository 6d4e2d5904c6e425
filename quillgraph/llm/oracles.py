"""DuckDB SQL for the registered queries that SQL can express."""

_SPACE = r"[\x20\x09-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_dedup(source: str = "documents") -> str:
    return rf"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {source})),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', ''), '{_UPPER}', '{_LOWER}') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.last, false) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


TOPK = """
WITH v AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20"""

URLS = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, h, pre, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
j AS (
  SELECT p.*, (SELECT max(struct_pack(n := length(r.rule), rule := r.rule, verdict := r.verdict)) FROM r
    WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre)) AS m FROM p)
SELECT page_id, host, path, m.rule AS rule,
  coalesce(m.verdict, CASE WHEN regexp_matches(host || path,
    '(?i)(^|[^a-z0-9])(adult|casino|porn|sex|xxx|gambling|malware|phishing|warez|ads|tracker)([^a-z0-9]|$)')
    OR regexp_matches(host || path, '^[0-9]+(?:\.[0-9]+){{3}}(?:[:/]|$)|(?:^|\.)xn--[a-z0-9-]+\.|/wp-login\.php$')
    OR regexp_matches(host || path, '/cgi-bin/[^/]*\.(?:exe|pl)$|\.(?:apk|exe|msi|scr)$|/banners?/[0-9]+x[0-9]+/|[.-]doubleclick\.')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM j"""

_WORD = r"[^\p{L}\p{M}\p{N}]+"
DECONTAMINATION = rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_WORD}'), lambda x: x <> '') AS w FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '{_WORD}'), lambda x: x <> '') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL),
si AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k,
    unnest([array_to_string(w[p:p + least(len(w), 5) - 1], ' ') FOR p IN range(1, len(w) - least(len(w), 5) + 2)]) AS s
  FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM si),
sd AS (
  SELECT DISTINCT doc_id, k, unnest([array_to_string(w[p:p + k - 1], ' ') FOR p IN range(1, greatest(len(w) - k + 2, 1))]) AS s
  FROM w, ks),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM sd JOIN si USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(n_item) * 0.8 - 1e-9)"""

SUBSTRINGS = rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM w WHERE len(w) >= 20)),
late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(struct_pack(d := doc_id, q := p)) OVER (PARTITION BY k) AS f FROM win)
  WHERE doc_id > f.d OR p > f.q),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM late, range(20) t(o)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (g.p IS NULL) AS t
  FROM words LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""

#: The reflected CRC-32 polynomial (a fixed value) as a list of 256 numbers, in a table of one row.
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc_list
  FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256)))"""


def crc32(text: str) -> str:
    """SQL for the crc32 of an ASCII text, beside crc_table."""
    codes = f"[CAST(ord(x) AS BIGINT) FOR x IN string_split({text}, '') IF x <> '']"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: xor(c >> 8, crc_list[CAST((xor(c, b) & 255) AS INTEGER) + 1])), 4294967295)"


#: Runs from places whose five words are equal: stretches of such pairs at one distance.
RUNS = rf"""
WITH {_CRC_TABLE},
d AS (
  SELECT row_number() OVER () AS r, doc_id, {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w
  FROM documents, crc_table),
e AS (
  SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS edited,
    CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM d),
words AS (
  SELECT r, n, i, w[1 + CASE WHEN edited AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM e)),
x AS (SELECT r, n, list(word ORDER BY i) AS w FROM words GROUP BY r, n),
five AS (SELECT r, n, i, array_to_string(w[i + 1:i + 5], ' ') AS k FROM (SELECT *, unnest(range(n - 4)) AS i FROM x WHERE n > 5)),
pairs AS (SELECT a.r, b.i - a.i AS q, a.i FROM five a JOIN five b ON a.r = b.r AND a.k = b.k AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (
  SELECT r, q, min(i) AS s, count(*) + 4 + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pairs) GROUP BY r, q, g),
runs AS (SELECT r, s, l, min(q) AS q FROM islands WHERE l >= greatest(6, 4 * q) GROUP BY r, s, l),
told AS (
  SELECT r, count(*) AS n_runs, min(struct_pack(l := -l, s := s, q := q)) AS best,
    string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) FILTER (g.i IS NULL) AS t FROM words LEFT JOIN gone g USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.q AS period, -best.l * 1000 // best.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM e LEFT JOIN told USING (r) LEFT JOIN kept USING (r)"""

def conversation_repair(source: str = "conversations") -> str:
    """Turn by turn: the least (cost, audit) of each state, with the repaired text beside it. Two
    insertions may stand before a turn and at the end."""
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM {source}, crc_table),
d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
j AS (
  SELECT *, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
  FROM o),
grammar(src, i, dst) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(src, mid, cost, letters, lines) AS (
  SELECT s, s, 0, '', CAST([] AS VARCHAR[]) FROM range(4) t(s) UNION ALL
  VALUES (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
    (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:'])),
edits AS (
  SELECT j.conv_id, j.n, x.src, x.mid AS dst, x.cost + 2 AS cost, x.letters || 'D' AS letters, x.lines FROM j, inserts x
  UNION ALL
  SELECT j.conv_id, j.n, x.src, g.dst, x.cost + CASE fault WHEN 3 THEN 5 ELSE 0 END, x.letters || 'K', list_append(x.lines, j.role || ':' || j.text)
  FROM j, inserts x, grammar g WHERE fault NOT IN (1, 2) AND g.src = x.mid AND g.i = j.i
  UNION ALL
  SELECT j.conv_id, j.n, x.src, g.dst, x.cost + 1 + CASE fault WHEN 3 THEN 5 ELSE 0 END, x.letters || 'R', list_append(x.lines, CASE g.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text)
  FROM j, inserts x, grammar g WHERE fault NOT IN (1, 2) AND g.src = x.mid AND g.i IN ('u', 'a')),
reached(conv_id, n, state, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), struct_pack(cost := CAST(0 AS BIGINT), audit := '', lines := CAST([] AS VARCHAR[])) FROM {source}
  UNION ALL
  SELECT r.conv_id, r.n + 1, CAST(e.dst AS BIGINT), min(struct_pack(cost := r.best.cost + e.cost, audit := r.best.audit || e.letters, lines := list_concat(r.best.lines, e.lines)))
  FROM reached r JOIN edits e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.n = r.n + 1 AND e.src = r.state GROUP BY r.conv_id, r.n, e.dst),
stat AS (
  SELECT conv_id, count(*) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM j GROUP BY conv_id),
ends AS (
  SELECT r.conv_id, min(struct_pack(cost := best.cost + x.cost, audit := best.audit || x.letters, lines := list_concat(best.lines, x.lines))) AS best
  FROM reached r LEFT JOIN stat s ON s.conv_id IS NOT DISTINCT FROM r.conv_id JOIN inserts x ON x.src = r.state
  WHERE r.n = coalesce(s.m, 0) AND x.mid IN (0, 3) GROUP BY r.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN stat s ON s.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLES = {
    "op1_line_dedup": line_dedup(),
    "op4_benchmark_decontamination": DECONTAMINATION,
    "op5_substring_dedup": SUBSTRINGS,
    "op7_url_filter": URLS,
    "op8_exact_topk": TOPK,
    "op11_conversation_repair": conversation_repair(),
    "op13_periodic_runs": RUNS,
}
