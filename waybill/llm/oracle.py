"""DuckDB SQL for the corpus queries that SQL can express."""

from waybill.llm import licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every template, clause and phrase of the license scan with its distinct tokens and the tokens it needs.
_TEMPLATES = ", ".join(
    f"({i}, '{label}', {percent}, ['{"', '".join(sorted({w.decode() for w in words}))}'])"
    for i, (words, label, percent) in enumerate(
        (*t, licenses.PERCENT) for t in licenses.clauses(licenses.TEMPLATES, licenses.STEP)))
_PHRASES = ", ".join(f"('{label}', string_split('{text}', ' '))" for text, label in licenses.PHRASES)

ORACLE: dict[str, str] = {
    "op2_decontamination": f"""
WITH b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark WHERE text IS NOT NULL),
pat AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + 9], ' ') AS g
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM pat),
d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
hit AS (
  SELECT g.doc_id, g.i, g.size, pat.item_id
  FROM (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS g
        FROM d, sizes, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS t(i)) g JOIN pat USING (size, g)),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_ngram_join": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS g
  FROM d, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * same >= 85 * (na.n + nb.n - same)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id""",
    "op5_substring_dedup": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k
  FROM (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS g FROM d, unnest(range(1, greatest(len(ws) - 18, 1))) AS t(i))),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM win WHERE k > 1),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_quality_rules": rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM d, unnest(range(1, greatest(len(ws) - 1, 1))) AS t(i))),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, text, ws, len(ws)::BIGINT AS n_words, list_sum(list_transform(ws, lambda w: length(w))) AS wc, lines,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, coalesce(wc, 0)::BIGINT AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.1 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR len(list_filter(ws, lambda w: NOT regexp_matches(w, '\p{{L}}'))) > 0.2 * n_words
    OR length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > 0.5 * word_chars
    OR length(text) - length(translate(text, '!?', '')) > 0.33 * n_words
    OR n_dup_lines > 0.33 * n_lines OR n_repeat_words > 0.33 * n_words
    OR len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 0.75 * n_lines) AS kept
FROM v""",
    "op11_license_scan": f"""
WITH t(id, label, percent, tokens) AS (VALUES {_TEMPLATES}),
p(label, ws) AS (VALUES {_PHRASES}),
d AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
places AS (
  SELECT w.doc_id, w.i, p.label FROM w JOIN p ON w.w = p.ws[1] JOIN d USING (doc_id) WHERE d.ws[w.i + 1:w.i + len(p.ws)] = p.ws),
base AS (
  SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, unnest(CASE WHEN i >= {licenses.STEP} THEN [i // {licenses.STEP} - 1, i // {licenses.STEP}] ELSE [0] END) AS block, w FROM w),
met AS (
  SELECT b.doc_id, t.label, count(DISTINCT b.w) / len(any_value(t.tokens)) AS share
  FROM blocks b JOIN (SELECT *, unnest(tokens) AS token FROM t) t ON b.w = t.token
  GROUP BY b.doc_id, b.block, t.id, t.label HAVING 100 * count(DISTINCT b.w) >= any_value(t.percent) * len(any_value(t.tokens))),
own AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS labels FROM met GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(own.share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)""",
}
