"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

import string

ORACLE: dict[str, str] = {}

ORACLE["op3_jaccard_join"] = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
texts AS (SELECT t, min(r) AS k, count(*) AS copies FROM docs GROUP BY t),
words AS (SELECT k, list_filter(string_split_regex(lower(t), '\s+'), lambda x: x <> '') AS ws FROM texts),
places AS (SELECT k, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT k, list_slice(ws, i, i + 4) AS g FROM places),
sizes AS (SELECT k, count(*) AS n FROM shingles GROUP BY k),
common AS (
  SELECT a.k AS x, b.k AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes s ON s.k = x JOIN sizes u ON u.k = y WHERE 5 * c >= 4 * (s.n + u.n - c)),
reached(x, y) AS (SELECT k, k FROM texts UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x),
roots AS (SELECT x AS k, min(y) AS root FROM reached GROUP BY x),
linked AS (
  SELECT x AS k, count(*) AS texts, sum(copies) AS docs FROM links JOIN texts ON texts.k = y GROUP BY x),
classes AS (
  SELECT root, min(doc_id) AS class_id FROM docs JOIN texts USING (t) JOIN roots USING (k) GROUP BY root)
SELECT doc_id, class_id, CAST(copies - 1 + coalesce(linked.docs, 0) AS BIGINT) AS n_links,
       CAST(coalesce(linked.texts, 0) AS BIGINT) AS n_text_links
FROM docs JOIN texts USING (t) JOIN roots USING (k) JOIN classes USING (root) LEFT JOIN linked USING (k)"""

_LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE["op5_decontamination"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS ws FROM benchmark),
starts AS (
  SELECT item, ws, least(len(ws), 13) AS size, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i
  FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, size, list_slice(ws, i, i + size - 1) AS g FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM docs JOIN sizes ON len(ws) >= size),
found AS (
  SELECT r, i, p.size, item FROM (SELECT r, i, size, list_slice(ws, i, i + size - 1) AS g FROM places) p
  JOIN windows w ON w.size = p.size AND w.g = p.g),
hit AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest(range(i, i + size)) AS spot FROM found) GROUP BY r),
owners AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(owners.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN owners USING (r)"""

#: Ratio -> numerator, denominator, and the levels and reach of its fence.
_RATIOS = {
    "word_length": ("word_chars", "n_words", 50, 90, 3),
    "symbol_share": ("n_symbols", "n_words", 50, 90, 3),
    "dup_line_share": ("n_dup_lines", "n_lines", 90, 99, 1),
    "repeat_share": ("n_repeat_words", "n_words", 90, 99, 1),
}


def _bucket(name: str) -> str:
    """The twelve leading bits of a ratio."""
    return f"(({name} >> greatest(length(bin({name})) - 12, 0)) << greatest(length(bin({name})) - 12, 0))"


def _ranked(rows: str, keys: str) -> str:
    """A sketch with the documents up to each bucket, and all of them."""
    return f"""
  SELECT *, CAST(sum(n) OVER (PARTITION BY {keys}ratio ORDER BY bucket) AS BIGINT) AS upto,
         CAST(sum(n) OVER (PARTITION BY {keys}ratio) AS BIGINT) AS total FROM ({rows})"""


def _stands_for(rows: str, keys: str) -> str:
    """A hundred documents at even quantiles of a sketch."""
    return f"""
  SELECT {keys}ratio, bucket, (200 * upto + total) // (2 * total) - (200 * (upto - n) + total) // (2 * total) AS n
  FROM ({_ranked(rows, keys)})"""


def _at(level: int) -> str:
    return f"min(bucket) FILTER (upto * 100 >= total * {level})"


_FENCES = " UNION ALL ".join(
    f"""
  SELECT lang, source, ratio, {_at(high)} + {reach} * ({_at(high)} - {_at(low)}) AS high,
         {f"{_at(100 - high)} + {reach} * ({_at(100 - high)} - {_at(100 - low)})" if name == "word_length" else "NULL"} AS low
  FROM ranked WHERE ratio = '{name}' GROUP BY lang, source, ratio"""
    for name, (_, _, low, high, reach) in _RATIOS.items()
)

ORACLE["op8_quality_rules"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
tokens AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs),
places AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM tokens WHERE len(ws) >= 5),
grams AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM places),
repeats AS (
  SELECT r, count(DISTINCT spot) AS n
  FROM (SELECT r, unnest(range(i, i + 5)) AS spot
        FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS kinds
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counts AS (
  SELECT r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(lines.n, 0) AS n_lines, coalesce(lines.n - kinds, 0) AS n_dup_lines,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs JOIN tokens USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
rated AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         {', '.join(f"CASE WHEN {d} > 0 THEN {n} * 1000 // {d} ELSE 0 END AS {name}" for name, (n, d, *_) in _RATIOS.items())}
  FROM counts),
entries AS ({' UNION ALL '.join(
    f'''SELECT lang, source, '{name}' AS ratio, {_bucket(name)} AS bucket
    FROM rated WHERE NOT base_failed''' for name in _RATIOS)}),
corpus AS ({_stands_for("SELECT ratio, bucket, count(*) AS n FROM entries GROUP BY ratio, bucket", "")}),
by_lang AS (
  SELECT lang, ratio, bucket, sum(n) AS n FROM (
    SELECT lang, ratio, bucket, count(*) AS n FROM entries GROUP BY lang, ratio, bucket
    UNION ALL SELECT lang, ratio, bucket, n FROM (SELECT DISTINCT lang, ratio FROM entries) JOIN corpus USING (ratio))
  GROUP BY lang, ratio, bucket),
of_lang AS ({_stands_for("SELECT * FROM by_lang", "lang, ")}),
by_source AS (
  SELECT lang, source, ratio, bucket, sum(n) AS n FROM (
    SELECT lang, source, ratio, bucket, count(*) AS n FROM entries GROUP BY lang, source, ratio, bucket
    UNION ALL
    SELECT e.lang, source, e.ratio, bucket, n FROM (SELECT DISTINCT lang, source, ratio FROM entries) e
    JOIN of_lang o ON e.lang IS NOT DISTINCT FROM o.lang AND e.ratio = o.ratio)
  GROUP BY lang, source, ratio, bucket),
ranked AS ({_ranked("SELECT * FROM by_source", "lang, source, ")}),
chosen AS ({_FENCES}),
outside AS (
  SELECT DISTINCT r FROM rated JOIN chosen c
  ON rated.lang IS NOT DISTINCT FROM c.lang AND rated.source IS NOT DISTINCT FROM c.source
  WHERE {' OR '.join(f"c.ratio = '{name}' AND {_bucket(name)} > c.high" for name in _RATIOS)}
     OR c.ratio = 'word_length' AND {_bucket('word_length')} < c.low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM outside) AS kept,
       {', '.join(f'CAST({name} AS BIGINT) AS {name}' for name in _RATIOS)}
FROM rated"""

#: CRC-32 of an ASCII string: its bytes folded into a register, eight shifts each.
_CRC32 = """
xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(
    list_prepend(xor(crc, b), range(8)),
    lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""

_LAST = "right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"
#: State (last role initial, - before the first), insertions before a row, their cost, and the
#: state and lines they lead to.
_INSERTED = """(VALUES
  ('-', '', 0, '-', CAST([] AS VARCHAR[])), ('-', 'I', 2, 'u', ['user:']), ('-', 'II', 4, 'a', ['user:', 'assistant:']),
  ('s', '', 0, 's', []), ('s', 'I', 2, 'u', ['user:']), ('s', 'II', 4, 'a', ['user:', 'assistant:']),
  ('u', '', 0, 'u', []), ('u', 'I', 2, 'a', ['assistant:']),
  ('a', '', 0, 'a', []), ('a', 'I', 2, 'u', ['user:'])) AS m(st, more, price, mid, lines)"""

ORACLE["op11_conversation_repair"] = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
hashed AS (SELECT *, {_CRC32} % 20 AS h FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE h <> 0),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS n FROM damaged),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS c,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i,
         CASE WHEN {_LAST} = '' THEN 'blank' WHEN n > 1 THEN 'duplicate'
              WHEN {_LAST} NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM counted),
edits AS (
  SELECT conv_id, i, st, 'D' AS edit, 3 AS price, st AS next, CAST([] AS VARCHAR[]) AS lines FROM placed, (VALUES ('-'), ('s'), ('u'), ('a')) s(st)
  UNION ALL
  SELECT conv_id, i, st, edit, price + CAST(fault = 'truncated' AS INT), next, [coalesce(given, role) || ':' || text]
  FROM placed JOIN (VALUES
    ('-', 'K', 0, 's', NULL, 's'), ('-', 'K', 0, 'u', NULL, 'u'), ('s', 'K', 0, 'u', NULL, 'u'),
    ('u', 'K', 0, 'a', NULL, 'a'), ('a', 'K', 0, 'u', NULL, 'u'),
    ('-', 'R', 2, NULL, 'user', 'u'), ('s', 'R', 2, NULL, 'user', 'u'), ('u', 'R', 2, NULL, 'assistant', 'a'),
    ('a', 'R', 2, NULL, 'user', 'u')) AS e(st, edit, price, needs, given, next)
    ON coalesce(needs, c) = c WHERE fault NOT IN ('blank', 'duplicate')),
ways(conv_id, i, st, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '-', {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}}
  FROM placed GROUP BY conv_id
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.next,
         min({{'cost': best.cost + m.price + e.price, 'audit': best.audit || more || edit,
               'lines': list_concat(best.lines, m.lines, e.lines)}})
  FROM ways w JOIN {_INSERTED} ON w.st = m.st
  JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.st = m.mid
  GROUP BY w.conv_id, w.i, e.next),
ends AS (
  SELECT w.conv_id, min({{'cost': best.cost + m.price, 'audit': best.audit || more, 'lines': list_concat(best.lines, m.lines)}}) AS best
  FROM ways w JOIN (SELECT conv_id, max(i) AS i FROM placed GROUP BY conv_id) p
    ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i
  JOIN {_INSERTED} ON w.st = m.st WHERE mid IN ('-', 'a') GROUP BY w.conv_id),
pairs AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM placed),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id"""

ORACLE["op13_hard_negatives"] = """
WITH taken AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM taken a JOIN taken b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.r, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores n ON n.r = p.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
