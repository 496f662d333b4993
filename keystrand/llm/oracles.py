"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re

from . import quality, secrets

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_SYM = "[^" + quality.SYMBOLS.replace("$", r"\$") + "]"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PHRASES = " OR ".join(f"contains(low, '{p.decode()}')" for p in quality.BOILERPLATE)
_TERMINAL = (quality.TERMINAL + quality.TERMINAL_WIDE).replace("'", "''")

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {_WORDS.format("text")} AS ws FROM d)),
g AS (SELECT doc_id, i, word, lead(word) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w1, w2) AS n FROM g WHERE w2 IS NOT NULL) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest([0, 1, 2]) AS k)),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
m AS (SELECT doc_id, j, line, translate(line, '{_CAPITALS}', '{_SMALL}') AS low, len({_WORDS.format("line")}) AS n, {_WORDS.format("line")}[-1] AS final,
      length(regexp_replace(line, '{_SYM}', '', 'g')) AS sym, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(line, '[^a-z]', '', 'g')) AS small FROM l),
p AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM m),
k AS (SELECT p.doc_id, p.j, count(c.i) AS covered FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i <= p.upto AND c.i > p.upto - p.n GROUP BY ALL),
b AS (SELECT p.*, n > 0 AND (sym * 10 > n OR (up + small >= 10 AND 2 * up > up + small)
      OR (n <= {quality.SHORT_LINE} AND NOT contains('{_TERMINAL}', right(final, 1)))
      OR (n >= 10 AND 2 * covered > n) OR {_PHRASES}) AS bad FROM p JOIN k USING (doc_id, j)),
s AS (SELECT doc_id, sum(n) AS n_words, sum(sym) AS n_symbols, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (bad) AS n_lines_removed, coalesce(sum(n) FILTER (bad), 0) AS n_words_removed,
      count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines FROM b GROUP BY doc_id),
t AS (SELECT s.*, coalesce((SELECT sum(length(word)) FROM w WHERE w.doc_id = s.doc_id), 0) AS word_chars, (SELECT count(*) FROM c WHERE c.doc_id = s.doc_id) AS n_repeat_words FROM s),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM t)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words_removed <= {quality.MAX_LOST} * n_words AS kept, n_lines, n_lines_removed, CAST(n_words_removed AS BIGINT) AS n_words_removed FROM f
"""

_LOWERED = f"translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWERED)} AS ws FROM documents),
b AS (SELECT item_id, {_ALNUM.format(_LOWERED)} AS ws FROM benchmark),
q AS (SELECT item_id, least(10, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i, ws FROM b WHERE len(ws) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS win FROM q),
z AS (SELECT DISTINCT n FROM v),
x AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM d),
y AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win FROM x, z WHERE i + n - 1 <= len(ws)),
h AS (SELECT doc_id, i, y.n, item_id FROM y JOIN v ON y.win = v.win AND y.n = v.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(items, '') AS items
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWERED)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 90 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""


def _either_case(pattern: str) -> str:
    """A pattern whose letters outside of classes and escapes match either case of ASCII."""
    parts = re.split(r"(\[[^\]]*\]|\\x[0-9A-Fa-f]{2}|\\.)", pattern)
    return "".join(x if k % 2 else re.sub("[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]", x) for k, x in enumerate(parts))


def _matches(k: int, kind: str, pattern: str, flags: int, group: int, least: int) -> str:
    pattern = (_either_case(pattern) if flags & re.I else pattern).replace(r"\s", r"\s\x0B\x1C-\x1F\x{85}\x{A0}").replace("'", "''")
    return f"SELECT doc_id, {k} AS ord, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, string_split_regex(t, '{pattern}') AS ps FROM d"


#: A match begins after all pieces between matches, and matches, before it.
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(k, *rule) for k, rule in enumerate(secrets.RULES))}),
u AS (SELECT doc_id, ord, kind, least, unnest(ms) AS hit, unnest(gs) AS part, unnest(ps[1:len(ms)]) AS before, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0),
s AS (SELECT *, sum(length(before) + length(hit)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM u),
k AS (SELECT doc_id, ord, kind, stop - length(hit) AS start, kind || ':' || CAST(stop - length(hit) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM s WHERE length(part) >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, ord) FILTER (ord < {len(secrets.BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, ord), '') AS spans
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""
