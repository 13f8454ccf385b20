"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from planwright.llm import quality

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i : least(i + 9, len(w))] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) n FROM win),
places AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM places JOIN win USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2_BODY = rf"""
w AS (SELECT *, regexp_extract_all(coalesce(text, ''), '{_SPACED}') ws, string_split(coalesce(text, ''), chr(10)) ls FROM d0),
win AS (SELECT rid, i, array_to_string(ws[i : i + 4], ' ') s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest(range(i, i + 5)) p FROM rep) GROUP BY 1),
ln AS (SELECT rid, source, unnest(ls) l, unnest(range(len(ls))) pos FROM w),
k AS (SELECT *, {_LOWER.format(f"trim(l, {_SPACE})")} AS key, len(regexp_extract_all(l, '{_SPACED}')) nw FROM ln),
dup AS (SELECT rid, count(*) - count(DISTINCT l) n FROM k WHERE nw > 0 GROUP BY 1),
same AS (SELECT rid, md5(string_agg(key, chr(10) ORDER BY pos)) doc FROM k WHERE key <> '' GROUP BY 1),
host AS (SELECT source, count(DISTINCT coalesce(doc, '')) n_docs FROM w LEFT JOIN same USING (rid) GROUP BY 1),
freq AS (SELECT k.source, key, count(DISTINCT doc) n FROM k JOIN same USING (rid) WHERE key <> '' GROUP BY 1, 2),
bad AS (SELECT freq.source, key FROM freq JOIN host ON freq.source IS NOT DISTINCT FROM host.source
  WHERE n > {quality.LINE_DOCS} AND n > {quality.LINE_SHARE} * n_docs),
gone AS (SELECT rid, count(*) n, sum(nw) nw FROM k JOIN bad ON k.key = bad.key AND k.source IS NOT DISTINCT FROM bad.source GROUP BY 1),
f AS (
  SELECT w.*, CAST(len(ws) AS BIGINT) n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^{quality.SYMBOLS}]+', '', 'g')) AS BIGINT) n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) n_repeat_words,
    CAST(coalesce(gone.n, 0) AS BIGINT) n_removed_lines, CAST(len(ws) - coalesce(gone.nw, 0) AS BIGINT) n_left_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
q AS (SELECT *, NOT base_failed AND NOT (n_removed_lines > 0 AND (n_left_words < {quality.LEFT_WORDS} OR n_left_words < {quality.LEFT_SHARE} * n_words)) AS kept FROM v)
"""

OP2 = f"""
WITH d0 AS (SELECT row_number() OVER () rid, * FROM documents),
{OP2_BODY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_left_words, kept FROM q
"""

OP4 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM l),
s AS (SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS dropped FROM k)
SELECT doc_id, CAST(count(*) AS BIGINT) n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) kept_sha256
FROM s GROUP BY doc_id
"""

def near_duplicate_ctes(size: int, percent: int, docs: str) -> str:
    """CTEs up to comp(doc_id, n, component_id) over a relation with doc_id and text; `WITH RECURSIVE` stands before."""
    return rf"""
nw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') w FROM {docs}),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {size - 1}], ' ') s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) i FROM nw WHERE len(w) > 0)),
ns AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM both_ JOIN ns p ON p.doc_id = x JOIN ns q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM nw UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x),
comp AS (SELECT nw.doc_id, coalesce(n, 0) n, (SELECT min(y) FROM reach WHERE reach.x = nw.doc_id) component_id FROM nw LEFT JOIN ns USING (doc_id))
"""


OP9 = f"""
WITH RECURSIVE {near_duplicate_ctes(4, 85, 'documents')}
SELECT doc_id, CAST(n AS BIGINT) n_shingles, component_id FROM comp
"""

_BROKEN = r"regexp_replace(replace({}, '\', '\\'), '(\[/?INST\]|\[/?TURN\]|</?s>)', 'X\1', 'g')"

# What the marks add: 15 characters around a user's text, 4 after an assistant's, 22 around another role and text, 3 at the start.
OP11 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, length({_BROKEN.format('text')}) n_text, length({_BROKEN.format('role')}) n_role FROM c)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
  CAST(3 + sum(n_text + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE n_role + 22 END) AS BIGINT) formatted_chars
FROM s GROUP BY conv_id
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds one after the other: all distances, all sums."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT rid, part, min(CAST(d AS HUGEINT) * {entries} + entry) best FROM (
    SELECT p.rid, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d FROM p JOIN b{k} b USING (part))
  GROUP BY 1, 2)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (
  SELECT part, CAST(best % {entries} AS INTEGER) entry, pos, CAST(sum(x) AS HUGEINT) s, count(*) n
  FROM (SELECT a.part, best, unnest(p.v) x, unnest(range(len(p.v))) pos FROM a{k} a JOIN p USING (rid, part)) GROUP BY 1, 2, 3),
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) v FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) v FROM s{k} GROUP BY 1, 2) m USING (part, entry))""")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] v FROM k, range({parts}) r(part)),
b0 AS (SELECT part, rid - 1 AS entry, v FROM p WHERE rid <= {entries}),
{','.join(steps)},
e AS (
  SELECT rid, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY part) code, CAST(sum(best // {entries}) AS BIGINT) error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) codebooks_sha256
FROM e JOIN k USING (rid)
"""


# crc32 bit by bit: -1 in the list of steps stands for a shift, other numbers are bytes.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)) END))"""

OP13 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] h
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h) d FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - ((conv_id % 20) + 20) % 20 base, {_CRC} % 4 m FROM t),
r AS (
  SELECT c.conv_id, h, text, n.d, 0 AS own FROM c JOIN n ON n.conv_id = base AND n.d <= m
  UNION ALL SELECT c.conv_id, h, text, n.d, 1 FROM c JOIN n ON n.conv_id = c.conv_id AND n.d > m),
q AS (
  SELECT conv_id, len(regexp_extract_all(text, '{_SPACED}')) w, row_number() OVER o d,
    string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY own, d ROWS UNBOUNDED PRECEDING) path FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY own, d)),
m AS (SELECT conv_id, d, w, path FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT path, d, min(conv_id) conv_id, count(*) n, max(w) w FROM m GROUP BY 1, 2),
stop AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) ends FROM (SELECT conv_id, arg_max(path, d) path FROM m GROUP BY 1) GROUP BY 1),
kids AS (SELECT path[: -33] path, count(*) n FROM node WHERE d > 0 GROUP BY 1),
up AS (SELECT top.path, sum((low.n - 1) * low.w) saved, count(*) FILTER (kids.n IS NULL) leaves
  FROM (SELECT path, n, w, unnest(range(d + 1)) cut FROM node) low JOIN node top ON top.path = low.path[: 32 * low.cut]
  LEFT JOIN kids ON kids.path = low.path GROUP BY 1)
SELECT node.conv_id, node.d AS depth, par.conv_id AS parent_conv_id, node.n AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) n_children, CAST(leaves AS BIGINT) n_leaves,
  CAST(saved AS BIGINT) saved_tokens, coalesce(ends, sha256('')) ends_sha256
FROM node LEFT JOIN kids USING (path) LEFT JOIN stop USING (path) JOIN up USING (path) LEFT JOIN node par ON node.d > 0 AND par.path = node.path[: -33]
"""

ORACLE_SQL = {
    "op9_ngram_jaccard": OP9, "op1_decontamination": OP1, "op2_quality_rules": OP2, "op4_line_dedup": OP4,
    "op11_chat_format": OP11, "op12_vector_codes": vector_codes(), "op13_prefix_trie": OP13,
}
