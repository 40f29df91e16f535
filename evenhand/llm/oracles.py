"""DuckDB SQL with the meaning of the registered queries, where SQL can express it."""

from __future__ import annotations

from evenhand.llm.common import LOWER, UPPER
from evenhand.llm.licenses import PHRASES, TEMPLATES, as_regex

_BLANK_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + 9), ' ') AS phrase FROM starts),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT rid, n, w, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n),
phrases AS (SELECT rid, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS phrase FROM places),
hits AS (SELECT rid, phrases.n, p, item FROM phrases JOIN win USING (n, phrase)),
covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

_OP6 = r"""
WITH t AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
d AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text)) AS o FROM t),
l AS (SELECT o, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line FROM d),
c AS (SELECT o, ln, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
u AS (SELECT *, sum(n) OVER (PARTITION BY o ORDER BY ln) AS upto FROM c),
f AS (SELECT a.o, a.ln AS s, min(b.ln) AS e FROM u a JOIN u b ON a.o = b.o AND b.ln >= a.ln AND b.upto >= a.upto - a.n + 50 GROUP BY ALL
  UNION SELECT a.o, max(b.ln), a.ln FROM u a JOIN u b ON a.o = b.o AND b.ln <= a.ln AND b.upto - b.n <= a.upto - 50 GROUP BY a.o, a.ln),
r AS (SELECT o, s, e, array_to_string(list_slice(ls, s, e), chr(10)) AS run FROM f JOIN d USING (o)),
later AS (SELECT *, row_number() OVER (PARTITION BY e - s, run ORDER BY o, s) AS nth FROM r),
gone AS (SELECT o, list_sort(list(DISTINCT q)) AS qs FROM (SELECT o, unnest(generate_series(s, e)) AS q FROM later WHERE nth > 1) GROUP BY o),
res AS (SELECT doc_id, text, ls, coalesce(qs, []) AS qs FROM d LEFT JOIN gone USING (o))
SELECT documents.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
  CASE WHEN documents.text IS NOT NULL THEN array_to_string(list_transform(qs, lambda x: x - 1), ',') END AS removed,
  CASE WHEN documents.text IS NOT NULL THEN sha256(array_to_string(list_transform(list_filter(generate_series(1, len(ls)), lambda i: NOT list_contains(qs, i)), lambda i: ls[i]), chr(10))) END AS text_sha256
FROM documents LEFT JOIN res ON documents.doc_id IS NOT DISTINCT FROM res.doc_id AND documents.text = res.text
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, source, CAST({_BLANK_WORDS} AS BIGINT) AS size,
    md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(md5(text), ''), '7')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
p AS (SELECT *, sum(cap) OVER (ORDER BY ratio, source NULLS LAST) - cap AS caps, sum(weight) OVER (ORDER BY ratio, source NULLS LAST) - weight AS weights FROM o),
share AS (SELECT arg_min(x, ratio) AS x FROM (SELECT ratio, CAST((SELECT sum(source_size) FROM s) - caps AS DOUBLE) / ((SELECT sum(weight) FROM w) - weights) AS x FROM p) WHERE x <= ratio),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), x * weight) AS target FROM o, share),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
g AS (SELECT source, key, sum(size) AS words, count(*) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) AS before FROM d GROUP BY source, key),
k AS (SELECT g.source, key, least(greatest(floor(target) - epochs * source_size - before, 0), words) // n AS part, words // n AS one
  FROM g JOIN e ON g.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + part AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key
"""

def _op10() -> str:
    line = f"' ' || array_to_string({_WORDS}, ' ') || ' '"
    where = {phrase: f"list_filter(generate_series(1, len(w)), lambda i: array_to_string(list_slice(w, i, i + {len(phrase.split()) - 1}), ' ') = '{phrase}')" for phrase in PHRASES}
    base = " || ".join(f"list_transform({at}, lambda i: struct_pack(s := i - 1, label := '{PHRASES[p]}'))" for p, at in where.items())
    notices = " || ".join(f"CASE WHEN regexp_matches(line, '{as_regex(t)}') THEN ['{label}'] ELSE [] END" for label, t in TEMPLATES)
    joined = "array_to_string(list_sort(list_distinct({0})), ',')"
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w, {line} AS line FROM documents),
f AS (SELECT doc_id, w, {base} AS base, {notices} AS notices FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
  list_min(list_transform(base, lambda x: x.s)) AS first_word, list_max(list_transform(base, lambda x: x.s)) AS last_word,
  {joined.format("list_transform(base, lambda x: x.label)")} AS base_labels, {joined.format("list_transform(base, lambda x: x.label) || notices")} AS labels,
  CASE WHEN len(notices) > 0 THEN 1.0::DOUBLE WHEN len(base) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM f
"""

_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

_OP11 = f"""
WITH o AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor({_CRC32}, 4294967295) % 9 AS h FROM o),
q AS (SELECT h.conv_id, coalesce(list_slice(b.s, 1, h.h), []) || list_slice(h.s, h.h + 1, len(h.s)) AS s FROM h LEFT JOIN o AS b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(s) AS n, unnest(generate_series(0, len(s))) AS depth, s FROM q),
m AS (SELECT conv_id, n, depth, CASE WHEN depth = 0 THEN [] ELSE list_slice(s, 1, depth) END AS prefix FROM p),
v AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth) AS ends FROM m GROUP BY ALL),
up AS (SELECT c.*, f.conv_id AS parent FROM v AS c LEFT JOIN v AS f ON c.depth = f.depth + 1 AND list_slice(c.prefix, 1, c.depth - 1) = f.prefix),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
w AS (SELECT up.*, coalesce(n_children, 0) AS n_children, CASE WHEN up.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(prefix[-1].x) END AS saved FROM up
  LEFT JOIN kids ON kids.parent = up.conv_id AND kids.depth = up.depth),
b AS (SELECT unnest(generate_series(0, depth)) AS d, prefix, n_children, saved FROM w),
t AS (SELECT CASE WHEN d = 0 THEN [] ELSE list_slice(prefix, 1, d) END AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM b GROUP BY 1)
SELECT conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM w JOIN t ON w.prefix = t.top
"""


ORACLES = {"op11_prefix_trie": _OP11, "op10_licenses": _op10(), "op5_decontamination": _OP5, "op6_line_dedup": _OP6, "op7_source_mixing": _OP7}
