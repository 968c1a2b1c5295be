"""SQL for DuckDB that restates the registered queries, as far as SQL can."""

from __future__ import annotations

from custvoice.llm import licenses

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM m, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
b AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_alpha,
             len(list_filter(ls, lambda x: x[1] IN ('-', '*'))) AS n_bullets
      FROM w LEFT JOIN n ON w.r = n.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR (n_lines > 3 AND 100 * n_dup_lines > 60 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_alpha < 60 * n_words
            OR (n_lines > 3 AND 100 * n_bullets > 90 * n_lines)) AS kept
FROM f
"""


_TEMPLATES = ", ".join(f"('{label}', '{text}', '{key}')" for label, text, key in licenses.TEMPLATES)
_BASE = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.BASE_PHRASES.items())
# Every place of a mandatory phrase is tried against its template, without an index.
OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
u AS (SELECT r, ws, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
p AS (SELECT string_split(phrase, ' ') AS ps, label FROM (VALUES {_BASE}) v(phrase, label)),
b AS (SELECT r, i, label FROM u JOIN p ON w = ps[1] AND ws[i + 1 : i + len(ps)] = ps),
bb AS (SELECT r, count(*)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word, list(DISTINCT label) AS ls FROM b GROUP BY r),
t AS (SELECT label, string_split(txt, ' ') AS ts, string_split(phrase, ' ') AS ks,
             len(string_split(trim(split_part(' ' || txt || ' ', ' ' || phrase || ' ', 1)), ' ')) * (NOT starts_with(txt, phrase))::INT AS shift
      FROM (VALUES {_TEMPLATES}) v(label, txt, phrase)),
h AS (SELECT r, label, ts, (i - shift)::BIGINT AS o, ws FROM u JOIN t ON w = ks[1] AND ws[i + 1 : i + len(ks)] = ks),
s AS (SELECT r, label, list_sum(list_transform(range(len(ts)), lambda j: CASE WHEN o + j >= 0 AND ws[o + j + 1] = ts[j + 1] THEN 1 ELSE 0 END)) / len(ts) AS score FROM h),
ss AS (SELECT r, list(DISTINCT label) AS ls, max(score) AS score FROM s WHERE score >= 0.8 GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(bb.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(coalesce(bb.ls, []) || coalesce(ss.ls, []))), ','), '') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(ss.score, 0.0))::DOUBLE AS score
FROM d LEFT JOIN bb USING (r) LEFT JOIN ss USING (r)
"""


# Compares all pairs that share a shingle, then follows links.
OP7 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
s AS (SELECT DISTINCT r, md5(array_to_string(ws[i : i + 4], ' ')) AS g
      FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n p ON a = p.r JOIN n q ON b = q.r WHERE 100 * c >= 80 * (p.n + q.n - c)),
w AS (SELECT r AS a, r AS b FROM d UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT w.a AS r, min(t.doc_id) AS component_id FROM w JOIN d t ON w.b = t.r GROUP BY w.a) m USING (r)
"""


# The CRC-32 of a number's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT),
    lambda c, x: list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(c, x)), 4294967295::BIGINT), 4294967295)"""

# Without seeds: every pair of equal six-word stretches of a document, put together along their distance.
OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} AS h,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o FROM documents),
e AS (SELECT r, doc_id, o, h % 10 = 0 AND len(o) > 0 AS echo, (h // 10) % greatest(len(o), 1) AS a, h // 10 AS g FROM d),
p AS (SELECT *, 1 + (len(o) - a) // (3 + g % 8) AS p FROM e),
w AS (SELECT r, doc_id, CASE WHEN echo THEN list_transform(range(len(o)), lambda i: o[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1])
                             ELSE o END AS ws FROM p),
s AS (SELECT r, i, md5(array_to_string(ws[i + 1 : i + 6], ' ')) AS g
      FROM (SELECT r, ws, unnest(range(greatest(len(ws) - 5, 0))) AS i FROM w)),
x AS (SELECT a.r, a.i, b.i - a.i AS q FROM s a JOIN s b ON a.r = b.r AND a.g = b.g AND b.i > a.i),
y AS (SELECT r, i, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM x),
z AS (SELECT r, min(i) AS start, max(i) - min(i) + 6 + q AS length, q FROM y GROUP BY r, q, k),
u AS (SELECT r, start, length, min(q) AS period FROM z WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length),
b AS (SELECT r, count(*) AS n_runs, arg_max({{'s': start, 'l': length, 'p': period}}, (length, -start, -period)) AS best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told,
             list({{'a': start + period, 'b': start + length}}) AS cuts FROM u GROUP BY r),
c AS (SELECT r, array_to_string(list_transform(list_filter(range(len(ws)), lambda i: len(list_filter(cuts, lambda x: x.a <= i AND i < x.b)) = 0),
                                               lambda i: ws[i + 1]), ' ') AS text FROM w JOIN b USING (r))
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256,
       sha256(coalesce(c.text, array_to_string(ws, ' '))) AS collapsed_sha256
FROM w LEFT JOIN b USING (r) LEFT JOIN c USING (r)
"""

OP12 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_HEAD = " || ".join(_field(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# All levels of both kinds of tree, then each document's siblings, then the way up.
OP13 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree,
        sha256({_HEAD} || {_field('text')}) AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN sha256({_HEAD} || {_field(_LOWERED)}) END AS altered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (SELECT 0 AS lvl, tree, idx, n, leaf AS node FROM l
      UNION ALL SELECT lvl + 1, tree, idx >> 4, (n + 15) >> 4, sha256(string_agg(node, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lvl, tree, idx >> 4, n),
s AS (SELECT tree, node AS subroot, lvl AS high, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
m AS (SELECT 0 AS lvl, place AS idx, n, subroot AS node FROM s
      UNION ALL SELECT lvl + 1, idx >> 4, (n + 15) >> 4, sha256(string_agg(node, '' ORDER BY idx)) FROM m WHERE n > 1 GROUP BY lvl, idx >> 4, n),
p AS (SELECT r, t.lvl AS step, coalesce(string_agg(node, '' ORDER BY t.idx) FILTER (t.idx < (l.idx >> (4 * t.lvl))), '') AS a,
             coalesce(string_agg(node, '' ORDER BY t.idx) FILTER (t.idx > (l.idx >> (4 * t.lvl))), '') AS b
      FROM l JOIN t ON l.tree = t.tree AND t.n > 1 AND t.idx >> 4 = l.idx >> (4 * t.lvl + 4) GROUP BY r, t.lvl
      UNION ALL SELECT r, high + m.lvl, coalesce(string_agg(node, '' ORDER BY m.idx) FILTER (m.idx < (place >> (4 * m.lvl))), ''),
             coalesce(string_agg(node, '' ORDER BY m.idx) FILTER (m.idx > (place >> (4 * m.lvl))), '')
      FROM d JOIN s USING (tree) JOIN m ON m.n > 1 AND m.idx >> 4 = place >> (4 * m.lvl + 4) GROUP BY r, high, m.lvl),
f AS (SELECT r, 0 AS step, coalesce(altered, leaf) AS node FROM d
      UNION ALL SELECT r, step + 1, sha256(a || node || b) FROM f JOIN p USING (r, step)),
q AS (SELECT r, string_agg(a || b, '' ORDER BY step) AS siblings FROM p GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN s USING (tree) JOIN (SELECT r, arg_max(node, step) AS folded_root FROM f GROUP BY r) USING (r) LEFT JOIN q USING (r),
     (SELECT node AS root FROM m WHERE n = 1)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_licenses": OP5, "op7_set_join": OP7, "op10_quality": OP10,
            "op11_periodic_runs": OP11, "op12_exact_copies": OP12, "op13_manifest": OP13}
