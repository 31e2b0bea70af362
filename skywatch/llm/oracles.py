"""DuckDB SQL for the queries that SQL can express in reasonable time on whole tables.

Fifty-byte strings of whole texts (op4) are too many for it; that query is tested by brute force.
"""

from __future__ import annotations

from skywatch.llm.quality import RULES, STOP_WORDS

_SPACED = r"[^\x20\x09-\x0D]+"
_LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_UPPER.lower()}')"


#: Rows get a number of their own: ids may repeat or be null.
_DOCS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"

def _op6() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    failed = []
    for rule in RULES:
        value = rule.top if rule.bottom is None else f"({rule.top}::DOUBLE / greatest({rule.bottom}, 1))"
        tests = [f"{value} < {rule.low}"] * (rule.low is not None) + [f"{value} > {rule.high}"] * (rule.high is not None)
        failed.append(f"CASE WHEN n_words >= {rule.from_words} AND ({' OR '.join(tests)}) THEN '{rule.name}' END")
    return f"""
WITH {_DOCS},
w AS (
  SELECT *, regexp_extract_all(text, '{_SPACED}') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d
),
p AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM w),
v AS (SELECT r, k, array_to_string(w[k:k + 4], chr(1)) AS v FROM p),
t AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, v) AS n FROM v) WHERE n > 1),
x AS (SELECT r, least(5, coalesce(lead(k) OVER (PARTITION BY r ORDER BY k), k + 5) - k) AS n FROM t),
rep AS (SELECT r, sum(n)::BIGINT AS n FROM x GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(l, lambda x: suffix(x, '...') OR suffix(x, '…')))::BIGINT AS n_ellipsis_lines,
    len(list_intersect(w, [{stop}]))::BIGINT AS n_stop_words
  FROM w LEFT JOIN rep USING (r)
),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    array_to_string(list_filter([{', '.join(failed)}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM b
"""


OP7 = f"""
WITH {_DOCS},
i AS (SELECT item_id, regexp_extract_all({_lower("text")}, '{_LETTERED}') AS w FROM benchmark),
j AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS v FROM j),
w AS (SELECT r, doc_id, regexp_extract_all({_lower("text")}, '{_LETTERED}') AS w FROM d),
sizes AS (SELECT DISTINCT n FROM v),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, sizes WHERE len(w) >= n),
g AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS v FROM p),
hit AS (SELECT g.r, g.p, g.n, v.item_id FROM g JOIN v ON g.n = v.n AND g.v = v.v),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS k FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit,
  coalesce(items.n_items, 0)::BIGINT AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
  coalesce(words.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP8 = f"""
WITH RECURSIVE {_DOCS},
w AS (SELECT r, doc_id, regexp_extract_all({_lower("text")}, '{_SPACED}') AS w FROM d),
p AS (
  SELECT r, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM w
),
s AS (SELECT DISTINCT r, s FROM p),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach(a, b) AS (SELECT r, r FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
low AS (SELECT a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
  CASE WHEN n.n IS NULL THEN d.doc_id ELSE low.component_id END AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN low USING (r)
"""

OP9 = f"""
WITH {_DOCS},
w AS (SELECT r, doc_id, regexp_extract_all(text, '{_SPACED}') AS w FROM d),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM w),
v AS (SELECT r, doc_id, p, array_to_string(w[p:p + 12], ' ') AS v FROM p),
m AS (SELECT v, min(doc_id) AS low FROM v GROUP BY v),
g AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS k FROM v JOIN m USING (v) WHERE m.low < v.doc_id),
a AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM w),
t AS (
  SELECT a.r, count(g.k) AS n_removed, string_agg(a.x, ' ' ORDER BY a.k) FILTER (WHERE g.k IS NULL) AS kept
  FROM a LEFT JOIN g ON g.r = a.r AND g.k = a.k GROUP BY a.r
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(t.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (r)
"""

OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
h AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
    ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d
),
f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
      WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""


def _op12(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of assignment and mean, written out one after the other."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""dist{k} AS (
  SELECT c.r, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN book{k} b ON b.part = c.part AND b.pos = c.pos
  GROUP BY c.r, c.part, b.entry
),
best{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM dist{k} GROUP BY r, part),""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
  SELECT part, pos, entry, sum(x) AS s, count(*) AS n FROM best{k} JOIN c USING (r, part) GROUP BY part, pos, entry
),
book{k + 1} AS MATERIALIZED (
  SELECT part, pos, entry, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END::BIGINT AS x
  FROM book{k} LEFT JOIN mean{k} USING (part, pos, entry)
),""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
u AS (SELECT r, unnest(e) AS x, unnest(range(len(e))) AS i, len(e) // {parts} AS w FROM k),
c AS MATERIALIZED (SELECT r, i // w AS part, i % w AS pos, floor(256 * x::DOUBLE)::BIGINT AS x FROM u),
book0 AS (SELECT part, pos, r AS entry, x FROM c WHERE r < {entries}),
{chr(10).join(steps)}
v AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM best{rounds} GROUP BY r),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM k JOIN v USING (r) GROUP BY label)
SELECT k.vec_id, v.code, v.error, l.label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM k JOIN v USING (r) JOIN l ON l.label IS NOT DISTINCT FROM k.label
"""


ORACLES = {
    "op6_quality_rules": _op6(),
    "op7_benchmark_decontamination": OP7,
    "op8_ngram_jaccard_join": OP8,
    "op9_substring_dedup": OP9,
    "op11_fill_in_middle": OP11,
    "op12_vector_codes": _op12(),
}
