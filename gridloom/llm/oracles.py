"""DuckDB SQL for operators whose results need no model and no tokenizer."""

from __future__ import annotations

from . import ngram_join, substring_dedup, winnowing

WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALL = "18446744073709551616::UHUGEINT"


def run_of(n: int) -> str:
    """n words from here on, joined by a space; NULL where fewer are left."""
    return " || ' ' || ".join(["word"] + [f"lead(word, {k}) OVER o" for k in range(1, n)])


def jaccard(n: int = ngram_join.N, percent: int = ngram_join.PERCENT) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOW)} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) >= {n}),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, {run_of(n)} AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {n - 1}),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least_, w.doc_id)) AS component_id
FROM w LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_ FROM r GROUP BY a) m USING (doc_id)
"""


def substrings(n: int = substring_dedup.LENGTH) -> str:
    return f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
u AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, {run_of(n)} AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS gone FROM g WHERE g IS NOT NULL),
c AS (SELECT u.doc_id, u.i, word, coalesce(max(gone::INT) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) AS gone FROM u LEFT JOIN m ON m.doc_id = u.doc_id AND m.i = u.i),
k AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


def fingerprints(gram: int = winnowing.GRAM, window: int = winnowing.WINDOW) -> str:
    """Hashes of 8 code points by doubling modulo 2**64, as the operator's; the least of each window, the later of equal ones."""
    m1, m2, m3 = (f"{int(m)}::UHUGEINT" for m in (winnowing.M1, winnowing.M2, winnowing.M3))
    bits = winnowing.PLACE_BITS
    mask = (1 << bits) - 1
    power = {k: f"{pow(int(winnowing.M1), k, 1 << 64)}::UHUGEINT" for k in (1, 2, 4)}
    assert gram == 8
    double = lambda x, k: f"(({x} * {power[k]} + lead({x}, {k}) OVER o) % {ALL})"
    mix = lambda x, shift, by: f"((xor({x}, {x} >> {shift})::UHUGEINT * {by}) % {ALL})::UBIGINT"
    near = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct({0} || {1})) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
f AS (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), (SELECT max(doc_id) FROM d)) AS next_id FROM d),
e AS MATERIALIZED (SELECT f.doc_id, f.next_id, f.n, f.t, substring(f.t, 1, f.n - f.n // 2) || substring(x.t, 1, f.n // 2) AS s FROM f JOIN d x ON x.doc_id = f.next_id),
t AS (SELECT doc_id * 2 AS k, t AS s FROM e UNION ALL SELECT doc_id * 2 + 1, s FROM e),
c AS (SELECT k, length(s) AS n, regexp_extract_all(s, '(?s).') AS cs FROM t WHERE s <> ''),
l1 AS (SELECT k, n, unnest(cs) AS ch, generate_subscripts(cs, 1) AS i FROM c WHERE n >= {gram}),
l2 AS (SELECT k, n, i, (unicode(ch)::UHUGEINT * {m3} + {m2}) % {ALL} AS h FROM l1),
l3 AS (SELECT k, n, i, {double("h", 1)} AS h FROM l2 WINDOW o AS (PARTITION BY k ORDER BY i)),
l4 AS (SELECT k, n, i, {double("h", 2)} AS h FROM l3 WINDOW o AS (PARTITION BY k ORDER BY i)),
l5 AS (SELECT k, n, i, {double("h", 4)} AS h FROM l4 WINDOW o AS (PARTITION BY k ORDER BY i)),
sh AS (SELECT k, n, 1 AS i, list_reduce(list_transform(cs, lambda x: (unicode(x)::UHUGEINT * {m3} + {m2}) % {ALL}), lambda a, b: (a * {m1} + b) % {ALL}) AS h FROM c WHERE n < {gram}),
p0 AS (SELECT k, greatest(1, n - {gram - 1}) AS cnt, i, h::UBIGINT AS h FROM (SELECT * FROM l5 UNION ALL SELECT * FROM sh) WHERE h IS NOT NULL AND i <= greatest(1, n - {gram - 1})),
p1 AS (SELECT k, cnt, i, {mix("h", 30, m2)} AS h FROM p0),
p2 AS (SELECT k, cnt, i, {mix("h", 27, m3)} AS h FROM p1),
p3 AS (SELECT k, cnt, i, (xor(h, h >> 31) >> {bits}) AS h FROM p2),
v AS (SELECT k, cnt, i, min(h::UHUGEINT * {mask + 1}::UHUGEINT + ({mask} - (i - 1))::UHUGEINT) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS v FROM p3),
q AS (SELECT DISTINCT k, (v // {mask + 1}::UHUGEINT)::UBIGINT AS h, {mask} - (v % {mask + 1}::UHUGEINT)::BIGINT AS place FROM v WHERE i <= greatest(1, cnt - {window - 1})),
fp AS MATERIALIZED (SELECT k, string_agg(lpad(lower(hex(h)), {(64 - bits) // 4}, '0') || lpad(lower(hex(place)), {bits // 4}, '0'), '' ORDER BY place) AS fp, list_distinct(list(h)) AS hs FROM q GROUP BY k)
SELECT e.doc_id, e.n AS n_chars, sha256(e.s) AS edited_sha256, coalesce(a.fp, '') AS fingerprint, coalesce(b.fp, '') AS edited_fingerprint,
       {near.format("coalesce(a.hs, [])", "coalesce(b.hs, [])")} AS near_edited, {near.format("coalesce(a.hs, [])", "coalesce(x.hs, [])")} AS near_next
FROM e LEFT JOIN fp a ON a.k = e.doc_id * 2 LEFT JOIN fp b ON b.k = e.doc_id * 2 + 1 LEFT JOIN fp x ON x.k = e.next_id * 2
"""
