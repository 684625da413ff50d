"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

EXACT = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY doc_id)
"""



JACCARD = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
        ELSE [array_to_string(t[i:i + 3], ' ') FOR i IN range(1, len(t) - 2)] END) AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.a)
SELECT s.doc_id, len(s.g) AS n_shingles, m.component_id
FROM s JOIN (SELECT a, min(c) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
"""

SUFFIX = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
x AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
s AS (SELECT doc_id, i, h[2 * i + 1:2 * i + 100] AS w FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM x WHERE n >= 50)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM s) WHERE least < doc_id),
g AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
k AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
q AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, run),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM q),
c AS (
    SELECT x.doc_id, string_agg(x.h[2 * e.before + 1:2 * e.a], '' ORDER BY e.a) || x.h[2 * max(e.z) + 1:] AS kept, sum(e.z - e.a) AS gone, count(*) AS runs
    FROM x JOIN e ON e.doc_id = x.doc_id GROUP BY x.doc_id, x.h)
SELECT x.doc_id, x.n AS n_bytes, coalesce(c.gone, 0)::BIGINT AS n_removed, coalesce(c.runs, 0)::BIGINT AS n_spans,
       sha256(from_hex(CASE WHEN c.doc_id IS NULL THEN x.h ELSE c.kept END)) AS kept_sha256
FROM x LEFT JOIN c ON c.doc_id = x.doc_id
"""

SUBSTRING = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, i, array_to_string(t[i:i + 19], ' ') AS x FROM (SELECT doc_id, t, unnest(range(1, len(t) - 18)) AS i FROM w WHERE len(t) >= 20)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM m),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
v AS (SELECT doc_id, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS i FROM w),
k AS (SELECT v.doc_id, string_agg(v.x, ' ' ORDER BY v.i) AS kept FROM v ANTI JOIN g ON g.doc_id = v.doc_id AND g.i = v.i GROUP BY v.doc_id)
SELECT w.doc_id, len(w.t) AS n_words, coalesce(len(l.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""

BENCHMARK = """
WITH low AS (
    SELECT doc_id AS id, true AS is_doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    UNION ALL SELECT item_id, false, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT id, is_doc, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM low),
b AS (SELECT id, least(len(t), 10) AS n, t FROM w WHERE NOT is_doc AND len(t) > 0),
bw AS (SELECT DISTINCT id, n, array_to_string(t[i:i + n - 1], ' ') AS x FROM (SELECT id, n, t, unnest(range(1, len(t) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT id, n, i, array_to_string(t[i:i + n - 1], ' ') AS x FROM (SELECT id, n, t, unnest(range(1, len(t) - n + 2)) AS i FROM w, sizes WHERE is_doc AND len(t) >= n)),
hit AS (SELECT dw.id, dw.i, dw.n, bw.id AS item FROM dw JOIN bw ON bw.n = dw.n AND bw.x = dw.x),
places AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM hit) GROUP BY id)
SELECT w.id AS doc_id, len(w.t) AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN places p ON p.id = w.id LEFT JOIN items n ON n.id = w.id WHERE w.is_doc
"""

RANKED = """
WITH low AS (
    SELECT doc_id AS id, true AS is_doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    UNION ALL SELECT item_id, false, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT id, is_doc, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM low WHERE t IS NOT NULL),
d AS (SELECT id, len(t) AS n, unnest(t) AS term FROM w WHERE is_doc),
total AS (SELECT count(DISTINCT id) AS docs, count(*) AS terms FROM d),
p AS (SELECT id, n, term, count(*) AS tf FROM d GROUP BY id, n, term),
q AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(t) AS term FROM w WHERE NOT is_doc)),
k AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
s AS (
    SELECT q.id AS item_id, p.id AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
    FROM q JOIN k ON k.term = q.term JOIN p ON p.term = q.term, total GROUP BY q.id, p.id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": JACCARD,
        "op6_suffix_dedup": SUFFIX,
        "op7_substring_dedup": SUBSTRING,
        "op8_exact_dedup": EXACT,
        "op9_decontaminate": BENCHMARK,
        "op11_ranked_search": RANKED,
    }
