"""DuckDB SQL for the queries of the catalog, on the same tables."""

from __future__ import annotations

from orrery.functions import lexical, semantic, structural
from orrery.operators import changes, clones, contracts, surface
from orrery.plans import fixtures

POINTS = """points AS (
  SELECT id, '/src/' || dominant_domain || '/v' || id || ['.py', '.js', '.ts', '.go'][id % 4 + 1] AS file_path, p, p[1:48] AS lexical, p[49:60] AS structural,
         p[61:64] AS semantic, md5(id::VARCHAR) AS content_hash, (20 + id * 37 % 900)::INTEGER AS line_count, dominant_domain, 1704067200 + id * 60 AS created
  FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS p, ['auth', 'db', 'api', 'ui', 'util'][label % 5 + 1] AS dominant_domain FROM embeddings))"""
CONTRACTS = (
    POINTS
    + """, n AS (SELECT vec_id AS v FROM embeddings), e AS (
  SELECT v AS s, v // 2 AS d FROM n UNION SELECT v, v % 17 FROM n WHERE v >= 17 AND v % 3 <> 0 UNION SELECT v, v + 1 FROM n WHERE v % 10 = 0 UNION SELECT v + 1, v FROM n WHERE v % 10 = 0),
contracts AS (
  SELECT e.s || ':' || e.d AS id, e.s AS caller_id, e.d AS callee_id, 'import' AS contract_type, list_distance(a.p, b.p) AS baseline_distance,
         a.file_path AS caller_path, b.file_path AS callee_path, a.p AS pa, b.p AS pb
  FROM e JOIN points a ON a.id = e.s JOIN points b ON b.id = e.d WHERE e.s <> e.d)"""
)
DELTAS = """deltas AS (
  SELECT event_id AS id, user_id AS code_point_id, value / 1000.0::DOUBLE AS movement_magnitude, ['lexical', 'structural', 'semantic'][event_id % 3 + 1] AS dominant_change, ts AS created_at FROM events)"""
COMMITS = """commits AS (SELECT p.file_path, e.event_id::VARCHAR AS hash, e.ts, e.event_type AS author FROM events e JOIN points p ON p.id = e.user_id)"""
TENSIONS = """tensions AS (
  SELECT c.id || '/' || d.id AS id, c.id AS contract_id, d.id AS delta_id, d.movement_magnitude AS tension_magnitude, ['detected', 'reviewed', 'resolved', 'ignored'][d.id % 4 + 1] AS status,
         d.created_at, c.callee_id, c.caller_path, c.callee_path, c.baseline_distance
  FROM deltas d JOIN contracts c ON c.callee_id = d.code_point_id WHERE d.movement_magnitude / c.baseline_distance >= 0.15::DOUBLE)"""
TEMPORAL = """temporal AS (
  SELECT p.file_path, CASE WHEN h.age IS NULL THEN 0 ELSE least(age / 365.0::DOUBLE, 1) END::DOUBLE AS file_age, CASE WHEN h.age IS NULL THEN 0 ELSE least(recent / 30.0::DOUBLE, 1) END::DOUBLE AS change_frequency,
         CASE WHEN h.age IS NULL THEN 0 ELSE least(authors / 10.0::DOUBLE, 1) END::DOUBLE AS author_diversity, CASE WHEN h.age IS NULL THEN 0 ELSE greatest(0, 1 - since / 90.0::DOUBLE) END::DOUBLE AS days_since_change,
         CASE WHEN h.age IS NULL THEN 1 ELSE 1 - least(recent / 30.0::DOUBLE, 1) END::DOUBLE AS stability_score
  FROM points p LEFT JOIN (
    SELECT file_path, floor((1706745600 - floor(epoch(min(ts)))) / 86400) AS age, floor((1706745600 - floor(epoch(max(ts)))) / 86400) AS since,
           count(*) FILTER (WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 90 DAYS) AS recent, count(DISTINCT author) AS authors
    FROM commits GROUP BY file_path) h ON h.file_path = p.file_path)"""
FILES = """files AS (
  SELECT k, '/src/' || dn || '/f' || k || ['.py', '.js', '.ts', '.go'][e + 1] AS file_path,
    CASE WHEN e = 0 THEN 'import os' || chr(10) || 'from src.' || tdn || '.f' || t || ' import run' || chr(10)
           || repeat('# step' || chr(10) || 'def run_' || sz || '(a, b=1):' || chr(10) || '    if a and b != ' || sz || ':' || chr(10) || '        return ' || kw || chr(10), 1 + sz % 9)
         WHEN e = 3 THEN 'package main' || chr(10) || repeat('// note' || chr(10) || 'func run() { x := ' || sz || ' }' || chr(10), 1 + sz % 3)
         ELSE 'import { run } from "../' || tdn || '/f' || t || '";' || chr(10)
           || repeat('export const run' || sz || ' = async (a) => {' || chr(10) || '  try { if (a >= ' || sz || ' && b) { return await ' || kw || '; } } catch (error) { throw new Error("x"); }' || chr(10) || '};' || chr(10), 1 + sz % 11)
    END AS content
  FROM (SELECT p_partkey AS k, p_size AS sz, p_partkey % 4 AS e, p_partkey // 2 AS t, ['auth', 'db', 'api', 'ui', 'util'][p_partkey % 5 + 1] AS dn,
               ['auth', 'db', 'api', 'ui', 'util'][(p_partkey // 2) % 5 + 1] AS tdn,
               ['login(token, password)', 'query(schema, table)', 'route(request, response)', 'render(component, props)', 'parse(format, config)'][p_partkey % 5 + 1] AS kw FROM part))"""
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def _beyond(name: str, value: str | None = None, over: float | None = None, under: float | None = None, whole: bool = False) -> str:
    value = value or name
    number = f" ' || {value} || '" if whole else ""
    cases = [f"WHEN {value} {sign} {limit}::DOUBLE THEN '{name}{number} {way} {limit:g}'" for limit, sign, way in ((under, "<", "under"), (over, ">", "over")) if limit is not None]
    return f"CASE {' '.join(cases)} END"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{_q(pattern)}'))"


def _sum(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join(_count(text, p) for p in patterns) + ")"


def _replaced(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{_q(pattern)}', '{_q(by)}', 'g')"
    return text


def _find(a: str, where: str = "") -> str:
    """Distances of all other points from point 7 by the columns `a`."""
    return f"SELECT q.id, q.file_path, q.dominant_domain, round({a}, 6) AS distance, round(list_cosine_similarity(q.p, r.p), 6) AS similarity FROM points q, points r WHERE r.id = 7 AND q.id <> 7 {where} ORDER BY {a}, q.file_path LIMIT 10"


TOKENS = "regexp_extract_all(lower(translate(regexp_replace(content, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '\\b[a-zA-Z]{2,}\\b')"
BIGRAMS = "[t[i] || '_' || t[i + 1] FOR i IN range(1, len(t))]"


def _lexical() -> str:
    terms = [(f"len(list_filter(t, lambda x: x = '{w}')) / greatest(len(t), 1)::DOUBLE") for w in lexical.VOCABULARY]
    pairs = [(f"len(list_filter(b, lambda x: x = '{w}')) / greatest(len(b), 1)::DOUBLE") for w in lexical.BIGRAM_VOCABULARY]
    return f"""w AS (SELECT file_path, {TOKENS} AS t FROM files), wb AS (SELECT file_path, t, {BIGRAMS} AS b FROM w),
raw AS (SELECT file_path, [{", ".join(terms + pairs)}] AS v FROM wb),
lex AS (SELECT file_path, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS v FROM (SELECT file_path, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM raw))"""


def _structural() -> str:
    s = structural
    ops = ", ".join(_count("clean", p) for p in s.OPERATORS)
    stop = ", ".join(f"'{w}'" for w in s.NOT_OPERANDS)
    sources = " || ".join(f"regexp_extract_all(content, '{_q(p)}', 1)" for p in s.SOURCES)
    comments = " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(content, '{_q(p)}'), lambda x: length(x))), 0)" for p in s.COMMENTS)
    return rf"""c AS (SELECT *, string_split(content, chr(10)) AS ln, {_replaced("content", s.STRIPPED)} AS clean, list_distinct({sources}) AS src FROM files),
d AS (SELECT *, [{ops}] AS ops, list_filter(regexp_extract_all(clean, '{s.IDENTIFIER}'), lambda x: x NOT IN ({stop})) || regexp_extract_all(clean, '{s.NUMBER}') AS used,
        list_filter(ln, lambda x: regexp_matches(x, '\S')) AS fl, {_sum("content", s.DEFINITIONS)} AS defs, {_sum("content", s.EXPORTED)} AS exps FROM c),
m AS (SELECT *, len(list_filter(ops, lambda x: x > 0)) AS n1, list_sum(ops)::DOUBLE AS b1, len(list_distinct(used)) AS n2, len(used) AS b2 FROM d),
h AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN (b1 + b2) * log2(n1 + n2) ELSE 0 END AS vol, CASE WHEN n1 > 0 AND n2 > 0 THEN (n1 / 2.0::DOUBLE) * (b2 / n2::DOUBLE) ELSE 0 END AS dif FROM m),
struct AS (SELECT file_path, len(ln)::INTEGER AS line_count, [least(len(ln) / 500.0::DOUBLE, 1), least({_sum("content", s.FUNCTIONS)} / 20.0::DOUBLE, 1), least({_sum("content", s.CLASSES)} / 10.0::DOUBLE, 1),
  least({_sum("content", s.IMPORTS)} / 30.0::DOUBLE, 1),
  CASE WHEN len(fl) > 0 THEN least(list_sum(list_transform(fl, lambda x: length(regexp_extract(x, '^\s*')) / 4.0::DOUBLE)) / len(fl) / 4.0::DOUBLE, 1) ELSE 0 END,
  least(({comments}) / greatest(length(content), 1)::DOUBLE, 1), least({_sum("content", s.DECISIONS)} / greatest(len(ln), 1)::DOUBLE * 5, 1), least({_sum("content", s.EXPORTS)} / 15.0::DOUBLE, 1),
  CASE WHEN n1 > 0 AND n2 > 0 THEN least((n1 + n2) / 200.0::DOUBLE, 1) ELSE 0 END, least(vol / 10000, 1), least(dif / 50, 1), least(dif * vol / 500000, 1), least(vol / 3000 / 5, 1),
  least(len(src) / 20.0::DOUBLE, 1), CASE WHEN defs > 0 THEN least(exps / defs::DOUBLE, 1) WHEN exps = 0 THEN 0 ELSE 1 END,
  least(len(src) / 20.0::DOUBLE, 1) * 0.6::DOUBLE + len(list_filter(src, lambda x: NOT starts_with(x, '.'))) / greatest(len(src), 1)::DOUBLE * 0.4::DOUBLE]::DOUBLE[] AS v FROM h)"""


def _semantic() -> str:
    scores = ", ".join(_count("lower(content)", semantic.keyword_pattern(words)) for words in semantic.DOMAINS.values())
    names = ", ".join(f"'{d}'" for d in semantic.DOMAINS)
    n = len(semantic.DOMAINS)
    return f"""sc AS (SELECT file_path, [{scores}]::DOUBLE[] AS s FROM files),
sem AS (SELECT file_path, v, [{names}][list_position(v, list_max(v))] AS dominant_domain FROM (
  SELECT file_path, CASE WHEN list_sum(s) > 0 THEN list_transform(s, lambda x: x / list_sum(s)) ELSE list_transform(s, lambda x: 1.0::DOUBLE / {n}) END AS v FROM sc))"""


def _imports() -> str:
    script = " || ".join(f"regexp_extract_all(content, '{_q(p)}', 1)" for p in contracts.SCRIPT_IMPORTS)
    python = " || ".join(f"regexp_extract_all(content, '{_q(p)}', 1)" for p in contracts.PYTHON_IMPORTS)
    return f"""imports AS (SELECT file_path, unnest(list_distinct(CASE WHEN regexp_matches(file_path, '\\.(js|ts)$') THEN {script} WHEN file_path LIKE '%.py' THEN {python} ELSE {script} || {python} END)) AS target FROM files),
dotted AS (SELECT i.file_path AS caller, i.target, min(f.file_path) AS callee FROM imports i JOIN files f ON f.file_path LIKE '%.py' AND (ends_with(f.file_path, replace(i.target, '.', '/') || '.py') OR ends_with(f.file_path, replace(i.target, '.', '/') || '/__init__.py'))
  WHERE i.file_path LIKE '%.py' AND contains(i.target, '.') AND NOT starts_with(i.target, '.') GROUP BY ALL),
base AS (SELECT file_path AS caller, target, '/src' || regexp_replace(target, '^\\.\\.', '') AS b FROM imports WHERE starts_with(target, '../')),
endings AS (SELECT unnest(range({len(contracts.ENDINGS)})) AS rank, unnest([{", ".join(f"'{e}'" for e in contracts.ENDINGS)}]) AS ending),
local AS (SELECT caller, target, arg_min(f.file_path, rank) AS callee FROM base, endings JOIN files f ON f.file_path = b || ending GROUP BY caller, target),
resolved AS (SELECT * FROM dotted UNION ALL SELECT * FROM local)"""


def _versions() -> str:
    """Points and deltas after each batch of file versions: p0, d1, p1, ... and contracts of the first ones."""
    added = ", ".join("'" + a.replace("\n", "' || chr(10) || '") + "'" for a in fixtures.ADDED)
    vectors = f"""{_lexical()}, {_structural()}, {_semantic()} SELECT l.file_path, files.k, content, l.v AS l, s.v AS s, m.v AS m, l.v || s.v || m.v AS p
    FROM lex l JOIN struct s ON s.file_path = l.file_path JOIN sem m ON m.file_path = l.file_path JOIN files ON files.file_path = l.file_path"""
    out = [f"src AS MATERIALIZED (SELECT * FROM files), {_imports()}"]
    for v in range(fixtures.VERSIONS + 1):
        content = f"content || repeat([{added}][k % 3 + 1], {v})" if v else "content"
        out.append(f"x{v} AS MATERIALIZED (SELECT * FROM (WITH files AS (SELECT k, file_path, {content} AS content FROM src{f' WHERE k % {v + 1} <> 0' if v else ''}), {vectors}))")
        if not v:
            out.append("p0 AS MATERIALIZED (SELECT *, 0 AS updated FROM x0)")
            continue
        out.append(f"""d{v} AS MATERIALIZED (SELECT x.file_path, {v} AS batch, list_distance(o.p, x.p) AS m, list_distance(o.l, x.l) AS lc, list_distance(o.s, x.s) AS sc, list_distance(o.m, x.m) AS mc
  FROM x{v} x JOIN p{v - 1} o ON o.file_path = x.file_path WHERE list_distance(o.p, x.p) >= 0.01::DOUBLE),
p{v} AS MATERIALIZED (SELECT o.* FROM p{v - 1} o ANTI JOIN d{v} d ON d.file_path = o.file_path UNION ALL SELECT x.*, {v} FROM x{v} x SEMI JOIN d{v} d ON d.file_path = x.file_path)""")
    batches = range(1, fixtures.VERSIONS + 1)
    out.append("deltas AS (" + " UNION ALL ".join(f"SELECT * FROM d{v}" for v in batches) + ")")
    out.append("""moves AS (SELECT *, substr(md5(file_path), 1, 12) AS point, ['lexical', 'structural', 'semantic'][list_position([lc, sc, mc], list_max([lc, sc, mc]))] AS dominant_change,
  substr(md5(substr(md5(file_path), 1, 12) || ':' || strftime(TIMESTAMP '2024-02-01' + to_hours(batch), '%Y-%m-%dT%H:%M:%S.%f')), 1, 12) AS id FROM deltas)""")
    limit = "CASE WHEN count(*) < 3 THEN 0.15::DOUBLE ELSE greatest(0.05::DOUBLE, least(0.5::DOUBLE, avg(d.m) + 2 * stddev_samp(d.m))) END"
    out.append(f"limits AS (SELECT m.file_path, m.batch, {limit} AS threshold FROM deltas m JOIN deltas d ON d.file_path = m.file_path AND d.batch <= m.batch GROUP BY m.file_path, m.batch)")
    out.append("""links AS (SELECT substr(md5(substr(md5(caller), 1, 12) || ':' || substr(md5(callee), 1, 12)), 1, 12) AS id, caller, callee, list_distance(a.p, b.p) AS base
  FROM (SELECT DISTINCT caller, callee FROM resolved WHERE caller <> callee) r JOIN p0 a ON a.file_path = r.caller JOIN p0 b ON b.file_path = r.callee)""")
    ends = " UNION ALL ".join(f"SELECT {v} AS batch, l.*, 1 - list_cosine_similarity(a.p, b.p) AS cur FROM links l JOIN d{v} d ON d.file_path = l.callee JOIN p{v} a ON a.file_path = l.caller JOIN p{v} b ON b.file_path = l.callee" for v in batches)
    out.append(f"now AS (SELECT *, abs(cur - base) AS size, CASE WHEN base > 0 THEN abs(cur - base) / base ELSE abs(cur - base) END AS pc FROM ({ends}))")
    return ", ".join(out)


def _clones() -> str:
    return f"""tk AS (SELECT file_path, regexp_extract_all(lower({_replaced("content", clones.NORMAL)}), '{_q(clones.TOKEN)}') AS t FROM files),
gh AS (SELECT file_path, [('0x' || substr(md5(array_to_string(t[i:i + 4], ' ')), 1, 8))::BIGINT FOR i IN range(1, len(t) - 3)] AS h FROM tk),
fps AS (SELECT file_path, list_distinct(CASE WHEN len(h) > 3 THEN [list_min(h[i:i + 3]) FOR i IN range(1, len(h) - 2)] ELSE h END) AS f FROM gh),
pairs AS (SELECT a.file_path AS file_a, b.file_path AS file_b, len(list_intersect(a.f, b.f)) AS shared, len(a.f) AS na, len(b.f) AS nb FROM fps a JOIN fps b ON a.file_path < b.file_path AND len(a.f) > 0 AND len(b.f) > 0),
found AS (SELECT *, shared / (na + nb - shared)::DOUBLE AS s FROM pairs WHERE shared / (na + nb - shared)::DOUBLE >= 0.3::DOUBLE)"""


def _surface() -> str:
    s = surface
    parts = [f"list_transform(regexp_extract_all(content, '{_q(p)}', 1), lambda x: '{k} ' || x)" for p, k in s.SCRIPT]
    parts.append(f"CASE WHEN regexp_matches(content, '{_q(s.DEFAULT)}') THEN ['default default'] ELSE [] END")
    parts.append(f"list_transform(flatten(list_transform(regexp_extract_all(content, '{_q(s.LIST)}', 1), lambda y: regexp_extract_all(y, '{_q(s.LISTED)}', 1))), lambda x: 're-export ' || x)")
    parts.append(f"CASE WHEN regexp_matches(content, '{_q(s.MODULE)}') THEN ['commonjs module.exports'] ELSE [] END")
    parts.append(f"list_transform(regexp_extract_all(content, '{_q(s.MEMBER)}', 1), lambda x: 'commonjs ' || x)")
    python = " || ".join(f"list_transform(regexp_extract_all(content, '{_q(p)}', 1), lambda x: '{k} ' || x)" for p, k in s.PYTHON)
    named = f"list_transform(regexp_extract_all(regexp_extract(content, '{_q(s.ALL)}', 1), '{_q(s.QUOTED)}', 1), lambda x: 'explicit ' || x)"
    return (
        _imports()
        + f""", ex AS (SELECT file_path, CASE WHEN regexp_matches(file_path, '\\.(js|ts)$') THEN {" || ".join(parts)} WHEN file_path LIKE '%.py' THEN CASE WHEN regexp_matches(content, '{_q(s.ALL)}') THEN {named} ELSE {python} END ELSE [] END AS x FROM files),
used AS (SELECT callee AS file_path, count(*) AS n, string_agg(caller, ',' ORDER BY caller) AS by_ FROM (SELECT DISTINCT caller, callee FROM resolved WHERE caller <> callee) GROUP BY callee),
sf AS (SELECT ex.file_path, x, len(x) AS e, coalesce(n, 0) AS i, coalesce(by_, '') AS by_ FROM ex LEFT JOIN used ON used.file_path = ex.file_path),
srf AS (SELECT *, (e / greatest(max(e) OVER (), 1)::DOUBLE + i / greatest(max(i) OVER (), 1)::DOUBLE) / 2 AS area, CASE WHEN i > 5 AND e > 5 THEN 'high' WHEN i > 2 OR e > 3 THEN 'medium' ELSE 'low' END AS risk FROM sf)"""
    )


DEGREES = """deg AS (SELECT p.id, (SELECT count(*) FROM contracts c WHERE c.callee_id = p.id) AS in_degree, (SELECT count(*) FROM contracts c WHERE c.caller_id = p.id) AS out_degree FROM points p)"""
#: Fifty turns are more than the tolerance asks for; the values agree at six places.
PAGERANK = """links AS (SELECT caller_id AS s, callee_id AS d, 1.0::DOUBLE / count(*) OVER (PARTITION BY caller_id) AS w FROM contracts),
pr(turn, id, r) AS (
  SELECT 0, id, 1.0::DOUBLE / (SELECT count(*) FROM points) FROM points
  UNION ALL
  SELECT turn, id, 0.15::DOUBLE / (SELECT count(*) FROM points) + 0.85::DOUBLE * sum(m) FROM (
    SELECT pr.turn + 1 AS turn, l.d AS id, pr.r * l.w AS m FROM pr JOIN links l ON l.s = pr.id WHERE pr.turn < 60
    UNION ALL SELECT pr.turn + 1, pr.id, 0::DOUBLE FROM pr WHERE pr.turn < 60) GROUP BY turn, id),
ranks AS (SELECT id, r / sum(r) OVER () AS pagerank FROM pr WHERE turn = 60)"""
HITS = """hits(turn, id, kind, x) AS (
  SELECT 0, id, kind, 1.0::DOUBLE FROM points, (VALUES ('h'), ('a')) k(kind)
  UNION ALL
  SELECT turn, id, kind, x / sqrt(sum(x * x) OVER (PARTITION BY kind)) FROM (SELECT turn, id, kind, sum(m) AS x FROM (
    SELECT s.turn + 1 AS turn, CASE WHEN s.kind = 'h' THEN c.callee_id ELSE c.caller_id END AS id, CASE WHEN s.kind = 'h' THEN 'a' ELSE 'h' END AS kind, s.x AS m
    FROM hits s JOIN contracts c ON CASE WHEN s.kind = 'h' THEN c.caller_id ELSE c.callee_id END = s.id WHERE s.turn < 100
    UNION ALL SELECT turn + 1, id, kind, 0::DOUBLE FROM hits WHERE turn < 100) GROUP BY turn, id, kind)),
scores AS (SELECT h.id, h.x AS hub_score, a.x AS authority_score FROM hits h JOIN hits a ON a.id = h.id AND a.turn = 100 AND a.kind = 'a' WHERE h.turn = 100 AND h.kind = 'h')"""
TENSE = "tense AS (SELECT callee_id AS id, count(*) AS n FROM tensions WHERE status = 'detected' GROUP BY callee_id)"
DRIFTS = """sd AS (SELECT a.file_path AS fa, b.file_path AS fb, 1 - list_cosine_similarity(a.p[1:60], b.p[1:60]) AS d FROM points a JOIN points b ON a.dominant_domain = b.dominant_domain AND a.file_path < b.file_path),
semantic AS (SELECT 'semantic' AS drift_type, CASE WHEN d - 0.4::DOUBLE > 0.3::DOUBLE THEN 'high' WHEN d - 0.4::DOUBLE > 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS severity, fa AS file_a, fb AS file_b, d AS current_distance, 0.4::DOUBLE AS expected_distance, d - 0.4::DOUBLE AS drift_amount FROM sd WHERE d > 0.4::DOUBLE),
cd AS (SELECT *, 1 - list_cosine_similarity(pa, pb) AS cur, abs(1 - list_cosine_similarity(pa, pb) - baseline_distance) / baseline_distance AS a FROM contracts),
contract AS (SELECT 'contract' AS drift_type, CASE WHEN a > 0.5 THEN 'high' WHEN a > 0.35::DOUBLE THEN 'medium' ELSE 'low' END AS severity, caller_path AS file_a, callee_path AS file_b, cur AS current_distance, baseline_distance AS expected_distance, a AS drift_amount FROM cd WHERE a > 0.3::DOUBLE),
temp AS (SELECT 'temporal' AS drift_type, 'medium' AS severity, c.caller_path AS file_a, c.callee_path AS file_b, b.days_since_change - a.days_since_change AS current_distance, 0::DOUBLE AS expected_distance, b.days_since_change - a.days_since_change AS drift_amount
  FROM contracts c JOIN temporal a ON a.file_path = c.caller_path JOIN temporal b ON b.file_path = c.callee_path WHERE b.days_since_change > 0.7::DOUBLE AND a.days_since_change < 0.3::DOUBLE)"""
_DRIFT_COLUMNS = "drift_type, severity, file_a, file_b, round(current_distance, 6) AS current_distance, round(expected_distance, 6) AS expected_distance, round(drift_amount, 6) AS drift_amount"
SMELL_RULES = """envy AS (SELECT caller_id, sum(k) AS total, max(k) AS k FROM (SELECT c.caller_id, n.module, count(*) AS k FROM contracts c JOIN node n ON n.id = c.callee_id GROUP BY ALL) GROUP BY caller_id),
smells AS (
  SELECT 'god_file' AS smell_type, CASE WHEN in_degree > 12 THEN 'critical' ELSE 'high' END AS severity, file_path, name AS file_name FROM node WHERE in_degree >= 8 AND (complexity >= 0.6::DOUBLE OR line_count >= 500)
  UNION ALL SELECT 'orphan', 'medium', file_path, name FROM node WHERE in_degree = 0 AND out_degree = 0 AND NOT regexp_matches(name, 'index|main|app|server|__init__|mod')
  UNION ALL SELECT 'circular_dependency', 'high', least(a.file_path, b.file_path), regexp_extract(least(a.file_path, b.file_path), '[^/]+$') || ' <-> ' || regexp_extract(greatest(a.file_path, b.file_path), '[^/]+$')
    FROM contracts x JOIN contracts y ON x.caller_id = y.callee_id AND x.callee_id = y.caller_id AND x.caller_id < x.callee_id JOIN node a ON a.id = x.caller_id JOIN node b ON b.id = x.callee_id
  UNION ALL SELECT 'feature_envy', 'medium', n.file_path, n.name FROM envy e JOIN node n ON n.id = e.caller_id WHERE e.total >= 3 AND e.k >= 3 AND e.k / e.total >= 0.6::DOUBLE
  UNION ALL SELECT 'hub_overload', CASE WHEN out_degree > 20 THEN 'high' ELSE 'medium' END, file_path, name FROM node WHERE out_degree >= 15 AND NOT regexp_matches(name, 'index|barrel|exports|__init__')
  UNION ALL SELECT 'unstable_interface', 'high', file_path, name FROM node WHERE pagerank >= 0.1::DOUBLE AND change_frequency >= 0.5
  UNION ALL SELECT 'dead_code_candidate', 'low', file_path, name FROM node WHERE in_degree = 0 AND NOT regexp_matches(name, 'index|main|app|server|__init__|test|spec') AND days_since_change < 0.2::DOUBLE AND stability_score > 0.8::DOUBLE)"""
SMELLS = """node AS (
  SELECT p.id, p.file_path, p.line_count, abs(p.structural[7]) * 4 AS complexity, d.in_degree, d.out_degree, r.pagerank, t.change_frequency, t.days_since_change, t.stability_score, regexp_extract(p.file_path, '[^/]+$') AS name,
         regexp_extract(p.file_path, '([^/]+)/[^/]+$', 1) AS module
  FROM points p JOIN deg d ON d.id = p.id JOIN ranks r ON r.id = p.id JOIN temporal t ON t.file_path = p.file_path),
""" + SMELL_RULES


def _file_smells() -> str:
    """Smells of the code files by their own imports, and by the history of the points of equal number."""
    rules = SMELL_RULES
    for word, by in (("contracts", "fcon"), ("FROM node", "FROM fnode"), ("JOIN node", "JOIN fnode"), ("envy AS", "fenvy AS"), ("FROM envy", "FROM fenvy"), ("smells AS", "fsmells AS")):
        rules = rules.replace(word, by)
    rank = PAGERANK.replace("contracts", "fcon").replace("points", "fpoints").replace("links", "flinks").replace("pr(", "fpr(").replace("FROM pr", "FROM fpr").replace("pr.", "fpr.").replace("ranks AS", "franks AS")
    return (
        """fcon AS (SELECT DISTINCT caller AS caller_id, callee AS callee_id FROM resolved WHERE caller <> callee), fpoints AS (SELECT file_path AS id FROM files),
fpast AS (SELECT p.id AS k, floor((1706745600 - floor(epoch(max(c.ts)))) / 86400) AS since, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 90 DAYS) AS recent FROM commits c JOIN points p ON p.file_path = c.file_path GROUP BY p.id),
fin AS (SELECT callee_id AS id, count(*) AS n FROM fcon GROUP BY ALL), fout AS (SELECT caller_id AS id, count(*) AS n FROM fcon GROUP BY ALL), """
        + rank
        + """, fnode AS (SELECT f.file_path AS id, f.file_path, s.line_count, s.v[7] AS complexity, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, r.pagerank,
         CASE WHEN h.k IS NULL THEN 0 ELSE least(h.recent / 30.0::DOUBLE, 1) END::DOUBLE AS change_frequency, CASE WHEN h.k IS NULL THEN 0 ELSE greatest(0, 1 - h.since / 90.0::DOUBLE) END::DOUBLE AS days_since_change,
         CASE WHEN h.k IS NULL THEN 1 ELSE 1 - least(h.recent / 30.0::DOUBLE, 1) END::DOUBLE AS stability_score,
         regexp_extract(f.file_path, '[^/]+$') AS name, regexp_extract(f.file_path, '([^/]+)/[^/]+$', 1) AS module
  FROM files f JOIN struct s ON s.file_path = f.file_path JOIN franks r ON r.id = f.file_path LEFT JOIN fin i ON i.id = f.file_path LEFT JOIN fout o ON o.id = f.file_path LEFT JOIN fpast h ON h.k = f.k),
"""
        + rules
    )


def _wave(ids: str) -> str:
    """Waves by level: (source, id, distance, intensity). A file is reached at its least distance, by its strongest parent."""
    levels = [f"l0 AS (SELECT id AS source, id, dominant_domain AS domain, 0 AS distance, 1.0::DOUBLE AS i FROM points WHERE id IN ({ids}))"]
    for n in range(1, 8):
        seen = " UNION ALL ".join(f"SELECT source, id FROM l{m}" for m in range(n))
        levels.append(
            f"l{n} AS (SELECT l.source, p.id, p.dominant_domain AS domain, {n} AS distance, max(l.i * 0.6::DOUBLE * CASE WHEN p.dominant_domain <> l.domain THEN 0.5::DOUBLE ELSE 1 END) AS i "
            f"FROM l{n - 1} l JOIN contracts c ON c.callee_id = l.id JOIN points p ON p.id = c.caller_id WHERE l.i >= 0.05::DOUBLE AND (l.source, p.id) NOT IN ({seen}) GROUP BY ALL)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(1, 8))
    return ", ".join(levels) + f", wave AS (SELECT *, (i < 0.05::DOUBLE OR id NOT IN (SELECT callee_id FROM contracts)) AS is_boundary FROM ({every}))"


def _paths(levels: int = 14) -> str:
    """Shortest paths (s, v, d, p = their number) level by level, and betweenness from them."""
    out = ["b0 AS (SELECT id AS s, id AS v, 0 AS d, 1.0::DOUBLE AS p FROM points)"]
    for n in range(1, levels):
        seen = " UNION ALL ".join(f"SELECT s, v FROM b{m}" for m in range(n))
        out.append(f"b{n} AS (SELECT x.s, x.v, {n} AS d, sum(x.p) AS p FROM (SELECT l.s, c.callee_id AS v, l.p FROM b{n - 1} l JOIN contracts c ON c.caller_id = l.v) x ANTI JOIN ({seen}) o ON o.s = x.s AND o.v = x.v GROUP BY ALL)")
    every = " UNION ALL ".join(f"SELECT * FROM b{n}" for n in range(levels))
    return (
        ", ".join(out)
        + f""", sp AS ({every}), through AS (SELECT a.v AS id, sum(a.p * b.p / c.p) AS b FROM sp a JOIN sp b ON b.s = a.v JOIN sp c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d WHERE a.s <> a.v AND b.s <> b.v GROUP BY a.v),
btw AS (SELECT p.id, coalesce(t.b, 0) / ((SELECT count(*) FROM points) - 1) / ((SELECT count(*) FROM points) - 2) AS betweenness FROM points p LEFT JOIN through t ON t.id = p.id)"""
    )


def _snippets() -> str:
    trimmed = "[regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN ln]"
    kinds = ", ".join(f"len(list_filter(t, lambda x: regexp_matches(x, '{_q('|'.join(f'(?:{p})' for p in patterns))}')))::INTEGER AS n_{k}" for k, patterns in changes.SNIPPETS.items())
    return f"""l AS (SELECT file_path, content, string_split(content, chr(10)) AS ln FROM files), lt AS (SELECT *, {trimmed} AS t FROM l)
SELECT file_path, len(ln)::INTEGER AS total_lines, {kinds}, len(ln) <= 50 AS complete, md5(CASE WHEN len(ln) <= 50 THEN content ELSE array_to_string(ln[1:50], chr(10)) || chr(10) || '... (' || (len(ln) - 50) || ' more lines)' END) AS content_md5 FROM lt"""


def _debt() -> str:
    return (
        f"WITH RECURSIVE {CONTRACTS}, {DELTAS}, {COMMITS}, {TENSIONS}, {FILES}, {_structural()}, {_clones()}, {TENSE}, {_imports()}, {_file_smells()}, "
        + """h2 AS (SELECT p.id AS k, greatest(0, 1 - floor((1706745600 - floor(epoch(max(c.ts)))) / 86400) / 90.0::DOUBLE) AS fresh FROM points p JOIN commits c ON c.file_path = p.file_path GROUP BY p.id),
cc AS (SELECT f AS file_path, count(*) AS n FROM (SELECT file_a AS f FROM found UNION ALL SELECT file_b FROM found) GROUP BY f),
cs AS (SELECT file_path, count(*) AS n FROM fsmells GROUP BY file_path),
known AS (SELECT s.file_path, s.line_count AS lines, s.v, coalesce(cc.n, 0) AS nc, coalesce(t.n, 0) AS nt, coalesce(cs.n, 0) AS ns, coalesce(h2.fresh, 0)::DOUBLE AS fresh
  FROM struct s JOIN files f ON f.file_path = s.file_path LEFT JOIN cs ON cs.file_path = s.file_path LEFT JOIN cc ON cc.file_path = s.file_path LEFT JOIN tense t ON t.id = f.k LEFT JOIN h2 ON h2.k = f.k),
factors AS (SELECT file_path, lines, nc, nt, ns, fresh, least((v[7] + v[11]) / 2 * 100, 100)::DOUBLE AS complexity, CASE WHEN lines > 500 THEN least(lines / 500.0::DOUBLE * 50, 100) ELSE lines / 500.0::DOUBLE * 20 END::DOUBLE AS size,
  least((v[16] + v[14]) / 2 * 100, 100)::DOUBLE AS coupling, least(nc * 25.0::DOUBLE, 100)::DOUBLE AS duplication, CASE WHEN fresh < 0.2::DOUBLE THEN 60 ELSE (1 - fresh) * 30 END::DOUBLE AS staleness,
  CASE WHEN v[6] < 0.1::DOUBLE THEN (1 - v[6] / 0.1::DOUBLE) * 50 ELSE 0 END::DOUBLE AS documentation, least(ns * 30.0::DOUBLE, 100)::DOUBLE AS smells, least(nt * 40.0::DOUBLE, 100)::DOUBLE AS tensions FROM known),
scored AS (SELECT *, complexity * 0.20::DOUBLE + size * 0.10::DOUBLE + coupling * 0.15::DOUBLE + duplication * 0.15::DOUBLE + staleness * 0.10::DOUBLE + documentation * 0.05::DOUBLE + smells * 0.15::DOUBLE + tensions * 0.10::DOUBLE AS score FROM factors),
debts AS (SELECT *, CASE WHEN score <= 20 THEN 'A' WHEN score <= 40 THEN 'B' WHEN score <= 60 THEN 'C' WHEN score <= 80 THEN 'D' ELSE 'F' END AS grade,
  least((complexity > 60)::INTEGER + (lines > 500)::INTEGER + (coupling > 60)::INTEGER + (nc > 0)::INTEGER + (fresh < 0.2::DOUBLE)::INTEGER + (documentation > 30)::INTEGER + (ns > 0)::INTEGER + (nt > 0)::INTEGER, 5)::INTEGER AS recommendations FROM scored)"""
    )


ADVICE = (
    "advised AS (SELECT *, array_to_string(list_filter(["
    + ", ".join(
        [
            _beyond("complexity", over=60),
            _beyond("lines", over=500, whole=True),
            _beyond("coupling", over=60),
            _beyond("clones", "nc", over=0, whole=True),
            _beyond("recency", "fresh", under=0.2),
            _beyond("documentation", over=30),
            _beyond("smells", "ns", over=0, whole=True),
            _beyond("tensions", "nt", over=0, whole=True),
        ]
    )
    + "], lambda x: x IS NOT NULL)[1:5], '; ') AS advice FROM debts)"
)
HISTORY = ", ".join([_beyond("change_frequency", over=0.5), _beyond("days_since_change", under=0.2), _beyond("author_diversity", over=0.5), _beyond("stability_score", over=0.8)])
INSIGHTS = ", ".join(_beyond(f"{x} distance", c, under=low, over=high) for x, c, low, high in (("lexical", "l", 0.5, 1.5), ("structural", "t", 0.3, 0.8), ("semantic", "m", 0.2, 0.5)))
COCHANGE = """items AS (SELECT DISTINCT file_path, author || '/' || ts::DATE AS s FROM commits), often AS (SELECT file_path, count(*) AS n FROM items GROUP BY file_path),
cochanged AS (SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS together, oa.n AS changes_a, ob.n AS changes_b FROM items a JOIN items b ON a.s = b.s AND a.file_path < b.file_path
  JOIN often oa ON oa.file_path = a.file_path JOIN often ob ON ob.file_path = b.file_path GROUP BY ALL HAVING count(*) >= 3)"""


def _means(name: str, where: str = "true", order: str = "d") -> str:
    """A table of (c, m): numbers and mean positions of the domains."""
    return f"""{name} AS (SELECT (row_number() OVER (ORDER BY {order}) - 1)::INTEGER AS c, m FROM (
  SELECT d, list(x ORDER BY i) AS m FROM (SELECT d, i, avg(x) AS x FROM (SELECT dominant_domain AS d, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM points WHERE {where}) GROUP BY d, i) GROUP BY d))"""


def oracle_sql() -> dict[str, str]:
    p, c = f"WITH {POINTS}", f"WITH {CONTRACTS}"
    d, h = f"{p}, {DELTAS}", f"{p}, {COMMITS}, {TEMPORAL}"
    t = f"{c}, {DELTAS}, {TENSIONS}"
    f = f"WITH {FILES}"
    axis = "1 - list_cosine_similarity(q.structural, r.structural)"
    names = lexical.VOCABULARY + lexical.BIGRAM_VOCABULARY
    w3, w1 = _wave("3, 7, 12"), _wave("7")
    out = {
        "get_position": f"{p} SELECT id, file_path, dominant_domain, content_hash, round(list_sum(lexical), 6) AS lexical_sum, round(list_sum(structural), 6) AS structural_sum, round(list_sum(semantic), 6) AS semantic_sum FROM points WHERE id = 7",
        "find_similar": f"{p} {_find('1 - list_cosine_similarity(q.p, r.p)')}",
        "find_similar_axis": f"{p} {_find(axis)}",
        "find_similar_euclidean": f"{p} {_find('list_distance(q.p, r.p)')}",
        "search_by_domain": f"{p} SELECT id, file_path, line_count FROM points WHERE dominant_domain = 'api' ORDER BY created DESC, file_path LIMIT 10",
        "list_code_points": f"{p} SELECT id, file_path, dominant_domain, line_count FROM points ORDER BY created DESC, file_path LIMIT 50 OFFSET 25",
        "find_by_criteria": f"{p} SELECT id, file_path, dominant_domain, line_count FROM points WHERE dominant_domain = 'db' AND line_count BETWEEN 100 AND 800 ORDER BY line_count DESC, file_path LIMIT 20",
        "find_by_criteria_similar": f"{p}, q AS (SELECT q.id, q.file_path, q.dominant_domain, q.line_count, CASE WHEN q.id <> 7 THEN 1 - list_cosine_similarity(q.p, r.p) END AS x FROM points q, points r WHERE r.id = 7 AND q.line_count >= 100) SELECT id, file_path, dominant_domain, line_count, round(x, 6) AS distance FROM q ORDER BY x NULLS LAST, file_path LIMIT 20",
        "compare": f"""{p}, x AS (SELECT a.file_path AS file_a, b.file_path AS file_b, list_cosine_similarity(a.p, b.p) AS s, 1 - list_cosine_similarity(a.lexical, b.lexical) AS l, 1 - list_cosine_similarity(a.structural, b.structural) AS t, 1 - list_cosine_similarity(a.semantic, b.semantic) AS m FROM points a, points b WHERE a.id = 7 AND b.id = 12)
SELECT file_a, file_b, round(1 - s, 6) AS total_distance, round(s, 6) AS similarity, round(l, 6) AS lexical_distance, round(t, 6) AS structural_distance, round(m, 6) AS semantic_distance,
  ['lexical', 'structural', 'semantic'][list_position([l, t, m], list_max([l, t, m]))] AS most_different_axis, ['lexical', 'structural', 'semantic'][list_position([l, t, m], list_min([l, t, m]))] AS most_similar_axis,
  concat_ws('; ', {INSIGHTS}) AS insights FROM x""",
        "get_stats": f"{p} SELECT dominant_domain, count(*) AS files, sum(line_count)::BIGINT AS lines, (SELECT count(*) FROM points) AS total_files, (SELECT sum(line_count)::BIGINT FROM points) AS total_lines FROM points GROUP BY dominant_domain",
        "export_positions": f"{p} SELECT id, regexp_extract(file_path, '[^/]+$') AS name, file_path AS path, dominant_domain AS domain, line_count AS lines, round(list_avg(lexical), 6) AS lexical_mean, round(list_avg(structural), 6) AS structural_mean, round(list_avg(semantic), 6) AS semantic_mean FROM points",
        "code_tokens": f"{f}, w AS (SELECT file_path, {TOKENS} AS t FROM files) SELECT file_path, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5, md5(array_to_string({BIGRAMS}, ' ')) AS bigrams_md5 FROM w",
        "lexical_features": f"{f}, {_lexical()} SELECT file_path, " + ", ".join(f"round(v[{i + 1}], 6) AS f{i:02d}_{n}" for i, n in enumerate(names)) + " FROM lex",
        "structural_features": f"{f}, {_structural()} SELECT file_path, " + ", ".join(f"round(v[{i + 1}], 6) AS {n}" for i, n in enumerate(structural.NAMES)) + " FROM struct",
        "semantic_features": f"{f}, {_semantic()} SELECT file_path, " + ", ".join(f"round(v[{i + 1}], 6) AS {n}" for i, n in enumerate(semantic.DOMAINS)) + ", dominant_domain FROM sem",
        "build_vocabulary": "WITH t AS (SELECT unnest(list_filter(string_split_regex(lower(replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '[^\\pL\\pN]+'), lambda x: regexp_full_match(x, '[a-z]{2,}'))) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 65",
        "top_terms": f"{f}, {_lexical()}, x AS (SELECT file_path, unnest([{', '.join(repr(n) for n in lexical.VOCABULARY[:50])}]) AS term, unnest(v[1:50]) AS s FROM lex), u AS (SELECT file_path, term, max(s) AS s FROM x GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY s DESC, term) AS r FROM u) SELECT file_path, r::INTEGER AS place, term, round(s, 6) AS score FROM k WHERE r <= 5",
        "index_files": f"{f}, {_semantic()} SELECT substr(md5(f.file_path), 1, 12) AS id, f.file_path, substr(sha256(content), 1, 16) AS content_hash, len(string_split(content, chr(10)))::INTEGER AS line_count, dominant_domain FROM files f JOIN sem s ON s.file_path = f.file_path",
        "reindex_deltas": f"{f}, {_versions()} SELECT id, file_path, batch::BIGINT AS version, round(m, 6) AS movement_magnitude, round(lc, 6) AS lexical_change, round(sc, 6) AS structural_change, round(mc, 6) AS semantic_change, dominant_change FROM moves",
        "reindex_points": f"""{f}, {_versions()}, last AS (SELECT file_path, count(*) AS n, arg_max(threshold, batch) AS threshold FROM limits GROUP BY file_path)
SELECT substr(md5(p.file_path), 1, 12) AS id, p.file_path, substr(sha256(content), 1, 16) AS content_hash, len(string_split(content, chr(10)))::INTEGER AS line_count, 0::BIGINT AS created, updated::BIGINT AS updated, coalesce(n, 0)::INTEGER AS samples, round(coalesce(threshold, 0.15::DOUBLE), 6) AS threshold FROM p{fixtures.VERSIONS} p LEFT JOIN last ON last.file_path = p.file_path WHERE k % 10 <> 9""",
        "reindex_tensions": f"""{f}, {_versions()} SELECT n.id AS contract_id, m.id AS delta_id, caller AS caller_path, callee AS callee_path, round(base, 6) AS baseline_distance, round(cur, 6) AS current_distance, round(size, 6) AS tension_magnitude, round(pc, 6) AS tension_percent,
  CASE WHEN pc > 0.25 THEN 'high' WHEN pc > 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS severity, 'detected' AS status, 'Review ' || regexp_extract(caller, '[^/]+$') || ' after ' || regexp_extract(callee, '[^/]+$') || ': '
  || CASE dominant_change WHEN 'structural' THEN 'its structure changed; compare signatures and exports' WHEN 'semantic' THEN 'its purpose changed; see whether it still fits its role' ELSE 'its terms changed; compare names' END || ' (+' || format('{{:.0f}}%', pc * 100) || ')' AS suggested_action
FROM now n JOIN moves m ON m.file_path = n.callee AND m.batch = n.batch JOIN limits t ON t.file_path = n.callee AND t.batch = n.batch WHERE pc >= t.threshold""",
        "upsert_contracts": f"""{c}, again AS (SELECT id, caller_id, callee_id, baseline_distance + 1 AS b FROM contracts WHERE caller_id % 3 = 0)
SELECT id, caller_id, callee_id, round(baseline_distance, 6) AS baseline_distance, false AS is_new FROM contracts WHERE caller_id % 3 <> 0 UNION ALL SELECT id, caller_id, callee_id, round(b, 6), false FROM again
UNION ALL SELECT id || '+', caller_id + 1000000, callee_id, round(b, 6), true FROM again WHERE callee_id % 2 = 0""",
        "prune_points": f"{c}, k AS (SELECT * FROM points WHERE id % 10 <> 9), inc AS (SELECT callee_id AS id, count(*) AS n FROM contracts WHERE caller_id % 10 <> 9 AND callee_id % 10 <> 9 GROUP BY callee_id) SELECT dominant_domain, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS contracts FROM k LEFT JOIN inc ON inc.id = k.id GROUP BY dominant_domain",
        "file_imports": f"{f}, {_imports()} SELECT file_path, target FROM imports",
        "resolve_imports": f"{f}, {_imports()} SELECT caller, target, callee FROM resolved",
        "detect_contracts": f"""{f}, {_imports()}, {_lexical()}, {_structural()}, {_semantic()}, pos AS (SELECT l.file_path, substr(md5(l.file_path), 1, 12) AS id, l.v || s.v || m.v AS p FROM lex l JOIN struct s ON s.file_path = l.file_path JOIN sem m ON m.file_path = l.file_path)
SELECT substr(md5(a.id || ':' || b.id), 1, 12) AS id, a.id AS caller_id, b.id AS callee_id, 'import' AS contract_type, round(list_distance(a.p, b.p), 6) AS baseline_distance FROM (SELECT DISTINCT caller, callee FROM resolved WHERE caller <> callee) r JOIN pos a ON a.file_path = r.caller JOIN pos b ON b.file_path = r.callee""",
        "extract_snippets": f"{f}, {_snippets()}",
        "suggest_fix": f"""{c}, {DELTAS}, last AS (SELECT * FROM deltas WHERE code_point_id = 7 ORDER BY created_at DESC, id::VARCHAR DESC LIMIT 1)
SELECT caller_path, callee_path, round(baseline_distance, 6) AS baseline_distance, dominant_change AS change_type, CASE WHEN movement_magnitude > 1 THEN 'high' WHEN movement_magnitude > 0.5 THEN 'medium' ELSE 'low' END AS severity, 1::INTEGER AS caller_imports, 1::INTEGER AS callee_functions FROM contracts LEFT JOIN last ON true WHERE callee_id = 7""",
        "get_contracts": f"{c} SELECT id, caller_path, callee_path, contract_type, round(baseline_distance, 6) AS baseline_distance FROM contracts WHERE caller_id = 7 OR callee_id = 7",
        "get_contract_stats": f"{c} SELECT contract_type, count(*) AS contracts, round(avg(baseline_distance), 6) AS avg_baseline, round(min(baseline_distance), 6) AS min_baseline, round(max(baseline_distance), 6) AS max_baseline FROM contracts GROUP BY contract_type",
        "analyze_impact": f"{c} SELECT caller_path, round(baseline_distance, 6) AS baseline_distance, round(1 - list_cosine_similarity(pa, pb), 6) AS current_distance, round(1 - list_cosine_similarity(pa, pb) - baseline_distance, 6) AS distance_delta FROM contracts WHERE callee_id = 7",
        "get_deltas": f"{d} SELECT d.id, file_path, round(movement_magnitude, 6) AS movement_magnitude, dominant_change FROM deltas d JOIN points p ON p.id = d.code_point_id ORDER BY d.created_at DESC, d.id DESC LIMIT 20",
        "deltas_for_file": f"{d} SELECT d.id, file_path, round(movement_magnitude, 6) AS movement_magnitude, dominant_change FROM deltas d JOIN points p ON p.id = d.code_point_id WHERE d.code_point_id = 7 ORDER BY d.created_at DESC, d.id DESC LIMIT 10",
        "significant_deltas": f"{d} SELECT d.id, file_path, round(movement_magnitude, 6) AS movement_magnitude FROM deltas d JOIN points p ON p.id = d.code_point_id WHERE movement_magnitude > 0.1::DOUBLE ORDER BY d.movement_magnitude DESC, d.id DESC LIMIT 50",
        "adaptive_thresholds": f"{d}, r AS (SELECT *, row_number() OVER (PARTITION BY code_point_id ORDER BY created_at DESC, id DESC) AS r FROM deltas) SELECT code_point_id, count(*) AS samples, round(CASE WHEN count(*) < 3 THEN 0.15::DOUBLE ELSE greatest(0.05::DOUBLE, least(0.5::DOUBLE, avg(movement_magnitude) + 2 * coalesce(stddev_samp(movement_magnitude), 0))) END, 6) AS threshold FROM r WHERE r <= 20 GROUP BY code_point_id",
        "detect_tensions": f"""{c}, {DELTAS}, r AS (SELECT *, row_number() OVER (PARTITION BY code_point_id ORDER BY created_at DESC, id::VARCHAR DESC) AS r FROM deltas),
th AS (SELECT code_point_id, CASE WHEN count(*) < 3 THEN 0.15::DOUBLE ELSE greatest(0.05::DOUBLE, least(0.5::DOUBLE, avg(movement_magnitude) + 2 * coalesce(stddev_samp(movement_magnitude), 0))) END AS threshold FROM r WHERE r <= 20 GROUP BY code_point_id),
x AS (SELECT c.id AS contract_id, d.id::VARCHAR AS delta_id, 1 - list_cosine_similarity(c.pa, c.pb) AS cur, c.baseline_distance AS b, th.threshold FROM contracts c JOIN deltas d ON d.code_point_id = c.callee_id JOIN th ON th.code_point_id = c.callee_id),
y AS (SELECT *, abs(cur - b) AS m, CASE WHEN b > 0 THEN abs(cur - b) / b ELSE abs(cur - b) END AS pc FROM x)
SELECT substr(md5(contract_id || ':' || delta_id), 1, 12) AS id, contract_id, delta_id, round(cur, 6) AS current_distance, round(m, 6) AS tension_magnitude, round(pc, 6) AS tension_percent, CASE WHEN pc > 0.25 THEN 'high' WHEN pc > 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS severity, 'detected' AS status FROM y WHERE pc >= threshold""",
        "get_tensions": f"{t} SELECT id, caller_path, callee_path, round(tension_magnitude, 6) AS tension_magnitude, round(baseline_distance + tension_magnitude, 6) AS current_distance, round(tension_magnitude / baseline_distance, 6) AS tension_percent FROM tensions t WHERE status = 'detected' ORDER BY t.tension_magnitude DESC, id DESC LIMIT 50",
        "latest_tensions": f"{t} SELECT id, caller_path, callee_path, round(tension_magnitude, 6) AS tension_magnitude, status FROM tensions ORDER BY created_at DESC, id DESC LIMIT 50",
        "tension_stats": f"{t} SELECT status, count(*) AS tensions, (SELECT round(coalesce(avg(tension_magnitude), 0), 6) FROM tensions WHERE status = 'detected') AS avg_detected, (SELECT round(coalesce(max(tension_magnitude), 0), 6) FROM tensions WHERE status = 'detected') AS max_detected FROM tensions GROUP BY status",
        "resolve_tension": f"{t}, u AS (SELECT CASE WHEN id = (SELECT min(id) FROM tensions) THEN 'resolved' ELSE status END AS status FROM tensions) SELECT status, count(*) AS tensions, count(*) FILTER (WHERE status = 'resolved') AS resolved FROM u GROUP BY status",
        "change_analysis": f"""{d}, x AS (SELECT *, CASE WHEN movement_magnitude > 1 THEN 'high' WHEN movement_magnitude > 0.5 THEN 'medium' ELSE 'low' END AS severity, dominant_change || ': 0.60 of the movement' AS causes,
  CASE dominant_change WHEN 'lexical' THEN '{_q(changes.LOOK["lexical"])}' WHEN 'structural' THEN '{_q(changes.LOOK["structural"])}' ELSE '{_q(changes.LOOK["semantic"])}' END AS looks FROM deltas)
SELECT dominant_change AS change_type, severity, count(*) AS deltas, min(causes) AS first_likely_causes, max(causes) AS last_likely_causes, min(looks) AS first_suggested_actions, max(looks) AS last_suggested_actions, '' AS first_warnings, '' AS last_warnings FROM x GROUP BY ALL""",
        "temporal_features": f"{h} SELECT file_path, round(file_age, 6) AS file_age, round(change_frequency, 6) AS change_frequency, round(author_diversity, 6) AS author_diversity, round(days_since_change, 6) AS days_since_change, round(stability_score, 6) AS stability_score FROM temporal",
        "get_temporal": f"{h} SELECT file_path, greatest((change_frequency > 0.5)::INTEGER + (days_since_change < 0.2::DOUBLE)::INTEGER + (author_diversity > 0.5)::INTEGER + (stability_score > 0.8::DOUBLE)::INTEGER, 1)::INTEGER AS notes FROM temporal",
        "hot_files": f"{h} SELECT file_path, round(change_frequency, 6) AS change_frequency FROM temporal WHERE change_frequency >= 0.5",
        "stale_files": f"{h} SELECT file_path, round(days_since_change, 6) AS days_since_change FROM temporal WHERE days_since_change <= 0.2::DOUBLE",
        "graph_degrees": f"{c}, {DEGREES} SELECT id, in_degree, out_degree FROM deg",
        "graph_pagerank": f"WITH RECURSIVE {CONTRACTS}, {PAGERANK} SELECT id, round(pagerank, 6) AS pagerank FROM ranks",
        "graph_hits": f"WITH RECURSIVE {CONTRACTS}, {HITS} SELECT id, round(hub_score, 6) AS hub_score, round(authority_score, 6) AS authority_score FROM scores",
        "graph_betweenness": f"{c}, {_paths()} SELECT id, round(betweenness, 6) AS betweenness FROM btw",
        "graph_top": f"""WITH RECURSIVE {CONTRACTS}, {PAGERANK}, {HITS}, {_paths()}, long AS (SELECT 'pagerank' AS metric, id, pagerank AS score FROM ranks UNION ALL SELECT 'hub_score', id, hub_score FROM scores UNION ALL SELECT 'authority_score', id, authority_score FROM scores UNION ALL SELECT 'betweenness', id, betweenness FROM btw),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, id) AS rank FROM long) SELECT metric, rank::INTEGER AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 10""",
        "analyze_graph": f"{c}, k AS (SELECT (SELECT count(*) FROM points) AS n_nodes, (SELECT count(*) FROM contracts) AS n_edges) SELECT n_nodes, n_edges, round(n_edges / n_nodes::DOUBLE, 6) AS avg_degree, round(n_edges / (n_nodes * (n_nodes - 1))::DOUBLE, 6) AS density FROM k",
        "simulate_wave": f"{c}, {w1} SELECT id, distance::INTEGER AS distance, round(i, 6) AS wave_intensity, (distance + 1)::INTEGER AS hops, is_boundary, domain, (row_number() OVER (PARTITION BY source ORDER BY i DESC, distance, id))::INTEGER AS priority FROM wave",
        "multi_wave": f"{c}, {w3} SELECT id, round(max(i), 6) AS max_intensity, min(distance)::INTEGER AS min_distance, count(DISTINCT source) AS n_waves FROM wave GROUP BY id",
        "predict_impact": f"""{c}, {w3}, a AS (SELECT source, count(*) AS total_affected, count(*) FILTER (WHERE i > 0.5) AS high_impact_files, count(*) FILTER (WHERE i > 0.2::DOUBLE AND i <= 0.5) AS medium_impact_files, max(distance)::INTEGER AS max_depth, count(*) FILTER (WHERE is_boundary) AS boundaries FROM wave GROUP BY source),
r AS (SELECT *, CASE WHEN high_impact_files > 5 OR total_affected > 10 THEN 'high' WHEN high_impact_files > 2 OR total_affected > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM a)
SELECT *, CASE risk_level WHEN 'high' THEN 'Split the change into smaller ones' WHEN 'medium' THEN 'Ask for another review of the files it reaches' ELSE 'The usual review will do' END AS recommendation FROM r""",
        "detect_smells": f"WITH RECURSIVE {CONTRACTS}, {COMMITS}, {TEMPORAL}, {DEGREES}, {PAGERANK}, {SMELLS} SELECT * FROM smells",
        "smell_summary": f"WITH RECURSIVE {CONTRACTS}, {COMMITS}, {TEMPORAL}, {DEGREES}, {PAGERANK}, {SMELLS} SELECT smell_type, severity, count(*) AS smells FROM smells GROUP BY ALL",
        "clone_fingerprints": f"{f}, {_clones()} SELECT file_path, len(f)::BIGINT AS n, list_sum(f)::BIGINT AS fp_sum FROM fps WHERE len(f) > 0",
        "detect_clones": f"{f}, {_clones()} SELECT CASE WHEN s > 0.95::DOUBLE THEN 'exact' WHEN s > 0.7::DOUBLE THEN 'parameterized' ELSE 'near-miss' END AS clone_type, count(*) AS clones, round(avg(s), 6) AS similarity, sum(shared)::BIGINT AS shared FROM found GROUP BY ALL",
        "clones_for_file": f"{f}, {_clones()} SELECT file_a, file_b, round(s, 6) AS similarity, CASE WHEN s > 0.95::DOUBLE THEN 'exact' WHEN s > 0.7::DOUBLE THEN 'parameterized' ELSE 'near-miss' END AS clone_type, shared::INTEGER AS shared_fingerprints, na::INTEGER AS total_fingerprints_a, nb::INTEGER AS total_fingerprints_b FROM found WHERE file_a = '/src/auth/f0.py' OR file_b = '/src/auth/f0.py'",
        "clone_pairs_top": f"{f}, {_clones()} SELECT file_a, file_b, round(s, 6) AS similarity, CASE WHEN s > 0.95::DOUBLE THEN 'exact' WHEN s > 0.7::DOUBLE THEN 'parameterized' ELSE 'near-miss' END AS clone_type, shared::INTEGER AS shared_fingerprints, na::INTEGER AS total_fingerprints_a, nb::INTEGER AS total_fingerprints_b FROM found ORDER BY s DESC, file_a, file_b LIMIT 50",
        "clone_counts": f"{f}, {_clones()} SELECT f AS file_path, count(*) AS clones FROM (SELECT file_a AS f FROM found UNION ALL SELECT file_b FROM found) GROUP BY f",
        "semantic_drift": f"{c}, {COMMITS}, {TEMPORAL}, {DRIFTS} SELECT {_DRIFT_COLUMNS} FROM semantic",
        "contract_drift": f"{c}, {COMMITS}, {TEMPORAL}, {DRIFTS} SELECT {_DRIFT_COLUMNS} FROM contract",
        "temporal_drift": f"{c}, {COMMITS}, {TEMPORAL}, {DRIFTS} SELECT {_DRIFT_COLUMNS} FROM temp",
        "detect_drift": f"{c}, {COMMITS}, {TEMPORAL}, {DRIFTS} SELECT drift_type, severity, count(*) AS drifts FROM (SELECT * FROM semantic UNION ALL SELECT * FROM contract UNION ALL SELECT * FROM temp) GROUP BY ALL",
        "get_debt": f"{_debt()} SELECT file_path, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("complexity", "size", "coupling", "duplication", "staleness", "documentation", "smells", "tensions", "score")) + ", grade, recommendations FROM debts",
        "debt_summary": f"{_debt()} SELECT count(*) AS total_files, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score, " + ", ".join(f"count(*) FILTER (WHERE grade = '{g}') AS grade_{g.lower()}" for g in "ABCDF") + ", CASE WHEN avg(score) <= 20 THEN 'A' WHEN avg(score) <= 40 THEN 'B' WHEN avg(score) <= 60 THEN 'C' WHEN avg(score) <= 80 THEN 'D' ELSE 'F' END AS grade FROM debts",
        "analyze_surface": f"{f}, {_surface()} SELECT file_path, md5(array_to_string(x, ',')) AS exports_md5, e AS export_count, i AS import_count, by_ AS imported_by, round(area, 6) AS surface_area, e > 0 AS is_public, risk AS stability_risk FROM srf",
        "debt_of_file": f"{_debt()}, {ADVICE} SELECT file_path, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("complexity", "size", "coupling", "duplication", "staleness", "documentation", "smells", "tensions", "score")) + ", grade, advice AS recommendations FROM advised WHERE file_path = '/src/auth/f10.ts'",
        "debt_top": f"{_debt()}, {ADVICE} SELECT file_path, round(score, 6) AS score, grade, advice AS recommendations FROM advised ORDER BY advised.score DESC, file_path LIMIT 10",
        "surface_of_module": f"{f}, {_surface()} SELECT file_path, regexp_extract(file_path, '[^/]+$') AS file_name, e AS export_count, i AS import_count, round(area, 6) AS surface_area, e > 0 AS is_public, risk AS stability_risk FROM srf WHERE file_path LIKE '%f7.go' ORDER BY file_path LIMIT 1",
        "surface_top": f"{f}, {_surface()} SELECT file_path, e AS export_count, i AS import_count, round(area, 6) AS surface_area, risk AS stability_risk FROM srf ORDER BY area DESC, file_path LIMIT 10",
        "drift_top": f"{c}, {COMMITS}, {TEMPORAL}, {DRIFTS}, every AS (SELECT * FROM semantic UNION ALL SELECT * FROM contract UNION ALL SELECT * FROM temp) SELECT {_DRIFT_COLUMNS} FROM every ORDER BY {RANK}, drift_type, file_a, file_b LIMIT 30",
        "impact_review": f"{c}, {w3}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i DESC, distance, id)::INTEGER AS priority FROM wave) SELECT source, priority, id, distance::INTEGER AS distance, round(i, 6) AS wave_intensity FROM r WHERE priority <= 10",
        "select_smells": f"WITH RECURSIVE {CONTRACTS}, {COMMITS}, {TEMPORAL}, {DEGREES}, {PAGERANK}, {SMELLS} SELECT * FROM smells WHERE severity IN ('critical', 'high') ORDER BY {RANK}, smell_type, file_path, file_name LIMIT 50",
        "cluster_turn": f"""{p}, {_means('means')}, x AS (SELECT id, c, list_distance(p, m) AS d FROM points, means),
n AS (SELECT k, id, arg_min(c, (d, c)) AS cluster, min(d) AS d FROM x, range(2, 6) r(k) WHERE c < k GROUP BY k, id) SELECT k::INTEGER AS k, cluster, count(*) AS size, round(sum(d * d), 6) AS inertia FROM n GROUP BY k, cluster""",
        "cluster_nearest": f"{p}, {_means('means')} SELECT file_path, dominant_domain, arg_min(c, (list_distance(p, m), c)) AS cluster, round(min(list_distance(p, m)), 6) AS distance FROM points, means GROUP BY ALL",
        "cluster_drift": f"""{p.replace('WITH', 'WITH RECURSIVE', 1)}, {_means('ma', 'id % 2 = 0')}, {_means('mb', 'id % 2 = 1', 'd DESC')},
a AS (SELECT id, arg_min(c, (list_distance(p, m), c)) AS was FROM points, ma GROUP BY id), b AS (SELECT id, arg_min(c, (list_distance(p, m), c)) AS now FROM points, mb GROUP BY id),
o AS (SELECT was, now, count(*) AS n FROM a JOIN b USING (id) GROUP BY ALL),
way AS (SELECT 0 AS k, []::INTEGER[] AS cols, 0::BIGINT AS n UNION ALL SELECT k + 1, list_append(cols, j::INTEGER), w.n + coalesce(o.n, 0) FROM way w JOIN range(0, 5) r(j) ON NOT list_contains(cols, j::INTEGER) LEFT JOIN o ON o.was = w.k AND o.now = j WHERE k < 5),
best AS (SELECT cols FROM way WHERE k = 5 ORDER BY n DESC, cols LIMIT 1)
SELECT id, was, now, cols[was + 1] AS expected, cols[was + 1] <> now AS drifted FROM a JOIN b USING (id), best""",
        "history_followed": """WITH RECURSIVE e AS (SELECT event_id::BIGINT AS seq, user_id::BIGINT AS u FROM events),
ch AS (SELECT seq, CASE WHEN seq % 11 = 0 THEN '/h/f' || u % 197 END AS old_path, '/h/f' || (CASE WHEN seq % 11 = 0 THEN (u * 7 + seq) % 197 ELSE u % 197 END) AS file_path FROM e),
r AS (SELECT old_path AS o, seq AS s, file_path AS n, coalesce(lag(seq) OVER (PARTITION BY old_path ORDER BY seq), -1) AS since FROM ch WHERE old_path <> file_path),
walk AS (SELECT seq, file_path, file_path AS here, seq AS t FROM ch UNION ALL SELECT w.seq, w.file_path, r.n, r.s FROM walk w JOIN r ON r.o = w.here AND w.t >= r.since AND w.t < r.s)
SELECT seq, file_path, arg_max(here, t) AS now_path FROM walk GROUP BY seq, file_path""",
        "temporal_notes": f"{h} SELECT file_path, coalesce(nullif(concat_ws('; ', {HISTORY}), ''), 'no limit passed') AS notes FROM temporal",
        "cochange_pairs": f"{p}, {COMMITS}, {COCHANGE} SELECT file_a, file_b, together, changes_a, changes_b, round(together / least(changes_a, changes_b)::DOUBLE, 6) AS confidence FROM cochanged",
        "shotgun_surgery": f"""{p}, {COMMITS}, {COCHANGE}, ends AS (SELECT file_a AS file_path, together, together / changes_a::DOUBLE AS share FROM cochanged UNION ALL SELECT file_b, together, together / changes_b::DOUBLE FROM cochanged),
g AS (SELECT file_path, count(*) AS partners, sum(together)::BIGINT AS together FROM ends WHERE share >= 0.4::DOUBLE GROUP BY file_path HAVING count(*) >= 3)
SELECT 'shotgun_surgery' AS smell_type, CASE WHEN partners >= 12 THEN 'critical' WHEN partners >= 6 THEN 'high' ELSE 'medium' END AS severity, file_path, partners, together FROM g""",
        "surface_summary": f"{f}, {_surface()} SELECT count(*) AS total_modules, count(*) FILTER (WHERE e > 0) AS public_modules, count(*) FILTER (WHERE e = 0) AS private_modules, sum(e)::BIGINT AS total_exports, round(sum(e) / count(*)::DOUBLE, 1) AS avg_exports, count(*) FILTER (WHERE risk = 'high') AS high_risk_modules FROM srf",
        "generate_matrix": f"""{c}, x AS (SELECT a.id AS i, b.id AS j, a.file_path AS row_path, b.file_path AS col_path, 1 - list_cosine_similarity(a.p, b.p) AS d FROM points a, points b)
SELECT row_path, col_path, round(CASE WHEN i = j THEN 0 WHEN f.id IS NOT NULL THEN f.baseline_distance WHEN g.id IS NOT NULL THEN 0 ELSE d END, 6) AS value, f.id IS NOT NULL AS is_dependency, f.id IS NOT NULL AND g.id IS NOT NULL AS is_bidirectional
FROM x LEFT JOIN contracts f ON f.caller_id = i AND f.callee_id = j LEFT JOIN contracts g ON g.caller_id = j AND g.callee_id = i""",
        "matrix_summary": f"{c} SELECT (SELECT count(*) FROM points) AS files, count(*) AS dependencies, ((SELECT count(*) FROM contracts a JOIN contracts b ON a.caller_id = b.callee_id AND a.callee_id = b.caller_id) // 2)::BIGINT AS bidirectional FROM contracts",
        "generate_heatmap": f"""{t}, {TENSE}, ch AS (SELECT code_point_id AS id, count(*) AS n FROM deltas GROUP BY code_point_id),
x AS (SELECT p.*, coalesce(ch.n, 0) AS cc, coalesce(te.n, 0) AS tc, (structural[7] + structural[11]) / 2 AS cx FROM points p LEFT JOIN ch ON ch.id = p.id LEFT JOIN tense te ON te.id = p.id)
SELECT file_path, regexp_extract(file_path, '[^/]+$') AS file_name, round(cc / greatest(max(cc) OVER (), 1)::DOUBLE * 0.5 + tc / greatest(max(tc) OVER (), 1)::DOUBLE * 0.5, 6) AS activity_score, cc AS change_count, tc AS tension_count, round(cx, 6) AS complexity_score, round((cx + coalesce(structural[16], 0) + least(line_count / 500.0::DOUBLE, 1)) / 3, 6) AS debt_score, dominant_domain AS domain FROM x""",
        "generate_architecture": f"{c}, {DEGREES} SELECT p.id, p.file_path, p.dominant_domain AS domain, p.line_count AS lines, in_degree, out_degree, round(out_degree / greatest(max(out_degree) OVER (), 1)::DOUBLE, 6) AS hub_score, round(in_degree / greatest(max(in_degree) OVER (), 1)::DOUBLE, 6) AS authority_score, round((out_degree / greatest(max(out_degree) OVER (), 1)::DOUBLE + in_degree / greatest(max(in_degree) OVER (), 1)::DOUBLE) / 2, 6) AS importance FROM points p JOIN deg d ON d.id = p.id",
        "architecture_summary": f"{c}, {DEGREES}, x AS (SELECT p.dominant_domain AS domain, out_degree / max(out_degree) OVER ()::DOUBLE AS h, in_degree / max(in_degree) OVER ()::DOUBLE AS a FROM points p JOIN deg d ON d.id = p.id) SELECT domain, count(*) AS files, count(*) FILTER (WHERE h > 0.5) AS hubs, count(*) FILTER (WHERE a > 0.5) AS authorities FROM x GROUP BY domain",
        "scatter_links": f"{t} SELECT caller_path, callee_path, round(baseline_distance, 6) AS baseline_distance, id IN (SELECT contract_id FROM tensions WHERE status = 'detected') AS is_tense FROM contracts",
        "generate_timeline": f"""{t}, {COMMITS}, a AS (SELECT 'delta' AS event_type, d.created_at AS ts, regexp_extract(p.file_path, '[^/]+$') || ' moved' AS title, p.file_path, CASE WHEN movement_magnitude > 0.5 THEN 'high' WHEN movement_magnitude > 0.2::DOUBLE THEN 'medium' ELSE 'low' END AS severity FROM (SELECT * FROM deltas ORDER BY created_at DESC, id DESC LIMIT 50) d JOIN points p ON p.id = d.code_point_id),
b AS (SELECT 'tension', created_at, regexp_extract(caller_path, '[^/]+$') || ' -> ' || regexp_extract(callee_path, '[^/]+$'), callee_path, CASE WHEN tension_magnitude / baseline_distance > 0.25 THEN 'high' WHEN tension_magnitude / baseline_distance > 0.15::DOUBLE THEN 'medium' ELSE 'low' END FROM tensions ORDER BY created_at DESC, id DESC LIMIT 30),
k AS (SELECT 'commit', ts, substr(hash, 1, 7), file_path, 'low' FROM commits ORDER BY ts DESC, hash DESC LIMIT 30),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM k)
SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, title, file_path, severity FROM u ORDER BY u.ts DESC, event_type, title LIMIT 100""",
    }
    out["export_csv"] = out["export_positions"]
    out["timeline_summary"] = f"SELECT event_type, severity, count(*) AS events FROM ({out['generate_timeline']}) GROUP BY ALL"
    out["heatmap_summary"] = f"SELECT count(*) AS files, count(*) FILTER (WHERE activity_score > 0.7::DOUBLE) AS hotspots, count(*) FILTER (WHERE debt_score > 0.6::DOUBLE) AS high_debt FROM ({out['generate_heatmap']})"
    return out
