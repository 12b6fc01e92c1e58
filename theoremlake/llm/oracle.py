"""SQL, for DuckDB, that gives what the pN_ queries give, by comparing all with all.

Problems without SQL: 1 (no function for entities and compatibility forms), 6 (byte pairs), 7 (any good packing will do),
8 (labels that spread); their tests compare with brute force or exact round trips."""

from __future__ import annotations

_CONTENT = """
content AS (
  SELECT decl_id, split, library, name,
         CASE WHEN regexp_full_match(coalesce(statement, ''), '[\\s\\p{Z}]*') THEN type_signature ELSE statement END AS c,
         NOT regexp_full_match(coalesce(statement, ''), '[\\s\\p{Z}]*') AS is_statement
  FROM declarations),
told AS (SELECT * FROM content WHERE NOT regexp_full_match(coalesce(c, ''), '[\\s\\p{Z}]*'))"""

_BOUND = r"""
flatten(list_transform(
    regexp_extract_all(c, '\(\s*([\p{L}\p{M}\p{N}_''\s]+?)\s*:([^:=>]|$)', 1)
    || regexp_extract_all(c, '(?:^|[^\p{L}\p{M}\p{N}_''])exists(?:[^\p{L}\p{M}\p{N}_''])\s*([\p{L}\p{M}\p{N}_''][\p{L}\p{M}\p{N}_''\s]*)', 1)
    || regexp_extract_all(c, '∃\s*([\p{L}\p{M}\p{N}_''][\p{L}\p{M}\p{N}_''\s]*)', 1)
    || regexp_extract_all(c, '(?:^|[^\p{L}\p{M}\p{N}_''])fun(?:[^\p{L}\p{M}\p{N}_''])\s*([\p{L}\p{M}\p{N}_''][\p{L}\p{M}\p{N}_''\s]*)', 1),
    lambda x: regexp_extract_all(x, '[\p{L}\p{M}\p{N}_'']+')))"""

_WORDS = r"regexp_extract_all(c, '[\p{L}\p{M}\p{N}_'']+')"

_P2 = f"""
WITH {_CONTENT},
sets AS (SELECT decl_id, list_distinct(list_transform({_WORDS}, lambda w: lower(w))) AS ws FROM told),
s AS (SELECT decl_id, ws, len(ws) AS n FROM sets WHERE len(ws) > 0),
pairs AS (
  SELECT a.decl_id AS left_id, b.decl_id AS right_id, a.n AS na, b.n AS nb, len(list_intersect(a.ws, b.ws)) AS common
  FROM s a JOIN s b ON a.decl_id < b.decl_id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n))
SELECT left_id, right_id FROM pairs WHERE common >= 0.7 * (na + nb - common) - 1e-9"""

_SIDES = f"""
WITH {_CONTENT},
sided AS (
  SELECT *, CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 0 WHEN lower(trim(split)) IN ('validation', 'valid', 'val', 'dev', 'development', 'test', 'testing') THEN 1 END AS side
  FROM told),
words AS (SELECT decl_id, side, {_BOUND} AS bound, CASE WHEN is_statement THEN {_WORDS}[3:] ELSE {_WORDS} END AS w FROM sided WHERE side IS NOT NULL),
sets AS (SELECT decl_id, side, list_distinct(list_transform(list_filter(w, lambda x: NOT list_contains(bound, x)), lambda x: lower(x))) AS ws FROM words),
s AS (SELECT decl_id, side, ws, len(ws) AS n FROM sets WHERE len(ws) > 0),
pairs AS (
  SELECT a.decl_id AS t, b.decl_id AS e, a.n AS na, b.n AS nb, len(list_intersect(a.ws, b.ws)) AS common
  FROM s a JOIN s b ON a.side = 0 AND b.side = 1 AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n)),
near AS (SELECT t, e FROM pairs WHERE common >= 0.7 * (na + nb - common) - 1e-9)"""

_P3 = f"{_SIDES} SELECT least(t, e) AS left_id, greatest(t, e) AS right_id FROM near"

_P3_REPORT = f"""{_SIDES},
kinds AS (
  SELECT decl_id, library, CASE WHEN lower(trim(split)) IN ('validation', 'valid', 'val', 'dev', 'development') THEN 'validation' WHEN lower(trim(split)) IN ('test', 'testing') THEN 'test' END AS split
  FROM declarations)
SELECT split, library, count(*) AS records, count(*) FILTER (decl_id IN (SELECT e FROM near)) AS overlapping
FROM kinds WHERE split IS NOT NULL GROUP BY split, library"""

_P4 = f"""
WITH RECURSIVE {_CONTENT},
parts AS (
  SELECT decl_id, unnest(list_transform(regexp_split_to_array(regexp_replace(regexp_extract(trim(name), '[^.]*$'), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '[_''\\d]+|\\s'), lambda x: lower(trim(x)))) AS part,
         generate_subscripts(regexp_split_to_array(regexp_replace(regexp_extract(trim(name), '[^.]*$'), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '[_''\\d]+|\\s'), 1) AS place
  FROM declarations),
entities AS (SELECT decl_id, arg_min(part, place) AS entity FROM parts WHERE part <> '' AND part NOT IN (SELECT lower(trim(word)) FROM relation_words WHERE word IS NOT NULL) GROUP BY decl_id),
plain AS (SELECT decl_id, is_statement, replace(replace(replace(replace(replace(c, '->', '→'), '/\\', '∧'), '<=', '≤'), '>=', '≥'), '<>', '≠') AS c FROM told),
tokens AS (SELECT decl_id, is_statement, {_BOUND} AS bound, regexp_extract_all(c, '[\\p{{L}}\\p{{M}}\\p{{N}}_'']+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}_'']') AS t FROM plain),
stopped AS (SELECT decl_id, is_statement, bound, CASE WHEN t[-1] = '.' THEN t[1:len(t) - 1] ELSE t END AS t FROM tokens),
placed AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: regexp_matches(t[i], '^[\\p{{L}}\\p{{M}}\\p{{N}}_'']')) AS spots FROM stopped),
headless AS (SELECT decl_id, bound, CASE WHEN is_statement AND len(spots) >= 2 THEN t[spots[2] + 1:len(t)] ELSE t END AS t, is_statement AND len(spots) >= 2 AS had FROM placed),
bare AS (SELECT decl_id, bound, CASE WHEN had AND t[1] = ':' AND coalesce(t[2], '') <> '=' THEN t[2:len(t)] ELSE t END AS t FROM headless),
sigs AS (
  SELECT decl_id, array_to_string(list_transform(t, lambda x: CASE WHEN list_contains(bound, x) THEN '#' || list_position(list_filter(t, lambda y: list_contains(bound, y)), x) WHEN x = 'forall' THEN '∀' WHEN x = 'exists' THEN '∃' ELSE x END), ' ') AS sig
  FROM bare),
nodes AS (
  SELECT decl_id, 'e' || entity AS node FROM entities
  UNION ALL SELECT decl_id, 's' || sig FROM sigs),
hops AS (SELECT DISTINCT a.node AS u, b.node AS v FROM nodes a JOIN nodes b USING (decl_id)),
reach AS (
  SELECT DISTINCT node AS u, node AS v FROM nodes
  UNION SELECT r.u, h.v FROM reach r JOIN hops h ON r.v = h.u),
roots AS (SELECT u AS node, min(v) AS root, min(CASE WHEN v[1] = 'e' THEN substr(v, 2) END) AS group_key FROM reach GROUP BY u),
grouped AS (SELECT DISTINCT decl_id, root, group_key FROM nodes JOIN roots USING (node))
SELECT decl_id, group_key FROM grouped WHERE root IN (SELECT root FROM grouped GROUP BY root HAVING count(*) > 1)"""

_P5 = """
WITH usable AS (
  SELECT point_id, list_transform(dense, lambda x: x::DOUBLE) AS v FROM index_points
  WHERE len(dense) = 64 AND len(list_filter(dense, lambda x: isfinite(x))) = 64 AND len(list_filter(dense, lambda x: x <> 0)) > 0),
ranked AS (
  SELECT a.point_id AS a, b.point_id AS b, row_number() OVER (PARTITION BY a.point_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.point_id) AS place
  FROM usable a JOIN usable b ON a.point_id <> b.point_id)
SELECT DISTINCT least(a, b) AS left_id, greatest(a, b) AS right_id FROM ranked WHERE place <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p3_found": _P3, "p3_report": _P3_REPORT, "p4_found": _P4, "p5_found": _P5}
