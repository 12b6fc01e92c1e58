"""DuckDB SQL that gives the results of the core queries by other means."""

from __future__ import annotations

from theoremlake.functions.text import NAME_STOP_WORDS, QUERY_STOP_WORDS, RELATION_WORDS
from theoremlake.operators.mining import PROOF_KINDS, TACTICS
from theoremlake.sources.parse import KINDS, MODIFIERS

_SPACE = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _ws(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_SPACE}', ' ', 'g'))"


_WORDS = "regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9]*')"
_PARTS = r"list_transform(regexp_extract_all(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+'), lambda p: lower(p))"


def _tokens(c: str) -> str:
    parts = _PARTS.format("w")
    return f"flatten(list_transform({_WORDS.format(c)}, lambda w: list_concat(list_filter([lower(w)], lambda x: length(x) >= 2), list_filter({parts}, lambda x: length(x) >= 2 AND x <> lower(w)))))"


def _hash(c: str, mod: int) -> str:
    return f"(('0x' || substr(sha256({c}), 1, 8))::BIGINT % {mod})"


_CHAPTER = r"regexp_extract(file_path, '(Ch\d{1,2})', 1)"
NORM = f"""norm AS (SELECT decl_id, coalesce(name, '') AS name, coalesce(kind, '') AS kind, {_ws('type_signature')} AS type_signature, {_ws('statement')} AS statement,
  {_ws('docstring')} AS docstring, {_ws('nl_description')} AS nl_description, coalesce(module_path, '') AS module_path, coalesce(nullif(library, ''), 'unknown') AS library,
  coalesce(file_path, '') AS file_path, coalesce(line_number, 0) AS line_number, coalesce(github_url, '') AS github_url,
  coalesce(nullif(chapter, ''), {_CHAPTER}, '') AS chapter FROM declarations)"""
_DENSE_TEXT = """concat_ws(' | ', nullif(nl_description, ''), kind || ' ' || name, nullif(type_signature, ''), nullif(docstring, ''), nullif(statement, ''), CASE WHEN module_path <> '' THEN 'module ' || module_path END, 'library ' || library)"""
_SPARSE_TEXT = "concat_ws(' ', nullif(name, ''), nullif(type_signature, ''), nullif(statement, ''), nullif(docstring, ''))"


def _split(c: str) -> str:
    return f"list_filter(string_split_regex(replace(lower(coalesce({c}, '')), '_', ' '), '{_SPACE}'), lambda x: x <> '')"


def _dense(k: int, where: str = "TRUE", name: str = "dense") -> str:
    """CTEs from norm to `name` (query_id, decl_id, score, rank)."""
    return f"""searches AS (SELECT query_id, query, gold, hint FROM nl_queries WHERE len({_split('query')}) > 0),
qb AS (SELECT query_id, {_hash('t', 384)} AS b, count(*) AS tf FROM (SELECT query_id, unnest({_split('query')}) AS t FROM searches) GROUP BY ALL),
db AS (SELECT decl_id, {_hash('t', 384)} AS b, count(*) AS tf FROM (SELECT decl_id, unnest({_split(_DENSE_TEXT)}) AS t FROM norm WHERE {where}) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS n FROM qb GROUP BY ALL), dn AS (SELECT decl_id, sqrt(sum(tf * tf)) AS n FROM db GROUP BY ALL),
dots AS (SELECT query_id, decl_id, sum(qb.tf * db.tf)::DOUBLE AS dot FROM qb JOIN db USING (b) GROUP BY ALL),
cosines AS (SELECT query_id, decl_id, round(dot / (qn.n * dn.n), 6) AS score FROM dots JOIN qn USING (query_id) JOIN dn USING (decl_id)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, decl_id) AS rank FROM cosines) WHERE rank <= {k})"""


def _sparse(k: int) -> str:
    return f"""sq AS (SELECT query_id, {_hash('t', 2147483648)} AS token_id, count(*) AS q_tf FROM (SELECT query_id, unnest({_tokens("coalesce(query, '')")}) AS t FROM nl_queries WHERE len({_split('query')}) > 0) GROUP BY ALL),
sd AS (SELECT decl_id, {_hash('t', 2147483648)} AS token_id, count(*) AS tf FROM (SELECT decl_id, unnest({_tokens(_SPARSE_TEXT)}) AS t FROM norm) GROUP BY ALL),
weights AS (SELECT token_id, ln(((SELECT count(*) FROM declarations)::DOUBLE - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1::DOUBLE) AS idf FROM sd GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, decl_id) AS rank FROM
  (SELECT query_id, decl_id, round(sum((q_tf * tf * idf)::DECIMAL(28, 12))::DOUBLE, 6) AS score FROM sq JOIN sd USING (token_id) JOIN weights USING (token_id) GROUP BY ALL)) WHERE rank <= {k})"""


def _doc_tokens() -> str:
    one = [f"flatten(list_transform({_WORDS.format(c)}, lambda w: list_concat([lower(w)], {_PARTS.format('w')})))" for c in ("name", "type_signature", "docstring", "statement")]
    return f"list_distinct(list_filter(flatten([{', '.join(one)}]), lambda x: length(x) >= 2))"


_TERMS = f"list_filter(list_transform({_WORDS.format('query')}, lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN {_list(QUERY_STOP_WORDS)})"
_LEXICAL = """coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN list_contains(toks, t) THEN 1::DOUBLE WHEN length(t) >= 5 AND
  len(list_filter(toks, lambda x: length(x) >= 5 AND (starts_with(x, t) OR starts_with(t, x)))) > 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END)), 0::DOUBLE)"""


def _features() -> str:
    var, head = r"\b[A-Z][0-9'']?\b", rf"^{_SPACE[:-1]}*\w+{_SPACE}\w+{_SPACE[:-1]}*:"
    toks, rel = _tokens("name"), _list(RELATION_WORDS)
    body = f"coalesce(nullif(statement, ''), nullif(type_signature, ''), nullif(name, ''), '')"
    ws = _ws(f"regexp_replace(regexp_replace({body}, '{head}', ''), '{var}', '_', 'g')")
    return f"""feat AS (SELECT decl_id AS seq, library, name, coalesce(list_filter({toks}, lambda t: t NOT IN {rel} AND t NOT IN {_list(NAME_STOP_WORDS)} AND NOT regexp_full_match(t, '[0-9]+'))[1], '') AS stem,
  list_sort(list_distinct(list_filter({toks}, lambda t: t IN {rel}))) AS relation, CASE WHEN lower({ws}) <> '' THEN library || '::' || lower({ws}) ELSE 'name::' || name END AS cluster,
  regexp_matches(lower(name), 'characterization|postulate') AS lookalike FROM norm)"""


_NEGATIVES = """cand AS (SELECT a.seq, c.name AS neg_name, c.seq AS c_seq, c.relation AS c_relation, a.relation AS a_relation, a.stem, c.lookalike, 0 AS g FROM feat a JOIN feat c ON a.library = c.library AND a.stem = c.stem AND a.stem <> ''
    AND a.cluster <> c.cluster AND a.name <> c.name
  UNION ALL SELECT a.seq, c.name, c.seq, c.relation, a.relation, a.stem, c.lookalike, 1 FROM feat a JOIN feat c ON a.library = c.library AND c.lookalike AND a.stem <> '' AND contains(lower(c.name), a.stem) AND a.cluster <> c.cluster AND a.name <> c.name),
onename AS (SELECT seq, neg_name, arg_min(g, g * 1000000000000 + c_seq) AS g, min(g * 1000000000000 + c_seq) AS place_at, arg_max(c_seq, g * 1000000000000 + c_seq) AS neg_id,
  any_value(CASE WHEN lookalike AND contains(lower(neg_name), stem) THEN 0 WHEN len(c_relation) > 0 AND c_relation <> a_relation THEN 1 WHEN len(c_relation) = 0 THEN 2 ELSE 3 END) AS class FROM cand GROUP BY seq, neg_name),
neg AS (SELECT * FROM (SELECT seq, neg_id, neg_name, class, row_number() OVER (PARTITION BY seq ORDER BY class, place_at, neg_name) AS place FROM onename) WHERE place <= 5)"""
_SIDES = f"""held AS (SELECT DISTINCT cluster FROM feat WHERE name IN (SELECT unnest(gold) FROM nl_queries)),
side AS (SELECT seq, cluster IN (SELECT cluster FROM held) OR {_hash('cluster', 1000)} < 100 AS is_test FROM feat)"""
_TRAIN = f"""same AS (SELECT n.* FROM neg n JOIN side a ON n.seq = a.seq JOIN side b ON n.neg_id = b.seq WHERE a.is_test = b.is_test),
train AS (SELECT norm.decl_id, side.is_test, CASE WHEN nl_description <> '' THEN nl_description WHEN made <> '' THEN made ELSE name END AS query, nl_description <> '' AS real_query, positive,
  coalesce(l.neg_names, []) AS neg_names, coalesce(l.neg_texts, []) AS neg_texts FROM (SELECT *, array_to_string(list_filter({_tokens('name')}, lambda t: NOT regexp_full_match(t, '[0-9]+')), ' ') AS made, {_DENSE_TEXT} AS positive FROM norm) norm
  JOIN side ON side.seq = norm.decl_id LEFT JOIN (SELECT same.seq, list(neg_name ORDER BY place) AS neg_names, list({_DENSE_TEXT.replace('name,', 'm.name,')} ORDER BY place) AS neg_texts FROM same JOIN norm m ON m.decl_id = same.neg_id GROUP BY same.seq) l ON l.seq = norm.decl_id)"""
_SIG = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[A-Za-z0-9_]+'))"
_ATTACH = f"""informal AS (SELECT query_id * 100 + pos - 1 AS seq, gold[pos] AS iname, query AS idesc, {_SIG.format('source_statement')} AS b FROM (SELECT *, unnest(range(1, len(gold) + 1)) AS pos FROM nl_queries)),
told AS (SELECT decl_id, trim(idesc) AS description, overlap FROM (SELECT *, row_number() OVER (PARTITION BY decl_id ORDER BY overlap DESC, seq) AS rn FROM (SELECT decl_id, seq, idesc,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS overlap
  FROM (SELECT decl_id, name, {_SIG.format("coalesce(nullif(statement, ''), type_signature)")} AS a FROM norm) JOIN informal ON iname = name)) WHERE rn = 1 AND trim(idesc) <> ''),
cands AS (SELECT norm.*, description FROM norm JOIN told USING (decl_id) WHERE (library, name) IN (SELECT (library, name) FROM norm GROUP BY library, name HAVING count(*) = 1) AND NOT contains(lower(description), lower(name)))"""
_RANKED = f"""ranked AS (SELECT query_id, rank, split_part(name, '.', -1) AS name FROM dense JOIN norm USING (decl_id)), gold AS (SELECT DISTINCT query_id, g AS name FROM (SELECT query_id, unnest(gold) AS g FROM searches) WHERE g IS NOT NULL),
hit AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM ranked r WHERE EXISTS (SELECT 1 FROM gold g WHERE g.query_id = r.query_id AND g.name = r.name)),
hq AS (SELECT query_id, min(rank) AS best_rank, count(DISTINCT name) FILTER (rank <= 5) AS h5, count(DISTINCT name) FILTER (rank <= 10) AS h10, coalesce(sum(nth::DOUBLE / rank) FILTER (rank <= 10), 0) AS sp FROM hit GROUP BY ALL),
per AS (SELECT query_id, n_gold, best_rank, coalesce(h5 / n_gold::DOUBLE, 0) AS recall5, coalesce(h10 / n_gold::DOUBLE, 0) AS recallk, CASE WHEN best_rank <= 10 THEN 1::DOUBLE / best_rank ELSE 0 END AS rrk, coalesce(1::DOUBLE / best_rank, 0) AS rr,
  coalesce(sp / least(n_gold, 10), 0) AS apk FROM (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY ALL) LEFT JOIN hq USING (query_id))"""


_LIMITED = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL),
r AS (
  SELECT user_id, n, event_id, true AS accepted, [ts] AS recent FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, n, event_id, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, ts) ELSE kept END
  FROM (SELECT e.user_id, e.n, e.event_id, e.ts, list_filter(r.recent, lambda t: e.ts - t <= INTERVAL 24 HOURS) AS kept FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.n = r.n + 1))
SELECT event_id, user_id, accepted FROM r"""


def _parsed() -> str:
    """CTEs of the parser: marks of comments and strings one after the other, all texts at once; then statements and their
    declarations. Texts of unknown kind count if they hold a declaration."""
    kinds = "|".join(sorted(KINDS, key=len, reverse=True))
    head = rf"(?s)^\s*(?:(?:{'|'.join(MODIFIERS)})\s+)*({kinds})\s+([A-Za-z_][A-Za-z0-9_'']*)\b(.*)\.\s*$"
    blank = lambda c: f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"
    return rf"""WITH RECURSIVE src AS (SELECT doc_id, doc_kind, text, coalesce(library, 'unknown') AS library, 'docs/d' || doc_id || '.v' AS file_path, source AS source_path FROM documents WHERE (doc_kind = 'source' OR doc_kind IS NULL) AND text IS NOT NULL),
pieces AS (SELECT doc_id, regexp_extract_all(text, '\(\*|\*\)|["\n.]|[^(*)"\n.]+|[(*)]') AS t FROM src),
toks AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM pieces),
marks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS m FROM toks WHERE tok IN ('(*', '*)', '"')),
state AS (
  SELECT doc_id, 0::BIGINT AS m, 0::BIGINT AS i, 0 AS depth, false AS str FROM pieces
  UNION ALL
  SELECT k.doc_id, k.m, k.i, s.depth + CASE WHEN NOT s.str AND k.tok = '(*' THEN 1 WHEN NOT s.str AND k.tok = '*)' AND s.depth > 0 THEN -1 ELSE 0 END, CASE WHEN k.tok = '"' AND s.depth = 0 THEN NOT s.str ELSE s.str END
  FROM state s JOIN marks k ON k.doc_id = s.doc_id AND k.m = s.m + 1),
placed AS (
  SELECT t.doc_id, t.i, t.tok, s.depth, s.str, s.i = t.i AS mark, 1 + coalesce(sum(CASE WHEN t.tok = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
  FROM toks t ASOF JOIN state s ON t.doc_id = s.doc_id AND t.i >= s.i),
flagged AS (
  SELECT *, tok = '(*' AND mark AND NOT str AS opens, tok = '(*' AND mark AND NOT str AND depth = 1 AS outer_open, tok = '*)' AND mark AND NOT str AND depth = 0 AND coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY i), 0) = 1 AS outer_close, tok = '.' AND depth = 0 AND NOT str AS stop
  FROM placed),
numbered AS (
  SELECT *, depth = 0 AND NOT outer_close AS is_code, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seq
  FROM flagged),
counted AS (
  SELECT *, coalesce(sum((is_code AND regexp_matches(tok, '[^\s\x0b\x1c-\x1f\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]'))::INT) OVER (PARTITION BY doc_id, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(outer_open::INT) OVER (PARTITION BY doc_id ORDER BY i) AS comment
  FROM numbered),
closed AS (SELECT DISTINCT doc_id, comment FROM counted WHERE outer_close),
comments AS (
  SELECT doc_id, comment, string_agg(tok, '' ORDER BY i) AS whole FROM counted SEMI JOIN closed USING (doc_id, comment)
  WHERE depth > 0 OR outer_close GROUP BY doc_id, comment),
last_doc AS (
  SELECT doc_id, seq, arg_max(whole, comment) AS doc FROM (SELECT DISTINCT doc_id, seq, comment FROM counted WHERE outer_close) JOIN comments USING (doc_id, comment) WHERE whole LIKE '(**%' GROUP BY doc_id, seq),
raw AS (
  SELECT doc_id, seq, {blank("string_agg(tok, '' ORDER BY i) FILTER (is_code)")} AS code,
         max(CASE WHEN opens AND before = 0 THEN line END) AS opened, max(CASE WHEN stop THEN line END) AS stop_line
  FROM counted GROUP BY doc_id, seq HAVING bool_or(stop)),
stmts AS (
  SELECT doc_id, seq, code, coalesce(opened, lag(stop_line) OVER (PARTITION BY doc_id ORDER BY seq), 1)::BIGINT AS line,
         regexp_extract(code, $re${head.replace("''", "'")}$re$, ['kind', 'name', 'rest']) AS m
  FROM raw),
typed AS (SELECT *, {_ws("regexp_replace(m.rest, '[.]$', '')")} AS tail FROM stmts),
all_statements AS (
  SELECT doc_id, seq, code, line, nullif(m.name, '') AS name, CASE WHEN m.name <> '' THEN m.kind END AS kind,
         CASE WHEN m.name = '' THEN NULL WHEN tail[1] = ':' THEN trim(substr(tail, 2)) WHEN contains(tail, ':=') THEN CASE WHEN contains(split_part(tail, ':=', 1), ':') THEN trim(split_part(split_part(tail, ':=', 1), ':', -1)) ELSE '' END ELSE tail END AS type_signature
  FROM typed),
holds AS (SELECT doc_id, library, file_path, source_path FROM src WHERE doc_kind = 'source' OR doc_id IN (SELECT doc_id FROM all_statements WHERE name IS NOT NULL)),
statements AS (SELECT library, file_path, source_path, doc_id, seq, code, line, name, kind, type_signature FROM all_statements JOIN holds USING (doc_id)),
cut AS (SELECT doc_id, seq, CASE WHEN regexp_full_match(doc, '(?s)\(\*\*.*\*\)') AND length(doc) >= 5 THEN substr(doc, 4, length(doc) - 5) ELSE doc END AS doc FROM last_doc),
docs AS (
  SELECT doc_id, seq, array_to_string(list_filter(list_transform(list_transform(regexp_split_to_array(doc, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{0085}}\x{{2028}}\x{{2029}}]'), lambda l: {blank('l')}), lambda l: CASE WHEN l[1] = '*' THEN {blank('substr(l, 2)')} ELSE l END), lambda l: l <> ''), ' ') AS docstring
  FROM cut)"""


def _grouped() -> str:
    """CTE of the statements of proofs, after those of _parsed()."""
    return rf"""marked AS (SELECT *, sum((kind IS NOT NULL)::INT) OVER (PARTITION BY library, file_path ORDER BY seq) AS d FROM statements),
owners AS (SELECT library, file_path, d, seq AS owner, name AS owner_name, kind AS owner_kind FROM marked WHERE kind IS NOT NULL AND kind IN {_list(list(PROOF_KINDS))}),
closers AS (SELECT library, file_path, d, min(seq) AS closer FROM marked WHERE kind IS NULL AND regexp_matches(code, '(?i)^\s*(Qed|Defined|Admitted|Abort)\b') GROUP BY ALL),
proofs AS (SELECT library, file_path, owner, owner_name, owner_kind, seq, code FROM marked JOIN owners USING (library, file_path, d) JOIN closers USING (library, file_path, d) WHERE kind IS NULL AND seq < closer)"""


def oracle_sql() -> dict[str, str]:
    parsed = _parsed()
    norm, neg = f"WITH {NORM}", f"WITH {NORM}, {_features()}, {_NEGATIVES}"
    dense10, dense40, dense50 = (f"{norm}, {_dense(k)}" for k in (10, 40, 50))
    train = f"{neg}, {_SIDES}, {_TRAIN}"
    url = "CASE " + " ".join(f"WHEN library = '{lib}' THEN 'https://example.org/{lib}/blob/main/' || {rel} || '#L' || line_number" for lib, rel in (("corelib", "regexp_replace(file_path, '^theories/', '')"), ("tessera", "regexp_replace(file_path, '^src/', '')"), ("ordinate", "regexp_replace(file_path, '^theories/', '')"), ("lattix", "file_path"))) + " ELSE '' END"
    latest = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY log_id DESC) AS rn FROM description_log) WHERE rn = 1"
    facets = " UNION ALL ".join(f"SELECT '{f}' AS facet, coalesce(nullif({f}, ''), 'unknown') AS value, count(*) AS n FROM declarations GROUP BY ALL" for f in ("library", "kind", "chapter"))
    joined = lambda f: f"(SELECT string_agg(v || '=' || n, ';' ORDER BY v) FROM (SELECT coalesce(nullif({f}, ''), 'unknown') AS v, count(*) AS n FROM declarations GROUP BY ALL))"
    own = "coalesce(nullif(type_signature, ''), nullif(statement, ''))"
    return {
        "compact_ws_documents": f"SELECT doc_id, {_ws('text')} AS compact FROM documents",
        "stable_id_declarations": f"{norm}, k AS (SELECT decl_id, concat_ws(':', library, file_path, line_number::VARCHAR, name) AS key FROM norm) SELECT decl_id, key, (('0x' || substr(sha256(key), 1, 16))::UBIGINT)::VARCHAR AS id FROM k",
        "normalized_declarations": f"{norm} SELECT decl_id, name, type_signature, library, line_number, chapter, {_DENSE_TEXT} AS dense_text, {_SPARSE_TEXT} AS keyword_text FROM norm",
        "url_chapter_extract": f"{norm} SELECT decl_id, {url} AS url, {_CHAPTER} AS file_chapter FROM norm",
        "prompt_and_display": f"""{norm} SELECT decl_id, '[' || decl_id || '] ' || kind || ' ' || name || ' :: ' || coalesce(nullif(type_signature, ''), substr(statement, 1, 320)) AS line,
  concat_ws(' | ', nullif(trim(kind || ' ' || name), ''), nullif(type_signature, ''), nullif(docstring, ''), nullif(statement, '')) AS rerank_text,
  split_part(coalesce(nullif(module_path, ''), 'none'), '.', 1) AS head, split_part(kind, ' ', -1) AS kind_word, greatest(0, least(100, round((decl_id % 150) / 100.0 * 100)))::INT AS percent, split_part(file_path, '/', -1) AS file_name FROM norm""",
        "hash_bucket_tokens": f"{norm} SELECT decl_id, {_hash('t', 384)}::INT AS bucket, count(*) AS tf FROM (SELECT decl_id, unnest({_split(_DENSE_TEXT)}) AS t FROM norm) GROUP BY ALL",
        "sparse_tokens_tf": f"SELECT doc_id, {_hash('t', 2147483648)} AS token_id, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS t FROM documents) GROUP BY ALL",
        "document_frequency_idf": f"""WITH p AS (SELECT DISTINCT doc_id, {_hash('t', 2147483648)} AS token_id FROM (SELECT doc_id, unnest({_tokens('text')}) AS t FROM documents))
SELECT token_id, count(*) AS df, round(ln(((SELECT count(*) FROM documents)::DOUBLE - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1::DOUBLE), 6) AS idf FROM p GROUP BY ALL""",
        "hash_sample": f"SELECT c_custkey, {_hash('c_name', 10000)} < 2500 AS picked FROM customer",
        "cluster_key_split": f"{norm}, {_features()} SELECT seq AS decl_id, stem, array_to_string(relation, ' ') AS relation, cluster, {_hash('cluster', 1000)} < 100 AS is_test FROM feat",
        "dense_hash_search_topk": f"{dense10} SELECT query_id, decl_id, score, rank FROM dense",
        "sparse_idf_search_topk": f"{norm}, {_sparse(10)} SELECT query_id, decl_id, score, rank FROM sparse",
        "fusion_rrf_search": f"""{dense40}, {_sparse(40)}, fused AS (SELECT query_id, decl_id, round(sum(1::DOUBLE / (2 + rank - 1)), 6) AS score FROM (SELECT query_id, decl_id, rank FROM dense UNION ALL SELECT query_id, decl_id, rank FROM sparse) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, decl_id) AS rank FROM fused) WHERE rank <= 10""",
        "faceted_filter_search": "WITH " + NORM + ", " + _dense(10, "library IN ('corelib', 'tessera') AND kind IN ('Lemma', 'Theorem')") + " SELECT query_id, decl_id, score, rank FROM dense",
        "lexical_rrf_rerank": f"""{dense40}, terms AS (SELECT query_id, {_TERMS} AS terms FROM searches), toks AS (SELECT decl_id, {_doc_tokens()} AS toks FROM norm WHERE decl_id IN (SELECT decl_id FROM dense)),
lex AS (SELECT query_id, decl_id, rank AS dense_rank, {_LEXICAL} AS lexical FROM dense JOIN terms USING (query_id) JOIN toks USING (decl_id)),
fused AS (SELECT *, 1::DOUBLE / (60 + dense_rank - 1) + 1::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, dense_rank) - 1) AS fused FROM lex),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense_rank) AS rank FROM fused) WHERE rank <= 10)
SELECT query_id, decl_id, rank, dense_rank, lexical, round(fused / max(fused) OVER (PARTITION BY query_id), 6) AS display_score FROM top""",
        "rerank_passthrough": f"{dense10} SELECT query_id, decl_id, rank, round(score / coalesce(nullif(max(score) OVER (PARTITION BY query_id), 0), 1), 6) AS display_score FROM dense",
        "dense_knn_embeddings": """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS vec_id,
  round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 10""",
        "facet_counts": facets,
        "stats_summary": f"SELECT (SELECT count(*) FROM declarations) AS total_points, {joined('library')} AS libraries, {joined('kind')} AS kinds",
        "inspect_profile": f"{norm} SELECT count(*) AS total, count(*) FILTER (docstring <> '') AS with_docstring FROM norm",
        "inspect_rows": f"{norm} SELECT decl_id, kind, name, library FROM norm WHERE library = 'corelib' AND lower(kind) = 'lemma' AND (contains(lower(name), 'unique') OR contains(lower(type_signature), 'unique') OR contains(lower(docstring), 'unique')) ORDER BY decl_id LIMIT 10",
        "top_kinds": f"{norm} SELECT kind, n FROM (SELECT kind, count(*) AS n, min(decl_id) AS f FROM norm GROUP BY kind) ORDER BY n DESC, f LIMIT 10",
        "describe_fill": f"""{norm} SELECT decl_id, CASE WHEN docstring <> '' THEN docstring WHEN {own} IS NOT NULL THEN kind || ' ' || name || ': ' || {own} WHEN kind IN ('Inductive', 'CoInductive') THEN 'Defines the inductive type ' || name || '.'
  WHEN kind IN ('Definition', 'Fixpoint', 'CoFixpoint') THEN 'Defines ' || name || '.' ELSE kind || ' ' || name || ' from ' || library || '.' END AS docstring, docstring = '' AS docstring_generated FROM norm""",
        "dedupe_first_wins": f"{norm} SELECT min(decl_id) AS decl_id, library, kind, name FROM norm GROUP BY library, kind, name, type_signature",
        "cache_latest": f"SELECT id::VARCHAR AS id, log_id, nl_description FROM ({latest})",
        "description_writeback": f"SELECT d.decl_id, CASE WHEN trim(coalesce(l.nl_description, '')) <> '' THEN l.nl_description ELSE d.nl_description END AS nl_description FROM declarations d JOIN index_points p USING (decl_id) LEFT JOIN ({latest}) l ON l.id = p.id",
        "resume_anti_join": "SELECT decl_id, name FROM declarations WHERE decl_id NOT IN (SELECT decl_id FROM index_points WHERE decl_id IS NOT NULL)",
        "prune_stale": "SELECT point_id, decl_id FROM index_points WHERE decl_id IN (SELECT decl_id FROM declarations WHERE lower(trim(split)) = 'train')",
        "upsert_latest": """WITH l AS (SELECT id::VARCHAR AS id, log_id, name FROM description_log), old AS (SELECT id, min(log_id) AS log_id FROM l WHERE log_id % 3 <> 0 GROUP BY id), new AS (SELECT id, max(log_id) AS log_id FROM l WHERE log_id % 3 = 0 GROUP BY id)
SELECT l.id, l.log_id, l.name FROM l JOIN (SELECT coalesce(new.id, old.id) AS id, coalesce(new.log_id, old.log_id) AS log_id FROM old FULL JOIN new ON old.id = new.id) p ON p.log_id = l.log_id""",
        "hard_negatives": f"{neg} SELECT seq AS decl_id, neg_id, neg_name, class, place FROM neg",
        "training_rows": f"{train} SELECT decl_id, is_test, query, real_query, array_to_string(neg_names, '|') AS neg_names FROM train",
        "triplet_explode": f"{train} SELECT query, positive, negative FROM (SELECT query, positive, unnest(neg_texts) AS negative FROM train WHERE NOT is_test) WHERE trim(negative) <> ''",
        "training_summary": f"{train} SELECT is_test, count(*) AS n_rows, round(100.0::DOUBLE * count(*) FILTER (real_query) / count(*), 4) AS pct_real, round(100.0::DOUBLE * count(*) FILTER (len(neg_names) > 0) / count(*), 4) AS pct_with_negatives, round(avg(len(neg_names)) FILTER (len(neg_names) > 0), 4) AS avg_negatives FROM train GROUP BY is_test",
        "jaccard_best_match": f"{norm}, {_ATTACH} SELECT decl_id, description, round(overlap, 6) AS overlap FROM told",
        "eval_candidates": f"{norm}, {_ATTACH} SELECT description AS query, name AS gold, split_part(coalesce(nullif(module_path, ''), 'mathcomp'), '.', 1) AS hint FROM cands WHERE {_hash('name', 10000)} < 5000",
        "corpus_variants": f"{norm}, {_ATTACH} SELECT decl_id, '' AS base, CASE WHEN name IN (SELECT name FROM cands WHERE {_hash('name', 10000)} < 5000) THEN '' ELSE coalesce(description, '') END AS enriched, coalesce(description, '') AS ship FROM norm LEFT JOIN told USING (decl_id)",
        "attach_coverage": f"{norm}, {_ATTACH} SELECT (SELECT count(*) FROM norm) AS declarations, (SELECT count(*) FROM told) AS described, round((SELECT count(*) FROM told)::DOUBLE / (SELECT count(*) FROM norm), 6) AS share, (SELECT count(*) FROM cands) AS candidates",
        "identifier_leaks": "SELECT query_id, coalesce(gold[1], '') <> '' AND contains(lower(coalesce(query, '')), lower(coalesce(gold[1], ''))) AS leaks FROM nl_queries",
        "gold_lookup": "SELECT query_id, g.name AS name, max(decl_id) AS decl_id FROM (SELECT query_id, unnest(gold) AS name, generate_subscripts(gold, 1) AS i FROM nl_queries) g JOIN declarations d ON d.name = g.name AND d.name <> '' GROUP BY query_id, g.name, i",
        "eval_recall_mrr_map": f"{dense50}, {_RANKED} SELECT query_id, n_gold, best_rank, round(recall5, 6) AS recall5, round(recallk, 6) AS recallk, round(rrk, 6) AS rrk, round(rr, 6) AS rr, round(apk, 6) AS apk FROM per",
        "eval_hit_at_k": f"""{dense50}, {_RANKED} SELECT coalesce(hint, '?') AS hint, count(*) AS queries, round(avg(CASE WHEN best_rank <= 1 THEN 1 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN best_rank <= 5 THEN 1 ELSE 0 END), 6) AS hit5,
  round(avg(CASE WHEN best_rank <= 10 THEN 1 ELSE 0 END), 6) AS hit10, round(avg(recall5), 6) AS recall5, round(avg(recallk), 6) AS recall10, round(avg(rrk), 6) AS mrr10, round(avg(rr), 6) AS mrr, round(avg(apk), 6) AS map10 FROM per JOIN searches USING (query_id) GROUP BY ALL""",
        "gold_rank_depth50": f"""{dense50}, {_RANKED} SELECT r.query_id, any_value(best_rank) AS gold_rank, string_agg(name, '|' ORDER BY rank) FILTER (rank <= 3) AS top_names FROM ranked r LEFT JOIN hq USING (query_id) GROUP BY r.query_id""",
        "self_exclusion": f"""{dense50}, {_RANKED}, own AS (SELECT query_id, gold[-1] AS own_name FROM searches),
            kept AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ranked JOIN own USING (query_id) WHERE name IS DISTINCT FROM own_name)
            SELECT query_id, rank, name FROM kept WHERE rank <= 10""",
        "embedded_points": f"""{norm}, b AS (SELECT DISTINCT decl_id, {_hash('t', 384)} AS bucket FROM (SELECT decl_id, unnest({_split(_DENSE_TEXT)}) AS t FROM norm))
            SELECT decl_id, count(bucket) AS n_used, CASE WHEN count(bucket) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM norm LEFT JOIN b USING (decl_id) GROUP BY decl_id""",
        "index_resume_prune": f"""{norm}, lemmas AS (SELECT norm.* FROM norm JOIN declarations d USING (decl_id) WHERE d.kind = 'Lemma')
            SELECT DISTINCT (('0x' || substr(sha256(concat_ws(':', library, file_path, line_number::VARCHAR, name)), 1, 16))::UBIGINT)::VARCHAR AS id, library FROM lemmas""",
        "premise_edges": f"""{norm}, short AS (SELECT decl_id, split_part(name, '.', -1) AS name, statement FROM norm), names AS (SELECT DISTINCT coalesce(list_filter({_tokens('name')}, lambda t: t NOT IN {_list(RELATION_WORDS)} AND t NOT IN {_list(NAME_STOP_WORDS)} AND NOT regexp_full_match(t, '[0-9]+'))[1], '') AS n FROM short),
tok AS (SELECT DISTINCT decl_id, name, unnest(regexp_extract_all(statement, '[A-Za-z_][A-Za-z0-9_'']*')) AS t FROM short),
p AS (SELECT decl_id, list(t ORDER BY t) AS l FROM tok WHERE length(t) >= 3 AND t <> name AND t NOT IN {_list(TACTICS)} AND t IN (SELECT n FROM names WHERE n <> '') GROUP BY decl_id) SELECT decl_id, array_to_string(l, '|') AS premises FROM p WHERE len(l) BETWEEN 1 AND 15""",
        "strided_sample": """WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, o_totalprice FROM o WHERE n <= 1500 OR i IN (SELECT (k * (SELECT count(*) FROM orders)) // 1500 FROM range(1500) t(k))""",
        "rate_limit_window_count": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n_recent FROM events",
        "rate_limit_stateful": _LIMITED,
        "strip_nested_comments": f"{parsed} SELECT library, file_path, seq, code, name, kind, type_signature FROM statements",
        "parse_declarations": f"""{parsed} SELECT name, kind, type_signature, {_ws('code')} AS statement, coalesce(docstring, '') AS docstring, replace(regexp_replace(file_path, '[.]v$', ''), '/', '.') AS module_path, library, file_path, source_path, line AS line_number, seq AS statement_no, '' AS github_url FROM statements LEFT JOIN docs USING (doc_id, seq) WHERE name IS NOT NULL""",
        "proof_grouping": f"{parsed}, {_grouped()} SELECT * FROM proofs",
        "mine_premises": f"""{parsed}, {_grouped()},
            known AS (SELECT DISTINCT regexp_extract(coalesce(name, ''), '[^.]*$') AS n FROM declarations UNION SELECT DISTINCT name FROM statements WHERE name IS NOT NULL),
            words AS (SELECT DISTINCT library, file_path, owner, owner_name, unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_'']*')) AS w FROM proofs),
            found AS (SELECT library, file_path, owner, list_sort(list(DISTINCT w)) AS premises FROM words WHERE length(w) >= 3 AND w NOT IN {_list(list(TACTICS))} AND w <> owner_name AND w IN (SELECT n FROM known WHERE n <> '') GROUP BY ALL)
            SELECT name, kind, library, file_path, type_signature, {_ws('code')} AS statement, premises FROM found JOIN statements s USING (library, file_path) WHERE s.seq = owner AND len(premises) BETWEEN 1 AND 15""",
    }
