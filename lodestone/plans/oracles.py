"""DuckDB SQL for the catalogue: the same rows, stated independently of the plans."""

from __future__ import annotations

from ..config import LEXICAL_ONLY_SCORE, SCOPES, SIGNALS, WELL_COVERED_HITS
from ..functions.paths import BARE_NAMES, BINARY_SUFFIXES, LANGUAGES, SKIP_DIRS, WATCH_IGNORED_DIRS, WATCH_IGNORED_SUFFIXES
from . import fixtures as X
from .fixtures import quoted, values
from .queries import DIGITS, EVENT_OPS, FTS_QUERIES, SEARCH_LIMIT, TASK_TEXTS, TASK_VECTORS


def _list(items) -> str:
    return ", ".join(quoted(i) for i in items)


# Lines and chunks of documents.
LINES = """
ln AS (
  SELECT doc_id::VARCHAR AS path, lang, i, CASE WHEN i < n THEN x || chr(10) ELSE x END AS x
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents)
  WHERE NOT (i = n AND x = '')
)"""


def _chunks(size: int) -> str:
    return f"""
ck AS (
  SELECT path, any_value(lang) AS language, min(i)::INT AS line_start, max(i)::INT AS line_end, string_agg(x, '' ORDER BY i) AS content FROM ln GROUP BY path, (i - 1) // {size}
)"""


SYM = LINES + "," + _chunks(50) + """,
sy AS (
  SELECT path, language, path || ':' || line_start || '-' || line_end AS symbol_name, 'chunk' AS symbol_type, line_start, line_end, content, path::BIGINT + (line_start - 1)::BIGINT * 1000000000 AS symbol_id FROM ck
)"""


def _chunk_query(size: int, name: str) -> str:
    return f"WITH {LINES}, {_chunks(size)} SELECT path, {name} AS symbol_name, 'chunk' AS symbol_type, line_start, line_end, content FROM ck"


TOKENS = r"len(list_filter(regexp_split_to_array(content, '[\s\x1c-\x1f\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+'), lambda w: w <> ''))"

# Postings and BM25.
INDEX = SYM + r""",
tk AS (
  SELECT symbol_id, path AS file, line_start, c.col, regexp_extract_all(strip_accents(lower(c.v)), '[\p{L}\p{N}]+') AS t
  FROM sy, LATERAL (SELECT unnest(['path', 'symbol_name', 'symbol_type', 'content']) AS col, unnest([path, symbol_name, symbol_type, content]) AS v) c
), po AS (
  SELECT symbol_id, file, line_start, col, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tk
), le AS (
  SELECT symbol_id, sum(len(t)) AS n FROM tk GROUP BY symbol_id
), st AS (
  SELECT count(*)::DOUBLE AS rows, avg(n) AS mean FROM le
)"""

def _rank(counts: str = "true") -> str:
    """counts: where a phrase adds to the score, in terms of query_id, phrase and m (the matched phrases)."""
    return f"""
df AS (
  SELECT query_id, phrase, count(*)::DOUBLE AS n FROM hits GROUP BY query_id, phrase
), rk AS (
  SELECT query_id, symbol_id, -sum(CASE WHEN NOT ({counts}) THEN 0 WHEN ln((rows - df.n + 0.5) / (df.n + 0.5)) <= 0 THEN 1e-6 ELSE ln((rows - df.n + 0.5) / (df.n + 0.5)) END * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * le.n / mean))) AS rank, any_value(m) AS m
  FROM hits JOIN df USING (query_id, phrase) JOIN le USING (symbol_id) JOIN (SELECT query_id, symbol_id, list(phrase) AS m FROM hits GROUP BY query_id, symbol_id) USING (query_id, symbol_id), st GROUP BY query_id, symbol_id
)"""


def _hit(query: int, phrase: int, where: str) -> str:
    return f"SELECT {query} AS query_id, {phrase} AS phrase, symbol_id, count(*)::DOUBLE AS f FROM po WHERE {where} GROUP BY symbol_id"


def _term(t: str, cols: str = "") -> str:
    return f"term = {quoted(t)}" + (f" AND col = {quoted(cols)}" if cols else "")


_has = "list_contains(m, {})".format
#: For each query: the conditions of its phrases, and its tree over them.
_FTS = {
    "fts_single_term": ([_term("that")], _has(0)),
    "fts_or": ([_term("that"), _term("que"), _term("nichtsdergleichen")], "true"),
    "fts_and": ([_term("the"), _term("that")], f"{_has(0)} AND {_has(1)}"),
    "fts_not": ([_term("that"), _term("with")], f"{_has(0)} AND NOT {_has(1)}"),
    "fts_phrase": (["(symbol_id, col, pos) IN (SELECT (a.symbol_id, a.col, a.pos) FROM po a JOIN po b ON a.symbol_id = b.symbol_id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the')"], _has(0)),
    "fts_prefix": (["term LIKE 'tha%'"], _has(0)),
    "fts_column": ([_term("7", "path"), _term("uber", "content")], "true"),
    "fts_precedence": ([_term("que"), _term("de"), _term("that"), _term("with")], f"({_has(0)} AND NOT {_has(1)}) OR ({_has(2)} AND {_has(3)})", f"CASE WHEN phrase < 2 THEN {_has(0)} AND NOT {_has(1)} ELSE {_has(2)} AND {_has(3)} END"),
    "fts_first": ([_term("the") + " AND pos = 0"], _has(0)),
}
assert set(_FTS) | {"fts_near"} == set(FTS_QUERIES)
#: Instances of both terms with at most three tokens between them; how rare a term is counts everywhere.
_NEAR = f"""
WITH {INDEX}, ne AS (
  SELECT DISTINCT a.symbol_id, a.col, a.pos, a.term FROM po a JOIN po b ON a.symbol_id = b.symbol_id AND a.col = b.col AND abs(a.pos - b.pos) <= 4 WHERE (a.term = 'that' AND b.term = 'with') OR (a.term = 'with' AND b.term = 'that')
), hits AS (
  SELECT 0 AS query_id, CASE term WHEN 'that' THEN 0 ELSE 1 END AS phrase, symbol_id, count(*)::DOUBLE AS f FROM ne GROUP BY ALL
), {_rank().replace("SELECT query_id, phrase, count(*)::DOUBLE AS n FROM hits GROUP BY query_id, phrase", "SELECT 0 AS query_id, CASE term WHEN 'that' THEN 0 ELSE 1 END AS phrase, count(DISTINCT symbol_id)::DOUBLE AS n FROM po WHERE term IN ('that', 'with') GROUP BY ALL")}
SELECT path, line_start, round(rank, {DIGITS}) AS rank FROM rk JOIN sy USING (symbol_id) WHERE {_has(0)} AND {_has(1)}"""


def _fts(conditions: list[str], tree: str, counts: str = "true", tail: str = "") -> str:
    hits = " UNION ALL ".join(_hit(0, k, c) for k, c in enumerate(conditions))
    return f"WITH {INDEX}, hits AS ({hits}), {_rank(counts)} SELECT path, line_start, round(rank, {DIGITS}) AS rank FROM rk JOIN sy USING (symbol_id) WHERE {tree} {tail}"


_NORMALISED = f"""
WITH {INDEX}, hits AS ({_hit(1, 0, _term('that'))} UNION ALL {_hit(2, 0, _term('que'))} UNION ALL {_hit(2, 1, _term('les'))}), {_rank()}
SELECT query_id::BIGINT AS query_id, symbol_id, round(1 - abs(rank) / max(abs(rank)) OVER (PARTITION BY query_id), {DIGITS}) AS fts_score FROM rk"""

_FALLBACK = f"""
WITH {INDEX}, hits AS ({_hit(1, 0, _term('that'))} UNION ALL {_hit(2, 0, _term('que'))} UNION ALL {_hit(2, 1, _term('les'))}), {_rank()}
SELECT query_id::BIGINT AS query_id, path, line_start, 'unknown' AS language, {LEXICAL_ONLY_SCORE}::DOUBLE AS score, {LEXICAL_ONLY_SCORE}::DOUBLE AS combined_score FROM rk JOIN sy USING (symbol_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rank, {DIGITS}), symbol_id) <= CASE query_id WHEN 1 THEN 15 ELSE 25 END"""

_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_TOPK = f"""
tk AS (
  SELECT query_id, symbol_id, score FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS symbol_id, round({_DOT}, {DIGITS}) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0
  ) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) <= 10
)"""

# Hybrid search: task 1 and 2 are conjunctions, 3 too (over its six words), 4 a disjunction.
_WORDS = {k: [w for w in t.split() if w != "OR"] for k, t in TASK_TEXTS.items()}
_CONJUNCTION = {1: "len(list_distinct(m)) = 2", 2: "len(list_distinct(m)) = 3", 3: "len(list_distinct(m)) = 6", 4: f"({_has(0)} AND {_has(1)}) OR {_has(2)}"}


#: Of the disjunction, the words of its first part add to the score where both occur.
_COUNTS = f"query_id <> 4 OR phrase = 2 OR ({_has(0)} AND {_has(1)})"


def _hybrid(each_side: str, fetch: str, limits: str) -> str:
    """CTEs up to fu (query_id, symbol_id, score, combined_score, semantic). each_side and fetch: row limits; limits: a CTE that they need."""
    hits = " UNION ALL ".join(_hit(k, n, _term(w)) for k, ws in _WORDS.items() for n, w in enumerate(ws))
    where = " OR ".join(f"(query_id = {k} AND ({c}))" for k, c in _CONJUNCTION.items())
    vectors = values(TASK_VECTORS.items(), "query_id, vec_id")
    return f"""{INDEX}, hits AS ({hits}), {_rank(_COUNTS)}, {limits}
lx AS (
  SELECT query_id, symbol_id, round(rank, {DIGITS}) AS rank FROM rk WHERE {where}
), l2 AS (
  SELECT lx.query_id, symbol_id, rank FROM lx JOIN lim USING (query_id) QUALIFY row_number() OVER (PARTITION BY lx.query_id ORDER BY rank, symbol_id) <= {each_side}
), l3 AS (
  SELECT query_id, symbol_id, 1 - abs(rank) / max(abs(rank)) OVER (PARTITION BY query_id) AS lex FROM l2
), se AS (
  SELECT query_id, symbol_id, sem FROM (
    SELECT v.query_id, b.vec_id AS symbol_id, round({_DOT}, {DIGITS}) AS sem FROM {vectors} JOIN embeddings a ON a.vec_id = v.vec_id, embeddings b
  ) JOIN lim USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sem DESC, symbol_id) <= {each_side}
), bo AS (
  SELECT query_id, symbol_id, coalesce(sem, 0.3::DOUBLE * lex) AS score, round(coalesce(0.7::DOUBLE * sem, 0) + coalesce(0.3::DOUBLE * lex, 0), {DIGITS}) AS combined_score, sem IS NOT NULL AS semantic FROM se FULL JOIN l3 USING (query_id, symbol_id)
), fu AS (
  SELECT bo.* FROM bo JOIN lim USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, symbol_id) <= {fetch}
), re AS (
  SELECT query_id, symbol_id, path, CASE WHEN semantic THEN language ELSE 'unknown' END AS language, line_start, symbol_name, content, score, combined_score FROM fu JOIN sy USING (symbol_id)
)"""


_LIM = values([(k, SEARCH_LIMIT) for k in TASK_TEXTS], "query_id, n_fetch")
_HYBRID_SEARCH = f"WITH {_hybrid(str(2 * SEARCH_LIMIT), str(SEARCH_LIMIT), f'lim AS (SELECT * FROM {_LIM}),')} SELECT query_id::BIGINT AS query_id, path, line_start, language, round(score, {DIGITS}) AS score, combined_score FROM re"

# Classification.
_SCOPES = values(SCOPES, "scope, scope_name, max_files, max_symbols, max_tokens, use_callers, use_deps, search_depth")
_TASKS = f"""
ta AS (
  SELECT conv_id * 1000 + turn AS query_id, text AS task FROM conversations UNION ALL SELECT -query_id, task FROM {values(X.TASKS, 'query_id, task')}
)"""


def _explained(tasks: str) -> str:
    first = lambda signals: "coalesce(" + ", ".join(f"CASE WHEN contains(t, {quoted(s)}) THEN {quoted(s)} END" for s in signals) + ")"
    return tasks + f""",
e1 AS (
  SELECT *, {', '.join(f'{first(s)} AS s{k}' for k, s in enumerate(SIGNALS, 1))}, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+\\(\\)') AS calls, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS n FROM (SELECT *, lower(trim(task)) AS t FROM ta)
), e2 AS (
  SELECT *, list_filter([s1, s2, s3, s4], lambda s: s IS NOT NULL) || calls AS sig,
    CASE WHEN n < 5 THEN 1 WHEN s4 IS NOT NULL THEN 4 WHEN s3 IS NOT NULL THEN 3 WHEN s2 IS NOT NULL THEN 2 WHEN s1 IS NOT NULL OR len(calls) > 0 THEN 1 ELSE 2 END AS scope FROM e1
), ex AS (
  SELECT query_id, task, e2.scope, scope_name, CASE WHEN n < 5 THEN ['<short task>'] ELSE sig END AS signals,
    CASE WHEN n < 5 THEN 'Task is only ' || n || ' word(s) → surgical scope' WHEN len(sig) = 0 THEN 'No keyword signals detected → defaulting to local scope'
      ELSE 'Detected ' || array_to_string(list_transform(sig[1:3], lambda s: '''' || s || ''''), ' and ') || CASE WHEN len(sig) > 3 THEN ' (+' || (len(sig) - 3) || ' more)' ELSE '' END || ' → ' || lower(scope_name) || ' scope' END AS reasoning
  FROM e2 JOIN {_SCOPES} ON v.scope = e2.scope
)"""


# Limits.
def _capped(rows: str) -> str:
    """CTEs up to cp from rows (query_id, path, line_start, symbol_name, language, content, score, combined_score) and cf (limits)."""
    return f"""
ro AS ({rows}), bf AS (
  SELECT query_id, path, max(combined_score) AS best FROM ro GROUP BY query_id, path
), tf AS (
  SELECT bf.query_id, path FROM bf JOIN cf USING (query_id) WHERE best > -1 QUALIFY row_number() OVER (PARTITION BY bf.query_id ORDER BY best DESC, path) <= max_files
), ts AS (
  SELECT ro.*, max_tokens, trunc({TOKENS} * 1.3::DOUBLE)::BIGINT AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, path, line_start, symbol_name, score DESC) AS r, max_symbols FROM ro JOIN tf USING (query_id, path) JOIN cf USING (query_id)
), cp AS (
  SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY r) AS running FROM ts WHERE r <= max_symbols) WHERE running <= max_tokens
), gr AS (
  SELECT query_id, path, arg_min(language, line_start) AS language, count(*) AS n_symbols, avg(combined_score) AS relevance_score, sum(tokens)::BIGINT AS tokens FROM cp GROUP BY query_id, path
)"""


_SCORED = "SELECT CASE language WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END AS query_id, path, line_start, symbol_name, language, content, length(content) / 100000.0::DOUBLE AS score, length(content) / 100000.0::DOUBLE AS combined_score FROM sy"
_CAPPED = f"WITH {SYM}, cf AS (SELECT scope AS query_id, max_files, max_symbols, max_tokens FROM {_SCOPES}), {_capped(_SCORED)}"

_CONTEXT = f"""
WITH {_explained('ta AS (SELECT * FROM ' + values(TASK_TEXTS.items(), 'query_id, task') + ')')}, {_hybrid("2 * n_fetch", "n_fetch", f"lim AS (SELECT query_id, 2 * max_symbols AS n_fetch FROM ex JOIN {_SCOPES} USING (scope)),")},
cf AS (SELECT query_id, max_files, max_symbols, max_tokens FROM ex JOIN {_SCOPES} USING (scope)), {_capped('SELECT * FROM re')}
SELECT gr.query_id::BIGINT AS query_id, lower(scope_name) AS scope, (sum(tokens) OVER (PARTITION BY gr.query_id))::BIGINT AS total_tokens, reasoning AS explanation, path, language, n_symbols, round(relevance_score, {DIGITS}) AS relevance_score
FROM gr JOIN ex USING (query_id)"""

_CONTEXT_CTES = _CONTEXT[: _CONTEXT.rindex("SELECT gr.query_id")].rstrip()
_CONTEXT_MARKDOWN = f"""{_CONTEXT_CTES}, fm AS (
  SELECT cp.query_id, cp.path, avg(combined_score) AS relevance, min(r) AS first, sum(tokens) AS tokens, '## File: `' || cp.path || '` (relevance: ' || printf('%.2f', avg(combined_score)) || ')' || chr(10) || '**Language:** ' || arg_min(cp.language, cp.line_start) || chr(10) || chr(10)
    || string_agg('### chunk: `' || cp.symbol_name || '` (lines ' || cp.line_start || '–' || sy.line_end || ')' || chr(10) || chr(10) || '```' || chr(10) || regexp_replace(cp.content, '\\s+$', '') || chr(10) || '```' || chr(10), chr(10) ORDER BY cp.line_start, r) AS body
  FROM cp JOIN sy ON sy.path = cp.path AND sy.line_start = cp.line_start GROUP BY cp.query_id, cp.path
), qm AS (
  SELECT query_id, string_agg(body, chr(10) ORDER BY relevance DESC, first) AS body, sum(tokens)::BIGINT AS tokens FROM fm GROUP BY query_id
)
SELECT ex.query_id::BIGINT AS query_id, '# lodestone context — ' || lower(scope_name) || ' scope' || chr(10) || chr(10) || '**Task:** ' || task || chr(10) || '**Reasoning:** ' || CASE WHEN ex.query_id IN (SELECT query_id FROM re) THEN '' ELSE 'No results found. ' END || reasoning || chr(10)
  || '**Estimated tokens:** ' || format('{{:,}}', coalesce(tokens, 0)) || chr(10) || chr(10) || coalesce(body, '_No relevant context found._') AS markdown
FROM ex LEFT JOIN qm USING (query_id)"""
_SEARCH_MARKDOWN = f"""
WITH {_hybrid(str(2 * SEARCH_LIMIT), str(SEARCH_LIMIT), f'lim AS (SELECT * FROM {_LIM}),')}, sm AS (
  SELECT re.query_id, string_agg('### `' || re.path || '` — chunk: `' || re.symbol_name || '` (lines ' || re.line_start || '-' || sy.line_end || ') score: ' || round(score, 3)::VARCHAR || chr(10) || '```' || re.language || chr(10) || re.content || chr(10) || '```' || chr(10), chr(10) ORDER BY combined_score DESC, re.path, re.line_start) AS body
  FROM re JOIN sy USING (symbol_id) GROUP BY re.query_id
)
SELECT v.query_id::BIGINT AS query_id, CASE WHEN body IS NULL THEN 'No results found for `' || query || '`.' ELSE '## Search results for `' || query || '`' || chr(10) || chr(10) || body END AS markdown FROM {values(TASK_TEXTS.items(), 'query_id, query')} LEFT JOIN sm ON sm.query_id = v.query_id"""
_EXPANDED_MARKDOWN = f"""
WITH {SYM}, em AS (
  SELECT path, string_agg('### chunk: ' || symbol_name || ' (lines ' || line_start || '-' || line_end || ')' || chr(10) || '```unknown' || chr(10) || content || chr(10) || '```' || chr(10), chr(10) ORDER BY line_start) AS body FROM sy GROUP BY path
)
SELECT doc_id::VARCHAR AS path, '## Expanded: ' || doc_id || chr(10) || coalesce(chr(10) || body, '') AS markdown FROM documents LEFT JOIN em ON path = doc_id::VARCHAR"""

# Paths.
_NAME = "list_extract(string_split(path, '/'), -1)"
_SUFFIX = f"regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)"
_PARTS = "len(list_filter(string_split(path, '/'), lambda p: p IN ({dirs}) OR ends_with(p, '.egg-info'))) > 0"
_PATH_LANGUAGE = f"""
WITH p AS (SELECT path FROM {values(X.PATHS, 'path')} UNION ALL SELECT url FROM pages)
SELECT path, coalesce(b.language, e.language, 'unknown') AS language, {_SUFFIX} AS suffix FROM p
LEFT JOIN (SELECT * FROM {values(BARE_NAMES.items(), 'name, language')}) b ON b.name = {_NAME} LEFT JOIN (SELECT * FROM {values(LANGUAGES.items(), 'suffix, language')}) e ON e.suffix = lower({_SUFFIX})"""
_SKIP = f"""
SELECT path, lower({_SUFFIX}) IN ({_list(BINARY_SUFFIXES)}) OR {_PARTS.format(dirs=_list((*SKIP_DIRS, '.lodestone')))} AS skipped, {_SUFFIX} IN ({_list(WATCH_IGNORED_SUFFIXES)}) OR {_PARTS.format(dirs=_list((*WATCH_IGNORED_DIRS, '.lodestone')))} AS ignored FROM {values(X.PATHS, 'path')}"""

# Graphs.
_SYMBOL = "path, symbol_name, symbol_type, line_start, line_end, content"
_CODE = f"""
co AS (
  SELECT *, path || '::' || symbol_name AS id, list_extract(string_split(list_extract(string_split(symbol_name, ':'), -1), '/'), -1) AS bare FROM {values(X.CODE, _SYMBOL)} WHERE symbol_type IN ('function', 'method', 'chunk')
), ed AS (
  SELECT a.id AS src, b.id AS dst, a.path AS caller_file, b.path AS callee_file, max(a.line_start)::INT AS line FROM co a, co b
  WHERE length(b.bare) > 2 AND a.bare <> b.bare AND a.id <> b.id AND regexp_matches(a.content, '\\b' || regexp_escape(b.bare) || '\\s*\\(') GROUP BY ALL
)"""
_NAMES = values([("log_line",), ("load_config",), ("open_socket",), ("emit",), ("none",)], "name")
_CALLERS = f"WITH {_CODE} SELECT name, a.symbol_name AS function_name, a.path AS file_path, a.line_start::INT AS line_start FROM {_NAMES} JOIN co b ON b.bare = name JOIN ed ON dst = b.id JOIN co a ON src = a.id"
_CALLEES = f"WITH {_CODE} SELECT name, b.symbol_name AS function_name, b.path AS file_path, b.line_start::INT AS line_start FROM {_NAMES} JOIN co a ON a.bare = name JOIN ed ON src = a.id JOIN co b ON dst = b.id"
_IMPORTS = f"""
im AS (
  SELECT path, CASE WHEN m LIKE 'from%import %' THEN regexp_extract(m, 'from\\s+(\\.{{0,3}}[\\w.]*)\\s+import', 1) ELSE regexp_extract(m, 'import\\s+([\\w.]+)', 1) END AS raw_import
  FROM (SELECT path, unnest(regexp_extract_all(content, '(?:from\\s+(?:\\.{{0,3}}[\\w.]*)\\s+import\\s+[\\w,\\s*]+)|(?:import\\s+(?:[\\w.]+))')) AS m FROM {values(X.IMPORTS, _SYMBOL)} WHERE symbol_type = 'import')
), fi AS (
  SELECT DISTINCT path FROM {values(X.IMPORT_FILES, 'path')}
), sp AS (
  SELECT DISTINCT path, raw_import, length(raw_import) - length(ltrim(raw_import, '.')) AS dots, replace(ltrim(raw_import, '.'), '.', '/') AS module, string_split(path, '/')[:-2] AS folder FROM im WHERE raw_import <> ''
), ba AS (
  SELECT path, raw_import, CASE WHEN dots = 0 THEN module ELSE array_to_string(list_filter(folder[:greatest(len(folder) - (dots - 1), 0)] || [module], lambda x: x <> ''), '/') END AS base FROM sp
), ca AS (
  SELECT path, raw_import, s.n, string_split(base || s.suffix, '/') AS parts FROM ba, (SELECT unnest(['.py', '/__init__.py', '.ts', '.js', '.tsx', '.jsx']) AS suffix, unnest(range(6)) AS n) s
), op AS (
  SELECT path, raw_import, n, k, array_to_string(parts[k:], '/') AS dst FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM ca)
), ie AS (
  SELECT src, dst, max(raw_import) AS raw_import FROM (SELECT op.path AS src, op.raw_import, arg_min(dst, n * 1000 + k) AS dst FROM op JOIN fi ON fi.path = dst GROUP BY ALL) WHERE src <> dst GROUP BY ALL
)"""
_UNDIRECTED = "li AS (SELECT src AS a, dst AS b FROM ie UNION SELECT dst, src FROM ie)"


def _related(depth: int) -> str:
    return f"""
WITH RECURSIVE {_IMPORTS}, {_UNDIRECTED}, bfs AS (
  SELECT path AS start, path, 0 AS hops FROM fi UNION SELECT start, b, hops + 1 FROM bfs JOIN li ON a = path WHERE hops < {depth}
)
SELECT start, path, min(hops)::BIGINT AS hops FROM bfs WHERE path <> start GROUP BY start, path"""


_DEGREES = "dg AS (SELECT fi.path, count(DISTINCT src)::BIGINT AS n FROM fi LEFT JOIN ie ON dst = fi.path GROUP BY fi.path)"
_BY_PATH = lambda own, other, text: f"SELECT {own} AS path, string_agg('  - `' || {other} || '`', chr(10) ORDER BY {other}) AS {text} FROM ie GROUP BY {own}"
_DEPS_MARKDOWN = f"""
WITH {_IMPORTS}, o AS ({_BY_PATH('src', 'dst', 'o')}), i AS ({_BY_PATH('dst', 'src', 'i')})
SELECT path, '## Dependencies for `' || path || '`' || chr(10) || chr(10) || '### This file imports:' || chr(10) || coalesce(o, '  - none found') || chr(10) || chr(10) || '### Files that import this file:' || chr(10) || coalesce(i, '  - none found') AS markdown
FROM fi LEFT JOIN o USING (path) LEFT JOIN i USING (path)"""
_CALLERS_MARKDOWN = f"""
WITH {_CODE}, c AS (SELECT name, string_agg('- `' || a.symbol_name || '` in `' || a.path || '` line ' || a.line_start, chr(10) ORDER BY a.path, a.line_start, a.symbol_name) AS t FROM {_NAMES} JOIN co b ON b.bare = name JOIN ed ON dst = b.id JOIN co a ON src = a.id GROUP BY name)
SELECT name, CASE WHEN t IS NULL THEN 'No callers found for `' || name || '`.' ELSE '## Callers of `' || name || '`' || chr(10) || chr(10) || t END AS markdown FROM {_NAMES} LEFT JOIN c USING (name)"""
_STRUCTURE = f"""
WITH {_IMPORTS}, {_DEGREES}, lg AS (
  SELECT coalesce(e.language, 'unknown') AS language, count(*) AS n FROM fi LEFT JOIN (SELECT * FROM {values(LANGUAGES.items(), 'suffix, language')}) e ON e.suffix = lower({_SUFFIX}) GROUP BY 1
)
SELECT '## Project Structure' || chr(10) || chr(10) || '**Files:** ' || (SELECT count(*) FROM fi) || '  ' || chr(10) || '**Symbols:** ' || {len(X.IMPORTS)} || '  ' || chr(10) || '**Est. tokens:** ' || (SELECT sum(length(content)) // 4 FROM {values(X.IMPORTS, _SYMBOL)}) || chr(10) || chr(10)
  || '### Language Breakdown' || chr(10) || (SELECT string_agg('  - ' || language || ': ' || n || ' files', chr(10) ORDER BY language) FROM lg) || chr(10)
  || chr(10) || '### Entry Points' || chr(10) || (SELECT string_agg('  - `' || path || '`', chr(10) ORDER BY path) FROM (SELECT path FROM dg WHERE n = 0 ORDER BY path LIMIT 10)) || chr(10)
  || chr(10) || '### Most Depended-On Files' || chr(10) || (SELECT string_agg('  - `' || path || '` (' || n || ' dependents)', chr(10) ORDER BY n DESC, path) FROM (SELECT * FROM dg ORDER BY n DESC, path LIMIT 10)) AS markdown"""


_GRAPH_TASKS = [(1, "open_socket", "open", "socket"), (2, "refactor OR across OR load_config OR anything", "load", "config")]
_HAS_PHRASE = " OR ".join(f"regexp_matches(lower({c}), '(^|[^\\p{{L}}\\p{{N}}])' || w1 || '[^\\p{{L}}\\p{{N}}]+' || w2 || '($|[^\\p{{L}}\\p{{N}}])')" for c in ("path", "symbol_name", "symbol_type", "content"))
#: Expansion: what the lexical side finds, the files of its callers and near its files, and all their symbols.
_WITH_GRAPH = f"""
WITH RECURSIVE {_explained("ta AS (SELECT query_id, task FROM " + values([t[:2] for t in _GRAPH_TASKS], "query_id, task") + ")")}, {_CODE}, {_IMPORTS}, {_UNDIRECTED},
cf AS (SELECT query_id, max_files, max_symbols, max_tokens, use_callers, use_deps, search_depth FROM ex JOIN {_SCOPES} USING (scope)), al AS (
  SELECT * FROM {values(X.CODE + X.IMPORTS, _SYMBOL)}
), fo AS (
  SELECT q.query_id, al.*, list_extract(string_split(list_extract(string_split(symbol_name, ':'), -1), '/'), -1) AS bare FROM al, (SELECT * FROM {values(_GRAPH_TASKS, 'query_id, task, w1, w2')}) q WHERE {_HAS_PHRASE}
), bfs AS (
  SELECT DISTINCT query_id, path, 0 AS hops FROM fo JOIN cf USING (query_id) WHERE use_deps UNION SELECT query_id, b, hops + 1 FROM bfs JOIN li ON a = path JOIN cf USING (query_id) WHERE hops < search_depth
), xf AS (
  SELECT fo.query_id, a.path FROM fo JOIN cf USING (query_id) JOIN co b ON b.bare = fo.bare JOIN ed ON dst = b.id JOIN co a ON src = a.id WHERE use_callers
  UNION SELECT s.query_id, e.path FROM bfs s JOIN bfs e ON e.query_id = s.query_id WHERE s.hops = 0 AND e.path <> s.path AND e.hops > 0
), cv AS (
  SELECT query_id, path FROM fo GROUP BY ALL HAVING count(*) >= {WELL_COVERED_HITS}
), {_capped(f"SELECT query_id, path, line_start, symbol_name, 'unknown' AS language, content, {LEXICAL_ONLY_SCORE}::DOUBLE AS score, {LEXICAL_ONLY_SCORE}::DOUBLE AS combined_score FROM fo UNION ALL SELECT query_id, path, line_start, symbol_name, 'unknown', content, 0, 0 FROM xf JOIN al USING (path) WHERE (query_id, path) NOT IN (SELECT (query_id, path) FROM cv)")}
SELECT g.query_id::BIGINT AS query_id, lower(scope_name) AS scope, (row_number() OVER (PARTITION BY g.query_id ORDER BY relevance_score DESC, first) - 1)::INT AS place, path, n_symbols::INT AS n_symbols, round(relevance_score, {DIGITS}) AS relevance_score
FROM gr g JOIN (SELECT query_id, path, min(r) AS first FROM cp GROUP BY ALL) USING (query_id, path) JOIN ex USING (query_id)"""
_GRAPH_JSON = f"""
WITH {_CODE}
SELECT 'node' AS kind, to_json({{'id': id, 'symbol_name': symbol_name, 'file_path': path, 'line_start': line_start}})::VARCHAR AS value FROM co
UNION ALL SELECT 'link', to_json({{'source': src, 'target': dst, 'caller_file': caller_file, 'callee_file': callee_file, 'line': line}})::VARCHAR FROM ed"""


def _source_symbols(*paths: str) -> str:
    rows = [r for r in X.SOURCE_SYMBOLS if not paths or r[0] in paths]
    return f"SELECT path, symbol_name, symbol_type, line_start::INT AS line_start, line_end::INT AS line_end, content FROM {values(rows, _SYMBOL)}"


# Sections of literal files.
def _section_lines(*languages: str) -> str:
    rows = [r for r in X.SECTION_FILES if r[1] in languages]
    given = "(VALUES " + ", ".join(f"({quoted(p)}, {quoted(lang)}, {quoted(t).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))})" for p, lang, t in rows) + ") AS v(path, language, content)"
    return f"""
fl AS (SELECT * FROM {given}), sl AS (
  SELECT path, language, i, CASE WHEN i < n THEN x || chr(10) ELSE x END AS x FROM (SELECT path, language, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i, len(string_split(content, chr(10))) AS n FROM fl) WHERE NOT (i = n AND x = '')
), nl AS (
  SELECT fl.path, fl.language, count(i) AS n FROM fl LEFT JOIN sl USING (path) GROUP BY ALL
)"""


def _fallback(size: str, which: str = "true") -> str:
    return f"""SELECT path, 'chunk_' || ((i - 1) // {size} * {size} + 1) AS symbol_name, 'chunk' AS symbol_type, min(i)::INT AS line_start, max(i)::INT AS line_end, string_agg(x, '' ORDER BY i) AS content FROM sl WHERE {which} GROUP BY path, (i - 1) // {size}
  UNION ALL SELECT path, 'chunk_1', 'chunk', 1, 0, '' FROM nl WHERE n = 0 AND {which}"""


def _starts(condition: str, name: str, kind: str) -> str:
    return f"""
he AS (SELECT path, i, {name} AS name, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i), n + 1) AS stop FROM sl JOIN nl USING (path) WHERE {condition})
SELECT he.path, name AS symbol_name, '{kind}' AS symbol_type, he.i::INT AS line_start, (stop - 1)::INT AS line_end, string_agg(x, '' ORDER BY sl.i) AS content FROM he JOIN sl ON sl.path = he.path AND sl.i >= he.i AND sl.i < stop GROUP BY ALL
UNION ALL {_fallback('50', 'path NOT IN (SELECT path FROM he)')}"""


_INSTRUCTION = "'^(FROM|RUN|COPY|ADD|ENV|EXPOSE|WORKDIR|CMD|ENTRYPOINT|LABEL|ARG|VOLUME|USER|ONBUILD|HEALTHCHECK|SHELL)\\b'"
_INSTRUCTED = f"upper(regexp_extract(ltrim(x), {_INSTRUCTION}, 1, 'i'))"
_MD = f"WITH {_section_lines('markdown')}, {_starts("regexp_matches(x, '^#{1,6}[[:space:]]')", "trim(regexp_replace(x, '^#{1,6}[[:space:]]+', ''), chr(10) || ' ')", 'function')}"
_DOCKER = f"WITH {_section_lines('dockerfile')}, {_starts(_INSTRUCTED + " <> '' OR i = 1", "CASE WHEN " + _INSTRUCTED + " <> '' THEN " + _INSTRUCTED + " ELSE 'chunk_1' END", 'chunk')}"
_YAML = f"""
WITH {_section_lines('yaml')}, ky AS (SELECT path, (i - 1) // 30 AS b, arg_min(regexp_extract(x, '^([A-Za-z_][A-Za-z0-9_\\-]*):', 1), i) AS k FROM sl WHERE regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_\\-]*:') GROUP BY ALL)
SELECT sl.path, coalesce(any_value(k), 'chunk_' || min(i)) AS symbol_name, 'chunk' AS symbol_type, min(i)::INT AS line_start, max(i)::INT AS line_end, string_agg(x, '' ORDER BY i) AS content FROM sl LEFT JOIN ky ON ky.path = sl.path AND b = (i - 1) // 30 GROUP BY sl.path, (i - 1) // 30"""
_TOML = f"""
WITH {_section_lines('toml')}, he AS (
  SELECT path, i, x, regexp_extract(trim(x), '^\\[([^\\]]+)\\]', 1) AS t, regexp_extract(trim(x), '^([A-Za-z_][A-Za-z0-9_\\-]*)\\s*=', 1) AS k FROM sl
), ok AS (SELECT * FROM he WHERE t <> '' OR k <> '')
SELECT path, CASE WHEN t <> '' THEN t ELSE k END AS symbol_name, CASE WHEN t <> '' THEN 'function' ELSE 'variable' END AS symbol_type, i::INT AS line_start, i::INT AS line_end, x AS content FROM ok UNION ALL {_fallback('50', 'path NOT IN (SELECT path FROM ok)')}"""
_SIZE = "CASE language WHEN 'json' THEN 30 WHEN 'xml' THEN 40 WHEN 'text' THEN 20 ELSE 50 END"
_SIZED = f"WITH {_section_lines('json', 'xml', 'text', 'unknown')} SELECT path, 'chunk_' || min(i) AS symbol_name, 'chunk' AS symbol_type, min(i)::INT AS line_start, max(i)::INT AS line_end FROM sl GROUP BY path, (i - 1) // {_SIZE}"

# Changes.
_OPS = "CASE event_type " + " ".join(f"WHEN {quoted(k)} THEN {quoted('delete' if v == 'deleted' else 'upsert')}" for k, v in EVENT_OPS.items()) + " END"
_LAST = f"la AS (SELECT user_id::VARCHAR AS path, arg_max({_OPS}, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS op FROM events GROUP BY user_id)"
_APPLIED = f"""
WITH {_LAST}, k AS (SELECT doc_id::VARCHAR AS path, lang AS language, n_chars AS size, CASE WHEN text = '' THEN 0 ELSE (len(string_split(rtrim(text, chr(10)), chr(10))) + 49) // 50 END AS n FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT path FROM la))
SELECT path, language, size, n::BIGINT AS n_symbols FROM k UNION ALL SELECT path, 'text', 0, 0 FROM la WHERE op = 'upsert'"""
_REINDEXED = f"""
WITH {_LAST}, dx AS (
  SELECT doc_id, lang, CASE WHEN op = 'upsert' THEN 'changed' || chr(10) || text ELSE text END AS text, op FROM documents LEFT JOIN la ON la.path = doc_id::VARCHAR WHERE op IS NULL OR op = 'upsert'
), {LINES.replace("FROM documents)", "FROM dx)")}, {_chunks(50)}
SELECT ck.path, any_value(language) AS language, count(*) AS n_symbols, sum(length(content))::BIGINT AS n_chars, (CASE WHEN any_value(op) = 'upsert' THEN sum(length(content)) ELSE 0 END)::BIGINT AS embedded_chars FROM ck JOIN dx ON ck.path = dx.doc_id::VARCHAR GROUP BY ck.path"""
_LETTERS = "list_value(length(t) - length(replace(t, 'e', '')), length(t) - length(replace(t, 'n', '')), length(t) - length(replace(t, 'a', '')), length(replace(replace(replace(t, 'e', ''), 'n', ''), 'a', '')))::DOUBLE[]"
_EMBEDDED = f"""
WITH {SYM}, em AS (
  SELECT symbol_id, {_LETTERS} AS v FROM (SELECT symbol_id, symbol_name || ' ' || symbol_type || ' ' || content AS t FROM sy)
)
SELECT symbol_id, dim::INT AS dim, round((x / n)::FLOAT::DOUBLE, 4) AS value FROM (SELECT symbol_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim, greatest(sqrt(list_dot_product(v, v)), 1e-12::DOUBLE) AS n FROM em)"""
_MOVES = f"""
WITH ev AS (SELECT * FROM {values(X.FILE_EVENTS, 'event_id, op, path, dest_path, is_directory')}), st AS (
  SELECT event_id, 0 AS part, path, CASE op WHEN 'deleted' THEN 'delete' WHEN 'moved' THEN 'delete' ELSE 'upsert' END AS op FROM ev WHERE NOT is_directory AND op IN ('created', 'modified', 'deleted', 'moved')
  UNION ALL SELECT event_id, 1, dest_path, 'upsert' FROM ev WHERE op = 'moved'
)
SELECT path, arg_max(op, event_id * 2 + part) AS op FROM st WHERE NOT ({_SUFFIX} IN ({_list(WATCH_IGNORED_SUFFIXES)}) OR {_PARTS.format(dirs=_list((*WATCH_IGNORED_DIRS, '.lodestone')))}) GROUP BY path"""

_STATS = f"WITH {SYM} SELECT (SELECT count(*) FROM documents) AS file_count, (SELECT count(*) FROM sy) AS symbol_count"

ORACLE_SQL = {
    "chunk_lines_50": _chunk_query(50, "path || ':' || line_start || '-' || line_end"),
    "chunk_lines_30": _chunk_query(30, "'chunk_' || line_start"),
    "chunk_lines_20": _chunk_query(20, "'chunk_' || line_start"),
    "file_line_stats": f"WITH {LINES} SELECT doc_id::VARCHAR AS path, documents.lang AS language, n_chars AS size, count(i)::BIGINT AS n_lines FROM documents LEFT JOIN ln ON ln.path = doc_id::VARCHAR GROUP BY ALL",
    "file_scan": "SELECT 'src/.part' || (doc_id % 20) || '/' || doc_id || '.py' AS path, 'python' AS language, strlen(text)::BIGINT AS size, length(text)::BIGINT AS n_chars, md5(text) AS digest, 'ok' AS status FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0",
    "language_breakdown": "SELECT lang AS language, count(*) AS n_files FROM documents GROUP BY lang",
    "index_stats": _STATS,
    "structure_totals": _STATS.replace("AS symbol_count", "AS symbol_count, (SELECT (sum(length(content)) // 4)::BIGINT FROM sy) AS total_tokens_estimate"),
    "token_estimate": f"WITH {SYM} SELECT path, line_start, trunc({TOKENS} * 1.3::DOUBLE)::BIGINT AS tokens FROM sy",
    "savings_report": "SELECT count(*) AS file_count, count(*) * 2000 AS raw_tokens, greatest(0, count(*) * 2000 - 4000) AS saved_tokens, round(100 * greatest(0, count(*) * 2000 - 4000)::DOUBLE / (count(*) * 2000), 1) AS reduction FROM documents",
    "path_language": _PATH_LANGUAGE,
    "skip_predicate": _SKIP,
    "indexed_lookup": "SELECT DISTINCT o_orderkey::VARCHAR AS path, o_orderkey IN (SELECT doc_id FROM documents) AS indexed FROM orders",
    "file_symbols": f"WITH {SYM} SELECT path, row_number() OVER (PARTITION BY path ORDER BY line_start)::INT AS place, line_start, line_end FROM sy",
    **{name: _fts(*x) for name, x in _FTS.items()},
    "fts_near": _NEAR,
    # The forms that the steps of the algorithm reduce to "and" and to "hand".
    "fts_porter": _fts([f"regexp_matches(term, '^{w}(s|e|es|ed|eds|ing|ings|ness|ful)?$')" for w in ("and", "hand")], "true"),
    "porter_stems": f"SELECT word, expected AS stem FROM {values(X.STEMS, 'word, expected')}",
    "fts_top": _fts(*_FTS["fts_or"], tail=f"ORDER BY round(rank, {DIGITS}), path, line_start LIMIT {SEARCH_LIMIT}"),
    "fts_normalised": _NORMALISED,
    "fts_syntax": f"SELECT query, error FROM {values(X.QUERY_TEXTS, 'query, error')}",
    "lexical_fallback": _FALLBACK,
    "vec_l2_normalise": f"SELECT vec_id, (i - 1)::INT AS dim, round(x / nrm, {DIGITS}) AS value FROM (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i, sqrt(list_dot_product(e, e)) AS nrm FROM (SELECT vec_id, list_transform(embedding, lambda x: (x * 4)::FLOAT)::DOUBLE[] AS e FROM embeddings))",
    "vec_mean_pool": f"SELECT text, dim::INT AS dim, round(CASE WHEN sum(m) > 0 THEN sum(x * m) / sum(m) ELSE 0 END, {DIGITS}) AS value FROM (SELECT vec_id // 3 AS text, CASE WHEN vec_id % 4 = 1 THEN 0 ELSE 1 END AS m, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY ALL",
    "vec_cosine_pairs": f"SELECT a.vec_id, round({_DOT}, {DIGITS}) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "vec_topk": f"WITH {_TOPK} SELECT * FROM tk",
    "vec_topk_labels": f"WITH {_TOPK} SELECT query_id, label, count(*) AS n, round(max(score), {DIGITS}) AS best FROM tk JOIN embeddings ON vec_id = symbol_id GROUP BY ALL",
    "hybrid_search": _HYBRID_SEARCH,
    "classify_tasks": f"WITH {_explained(_TASKS)} SELECT query_id, v.* FROM ex JOIN {_SCOPES} USING (scope)",
    "explain_tasks": f"WITH {_explained(_TASKS)} SELECT query_id, scope_name, array_to_string(signals, '|') AS signals, reasoning FROM ex",
    "scope_limits": f"SELECT * FROM {_SCOPES}",
    "budget_cap": f"{_CAPPED} SELECT query_id::BIGINT AS query_id, path, line_start, tokens, round(combined_score, {DIGITS}) AS combined_score FROM cp",
    "top_files_symbols": f"{_CAPPED} SELECT query_id::BIGINT AS query_id, path, n_symbols, round(relevance_score, {DIGITS}) AS relevance_score, tokens FROM gr",
    "context_result": _CONTEXT,
    "context_markdown": _CONTEXT_MARKDOWN,
    "context_with_graph": _WITH_GRAPH,
    "search_markdown": _SEARCH_MARKDOWN,
    "expanded_markdown": _EXPANDED_MARKDOWN,
    "expand_context": f"WITH {SYM} SELECT path, 'unknown' AS language, count(*) AS n_symbols, sum(length(content))::BIGINT AS n_chars, 1.0::DOUBLE AS relevance_score FROM sy GROUP BY path",
    "call_sites": f"WITH {SYM} SELECT DISTINCT path, line_start, unnest(regexp_extract_all(content, '\\b([\\p{{L}}\\p{{N}}_]+)\\s*\\(', 1)) AS callee FROM sy",
    "call_nodes": f"WITH {_CODE} SELECT id, symbol_name, path AS file_path, line_start::INT AS line_start FROM co",
    "call_edges": f"WITH {_CODE} SELECT * FROM ed",
    "callers": _CALLERS,
    "callees": _CALLEES,
    "callers_markdown": _CALLERS_MARKDOWN,
    "import_refs": f"WITH {_IMPORTS} SELECT path, raw_import FROM im",
    "import_edges": f"WITH {_IMPORTS} SELECT * FROM ie",
    "deps": f"WITH {_IMPORTS} SELECT dst AS path FROM ie WHERE src = 'app/main.py'",
    "dependents": f"WITH {_IMPORTS} SELECT src AS path FROM ie WHERE dst = 'lib/util.py'",
    "deps_markdown": _DEPS_MARKDOWN,
    **{f"related_files_k{k}": _related(k) for k in (1, 2, 3)},
    "entry_points": f"WITH {_IMPORTS}, {_DEGREES} SELECT path FROM dg WHERE n = 0",
    "hotspots": f"WITH {_IMPORTS}, {_DEGREES} SELECT path AS file_path, n AS dependent_count FROM dg ORDER BY n DESC, path LIMIT 5",
    "graph_json": _GRAPH_JSON,
    "graph_loaded": f"WITH {_CODE} SELECT * FROM ed",
    "structure_report": _STRUCTURE,
    "stats_report": _STATS.replace("SELECT (SELECT count(*) FROM documents) AS file_count, (SELECT count(*) FROM sy) AS symbol_count", "SELECT '## lodestone stats' || chr(10) || chr(10) || '**Indexed files:** ' || (SELECT count(*) FROM documents) || chr(10) || '**Total symbols:** ' || (SELECT count(*) FROM sy) || chr(10) || '**DB size:** 0 KB' || chr(10) || '**Watcher:** stopped' AS markdown"),
    "md_sections": _MD,
    "yaml_chunks": _YAML,
    "toml_symbols": _TOML,
    "docker_blocks": _DOCKER,
    "sized_chunks": _SIZED,
    "html_document": "SELECT page_id::VARCHAR AS path, 'document' AS symbol_name, 'chunk' AS symbol_type, 1 AS line_start, len(string_split(rtrim(html, chr(10)), chr(10)))::INT AS line_end, length(html) AS n_chars FROM pages",
    "sql_symbols": _source_symbols("q.sql", "e.sql"),
    "py_symbols": _source_symbols("m.py", "bad.py"),
    "parsed_symbols": _source_symbols(),
    "cdc_latest_op": f"WITH {_LAST} SELECT * FROM la",
    "cdc_apply": _APPLIED,
    "cdc_reindex": _REINDEXED,
    "store_reindex": _REINDEXED,
    "embedded_symbols": _EMBEDDED,
    "cdc_moves": _MOVES,
    "listing_diff": "SELECT doc_id::VARCHAR AS path, 'upsert' AS op FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 UNION ALL SELECT 'gone', 'delete'",
    "upsert_replace": "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 3 THEN 'new' ELSE lang END AS language, n_chars AS size FROM documents UNION ALL SELECT 'new.py', 'python', 7",
    "remove_cascade": f"WITH {SYM} SELECT 'files' AS name, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'symbols', count(*) FROM sy WHERE path::BIGINT % 3 <> 0 UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id NOT IN (SELECT doc_id FROM documents)",
    "index_counts": "SELECT count(*) FILTER (o_orderkey % 9 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 5 <> 0)) AS indexed, count(*) FILTER (o_orderkey % 9 = 0) AS failed FROM orders",
    "log_tail": f"SELECT line_no::BIGINT AS line_no, value, CASE WHEN contains(value, 'ERROR') THEN 'error' WHEN contains(value, 'WARNING') THEN 'warning' WHEN contains(value, 'SUCCESS') OR contains(value, '✓') THEN 'success' ELSE 'other' END AS severity FROM {values(X.LOG, 'line_no, value')} WHERE line_no >= 2",
    "log_tail_by_source": "SELECT event_type AS source, event_id AS line_no, upper(event_type) || ' ' || props AS value, CASE WHEN contains(upper(event_type) || ' ' || props, 'ERROR') THEN 'error' ELSE 'other' END AS severity FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 5",
}
