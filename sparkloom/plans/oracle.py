"""The SQL that the registered queries are held against: views of the driver's tables, and each query's definition over them."""

from __future__ import annotations

from sparkloom.functions import exprs as X
from sparkloom.operators import ingest as I
from sparkloom.operators import packaging as K
from sparkloom.plans import query_plan as P

#: A string at a line's start, its single quotes doubled for SQL.
DOCSTRING = r"""regexp_extract(text_raw, '(?m)^\s*(?:\"\"\".*?\"\"\"|''''''.*?'''''')', 0, 's')""".replace('\\"', '"')
NOW = "2024-01-31 12:00:00"
SYMBOL = "The"
STRIP = "trim({0}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def strip(x: str) -> str:
    return STRIP.format(x)


def texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def half_up(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5e0) / 10"


EVENTS = "ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
CALLS = f"""{EVENTS}, calls AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'lookup' WHEN 'purchase' THEN 'map' WHEN 'signup' THEN 'context' WHEN 'error' THEN 'status' END AS tool,
 '/repo/' || (user_id % 10) AS repo_path, ts AS called_at, k * 7 AS duration_ms, CAST(floor(value) AS BIGINT) AS tokens_sent, CAST(floor(value) AS BIGINT) * (k % 10) AS tokens_raw,
 CASE user_id % 3 WHEN 0 THEN 'mcp' WHEN 1 THEN 'pi' END AS channel, CASE user_id % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'small' WHEN 2 THEN 'unknown' END AS model,
 event_type = 'view' AND k % 13 <> 0 AND k % 11 <> 0 AS told, k FROM ev)"""
SAVED = "CASE WHEN {raw} > 0 THEN " + half_up("100e0 * ({raw} - {sent}) / {raw}") + " END"
SUMS = "count(*) AS calls, CAST(sum(tokens_sent) AS BIGINT) AS sent, CAST(sum(tokens_raw) AS BIGINT) AS raw"
SAVED_SUMS = SAVED.format(raw="sum(tokens_raw)", sent="sum(tokens_sent)")
META = """CASE WHEN told THEN k % 9 END AS result_count, CASE WHEN told THEN k % 2 = 0 END AS truncated, CASE WHEN told THEN '{"lexical":' || k % 3 || ',"vector":' || k % 4 || ',"both":' || k % 5 || '}' END AS sources, CAST(NULL AS VARCHAR) AS timing, CAST(NULL AS VARCHAR) AS retrieval, CAST(NULL AS VARCHAR) AS packager, CAST(NULL AS VARCHAR) AS top_scores"""
PERIODS = [("today", "date_trunc('day', TIMESTAMP '{0}')"), ("week", "TIMESTAMP '{0}' - INTERVAL 7 DAYS"), ("month", "TIMESTAMP '{0}' - INTERVAL 30 DAYS"), ("all", "TIMESTAMP '0001-01-01'")]


def hinted(parts: str) -> str:
    return f"(len({parts}) BETWEEN 2 AND 5 AND len(list_filter({parts}, lambda p: lower(p) IN ({texts(X.SYMBOL_WORDS)}))) > 0)"


def pascal(parts: str) -> str:
    return f"array_to_string(list_transform({parts}, lambda p: upper(p[1:1]) || lower(p[2:])), '')"


def symbol_of_path(p: str) -> str:
    base = rf"regexp_replace(string_split({p}, '/')[-1], '(?i)(\.d)?\.[^.]+$', '')"
    compact = f"regexp_replace({base}, '[^a-zA-Z0-9]', '', 'g')"
    parts = f"list_filter(regexp_split_to_array({base}, '[-_.]+'), lambda x: x <> '')"
    return f"CASE WHEN lower({base}) IN ({texts(X.GENERIC_NAMES)}) OR length({compact}) < 3 THEN NULL WHEN regexp_matches({base}, '[A-Z]') THEN {compact} WHEN {hinted(parts)} THEN {pascal(parts)} END"


def symbol_of(v: str) -> str:
    tail = f"regexp_replace(coalesce(list_filter(string_split(trim({v}), '.'), lambda x: x <> '')[-1], trim({v})), '[^a-zA-Z0-9_-]', '', 'g')"
    parts = f"list_filter(regexp_split_to_array({tail}, '[-_]+'), lambda x: x <> '')"
    own = f"CASE WHEN length({tail}) < 3 THEN NULL WHEN regexp_matches({tail}, '[A-Z]') THEN regexp_replace({tail}, '[^a-zA-Z0-9]', '', 'g') WHEN {hinted(parts)} THEN {pascal(parts)} END"
    return rf"CASE WHEN trim({v}) = '' THEN NULL WHEN contains({v}, '/') OR regexp_matches(trim({v}), '(?i)\.[a-z0-9]+$') THEN {symbol_of_path(f'trim({v})')} ELSE {own} END"


REGEX_LIKE = r"(regexp_matches({0}, '[\[\]{{}}()^$|\\]') OR contains({0}, '.*') OR contains({0}, '.+'))"
CODE = f"(contains(string_split(path, '/')[-1], '.') AND string_split(lower(path), '.')[-1] IN ({texts(X.CODE_EXTENSIONS)}))"
SHORT = r"CASE WHEN regexp_matches(tool, '^mcp__.*__(?:engine_)?.+$') THEN regexp_extract(tool, '^mcp__.*__(?:engine_)?(.+)$', 1) WHEN starts_with(tool, 'pi:engine_') THEN tool[11:] WHEN starts_with(tool, 'pi:') THEN upper(tool[4:4]) || tool[5:] ELSE tool END"
PAYLOADS = f"""{EVENTS}, payloads AS (SELECT user_id AS sid, event_id AS seq, date_trunc('hour', ts) AS t,
 CASE event_type WHEN 'view' THEN CASE k % 6 WHEN 0 THEN 'mcp__engine__engine_status' WHEN 1 THEN 'mcp__engine__map' ELSE 'mcp__engine__engine_search' END WHEN 'click' THEN CASE WHEN k % 10 = 0 THEN 'pi:read' ELSE 'Read' END
  WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'Glob' ELSE 'Grep' END WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'pi:engine_lookup' ELSE 'mcp__my_engine__source' END WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 'pi:edit' ELSE 'Bash' END END AS tool,
 CASE WHEN (event_type = 'click' AND k % 9 > 0) OR (event_type = 'purchase' AND k % 3 = 0) THEN 'src/' || CASE k % 5 WHEN 0 THEN 'UserStore' WHEN 1 THEN 'index' WHEN 2 THEN 'user-store' ELSE 'f' || k END || CASE k % 7 WHEN 0 THEN '.kt' WHEN 1 THEN '.md' WHEN 2 THEN '' WHEN 3 THEN '.D.TS' WHEN 4 THEN '.py' WHEN 5 THEN '.' ELSE '.sql' END END AS path,
 CASE WHEN event_type IN ('view', 'purchase') AND k % 8 > 0 THEN CASE k % 6 WHEN 0 THEN 'UserStore' WHEN 1 THEN 'how it works' WHEN 2 THEN 'a.*b' WHEN 3 THEN 'user_store' WHEN 4 THEN '**/*.kt' ELSE 'token' END END AS query,
 CASE WHEN event_type = 'signup' AND k % 3 > 0 THEN 'S' || k % 4 END AS symbol, CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN 'c' || k END AS chunk_id, CASE WHEN k % 17 = 0 THEN k END AS start, CASE WHEN k % 19 = 0 THEN 20::BIGINT END AS most FROM ev)"""
SEEN = f"""{PAYLOADS}, marked AS (SELECT *, {CODE} AS is_code, CASE WHEN regexp_matches(tool, '{X.ENGINE}') THEN 'engine' WHEN regexp_matches(tool, '{X.NATIVE}') THEN 'native' WHEN regexp_matches(tool, '{X.ADMIN}') THEN 'admin' ELSE 'other' END AS category, {SHORT} AS short FROM payloads),
seen0 AS (SELECT *, CASE WHEN short IN ('Grep', 'Glob') THEN query END AS selector, CASE WHEN category <> 'native' THEN NULL WHEN tool = 'Read' AND NOT is_code THEN 'non_code_file' WHEN tool = 'Grep' AND {REGEX_LIKE.format('query')} AND path IS NOT NULL THEN 'known_path_regex' END AS reason_code,
 last_value(CASE WHEN category = 'engine' THEN {{'t': t, 'short': short}} END IGNORE NULLS) OVER w AS e, last_value(CASE WHEN category = 'native' THEN t END IGNORE NULLS) OVER w AS n,
 last_value(CASE WHEN category = 'engine' AND short = 'search' THEN query END IGNORE NULLS) OVER w AS last_query, last_value(CASE WHEN category = 'engine' AND short <> 'search' THEN symbol END IGNORE NULLS) OVER w AS last_symbol, last_value(CASE WHEN category = 'engine' AND short = 'source' THEN chunk_id END IGNORE NULLS) OVER w AS last_chunk
 FROM marked WINDOW w AS (PARTITION BY sid ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
seen AS (SELECT *, CASE WHEN short = 'Read' AND is_code AND e IS NOT NULL AND (n IS NULL OR n < e.t) THEN e.short END AS guided_by, category = 'native' AND short = 'Read' AND coalesce(is_code, false) AS code_read FROM seen0)"""
EXACT_GREP = f"(NOT regexp_matches(query, '\\s') AND NOT {REGEX_LIKE.format('query')} AND {symbol_of('query')} IS NOT NULL)"
GLOB = r"regexp_replace(coalesce(query, path), '[*?\[\]{}]', '', 'g')"
DECIDED = SEEN + rf""", decided AS (SELECT sid, seq, t, tool, guided_by, CASE tool WHEN 'Grep' THEN CASE WHEN query IS NULL THEN 'discovery' WHEN {EXACT_GREP} THEN 'symbol' WHEN regexp_matches(query, '\s') THEN 'concept' ELSE 'discovery' END
  WHEN 'Glob' THEN CASE WHEN coalesce(query, path) IS NULL OR {symbol_of(GLOB)} IS NULL THEN 'structure' ELSE 'symbol' END ELSE coalesce('after_' || guided_by, CASE WHEN {symbol_of_path('path')} IS NOT NULL THEN 'symbol' END, 'discovery') END AS hint,
 CASE tool WHEN 'Grep' THEN CASE WHEN {EXACT_GREP} THEN {symbol_of('query')} END WHEN 'Glob' THEN {symbol_of(GLOB)} ELSE {symbol_of_path('path')} END AS symbol
 FROM seen WHERE reason_code IS NULL AND CASE tool WHEN 'Grep' THEN NOT coalesce({REGEX_LIKE.format('query')} AND path IS NOT NULL, false) WHEN 'Glob' THEN coalesce(query, path) IS NULL OR regexp_matches(coalesce(query, path), '[*?\[\]{{}}]') WHEN 'Read' THEN coalesce(is_code, false) ELSE false END)"""
SIDES = [
    ("engine_tool", "CASE WHEN category = 'engine' THEN short END"), ("native_tool", "CASE WHEN category = 'native' THEN short END"), ("other_tool", "CASE WHEN category IN ('admin', 'other') THEN short END"),
    ("guided_by", "CASE WHEN code_read THEN guided_by END"), ("blind_path", "CASE WHEN code_read AND guided_by IS NULL THEN path END"),
    ("extension", r"CASE WHEN NOT code_read THEN NULL WHEN coalesce(path, '') = '' THEN '(unknown)' WHEN ends_with(lower(path), '.d.ts') THEN '.d.ts' WHEN NOT contains(string_split(path, '/')[-1], '.') THEN '(no ext)' ELSE '.' || string_split(lower(path), '.')[-1] END"),
    ("grep_selector", "CASE WHEN category = 'native' AND short = 'Grep' THEN selector END"), ("glob_selector", "CASE WHEN category = 'native' AND short = 'Glob' THEN selector END"), ("reason", "CASE WHEN category = 'native' THEN reason_code END"),
]
COVERAGE = SEEN + ", sides AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {v} AS value, guided_by IS NOT NULL AS led FROM seen" for d, v in SIDES) + "), coverage AS (SELECT dimension, value, count(*) AS n, count(*) FILTER (led) AS guided FROM sides WHERE value IS NOT NULL GROUP BY ALL)"

LANG = "CASE lang WHEN 'de' THEN '{0}' WHEN 'en' THEN '{1}' WHEN 'es' THEN '{2}' WHEN 'fr' THEN '{3}' END"
FILES = f"files AS (SELECT doc_id, '/repo/' || doc_id % 10 AS repo_path, source || '/src/main/' || doc_id || {LANG.format('.kt', '.ts', '.py', '.xml')} AS path, text AS content, {LANG.format('kotlin', 'typescript', 'python', 'xml')} AS language, ':' || source AS module FROM documents)"
MEMBER = [
    (r"^(private )?va[lr] ", True, None), (r"^\s*(override\s+)?(suspend\s+)?fun\s+", False, r"\{.*$"), (r"^\s*(public|private|protected|readonly|static)\s+\w+\s*[?:]", False, None),
    (r"^\s*(public|private|protected|static|async)\s+\w+\s*\(", False, r"\{.*$"), (r"^\s*self\.\w+\s*=", False, None), (r"^\s*(async\s+)?def\s+\w+", False, ":.*$"),
]


def _member(x: str) -> str:
    cut = lambda at: strip(f"regexp_replace({strip(x)}, '{at}', '')")
    parts = [f"CASE WHEN regexp_matches({strip(x) if plain else x}, '{pattern}') THEN {cut(at) if at else strip(x)}{' || CASE WHEN contains(' + x + chr(44) + chr(39) + ':' + chr(39) + ') THEN ' + chr(39) + ':' + chr(39) + ' ELSE ' + chr(39) + chr(39) + ' END' if at == ':.*$' else ''} END" for pattern, plain, at in MEMBER]
    field = rf"CASE WHEN regexp_matches({x}, '^\s*(final|late|static|const)\s+\w+[\w<>,?\s]*\s+\w+\s*[;=]') THEN {strip(x)} END"
    method = rf"CASE WHEN regexp_matches({x}, '^\s*(@\w+\s+)*(static\s+)?\w+[<\w>,?\s]*\s+\w+\s*\(') AND NOT regexp_matches({strip(x)}, '^(if|for|while|return)') THEN {strip(f"regexp_replace({strip(f'regexp_replace({strip(x)}, {chr(39)}' + r'\{.*$' + f'{chr(39)}, {chr(39)}{chr(39)})')}, '=>.*$', '')")} END"
    parts[4:4] = [field, method]
    return f"list_filter([{', '.join(parts)}], lambda m: m IS NOT NULL)"


def _skeleton() -> str:
    own = f"list_filter(plain, lambda t: t NOT IN ('{{', '}}', '') AND NOT starts_with(t, 'export '))"
    chosen = (
        f"CASE WHEN kind IN ('class', 'object', 'viewmodel', 'dataclass', 'mixin', 'extension') THEN flatten(list_transform(ls, lambda x: {_member('x')})) WHEN kind = 'interface' THEN list_filter({own}, lambda t: NOT starts_with(t, 'interface ') AND regexp_matches(t, '^[\\w\\[]'))"
        f" WHEN kind = 'enum' THEN list_filter({own}, lambda t: NOT starts_with(t, 'enum ') AND regexp_matches(t, '^\\w+\\s*(=|,|$)')) WHEN kind IN ('api_interface', 'dao') THEN list_filter(plain, lambda t: regexp_matches(t, '^(@\\w+|suspend\\s+fun|fun\\s+)'))"
        " WHEN kind = 'entity' THEN list_filter(plain, lambda t: regexp_matches(t, '^(va[lr] |@ColumnInfo|@PrimaryKey)')) END"
    )
    return f"array_to_string(list_transform({chosen}, lambda x: '  ' || x), chr(10))"


def truncated(x: str, budget: int) -> str:
    return f"CASE WHEN length({x}) <= {budget * 4} THEN {x} ELSE substr({x}, 1, {budget * 4}) || chr(10) || '... (truncated)' END"


#: A function's first declaring line, where it has no signature.
UNSIGNED = rf"CASE WHEN kind IN ('function', 'method', 'composable', 'di_provider') AND coalesce(signature, '') = '' THEN coalesce(list_transform(list_filter(ls, lambda x: regexp_matches(x, '\b(fun|def)\s+')), lambda x: CASE WHEN regexp_matches(x, '\bfun\s+') THEN {strip(f"regexp_replace({strip('x')}, '{chr(92)}{{.*$', '')")} ELSE {strip(f"regexp_replace({strip('x')}, ':.*$', ':')")} END)[1], {strip('ls[1]')}) END"
CHUNKS = rf"""{FILES}, cut AS (SELECT * EXCLUDE (content), unnest(range(0, len(string_split(content, chr(10))), 5)) AS pos0, string_split(content, chr(10)) AS all_ls FROM files),
pieces AS (SELECT * EXCLUDE (all_ls), all_ls[pos0 + 1:pos0 + 5] AS ls, array_to_string(all_ls[pos0 + 1:pos0 + 5], chr(10)) AS text_raw, CAST(pos0 + 1 AS BIGINT) AS start_line, CAST(pos0 + len(all_ls[pos0 + 1:pos0 + 5]) AS BIGINT) AS end_line FROM cut),
named AS (SELECT *, substr(sha256(text_raw), 1, 16) AS content_hash, nullif(regexp_extract(text_raw, '([A-Za-z]+)', 1), '') AS symbol_name, 'main' AS source_set, [{texts(("class", "function", "interface", "enum", "viewmodel", "dao", "generic_block"))}][length(text_raw) % 7 + 1] AS kind,
 nullif(substr(trim(string_split(text_raw, chr(10))[1]), 1, 60), '') AS signature, list_filter([language, CASE WHEN length(text_raw) > 400 THEN 'Long' END, CASE WHEN contains(text_raw, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS tags,
 list_filter(regexp_extract_all(text_raw, '@[A-Za-z0-9.]+'), lambda x, i: list_position(regexp_extract_all(text_raw, '@[A-Za-z0-9.]+'), x) = i) AS annotations, list_sort(list_distinct(regexp_extract_all(text_raw, '[A-Z][a-z]{{5,}}'))) AS uses, list_transform(ls, lambda x: {strip('x')}) AS plain FROM pieces WHERE length(trim(text_raw)) > 0),
docd AS (SELECT *, regexp_extract(text_raw, '/\*\*.*?\*/', 0, 's') AS block_doc, {strip(DOCSTRING)} AS string_doc,
 regexp_replace(regexp_extract(chr(10) || array_to_string(plain, chr(10)), '\n((?://[/!][^\n]*(?:\n|$))+)', 1), '\n$', '') AS run_doc FROM named),
sketched AS (SELECT *, concat_ws(chr(10), nullif(array_to_string(annotations, ' '), ''), signature, nullif(CASE WHEN block_doc <> '' THEN block_doc WHEN string_doc <> '' THEN string_doc ELSE run_doc END, ''), nullif({UNSIGNED}, ''), nullif({_skeleton()}, '')) AS short FROM docd),
chunks AS (SELECT substr(sha256(path || ':' || start_line || ':' || end_line || ':' || content_hash), 1, 24) AS id, doc_id, repo_path, path, module, source_set, language, kind, symbol_name, concat_ws('.', substr(module, 2), symbol_name) AS symbol_fqname, signature, start_line, end_line, text_raw, tags, annotations, uses, content_hash,
 CASE WHEN {strip('short')} <> '' THEN {truncated('short', 200)} ELSE {truncated('text_raw', 200)} END AS text_sketch FROM sketched)"""
TERMS = rf"list_filter(regexp_split_to_array(translate(lower({{0}}), '{X.ACCENTED}', '{X.PLAIN}'), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda x: x <> '')"
TERM_ROWS = CHUNKS + f""", words AS (SELECT id, unnest({TERMS.format("concat_ws(' ', symbol_name, symbol_fqname, text_raw, path, array_to_string(tags, ' '))").replace("{{", "{").replace("}}", "}")}) AS term FROM chunks),
lens AS (SELECT id, count(*) AS len FROM words GROUP BY id), postings AS (SELECT term, id, len, count(*) AS tf FROM words JOIN lens USING (id) GROUP BY ALL), stats AS (SELECT count(*)::DOUBLE AS total, avg(len) AS avgdl FROM lens)"""
SEARCHES = "searches AS (SELECT conv_id * 1000 + turn AS qid, text AS query, embedding FROM conversations LEFT JOIN embeddings ON vec_id = conv_id WHERE conv_id % 50 = 0)"


def once(x: str) -> str:
    """Each item of a list at its first place."""
    return f"list_filter({x}, lambda item, place: list_position({x}, item) = place)"


def table(values: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': [{texts(v if isinstance(v, list) else [v])}]" for k, v in values.items()) + "}"


def plan_of(source: str) -> str:
    camel = P.CAMEL
    return rf"""q0 AS (SELECT qid, coalesce(query, '') AS query FROM {source}),
q1 AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(query, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^a-zA-Z0-9\s]', ' ', 'g')), '\s+'), lambda x: length(x) >= 2) AS raw0,
 trim(query) <> '' AND (NOT regexp_matches(trim(query), '\s') OR regexp_matches(query, '{camel}') OR regexp_matches(query, '[./_-]')) AS identifier_like,
 list_filter(list_transform(regexp_split_to_array(query, '\s+'), lambda x: regexp_replace(x, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g')), lambda x: regexp_matches(x, '^[a-zA-Z0-9]+$') OR regexp_matches(x, '{camel}')) AS ex0 FROM q0),
q2 AS (SELECT qid, query, identifier_like, {once('raw0')} AS raw, CASE WHEN identifier_like THEN list_filter(list_transform(ex0, lambda x: lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g'))), lambda x: length(x) >= 3) ELSE [] END AS ex1 FROM q1),
q3 AS (SELECT qid, query, identifier_like, CASE WHEN len(list_filter(raw, lambda x: x NOT IN ({texts(P.STOP_WORDS)}))) > 0 THEN list_filter(raw, lambda x: x NOT IN ({texts(P.STOP_WORDS)})) ELSE raw END AS terms, {once('ex1')} AS exact FROM q2),
q4 AS (SELECT *, flatten(list_transform(list_concat(terms, exact), lambda x: list_concat(list_filter([CASE WHEN length(x) <= 3 THEN NULL WHEN ends_with(x, 'ies') AND length(x) > 4 THEN x[:length(x) - 3] || 'y' WHEN ends_with(x, 'sses') AND length(x) > 5 THEN x[:length(x) - 2] WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN x[:length(x) - 1] END], lambda y: y IS NOT NULL), coalesce({table(P.ALIASES)}[x], [])))) AS more FROM q3),
q5 AS (SELECT * EXCLUDE (more), list_filter({once('more')}, lambda x: length(x) >= 2 AND NOT list_contains(terms, x) AND NOT list_contains(exact, x))[1:{P.EXPANSIONS}] AS expansions FROM q4),
q6 AS (SELECT *, list_concat(exact, terms, expansions) AS everything, list_concat(terms, expansions) AS hinting, list_concat(exact, terms) AS both0, list_transform(list_sort(list_transform(terms, lambda x: {{'n': -length(x), 't': x}})), lambda y: y.t)[1:{P.CORE_TERMS}] AS core FROM q5),
q7 AS (SELECT *, flatten(list_filter(list_transform({once('hinting')}, lambda x: {table(P.LANGUAGE_HINTS)}[x]), lambda y: y IS NOT NULL)) AS lh, flatten(list_filter(list_transform({once('hinting')}, lambda x: {table(P.KIND_HINTS)}[x]), lambda y: y IS NOT NULL)) AS kh FROM q6),
plan AS (SELECT qid, query, identifier_like, terms, exact, expansions, ({once('everything')})[1:{P.LIKE_TERMS}] AS like_terms, {once('lh')} AS languages, {once('kh')} AS kinds, CASE WHEN len(core) > 1 THEN core ELSE [] END AS strict, ({once('both0')})[1:{P.BROAD_TERMS}] AS broad FROM q7)"""


VARIANTS = "variants AS (" + " UNION ALL ".join(f"SELECT qid, '{n}' AS name, {P.WEIGHTS[n]}e0 AS weight, {c} AS vterms, {'len(strict)' if n == 'strict' else '1'} AS least FROM plan WHERE len({c}) > 0" for n, c in (("exact", "exact"), ("strict", "strict"), ("broad", "broad"), ("expanded", "expansions"))) + ")"
BM25 = (
    TERM_ROWS.replace("WITH ", "") + f""", {SEARCHES}, {plan_of('searches')}, {VARIANTS}, wanted AS (SELECT qid, name, weight, least, unnest(vterms) AS term FROM variants), df AS (SELECT term, count(*) AS df FROM postings WHERE term IN (SELECT term FROM wanted) GROUP BY term),
bm AS (SELECT qid, name, weight, least, id, round(sum(greatest(ln((total - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / avgdl))), 6) AS score, count(*) AS matched FROM wanted JOIN df USING (term) JOIN postings USING (term), stats GROUP BY ALL HAVING count(*) >= least)"""
)


def _points(terms: str, s: str, p: str, g: str) -> str:
    return f"coalesce(list_sum(list_transform({terms}, lambda x: {s} + CASE WHEN contains(p, x) THEN {p} ELSE 0 END + CASE WHEN contains(g, x) THEN {g} ELSE 0 END)), 0)"


SYMBOLS = f""", low AS (SELECT id, path, start_line, kind, language, module, tags, lower(coalesce(symbol_name, '')) AS s, lower(path) AS p, lower(coalesce(signature, '')) AS g FROM chunks),
symbols AS (SELECT qid, id, path, start_line, CAST({_points('exact', "CASE WHEN s = x THEN 90 WHEN contains(s, x) THEN 50 ELSE 0 END", '40', '35')} + {_points('terms', "CASE WHEN contains(s, x) THEN 14 ELSE 0 END", '10', '8')} + {_points('expansions', "CASE WHEN contains(s, x) THEN 8 ELSE 0 END", '6', '5')}
 + CASE WHEN list_contains(kinds, lower(kind)) THEN 6 ELSE 0 END + CASE WHEN list_contains(languages, lower(language)) THEN 5 ELSE 0 END AS BIGINT) AS score FROM low, plan WHERE {{where}} len(list_filter(like_terms, lambda x: contains(s, x) OR contains(p, x) OR contains(g, x))) > 0)"""


def lexical(limit: int, where: str = "") -> str:
    each = max(2 * limit, 12)
    return (
        BM25 + SYMBOLS.replace("{where}", where and f"{where} AND") + f""", hits AS (SELECT qid, id, path, name, weight / (6 + row_number() OVER (PARTITION BY qid, name ORDER BY score DESC, id)) AS part, row_number() OVER (PARTITION BY qid, name ORDER BY score DESC, id) AS r FROM bm JOIN (SELECT id, path FROM chunks {where and 'WHERE ' + where}) USING (id)),
sym AS (SELECT qid, id, path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path, start_line) AS r FROM symbols), parts AS (SELECT qid, id, path, name, part FROM hits WHERE r <= {each} UNION ALL SELECT qid, id, path, 'symbol_path', {P.WEIGHTS['symbol_path']}e0 / (5 + r) + least(0.08e0, score / 1000) FROM sym WHERE r <= {each}),
fused AS (SELECT qid, id, path, round(sum(part), 9) AS score, count(*) AS n_variants, string_agg(name, ',' ORDER BY name) AS variants FROM parts GROUP BY qid, id, path),
lexical AS (SELECT qid, id, score, n_variants, variants, row_number() OVER (PARTITION BY qid ORDER BY score DESC, n_variants DESC, path, id) AS rank FROM fused QUALIFY rank <= {limit})"""
    )


def vector(limit: int, where: str = "", tags: str = "") -> str:
    return f""", near0 AS (SELECT s.qid, c.id, c.tags, round(list_distance(s.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance FROM searches s, chunks c JOIN embeddings e ON e.vec_id = c.doc_id WHERE s.embedding IS NOT NULL {where and 'AND ' + where}),
near1 AS (SELECT * FROM near0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= {limit}), vec AS (SELECT qid, id, distance, round(1 - distance, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM near1 {tags and 'WHERE ' + tags})"""


RRF = """, rrf AS (SELECT coalesce(l.qid, v.qid) AS qid, coalesce(l.id, v.id) AS id, round(coalesce(1e0 / (60 + l.rank), 0) + coalesce(1e0 / (60 + v.rank), 0), 9) AS rrf, CASE WHEN l.id IS NULL THEN 'vector' WHEN v.id IS NULL THEN 'lexical' ELSE 'both' END AS source, l.rank AS left_rank, v.rank AS right_rank, coalesce(variants, '') AS variants FROM lexical l FULL JOIN vec v ON l.qid = v.qid AND l.id = v.id)"""
SQUEEZE = "lower(regexp_replace({0}, '[^a-zA-Z0-9]', '', 'g'))"
_RULES = [
    ("exact_symbol", "named AND sym = wanted", "0.036e0"), ("symbol_match", "named AND sym <> wanted AND contains(sym, wanted)", "0.02e0"), ("basename_match", "named AND starts_with(base, wanted)", "0.026e0"),
    ("path_match", "named AND NOT starts_with(base, wanted) AND contains(whole, wanted)", "0.02e0"), ("signature_match", "named AND NOT starts_with(base, wanted) AND NOT contains(whole, wanted) AND contains(sig, wanted)", "0.016e0"),
    ("header_overlap", "nh > 0", "least(0.018e0, nh * 0.0045e0)"), ("all_terms_in_header", "nh = len(terms) AND len(terms) > 1", "0.008e0"), ("body_overlap", "nb > 0", "least(0.009e0, nb * 0.0025e0)"), ("expanded_overlap", "ne > 0", "least(0.006e0, ne * 0.0015e0)"),
    ("kind_hint", "list_contains(kinds, lower(kind))", "0.007e0"), ("language_hint", "list_contains(languages, lower(language))", "0.007e0"), ("source_consensus", "source = 'both'", "0.004e0"),
    ("lexical_exact", "list_contains(string_split(variants, ','), 'exact')", "0.006e0"), ("symbol_path_hit", "list_contains(string_split(variants, ','), 'symbol_path')", "0.006e0"),
]
RERANK = (
    RRF + f""", wide AS (SELECT r.*, path, kind, language, terms, expansions, kinds, languages, lower(concat_ws(' ', coalesce(symbol_name, ''), coalesce(signature, ''), string_split(path, '/')[-1], path, kind, language, nullif(array_to_string(tags, ' '), ''), nullif(array_to_string(uses, ' '), ''))) AS head, lower(text_raw) AS body,
 {SQUEEZE.format('query')} AS wanted, {SQUEEZE.format("coalesce(symbol_name, '')")} AS sym, {SQUEEZE.format("string_split(path, '/')[-1]")} AS base, {SQUEEZE.format('path')} AS whole, {SQUEEZE.format("coalesce(signature, '')")} AS sig, identifier_like FROM rrf r JOIN chunks USING (id) JOIN plan USING (qid)),
judged AS (SELECT *, identifier_like AND length(wanted) >= 3 AS named, len(list_filter(terms, lambda x: contains(head, x))) AS nh, len(list_filter(terms, lambda x: NOT contains(head, x) AND contains(body, x))) AS nb, len(list_filter(expansions, lambda x: contains(head, x) OR contains(body, x))) AS ne FROM wide),
scored AS (SELECT *, round(least(0.09e0, 0e0 + {' + '.join(f'CASE WHEN {t} THEN {p} ELSE 0e0 END' for _, t, p in _RULES)}), 9) AS bonus, concat_ws(',', {', '.join(f"CASE WHEN {t} THEN '{n}' END" for n, t, _ in _RULES)}) AS reasons FROM judged),
reranked AS (SELECT qid, id, rrf, source, left_rank, right_rank, variants, path, bonus, reasons, round(rrf + bonus, 9) AS final FROM scored)"""
)


def hybrid(most: int = 8, where: str = "") -> str:
    return lexical(3 * most, where) + vector(3 * most, where) + RERANK + f""", hybrid AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, rrf DESC, (source = 'both') DESC, path, id) AS rank FROM reranked QUALIFY rank <= {most})"""


HIGHLIGHT = f"""list_transform(list_sort(list_transform({{best}}, lambda x: {{{{'at': x.at, 'line': x.line}}}})), lambda x: x.line)"""
LINES = f"list_filter(list_transform(string_split(text_raw, chr(10)), lambda x: {strip('x')}), lambda x: x NOT IN ('', '{{', '}}'))"


def highlighted(source: str) -> str:
    """CTEs h1 to h3: the rows of ``source`` (with text_raw, signature, terms) and their highlights."""
    return f"""h1 AS (SELECT *, list_sort(list_transform({LINES}, lambda x, i: {{'n': -(coalesce(list_sum(list_transform(terms, lambda y: CASE WHEN lower(x) = y THEN 4 WHEN contains(lower(x), y) THEN 2 ELSE 0 END)), 0) + CASE WHEN x = {strip('signature')} THEN 3 ELSE 0 END), 'at': i, 'line': x}}))[1:{K.HIGHLIGHTS}] AS best FROM {source}),
h2 AS (SELECT * REPLACE (CASE WHEN len(list_filter(best, lambda x: x.n < 0)) > 0 THEN list_filter(best, lambda x: x.n < 0) ELSE best END AS best) FROM h1), h3 AS (SELECT * EXCLUDE (best), list_transform(list_sort(list_transform(best, lambda x: {{'at': x.at, 'line': x.line}})), lambda x: x.line) AS highlights FROM h2)"""


def packed(view: str, most: int) -> str:
    own = f"list_filter(highlights, lambda x: x IS DISTINCT FROM {strip('signature')})"
    body = f"CASE WHEN len({own}) > 0 THEN array_to_string(list_transform({own}, lambda x: '  ' || x), chr(10)) ELSE {strip('text_sketch')} END"
    impl = f"concat_ws(chr(10), nullif(array_to_string(annotations, ' '), ''), nullif(signature, ''), nullif({body}, ''), CASE WHEN len(uses) > 0 THEN 'Uses: ' || array_to_string(uses, ', ') END)"
    snippet = {"raw": "text_raw", "sketch": "text_sketch", "implementation": truncated("impl", K.IMPLEMENTATION_TOKENS)}[view]
    shown = "to_json({'id': id, 'path': path, 'lines': start_line || '-' || end_line, 'symbolName': symbol_name, 'kind': kind, 'source': source, 'snippet': snippet, 'module': module, 'language': language, 'signature': signature})"
    listed = lambda c: f"CASE WHEN len({c}) > 0 THEN length(to_json({c})::VARCHAR) + {len(c) + 4} ELSE 0 END"
    return (
        hybrid(most) + f""", got AS (SELECT h.qid, h.rank, h.final, h.source, c.* EXCLUDE (uses), c.uses[1:{K.USES}] AS uses, terms FROM hybrid h JOIN chunks c USING (id) JOIN plan p ON p.qid = h.qid), spread AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY rank) AS place FROM got QUALIFY place <= {K.VIEWS[view][2]}),
{highlighted('spread')}, h4 AS (SELECT *, {impl} AS impl FROM h3), h5 AS (SELECT *, {snippet} AS snippet FROM h4), packed AS (SELECT qid, id, path, rank, snippet, highlights, CAST(ceil((length({shown}::VARCHAR) + 11 + length(regexp_replace(CAST(floor(final * 10000 + 0.5e0) AS BIGINT)::VARCHAR, '0+$', '')) + {listed('uses')} + {'0' if view == 'raw' else listed('highlights')}) / 4e0) AS BIGINT) AS tokens FROM h5),
fits AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS used FROM packed)"""
    )


KNN = """kq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), kv AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
knn AS (SELECT qid, id, round({distance}, 6) AS distance, round(1 - round({distance}, 6), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round({distance}, 6), id) AS rank FROM kv, kq {more} QUALIFY rank <= 10)"""
JUDGED = f""", judged0 AS (SELECT qid AS query, e.vec_id AS item, 1 + e.vec_id % 3 AS gain, l.label FROM kq JOIN embeddings l ON l.vec_id = qid JOIN embeddings e ON e.label = l.label WHERE e.vec_id <> qid), ideal AS (SELECT query, sum(gain / log2(p + 1)) AS idcg FROM (SELECT query, gain, row_number() OVER (PARTITION BY query ORDER BY gain DESC, item) AS p FROM judged0) WHERE p <= 5 GROUP BY query),
found AS (SELECT query, coalesce(1e0 / min(rank), 0) AS mrr, count(*) FILTER (rank <= 5) AS hits, count(*) AS relevant, coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= 5), 0) AS dcg FROM judged0 LEFT JOIN knn ON qid = query AND id = item GROUP BY query),
metrics AS (SELECT query, round(mrr, 6) AS mrr, round(dcg / idcg, 6) AS ndcg, round(hits / 5e0, 6) AS precision, round(hits::DOUBLE / relevant, 6) AS recall FROM found JOIN ideal USING (query))"""
IGNORED = f"(list_has_any(string_split(path, '/'), [{texts(I.IGNORED_DIRS)}]) OR string_split(path, '/')[-1] IN ({texts([*I.IGNORED_FILES, *I.SECRET_FILES])}) OR (contains(substr(string_split(path, '/')[-1], 2), '.') AND '.' || string_split(lower(path), '.')[-1] IN ({texts([*I.IGNORED_EXTENSIONS, *I.SECRET_EXTENSIONS])})) OR starts_with(string_split(path, '/')[-1], '.env'))"


def spans(most: int) -> str:
    """CTEs spans (path, first, last) and text_rows (path, start_line, end_line, text_raw, plain) of the files' chunks of lines; ``files`` has path and content. Recursive."""
    bounds = f"list_filter(range(len(ls)), lambda i: regexp_matches({strip('ls[i + 1]')}, '{I.BOUNDARY}') OR {strip('ls[i + 1]')} = '')"
    after = lambda first: f"list_filter(bs, lambda i: i - {first} + 1 >= {most})[1]"
    return f"""lined AS (SELECT path, string_split(content, chr(10)) AS ls FROM files), cuts AS (SELECT path, len(ls) AS n, {bounds} AS bs FROM lined WHERE len(ls) > {most}),
walk AS (SELECT path, bs, n, 0::BIGINT AS first, {after(0)} AS nxt FROM cuts UNION ALL SELECT path, bs, n, nxt, {after('nxt')} FROM walk WHERE nxt IS NOT NULL),
spans AS (SELECT path, first, coalesce(nxt, n) AS last FROM walk UNION ALL SELECT path, 0, len(ls) FROM lined WHERE len(ls) <= {most}),
text_rows AS (SELECT path, first + 1 AS start_line, last AS end_line, array_to_string(ls[first + 1:last], chr(10)) AS text_raw, list_transform(ls[first + 1:last], lambda x: {strip('x')}) AS plain, len(ls) AS n FROM spans JOIN lined USING (path))"""


#: The name of a chunk of lines: of its first declaration, else its file's.
LINES_NAME = f"coalesce(nullif(regexp_extract(coalesce(list_filter(plain, lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '/*'))[1], ''), '{I.DECLARES}', 1), ''), string_split(path, '/')[-1])"


def built(files: str) -> str:
    """The chunks of an index built from ``files``: documents as files, XML ones whole, the others cut after 100 lines."""
    return f"""WITH RECURSIVE {FILES.replace('files AS', 'all_files AS')}, files AS ({files}), {spans(100)},
built AS (SELECT path, 'generic_block' AS kind, {LINES_NAME} AS symbol_name, start_line, end_line, text_raw FROM text_rows WHERE NOT ends_with(path, '.xml') AND ({strip('text_raw')} <> '' OR n <= 100)
 UNION ALL SELECT path, 'layout', replace(string_split(path, '/')[-1], '.xml', ''), 1, len(string_split(content, chr(10))), content FROM files WHERE ends_with(path, '.xml'))"""


def xml_elements(names: str) -> str:
    """Elements of one of the names, each to the first end of one or the first closed tag; of a column ``content``."""
    return f"regexp_extract_all(content, '(?s)<(?:{names}).*?(?:/>|</(?:{names})>)')"
