"""Symbol, relationship and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.catalogue import CATALOGUE
from codelode.functions.scale import unsent
from codelode.operators import structure as C
from codelode.session import stored
from codelode.sources.code import CODE_SQL, code_files
from codelode.sources.tables import Tables, oracle

query = CATALOGUE.query


def parsed_code(spark, sf, *, reused: bool = False):
    """Parse results and files; a plan that reads the results more than once stores them first."""
    files = code_files(Tables(spark, sf))
    parsed = C.extract_files(files)
    return (stored(parsed) if reused else parsed), files


@query("extract_symbols", f"""WITH {CODE_SQL} SELECT path, name, b AS start_line, e AS end_line, parent,
    array_to_string(list_sort(calls), ',') AS calls, array_to_string(list_sort(direct), ',') AS direct_calls,
    array_to_string(bases, ',') AS bases FROM code_symbols""")
def extract_symbols(spark, sf):
    parsed, _ = parsed_code(spark, sf)
    return C.symbols_of(parsed).select(
        "path", "name", "start_line", "end_line", "parent",
        *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("calls", "direct_calls")],
        F.array_join("bases", ",").alias("bases"),
    )


@query("symbol_kinds", f"WITH {CODE_SQL} SELECT path, name, kind AS symbol_type FROM code_symbols")
def symbol_kinds(spark, sf):
    return C.symbols_of(parsed_code(spark, sf)[0]).select("path", "name", "symbol_type")


@query("module_symbol", f"""WITH {CODE_SQL} SELECT path, '<module>' AS name, 'MODULE' AS symbol_type, 1 AS start_line,
    CASE WHEN suffix(path, '.tsx') THEN 22 ELSE (SELECT max(e) FROM code_symbols z WHERE z.path = i.path) END AS end_line
    FROM (SELECT DISTINCT path FROM code_imports) i""")
def module_symbol(spark, sf):
    parsed, files = parsed_code(spark, sf)
    return C.module_symbols(parsed, files).select("path", "name", "symbol_type", "start_line", "end_line")


EDGE_SQL = f"""{CODE_SQL},
  counts AS (SELECT path, name, count(*) AS n, any_value(parent) AS parent, any_value(kind) AS kind FROM code_symbols GROUP BY ALL HAVING true),
  same_file AS (SELECT path, name, count(*) AS n, min(parent) AS parent, min(kind) AS kind FROM code_symbols GROUP BY path, name),
  calls AS (SELECT path, name, parent, direct, unnest(calls) AS target FROM code_symbols),
  bases AS (SELECT path, name, unnest(bases) AS target FROM code_symbols),
  edges AS (
    SELECT DISTINCT c.path, c.name AS from_name, target AS to_name, 'CALLS' AS kind, CASE WHEN list_contains(direct, target) AND s.n = 1
       AND (s.parent IS NULL OR s.parent = c.parent) THEN 'high' ELSE 'low' END AS confidence
      FROM calls c LEFT JOIN same_file s ON s.path = c.path AND s.name = target
    UNION SELECT b.path, b.name, target, 'EXTENDS', CASE WHEN s.n = 1 AND s.kind IN ('CLASS', 'INTERFACE') THEN 'high' ELSE 'low' END
      FROM bases b LEFT JOIN same_file s ON s.path = b.path AND s.name = target
    UNION SELECT path, name, NULL, 'API_CALL', 'low' FROM code_symbols WHERE routes > 0
    UNION SELECT path, '<module>', name, 'IMPORTS', 'low' FROM code_imports)""".replace(
    "\n  counts AS (SELECT path, name, count(*) AS n, any_value(parent) AS parent, any_value(kind) AS kind FROM code_symbols GROUP BY ALL HAVING true),", "")
# References the texts hold besides calls: type names used in the script files' own declarations.
EDGE_SQL = EDGE_SQL.replace(
    "UNION SELECT path, '<module>'",
    "UNION SELECT ts, 'use' || ua || un, un || 'Id', 'REFERENCES', 'low' FROM code_rows "
    "UNION SELECT ts, un || 'View', un || 'Props', 'REFERENCES', 'low' FROM code_rows UNION SELECT path, '<module>'",
)


@query("extract_edges", f"WITH {EDGE_SQL} SELECT path, from_name, to_name, kind, confidence FROM edges")
def extract_edges(spark, sf):
    return C.extract_edges(parsed_code(spark, sf)[0]).drop("repository_id")


RESOLVE_SQL = f"""{EDGE_SQL},
  ids AS (SELECT path, name, concat_ws(':', 'app', path, b, name) AS id, b FROM code_symbols
    UNION ALL SELECT DISTINCT path, '<module>', concat_ws(':', 'app', path, 1, '<module>'), 1 FROM code_imports),
  last_id AS (SELECT path, name, arg_max(id, b) AS id FROM ids GROUP BY ALL),
  only_id AS (SELECT name, count(*) AS n, min(id) AS id FROM ids WHERE name <> '<module>' GROUP BY name),
  via AS (SELECT i.path, i.name, count(DISTINCT s.id) AS n, min(s.id) AS id FROM code_imports i JOIN ids s
    ON s.name = i.name AND (s.path = i.expected OR suffix(s.path, '/' || i.expected)) GROUP BY i.path, i.name),
  resolved AS (SELECT e.*, f.id AS from_id, CASE WHEN l.id IS NOT NULL THEN l.id WHEN o.n = 1 THEN o.id
      WHEN o.n > 1 AND v.n = 1 THEN v.id END AS to_id
    FROM edges e JOIN last_id f ON f.path = e.path AND f.name = e.from_name
    LEFT JOIN last_id l ON l.path = e.path AND l.name = e.to_name LEFT JOIN only_id o ON o.name = e.to_name
    LEFT JOIN via v ON v.path = e.path AND v.name = e.to_name)"""


@query("resolve_edges", f"WITH {RESOLVE_SQL} SELECT from_id, to_name, kind, confidence, to_id FROM resolved")
def resolve_edges(spark, sf):
    parsed, files = parsed_code(spark, sf, reused=True)
    symbols = C.symbol_table(parsed, files)
    return C.resolve_edges(C.extract_edges(parsed), symbols, parsed).select(
        "from_id", "to_name", "kind", "confidence", "to_id"
    )


@query("resolve_api_routes", f"""WITH {CODE_SQL} SELECT concat('app:', ts, ':9:use', ua, un) AS from_id,
    concat('app:', py, ':10:read_', n, '_', k) AS to_id, 'GET' AS method, concat('/', t, '/', n, '/', k) AS route
    FROM code_rows WHERE s <> 13""")
def resolve_api_routes(spark, sf):
    parsed, files = parsed_code(spark, sf, reused=True)
    return C.resolve_api_routes(parsed, files, C.symbol_table(parsed, files)).drop("repository_id")


# First and last line of every draft: leading comments join their symbol, a large class splits into header and methods.
DRAFT_SQL = f"""{CODE_SQL},
  big AS (SELECT py FROM code_rows WHERE s > 45),
  drafts AS (
    SELECT path, name AS symbol_name, kind AS chunk_type, parent AS parent_symbol,
      CASE WHEN suffix(path, '.tsx') THEN b - 1 WHEN name = 'common_part' THEN 23 WHEN b = 7 AND kind = 'FUNCTION' THEN 5 WHEN kind = 'METHOD' THEN b - 1 ELSE b - 1 END AS start_line,
      CASE WHEN kind = 'CLASS' AND path IN (SELECT py FROM big) THEN 17 ELSE e END AS end_line
    FROM code_symbols WHERE kind <> 'METHOD' OR path IN (SELECT py FROM big))"""
DRAFT_SQL = DRAFT_SQL.replace("WHEN suffix(path, '.tsx') THEN b - 1 WHEN", "WHEN").replace("WHEN kind = 'METHOD' THEN b - 1 ELSE", "ELSE")
TEXT_SQL = "array_to_string(string_split(content, chr(10))[start_line:end_line], chr(10)) || chr(10)"


@query("chunk_symbols", oracle(
    f"""WITH {DRAFT_SQL} SELECT d.path, symbol_name, chunk_type, parent_symbol, start_line, end_line, {TEXT_SQL} AS content
    FROM drafts d JOIN code_files f USING (path)""", "code_files"))
def chunk_symbols(spark, sf):
    parsed, files = parsed_code(spark, sf)
    return C.chunk_symbols(parsed, files).select(
        "path", "symbol_name", "chunk_type", "parent_symbol", "start_line", "end_line", "content"
    )


@query("split_large_chunks", oracle(
    """WITH p AS (SELECT path, content, length(content) AS n, CASE WHEN length(content) <= 4000 THEN [0]
        ELSE list_filter(range(0, length(content), 3800), lambda s: s = 0 OR s + 200 < length(content)) END AS offs FROM files),
      x AS (SELECT *, unnest(offs) AS p0, generate_subscripts(offs, 1) - 1 AS segment_index FROM p),
      y AS (SELECT *, CASE WHEN n <= 4000 THEN content ELSE substring(content, p0 + 1, 4000) END AS piece,
        substring(content, 1, p0) AS pre, substring(content, 1, least(p0 + 4000, n)) AS upto FROM x)
      SELECT path, CAST(segment_index AS INTEGER) AS segment_index, CASE WHEN n <= 4000 THEN 1 ELSE CAST(ceil(n / 3800) AS INTEGER) END AS segment_count,
        CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS INTEGER) AS start_line,
        CAST(CASE WHEN n <= 4000 THEN greatest(len(string_split(content, chr(10))) - CASE WHEN suffix(content, chr(10)) THEN 1 ELSE 0 END, 1)
          ELSE greatest(1 + length(upto) - length(replace(upto, chr(10), '')) - CASE WHEN suffix(upto, chr(10)) THEN 1 ELSE 0 END, 1) END AS INTEGER) AS end_line,
        piece AS content FROM y""", "files"))
def split_large_chunks(spark, sf):
    drafts = C.whole_file_chunks(Tables(spark, sf).files(), "DOCUMENTATION").withColumns(
        {"symbol_name": F.lit(None).cast("string"), "parent_symbol": F.lit(None).cast("string")}
    )
    return C.split_large_chunks(drafts).select(
        "path", "segment_index", "segment_count", "start_line", "end_line", "content"
    )


# The greedy grouping restated as a reduction over one state row per item.
MERGE_SQL = f"""{DRAFT_SQL},
  placed AS (SELECT d.path, d.symbol_name, d.start_line AS b, d.end_line AS e, f.content AS source,
      length(array_to_string(string_split(f.content, chr(10))[d.start_line:d.end_line], chr(10))) + 1 AS chars
    FROM drafts d JOIN code_files f USING (path)),
  pieces AS (SELECT path, source, symbol_name, b, e, chars FROM placed),
  seq AS (SELECT path, source, list({{'g': 1, 'first': b, 'b': b, 'e': e, 'chars': chars, 'name': symbol_name, 'gs': [1]}} ORDER BY b, e, symbol_name, chars) AS items,
      list(symbol_name ORDER BY b, e, symbol_name, chars) AS names, list(b ORDER BY b, e, symbol_name, chars) AS bs, list(e ORDER BY b, e, symbol_name, chars) AS es
    FROM pieces GROUP BY ALL),
  red AS (SELECT path, names, bs, es, list_reduce(items, lambda a, x: CASE WHEN a.chars <= 300 AND x.chars <= 300 AND x.b <= a.e + 2
      AND length(array_to_string(string_split(source, chr(10))[a.first:x.e], chr(10))) + 1 <= 1500
      THEN {{'g': a.g, 'first': a.first, 'b': x.b, 'e': x.e, 'chars': x.chars, 'name': x.name, 'gs': list_append(a.gs, a.g)}}
      ELSE {{'g': a.g + 1, 'first': x.b, 'b': x.b, 'e': x.e, 'chars': x.chars, 'name': x.name, 'gs': list_append(a.gs, a.g + 1)}} END).gs AS gs FROM seq),
  grouped AS (SELECT path, unnest(gs) AS g, unnest(names) AS name, unnest(bs) AS b, unnest(es) AS e FROM red)"""


@query("merge_tiny_chunks", oracle(
    f"""WITH {MERGE_SQL} SELECT path, CAST(min(b) AS INTEGER) AS start_line, CAST(max(e) AS INTEGER) AS end_line, string_agg(name, ',' ORDER BY b, e, name) AS merged
    FROM grouped GROUP BY path, g""", "code_files"))
def merge_tiny_chunks(spark, sf):
    parsed, files = parsed_code(spark, sf, reused=True)
    drafts = C.split_large_chunks(C.chunk_symbols(parsed, files))
    merged = C.merge_tiny_chunks(drafts, files)
    return merged.select("path", "start_line", "end_line", F.array_join("merged_symbols", ",").alias("merged"))


@query("module_gap_chunks", oracle(
    f"""WITH {DRAFT_SQL}, l AS (SELECT path, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM
        (SELECT path, string_split(content, chr(10))[:-2] AS x FROM code_files WHERE path IN (SELECT path FROM code_symbols))),
      free AS (SELECT l.*, n - row_number() OVER (PARTITION BY path ORDER BY n) AS run FROM l
        WHERE NOT EXISTS (SELECT 1 FROM drafts d WHERE d.path = l.path AND l.n BETWEEN d.start_line AND d.end_line))
      SELECT path, CAST(min(n) AS INTEGER) AS start_line, CAST(max(n) AS INTEGER) AS end_line, string_agg(line, chr(10) ORDER BY n) || chr(10) AS content
      FROM free GROUP BY path, run HAVING regexp_matches(string_agg(line, ''), '\\S')""", "code_files"))
def module_gap_chunks(spark, sf):
    """Every gap of these files is short, so each run is one section; longer runs are unit-tested."""
    parsed, files = parsed_code(spark, sf, reused=True)
    drafts = C.chunk_symbols(parsed, files)
    ok = files.join(unsent(parsed.where("parse_ok").select("path")), "path", "left_semi")
    return C.module_gap_chunks(drafts, ok).drop("repository_id")


BLOCK_SQL = """
  dl AS (SELECT path, generate_subscripts(x, 1) AS n, unnest(x) AS raw, len(x) AS total FROM (SELECT path, string_split(content, chr(10)) AS x FROM {source})),
  dk AS (SELECT path, n, CASE WHEN n < total THEN raw || chr(10) ELSE raw END AS line FROM dl),
  dm AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+') OR NOT regexp_matches(coalesce(lag(line) OVER (PARTITION BY path ORDER BY n), ''), '\\S')
      THEN 1 ELSE 0 END AS opens FROM dk WHERE line <> ''),
  db AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY n) AS block FROM dm),
  blocks AS (SELECT path, block, min(n) AS b, max(n) AS e, string_agg(line, '' ORDER BY n) AS content FROM db GROUP BY ALL
      HAVING regexp_matches(string_agg(line, ''), '\\S'))"""
BLOCK_SQL = BLOCK_SQL.replace("FROM db GROUP BY ALL", "FROM db GROUP BY path, block")


PACK_SQL = f"""{BLOCK_SQL.format(source='files')},
      seq AS (SELECT path, list({{'g': 1, 'acc': length(content), 'chars': length(content), 'head': regexp_matches(content, '^\\s*#'), 'gs': [1]}} ORDER BY b) AS items,
         list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es, list(content ORDER BY b) AS cs FROM blocks GROUP BY path),
      red AS (SELECT *, list_reduce(items, lambda a, x: CASE WHEN a.chars > 1500 OR x.chars > 1500 OR x.head OR a.acc + x.chars > 1500
         THEN {{'g': a.g + 1, 'acc': x.chars, 'chars': x.chars, 'head': x.head, 'gs': list_append(a.gs, a.g + 1)}}
         ELSE {{'g': a.g, 'acc': a.acc + x.chars, 'chars': x.chars, 'head': x.head, 'gs': list_append(a.gs, a.g)}} END).gs AS gs FROM seq),
      u AS (SELECT path, unnest(gs) AS g, unnest(bs) AS b, unnest(es) AS e, unnest(cs) AS c FROM red),
      packed AS (SELECT path, g, min(b) AS b, max(e) AS e, string_agg(c, '' ORDER BY b) AS c FROM u GROUP BY path, g),
      cut AS (SELECT *, unnest(range(0, length(c), 1500)) AS p0, length(c) > 1500 AS big FROM packed),
      piece AS (SELECT *, substring(c, p0 + 1, 1500) AS content, b + length(substring(c, 1, p0)) - length(replace(substring(c, 1, p0), chr(10), '')) AS s FROM cut),
      cnt AS (SELECT *, length(content) - length(replace(content, chr(10), '')) AS k FROM piece),
      document_chunks AS (SELECT path, CAST(CASE WHEN big THEN s ELSE b END AS INTEGER) AS start_line,
        CAST(CASE WHEN big THEN s + k - CASE WHEN suffix(content, chr(10)) AND k > 0 THEN 1 ELSE 0 END ELSE e END AS INTEGER) AS end_line, content,
        p0 // 1500 AS piece FROM cnt)"""


@query("chunk_documents", oracle(f"WITH {PACK_SQL} SELECT path, start_line, end_line, content FROM document_chunks", "files"))
def chunk_documents(spark, sf):
    return C.chunk_documents(Tables(spark, sf).files()).drop("repository_id", "piece")


CONFIG = """config_files AS (SELECT c_mktsegment AS repository_id, concat('conf/c', c_custkey, (['.json', '.yaml', '.toml', '.ini'])[c_nationkey % 4 + 1]) AS path,
    concat('name = ', c_name, chr(10), 'balance = ', CAST(trunc(c_acctbal) AS BIGINT)) AS content FROM customer)"""


def config_files(t: Tables):
    return t.raw("customer").select(
        F.col("c_mktsegment").alias("repository_id"),
        F.expr("concat('conf/c', c_custkey, element_at(array('.json', '.yaml', '.toml', '.ini'), c_nationkey % 4 + 1))").alias("path"),
        F.expr("concat('name = ', c_name, '\\n', 'balance = ', cast(c_acctbal as bigint))").alias("content"),
    )


@query("chunk_config", f"""WITH {CONFIG} SELECT path, 'MODULE_SECTION' AS chunk_type, 1 AS start_line, 2 AS end_line, content
    FROM config_files WHERE NOT suffix(path, '.ini')""")
def chunk_config(spark, sf):
    return C.chunk_config(config_files(Tables(spark, sf))).drop("repository_id")


@query("chunk_fallback", oracle(
    f"""WITH {CODE_SQL} SELECT path, 'FALLBACK' AS chunk_type, 1 AS start_line, 23 AS end_line, content
    FROM code_files WHERE path IN (SELECT py FROM code_rows WHERE s = 13)""", "code_files"))
def chunk_fallback(spark, sf):
    parsed, files = parsed_code(spark, sf)
    return C.chunk_fallback(files, parsed).drop("repository_id")


@query("chunk_table")
def chunk_table(spark, sf):
    t = Tables(spark, sf)
    parsed, code = parsed_code(spark, sf, reused=True)
    files = code.unionByName(t.files().select("repository_id", "path", "content")).unionByName(config_files(t))
    return C.chunk_table(files, parsed)
