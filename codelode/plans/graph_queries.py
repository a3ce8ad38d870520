"""Graph, flow and impact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.catalogue import CATALOGUE
from codelode.functions import scale
from codelode.operators import graph as G
from codelode.operators import retrieve as R
from codelode.plans.retrieve_queries import MATCH_SQL, OWNER_SQL, same, sql_stem, terms_cte
from codelode.plans.rank_queries import EXPAND_BODY
from codelode.plans.structure_queries import RESOLVE_SQL, parsed_code
from codelode.operators import structure as C
from codelode.plans.understand_queries import sql_shaped
from codelode.session import stored
from codelode.sources.code import CODE_SQL
from codelode.sources.tables import Tables, oracle

query = CATALOGUE.query
GRAPH = ("symbols", "symbol_queries", "symbol_chunks", "edges")


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("find_symbol", oracle(
    f"""WITH {OWNER_SQL}, best AS (SELECT query_id, chunk_id, max(score) AS cs FROM owners GROUP BY query_id, chunk_id),
      r AS (SELECT o.*, cs, row_number() OVER (PARTITION BY o.query_id, o.symbol_id ORDER BY cs DESC, o.file_path, o.start_line, o.chunk_id) AS n
        FROM owners o JOIN best b ON b.query_id = o.query_id AND b.chunk_id = o.chunk_id)
      SELECT query_id, symbol_id, name, file_path, symbol_start, symbol_end, match_type, round(cs, 6) AS score FROM r WHERE n = 1""", *GRAPH[:3]))
def find_symbol(spark, sf):
    t = Tables(spark, sf)
    found = G.find_symbol(R.symbol_matches(t.symbols(), t.symbol_queries()), t.symbol_chunks())
    return found.drop(*G.SCOPE).withColumn("score", F.round("score", 6))


REFERENCE_SQL = f"""
  tg AS (SELECT q.query_id, s.*, s.name = q.query_text AS exact_name FROM symbols s JOIN symbol_queries q ON lower(s.name) = lower(q.query_text) AND {same('s', 'q')}),
  targets AS (SELECT * FROM tg WHERE exact_name OR query_id NOT IN (SELECT query_id FROM tg WHERE exact_name)),
  refs AS (SELECT t.query_id, s.file_path AS file, s.name AS symbol, s.start_line AS line, e.kind, e.confidence, e.from_id AS source_id, e.to_id AS target_id,
      t.file_path AS target_file, t.start_line AS target_start, t.end_line AS target_end
    FROM edges e JOIN targets t ON t.symbol_id = e.to_id AND {same('t', 'e')} JOIN symbols s ON s.symbol_id = e.from_id AND {same('s', 'e')})"""


@query("find_references", oracle(f"WITH {REFERENCE_SQL} SELECT * FROM refs", "symbols", "symbol_queries", "edges"))
def find_references(spark, sf):
    t = Tables(spark, sf)
    return G.find_references(t.symbols(), t.edges(), t.symbol_queries())


@query("related_chunks", oracle(
    f"""WITH {OWNER_SQL}, own AS (SELECT query_id, repository_id, index_version, chunk_id, file_path, start_line, end_line, max(score) AS score, bool_or(prefix(match_type, 'exact_')) AS is_exact FROM owners GROUP BY ALL),
      ranked_in AS (SELECT * FROM own WHERE is_exact OR query_id NOT IN (SELECT query_id FROM own WHERE is_exact)),
      taken AS (SELECT query_id, chunk_id FROM ranked_in), {EXPAND_BODY}
      SELECT query_id, chunk_id, round(score, 6) AS score, 'symbol' AS signal FROM ranked_in
      UNION ALL SELECT a.query_id, a.k.id, round(s.score, 6), 'structural' FROM added a JOIN seeds s ON s.query_id = a.query_id AND s.seed_rank = a.k.r""", *GRAPH))
def related_chunks(spark, sf):
    t = Tables(spark, sf)
    matches = R.symbol_matches(t.symbols(), t.symbol_queries())
    found = G.related_chunks(matches, t.symbol_chunks(), t.symbols(), t.edges())
    return found.drop(*G.SCOPE).withColumn("score", F.round("score", 6))


NEIGHBOR_SQL = f"""
  cover AS (SELECT s.symbol_id, arg_min(c.chunk_id, CASE WHEN c.symbol_name = s.name THEN 0 ELSE 1 END * 1000000000000 + c.start_line::BIGINT * 10000000 + c.chunk_id) AS chunk_id
    FROM symbols s JOIN symbol_chunks c ON {same('c', 's')} AND c.file_path = s.file_path AND s.start_line BETWEEN c.start_line AND c.end_line AND c.end_line >= s.end_line GROUP BY 1),
  calls AS (SELECT repository_id, index_version, from_id, to_id, min(kind) AS kind, min(confidence) AS confidence FROM edges WHERE kind IN ('CALLS', 'API_CALL') AND to_id IS NOT NULL GROUP BY repository_id, index_version, from_id, to_id),
  nb AS (SELECT * FROM (SELECT c.*, b.file_path AS target_file, b.name AS target_name, cv.chunk_id, row_number() OVER (PARTITION BY from_id ORDER BY b.symbol_type IN ('CLASS', 'INTERFACE', 'TYPE'),
      b.file_path = a.file_path, b.file_path, b.name, b.start_line, b.symbol_id) AS rank
    FROM calls c JOIN symbols a ON a.symbol_id = c.from_id AND {same('a', 'c')} JOIN symbols b ON b.symbol_id = c.to_id AND {same('b', 'c')} JOIN cover cv ON cv.symbol_id = c.to_id) WHERE rank <= 2)"""


@query("forward_neighbors", oracle(
    f"WITH {NEIGHBOR_SQL} SELECT from_id, to_id, kind, confidence, chunk_id, CAST(rank AS INTEGER) AS rank FROM nb", "symbols", "symbol_chunks", "edges"))
def forward_neighbors(spark, sf):
    t = Tables(spark, sf)
    return G.forward_neighbors(t.symbols(), t.edges(), t.symbol_chunks()).select(
        "from_id", "to_id", "kind", "confidence", "chunk_id", "rank"
    )


@query("flow_edges", oracle(
    f"""WITH c AS (SELECT repository_id, index_version, from_id, to_id, kind, min(confidence) AS confidence FROM edges WHERE kind IN ('CALLS', 'API_CALL') AND to_id IS NOT NULL GROUP BY ALL)
       SELECT c.*, a.name AS source_symbol, a.file_path AS source_file, a.start_line AS source_start, a.end_line AS source_end,
         b.name AS target_symbol, b.file_path AS target_file, b.start_line AS target_start, b.end_line AS target_end
       FROM c JOIN symbols a ON a.symbol_id = from_id AND {same('a', 'c')} JOIN symbols b ON b.symbol_id = to_id AND {same('b', 'c')}""", "symbols", "edges"))
def flow_edges(spark, sf):
    t = Tables(spark, sf)
    return G.flow_edges(t.symbols(), t.edges())


def sql_identifier_terms(x: str) -> str:
    spaced = f"replace({x}, '_', ' ')"
    for a, b in (("([a-z])([A-Z])", "g"), ("([A-Z])([A-Z][a-z])", "g"), ("([A-Za-z])([0-9])", "g"), ("([0-9])([A-Za-z])", "g")):
        spaced = f"regexp_replace({spaced}, '{a}', '\\1 \\2', '{b}')"
    return (
        f"list_distinct(list_transform(list_transform(list_filter(string_split({spaced}, ' '), lambda z: length(z) >= 2), "
        f"lambda z: lower(z)), lambda z: {sql_stem('z')}))"
    )


IGNORED = "[" + ",".join(f"'{w}'" for w in G.IGNORED_WORDS) + "]"
ENTRY_SQL = f"""cand AS (SELECT symbol_id AS query_id, name, file_path, symbol_id % 3 = 0 AS is_route FROM symbols
      UNION ALL SELECT symbol_id - 1, concat(name, 'X'), file_path, false FROM symbols),
  spans AS (SELECT query_id, regexp_extract(query_text, '(?i)\\bfrom\\b(.+?)\\bto\\b', 1) AS query_text FROM questions),
  {terms_cte('questions')}, {terms_cte('spans')},
  wl AS (SELECT query_id, query_text, regexp_extract_all(query_text, '[A-Za-z]+') AS raw FROM questions),
  wl2 AS (SELECT *, list_transform(list_transform(raw, lambda z: lower(z)), lambda z: {sql_stem('z')}) AS words,
      list_transform(list_transform(list_filter(raw, lambda z: NOT list_contains({IGNORED}, lower(z))), lambda z: lower(z)), lambda z: {sql_stem('z')}) AS cw FROM wl),
  qt AS (SELECT w.query_id, list_concat(coalesce(list({sql_stem('t.term')}), []), any_value(list_filter(list_transform(range(1, len(words)), lambda i: CASE WHEN length(words[i + 1]) <= 3 THEN words[i] || words[i + 1] END), lambda z: z IS NOT NULL))) AS terms
      FROM wl2 w LEFT JOIN questions_terms t USING (query_id) GROUP BY w.query_id),
  sw AS (SELECT query_id, query_text, list_transform(list_transform(regexp_extract_all(query_text, '[A-Za-z]+'), lambda z: lower(z)), lambda z: {sql_stem('z')}) AS words FROM spans),
  st AS (SELECT w.query_id, list_concat(coalesce(list({sql_stem('t.term')}), []), any_value(list_filter(list_transform(range(1, len(words)), lambda i: CASE WHEN length(words[i + 1]) <= 3 THEN words[i] || words[i + 1] END), lambda z: z IS NOT NULL))) AS terms,
      any_value(w.query_text) AS span FROM sw w LEFT JOIN spans_terms t USING (query_id) GROUP BY w.query_id),
  guess AS (SELECT query_id, unnest(list_transform(range(1, len(cw)), lambda i: {{'name': cw[i] || '_' || cw[i + 1], 'pos': i - 1, 'j': false}}), recursive := true) FROM wl2
      UNION ALL SELECT query_id, {sql_stem('a')} || b, i - 1 + len(cw), true FROM (SELECT query_id, cw, i, lower(raw[i]) AS a, lower(raw[i + 1]) AS b FROM wl2, range(1, 60) r(i) WHERE i < len(raw)) WHERE b IN ('in', 'on', 'up', 'out')),
  gs AS (SELECT query_id, name, max(pos) AS pos, bool_or(j) AS j FROM guess GROUP BY query_id, name),
  rows_ AS (SELECT coalesce(c.query_id, g.query_id) AS query_id, coalesce(c.name, g.name) AS name, c.file_path, c.is_route, g.pos FROM cand c FULL JOIN gs g ON g.query_id = c.query_id AND g.name = c.name),
  sc AS (SELECT r.*, q.query_text, len(list_intersect({sql_identifier_terms('r.name')}, qt.terms)) + CASE WHEN EXISTS (SELECT 1 FROM gs WHERE gs.j AND gs.query_id = r.query_id AND gs.name = lower(r.name)) THEN 1 ELSE 0 END AS base,
      CASE WHEN regexp_matches(q.query_text, '(?i)\\bwhen\\b|\\bendpoint\\b|\\broute\\b') AND is_route THEN 2 ELSE 0 END AS bonus,
      CASE WHEN regexp_matches(st.span, '(?i)\\b(frontend|react|form|browser|client)\\b') AND prefix(file_path, 'frontend/') THEN len(list_intersect({sql_identifier_terms('r.name')}, st.terms)) ELSE 0 END AS front
    FROM rows_ r JOIN questions q USING (query_id) JOIN qt USING (query_id) JOIN st USING (query_id)),
  ex AS (SELECT query_id, lower(token) AS low, min(n) AS n FROM (SELECT query_id, query_text, generate_subscripts(x, 1) AS n, unnest(x) AS token FROM
      (SELECT query_id, query_text, regexp_extract_all(query_text, '[A-Za-z_][A-Za-z0-9_]*') AS x FROM questions)) WHERE {sql_shaped('token', 'query_text')} GROUP BY query_id, lower(token)),
  pick AS (SELECT sc.query_id, arg_min(name, (-front, name)) FILTER (WHERE front > 0) AS by_front, arg_min(name, (ex.n, name)) FILTER (WHERE is_route IS NOT NULL AND ex.n IS NOT NULL) AS by_name,
      arg_min(name, (-(base + bonus), -base, CASE WHEN file_path IS NULL THEN 0 ELSE -1 END, -coalesce(pos, -1), name)) FILTER (WHERE base + bonus > 0) AS by_terms
    FROM sc LEFT JOIN ex ON ex.query_id = sc.query_id AND ex.low = lower(sc.name) GROUP BY sc.query_id)"""


@query("select_entry_symbol", oracle(
    f"WITH {ENTRY_SQL} SELECT query_id, coalesce(by_front, by_name, by_terms) AS entry FROM pick", "questions", "symbols"))
def select_entry_symbol(spark, sf):
    t = Tables(spark, sf)
    own = t.symbols().select(F.col("symbol_id").alias("query_id"), "name", "file_path", (F.col("symbol_id") % 3 == 0).alias("is_route"))
    other = t.symbols().select(
        (F.col("symbol_id") - 1).alias("query_id"), F.concat("name", F.lit("X")).alias("name"), "file_path", F.lit(False).alias("is_route")
    )
    return G.select_entry_symbol(t.questions(), own.unionByName(other))


FLOW_SQL = f"""{NEIGHBOR_SQL},
  nl AS (SELECT from_id, list({{'id': to_id, 'kind': kind}} ORDER BY regexp_matches(target_name, '^[A-Z]'), target_name, target_file, to_id) AS kids FROM nb GROUP BY from_id),
  walk AS (SELECT symbol_id AS query_id, 0 AS step, [symbol_id] AS queue, [symbol_id] AS path, []::BIGINT[] AS visited, []::STRUCT(s BIGINT, t BIGINT, k VARCHAR)[] AS links FROM symbols
    UNION ALL SELECT w.query_id, w.step + 1,
      CASE WHEN w.queue[1] IS NULL THEN w.queue ELSE list_concat(list_filter(list_transform(coalesce(n.kids, []), lambda c: c.id), lambda i: NOT list_contains(list_append(w.visited, w.queue[1]), i)
        AND NOT list_contains(w.queue[2:], i)), w.queue[2:]) END,
      CASE WHEN w.queue[1] IS NULL THEN w.path ELSE list_concat(w.path, list_filter(list_transform(coalesce(n.kids, []), lambda c: c.id), lambda i: NOT list_contains(w.path, i))) END,
      CASE WHEN w.queue[1] IS NULL THEN w.visited ELSE list_append(w.visited, w.queue[1]) END,
      CASE WHEN w.queue[1] IS NULL THEN w.links ELSE list_concat(w.links, list_transform(coalesce(n.kids, []), lambda c: {{'s': w.queue[1], 't': c.id, 'k': c.kind}})) END
    FROM walk w LEFT JOIN nl n ON n.from_id = w.queue[1] WHERE w.step < 5),
  trace AS (SELECT * FROM walk WHERE step = 5)"""


def traced(t: Tables):
    """A bounded walk from every symbol."""
    neighbors = stored(G.forward_neighbors(t.symbols(), t.edges(), t.symbol_chunks()))
    entries = t.symbols().select(F.col("symbol_id").alias("query_id"), "symbol_id")
    return G.flow_trace(entries, neighbors)


@query("flow_trace", recursive(oracle(
    f"""WITH {FLOW_SQL} SELECT query_id, array_to_string(path, ',') AS path, array_to_string(list_transform(links, lambda l: l.s || '>' || l.t || ':' || l.k), ',') AS edges,
      len(queue) > 0 AS is_partial FROM trace""", "symbols", "symbol_chunks", "edges")))
def flow_trace(spark, sf):
    labels = F.transform("edges", lambda e: F.concat(
        e["source"].cast("string"), F.lit(">"), e["target"].cast("string"), F.lit(":"), e["kind"]))
    return traced(Tables(spark, sf)).select(
        "query_id", F.array_join(F.transform("path", lambda p: p.cast("string")), ",").alias("path"),
        F.array_join(labels, ",").alias("edges"), "is_partial",
    )


# The whole investigation over parsed code: every symbol as an entry, first hops, open calls and cut targets in one walk.
WALK_SQL = f"""{RESOLVE_SQL},
  sym AS (SELECT concat_ws(':', 'app', path, b, name) AS id, path, name, kind, b, direct, calls FROM code_symbols),
  routes AS (SELECT concat('app:', ts, ':9:use', ua, un) AS from_id, concat('app:', py, ':10:read_', n, '_', k) AS to_id FROM code_rows WHERE s <> 13),
  links AS (SELECT from_id, to_id, min(kind) AS kind FROM (SELECT from_id, to_id, kind FROM resolved WHERE kind = 'CALLS' AND to_id IS NOT NULL
    UNION ALL SELECT from_id, to_id, 'API_CALL' FROM routes) GROUP BY from_id, to_id),
  nb AS (SELECT l.*, b.name AS target_name, b.path AS target_file FROM links l JOIN sym a ON a.id = l.from_id JOIN sym b ON b.id = l.to_id
    QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY b.kind IN ('CLASS', 'INTERFACE', 'TYPE'), b.path = a.path, b.path, b.name, b.b, b.id) <= 2),
  kids AS (SELECT from_id, list({{'id': to_id, 'kind': kind}} ORDER BY regexp_matches(target_name, '^[A-Z]'), target_name, target_file, to_id) AS kids FROM nb GROUP BY from_id),
  asked AS (SELECT id, name, unnest(direct) AS called FROM sym WHERE prefix(path, 'frontend/')),
  hop AS (SELECT a.id, a.called, min(t.id) AS target_id FROM asked a JOIN (SELECT DISTINCT from_id, to_id FROM resolved WHERE kind = 'CALLS') l ON l.from_id = a.id
    JOIN sym t ON t.id = l.to_id AND t.name = a.called AND prefix(t.path, 'frontend/') WHERE a.called <> a.name GROUP BY a.id, a.called HAVING count(DISTINCT t.id) = 1),
  picked AS (SELECT id, min(called) AS called, arg_min(target_id, called) AS target_id FROM hop GROUP BY id),
  tries AS (SELECT a.id, any_value(p.target_id) AS target_id, count(DISTINCT a.called) FILTER (WHERE p.called IS NULL OR a.called <= p.called) AS tried
    FROM asked a LEFT JOIN picked p USING (id) WHERE a.called <> a.name GROUP BY a.id),
  ended AS (SELECT id, list_sort(direct)[1] AS call FROM sym WHERE len(direct) > 0 AND id NOT IN (SELECT from_id FROM resolved WHERE kind = 'CALLS' AND to_id IS NOT NULL)),
  walk AS (SELECT sym.id AS query_id, 0 AS step, least(coalesce(tried, 0), 5) AS used, CASE WHEN tried <= 5 THEN target_id END AS hop,
      [coalesce(hop, sym.id)] AS queue, CASE WHEN hop IS NULL THEN [sym.id] ELSE [sym.id, hop] END AS path,
      CASE WHEN hop IS NULL THEN []::VARCHAR[] ELSE [sym.id] END AS visited,
      CASE WHEN hop IS NULL THEN []::STRUCT(s VARCHAR, t VARCHAR, k VARCHAR)[] ELSE [{{'s': sym.id, 't': hop, 'k': 'CALLS'}}] END AS links, []::VARCHAR[] AS opened
    FROM sym LEFT JOIN tries USING (id)
    UNION ALL SELECT w.query_id, w.step + 1, w.used, w.hop,
      CASE WHEN h IS NULL THEN w.queue ELSE list_concat(list_filter(list_transform(coalesce(k.kids, []), lambda c: c.id), lambda i: NOT list_contains(list_append(w.visited, h), i)
        AND NOT list_contains(w.queue[2:], i)), w.queue[2:]) END,
      CASE WHEN h IS NULL THEN w.path ELSE list_concat(list_concat(w.path, list_filter(list_transform(coalesce(k.kids, []), lambda c: c.id), lambda i: NOT list_contains(w.path, i))),
        CASE WHEN k.kids IS NULL AND e.call IS NOT NULL THEN [concat_ws(':', 'unresolved', h, e.call)] ELSE [] END) END,
      CASE WHEN h IS NULL THEN w.visited ELSE list_append(w.visited, h) END,
      CASE WHEN h IS NULL THEN w.links ELSE list_concat(list_concat(w.links, list_transform(coalesce(k.kids, []), lambda c: {{'s': h, 't': c.id, 'k': c.kind}})),
        CASE WHEN k.kids IS NULL AND e.call IS NOT NULL THEN [{{'s': h, 't': concat_ws(':', 'unresolved', h, e.call), 'k': 'CALLS'}}] ELSE [] END) END,
      CASE WHEN h IS NOT NULL AND k.kids IS NULL AND e.call IS NOT NULL THEN list_append(w.opened, concat_ws(':', 'unresolved', h, e.call)) ELSE w.opened END
    FROM (SELECT *, CASE WHEN used + step < 5 THEN queue[1] END AS h FROM walk WHERE step < 5) w LEFT JOIN kids k ON k.from_id = w.h LEFT JOIN ended e ON e.id = w.h),
  done AS (SELECT *, len(queue) > 0 AS is_partial FROM walk WHERE step = 5)"""


def walked(spark, sf):
    """flow_trace from every symbol of the parsed code."""
    parsed, files = parsed_code(spark, sf, reused=True)
    version = F.lit(1).alias("index_version")
    symbols = stored(C.symbol_table(parsed, files))
    resolved = stored(C.resolve_edges(C.extract_edges(parsed), symbols, parsed).select("repository_id", "from_id", "to_id", "kind", "confidence"))
    routes = C.resolve_api_routes(parsed, files, symbols).select("repository_id", "from_id", "to_id", F.lit("API_CALL").alias("kind"), F.lit("low").alias("confidence"))
    edges = resolved.where("to_id IS NOT NULL").unionByName(routes).select("*", version)
    places = symbols.where(F.col("name") != C.MODULE).select("*", version, F.col("path").alias("file_path"))
    chunks = C.chunk_symbols(parsed, files).select(
        "repository_id", version, F.concat_ws(":", "path", F.col("start_line").cast("string"), "symbol_name").alias("chunk_id"),
        F.col("path").alias("file_path"), "symbol_name", "start_line", "end_line",
    )
    facts = C.symbols_of(parsed).join(scale.unsent(files.select("repository_id", "path", "content")), ["repository_id", "path"]).select(
        "repository_id", version, F.concat_ws(":", "repository_id", "path", F.col("start_line").cast("string"), "name").alias("symbol_id"),
        F.col("name").alias("symbol"), "calls", "direct_calls", F.col("content").alias("source_text"), F.col("content").alias("file_text"),
        F.expr("cast(array() as array<string>)").alias("explicit"),
    )
    direct = facts.select(*G.SCOPE, "symbol_id", F.explode("direct_calls").alias("called"))
    answered = resolved.where("kind = 'CALLS' AND to_id IS NOT NULL").select(F.col("from_id").alias("node_id"))
    ended = G.unresolved_calls(facts.withColumnRenamed("symbol_id", "node_id"), answered)
    entries = places.select(*G.SCOPE, F.col("symbol_id").alias("query_id"), "symbol_id")
    neighbors = stored(G.forward_neighbors(places, edges, chunks))
    hops = G.first_hops(entries, direct, places, edges)
    return G.flow_trace(entries, neighbors, first_hops=hops, open_calls=ended)


@query("flow_walk", recursive(f"""WITH {WALK_SQL} SELECT query_id, array_to_string(path, ' ') AS path,
    array_to_string(list_transform(links, lambda l: l.s || '>' || l.t || ':' || l.k), ' ') AS edges, array_to_string(opened, ' ') AS open,
    CASE WHEN is_partial THEN array_to_string(list_filter(path, lambda p: NOT list_contains(visited, p) AND NOT list_contains(opened, p)), ' ') ELSE '' END AS cut, is_partial FROM done"""))
def flow_walk(spark, sf):
    labels = F.transform("edges", lambda e: F.concat(e["source"], F.lit(">"), e["target"], F.lit(":"), e["kind"]))
    return walked(spark, sf).select(
        "query_id", *[F.array_join(c, " ").alias(c) for c in ("path", "open", "cut")], F.array_join(labels, " ").alias("edges"), "is_partial"
    )


@query("client_first_hop", oracle(
    f"""WITH front AS (SELECT * FROM symbols WHERE prefix(file_path, 'frontend/')),
       dc AS (SELECT DISTINCT e.from_id AS symbol_id, s.name AS called FROM edges e JOIN symbols s ON s.symbol_id = e.to_id AND {same('s', 'e')} WHERE confidence = 'high'),
       h AS (SELECT f.symbol_id, dc.called, e.to_id FROM front f JOIN dc ON dc.symbol_id = f.symbol_id AND dc.called <> f.name
         JOIN (SELECT DISTINCT repository_id, index_version, from_id, to_id FROM edges WHERE kind = 'CALLS') e ON e.from_id = f.symbol_id JOIN front g ON g.symbol_id = e.to_id AND {same('g', 'e')} AND g.name = dc.called),
       s AS (SELECT symbol_id, called, min(to_id) AS target_id FROM h GROUP BY symbol_id, called HAVING count(DISTINCT to_id) = 1)
       SELECT symbol_id, min(called) AS called, arg_min(target_id, called) AS target_id FROM s GROUP BY 1""", "symbols", "edges"))
def client_first_hop(spark, sf):
    t = Tables(spark, sf)
    named = t.symbols().select(*G.SCOPE, F.col("symbol_id").alias("to_id"), F.col("name").alias("called"))
    direct = t.edges().where("confidence = 'high'").join(named, [*G.SCOPE, "to_id"]).select(
        *G.SCOPE, F.col("from_id").alias("symbol_id"), "called"
    ).distinct()
    return G.client_first_hop(t.symbols(), direct, t.symbols(), t.edges()).drop(*G.SCOPE)


@query("unresolved_calls", f"""WITH {RESOLVE_SQL}, open AS (SELECT c.path, c.name, c.b, c.direct FROM code_symbols c WHERE concat_ws(':', 'app', path, b, name) NOT IN
      (SELECT from_id FROM resolved WHERE kind = 'CALLS' AND to_id IS NOT NULL))
    SELECT concat_ws(':', 'app', path, b, name) AS node_id, list_sort(direct)[1] AS call FROM open WHERE len(direct) > 0""")
def unresolved_calls(spark, sf):
    parsed, files = parsed_code(spark, sf, reused=True)
    symbols = C.symbol_table(parsed, files)
    resolved = C.resolve_edges(C.extract_edges(parsed), symbols, parsed).where("kind = 'CALLS' AND to_id IS NOT NULL")
    nodes = C.symbols_of(parsed).join(scale.unsent(files.select("repository_id", "path", "content")), ["repository_id", "path"]).select(
        F.concat_ws(":", "repository_id", "path", F.col("start_line").cast("string"), "name").alias("node_id"),
        F.col("name").alias("symbol"), "calls", "direct_calls", F.col("content").alias("source_text"),
        F.col("content").alias("file_text"), F.expr("cast(array() as array<string>)").alias("explicit"),
    )
    return G.unresolved_calls(nodes, resolved.select(F.col("from_id").alias("node_id")))


# Steps: the walked path with one piece of evidence per covering chunk, shifted for some nodes.
STEP_SQL = f"""{FLOW_SQL},
  dfs AS (SELECT query_id, 0 AS n, path AS stack, []::BIGINT[] AS done, links, visited, queue, len(path) + len(links) AS total FROM trace
    UNION ALL SELECT query_id, n + 1,
      CASE WHEN stack[1] IS NOT NULL AND NOT list_contains(done, stack[1]) THEN list_concat(list_transform(list_filter(links, lambda l: l.s = stack[1]), lambda l: l.t), stack[2:]) ELSE stack[2:] END,
      CASE WHEN stack[1] IS NOT NULL AND NOT list_contains(done, stack[1]) THEN list_append(done, stack[1]) ELSE done END, links, visited, queue, total FROM dfs WHERE n < total),
  ordered AS (SELECT query_id, visited, queue, links, generate_subscripts(done, 1) AS position, unnest(done) AS node_id FROM dfs WHERE n = total),
  pathed AS (SELECT o.query_id, o.position, o.node_id, s.repository_id, s.index_version, s.file_path AS file, s.name AS symbol, s.start_line, s.end_line, len(queue) > 0 AND NOT list_contains(visited, o.node_id) AS is_unresolved
    FROM ordered o JOIN symbols s ON s.symbol_id = o.node_id),
  support AS (SELECT p.query_id, p.position, p.node_id, c.chunk_id AS evidence_id, c.start_line AS es, c.end_line AS ee, row_number() OVER (PARTITION BY p.query_id, p.node_id ORDER BY c.chunk_id) AS rank
    FROM pathed p JOIN symbol_chunks c ON {same('c', 'p')} AND c.file_path = p.file AND p.start_line BETWEEN c.start_line AND c.end_line),
  anchor AS (SELECT query_id, node_id, arg_min(es, rank) AS fs, arg_min(ee, rank) AS fe FROM support GROUP BY query_id, node_id),
  placed AS (SELECT p.*, fs, fe, EXISTS (SELECT 1 FROM support s WHERE s.query_id = p.query_id AND s.node_id = p.node_id AND abs(es - p.start_line) <= 5 AND abs(ee - p.end_line) <= 5) AS near
    FROM pathed p JOIN anchor a ON a.query_id = p.query_id AND a.node_id = p.node_id),
  steps AS (SELECT *, CASE WHEN near THEN start_line ELSE fs END AS b, CASE WHEN near THEN end_line ELSE fe END AS e,
      row_number() OVER (PARTITION BY query_id ORDER BY position) AS step, lead(node_id) OVER (PARTITION BY query_id ORDER BY position) AS next_id FROM placed),
  lk AS (SELECT query_id, l.s AS s, l.t AS t, min(l.k) AS k FROM (SELECT query_id, unnest(links) AS l FROM trace) GROUP BY ALL),
  stepped AS (SELECT s.query_id, s.step, s.node_id, s.file, s.symbol, s.b AS start_line, s.e AS end_line, s.is_unresolved OR (next_id IS NOT NULL AND k IS NULL) AS unresolved,
      CASE WHEN NOT (s.is_unresolved OR (next_id IS NOT NULL AND k IS NULL)) THEN k END AS relationship_to_next
    FROM steps s LEFT JOIN lk ON lk.query_id = s.query_id AND lk.s = s.node_id AND lk.t = s.next_id)"""
STEP_SQL = STEP_SQL.replace("FROM trace) GROUP BY ALL)", "FROM trace) GROUP BY query_id, l.s, l.t)")


def stepped(t: Tables):
    trace = stored(traced(t))
    places = t.symbols().select(
        *G.SCOPE, F.col("symbol_id").alias("node_id"), F.col("file_path").alias("file"), F.col("name").alias("symbol"), "start_line", "end_line"
    )
    path = stored(G.ordered_path(trace).join(places, "node_id"))
    points = path.select(*G.SCOPE, "node_id", F.col("file").alias("file_path"), F.col("start_line").alias("symbol_start"))
    from codelode.functions import scale

    nodes = scale.points_in_intervals(
        points.distinct(), t.symbol_chunks().select(*G.SCOPE, "chunk_id", "file_path", "start_line", "end_line"),
        [*G.SCOPE, "file_path"], "symbol_start", "start_line", "end_line",
    )
    support = path.select("query_id", "position", "node_id", "file").join(nodes, "node_id").select(
        "query_id", "position", "node_id", "file", F.col("chunk_id").alias("rank"), F.col("chunk_id").alias("evidence_id"),
        F.col("start_line").alias("evidence_start"), F.col("end_line").alias("evidence_end"),
    )
    links = trace.select("query_id", F.explode("edges").alias("e")).select("query_id", "e.*")
    return G.flow_steps(path, support, links), support


@query("flow_steps", recursive(oracle(f"WITH {STEP_SQL} SELECT *, (SELECT string_agg(evidence_id, ',' ORDER BY evidence_id) FROM support u WHERE u.query_id = stepped.query_id AND u.node_id = stepped.node_id AND abs(es - stepped.start_line) <= 5 AND abs(ee - stepped.end_line) <= 5) AS evidence_ids FROM stepped",
    "symbols", "symbol_chunks", "edges")))
def flow_steps(spark, sf):
    steps, _ = stepped(Tables(spark, sf))
    return steps.withColumn("step", F.col("step").cast("long")).withColumn(
        "evidence_ids", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",")
    )


@query("flow_evidence_order", oracle(
    """WITH ev AS (SELECT context_id AS query_id, evidence_id, file_path, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, evidence_id) AS rank FROM evidence),
       nodes AS (SELECT *, CAST(split_part(evidence_id, '-', 2) AS INTEGER) AS position FROM ev WHERE file_path = 'src/f1.py'),
       f AS (SELECT query_id, position, arg_min(evidence_id, rank) AS evidence_id FROM nodes GROUP BY query_id, position),
       p AS (SELECT query_id, evidence_id, min(position) AS pos FROM f GROUP BY query_id, evidence_id),
       r AS (SELECT ev.query_id, ev.evidence_id, row_number() OVER (PARTITION BY ev.query_id ORDER BY coalesce(p.pos, 1000 + ev.rank)) AS new_rank FROM ev LEFT JOIN p ON p.query_id = ev.query_id AND p.evidence_id = ev.evidence_id)
       SELECT query_id, evidence_id, CAST(new_rank AS INTEGER) AS new_rank FROM r WHERE new_rank <= 16""", "evidence"))
def flow_evidence_order(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("context_id").orderBy(F.desc("score"), "evidence_id")
    rows = Tables(spark, sf).evidence().withColumn("rank", F.row_number().over(order)).withColumnRenamed("context_id", "query_id")
    nodes = rows.where("file_path = 'src/f1.py'").withColumn("position", F.split("evidence_id", "-")[1].cast("int"))
    return G.flow_evidence_order(rows.select("query_id", "evidence_id", "rank"), nodes)


@query("flow_audit", recursive(oracle(
    f"""WITH {STEP_SQL}, prop AS (SELECT query_id, step, file, CASE WHEN query_id % 7 = 0 AND step = 2 THEN 'wrong' ELSE symbol END AS symbol, NOT (query_id % 5 = 0 AND step = 3) AS cited FROM stepped WHERE NOT (query_id % 11 = 0 AND step = 1)),
      j AS (SELECT coalesce(p.query_id, o.query_id) AS query_id, p.query_id IS NOT NULL AND o.query_id IS NOT NULL AND p.file = o.file AND p.symbol = o.symbol AND p.cited AS same
        FROM prop p FULL JOIN stepped o ON o.query_id = p.query_id AND o.step = p.step), v AS (SELECT query_id, bool_and(coalesce(same, false)) AS accepted FROM j GROUP BY 1)
      SELECT s.query_id, s.step, file, symbol, relationship_to_next, unresolved, accepted FROM stepped s JOIN v USING (query_id)""", "symbols", "symbol_chunks", "edges")))
def flow_audit(spark, sf):
    observed = stored(stepped(Tables(spark, sf))[0].withColumn("step", F.col("step").cast("long")))
    proposed = observed.where("NOT (query_id % 11 = 0 AND step = 1)").select(
        "query_id", "step", "file", F.expr("CASE WHEN query_id % 7 = 0 AND step = 2 THEN 'wrong' ELSE symbol END").alias("symbol"),
        F.expr("NOT (query_id % 5 = 0 AND step = 3)").alias("cited"),
    )
    return G.flow_audit(proposed, observed)


# ---------------------------------------------------------------- impact

IMPACT_SQL = f"""{OWNER_SQL}, {REFERENCE_SQL},
  ev AS (SELECT o.query_id, o.chunk_id AS evidence_id, c.file_path AS file, c.symbol_name AS evidence_symbol, c.content, c.start_line, list(o.name) AS names
      FROM owners o JOIN symbol_chunks c USING (chunk_id) GROUP BY ALL),
  defs AS (SELECT DISTINCT query_id, file_path AS file, name AS symbol FROM targets),
  direct AS (SELECT d.query_id, d.file, d.symbol, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence_ids FROM defs d JOIN ev ON ev.query_id = d.query_id AND ev.file = d.file
      WHERE coalesce(evidence_symbol = d.symbol, false) OR contains(content, d.symbol) OR list_contains(names, d.symbol) GROUP BY d.query_id, d.file, d.symbol),
  bestref AS (SELECT query_id, file, symbol, arg_min(kind, CASE kind WHEN 'CALLS' THEN '1CALLS' WHEN 'API_CALL' THEN '1API_CALL' WHEN 'IMPORTS' THEN '3' ELSE '2' || kind END) AS kind FROM
      (SELECT * REPLACE (CASE WHEN line % 5 = 0 THEN '<module>' ELSE symbol END AS symbol) FROM refs) GROUP BY query_id, file, symbol),
  indirect AS (SELECT b.* FROM bestref b ANTI JOIN direct USING (query_id, file, symbol)),
  impacted AS (SELECT * FROM indirect i WHERE symbol <> '<module>' OR NOT EXISTS (SELECT 1 FROM indirect x WHERE x.query_id = i.query_id AND x.file = i.file AND x.symbol <> '<module>'))"""
IMPACT_SQL = IMPACT_SQL.replace("USING (chunk_id) GROUP BY ALL)", "USING (chunk_id) GROUP BY o.query_id, o.chunk_id, c.file_path, c.symbol_name, c.content, c.start_line)")


def impact_evidence(t: Tables):
    owners = R.symbol_owner_chunks(R.symbol_matches(t.symbols(), t.symbol_queries()), t.symbol_chunks())
    return owners.drop("file_path").join(t.symbol_chunks(), [*G.SCOPE, "chunk_id"]).select(
        "query_id", F.col("chunk_id").alias("evidence_id"), F.col("file_path").alias("file"), F.col("symbol_name").alias("evidence_symbol"),
        "content", "start_line", F.transform("matched_symbols", lambda s: s["name"]).alias("contained_names"),
    )


def impact_definitions(t: Tables):
    return G.named_targets(t.symbols(), t.symbol_queries()).select(
        "query_id", F.col("file_path").alias("file"), F.col("name").alias("symbol")
    ).distinct()


def impact_reference_rows(t: Tables, direct):
    references = G.find_references(t.symbols(), t.edges(), t.symbol_queries()).withColumn(
        "symbol", F.expr("CASE WHEN line % 5 = 0 THEN '<module>' ELSE symbol END")
    )
    return G.impact_references(references, direct)


@query("impact_direct", oracle(f"WITH {IMPACT_SQL} SELECT * FROM direct", *GRAPH))
def impact_direct(spark, sf):
    t = Tables(spark, sf)
    return G.impact_direct(impact_definitions(t), impact_evidence(t)).withColumn(
        "evidence_ids", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",")
    )


@query("impact_references", oracle(f"WITH {IMPACT_SQL} SELECT * FROM impacted", *GRAPH))
def impact_references(spark, sf):
    t = Tables(spark, sf)
    return impact_reference_rows(t, stored(G.impact_direct(impact_definitions(t), impact_evidence(t))))


@query("impact_mentions", oracle(
    f"""WITH {IMPACT_SQL}, tgt AS (SELECT DISTINCT query_id, split_part(query_text, '_', 2) AS target FROM symbol_queries WHERE contains(query_text, '_')),
      m AS (SELECT ev.query_id, file, evidence_symbol AS symbol, min(evidence_id) AS evidence_id FROM ev JOIN tgt USING (query_id)
        WHERE evidence_symbol IS NOT NULL AND evidence_symbol <> target AND contains(content, target) AND (contains(file, 'test') OR contains(file, 'schema') OR contains(file, 'types') OR prefix(file, 'frontend/')) GROUP BY ev.query_id, file, evidence_symbol)
      SELECT m.* FROM m ANTI JOIN direct USING (query_id, file, symbol)""", *GRAPH))
def impact_mentions(spark, sf):
    t = Tables(spark, sf)
    evidence = stored(impact_evidence(t))
    targets = t.symbol_queries().where("contains(query_text, '_')").select("query_id", F.split("query_text", "_")[1].alias("target"))
    return G.impact_mentions(evidence, targets, G.impact_direct(impact_definitions(t), evidence))


@query("impact_fields", f"""WITH {CODE_SQL} SELECT py AS query_id, py AS file, ua || un || '.size' AS symbol, 'direct' AS bucket, py AS evidence_id FROM code_rows
    UNION ALL SELECT py, py, 'read_' || n || '_' || k, 'indirect', py FROM code_rows UNION ALL SELECT ts, ts, 'use' || ua || un, 'indirect', ts FROM code_rows""")
def impact_fields(spark, sf):
    from codelode.sources.code import code_files

    files = code_files(Tables(spark, sf))
    evidence = files.select(
        F.col("path").alias("query_id"), F.col("path").alias("evidence_id"), F.col("path").alias("file"), "content",
        F.lit(1).alias("start_line"), F.lit(None).cast("string").alias("evidence_symbol"),
        F.expr("cast(array() as array<struct<name:string,start_line:int,end_line:int>>)").alias("contained"),
    )
    fields = files.select(F.col("path").alias("query_id"), F.array(F.lit("size"), F.lit("size_id")).alias("fields"))
    return G.impact_fields(evidence, fields)


BACKFILL = f"""{IMPACT_SQL}, kept AS (SELECT *, evidence_id AS rank FROM ev WHERE evidence_symbol IS NULL),
  c AS (SELECT query_id, file, symbol, [string_split(evidence_ids, ',')[1]] AS ids FROM direct),
  lost AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.query_id = c.query_id AND list_contains(c.ids, k.evidence_id::VARCHAR)))"""


@query("impact_evidence_backfill", oracle(
    f"""WITH {BACKFILL} SELECT l.query_id, l.file, l.symbol, arg_min(k.evidence_id, k.rank) AS evidence_id FROM lost l JOIN kept k ON k.query_id = l.query_id AND k.file = l.file
      WHERE contains(k.content, l.symbol) OR contains(k.content, split_part(l.symbol, '.', -1)) GROUP BY l.query_id, l.file, l.symbol""", *GRAPH))
def impact_evidence_backfill(spark, sf):
    t = Tables(spark, sf)
    evidence = stored(impact_evidence(t))
    kept = evidence.where("evidence_symbol IS NULL").withColumn("rank", F.col("evidence_id"))
    cited_once = G.impact_direct(impact_definitions(t), evidence).withColumn("evidence_ids", F.slice("evidence_ids", 1, 1))
    return G.impact_evidence_backfill(cited_once, kept)


@query("impact_merge", oracle(
    f"""WITH {IMPACT_SQL}, obs AS (SELECT query_id, 'direct' AS bucket, file, symbol, string_split(evidence_ids, ',') AS ids FROM direct
        UNION ALL SELECT query_id, 'indirect', file, symbol, [symbol, kind] FROM impacted),
      j AS (SELECT *, CASE WHEN length(file) % 3 = 0 THEN [ids[1], 'made-up'] WHEN length(file) % 3 = 1 THEN ['made-up'] END AS prop FROM obs)
      SELECT query_id, bucket, file, symbol, array_to_string(CASE WHEN length(file) % 3 = 0 THEN [ids[1]] ELSE ids END, ',') AS evidence_ids,
        CASE WHEN bucket = 'direct' THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN contains(lower(file), 'test') THEN file END AS test_to_inspect FROM j""", *GRAPH))
def impact_merge(spark, sf):
    t = Tables(spark, sf)
    direct = stored(G.impact_direct(impact_definitions(t), impact_evidence(t)))
    indirect = impact_reference_rows(t, direct)
    observed = stored(direct.select(
        "query_id", F.lit("direct").alias("bucket"), "file", "symbol", F.transform("evidence_ids", lambda x: x.cast("string")).alias("evidence_ids")
    ).unionByName(indirect.select("query_id", F.lit("indirect").alias("bucket"), "file", "symbol", F.array("symbol", "kind").alias("evidence_ids"))))
    proposed = observed.where("length(file) % 3 < 2").withColumn(
        "evidence_ids", F.expr("CASE WHEN length(file) % 3 = 0 THEN array(evidence_ids[0], 'made-up') ELSE array('made-up') END")
    )
    return G.impact_merge(proposed, observed).withColumn("evidence_ids", F.array_join("evidence_ids", ","))
