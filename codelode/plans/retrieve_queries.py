"""Retrieval queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.catalogue import CATALOGUE
from codelode.functions.stemmer import STEP_2, STEP_3, STEP_4
from codelode.functions import text as X
from codelode.operators import retrieve as R
from codelode.sources.tables import MODEL_VERSION, Tables, oracle

query = CATALOGUE.query

STOP = "[" + ",".join(f"'{w}'" for w in X.STOPWORDS) + "]"
GENERIC = "[" + ",".join(f"'{w}'" for w in X.GENERIC_TERMS) + "]"


def sql_stem(x: str) -> str:
    return (
        f"CASE WHEN suffix({x}, 'ing') AND length({x}) > 5 THEN {x}[:-4] "
        f"WHEN suffix({x}, 'ed') AND length({x}) > 4 THEN {x}[:-3] "
        f"WHEN suffix({x}, 's') AND length({x}) > 3 THEN {x}[:-2] ELSE {x} END"
    )


def sql_tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda z: lower(z))"


def terms_cte(source: str, id_column: str = "query_id", text: str = "query_text") -> str:
    """CTEs `<source>_terms(id, pos, term)`: numbered pieces, first occurrence kept, then joined words."""
    s = source
    return f"""
    {s}_raw AS (SELECT {id_column}, generate_subscripts(t, 1) AS tok, unnest(t) AS token FROM
        (SELECT {id_column}, regexp_extract_all({text}, '[A-Za-z0-9_]+') AS t FROM {s})),
    {s}_parts AS (SELECT {id_column}, tok, token, generate_subscripts(p, 1) AS part, unnest(p) AS piece
        FROM (SELECT *, string_split(token, '_') AS p FROM {s}_raw)),
    {s}_camel AS (SELECT {id_column}, tok, part, generate_subscripts(c, 1) AS sub, unnest(c) AS piece FROM (
        SELECT {id_column}, tok, part, list_filter(string_split(
          regexp_replace(regexp_replace(regexp_replace(regexp_replace(piece,
            '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'),
            '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), ' '), lambda z: z <> '') AS c
        FROM {s}_parts)),
    {s}_pieces AS (
        SELECT {id_column}, tok, 0 AS stage, 0 AS part, 0 AS sub, lower(token) AS term FROM {s}_raw
        UNION ALL SELECT {id_column}, tok, 1, part, 0, lower(piece) FROM {s}_parts
        UNION ALL SELECT {id_column}, tok, 2, part, sub, lower(piece) FROM {s}_camel),
    {s}_joined AS (SELECT {id_column}, tok, {sql_stem('a')} || b AS term FROM (
        SELECT {id_column}, tok, lower(token) AS a, lower(lead(token) OVER (PARTITION BY {id_column} ORDER BY tok)) AS b
        FROM {s}_raw) WHERE b IN ('in', 'on', 'up', 'out')),
    {s}_all AS (
        SELECT {id_column}, 0 AS late, tok, stage, part, sub, term FROM {s}_pieces
        WHERE length(term) >= 3 AND NOT list_contains({STOP}, term)
        UNION ALL SELECT {id_column}, 1, tok, 0, 0, 0, term FROM {s}_joined),
    {s}_terms AS (SELECT {id_column}, term, row_number() OVER (PARTITION BY {id_column} ORDER BY late, tok, stage, part, sub) AS pos
        FROM (SELECT *, row_number() OVER (PARTITION BY {id_column}, term ORDER BY late, tok, stage, part, sub) AS seen
              FROM {s}_all) WHERE seen = 1)"""


@query(
    "tokenize",
    oracle(f"SELECT chunk_id, array_to_string({sql_tokens('content')}, ' ') AS tokens FROM chunks", "chunks"),
)
def tokenize(spark, sf):
    return Tables(spark, sf).chunks().select(
        "chunk_id", F.array_join(X.tokens(F.col("content")), " ").alias("tokens")
    )


@query(
    "query_terms",
    oracle(
        f"""WITH both_q AS (SELECT concat('b', query_id) AS query_id, query_text FROM queries
             UNION ALL SELECT concat('q', query_id), query_text FROM questions), {terms_cte('both_q')}
        SELECT b.query_id, coalesce(string_agg(t.term, ' ' ORDER BY t.pos), '') AS terms
        FROM both_q b LEFT JOIN both_q_terms t USING (query_id) GROUP BY b.query_id""",
        "queries", "questions",
    ),
)
def query_terms(spark, sf):
    t = Tables(spark, sf)
    both = t.queries().select(F.concat(F.lit("b"), "query_id").alias("query_id"), "query_text").unionByName(
        t.questions().select(F.concat(F.lit("q"), "query_id").alias("query_id"), "query_text")
    )
    return both.select("query_id", F.array_join(X.query_terms(F.col("query_text")), " ").alias("terms"))


@query(
    "distinctive_terms",
    oracle(
        f"""WITH {terms_cte('questions')}
        SELECT b.query_id, coalesce(string_agg(t.term, ' ' ORDER BY t.pos), '') AS terms
        FROM questions b LEFT JOIN (SELECT * FROM questions_terms WHERE NOT list_contains({GENERIC}, term)) t
        USING (query_id) GROUP BY b.query_id""",
        "questions",
    ),
)
def distinctive_terms(spark, sf):
    return Tables(spark, sf).questions().select(
        "query_id", F.array_join(X.distinctive_terms(X.query_terms(F.col("query_text"))), " ").alias("terms")
    )


@query(
    "stem_match",
    oracle(
        f"""WITH {terms_cte('symbol_chunks', 'chunk_id', 'symbol_text')},
        stems AS (SELECT DISTINCT chunk_id, {sql_stem('w')} AS st FROM (
            SELECT chunk_id, unnest({sql_tokens('content')}) AS w FROM symbol_chunks))
        SELECT c.chunk_id, coalesce(string_agg(t.term, ' ' ORDER BY t.pos) FILTER (WHERE s.st IS NOT NULL), '') AS matched
        FROM symbol_chunks c LEFT JOIN symbol_chunks_terms t USING (chunk_id)
        LEFT JOIN stems s ON s.chunk_id = c.chunk_id AND s.st = {sql_stem('t.term')}
        GROUP BY c.chunk_id""",
        "symbol_chunks",
    ).replace("AS content\n        FROM part", "AS content, concat(p_name, 'ing ', lower(p_type), ' logged in parts returning') AS symbol_text FROM part"),
)
def stem_match(spark, sf):
    t = Tables(spark, sf)
    asked = t.raw("part").select(
        F.col("p_partkey").alias("chunk_id"),
        F.expr("concat(p_name, 'ing ', lower(p_type), ' logged in parts returning')").alias("symbol_text"),
    )
    joined = t.symbol_chunks().join(asked, "chunk_id")
    return joined.select(
        "chunk_id",
        F.array_join(X.stem_matches(X.query_terms(F.col("symbol_text")), F.col("content")), " ").alias("matched"),
    )


def same(a: str, b: str) -> str:
    """Both rows belong to one corpus version."""
    return f"{a}.repository_id = {b}.repository_id AND {a}.index_version = {b}.index_version"


SEMANTIC_SQL = """
  scored AS (SELECT q.query_id, v.chunk_id, round(coalesce(
      list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.query_embedding AS DOUBLE[]))
      / nullif(sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))
             * sqrt(list_dot_product(CAST(q.query_embedding AS DOUBLE[]), CAST(q.query_embedding AS DOUBLE[]))), 0), 0), 12) AS raw_score
    FROM vectors v JOIN query_vectors q ON v.repository_id = q.repository_id AND v.index_version = q.index_version {where}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rank FROM scored)
"""


def six_digits(found):
    """Scores are ranked as they are and rounded only for the comparison."""
    return found.select("query_id", "chunk_id", F.round("raw_score", 6).alias("raw_score"), "rank")


@query(
    "semantic_topk",
    oracle(
        "WITH " + SEMANTIC_SQL.format(where="")
        + "SELECT query_id, chunk_id, round(raw_score, 6) AS raw_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 30",
        "vectors", "query_vectors",
    ),
)
def semantic_topk(spark, sf):
    t = Tables(spark, sf)
    return six_digits(R.semantic_topk(t.vectors(), t.query_vectors()))


@query(
    "stale_vector_filter",
    oracle(
        "WITH " + SEMANTIC_SQL.format(where=f"WHERE v.model_version = '{MODEL_VERSION}'")
        + "SELECT query_id, chunk_id, round(raw_score, 6) AS raw_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10",
        "vectors", "query_vectors",
    ),
)
def stale_vector_filter(spark, sf):
    t = Tables(spark, sf)
    return six_digits(R.semantic_topk(R.active_vectors(t.vectors(), MODEL_VERSION), t.query_vectors(), 10))


LEXICAL_SQL = f"""{terms_cte('queries')},
  n AS (SELECT query_id, count(*) AS n_terms FROM queries_terms GROUP BY 1),
  tf AS (SELECT repository_id, index_version, chunk_id, term, count(*) AS tf FROM (
      SELECT repository_id, index_version, chunk_id, unnest({sql_tokens('content')}) AS term FROM chunks) GROUP BY ALL),
  m AS (SELECT query_id, chunk_id, sum(tf) AS hits, count(*) AS matched
      FROM queries_terms JOIN queries USING (query_id) JOIN tf USING (term, repository_id, index_version) GROUP BY ALL),
  s AS (SELECT q.query_id, c.chunk_id, c.file_path, c.start_line, n_terms, coalesce(hits, 0) AS hits,
      coalesce(matched, 0) AS matched, CASE WHEN contains(lower(c.content), lower(trim(q.query_text))) THEN 1 ELSE 0 END AS phrase
      FROM queries q JOIN n USING (query_id) JOIN chunks c ON {same('c', 'q')}
      LEFT JOIN m ON m.query_id = q.query_id AND m.chunk_id = c.chunk_id),
  lexical_scored AS (SELECT *, matched = n_terms AS is_strict, hits + phrase + matched / n_terms AS raw_score
      FROM s WHERE hits + phrase > 0),
  tier AS (SELECT query_id, bool_or(is_strict) AS best FROM lexical_scored GROUP BY 1),
  lexical_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, file_path, start_line, chunk_id) AS rank
      FROM lexical_scored JOIN tier USING (query_id) WHERE is_strict = best)"""


@query(
    "lexical_topk",
    oracle(
        f"WITH {LEXICAL_SQL} SELECT query_id, chunk_id, round(raw_score, 6) AS raw_score, is_strict, CAST(rank AS INTEGER) AS rank "
        "FROM lexical_ranked WHERE rank <= 30",
        "queries", "chunks",
    ),
)
def lexical_topk(spark, sf):
    t = Tables(spark, sf)
    return R.lexical_topk(t.chunks(), t.queries()).select(
        "query_id", "chunk_id", F.round("raw_score", 6).alias("raw_score"), "is_strict", "rank"
    )


def sql_porter(words: str) -> str:
    """CTEs that end with porter(word, term): the Porter stem of the words of a CTE, step by step."""
    def shape(x: str) -> str:
        # every y after a consonant is a vowel; doubled y are told apart from left to right
        marked = f"regexp_replace(regexp_replace(regexp_replace({x}, '^yy', 'yV'), '([aeiou]y)y', '\\1V', 'g'), '([bcdfghjklmnpqrstvwxz])y', '\\1V', 'g')"
        return f"regexp_replace(regexp_replace({marked}, '[aeiou]', 'V', 'g'), '[^V]', 'C', 'g')"

    def least(x: str, m: int) -> str:
        return f"regexp_matches({shape(x)}, '^C*(V+C+){{{m}}}')"

    def cut(n: int) -> str:
        return f"left(w, length(w) - {n})"

    def short(x: str) -> str:
        return f"(suffix({shape(x)}, 'CVC') AND NOT regexp_matches({x}, '[wxy]$'))"

    def longest(suffixes: dict[str, str], m: int) -> str:
        cases = " ".join(
            f"WHEN suffix(w, '{x}') THEN CASE WHEN {least(cut(len(x)), m)}{extra} THEN {cut(len(x))} || '{to}' ELSE w END"
            for x, to in sorted(suffixes.items(), key=lambda p: -len(p[0]))
            for extra in [f" AND regexp_matches({cut(len(x))}, '[st]$')" if x == "ion" else ""]
        )
        return f"CASE {cases} ELSE w END"

    vowel = lambda x: f"contains({shape(x)}, 'V')"
    steps = [
        f"CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {cut(2)} WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN {cut(1)} ELSE w END, false",
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {least(cut(3), 1)} THEN {cut(1)} ELSE w END WHEN suffix(w, 'ed') AND {vowel(cut(2))} THEN {cut(2)}"
        f" WHEN suffix(w, 'ing') AND {vowel(cut(3))} THEN {cut(3)} ELSE w END,"
        f" NOT suffix(w, 'eed') AND (suffix(w, 'ed') AND {vowel(cut(2))} OR suffix(w, 'ing') AND {vowel(cut(3))})",
        f"CASE WHEN NOT took THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'"
        f" WHEN w[-1] = w[-2] AND suffix({shape('w')}, 'CC') AND NOT regexp_matches(w, '[lsz]$') THEN {cut(1)}"
        f" WHEN {least('w', 1)} AND NOT {least('w', 2)} AND {short('w')} THEN w || 'e' ELSE w END, false",
        f"CASE WHEN suffix(w, 'y') AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE w END, false",
        f"{longest(STEP_2, 1)}, false", f"{longest(STEP_3, 1)}, false", f"{longest(dict.fromkeys(STEP_4, ''), 2)}, false",
        f"CASE WHEN suffix(w, 'e') AND ({least(cut(1), 2)} OR {least(cut(1), 1)} AND NOT {short(cut(1))}) THEN {cut(1)} ELSE w END, false",
        f"CASE WHEN suffix(w, 'll') AND {least('w', 2)} THEN {cut(1)} ELSE w END, false",
    ]
    ctes = [f"porter_0 AS (SELECT DISTINCT word, word AS w, false AS took FROM {words})"]
    ctes += [f"porter_{n + 1}(word, w, took) AS (SELECT word, {step} FROM porter_{n})" for n, step in enumerate(steps)]
    ctes.append(f"porter AS (SELECT word, CASE WHEN regexp_matches(word, '^[a-z]{{3,}}$') THEN w ELSE word END AS term FROM porter_{len(steps)})")
    return ",\n        ".join(ctes)


@query(
    "fulltext_rank",
    oracle(
        f"""WITH {terms_cte('queries')},
        w AS (SELECT repository_id, index_version, chunk_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos
          FROM (SELECT *, {sql_tokens('content')} AS t FROM chunks)),
        said AS (SELECT word FROM w UNION SELECT term FROM queries_terms), {sql_porter('said')},
        a AS (SELECT DISTINCT q.repository_id, q.index_version, t.query_id, p.term FROM queries_terms t JOIN queries q USING (query_id) JOIN porter p ON p.word = t.term),
        n AS (SELECT query_id, count(*) AS n_terms FROM a GROUP BY 1),
        h AS (SELECT a.query_id, w.chunk_id, w.pos, a.term, lead(w.pos) OVER s AS next_pos, lead(a.term) OVER s AS next_term
          FROM a JOIN porter p ON p.term = a.term JOIN w ON {same('a', 'w')} AND w.word = p.word WINDOW s AS (PARTITION BY a.query_id, w.chunk_id ORDER BY w.pos)),
        d AS (SELECT query_id, chunk_id, count(DISTINCT term) AS matched, count(*) AS hits,
          round(coalesce(sum(CASE WHEN next_term <> term THEN 1.0::DOUBLE / (next_pos - pos + 1) ELSE 0 END), 0), 9) AS covers FROM h GROUP BY query_id, chunk_id),
        z AS (SELECT query_id, chunk_id, CASE WHEN matched = 1 THEN hits * 0.1::DOUBLE ELSE covers END AS raw_score, matched = n_terms AS is_strict FROM d JOIN n USING (query_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_strict DESC, raw_score DESC, chunk_id) AS rank, bool_or(is_strict) OVER (PARTITION BY query_id) AS tier FROM z)
        SELECT query_id, chunk_id, round(raw_score, 6) AS raw_score, is_strict, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30 AND is_strict = tier""",
        "queries", "chunks",
    ),
)
def fulltext_rank(spark, sf):
    t = Tables(spark, sf)
    return R.fulltext_rank(t.chunks(), t.queries()).select(
        "query_id", "chunk_id", F.round("raw_score", 6).alias("raw_score"), "is_strict", "rank"
    )


EXACT_SQL = f"""
  exact AS (SELECT q.query_id, s.*, CASE WHEN s.name = q.query_text THEN 1.0 ELSE 0.95 END::DOUBLE AS score,
      CASE WHEN s.name = q.query_text THEN 'exact_case_sensitive' ELSE 'exact_case_insensitive' END AS match_type
      FROM symbols s JOIN symbol_queries q ON lower(s.name) = lower(q.query_text) AND {same('s', 'q')})"""
GRAM_SQL = """
  names AS (SELECT DISTINCT repository_id, index_version, name FROM symbols),
  ng AS (SELECT repository_id, index_version, name, g, count(*) AS k FROM (SELECT repository_id, index_version, name, unnest(list_transform(range(1, length(name) + 2),
      lambda i: substring('  ' || lower(name) || ' ', i, 3))) AS g FROM names) GROUP BY ALL),
  qg AS (SELECT repository_id, index_version, query_id, query_text, g, count(*) AS k FROM (SELECT repository_id, index_version, query_id, query_text, unnest(list_transform(range(1, length(query_text) + 2),
      lambda i: substring('  ' || lower(query_text) || ' ', i, 3))) AS g FROM symbol_queries) GROUP BY ALL),
  dice AS (SELECT repository_id, index_version, query_id, query_text, name, 2.0::DOUBLE * sum(least(ng.k, qg.k))::DOUBLE / (length(name) + 1 + length(query_text) + 1) AS score
      FROM ng JOIN qg USING (g, repository_id, index_version) WHERE lower(name) <> lower(query_text) GROUP BY repository_id, index_version, query_id, query_text, name),
  fuzzy AS (SELECT * FROM (SELECT query_id, s.*, score, 'fuzzy' AS match_type,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.name, s.symbol_id) AS rk
      FROM dice JOIN symbols s USING (repository_id, index_version, name) WHERE score > 0.3) WHERE rk <= 10)"""
MATCH_COLUMNS = "query_id, repository_id, index_version, symbol_id, name, file_path, symbol_type, start_line, end_line, parent_symbol, score, match_type"
MATCH_SQL = f"{EXACT_SQL}, {GRAM_SQL}, matches AS (SELECT {MATCH_COLUMNS} FROM exact UNION ALL SELECT {MATCH_COLUMNS} FROM fuzzy)"
OWNER_SQL = f"""{MATCH_SQL},
  owners AS (SELECT m.query_id, m.repository_id, m.index_version, c.chunk_id, c.file_path, m.score, m.name, m.match_type, m.start_line AS symbol_start,
      m.end_line AS symbol_end, c.start_line, c.end_line, m.symbol_id, m.symbol_type, m.parent_symbol
      FROM matches m JOIN symbol_chunks c ON {same('c', 'm')} AND c.file_path = m.file_path
      AND (c.symbol_name = m.name OR m.start_line BETWEEN c.start_line AND c.end_line))"""


@query("symbol_exact", oracle(f"WITH {EXACT_SQL} SELECT query_id, symbol_id, score, match_type FROM exact", "symbols", "symbol_queries"))
def symbol_exact(spark, sf):
    t = Tables(spark, sf)
    return R.symbol_exact(t.symbols(), t.symbol_queries()).select("query_id", "symbol_id", "score", "match_type")


@query("symbol_fuzzy", oracle(f"WITH {GRAM_SQL} SELECT query_id, symbol_id, name, round(score, 6) AS score FROM fuzzy", "symbols", "symbol_queries"))
def symbol_fuzzy(spark, sf):
    t = Tables(spark, sf)
    return R.symbol_fuzzy(t.symbols(), t.symbol_queries()).select("query_id", "symbol_id", "name", F.round("score", 6).alias("score"))


@query(
    "symbol_owner_chunks",
    oracle(
        f"""WITH {OWNER_SQL} SELECT query_id, chunk_id, round(max(score), 6) AS raw_score,
        string_agg(DISTINCT lpad(symbol_start::VARCHAR, 6, '0') || ':' || name || ':' || match_type, ',' ORDER BY
          lpad(symbol_start::VARCHAR, 6, '0') || ':' || name || ':' || match_type) AS matched
        FROM owners GROUP BY query_id, chunk_id""",
        "symbols", "symbol_queries", "symbol_chunks",
    ),
)
def symbol_owner_chunks(spark, sf):
    t = Tables(spark, sf)
    matches = R.symbol_matches(t.symbols(), t.symbol_queries())
    owners = R.symbol_owner_chunks(matches, t.symbol_chunks())
    label = F.transform(
        "matched_symbols",
        lambda s: F.concat_ws(":", F.lpad(s["symbol_start"].cast("string"), 6, "0"), s["name"], s["match_type"]),
    )
    return owners.select(
        "query_id", "chunk_id", F.round("raw_score", 6).alias("raw_score"), F.array_join(F.array_sort(F.array_distinct(label)), ",").alias("matched")
    )


@query(
    "contained_symbols",
    oracle(
        f"""WITH {OWNER_SQL},
        own AS (SELECT DISTINCT query_id, repository_id, index_version, chunk_id, file_path, start_line, end_line FROM owners),
        alls AS (SELECT query_id, chunk_id, name, symbol_start, symbol_end, 0 AS p, match_type FROM owners
          UNION ALL SELECT o.query_id, o.chunk_id, s.name, s.start_line, s.end_line, 1, 'contained'
          FROM own o JOIN symbols s ON {same('s', 'o')} AND s.file_path = o.file_path AND s.start_line BETWEEN o.start_line AND o.end_line)
        SELECT query_id, chunk_id, name, symbol_start, symbol_end, substring(min(p || match_type), 2) AS match_type
        FROM alls GROUP BY query_id, chunk_id, name, symbol_start, symbol_end""",
        "symbols", "symbol_queries", "symbol_chunks",
    ),
)
def contained_symbols(spark, sf):
    t = Tables(spark, sf)
    matches = R.symbol_matches(t.symbols(), t.symbol_queries())
    return R.contained_symbols(matches, t.symbol_chunks(), t.symbols()).drop(*R.SCOPE)
