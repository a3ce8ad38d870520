"""Query understanding, cache, redaction and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.catalogue import CATALOGUE
from codelode.functions import text as X
from codelode.operators import cache as H
from codelode.operators import embed as B
from codelode.operators import understand as U
from codelode.plans.retrieve_queries import terms_cte
from codelode.sources.tables import Tables, oracle

query = CATALOGUE.query

STOP = "[" + ",".join(f"'{w}'" for w in X.IDENTIFIER_STOPWORDS) + "]"
COLLAPSED = "trim(regexp_replace(query_text, '\\s+', ' ', 'g'))"


def sql_any(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def sql_shaped(token: str, text: str) -> str:
    quoted = " OR ".join(
        f"contains({text}, {a} || {token} || {b})" for a in ("'`'", "''''", "'\"'") for b in ("'`'", "''''", "'\"'")
    )
    return (
        f"({token} IS NOT NULL AND NOT list_contains({STOP}, lower({token})) AND ({quoted} OR contains({token}, '_') "
        f"OR (regexp_matches({token}, '^[A-Z]') AND {token} <> upper({token})) OR regexp_matches({token}, '^[a-z].*[A-Z]')))"
    )


def sql_found(text: str, pattern: str, group: int = 1) -> str:
    escaped = pattern.replace("'", "''")
    return f"nullif(regexp_extract({text}, '{escaped}', {group}), '')"


TARGETS = f"""v AS (SELECT query_id, query_text, {COLLAPSED} AS value FROM questions),
  r AS (SELECT *, lower(value) AS low, {sql_found('value', U.PATH)} AS file_path, {sql_found('value', U.REFERENCE[0])} AS r1, {sql_found('value', U.REFERENCE[1])} AS r2,
      regexp_replace(value, '^[`''"]+|[`''"]+$', '', 'g') AS bare, {sql_found('value', U.FIND)} AS found FROM v),
  targets AS (SELECT *, CASE WHEN {sql_shaped('r1', 'value')} THEN r1 WHEN {sql_shaped('r2', 'value')} THEN r2 END AS reference_symbol,
      CASE WHEN regexp_full_match(bare, '[A-Za-z_][A-Za-z0-9_]*') THEN bare ELSE found END AS lookup_symbol FROM r)"""


@query("classify_task", oracle(
    f"""WITH {TARGETS} SELECT query_id, CASE WHEN {sql_any('low', U.EXTERNAL_PHRASES)} THEN 'EXTERNAL_DOC_QUERY'
      WHEN prefix(low, 'trace ') OR (contains(low, 'trace') AND contains(low, ' from ') AND contains(low, ' to ')) THEN 'FLOW_TRACE'
      WHEN {sql_any('low', U.IMPACT_PHRASES)} THEN 'CHANGE_IMPACT' WHEN {sql_any('low', U.ARCHITECTURE_PHRASES)} THEN 'ARCHITECTURE_EXPLANATION'
      WHEN reference_symbol IS NOT NULL THEN 'REFERENCE_LOOKUP'
      WHEN file_path IS NOT NULL AND (prefix(low, 'open ') OR prefix(low, 'read ') OR prefix(low, 'show ')) THEN 'DIRECT_FILE_OP'
      WHEN lookup_symbol IS NOT NULL THEN 'SYMBOL_LOOKUP' ELSE 'REPOSITORY_QA' END AS task_type FROM targets""", "questions"))
def classify_task(spark, sf):
    return Tables(spark, sf).questions().select("query_id", U.task_type(F.col("query_text")).alias("task_type"))


@query("extract_identifiers", oracle(
    f"""WITH t AS (SELECT query_id, query_text, generate_subscripts(x, 1) AS n, unnest(x) AS token FROM
        (SELECT query_id, query_text, regexp_extract_all(query_text, '[A-Za-z_][A-Za-z0-9_]*') AS x FROM questions)),
      f AS (SELECT query_id, token, min(n) AS n FROM t WHERE {sql_shaped('token', 'query_text')} GROUP BY ALL)
      SELECT q.query_id, coalesce(string_agg(token, ',' ORDER BY n), '') AS identifiers FROM questions q LEFT JOIN f USING (query_id) GROUP BY 1""", "questions"))
def extract_identifiers(spark, sf):
    return Tables(spark, sf).questions().select(
        "query_id", F.array_join(X.explicit_identifiers(F.col("query_text")), ",").alias("identifiers")
    )


@query("extract_targets", oracle(
    f"WITH {TARGETS} SELECT query_id, file_path, reference_symbol, lookup_symbol FROM targets", "questions"))
def extract_targets(spark, sf):
    value = X.collapse_spaces(F.col("query_text"))
    return Tables(spark, sf).questions().select(
        "query_id", U.file_path(value).alias("file_path"), U.reference_symbol(value).alias("reference_symbol"),
        U.lookup_symbol(value).alias("lookup_symbol"),
    )


@query("mentioned_entity", oracle(
    """WITH e AS (SELECT l_partkey AS query_id, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS top FROM lineitem GROUP BY 1)
       SELECT query_id, coalesce(nullif(regexp_extract(query_text, '[`''"]([A-Za-z_][A-Za-z0-9_]*)[`''"]', 1), ''),
         nullif(regexp_extract(query_text, '\\b([A-Za-z_]+_[A-Za-z0-9_]+)\\b', 1), ''), CAST(top AS VARCHAR)) AS entity FROM questions LEFT JOIN e USING (query_id)""", "questions"))
def mentioned_entity(spark, sf):
    t = Tables(spark, sf)
    evidence = t.raw("lineitem").selectExpr(
        "l_partkey AS query_id", "l_suppkey AS evidence_id", "l_orderkey * 10 + l_linenumber AS rank"
    )
    return U.mentioned_entity(t.questions(), evidence)


# Question marks and conjunctions are turned into one separator first, since RE2 has no look-around.
@query("split_subqueries", oracle(
    f"""WITH v AS (SELECT query_id, {COLLAPSED} AS value FROM questions),
      s AS (SELECT query_id, regexp_replace(regexp_replace(regexp_replace(value, '([?.;]) ', '\\1@@', 'g'), '(?i), ((?:and )?(?:how|where|what|which)\\b)', '@@\\1', 'g'),
        '(?i) and ((?:how|where|what|which)\\b)', '@@\\1', 'g') AS marked FROM v),
      c AS (SELECT query_id, list_filter(list_transform(string_split(marked, '@@'), lambda x: trim(x, ' ,;?.')),
        lambda x: len(regexp_extract_all(x, '[A-Za-z_]+')) >= 3) AS cs FROM s),
      d AS (SELECT query_id, cs, flatten(list_transform(cs, lambda x: list_filter([
          CASE WHEN regexp_matches(x, '(?i)\\b([A-Za-z_]+)\\s+are\\b.+?\\bfor\\s+(?:the\\s+)?(?:current\\s+)?([A-Za-z_]+)\\b') THEN
            regexp_extract(x, '(?i)\\b([A-Za-z_]+)\\s+are\\b.+?\\bfor\\s+(?:the\\s+)?(?:current\\s+)?([A-Za-z_]+)\\b', 2) || ' ' ||
            regexp_extract(x, '(?i)\\b([A-Za-z_]+)\\s+are\\b.+?\\bfor\\s+(?:the\\s+)?(?:current\\s+)?([A-Za-z_]+)\\b', 1) END,
          CASE WHEN regexp_matches(x, '(?i)\\bcurrent\\s+([A-Za-z_]+)\\b') THEN 'current ' || regexp_extract(x, '(?i)\\bcurrent\\s+([A-Za-z_]+)\\b', 1) END],
          lambda y: y IS NOT NULL))) AS ds FROM c),
      g AS (SELECT query_id, cs, list_reduce(list_concat([cs], list_transform(ds, lambda y: [y])), lambda acc, y:
        CASE WHEN len(list_filter(acc, lambda z: lower(z) = lower(y[1]))) > 0 THEN acc ELSE list_concat(acc, y) END) AS grown FROM d)
      SELECT query_id, CASE WHEN len(cs) <= 1 THEN '' ELSE array_to_string(grown[:6], '|') END AS clauses FROM g""", "questions"))
def split_subqueries(spark, sf):
    return Tables(spark, sf).questions().select(
        "query_id", F.array_join(U.subqueries(F.col("query_text")), "|").alias("clauses")
    )


@query("external_doc_flag", oracle(
    f"SELECT query_id, {sql_any('lower(' + COLLAPSED + ')', U.EXTERNAL_PHRASES)} AS is_external FROM questions", "questions"))
def external_doc_flag(spark, sf):
    return Tables(spark, sf).questions().select("query_id", U.is_external(F.col("query_text")).alias("is_external"))


@query("query_fingerprint", f"""SELECT concat(conv_id, '-', turn) AS query_id, sha256(lower({COLLAPSED.replace('query_text', 'text')})) AS query_hash FROM conversations""")
def query_fingerprint(spark, sf):
    return Tables(spark, sf).raw("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), U.query_fingerprint(F.col("text")).alias("query_hash")
    )


# ---------------------------------------------------------------- cache

CACHE = """cache AS (SELECT sha256(split_part(url, '/', 4)) AS query_hash, url, page_id AS position, ts AS retrieved_at FROM pages JOIN events ON event_id = page_id)"""
CUTOFF = "2024-01-01 06:00:00"


def cache_rows(t: Tables):
    seen = t.raw("events").select(F.col("event_id").alias("page_id"), F.col("ts").alias("retrieved_at"))
    return t.raw("pages").join(seen, "page_id").select(
        F.sha2(F.split_part("url", F.lit("/"), F.lit(4)), 256).alias("query_hash"), "url",
        F.col("page_id").alias("position"), "retrieved_at",
    )


def cutoff():
    return F.to_timestamp_ntz(F.lit(CUTOFF))


@query("cache_lookup", f"""WITH {CACHE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY position, url) AS rank FROM cache WHERE retrieved_at >= TIMESTAMP '{CUTOFF}')
    SELECT query_hash, url, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND query_hash IN (SELECT sha256(l) FROM (VALUES ('en'), ('de'), ('fr')) v(l))""")
def cache_lookup(spark, sf):
    t = Tables(spark, sf)
    requests = t.raw("documents").where("lang IN ('en', 'de', 'fr')").select(F.sha2("lang", 256).alias("query_hash"))
    return H.cache_lookup(cache_rows(t), requests, cutoff()).select("query_hash", "url", "rank")


@query("cache_upsert", f"""WITH {CACHE}, e AS (SELECT *, 0 AS fresh FROM cache UNION ALL
      SELECT query_hash, split_part(url, '?', 1), position + 1000, retrieved_at + INTERVAL 1 HOUR, 1 FROM cache WHERE contains(url, '?')),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_hash, url ORDER BY retrieved_at DESC, fresh DESC, position DESC) AS n FROM e)
    SELECT query_hash, url, position, strftime(retrieved_at, '%Y-%m-%d %H:%M:%S') AS retrieved FROM r WHERE n = 1""")
def cache_upsert(spark, sf):
    rows = cache_rows(Tables(spark, sf))
    incoming = rows.where("contains(url, '?')").select(
        "query_hash", F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), (F.col("position") + 1000).alias("position"),
        F.expr("retrieved_at + INTERVAL 1 HOUR").alias("retrieved_at"),
    )
    done = H.cache_upsert(rows, incoming)
    return done.select("query_hash", "url", "position", F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss").alias("retrieved"))


@query("cache_prune", f"WITH {CACHE} SELECT query_hash, url, position FROM cache WHERE retrieved_at >= TIMESTAMP '{CUTOFF}'")
def cache_prune(spark, sf):
    return H.cache_prune(cache_rows(Tables(spark, sf)), cutoff()).select("query_hash", "url", "position")


RESULTS = """results AS (SELECT split_part(url, '/', 4) AS query_id, CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 3 = 0 THEN upper(url) ELSE url END AS url,
    CASE WHEN page_id % 5 <> 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, page_id AS position FROM pages)"""


@query("url_domain", f"""WITH {RESULTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position, url) AS rank FROM results WHERE url <> '')
    SELECT query_id, url, CASE WHEN coalesce(title, '') = '' THEN 'Untitled result' ELSE title END AS title, lower(regexp_extract(url, '(?i)^[a-z]+://([^/?#]*)', 1)) AS source_domain
    FROM r WHERE rank <= 5""")
def url_domain(spark, sf):
    results = Tables(spark, sf).raw("pages").selectExpr(
        "split_part(url, '/', 4) AS query_id",
        "CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 3 = 0 THEN upper(url) ELSE url END AS url",
        "CASE WHEN page_id % 5 <> 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title", "page_id AS position",
    )
    return H.url_domain(results)


ARGS_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("API-Key", T.StringType()),
    T.StructField("options", T.MapType(T.StringType(), T.StringType())),
    T.StructField("auth", T.StructType([
        T.StructField("user", T.StringType()), T.StructField("refresh_token", T.StringType()),
        T.StructField("hosts", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()), T.StructField("password", T.StringType()),
        ]))),
    ])),
])


@query("redact_arguments", """SELECT event_id AS call_id, concat('{"query":"', event_type, '","API-Key":"[REDACTED]","options":{"limit":"5","', CASE WHEN value > 50 THEN 'x_secret_y' ELSE 'plain' END, '":"',
    CASE WHEN value > 50 THEN '[REDACTED]' ELSE 'v' || event_id END, '"},"auth":{"user":"u', user_id, '","refresh_token":"[REDACTED]","hosts":[{"name":"h', event_id, '","password":"[REDACTED]"}]}}') AS args FROM events""")
def redact_arguments(spark, sf):
    calls = Tables(spark, sf).raw("events").select(
        F.col("event_id").alias("call_id"),
        F.expr(
            """concat('{"query":"', event_type, '","API-Key":"k', event_id, '","options":{"limit":"5","', CASE WHEN value > 50 THEN 'x_secret_y' ELSE 'plain' END,
               '":"v', event_id, '"},"auth":{"user":"u', user_id, '","refresh_token":"t","hosts":[{"name":"h', event_id, '","password":"p"}]}}')"""
        ).alias("args"),
    )
    return H.redact_arguments(calls, ARGS_SCHEMA)


# ---------------------------------------------------------------- embedding

EMB = """emb AS (SELECT doc_id AS chunk_id, sha256(text) AS content_hash, text AS content,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE [CAST(doc_id AS DOUBLE)] END AS embedding, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'm0' ELSE 'm1' END AS model_version FROM documents),
  pending AS (SELECT * FROM emb WHERE embedding IS NULL OR model_version IS DISTINCT FROM 'm1')"""


def embedded_chunks(t: Tables):
    return t.raw("documents").selectExpr(
        "doc_id AS chunk_id", "sha2(text, 256) AS content_hash", "text AS content",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE array(cast(doc_id as double)) END AS embedding",
        "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'm0' ELSE 'm1' END AS model_version",
    )


@query("embedding_pending", f"WITH {EMB} SELECT chunk_id, model_version FROM pending")
def embedding_pending(spark, sf):
    return B.embedding_pending(embedded_chunks(Tables(spark, sf)), "m1").select("chunk_id", "model_version")


@query("embedding_cache_reuse", f"""WITH {EMB}, c AS (SELECT content_hash, arg_min(embedding, chunk_id) AS cached FROM emb WHERE embedding IS NOT NULL AND model_version = 'm1' GROUP BY 1)
    SELECT chunk_id, cached[1] AS first_value, cached IS NOT NULL AS reused FROM pending LEFT JOIN c USING (content_hash)""")
def embedding_cache_reuse(spark, sf):
    rows = embedded_chunks(Tables(spark, sf))
    done = B.embedding_cache_reuse(B.embedding_pending(rows, "m1"), rows, "m1")
    return done.select("chunk_id", F.col("embedding")[0].alias("first_value"), "reused")


@query("embedding_dedupe", f"WITH {EMB} SELECT content_hash, min(chunk_id) AS representative_id, arg_min(content, chunk_id) AS content, count(*) AS copies FROM pending GROUP BY 1")
def embedding_dedupe(spark, sf):
    return B.embedding_dedupe(B.embedding_pending(embedded_chunks(Tables(spark, sf)), "m1"))


@query("hash_embedding", oracle(
    f"""WITH {terms_cte('chunks', 'chunk_id', 'content')},
      b AS (SELECT chunk_id, CAST(concat('0x', substring(sha256(term), 1, 8)) AS BIGINT) % 384 AS bucket, count(*) AS n FROM chunks_terms GROUP BY ALL),
      z AS (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1),
      g AS (SELECT chunk_id, k AS bucket FROM chunks, range(384) r(k))
      SELECT g.chunk_id, list(round(coalesce(n / norm, 0), 6)::DOUBLE ORDER BY g.bucket) AS embedding
      FROM g LEFT JOIN b ON b.chunk_id = g.chunk_id AND b.bucket = g.bucket LEFT JOIN z ON z.chunk_id = g.chunk_id GROUP BY g.chunk_id""", "chunks"))
def hash_embedding(spark, sf):
    vectors = B.hash_embedding(Tables(spark, sf).chunks(), F.col("content"))
    return vectors.select("chunk_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))
