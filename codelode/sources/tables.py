"""Logical tables derived from the given parquet tables.

Every derivation is a row-wise projection, so it scales with its input and needs no shuffle.
`SQL` holds the same derivations as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as X

MODEL_VERSION = "m1"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def files(self) -> DataFrame:
        """One stored file per document; the source is the corpus."""
        return self.raw("documents").select(
            F.col("source").alias("repository_id"),
            F.col("doc_id").alias("file_id"),
            F.expr("concat(source, '/', lang, '/doc_', doc_id, '.md')").alias("path"),
            F.col("lang").alias("language"),
            F.octet_length("text").cast("long").alias("size_bytes"),
            F.sha2("text", 256).alias("sha"),
            F.col("text").alias("content"),
        )

    def chunks(self) -> DataFrame:
        """One retrieval chunk per document."""
        return self.raw("documents").select(
            F.col("source").alias("repository_id"),
            F.expr("cast(1 + floor(doc_id / 20) % 2 as int)").alias("index_version"),
            F.col("doc_id").alias("chunk_id"),
            F.expr("concat(lang, '/doc_', cast(floor(doc_id / 40) as bigint), '.md')").alias("file_path"),
            F.lit(1).alias("start_line"),
            X.line_count(F.col("text")).alias("end_line"),
            F.col("text").alias("content"),
        )

    def queries(self) -> DataFrame:
        """Every benchmark text, asked in each of the 40 versions of the 20 corpora."""
        return self.raw("benchmark").select("*", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("_n")).select(
            F.expr("item_id * 40 + _n").alias("query_id"), F.expr("concat('src', _n % 20)").alias("repository_id"),
            F.expr("cast(1 + floor(_n / 20) as int)").alias("index_version"), F.col("text").alias("query_text"),
        )

    def questions(self) -> DataFrame:
        """Question texts of many shapes, spun from parts so that every rule fires."""
        return self.raw("part").select(
            F.col("p_partkey").alias("query_id"),
            F.expr(
                """
                concat(
                  element_at(array('Where is `', 'How does ', 'trace ', 'What is affected by ',
                    'open src/', 'Explain the architecture of ', 'usages of ', 'find ', 'official docs for ',
                    'Suppose we logged in and changed ', 'Which parts are listed for the current ', ''),
                    cast(p_partkey % 12 + 1 as int)),
                  element_at(array(replace(p_name, ' ', '_'), concat(initcap(split(p_name, ' ')[0]),
                    initcap(split(p_name, ' ')[1])), p_name, concat(split(p_name, ' ')[0],
                    initcap(split(p_name, ' ')[1]))), cast(p_size % 4 + 1 as int)),
                  element_at(array('` used?', ' from frontend form to the api', ', and how is it stored', '.py', '',
                    ' request when users sign up', ' schema; where are tokens saved? what happens next',
                    ' and what is the current owner'),
                    cast((p_partkey + p_size) % 8 + 1 as int)))
                """
            ).alias("query_text"),
        )

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.expr("concat('c', vec_id % 3)").alias("repository_id"),
            F.expr("cast(1 + floor(vec_id / 3) % 2 as int)").alias("index_version"),
            F.col("vec_id").alias("chunk_id"),
            "embedding",
            F.expr("concat('m', label % 2)").alias("model_version"),
            "label",
        )

    def query_vectors(self) -> DataFrame:
        """One question vector per label and corpus version: the vector with the lowest id there."""
        return self.vectors().groupBy("repository_id", "index_version", "label").agg(
            F.min_by("embedding", "chunk_id").alias("query_embedding")
        ).select(F.concat_ws(":", "repository_id", "index_version", "label").alias("query_id"), "repository_id", "index_version", "query_embedding")

    def symbols(self) -> DataFrame:
        return self.raw("part").select(
            F.expr("concat('c', p_partkey % 3)").alias("repository_id"),
            F.expr("cast(1 + floor(p_partkey / 3) % 2 as int)").alias("index_version"),
            F.col("p_partkey").alias("symbol_id"),
            F.expr(
                "CASE WHEN p_size % 10 = 0 THEN replace(initcap(p_name), ' ', '_') "
                "ELSE replace(p_name, ' ', '_') END"
            ).alias("name"),
            F.expr(
                "concat(CASE p_type WHEN 'ECONOMY' THEN 'frontend/' WHEN 'PROMO' THEN 'backend/tests/' "
                "ELSE 'backend/' END, lower(p_type), '/m', cast(floor(p_partkey / 40) as bigint), '.py')"
            ).alias("file_path"),
            F.expr(
                "element_at(array('FUNCTION','METHOD','CLASS','INTERFACE','TYPE','HOOK'), cast(p_size % 6 + 1 as int))"
            ).alias("symbol_type"),
            F.expr("cast(p_partkey % 200 + 1 as int)").alias("start_line"),
            F.expr("cast(p_partkey % 200 + 1 + p_size as int)").alias("end_line"),
            F.expr("CASE WHEN p_size % 6 = 1 THEN concat('hot_', split(p_name, ' ')[1]) END").alias("parent_symbol"),
        )

    def symbol_chunks(self) -> DataFrame:
        """Chunks that carry a symbol name, for joins between symbols and chunks."""
        return self.raw("part").select(
            F.expr("concat('c', p_partkey % 3)").alias("repository_id"),
            F.expr("cast(1 + floor(p_partkey / 3) % 2 as int)").alias("index_version"),
            F.col("p_partkey").alias("chunk_id"),
            F.expr(
                "concat(CASE p_type WHEN 'ECONOMY' THEN 'frontend/' WHEN 'PROMO' THEN 'backend/tests/' "
                "ELSE 'backend/' END, lower(p_type), '/m', cast(floor(p_partkey / 40) as bigint), '.py')"
            ).alias("file_path"),
            F.expr("CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') END").alias("symbol_name"),
            F.expr("cast(p_partkey % 200 + 1 as int)").alias("start_line"),
            F.expr("cast(p_partkey % 200 + 4 + p_size % 17 as int)").alias("end_line"),
            F.expr(
                "concat('def ', replace(p_name, ' ', '_'), '(x): return ', replace(p_name, ' ', '.'), '(x) # ', p_brand)"
            ).alias("content"),
        )

    def symbol_queries(self) -> DataFrame:
        """Names to look up in each corpus version: every distinct part name, spelled right and spelled wrong."""
        names = self.raw("part").select("p_name").distinct()
        return names.select(
            F.explode(
                F.expr("array(replace(p_name, ' ', '_'), concat(replace(p_name, 'e', 'a'), 'z'))")
            ).alias("query_text")
        ).select("query_text", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("_n")).select(
            "query_text", F.expr("concat('c', _n % 3)").alias("repository_id"), F.expr("cast(1 + floor(_n / 3) as int)").alias("index_version"),
        ).select(F.concat_ws(":", "repository_id", "index_version", "query_text").alias("query_id"), "repository_id", "index_version", "query_text")

    def edges(self) -> DataFrame:
        """Directed relationships between symbols; some targets are unresolved, some lie in another corpus by mistake."""
        return self.raw("lineitem").select(
            F.expr("concat('c', l_partkey % 3)").alias("repository_id"),
            F.expr("cast(1 + floor(l_partkey / 3) % 2 as int)").alias("index_version"),
            F.col("l_partkey").alias("from_id"),
            F.expr(
                "CASE WHEN l_discount = 0 THEN NULL WHEN l_discount = 0.01 THEN l_partkey + 1 WHEN l_returnflag = 'A' THEN l_partkey - 6 * l_suppkey "
                "ELSE l_partkey + 6 * (l_suppkey + l_linenumber) END"
            ).alias("to_id"),
            F.expr(
                "CASE concat(l_returnflag, l_linestatus) WHEN 'RF' THEN 'CALLS' WHEN 'RO' THEN 'API_CALL' "
                "WHEN 'AF' THEN 'REFERENCES' WHEN 'AO' THEN 'EXTENDS' WHEN 'NO' THEN 'CALLS' ELSE 'IMPORTS' END"
            ).alias("kind"),
            F.expr("CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END").alias("confidence"),
        )

    def candidates(self) -> DataFrame:
        """Ranked interval candidates: about 32 per query over four files and three signals."""
        return self.raw("lineitem").select(
            F.expr("cast(floor(l_orderkey / 8) as bigint)").alias("query_id"),
            F.expr(
                "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                "cast(round(l_extendedprice * 100) as bigint))"
            ).alias("chunk_id"),
            F.expr("concat('c', l_suppkey % 3)").alias("repository_id"),
            F.expr("cast(1 + l_linenumber % 2 as int)").alias("index_version"),
            F.expr("concat('src/f', l_suppkey % 4, '.py')").alias("file_path"),
            F.expr("cast(l_partkey % 100 + 1 as int)").alias("start_line"),
            F.expr("cast(l_partkey % 100 + 1 + l_quantity as int)").alias("end_line"),
            F.col("l_extendedprice").alias("raw_score"),
            F.expr(
                "CASE l_returnflag WHEN 'A' THEN 'semantic' WHEN 'N' THEN 'lexical' ELSE 'symbol' END"
            ).alias("signal"),
        )

    def evidence(self) -> DataFrame:
        """Evidence rows per context with the fields that dedupe, budgets and quality read."""
        web = "(l_linenumber = 7 AND l_tax > 0.03)"
        return self.raw("lineitem").select(
            F.expr("cast(floor(l_orderkey / 8) as bigint)").alias("context_id"),
            F.expr(
                "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                "cast(round(l_extendedprice * 100) as bigint))"
            ).alias("evidence_id"),
            F.expr("CASE WHEN l_linenumber = 7 AND l_tax > 0.03 THEN 'WEB' ELSE 'CODE' END").alias("source_type"),
            F.expr("concat('c', l_suppkey % 3)").alias("repository_id"),
            F.expr(f"CASE WHEN NOT {web} THEN concat('src/f', l_suppkey % 4, '.py') END").alias("file_path"),
            F.expr(f"CASE WHEN NOT {web} THEN cast(l_partkey % 100 + 1 as int) END").alias("start_line"),
            F.expr(f"CASE WHEN NOT {web} THEN cast(l_partkey % 100 + 1 + l_quantity as int) END").alias("end_line"),
            F.expr(f"CASE WHEN {web} THEN concat('https://docs.example/', l_partkey % 50) END").alias("url"),
            F.expr("round(l_quantity / 50 - l_discount, 4)").alias("score"),
            F.expr(f"l_linestatus = 'F' AND NOT {web}").alias("is_structural"),
            F.expr("cast(l_quantity * 80 as bigint)").alias("chars"),
            F.expr("CASE WHEN l_returnflag = 'R' THEN concat('sym_', l_partkey % 64) END").alias("symbol"),
            F.expr("cast(l_partkey % 100 + 1 + l_quantity + l_linenumber as int)").alias("file_line_count"),
            F.expr(
                "CASE l_returnflag WHEN 'A' THEN 'semantic' WHEN 'N' THEN 'lexical' ELSE 'symbol' END"
            ).alias("signal"),
            F.expr("CASE WHEN l_returnflag = 'A' THEN round(l_extendedprice / 100000, 6) END").alias("raw_semantic"),
            F.expr(
                "CASE WHEN l_returnflag = 'N' THEN array(element_at(array('login', 'token', 'user', 'session', 'cache'), "
                "cast(l_suppkey % 5 + 1 as int))) ELSE array() END"
            ).alias("matched_terms"),
            F.expr("CASE WHEN l_tax = 0 THEN concat('/api/', l_suppkey % 20) END").alias("route"),
        )

    def index_versions(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_custkey").alias("repository_id"),
            F.col("o_orderkey").alias("version"),
            F.expr(
                "CASE o_orderstatus WHEN 'O' THEN 'READY' WHEN 'F' THEN 'PARTIAL' "
                "ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'PARSING' ELSE 'FAILED' END END"
            ).alias("state"),
            F.expr("cast(o_orderdate as string)").alias("created"),
        )

    def corpora(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("repository_id"),
            F.col("c_nationkey").alias("owner_id"),
            F.col("c_name").alias("name"),
            F.expr("CASE WHEN c_mktsegment = 'MACHINERY' THEN 'UPLOAD' ELSE 'GITHUB' END").alias("source_type"),
            F.expr(
                "CASE WHEN c_acctbal < 0 THEN 'ACCESS_LOST' WHEN c_mktsegment = 'BUILDING' THEN 'SOURCE_DELETED' "
                "ELSE 'ACTIVE' END"
            ).alias("access_status"),
            F.col("c_nationkey").alias("installation_id"),
        )

    def snapshot(self, side: str) -> DataFrame:
        """File listing of the old or new version: orders as files, priority decides presence."""
        absent = {"old": "1-URGENT", "new": "5-LOW"}[side]
        sha = F.expr("concat(o_orderstatus, cast(o_totalprice as bigint))")
        if side == "new":
            sha = F.when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(sha, F.lit("x"))).otherwise(sha)
        sha = F.when(F.col("o_totalprice") > 450000, F.lit(None).cast("string")).otherwise(sha)
        return self.raw("orders").where(F.col("o_orderpriority") != absent).select(
            F.expr("concat('r', o_custkey)").alias("repository_id"),
            F.expr("concat('src/', o_orderstatus, '/o', o_orderkey, '.py')").alias("path"),
            F.col("o_orderkey").alias("file_id"),
            sha.alias("sha"),
        )

    def messages(self) -> DataFrame:
        return self.raw("conversations").select(
            F.col("conv_id").alias("session_id"), F.col("turn"), "role", F.col("text").alias("content")
        )

    def memories(self) -> DataFrame:
        documents, labels = self.raw("documents"), self.raw("labels").select("doc_id", "quality")
        return documents.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("memory_id"),
            F.col("source").alias("repository_id"),
            F.substring_index("text", "\n", 1).alias("topic"),
            F.col("text").alias("content"),
            F.expr("coalesce(quality = 0, false)").alias("is_stale"),
            F.expr("array(doc_id, doc_id + 1)").alias("evidence_ids"),
            F.expr("doc_id * 37 % 1000").alias("updated_at"),
        )

    def tool_calls(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("run_id"),
            F.col("event_id").alias("sequence"),
            F.col("event_type").alias("tool_name"),
            F.col("value").alias("duration_ms"),
            F.col("props").alias("args"),
            F.col("ts").alias("started_at"),
        )

    def model_calls(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("run_id"),
            F.col("event_id").alias("call_id"),
            F.expr("CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END").alias("slot"),
            F.expr("cast(round(value * 100) as bigint)").alias("latency_ms"),
            F.expr("CASE WHEN event_type = 'error' THEN NULL ELSE cast(floor(value) as bigint) END").alias(
                "input_tokens"
            ),
            F.expr(
                "CASE WHEN event_type IN ('error', 'signup', 'view', 'click') THEN NULL "
                "ELSE cast(floor(value / 2) as bigint) END"
            ).alias("output_tokens"),
            F.expr("CASE event_type WHEN 'error' THEN 'INVALID' ELSE 'VALID' END").alias("status"),
        )

    def tree(self) -> DataFrame:
        """Raw file paths with excluded folders, secrets, odd separators and many suffixes."""
        return self.raw("part").select(
            F.expr("concat('c', p_brand)").alias("repository_id"),
            F.expr(
                """
                concat(
                  element_at(array('src/', 'src/api/', 'node_modules/lib/', 'build/', 'tests/unit/',
                    'pkg.egg-info/', '.git/objects/', 'a/../b/', 'backend/app/', 'docs/', './frontend/src/',
                    'backend\\\\db\\\\', ''), cast(p_partkey % 13 + 1 as int)),
                  element_at(array('test_', '', 'id_rsa', 'secrets.', 'Auth', '.env.'), cast(p_size % 6 + 1 as int)),
                  replace(p_name, ' ', '_'), p_partkey,
                  element_at(array('.py', '.ts', '.tsx', '.js', '.md', '.json', '.PNG', '.pem', '.env', '.toml',
                    '.txt', '', '.spec.ts', '.zip', '.yaml'), cast((p_partkey + p_size) % 15 + 1 as int)))
                """
            ).alias("path"),
            F.col("p_partkey").alias("file_id"),
            F.expr("cast(p_retailprice * 1000 as bigint)").alias("size_bytes"),
        )

    def raw_files(self) -> DataFrame:
        """Byte contents; some carry a NUL byte or a binary suffix."""
        return self.raw("documents").select(
            F.col("source").alias("repository_id"),
            F.col("doc_id").alias("file_id"),
            F.expr(
                "concat(source, '/f', doc_id, element_at(array('.md', '.py', '.ts', '.png', '.json', '.bin2', "
                "'.TXT'), cast(doc_id % 7 + 1 as int)))"
            ).alias("path"),
            F.expr(
                "cast(CASE WHEN n_chars % 5 = 0 THEN concat(text, unhex('00'), unhex('C3')) ELSE text END as binary)"
            ).alias("content"),
        )


SQL: dict[str, str] = {
    "files": """SELECT source AS repository_id, doc_id AS file_id,
        concat(source, '/', lang, '/doc_', doc_id, '.md') AS path, lang AS language,
        CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha, text AS content FROM documents""",
    "chunks": """SELECT source AS repository_id, CAST(1 + (doc_id // 20) % 2 AS INTEGER) AS index_version, doc_id AS chunk_id,
        concat(lang, '/doc_', doc_id // 40, '.md') AS file_path, 1 AS start_line,
        CAST(greatest(len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END, 1) AS INTEGER)
        AS end_line, text AS content FROM documents""",
    "queries": """SELECT item_id * 40 + n AS query_id, concat('src', n % 20) AS repository_id, CAST(1 + n // 20 AS INTEGER) AS index_version,
        text AS query_text FROM benchmark, range(40) r(n)""",
    "questions": """SELECT p_partkey AS query_id, concat(
        (['Where is `', 'How does ', 'trace ', 'What is affected by ',
          'open src/', 'Explain the architecture of ', 'usages of ', 'find ', 'official docs for ',
          'Suppose we logged in and changed ', 'Which parts are listed for the current ', ''])[p_partkey % 12 + 1],
        ([replace(p_name, ' ', '_'),
          concat(upper(w1[1]), w1[2:], upper(w2[1]), w2[2:]), p_name, concat(w1, upper(w2[1]), w2[2:])])[p_size % 4 + 1],
        (['` used?', ' from frontend form to the api', ', and how is it stored', '.py', '',
          ' request when users sign up', ' schema; where are tokens saved? what happens next',
          ' and what is the current owner'])[(p_partkey + p_size) % 8 + 1]) AS query_text
        FROM (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part)""",
    "vectors": """SELECT concat('c', vec_id % 3) AS repository_id, CAST(1 + (vec_id // 3) % 2 AS INTEGER) AS index_version, vec_id AS chunk_id, embedding, concat('m', label % 2) AS model_version, label FROM embeddings""",
    "query_vectors": """SELECT concat_ws(':', repository_id, index_version, label) AS query_id, repository_id, index_version,
        arg_min(embedding, chunk_id) AS query_embedding FROM vectors GROUP BY repository_id, index_version, label""",
    "symbols": """SELECT concat('c', p_partkey % 3) AS repository_id, CAST(1 + (p_partkey // 3) % 2 AS INTEGER) AS index_version, p_partkey AS symbol_id,
        CASE WHEN p_size % 10 = 0 THEN concat(upper(w1[1]), w1[2:], '_', upper(w2[1]), w2[2:])
             ELSE replace(p_name, ' ', '_') END AS name,
        concat(CASE p_type WHEN 'ECONOMY' THEN 'frontend/' WHEN 'PROMO' THEN 'backend/tests/' ELSE 'backend/' END,
               lower(p_type), '/m', p_partkey // 40, '.py') AS file_path,
        (['FUNCTION','METHOD','CLASS','INTERFACE','TYPE','HOOK'])[p_size % 6 + 1] AS symbol_type,
        CAST(p_partkey % 200 + 1 AS INTEGER) AS start_line, CAST(p_partkey % 200 + 1 + p_size AS INTEGER) AS end_line,
        CASE WHEN p_size % 6 = 1 THEN concat('hot_', w2) END AS parent_symbol
        FROM (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part)""",
    "symbol_chunks": """SELECT concat('c', p_partkey % 3) AS repository_id, CAST(1 + (p_partkey // 3) % 2 AS INTEGER) AS index_version, p_partkey AS chunk_id,
        concat(CASE p_type WHEN 'ECONOMY' THEN 'frontend/' WHEN 'PROMO' THEN 'backend/tests/' ELSE 'backend/' END,
               lower(p_type), '/m', p_partkey // 40, '.py') AS file_path,
        CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') END AS symbol_name,
        CAST(p_partkey % 200 + 1 AS INTEGER) AS start_line, CAST(p_partkey % 200 + 4 + p_size % 17 AS INTEGER) AS end_line,
        concat('def ', replace(p_name, ' ', '_'), '(x): return ', replace(p_name, ' ', '.'), '(x) # ', p_brand) AS content
        FROM part""",
    "symbol_queries": """SELECT concat_ws(':', repository_id, index_version, query_text) AS query_id, * FROM (
        SELECT concat('c', n % 3) AS repository_id, CAST(1 + n // 3 AS INTEGER) AS index_version, query_text FROM range(6) r(n), (
        SELECT unnest([replace(p_name, ' ', '_'), concat(replace(p_name, 'e', 'a'), 'z')]) AS query_text
        FROM (SELECT DISTINCT p_name FROM part)))""",
    "edges": """SELECT concat('c', l_partkey % 3) AS repository_id, CAST(1 + (l_partkey // 3) % 2 AS INTEGER) AS index_version, l_partkey AS from_id,
        CASE WHEN l_discount = 0 THEN NULL WHEN l_discount = 0.01 THEN l_partkey + 1 WHEN l_returnflag = 'A' THEN l_partkey - 6 * l_suppkey
             ELSE l_partkey + 6 * (l_suppkey + l_linenumber) END AS to_id,
        CASE concat(l_returnflag, l_linestatus) WHEN 'RF' THEN 'CALLS' WHEN 'RO' THEN 'API_CALL'
             WHEN 'AF' THEN 'REFERENCES' WHEN 'AO' THEN 'EXTENDS' WHEN 'NO' THEN 'CALLS' ELSE 'IMPORTS' END AS kind,
        CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END AS confidence FROM lineitem""",
    "candidates": """SELECT l_orderkey // 8 AS query_id,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS chunk_id,
        concat('c', l_suppkey % 3) AS repository_id, CAST(1 + l_linenumber % 2 AS INTEGER) AS index_version, concat('src/f', l_suppkey % 4, '.py') AS file_path, CAST(l_partkey % 100 + 1 AS INTEGER) AS start_line,
        CAST(l_partkey % 100 + 1 + l_quantity AS INTEGER) AS end_line, l_extendedprice AS raw_score,
        CASE l_returnflag WHEN 'A' THEN 'semantic' WHEN 'N' THEN 'lexical' ELSE 'symbol' END AS signal FROM lineitem""",
    "evidence": """SELECT l_orderkey // 8 AS context_id,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS evidence_id,
        CASE WHEN web THEN 'WEB' ELSE 'CODE' END AS source_type,
        concat('c', l_suppkey % 3) AS repository_id, CASE WHEN NOT web THEN concat('src/f', l_suppkey % 4, '.py') END AS file_path,
        CASE WHEN NOT web THEN CAST(l_partkey % 100 + 1 AS INTEGER) END AS start_line,
        CASE WHEN NOT web THEN CAST(l_partkey % 100 + 1 + l_quantity AS INTEGER) END AS end_line,
        CASE WHEN web THEN concat('https://docs.example/', l_partkey % 50) END AS url, round(l_quantity / 50 - l_discount, 4) AS score,
        l_linestatus = 'F' AND NOT web AS is_structural, CAST(l_quantity * 80 AS BIGINT) AS chars,
        CASE WHEN l_returnflag = 'R' THEN concat('sym_', l_partkey % 64) END AS symbol,
        CAST(l_partkey % 100 + 1 + l_quantity + l_linenumber AS INTEGER) AS file_line_count,
        CASE l_returnflag WHEN 'A' THEN 'semantic' WHEN 'N' THEN 'lexical' ELSE 'symbol' END AS signal,
        CASE WHEN l_returnflag = 'A' THEN round(l_extendedprice / 100000, 6) END AS raw_semantic,
        CASE WHEN l_returnflag = 'N' THEN [(['login', 'token', 'user', 'session', 'cache'])[l_suppkey % 5 + 1]] ELSE [] END AS matched_terms,
        CASE WHEN l_tax = 0 THEN concat('/api/', l_suppkey % 20) END AS route
        FROM (SELECT *, l_linenumber = 7 AND l_tax > 0.03 AS web FROM lineitem)""",
    "index_versions": """SELECT o_custkey AS repository_id, o_orderkey AS version,
        CASE o_orderstatus WHEN 'O' THEN 'READY' WHEN 'F' THEN 'PARTIAL'
             ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'PARSING' ELSE 'FAILED' END END AS state,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created FROM orders""",
    "corpora": """SELECT c_custkey AS repository_id, c_nationkey AS owner_id, c_name AS name,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'UPLOAD' ELSE 'GITHUB' END AS source_type,
        CASE WHEN c_acctbal < 0 THEN 'ACCESS_LOST' WHEN c_mktsegment = 'BUILDING' THEN 'SOURCE_DELETED' ELSE 'ACTIVE' END
        AS access_status, c_nationkey AS installation_id FROM customer""",
    "snapshot_old": """SELECT concat('r', o_custkey) AS repository_id,
        concat('src/', o_orderstatus, '/o', o_orderkey, '.py') AS path, o_orderkey AS file_id,
        CASE WHEN o_totalprice > 450000 THEN NULL ELSE concat(o_orderstatus, CAST(trunc(o_totalprice) AS BIGINT)) END AS sha
        FROM orders WHERE o_orderpriority <> '1-URGENT'""",
    "snapshot_new": """SELECT concat('r', o_custkey) AS repository_id,
        concat('src/', o_orderstatus, '/o', o_orderkey, '.py') AS path, o_orderkey AS file_id,
        CASE WHEN o_totalprice > 450000 THEN NULL ELSE concat(o_orderstatus, CAST(trunc(o_totalprice) AS BIGINT),
             CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'x' ELSE '' END) END AS sha
        FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "messages": "SELECT conv_id AS session_id, turn, role, text AS content FROM conversations",
    "memories": """SELECT doc_id AS memory_id, source AS repository_id, split_part(text, chr(10), 1) AS topic, text AS content,
        coalesce(quality = 0, false) AS is_stale, [doc_id, doc_id + 1] AS evidence_ids, doc_id * 37 % 1000 AS updated_at
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "tool_calls": """SELECT user_id AS run_id, event_id AS sequence, event_type AS tool_name, value AS duration_ms,
        props AS args, ts AS started_at FROM events""",
    "model_calls": """SELECT user_id AS run_id, event_id AS call_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS slot,
        CAST(round(value * 100) AS BIGINT) AS latency_ms,
        CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS input_tokens,
        CASE WHEN event_type IN ('error', 'signup', 'view', 'click') THEN NULL ELSE CAST(floor(value / 2) AS BIGINT) END
        AS output_tokens, CASE event_type WHEN 'error' THEN 'INVALID' ELSE 'VALID' END AS status FROM events""",
    "tree": r"""SELECT concat('c', p_brand) AS repository_id, concat(
        (['src/', 'src/api/', 'node_modules/lib/', 'build/', 'tests/unit/', 'pkg.egg-info/', '.git/objects/', 'a/../b/',
          'backend/app/', 'docs/', './frontend/src/', 'backend\db\', ''])[p_partkey % 13 + 1],
        (['test_', '', 'id_rsa', 'secrets.', 'Auth', '.env.'])[p_size % 6 + 1], replace(p_name, ' ', '_'), p_partkey,
        (['.py', '.ts', '.tsx', '.js', '.md', '.json', '.PNG', '.pem', '.env', '.toml', '.txt', '', '.spec.ts', '.zip',
          '.yaml'])[(p_partkey + p_size) % 15 + 1]) AS path,
        p_partkey AS file_id, CAST(trunc(p_retailprice * 1000) AS BIGINT) AS size_bytes FROM part""",
    "raw_files": """SELECT source AS repository_id, doc_id AS file_id,
        concat(source, '/f', doc_id, (['.md', '.py', '.ts', '.png', '.json', '.bin2', '.TXT'])[doc_id % 7 + 1]) AS path,
        CASE WHEN n_chars % 5 = 0 THEN encode(text) || '\\x00\\xC3'::BLOB ELSE encode(text) END AS content
        FROM documents""",
}


def oracle(body: str, *bindings: str) -> str:
    """Prefix a query with the bindings it reads."""
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in bindings)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
