"""Version sync, session, memory and finding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.catalogue import CATALOGUE
from codelode.operators import memory as M
from codelode.operators import sync as S
from codelode.sources.tables import Tables, oracle

query = CATALOGUE.query

DIFF = """diff AS (SELECT coalesce(o.repository_id, n.repository_id) AS repository_id, coalesce(o.path, n.path) AS path,
    CASE WHEN n.path IS NULL THEN 'DELETED' WHEN o.path IS NULL THEN 'NEW' WHEN o.sha IS NOT DISTINCT FROM n.sha THEN 'UNCHANGED' ELSE 'CHANGED' END AS change
    FROM snapshot_old o FULL JOIN snapshot_new n ON n.repository_id = o.repository_id AND n.path = o.path)"""
SNAPS = ("snapshot_old", "snapshot_new")


def diff_of(t: Tables):
    return S.snapshot_diff(t.snapshot("old"), t.snapshot("new"))


@query("sync_eligibility", oracle(
    """WITH i AS (SELECT n_nationkey AS installation_id, CASE WHEN n_regionkey = 2 THEN 'REVOKED' ELSE 'ACTIVE' END AS status FROM nation),
      s AS (SELECT repository_id, bool_or(state = 'PARSING') AS busy, bool_or(state IN ('READY', 'PARTIAL')) AS ready FROM index_versions GROUP BY 1)
      SELECT c.repository_id, CASE WHEN source_type <> 'GITHUB' THEN 'WRONG_SOURCE' WHEN access_status <> 'ACTIVE' THEN 'ACCESS_UNAVAILABLE'
        WHEN i.status IS NULL THEN 'NO_INSTALLATION' WHEN coalesce(busy, false) THEN 'IN_PROGRESS' WHEN NOT coalesce(ready, false) THEN 'NO_READY_INDEX' ELSE 'OK' END AS verdict
      FROM corpora c LEFT JOIN i ON i.installation_id = c.installation_id AND i.status = 'ACTIVE' LEFT JOIN s ON s.repository_id = c.repository_id""",
    "corpora", "index_versions"))
def sync_eligibility(spark, sf):
    t = Tables(spark, sf)
    installations = t.raw("nation").selectExpr(
        "n_nationkey AS installation_id", "CASE WHEN n_regionkey = 2 THEN 'REVOKED' ELSE 'ACTIVE' END AS status"
    )
    return S.sync_eligibility(t.corpora(), installations, t.index_versions())


@query("next_version", oracle(
    """SELECT repository_id, max(version) + 1 AS next_version, max(version) FILTER (WHERE state IN ('READY', 'PARTIAL')) AS base_version
       FROM index_versions GROUP BY 1""", "index_versions"))
def next_version(spark, sf):
    return S.next_version(Tables(spark, sf).index_versions())


@query("snapshot_diff", oracle(f"WITH {DIFF} SELECT * FROM diff", *SNAPS))
def snapshot_diff(spark, sf):
    return diff_of(Tables(spark, sf))


def old_chunks(t: Tables):
    return t.snapshot("old").selectExpr(
        "repository_id", "path", "file_id AS chunk_id", "array(cast(file_id as double)) AS embedding",
        "CASE WHEN file_id % 3 = 0 THEN 'm0' ELSE 'm1' END AS model_version", "1 AS index_version",
    )


@query("carry_forward", oracle(
    f"""WITH {DIFF} SELECT o.repository_id, o.path, file_id AS chunk_id, CASE WHEN file_id % 3 <> 0 THEN CAST(file_id AS DOUBLE) END AS first_value,
      CASE WHEN file_id % 3 <> 0 THEN 'm1' END AS model_version, 2 AS index_version FROM snapshot_old o JOIN diff USING (repository_id, path) WHERE change = 'UNCHANGED'""", *SNAPS))
def carry_forward(spark, sf):
    t = Tables(spark, sf)
    kept = S.carry_forward(old_chunks(t), diff_of(t), 2, "m1")
    return kept.withColumn("first_value", F.col("embedding")[0]).drop("embedding")


SYMBOLS = """old_s AS (SELECT repository_id, path, 'o' || file_id AS symbol_id, 'fn' || file_id % 50 AS name, CAST(file_id % 90 AS INTEGER) AS start_line,
      CASE WHEN file_id % 4 = 0 THEN 'Box' END AS parent FROM snapshot_old),
    new_s AS (SELECT repository_id, path, 'n' || file_id AS symbol_id, CASE WHEN file_id % 9 = 0 AND change <> 'UNCHANGED' THEN 'renamed' ELSE 'fn' || file_id % 50 END AS name,
      CAST(file_id % 90 + CASE WHEN change = 'UNCHANGED' THEN 0 ELSE 2 END AS INTEGER) AS start_line, CASE WHEN file_id % 4 = 0 THEN 'Box' END AS parent
      FROM snapshot_new JOIN diff USING (repository_id, path)),
    remap AS (SELECT o.symbol_id AS old_id, n.symbol_id AS new_id, change = 'UNCHANGED' AS carried FROM old_s o JOIN diff d USING (repository_id, path)
      JOIN new_s n ON n.repository_id = o.repository_id AND n.path = o.path AND n.name = o.name
        AND CASE WHEN change = 'UNCHANGED' THEN n.start_line = o.start_line ELSE n.parent IS NOT DISTINCT FROM o.parent END)"""
EDGES = """old_e AS (SELECT 'o' || o_orderkey AS from_id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'o' || (o_orderkey + 3) END AS to_id,
      CASE WHEN o_totalprice > 200000 THEN 'CALLS' ELSE 'IMPORTS' END AS kind, 'low' AS confidence FROM orders),
    carried_e AS (SELECT f.new_id AS from_id, t.new_id AS to_id, kind, confidence FROM old_e e JOIN remap f ON f.old_id = e.from_id AND f.carried
      LEFT JOIN remap t ON t.old_id = e.to_id WHERE e.to_id IS NULL OR t.new_id IS NOT NULL)"""


def remap_of(t: Tables):
    diff = diff_of(t)
    old = t.snapshot("old").selectExpr(
        "repository_id", "path", "concat('o', file_id) AS symbol_id", "concat('fn', file_id % 50) AS name",
        "cast(file_id % 90 as int) AS start_line", "CASE WHEN file_id % 4 = 0 THEN 'Box' END AS parent",
    )
    new = t.snapshot("new").join(diff, ["repository_id", "path"]).selectExpr(
        "repository_id", "path", "concat('n', file_id) AS symbol_id",
        "CASE WHEN file_id % 9 = 0 AND change <> 'UNCHANGED' THEN 'renamed' ELSE concat('fn', file_id % 50) END AS name",
        "cast(file_id % 90 + CASE WHEN change = 'UNCHANGED' THEN 0 ELSE 2 END as int) AS start_line",
        "CASE WHEN file_id % 4 = 0 THEN 'Box' END AS parent",
    )
    return S.symbol_remap(old, new, diff), diff


def old_edges(t: Tables):
    return t.raw("orders").selectExpr(
        "concat('o', o_orderkey) AS from_id", "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE concat('o', o_orderkey + 3) END AS to_id",
        "CASE WHEN o_totalprice > 200000 THEN 'CALLS' ELSE 'IMPORTS' END AS kind", "'low' AS confidence",
    )


@query("symbol_remap", oracle(f"WITH {DIFF}, {SYMBOLS} SELECT * FROM remap", *SNAPS))
def symbol_remap(spark, sf):
    return remap_of(Tables(spark, sf))[0]


@query("edge_carry_forward", oracle(f"WITH {DIFF}, {SYMBOLS}, {EDGES} SELECT * FROM carried_e", *SNAPS))
def edge_carry_forward(spark, sf):
    t = Tables(spark, sf)
    return S.edge_carry_forward(old_edges(t), remap_of(t)[0])


@query("edge_relink", oracle(
    f"""WITH {DIFF}, {SYMBOLS}, {EDGES} SELECT * FROM carried_e UNION ALL
      SELECT 'n' || file_id, 'n' || (file_id + 1), 'CALLS', 'high' FROM snapshot_new JOIN diff USING (repository_id, path) WHERE change <> 'UNCHANGED'""", *SNAPS))
def edge_relink(spark, sf):
    t = Tables(spark, sf)
    remap, diff = remap_of(t)
    rebuilt = t.snapshot("new").selectExpr(
        "repository_id", "path", "concat('n', file_id) AS from_id", "concat('n', file_id + 1) AS to_id", "'CALLS' AS kind",
        "'high' AS confidence",
    )
    return S.edge_relink(S.edge_carry_forward(old_edges(t), remap), rebuilt, diff.where("change <> 'UNCHANGED'"))


MEMO = """memo AS (SELECT 'm' || o_orderkey AS memory_id, 'r' || o_custkey AS repository_id, [o_orderkey, o_orderkey + 1] AS ids, o_orderpriority = '2-HIGH' AS is_stale FROM orders),
   own AS (SELECT repository_id, path, file_id AS chunk_id FROM snapshot_old)"""


def memo(t: Tables):
    return t.raw("orders").selectExpr(
        "concat('m', o_orderkey) AS memory_id", "concat('r', o_custkey) AS repository_id",
        "array(o_orderkey, o_orderkey + 1) AS evidence_ids", "o_orderpriority = '2-HIGH' AS is_stale", "1 AS index_version",
    )


@query("memory_invalidate", oracle(
    f"""WITH {DIFF}, {MEMO}, bad AS (SELECT o.repository_id, chunk_id FROM own o JOIN diff USING (repository_id, path) WHERE change <> 'UNCHANGED')
      SELECT memory_id, is_stale OR EXISTS (SELECT 1 FROM bad WHERE bad.repository_id = memo.repository_id AND list_contains(ids, bad.chunk_id)) AS is_stale FROM memo""", *SNAPS))
def memory_invalidate(spark, sf):
    t = Tables(spark, sf)
    return S.memory_invalidate(memo(t), old_chunks(t).select("repository_id", "path", "chunk_id"), diff_of(t)).select(
        "memory_id", "is_stale"
    )


@query("memory_remap", oracle(
    f"""WITH {DIFF}, {MEMO}, cm AS (SELECT file_id AS old_id, file_id + 1000000 AS new_id FROM snapshot_old JOIN diff USING (repository_id, path) WHERE change = 'UNCHANGED'),
      x AS (SELECT memory_id, is_stale, ids, count(cm.new_id) AS n FROM memo LEFT JOIN cm ON list_contains(ids, cm.old_id) GROUP BY ALL)
      SELECT memory_id, CASE WHEN NOT is_stale AND n = 2 THEN ids[1] + 1000000 ELSE ids[1] END AS first_id,
        CASE WHEN NOT is_stale AND n = 2 THEN ids[2] + 1000000 ELSE ids[2] END AS second_id, is_stale OR n < 2 AS is_stale,
        CASE WHEN NOT is_stale AND n = 2 THEN 2 ELSE 1 END AS index_version FROM x""", *SNAPS))
def memory_remap(spark, sf):
    t = Tables(spark, sf)
    same = diff_of(t).where("change = 'UNCHANGED'")
    chunk_map = t.snapshot("old").join(same, ["repository_id", "path"]).selectExpr("file_id AS old_id", "file_id + 1000000 AS new_id")
    done = S.memory_remap(memo(t), chunk_map, 2)
    return done.select(
        "memory_id", F.col("evidence_ids")[0].alias("first_id"), F.col("evidence_ids")[1].alias("second_id"), "is_stale", "index_version"
    )


@query("access_status_update", oracle(
    """WITH ev AS (SELECT o_orderkey AS sequence, CAST(o_custkey % 25 AS INTEGER) AS installation_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS repository_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'ACCESS_LOST' ELSE 'SOURCE_DELETED' END AS status FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000),
       x AS (SELECT c.repository_id, arg_max(e.status, e.sequence) AS status FROM corpora c JOIN ev e ON e.installation_id = c.installation_id
         AND (e.repository_id IS NULL OR e.repository_id = c.repository_id) GROUP BY 1)
       SELECT c.repository_id, coalesce(x.status, c.access_status) AS access_status FROM corpora c LEFT JOIN x USING (repository_id)""", "corpora"))
def access_status_update(spark, sf):
    t = Tables(spark, sf)
    events = t.raw("orders").where("o_orderstatus = 'P' AND o_totalprice > 400000").selectExpr(
        "o_orderkey AS sequence", "cast(o_custkey % 25 as int) AS installation_id",
        "CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS repository_id",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'ACCESS_LOST' ELSE 'SOURCE_DELETED' END AS status",
    )
    return S.access_status_update(t.corpora(), events).select("repository_id", "access_status")


# ---------------------------------------------------------------- sessions, memories, findings

EXCHANGES = """recent AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM messages),
   exchanges AS (SELECT session_id, turn, role, content, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS exchange FROM recent WHERE back <= 100)"""


@query("session_exchanges", oracle(
    f"WITH {EXCHANGES} SELECT session_id, turn, role, CAST(exchange AS BIGINT) AS exchange FROM exchanges", "messages"))
def session_exchanges(spark, sf):
    return M.session_exchanges(Tables(spark, sf).messages()).select("session_id", "turn", "role", "exchange")


KEYS = "list_distinct(list_transform(list_filter(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*'), lambda z: length(z) >= 3), lambda z: lower(z)))"
RECALL = f"""{EXCHANGES}, q AS (SELECT DISTINCT conv_id AS session_id, coalesce(d.text, '') AS query_text
      FROM conversations LEFT JOIN documents d ON d.doc_id = conv_id * 3),
   words AS (SELECT session_id, exchange, string_agg(content, ' ') AS t FROM exchanges GROUP BY ALL),
   rel AS (SELECT w.session_id, exchange, row_number() OVER (PARTITION BY w.session_id ORDER BY exchange DESC) AS back FROM words w JOIN q USING (session_id)
      WHERE len({KEYS.format(x='query_text')}) = 0 OR list_has_any({KEYS.format(x='query_text')}, {KEYS.format(x='t')})),
   recalled AS (SELECT e.* FROM exchanges e JOIN rel USING (session_id, exchange) WHERE rel.back <= 3)"""


def recalled(t: Tables):
    documents = t.raw("documents").select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    sessions = t.messages().select("session_id").distinct().withColumn("_doc", F.col("session_id") * 3)
    asked = sessions.join(documents, "_doc", "left").select("session_id", F.coalesce("_text", F.lit("")).alias("query_text"))
    return M.session_recall(M.session_exchanges(t.messages()), asked)


@query("session_recall", oracle(f"WITH {RECALL} SELECT session_id, turn, CAST(exchange AS BIGINT) AS exchange FROM recalled", "messages"))
def session_recall(spark, sf):
    return recalled(Tables(spark, sf)).select("session_id", "turn", "exchange")


@query("session_transcript", oracle(
    f"""WITH {RECALL} SELECT session_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substring(content, 1, 500), chr(10) ORDER BY turn) AS transcript
      FROM recalled GROUP BY 1""", "messages"))
def session_transcript(spark, sf):
    return M.session_transcript(recalled(Tables(spark, sf)))


@query("memory_search", oracle(
    f"""WITH q AS (SELECT conv_id || '-' || turn AS query_id, source AS repository_id, CASE WHEN role = 'system' THEN '?' ELSE c.text END AS query_text
        FROM conversations c JOIN documents d ON d.doc_id = c.conv_id),
      k AS (SELECT *, {KEYS.format(x='query_text')} AS ks FROM q)
      SELECT query_id, memory_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, memory_id) AS INTEGER) AS position
      FROM k JOIN memories m USING (repository_id) WHERE NOT is_stale AND (len(ks) = 0 OR
        len(list_filter(ks, lambda z: contains(lower(topic), z) OR contains(lower(content), z))) > 0)""", "memories"))
def memory_search(spark, sf):
    t = Tables(spark, sf)
    corpora = t.raw("documents").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("repository_id"))
    queries = t.raw("conversations").join(corpora, "conv_id").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "repository_id",
        F.expr("CASE WHEN role = 'system' THEN '?' ELSE text END").alias("query_text"),
    )
    return M.memory_search(t.memories(), queries)


@query("memory_admit", oracle(
    """WITH x AS (SELECT memory_id, repository_id, content, unnest(evidence_ids) AS id FROM memories),
       h AS (SELECT x.memory_id, bool_and(c.chunk_id IS NOT NULL) AS ok FROM x LEFT JOIN chunks c ON c.chunk_id = x.id AND c.repository_id = x.repository_id GROUP BY 1)
       SELECT m.memory_id, m.repository_id, trim(substring(content, 1, 255)) AS topic, ok AS accepted FROM memories m JOIN h USING (memory_id)""", "memories", "chunks"))
def memory_admit(spark, sf):
    t = Tables(spark, sf)
    return M.memory_admit(t.memories().withColumn("topic", F.lit(None).cast("string")), t.chunks())


@query("finding_admit", oracle(
    """WITH p AS (SELECT memory_id AS finding_id, repository_id, [memory_id] AS evidence_ids, CASE WHEN memory_id % 2 = 0 THEN memory_id END AS session_id,
         CASE WHEN memory_id % 5 = 0 THEN 'Given' END AS title, CASE WHEN memory_id % 3 = 0 THEN 'Inner' END AS inside FROM memories),
       s AS (SELECT doc_id AS session_id, CASE WHEN lang = 'en' THEN source ELSE 'other' END AS repository_id FROM documents),
       c AS (SELECT doc_id AS chunk_id, source AS repository_id FROM documents WHERE lang <> 'de')
       SELECT finding_id, CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.chunk_id = p.finding_id AND c.repository_id = p.repository_id) THEN 'BAD_EVIDENCE'
         WHEN session_id IS NOT NULL AND (SELECT any_value(s.repository_id) FROM s WHERE s.session_id = p.session_id) IS DISTINCT FROM p.repository_id THEN 'BAD_SESSION' ELSE 'ACCEPTED' END AS verdict,
         coalesce(title, inside, 'FLOW') AS title FROM p""", "memories"))
def finding_admit(spark, sf):
    t = Tables(spark, sf)
    proposed = t.memories().selectExpr(
        "memory_id AS finding_id", "repository_id", "array(memory_id) AS evidence_ids",
        "CASE WHEN memory_id % 2 = 0 THEN memory_id END AS session_id", "CASE WHEN memory_id % 5 = 0 THEN 'Given' END AS title",
        """CASE WHEN memory_id % 3 = 0 THEN '{"title": "Inner"}' ELSE '{}' END AS content""", "'FLOW' AS type",
    )
    documents = t.raw("documents")
    sessions = documents.selectExpr("doc_id AS session_id", "CASE WHEN lang = 'en' THEN source ELSE 'other' END AS repository_id")
    chunks = documents.where("lang <> 'de'").selectExpr("doc_id AS chunk_id", "source AS repository_id")
    return M.finding_admit(proposed, chunks, sessions)


@query("memory_auto_gate", """SELECT o_orderkey AS answer_id, 'repository_qa' AS topic, concat(o_orderkey, ',', o_custkey, CASE WHEN o_custkey <> o_orderkey + 1 AND o_orderkey + 1 <> o_orderkey THEN ',' || (o_orderkey + 1) ELSE '' END) AS evidence_ids
    FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_custkey <> o_orderkey
    UNION ALL SELECT o_orderkey, 'repository_qa', concat(o_orderkey, ',', o_orderkey + 1) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_custkey = o_orderkey""")
def memory_auto_gate(spark, sf):
    answers = Tables(spark, sf).raw("orders").selectExpr(
        "o_orderkey AS answer_id", "'REPOSITORY_QA' AS task_type",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE 'medium' END AS confidence",
        "CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE 'text' END AS answer",
        """array(named_struct('evidence_id', o_orderkey, 'source_type', 'CODE', 'source_ids', array(o_orderkey, o_custkey)),
                 named_struct('evidence_id', o_orderkey + 9, 'source_type', 'WEB', 'source_ids', array(0L)),
                 named_struct('evidence_id', o_orderkey + 1, 'source_type', 'CODE', 'source_ids', cast(array() as array<bigint>))) AS evidence""",
    )
    return M.memory_auto_gate(answers).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query("finding_title", """WITH c AS (SELECT doc_id AS finding_id, text AS title, rtrim(substring(text, 1, 252), ' ' || chr(10) || chr(9)) AS cut FROM documents),
    p AS (SELECT *, length(cut) - strpos(reverse(cut), ' ') AS gap FROM c)
    SELECT finding_id, CASE WHEN length(title) <= 255 THEN title WHEN contains(cut, ' ') AND gap >= 126
      THEN rtrim(substring(cut, 1, gap), ' ' || chr(10) || chr(9)) || '...' ELSE cut || '...' END AS title FROM p""")
def finding_title(spark, sf):
    return Tables(spark, sf).raw("documents").select(
        F.col("doc_id").alias("finding_id"), M.finding_title(F.col("text")).alias("title")
    )
