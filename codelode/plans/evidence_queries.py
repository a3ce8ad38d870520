"""Evidence, quality and citation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.catalogue import CATALOGUE
from codelode.functions import scale
from codelode.functions import text as X
from codelode.operators import evidence as E
from codelode.operators import rank as K
from codelode.operators import retrieve as R
from codelode.plans.rank_queries import ADJACENT_SQL, DEDUPE_SQL, SCORED, scored_candidates
from codelode.plans.retrieve_queries import OWNER_SQL, terms_cte, GENERIC
from codelode.sources.tables import Tables, oracle

query = CATALOGUE.query

EVIDENCE_ORDER = (
    "CASE WHEN is_structural THEN 2 WHEN source_type = 'WEB' THEN 1 ELSE 0 END, score DESC, coalesce(file_path, ''), "
    "coalesce(start_line, 0), evidence_id"
)


@query("build_evidence", oracle(
    f"""WITH {OWNER_SQL}, g AS (SELECT query_id, chunk_id, max(score) AS score,
        list({{'n': name, 'm': match_type}} ORDER BY symbol_start, symbol_end, name, match_type) AS contained FROM owners GROUP BY query_id, chunk_id)
      SELECT g.query_id, g.chunk_id AS evidence_id, c.file_path, c.start_line, c.end_line,
        coalesce(c.symbol_name, list_filter(contained, lambda x: prefix(x.m, 'exact_'))[1].n) AS symbol, substring(c.content, 1, 4000) AS content_excerpt,
        CAST(2 + 1 AS INTEGER) AS metadata_keys FROM g JOIN symbol_chunks c USING (chunk_id)""",
    "symbols", "symbol_queries", "symbol_chunks"))
def build_evidence(spark, sf):
    t = Tables(spark, sf)
    owners = R.symbol_owner_chunks(R.symbol_matches(t.symbols(), t.symbol_queries()), t.symbol_chunks())
    ranked = owners.drop("file_path", *R.SCOPE).join(scale.unsent(t.symbol_chunks()), "chunk_id").select(
        "query_id", "chunk_id", "file_path", "start_line", "end_line", "symbol_name", "content",
        F.col("matched_symbols").alias("contained"), F.lit(None).cast("string").alias("parent_symbol"),
        F.col("raw_score").alias("score"), F.lit("symbol").alias("signal"),
    )
    return E.build_evidence(ranked).withColumn("metadata_keys", F.size("metadata")).drop("metadata")


DEDUPED = f"""
  deduped AS (SELECT * EXCLUDE (seen) FROM (SELECT *, row_number() OVER (PARTITION BY context_id,
      CASE WHEN source_type = 'WEB' THEN url ELSE concat_ws('|', repository_id, file_path, start_line, end_line) END, source_type = 'WEB'
      ORDER BY {EVIDENCE_ORDER}) AS seen FROM evidence) WHERE seen = 1)"""


@query("evidence_dedupe", oracle(f"WITH {DEDUPED} SELECT context_id, evidence_id FROM deduped", "evidence"))
def evidence_dedupe(spark, sf):
    return E.evidence_dedupe(Tables(spark, sf).evidence()).select("context_id", "evidence_id")


BUDGET = f"""{DEDUPED},
  ordered AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY {EVIDENCE_ORDER}) AS rank FROM deduped),
  summed AS (SELECT *, sum(chars) OVER (PARTITION BY context_id ORDER BY rank) AS used_chars FROM ordered WHERE rank <= 16),
  kept AS (SELECT * FROM summed WHERE used_chars <= 32000)"""


@query("context_budget", oracle(
    f"WITH {BUDGET} SELECT context_id, evidence_id, CAST(rank AS INTEGER) AS rank, CAST(used_chars AS BIGINT) AS used_chars FROM kept", "evidence"))
def context_budget(spark, sf):
    kept = E.context_budget(E.evidence_dedupe(Tables(spark, sf).evidence()))
    return kept.select("context_id", "evidence_id", "rank", "used_chars")


RESERVED = f"""{BUDGET},
  has AS (SELECT context_id, bool_or(source_type = 'WEB') AS has FROM kept GROUP BY 1),
  webs AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY rank) AS w FROM ordered WHERE source_type = 'WEB' AND context_id % 3 = 0),
  due AS (SELECT webs.* FROM webs LEFT JOIN has USING (context_id) WHERE w = 1 AND NOT coalesce(has, false) AND chars <= 32000),
  reserved AS (SELECT k.context_id, k.evidence_id FROM kept k LEFT JOIN due d USING (context_id)
      WHERE d.chars IS NULL OR (k.rank <= 15 AND k.used_chars <= 32000 - d.chars) UNION ALL SELECT context_id, evidence_id FROM due)"""


@query("web_reservation", oracle(f"WITH {RESERVED} SELECT * FROM reserved", "evidence"))
def web_reservation(spark, sf):
    evidence = Tables(spark, sf).evidence().withColumn("is_external", F.col("context_id") % 3 == 0)
    return E.web_reservation(E.evidence_dedupe(evidence)).select("context_id", "evidence_id")


CONTEXTS = """contexts AS (SELECT conv_id || '-' || turn AS context_id, source AS repository_id,
    CASE WHEN role = 'system' THEN '?' ELSE c.text END AS query_text, CASE WHEN role = 'system' THEN '' ELSE 'REPOSITORY_QA' END AS task_type
    FROM conversations c JOIN documents d ON d.doc_id = c.conv_id)"""


def memory_contexts(t: Tables):
    """Every conversation turn as a question to the corpus of the document with the conversation's id."""
    corpora = t.raw("documents").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("repository_id"))
    return t.raw("conversations").join(corpora, "conv_id").select(
        F.concat_ws("-", "conv_id", "turn").alias("context_id"), "repository_id",
        F.expr("CASE WHEN role = 'system' THEN '?' ELSE text END").alias("query_text"),
        F.expr("CASE WHEN role = 'system' THEN '' ELSE 'REPOSITORY_QA' END").alias("task_type"),
    )


MEMORY_HITS = f"""{CONTEXTS},
  kw AS (SELECT *, list_distinct(list_transform(list_filter(regexp_extract_all(query_text || ' ' || task_type, '[A-Za-z_][A-Za-z0-9_]*'),
      lambda x: length(x) >= 3), lambda x: lower(x))) AS ks FROM contexts),
  hits AS (SELECT context_id, memory_id, content FROM kw JOIN memories m USING (repository_id)
      WHERE NOT is_stale AND (len(ks) = 0 OR len(list_filter(ks, lambda k: contains(lower(topic), k))) > 0))"""


@query("memory_filter", oracle(f"WITH {MEMORY_HITS} SELECT context_id, memory_id FROM hits", "memories"))
def memory_filter(spark, sf):
    t = Tables(spark, sf)
    return E.memory_filter(t.memories(), memory_contexts(t))


@query("memory_budget", oracle(
    """WITH m AS (SELECT conv_id % 40 AS context_id, turn * 100000 + conv_id AS position, conv_id * 100 + turn AS memory_id, length(text) AS chars FROM conversations),
      u AS (SELECT range AS context_id, range * 500 AS used_chars FROM range(40)),
      s AS (SELECT *, sum(chars) OVER (PARTITION BY context_id ORDER BY position, memory_id) + used_chars AS total FROM m JOIN u USING (context_id))
      SELECT context_id, memory_id, chars FROM s WHERE total <= 32000"""))
def memory_budget(spark, sf):
    rows = Tables(spark, sf).raw("conversations").select(
        F.expr("conv_id % 40").alias("context_id"), F.expr("turn * 100000 + conv_id").alias("position"),
        F.expr("conv_id * 100 + turn").alias("memory_id"), F.length("text").cast("long").alias("chars"),
    )
    used = rows.select("context_id").distinct().withColumn("used_chars", F.col("context_id") * 500)
    return E.memory_budget(rows, used)


@query("file_line_counts", oracle(
    "SELECT context_id, file_path, max(coalesce(file_line_count, end_line)) AS line_count FROM evidence WHERE file_path IS NOT NULL GROUP BY ALL", "evidence"))
def file_line_counts(spark, sf):
    return E.file_line_counts(Tables(spark, sf).evidence())


@query("context_summary", oracle(
    f"""WITH {BUDGET} SELECT context_id, count(*) AS items, CAST(sum(chars) AS BIGINT) AS used_chars, CAST(ceil(sum(chars) / 4) AS BIGINT) AS estimated_tokens,
      sha256(concat_ws('|', 'q' || context_id, 'REPOSITORY_QA', string_agg(evidence_id, '|' ORDER BY rank))) AS context_hash FROM kept GROUP BY context_id""", "evidence"))
def context_summary(spark, sf):
    kept = E.context_budget(E.evidence_dedupe(Tables(spark, sf).evidence()))
    named = kept.withColumn("query_text", F.concat(F.lit("q"), "context_id")).withColumn("task_type", F.lit("REPOSITORY_QA"))
    return E.context_summary(named)


@query("conflict_check", oracle(
    """WITH c AS (SELECT context_id, 's' || symbol AS claim, file_path FROM evidence WHERE file_path IS NOT NULL AND symbol IS NOT NULL
        UNION ALL SELECT context_id, 'r' || route, file_path FROM evidence WHERE file_path IS NOT NULL AND route IS NOT NULL),
       x AS (SELECT context_id, claim, count(DISTINCT file_path) > 1 AS bad FROM c GROUP BY ALL)
       SELECT e.context_id, coalesce(bool_or(bad), false) AS has_conflict FROM (SELECT DISTINCT context_id FROM evidence) e LEFT JOIN x USING (context_id) GROUP BY 1""".replace("GROUP BY ALL", "GROUP BY context_id, claim"),
    "evidence"))
def conflict_check(spark, sf):
    return E.conflict_check(Tables(spark, sf).evidence())


# Question of a context: its distinctive terms and identifiers follow from the context id.
QUALITY_CONTEXTS = """qc AS (SELECT DISTINCT context_id, list_slice(['login', 'token', 'user', 'session', 'cache'], 1, CAST(context_id % 6 AS INTEGER)) AS distinctive,
    ['sym_' || (context_id % 64)] AS identifiers FROM evidence)"""


def quality_contexts(evidence):
    terms = F.array(*[F.lit(x) for x in ("login", "token", "user", "session", "cache")])
    return evidence.select("context_id").distinct().select(
        "context_id", F.slice(terms, F.lit(1), (F.col("context_id") % 6).cast("int")).alias("distinctive"),
        F.array(F.concat(F.lit("sym_"), (F.col("context_id") % 64).cast("string"))).alias("identifiers"),
    )


def quality_evidence(t: Tables):
    """Single-file symbols only conflict when they repeat; a rare contained symbol backs a context."""
    contained = F.when(F.col("symbol").isNotNull(), F.array(F.struct(
        F.col("symbol").alias("name"), F.expr("CASE WHEN score > 0.9 THEN 'exact_case_sensitive' ELSE 'contained' END").alias("match_type")
    ))).otherwise(F.array())
    rows = t.evidence().withColumn("contained", contained)
    return rows


COVERAGE = f"""{QUALITY_CONTEXTS},
  terms AS (SELECT context_id, unnest(distinctive) AS term FROM qc),
  mt AS (SELECT DISTINCT context_id, unnest(matched_terms) AS term FROM evidence),
  cov AS (SELECT qc.context_id, count(t.term) AS n_terms, count(mt.term) AS n_matched FROM qc LEFT JOIN terms t USING (context_id)
      LEFT JOIN mt ON mt.context_id = t.context_id AND mt.term = t.term GROUP BY 1),
  coverage AS (SELECT *, n_terms > 0 AND n_matched >= CASE WHEN n_terms = 1 THEN 1 ELSE greatest(2, CAST(ceil(n_terms / 2) AS BIGINT)) END AS covered FROM cov)"""


@query("lexical_coverage", oracle(f"WITH {COVERAGE} SELECT * FROM coverage", "evidence"))
def lexical_coverage(spark, sf):
    evidence = Tables(spark, sf).evidence()
    return E.lexical_coverage(evidence, quality_contexts(evidence))


# Split every order into its own context so that small and weak contexts occur too.
SMALL = "small AS (SELECT * REPLACE (CAST(split_part(evidence_id, '-', 1) AS BIGINT) AS context_id) FROM evidence)"
QUALITY_SQL = f"""{SMALL}, {COVERAGE.replace('FROM evidence', 'FROM small')},
  sy AS (SELECT context_id, bool_or(symbol IS NOT NULL AND (score > 0.9 OR list_contains(identifiers, symbol))) AS sym FROM small JOIN qc USING (context_id) GROUP BY 1),
  fx AS (SELECT context_id, count(*) AS n, count(*) FILTER (WHERE score >= 0.65) AS strong, max(coalesce(raw_semantic, 0)) AS sem FROM small GROUP BY 1),
  cl AS (SELECT context_id, 's' || symbol AS claim, file_path FROM small WHERE file_path IS NOT NULL AND symbol IS NOT NULL
      UNION ALL SELECT context_id, 'r' || route, file_path FROM small WHERE file_path IS NOT NULL AND route IS NOT NULL),
  cf AS (SELECT context_id, bool_or(bad) AS bad FROM (SELECT context_id, claim, count(DISTINCT file_path) > 1 AS bad FROM cl GROUP BY context_id, claim) GROUP BY 1),
  quality AS (SELECT context_id, CASE WHEN NOT (covered OR sym) AND sem < 0.73 THEN 'NONE' WHEN coalesce(bad, false) THEN 'CONFLICTING'
      WHEN n >= 3 AND strong >= 2 THEN 'STRONG' ELSE 'INCOMPLETE' END AS quality
    FROM fx JOIN coverage USING (context_id) JOIN sy USING (context_id) LEFT JOIN cf USING (context_id))"""


def small_quality(t: Tables):
    rows = quality_evidence(t)
    small = rows.withColumn("context_id", F.split("evidence_id", "-")[0].cast("long"))
    return E.evidence_quality(small, quality_contexts(small))


@query("evidence_quality", oracle(f"WITH {QUALITY_SQL} SELECT * FROM quality", "evidence"))
def evidence_quality(spark, sf):
    return small_quality(Tables(spark, sf))


@query("quality_override", oracle(
    f"""WITH {QUALITY_SQL}, parts AS (SELECT l_orderkey AS context_id, CASE WHEN l_tax > 0.06 THEN 'STRONG' ELSE 'NONE' END AS part_quality FROM lineitem),
      p AS (SELECT context_id, bool_or(part_quality <> 'NONE') AS ok FROM parts GROUP BY 1)
      SELECT context_id, CASE WHEN quality = 'NONE' AND ok THEN 'INCOMPLETE' ELSE quality END AS quality FROM quality LEFT JOIN p USING (context_id)""", "evidence"))
def quality_override(spark, sf):
    t = Tables(spark, sf)
    parts = t.raw("lineitem").select(
        F.col("l_orderkey").alias("context_id"), F.expr("CASE WHEN l_tax > 0.06 THEN 'STRONG' ELSE 'NONE' END").alias("part_quality")
    )
    return E.quality_override(small_quality(t), parts)


@query("answer_gate", oracle(
    """WITH a AS (SELECT o_orderkey AS answer_id, (['REPOSITORY_QA', 'EXTERNAL_DOC_QUERY', 'CHANGE_IMPACT', 'FLOW_TRACE'])[o_custkey % 4 + 1] AS task_type,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'NONE' ELSE 'STRONG' END AS quality, o_orderkey % 3 AS direct_items, o_orderkey % 2 AS removed,
        o_custkey % 3 AS kept, o_custkey % 2 AS kept_local, o_orderkey % 6 AS model_calls FROM orders)
      SELECT answer_id, CASE WHEN quality = 'NONE' OR (task_type = 'CHANGE_IMPACT' AND direct_items = 0) THEN 'INSUFFICIENT_EVIDENCE'
        WHEN task_type IN ('REPOSITORY_QA', 'EXTERNAL_DOC_QUERY') AND removed > 0 AND kept = 0 THEN 'INVALID_OUTPUT'
        WHEN task_type = 'EXTERNAL_DOC_QUERY' AND kept_local = 0 THEN 'INVALID_OUTPUT'
        WHEN model_calls > 4 THEN 'BOUNDS_EXCEEDED' ELSE 'OK' END AS status FROM a"""))
def answer_gate(spark, sf):
    answers = Tables(spark, sf).raw("orders").selectExpr(
        "o_orderkey AS answer_id",
        "element_at(array('REPOSITORY_QA', 'EXTERNAL_DOC_QUERY', 'CHANGE_IMPACT', 'FLOW_TRACE'), cast(o_custkey % 4 + 1 as int)) AS task_type",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'NONE' ELSE 'STRONG' END AS quality",
        "o_orderkey % 3 AS direct_items", "o_orderkey % 2 AS removed", "o_custkey % 3 AS kept",
        "o_custkey % 2 AS kept_local", "o_orderkey % 6 AS model_calls",
    )
    return E.answer_gate(answers)


CLAUSES = """clauses AS (SELECT context_id AS query_id, evidence_id, CAST(split_part(evidence_id, '-', 2) AS INTEGER) AS clause, is_structural, file_path,
      start_line, end_line, row_number() OVER (PARTITION BY context_id, split_part(evidence_id, '-', 2) ORDER BY score DESC, evidence_id) AS position
    FROM evidence WHERE source_type = 'CODE')"""


@query("clause_interleave", oracle(
    f"""WITH {CLAUSES}, l AS (SELECT query_id, list({{'id': evidence_id, 'f': file_path, 's': start_line, 'e': end_line, 'p': 0}} ORDER BY is_structural, position, clause, evidence_id) AS items
        FROM clauses GROUP BY query_id),
      two AS (SELECT query_id, list_concat(list_transform(items, lambda x: [{{'id': x.id, 'f': x.f, 's': x.s, 'e': x.e, 'p': 1}}]), list_transform(items, lambda x: [x])) AS xs FROM l),
      r AS (SELECT query_id, list_reduce(xs, lambda acc, x: CASE WHEN len(acc) >= 16 OR len(list_filter(acc, lambda y: y.id = x[1].id OR (x[1].p = 1 AND y.f = x[1].f)
          OR (y.f = x[1].f AND greatest(least(y.e, x[1].e) - greatest(y.s, x[1].s) + 1, 0) * 2 > least(y.e - y.s, x[1].e - x[1].s) + 1))) > 0
          THEN acc ELSE list_concat(acc, x) END) AS kept FROM two)
      SELECT query_id, CAST(generate_subscripts(kept, 1) AS INTEGER) AS rank, unnest(list_transform(kept, lambda y: y.id)) AS evidence_id FROM r""", "evidence"))
def clause_interleave(spark, sf):
    from pyspark.sql import Window

    rows = Tables(spark, sf).evidence().where("source_type = 'CODE'").withColumn("clause", F.split("evidence_id", "-")[1].cast("int"))
    order = Window.partitionBy("context_id", "clause").orderBy(F.desc("score"), "evidence_id")
    groups = rows.withColumn("position", F.row_number().over(order)).withColumnRenamed("context_id", "query_id")
    return E.clause_interleave(groups)


# Citations: ranges and files drift from the evidence, some ids are unknown, some provenance is foreign.
CITED = """cited AS (SELECT context_id AS response_id, evidence_id AS citation_id, context_id,
      CASE WHEN chars % 720 = 0 THEN 'missing-' || evidence_id ELSE evidence_id END AS evidence_id,
      CASE WHEN chars % 560 = 0 THEN 'src/none.py' WHEN chars % 400 = 0 THEN 'src/f1.py' END AS cited_file,
      CASE WHEN score > 0.5 THEN start_line + (start_line % 7) - 1 END AS cited_start, CASE WHEN score > 0.3 THEN end_line - 2 + (start_line % 3) END AS cited_end,
      CASE WHEN chars % 880 = 0 THEN 'c9' WHEN score > 0 THEN repository_id END AS cited_repository, CASE WHEN chars % 1040 = 0 THEN 8 WHEN score > 0.1 THEN 7 END AS cited_index FROM evidence),
    lc AS (SELECT context_id, file_path, max(coalesce(file_line_count, end_line)) AS line_count FROM evidence WHERE file_path IS NOT NULL GROUP BY ALL),
    cx AS (SELECT DISTINCT context_id, CASE WHEN context_id % 2 = 0 THEN 'c' || (context_id % 3) END AS ctx_repo, CASE WHEN context_id % 5 = 0 THEN 6 ELSE 7 END AS ctx_index FROM evidence),
    j AS (SELECT c.*, e.source_type, e.file_path, e.start_line, e.end_line, e.repository_id, 7 AS index_id, ctx_repo, ctx_index,
        coalesce(cited_file, e.file_path) AS p, coalesce(cited_start, e.start_line) AS s, coalesce(cited_end, e.end_line) AS n, e.evidence_id IS NOT NULL AS found
      FROM cited c LEFT JOIN evidence e ON e.context_id = c.context_id AND e.evidence_id = c.evidence_id JOIN cx ON cx.context_id = c.context_id),
    checked AS (SELECT j.response_id, j.citation_id, j.context_id, j.evidence_id, CASE WHEN NOT found THEN 'UNKNOWN_EVIDENCE_ID'
        WHEN source_type <> 'WEB' AND (line_count IS NULL OR j.file_path <> p) THEN 'FILE_PATH_MISMATCH'
        WHEN source_type <> 'WEB' AND (s < 1 OR n < s OR n > line_count OR s < start_line OR n > end_line) THEN 'LINE_RANGE_MISMATCH'
        WHEN cited_index <> index_id THEN 'INDEX_VERSION_MISMATCH' WHEN cited_repository <> repository_id THEN 'REPOSITORY_MISMATCH'
        WHEN index_id <> ctx_index THEN 'INDEX_VERSION_MISMATCH' WHEN ctx_repo <> repository_id THEN 'REPOSITORY_MISMATCH' END AS reason
      FROM j LEFT JOIN lc ON lc.context_id = j.context_id AND lc.file_path = j.p)"""


def checked_citations(t: Tables):
    evidence = t.evidence().withColumn("index_id", F.lit(7))
    cited = evidence.selectExpr(
        "context_id AS response_id", "evidence_id AS citation_id", "context_id",
        "CASE WHEN chars % 720 = 0 THEN concat('missing-', evidence_id) ELSE evidence_id END AS evidence_id",
        "CASE WHEN chars % 560 = 0 THEN 'src/none.py' WHEN chars % 400 = 0 THEN 'src/f1.py' END AS cited_file",
        "CASE WHEN score > 0.5 THEN start_line + (start_line % 7) - 1 END AS cited_start",
        "CASE WHEN score > 0.3 THEN end_line - 2 + (start_line % 3) END AS cited_end",
        "CASE WHEN chars % 880 = 0 THEN 'c9' WHEN score > 0 THEN repository_id END AS cited_repository",
        "CASE WHEN chars % 1040 = 0 THEN 8 WHEN score > 0.1 THEN 7 END AS cited_index",
    )
    contexts = evidence.select("context_id").distinct().selectExpr(
        "context_id", "CASE WHEN context_id % 2 = 0 THEN concat('c', context_id % 3) END AS repository_id",
        "CASE WHEN context_id % 5 = 0 THEN 6 ELSE 7 END AS index_id",
    )
    return E.citation_check(cited, evidence, contexts, E.file_line_counts(evidence))


@query("citation_check", oracle(f"WITH {CITED} SELECT * FROM checked", "evidence"))
def citation_check(spark, sf):
    return checked_citations(Tables(spark, sf))


@query("citation_summary", oracle(
    f"""WITH {CITED}, h AS (SELECT response_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM
        (SELECT response_id, reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY 1),
      s AS (SELECT response_id, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(reason) AS rejected,
        coalesce(string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) FILTER (WHERE reason IS NULL), '') AS kept_ids FROM checked GROUP BY 1)
      SELECT s.*, coalesce(reasons, '') AS reasons FROM s LEFT JOIN h USING (response_id)""", "evidence"))
def citation_summary(spark, sf):
    done = E.citation_summary(checked_citations(Tables(spark, sf)))
    entries = F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return done.withColumn("reasons", F.array_join(F.array_sort(entries), ",")).withColumn("kept_ids", F.array_join("kept_ids", ","))


@query("confidence_downgrade", oracle(
    f"""WITH {CITED}, a AS (SELECT context_id AS response_id, (['high', 'medium', 'low'])[context_id % 3 + 1] AS confidence,
        CASE WHEN context_id % 2 = 0 THEN 'Partial.' END AS limitations FROM (SELECT DISTINCT context_id FROM evidence)),
      r AS (SELECT response_id, count(reason) > 0 AS bad FROM checked GROUP BY 1)
      SELECT response_id, CASE WHEN bad THEN CASE confidence WHEN 'high' THEN 'medium' ELSE 'low' END ELSE confidence END AS confidence,
        CASE WHEN bad THEN concat_ws(' ', limitations, 'One or more citations failed evidence validation.') ELSE limitations END AS limitations, bad AS downgraded
      FROM a JOIN r USING (response_id)""", "evidence"))
def confidence_downgrade(spark, sf):
    t = Tables(spark, sf)
    answers = t.evidence().select("context_id").distinct().selectExpr(
        "context_id AS response_id", "element_at(array('high', 'medium', 'low'), cast(context_id % 3 + 1 as int)) AS confidence",
        "CASE WHEN context_id % 2 = 0 THEN 'Partial.' END AS limitations",
    )
    return E.confidence_downgrade(answers, checked_citations(t))


CONTEXT_SQL = f"""{SCORED.replace('AS score', "AS score, rpad(chunk_id, CAST(trunc(raw_score) AS INTEGER) % 3000 + 30, 'x') AS content, [signal] AS signals")},
  {DEDUPE_SQL.format(source='scored')},
  thin AS (SELECT s.* FROM scored s JOIN survivors USING (query_id, repository_id, index_version, file_path, chunk_id)), {ADJACENT_SQL.format(source='thin')},
  ev AS (SELECT query_id, file_path, start_line, end_line, score, CASE WHEN len(ids) = 1 THEN ids[1] ELSE sha256(array_to_string(ids, ':')) END AS evidence_id,
      least(length(content), 4000) AS chars FROM adjacent),
  ctx_ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path, start_line, evidence_id) AS rank FROM ev),
  ctx_sum AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ctx_ord WHERE rank <= 16)"""


@query("build_context", oracle(
    f"""WITH {CONTEXT_SQL} SELECT query_id AS context_id, evidence_id, file_path, start_line, end_line, CAST(rank AS INTEGER) AS rank, CAST(used AS BIGINT) AS used_chars
    FROM ctx_sum WHERE used <= 32000""", "candidates"))
def build_context(spark, sf):
    """Overlap dedupe, adjacency merge, evidence, place dedupe and budget in one plan."""
    ranked = scored_candidates(Tables(spark, sf))
    # Texts join the rows that survive the dedupe when their runs are known, so they move once.
    runs = K.adjacent_runs(K.overlap_survivors(ranked, ["raw_score"]).withColumn("signals", F.array("signal")))
    merged = K.merge_runs(runs.withColumn("content", F.expr("rpad(chunk_id, cast(raw_score as int) % 3000 + 30, 'x')")))
    evidence = E.build_evidence(
        merged.withColumns({
            "symbol_name": F.lit(None).cast("string"), "parent_symbol": F.lit(None).cast("string"),
            "contained": F.expr("array()").cast("array<struct<name:string,match_type:string>>"),
        })
    ).select(
        F.col("query_id").alias("context_id"), "evidence_id", "file_path", "start_line", "end_line",
        F.col("metadata")["score"].cast("double").alias("score"), F.length("content_excerpt").cast("long").alias("chars"),
        F.lit("CODE").alias("source_type"), "repository_id", "index_version",
        (F.col("metadata")["is_structural_expansion"] == "true").alias("is_structural"), F.lit(None).cast("string").alias("url"),
    )
    kept = E.context_budget(E.evidence_dedupe(evidence))
    return kept.select("context_id", "evidence_id", "file_path", "start_line", "end_line", "rank", "used_chars")
