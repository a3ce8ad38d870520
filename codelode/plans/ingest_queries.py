"""Source, filter and lookup queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codelode.catalogue import CATALOGUE
from codelode.functions import paths as P
from codelode.operators import ingest as I
from codelode.session import ensure_checkpoint_dir
from codelode.sources import files as S
from codelode.sources.tables import Tables, oracle
from codelode.sources.versions import write_version

query = CATALOGUE.query

EXCLUDED = "(" + ",".join(f"'{x}'" for x in P.EXCLUDED_FOLDERS) + ")"
BINARY = "(" + ",".join(f"'{x}'" for x in P.BINARY_SUFFIXES) + ")"
NORM = "regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '')"
SECRET = "regexp_full_match(lower(split_part({p}, '/', -1)), '\\.env|\\.env\\..*|.*\\.pem|.*\\.key|id_rsa.*|.*\\.p12|credentials\\.json|secrets\\..*')"
EXCLUDE = (
    "len(list_filter(string_split({p}, '/'), lambda x: x = '..' OR x IN " + EXCLUDED + " OR suffix(x, '.egg-info'))) > 0"
)
SUFFIX = "lower(regexp_extract(split_part({p}, '/', -1), '^.+(\\.[^.]+)$', 1))"
LANG = (
    "CASE {s} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END"
)


def shared_location(spark, name: str) -> str:
    """A fresh folder for written output below the cluster's shared folder; a local one only for local masters."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("scan_manifest", oracle(
    f"""SELECT path, file_id, size_bytes, sha FROM (SELECT *, {NORM} AS np, md5(path) AS sha,
        CASE WHEN path LIKE '%docs/%' THEN 'tree' ELSE 'blob' END AS kind FROM tree)
        WHERE kind = 'blob' AND NOT {EXCLUDE.format(p='np')} AND NOT {SECRET.format(p='np')}""", "tree"))
def scan_manifest(spark, sf):
    manifest = Tables(spark, sf).tree().select(
        "path", "file_id", "size_bytes", F.md5("path").alias("sha"), F.lit(False).alias("truncated"),
        F.expr("CASE WHEN path LIKE '%docs/%' THEN 'tree' ELSE 'blob' END").alias("type"),
    )
    return S.manifest_files(manifest)


@query("path_filter", oracle(f"SELECT file_id, path FROM tree WHERE NOT {EXCLUDE.format(p=NORM)}", "tree"))
def path_filter(spark, sf):
    return I.path_filter(Tables(spark, sf).tree()).select("file_id", "path")


@query("secret_filter", oracle(f"SELECT file_id, path FROM tree WHERE NOT {SECRET.format(p=NORM)}", "tree"))
def secret_filter(spark, sf):
    return I.secret_filter(Tables(spark, sf).tree()).select("file_id", "path")


IGNORE_LINES = ["# comment", "*.md", "/docs/", "!docs/test_*", "app", "*.sp?c.ts", "!*[0-4].md", "/build/*", ""]
# The same rules compiled by hand for the oracle: position, negate, anchored, regular expression.
IGNORE_SQL = """rules(pos, negate, anchored, re) AS (VALUES (2, false, false, '.*\\.md(/.*)?'), (3, false, true, 'docs(/.*)?'),
   (4, true, false, 'docs/test_.*(/.*)?'), (5, false, false, 'app(/.*)?'), (6, false, false, '.*\\.sp.c\\.ts(/.*)?'),
   (7, true, false, '.*[0-4]\\.md(/.*)?'), (8, false, true, 'build/.*(/.*)?'))"""


@query("ignore_rules", oracle(
    f"""WITH {IGNORE_SQL}, hits AS (SELECT file_id, pos, negate FROM (SELECT *, {NORM} AS np FROM tree), rules
        WHERE regexp_full_match(np, re) OR (NOT anchored AND
          len(list_filter(string_split(np, '/'), lambda x: regexp_full_match(x, re))) > 0)),
      last AS (SELECT file_id, arg_max(negate, pos) AS negate FROM hits GROUP BY 1)
      SELECT file_id, path FROM tree LEFT JOIN last USING (file_id) WHERE coalesce(negate, true)""", "tree"))
def ignore_rules(spark, sf):
    tree = Tables(spark, sf).tree()
    lines = F.array(*[F.lit(line) for line in IGNORE_LINES])
    rules = tree.select("repository_id").distinct().select("repository_id", F.posexplode(lines).alias("pos", "line"))
    return I.ignore_rules(tree, rules).select("file_id", "path")


CLASSIFIED = f"""classified AS (SELECT *, CASE WHEN octet_length(content) > 20000 THEN 'OVERSIZED'
   WHEN {SUFFIX.format(p='path')} IN {BINARY} OR strpos(substring(hex(content), 1, 16384), '00') > 0
        AND len(list_filter(range(1, least(octet_length(content), 8192) + 1), lambda i: substring(hex(content), 2 * i - 1, 2) = '00')) > 0
   THEN 'BINARY' ELSE 'OK' END AS status FROM raw_files)"""
CLASSIFIED = f"""classified AS (SELECT *, CASE WHEN octet_length(content) > 20000 THEN 'OVERSIZED'
   WHEN {SUFFIX.format(p='path')} IN {BINARY} OR regexp_matches(substring(hex(content), 1, 16384), '^(..)*00')
   THEN 'BINARY' ELSE 'OK' END AS status FROM raw_files)"""


@query("classify_files", oracle(f"WITH {CLASSIFIED} SELECT file_id, status FROM classified", "raw_files"))
def classify_files(spark, sf):
    return I.classify_files(Tables(spark, sf).raw_files(), 20_000).select("file_id", "status")


@query("detect_language", oracle(
    f"""SELECT file_id, {LANG.format(s='s')} AS language, {LANG.format(s='s')} IS NOT NULL AS keeps_text
        FROM (SELECT file_id, {SUFFIX.format(p="replace(path, '\\', '/')")} AS s FROM tree)""", "tree"))
def detect_language(spark, sf):
    return I.detect_language(Tables(spark, sf).tree()).select("file_id", "language", "keeps_text")


@query("content_fingerprint", oracle(
    f"""WITH {CLASSIFIED} SELECT file_id, CASE WHEN status = 'OK' THEN sha256(content) END AS content_hash,
        CASE WHEN status = 'OK' AND {LANG.format(s=SUFFIX.format(p='path'))} IS NOT NULL THEN length(decode(content, 'replace')) END AS text_length
        FROM classified""", "raw_files"))
def content_fingerprint(spark, sf):
    done = I.content_fingerprint(I.classify_files(Tables(spark, sf).raw_files(), 20_000))
    return done.select("file_id", "content_hash", F.length("text").cast("long").alias("text_length"))


@query("corpus_revision", oracle(
    """WITH b AS (SELECT repository_id, substring(sha256(path), 1, 4) AS bucket,
        sha256(string_agg(path || chr(0) || sha, chr(10) ORDER BY path || chr(0) || sha)) AS digest FROM files GROUP BY ALL)
       SELECT repository_id, sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS revision FROM b GROUP BY 1""", "files"))
def corpus_revision(spark, sf):
    return I.corpus_revision(Tables(spark, sf).files().withColumnRenamed("sha", "content_hash"))


@query("index_counters", oracle(
    f"""WITH {CLASSIFIED} SELECT repository_id, count(*) AS files_discovered, count(*) FILTER (WHERE status = 'OK') AS files_processed,
        count(*) FILTER (WHERE status = 'PARSE_FAILED') AS files_failed, count(*) FILTER (WHERE status = 'OK') > 25 AS size_warning
        FROM classified GROUP BY 1""", "raw_files"))
def index_counters(spark, sf):
    return I.index_counters(I.classify_files(Tables(spark, sf).raw_files(), 20_000), 25)


ENTRIES = """entries AS (SELECT l_orderkey AS archive_id, l_linenumber * 1000000 + l_partkey AS pos,
    concat((['src/', '/abs/', 'C:', 'a/../', 'lib/', 'docs/', 'app/', 'x/', 'y/', 'z/'])[CASE WHEN l_tax < 0.01 THEN l_suppkey % 10 ELSE 0 END + 1],
      'f', l_partkey, CASE WHEN l_quantity > 48 THEN '/' ELSE '.py' END) AS entry_name,
    CASE WHEN l_discount = 0.1 AND l_tax > 0.07 THEN 1 ELSE 0 END AS flag_bits,
    CASE WHEN l_quantity = 1 THEN 99 ELSE 8 END AS compress_type,
    CASE WHEN l_quantity = 2 THEN 2717843456 ELSE 2175008768 END AS external_attr,
    CAST(trunc(l_extendedprice) AS BIGINT) AS file_size FROM lineitem)"""


@query("archive_manifest_check", oracle(
    f"""WITH {ENTRIES}, judged AS (SELECT *, NOT suffix(entry_name, '/') AS is_file, CASE
        WHEN entry_name = '' OR prefix(entry_name, '/') OR regexp_matches(entry_name, '^[A-Za-z]:') THEN 'ABSOLUTE_PATH'
        WHEN list_contains(string_split(entry_name, '/'), '..') THEN 'PARENT_SEGMENT'
        WHEN flag_bits & 1 = 1 THEN 'ENCRYPTED' WHEN compress_type NOT IN (0, 8, 12, 14) THEN 'UNSUPPORTED_COMPRESSION'
        WHEN (external_attr >> 16) & 61440 = 40960 THEN 'SYMLINK' END AS reason FROM entries)
      SELECT archive_id, count(*) FILTER (WHERE is_file) AS n_files, CAST(coalesce(sum(file_size) FILTER (WHERE is_file), 0) AS BIGINT) AS n_bytes,
        CASE WHEN count(*) FILTER (WHERE is_file) > 8 THEN 'TOO_MANY_FILES'
             WHEN coalesce(sum(file_size) FILTER (WHERE is_file), 0) > 300000 THEN 'TOO_LARGE'
             ELSE coalesce(arg_min(reason, pos) FILTER (WHERE reason IS NOT NULL), 'OK') END AS verdict
      FROM judged GROUP BY 1"""))
def archive_manifest_check(spark, sf):
    entries = Tables(spark, sf).raw("lineitem").select(
        F.col("l_orderkey").alias("archive_id"),
        F.expr("l_linenumber * 1000000 + l_partkey").alias("pos"),
        F.expr(
            "concat(element_at(array('src/', '/abs/', 'C:', 'a/../', 'lib/', 'docs/', 'app/', 'x/', 'y/', 'z/'), "
            "cast(CASE WHEN l_tax < 0.01 THEN l_suppkey % 10 ELSE 0 END + 1 as int)), 'f', l_partkey, "
            "CASE WHEN l_quantity > 48 THEN '/' ELSE '.py' END)"
        ).alias("entry_name"),
        F.expr("CASE WHEN l_discount = 0.1 AND l_tax > 0.07 THEN 1 ELSE 0 END").alias("flag_bits"),
        F.expr("CASE WHEN l_quantity = 1 THEN 99 ELSE 8 END").alias("compress_type"),
        F.expr("CASE WHEN l_quantity = 2 THEN 2717843456L ELSE 2175008768L END").alias("external_attr"),
        F.expr("cast(l_extendedprice as bigint)").alias("file_size"),
    )
    return I.archive_manifest_check(entries, 8, 300_000)


LINES = "CASE WHEN suffix(content, chr(10)) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END"


@query("read_file_head", oracle(
    f"""SELECT repository_id, path, concat(array_to_string(l[:20], chr(10)), CASE WHEN len(l) > 20 OR suffix(content, chr(10)) THEN chr(10) ELSE '' END) AS head,
        CAST(least(len(l), 20) AS INTEGER) AS end_line, CAST(len(l) AS INTEGER) AS total_lines, len(l) > 20 AS truncated
        FROM (SELECT *, {LINES} AS l FROM files)""", "files"))
def read_file_head(spark, sf):
    return I.read_file_head(Tables(spark, sf).files(), 20)


REQUESTS = """requests AS (SELECT file_id AS request_id, repository_id, concat(CASE language WHEN 'de' THEN '../' ELSE '' END, path,
      CASE WHEN size_bytes % 7 = 0 THEN '.exe' ELSE '' END) AS path,
      CAST(size_bytes % 10 AS INTEGER) AS start_line, CAST(size_bytes % 10 + file_id % 5 - 1 AS INTEGER) AS end_line FROM files),
    stored AS (SELECT repository_id, path, content, CASE WHEN size_bytes > 9000 THEN 'OVERSIZED' WHEN size_bytes % 11 = 0 THEN 'BINARY' ELSE 'OK' END AS status
      FROM files UNION ALL SELECT repository_id, concat(path, '.exe'), content, 'OK' FROM files WHERE language = 'en')"""


@query("read_file_range", oracle(
    f"""WITH {REQUESTS}, j AS (SELECT r.*, s.content, s.status, {LINES} AS l FROM requests r LEFT JOIN stored s USING (repository_id, path)),
      e AS (SELECT *, CASE WHEN list_contains(string_split(path, '/'), '..') THEN 'PATH_TRAVERSAL' WHEN content IS NULL THEN 'NOT_FOUND'
        WHEN NOT suffix(path, '.md') THEN 'UNSUPPORTED_TYPE' WHEN status = 'BINARY' THEN 'BINARY' WHEN status = 'OVERSIZED' THEN 'TOO_LARGE'
        WHEN end_line < start_line OR end_line > len(l) OR start_line < 1 THEN 'LINE_RANGE' END AS error FROM j)
      SELECT request_id, error, CASE WHEN error IS NULL THEN array_to_string(l[start_line:end_line], chr(10)) END AS content FROM e""", "files"))
def read_file_range(spark, sf):
    files = Tables(spark, sf).files()
    requests = files.select(
        F.col("file_id").alias("request_id"), "repository_id",
        F.expr(
            "concat(CASE language WHEN 'de' THEN '../' ELSE '' END, path, CASE WHEN size_bytes % 7 = 0 THEN '.exe' ELSE '' END)"
        ).alias("path"),
        F.expr("cast(size_bytes % 10 as int)").alias("start_line"),
        F.expr("cast(size_bytes % 10 + file_id % 5 - 1 as int)").alias("end_line"),
    )
    status = F.expr("CASE WHEN size_bytes > 9000 THEN 'OVERSIZED' WHEN size_bytes % 11 = 0 THEN 'BINARY' ELSE 'OK' END")
    stored = files.select("repository_id", "path", "content", status.alias("status")).unionByName(
        files.where("language = 'en'").select(
            "repository_id", F.concat("path", F.lit(".exe")).alias("path"), "content", F.lit("OK").alias("status")
        )
    )
    return I.read_file_range(requests, stored)


@query("rebuild_content", oracle("SELECT file_id, content FROM files", "files"))
def rebuild_content(spark, sf):
    files = Tables(spark, sf).files()
    pieces = files.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("start_line", "content"))
    chunks = pieces.withColumn("end_line", F.col("start_line")).withColumn("chunk_id", F.col("start_line"))
    hidden = files.withColumn("content", F.expr("CASE WHEN language <> 'fr' THEN content END"))
    return I.rebuild_content(hidden, chunks)


@query("list_directory", oracle(
    f"""WITH t AS (SELECT repository_id, {NORM} AS path FROM tree),
      folders(folder) AS (VALUES (''), ('src'), ('backend'), ('backend/app')),
      c AS (SELECT DISTINCT repository_id, folder, CASE WHEN folder = '' THEN path ELSE substring(path, length(folder) + 2) END AS rest
        FROM t, folders WHERE folder = '' OR prefix(path, folder || '/'))
      SELECT repository_id, folder, split_part(rest, '/', 1) AS name, bool_or(contains(rest, '/')) AS is_directory FROM c GROUP BY 1, 2, 3""", "tree"))
def list_directory(spark, sf):
    tree = Tables(spark, sf).tree().withColumn("path", P.normalize(F.col("path")))
    folders = F.array(*[F.lit(x) for x in ("", "src", "backend", "backend/app")])
    return I.list_directory(tree, tree.select("repository_id").distinct().withColumn("folder", F.explode(folders)))


@query("write_index_version")
def write_index_version(spark, sf):
    files = I.classify_files(Tables(spark, sf).raw_files(), 20_000).withColumn("index_version", F.lit(1))
    counters = I.index_counters(files).withColumn("index_version", F.lit(1))
    return write_version({"files": files}, shared_location(spark, "versions"), counters)


@query("purge_corpus", oracle(
    """SELECT v.* FROM index_versions v WHERE repository_id NOT IN (SELECT repository_id FROM corpora WHERE access_status = 'SOURCE_DELETED')""",
    "index_versions", "corpora"))
def purge_corpus(spark, sf):
    t = Tables(spark, sf)
    return I.purge_corpus(t.index_versions(), t.corpora().where("access_status = 'SOURCE_DELETED'"))


CURRENT = """cur AS (SELECT repository_id, max(version) AS version FROM index_versions WHERE state IN ('READY', 'PARTIAL') GROUP BY 1)"""


@query("scope_filter", oracle(
    f"WITH {CURRENT} SELECT v.* FROM index_versions v JOIN cur USING (repository_id, version)", "index_versions"))
def scope_filter(spark, sf):
    versions = Tables(spark, sf).index_versions()
    return I.scope_filter(versions, I.current_version(versions))


@query("current_version", oracle(
    f"WITH {CURRENT} SELECT v.* FROM index_versions v JOIN cur USING (repository_id, version)", "index_versions"))
def current_version(spark, sf):
    return I.current_version(Tables(spark, sf).index_versions())


@query("latest_version_any_state", oracle(
    """WITH l AS (SELECT repository_id, max(version) AS version FROM index_versions GROUP BY 1)
       SELECT c.repository_id, c.name, l.version, v.state FROM corpora c LEFT JOIN l USING (repository_id)
       LEFT JOIN index_versions v ON v.repository_id = l.repository_id AND v.version = l.version""", "corpora", "index_versions"))
def latest_version_any_state(spark, sf):
    t = Tables(spark, sf)
    return I.latest_version_any_state(t.corpora(), t.index_versions()).select("repository_id", "name", "version", "state")


@query("owner_filter", oracle(
    """WITH r AS (SELECT o_orderkey AS request_id, o_custkey + 50 AS repository_id,
         CASE WHEN o_orderstatus = 'F' THEN c_nationkey WHEN o_orderpriority = '5-LOW' THEN NULL ELSE (o_orderkey % 25)::INTEGER END AS user_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END AS context_repository_id
         FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 50)
       SELECT request_id, repository_id, CASE WHEN c.repository_id IS NULL THEN 'NOT_FOUND' WHEN user_id IS NULL OR user_id <> owner_id THEN 'DENIED'
         WHEN context_repository_id <> r.repository_id THEN 'CONTEXT_MISMATCH' ELSE 'OK' END AS verdict
       FROM r LEFT JOIN corpora c USING (repository_id)""".replace("c.repository_id IS NULL", "c.name IS NULL").replace("r.repository_id THEN", "repository_id THEN"),
    "corpora"))
def owner_filter(spark, sf):
    t = Tables(spark, sf)
    orders = t.raw("orders").withColumn("repository_id", F.col("o_custkey") + 50)
    owners = t.raw("customer").select(F.col("c_custkey").alias("repository_id"), "c_nationkey")
    requests = orders.join(owners, "repository_id", "left").select(
        F.col("o_orderkey").alias("request_id"), "repository_id",
        F.expr(
            "CASE WHEN o_orderstatus = 'F' THEN c_nationkey WHEN o_orderpriority = '5-LOW' THEN NULL "
            "ELSE cast(o_orderkey % 25 as int) END"
        ).alias("user_id"),
        F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END").alias("context_repository_id"),
    )
    return I.owner_filter(requests, t.corpora())


@query("pruned_projection", oracle(
    """SELECT file_id, path, language, CASE WHEN split_part(path, '/', 2) = 'en' OR contains(lower(content), 'email') THEN length(content) END AS content_chars
       FROM files WHERE split_part(path, '/', 2) = 'en' OR contains(lower(content), 'email')""", "files"))
def pruned_projection(spark, sf):
    files = Tables(spark, sf).files()
    wanted = files.where("split_part(path, '/', 2) = 'en' OR content ILIKE '%email%'")
    return wanted.select("file_id", "path", "language", F.length("content").cast("long").alias("content_chars"))


FINDINGS = """findings AS (SELECT event_id AS finding_id, user_id AS repository_id,
    CASE event_type WHEN 'click' THEN 'REVIEW' WHEN 'view' THEN 'FLOW' ELSE 'IMPACT' END AS type,
    concat('{"category": "', CASE WHEN value > 50 THEN 'security' ELSE 'style' END, '", "title": "', event_type, ' ', CAST(event_id AS VARCHAR), '"}') AS content, ts AS created_at FROM events)"""


def findings(t: Tables):
    return t.raw("events").select(
        F.col("event_id").alias("finding_id"), F.col("user_id").alias("repository_id"),
        F.expr("CASE event_type WHEN 'click' THEN 'REVIEW' WHEN 'view' THEN 'FLOW' ELSE 'IMPACT' END").alias("type"),
        F.expr(
            """concat('{"category": "', CASE WHEN value > 50 THEN 'security' ELSE 'style' END, '", "title": "', event_type, ' ', event_id, '"}')"""
        ).alias("content"),
        F.col("ts").alias("created_at"),
    )


@query("json_field_filter", oracle(
    f"""WITH {FINDINGS} SELECT finding_id, repository_id, content FROM findings WHERE type = 'REVIEW' AND contains(content, '"category": "security"')
       ORDER BY created_at DESC, finding_id"""))
def json_field_filter(spark, sf):
    chosen = I.json_field_filter(findings(Tables(spark, sf)), "REVIEW", "security")
    return chosen.orderBy(F.desc("created_at"), "finding_id").select("finding_id", "repository_id", "content")


@query("resolve_evidence_links", oracle(
    """WITH r AS (SELECT memory_id AS request_id, evidence_ids FROM memories),
       x AS (SELECT request_id, generate_subscripts(evidence_ids, 1) - 1 AS position, unnest(evidence_ids) AS chunk_id FROM r)
       SELECT request_id, CAST(position AS INTEGER) AS position, chunk_id, file_path, start_line, end_line, substring(content, 1, 500) AS excerpt
       FROM x LEFT JOIN chunks USING (chunk_id)""", "memories", "chunks"))
def resolve_evidence_links(spark, sf):
    t = Tables(spark, sf)
    requests = t.memories().select(F.col("memory_id").alias("request_id"), "evidence_ids")
    return I.resolve_evidence_links(requests, t.chunks())


@query("list_findings", oracle(
    f"WITH {FINDINGS} SELECT repository_id, finding_id, type FROM findings ORDER BY created_at DESC, finding_id"))
def list_findings(spark, sf):
    ordered = findings(Tables(spark, sf)).orderBy(F.desc("created_at"), "finding_id")
    return ordered.select("repository_id", "finding_id", "type")
