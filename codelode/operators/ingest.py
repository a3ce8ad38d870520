"""Listing, filtering, classifying and reading files; version scoping and simple lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import paths as P
from codelode.functions import scale
from codelode.functions import text as X

# Limits of the source.
SNIFF_BYTES = 8192
MAX_FILE_BYTES = 1_572_864
FILE_TARGET = 2000
HEAD_LINES = 4000
MAX_FILES = 20_000
MAX_EXTRACTED = 500 * 1024 * 1024
MAX_ARCHIVE = 100 * 1024 * 1024
READY_STATES = ["READY", "PARTIAL"]
REVISION_BUCKETS = 65_536


def path_filter(files: DataFrame) -> DataFrame:
    return files.where(~P.is_excluded(F.col("path")))


def secret_filter(files: DataFrame) -> DataFrame:
    return files.where(~P.is_secret(F.col("path")))


def compile_ignore_rules(rules: DataFrame) -> DataFrame:
    """Rule lines (repository_id, pos, line) as one ordered array of (regex, negate, anchored) per corpus."""
    line = F.trim("line")
    negate = line.startswith("!")
    body = F.when(negate, F.substring(line, F.lit(2), F.length(line))).otherwise(line)
    core = F.regexp_replace(F.regexp_replace(body, "^/+", ""), "/+$", "")
    rows = rules.where((line != "") & ~line.startswith("#")).select(
        "repository_id", "pos", negate.alias("negate"), body.startswith("/").alias("anchored"),
        F.concat(F.lit("(?s)^"), P.glob_regex(core), F.lit("(/.*)?$")).alias("regex"),
    )
    return rows.groupBy("repository_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "regex", "negate", "anchored"))).alias("rules")
    )


def ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep paths whose last matching rule is absent or a negation. Rules are few per corpus, so they travel as an array."""
    path = P.normalize(F.col("path"))
    joined = files.join(compile_ignore_rules(rules), "repository_id", "left")

    def hits(rule: Column) -> Column:
        whole = F.regexp_like(path, rule["regex"])
        inner = F.exists(P.parts(path), lambda part: F.regexp_like(part, rule["regex"]))
        return whole | (~rule["anchored"] & inner)

    last = F.try_element_at(F.filter("rules", hits), F.lit(-1))
    return joined.where(F.coalesce(last["negate"], F.lit(True))).drop("rules")


def classify_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Adds status OK / BINARY / OVERSIZED; the size is checked before the bytes are looked at."""
    size = F.octet_length("content")
    has_nul = F.expr(f"position(X'00' in substr(content, 1, {SNIFF_BYTES})) > 0")
    binary = P.suffix(P.normalize(F.col("path"))).isin(P.BINARY_SUFFIXES)
    return files.withColumn(
        "status", F.when(size > max_bytes, "OVERSIZED").when(binary | has_nul, "BINARY").otherwise("OK")
    )


def detect_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", P.language(F.col("path"))).withColumn(
        "keeps_text", P.keeps_text(F.col("path"))
    )


def content_fingerprint(classified: DataFrame) -> DataFrame:
    """sha256 of OK files, and their text with invalid bytes replaced where the suffix keeps text."""
    ok = F.col("status") == "OK"
    return classified.withColumn("content_hash", F.when(ok, F.sha2("content", 256))).withColumn(
        "text", F.when(ok & P.keeps_text(F.col("path")), F.make_valid_utf8(F.col("content").cast("string")))
    )


def corpus_revision(files: DataFrame) -> DataFrame:
    """Content hash of a corpus as a two-level hash tree: path buckets, then bucket digests.

    One flat digest over all paths would push a whole corpus through one task; the tree changes
    whenever any path or content changes and needs only bounded groups.
    """
    leaf = F.concat_ws("\u0000", "path", "content_hash")
    bucket = F.conv(F.substring(F.sha2("path", 256), 1, 4), 16, 10).cast("int")
    digests = (
        files.withColumn("_bucket", bucket)
        .groupBy("repository_id", "_bucket")
        .agg(F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), "\n"), 256).alias("_digest"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_digest"))), lambda x: x["_digest"])
    return digests.groupBy("repository_id").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("revision"))


def index_counters(files: DataFrame, target: int = FILE_TARGET) -> DataFrame:
    ok = F.count_if(F.col("status") == "OK")
    return files.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("files_discovered"),
        ok.alias("files_processed"),
        F.count_if(F.col("status") == "PARSE_FAILED").alias("files_failed"),
        (ok > target).alias("size_warning"),
    )


def archive_manifest_check(
    entries: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_EXTRACTED
) -> DataFrame:
    """Verdict per archive: count and size limits first, then the first bad entry in listing order."""
    name = F.replace(F.col("entry_name"), F.lit("\\"), F.lit("/"))
    is_dir = F.col("entry_name").endswith("/")
    mode = F.shiftright("external_attr", 16).bitwiseAND(0xF000)
    reason = (
        F.when((name == "") | name.startswith("/") | name.rlike("^[A-Za-z]:"), "ABSOLUTE_PATH")
        .when(F.array_contains(P.parts(name), ".."), "PARENT_SEGMENT")
        .when(F.col("flag_bits").bitwiseAND(1) == 1, "ENCRYPTED")
        .when(~F.col("compress_type").isin(0, 8, 12, 14), "UNSUPPORTED_COMPRESSION")
        .when(mode == 0xA000, "SYMLINK")
    )
    judged = entries.withColumn("_reason", reason).withColumn("_file", ~is_dir)
    per_archive = judged.groupBy("archive_id").agg(
        F.count_if("_file").alias("n_files"),
        F.sum(F.when(F.col("_file"), F.col("file_size")).otherwise(0)).alias("n_bytes"),
        F.min(F.when(F.col("_reason").isNotNull(), F.struct("pos", "_reason"))).alias("_first"),
    )
    return per_archive.select(
        "archive_id", "n_files", "n_bytes",
        F.when(F.col("n_files") > max_files, "TOO_MANY_FILES")
        .when(F.col("n_bytes") > max_bytes, "TOO_LARGE")
        .otherwise(F.coalesce(F.col("_first._reason"), F.lit("OK")))
        .alias("verdict"),
    )


def read_file_head(files: DataFrame, max_lines: int = HEAD_LINES) -> DataFrame:
    lines = X.lines(F.col("content"))
    total = F.size(lines)
    head = F.array_join(F.slice(lines, 1, max_lines), "\n")
    ends = F.when((total > max_lines) | F.col("content").endswith("\n"), F.lit("\n")).otherwise(F.lit(""))
    return files.select(
        "repository_id", "path", F.concat(head, ends).alias("head"), F.least(total, F.lit(max_lines)).alias("end_line"),
        total.alias("total_lines"), (total > max_lines).alias("truncated"),
    )


def read_file_range(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Inclusive line range per request, or the first failing check as an error code."""
    path = F.col("path")
    stored = files.select("repository_id", "path", "status", "content", F.lit(True).alias("_found"))
    joined = requests.join(stored, ["repository_id", "path"], "left")
    lines = X.lines(F.col("content"))
    bad_range = (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.size(lines)) | (F.col("start_line") < 1)
    error = (
        F.when(P.is_unsafe(path), "PATH_TRAVERSAL")
        .when(F.col("_found").isNull(), "NOT_FOUND")
        .when(P.is_secret(path) | ~P.suffix(path).isin(list(P.LANGUAGES)), "UNSUPPORTED_TYPE")
        .when(F.col("status") == "BINARY", "BINARY")
        .when(F.col("status") == "OVERSIZED", "TOO_LARGE")
        .when(bad_range, "LINE_RANGE")
    )
    span = F.col("end_line") - F.col("start_line") + 1
    return joined.withColumn("error", error).select(
        "request_id", "error",
        F.when(
            F.col("error").isNull(),
            F.array_join(F.slice(lines, F.greatest("start_line", F.lit(1)), F.greatest(span, F.lit(0))), "\n"),
        ).alias("content"),
    )


def rebuild_content(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored text, or the file's chunks joined in order where the text is missing. A file is bounded by the size limit."""
    missing = files.where(F.col("content").isNull()).select("file_id")
    piece = F.struct("start_line", "end_line", "chunk_id", "content")
    joined = (
        chunks.join(missing, "file_id", "left_semi")
        .groupBy("file_id")
        .agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
        .select("file_id", F.array_join(F.transform("_pieces", lambda p: p["content"]), "\n").alias("_rebuilt"))
    )
    return files.join(joined, "file_id", "left").select(
        "file_id", F.coalesce("content", "_rebuilt", F.lit("")).alias("content")
    )


def list_directory(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Immediate children of each requested folder ('' is the root); a folder wins over a file of the same name.

    Every path is spread over its ancestor folders, so requests meet files by equality.
    """
    pieces = F.split("path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(pieces) - 1),
        lambda depth: F.struct(
            F.array_join(F.slice(pieces, F.lit(1), depth), "/").alias("folder"),
            F.element_at(pieces, depth + 1).alias("name"),
            (depth + 1 < F.size(pieces)).alias("is_directory"),
        ),
    )
    spread = files.select("repository_id", F.explode(ancestors).alias("a")).select("repository_id", "a.*")
    asked = requests.select("repository_id", "folder").distinct()
    return (
        spread.join(asked, ["repository_id", "folder"])
        .groupBy("repository_id", "folder", "name")
        .agg(F.bool_or("is_directory").alias("is_directory"))
    )


def purge_corpus(rows: DataFrame, purged: DataFrame) -> DataFrame:
    """Rows of corpora that are not purged."""
    return rows.join(purged.select("repository_id").distinct(), "repository_id", "left_anti")


# ---------------------------------------------------------------- version scoping and lookups

def current_version(versions: DataFrame) -> DataFrame:
    """Newest READY or PARTIAL version per corpus."""
    ready = versions.where(F.col("state").isin(READY_STATES))
    others = [c for c in versions.columns if c != "repository_id"]
    return scale.latest_per(ready, ["repository_id"], others, F.col("version"))


def latest_version_any_state(corpora: DataFrame, versions: DataFrame) -> DataFrame:
    """Every corpus with its newest version, if any."""
    others = [c for c in versions.columns if c != "repository_id"]
    return corpora.join(scale.latest_per(versions, ["repository_id"], others, F.col("version")), "repository_id", "left")


def scope_filter(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows of the chosen (repository_id, version) pairs, before any ranking."""
    return rows.join(scope.select("repository_id", "version").distinct(), ["repository_id", "version"], "left_semi")


def owner_filter(requests: DataFrame, corpora: DataFrame) -> DataFrame:
    """Verdict per request: missing corpus, foreign owner, other context, or OK."""
    owned = corpora.select("repository_id", F.col("owner_id"), F.lit(True).alias("_found"))
    joined = requests.join(owned, "repository_id", "left")
    verdict = (
        F.when(F.col("_found").isNull(), "NOT_FOUND")
        .when(F.col("user_id").isNull() | ~F.col("owner_id").eqNullSafe(F.col("user_id")), "DENIED")
        .when(
            F.col("context_repository_id").isNotNull() & (F.col("context_repository_id") != F.col("repository_id")),
            "CONTEXT_MISMATCH",
        )
        .otherwise("OK")
    )
    return joined.select("request_id", "repository_id", verdict.alias("verdict"))


def json_field_filter(findings: DataFrame, kind: str, category: str | None) -> DataFrame:
    """Findings of one type, with an optional category inside their JSON content."""
    chosen = findings.where(F.col("type") == kind)
    if category is not None:
        chosen = chosen.where(F.get_json_object("content", "$.category") == category)
    return chosen


def resolve_evidence_links(requests: DataFrame, chunks: DataFrame, excerpt: int = 500) -> DataFrame:
    """Requested ids in order with place and excerpt; unknown ids give nulls."""
    asked = requests.select("request_id", F.posexplode("evidence_ids").alias("position", "chunk_id"))
    return asked.join(
        chunks.select(
            "chunk_id", "file_path", "start_line", "end_line", F.substring("content", 1, excerpt).alias("excerpt")
        ),
        "chunk_id", "left",
    )
