"""Evidence building, budgets, quality grading and citation validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import lookup, scale
from codelode.functions import text as X
from codelode.session import stored

# Budgets and thresholds.
MAX_CHARS = 32_000
MAX_ITEMS = 16
EXCERPT_CHARS = 4_000
STRONG_SCORE = 0.65
MIN_SEMANTIC = 0.73
EXACT_MATCHES = ["exact_case_sensitive", "exact_case_insensitive"]


def build_evidence(ranked: DataFrame) -> DataFrame:
    """Excerpt, symbol and place of ranked chunks.

    Reads chunk_id, content, symbol_name, contained (array of struct name, match_type in place
    order), parent_symbol, score, signal, start_line, end_line, file_path.
    """
    exact = F.filter("contained", lambda s: s["match_type"].isin(EXACT_MATCHES))
    # A map keeps open metadata keys; absent values are left out.
    pairs = F.array(
        F.struct(F.lit("score").alias("key"), F.col("score").cast("string").alias("value")),
        F.struct(F.lit("signal").alias("key"), F.col("signal").alias("value")),
        F.struct(F.lit("is_structural_expansion").alias("key"), (F.col("signal") == "structural").cast("string").alias("value")),
        F.struct(F.lit("parent_symbol").alias("key"), F.col("parent_symbol").alias("value")),
    )
    return ranked.select(
        "query_id", *[name for name in scale.SCOPE if name in ranked.columns], F.col("chunk_id").alias("evidence_id"),
        "file_path", "start_line", "end_line",
        F.coalesce("symbol_name", F.try_element_at(exact, F.lit(1))["name"]).alias("symbol"),
        F.substring("content", 1, EXCERPT_CHARS).alias("content_excerpt"),
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("metadata"),
    )


def priority() -> Column:
    return F.when(F.col("is_structural"), 2).when(F.col("source_type") == "WEB", 1).otherwise(0)


def evidence_order() -> list[Column]:
    return [
        priority(), F.desc("score"), F.coalesce("file_path", F.lit("")), F.coalesce("start_line", F.lit(0)),
        F.asc("evidence_id"),
    ]


def evidence_dedupe(evidence: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """First row per place in its corpus (and version, where there is one), or per URL for web rows, in evidence order (or the given order)."""
    web = F.col("source_type") == "WEB"
    place = F.when(web, F.concat(F.lit("WEB\u0000"), F.coalesce("url", F.lit("")))).otherwise(
        F.concat_ws("\u0000", *[F.col(name).cast("string") for name in scale.SCOPE if name in evidence.columns], "file_path", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    )
    return scale.first_per(
        evidence.withColumn("_place", place), ["context_id", "_place"], order or evidence_order()
    ).drop("_place")


def context_budget(
    evidence: DataFrame, items: int = MAX_ITEMS, chars: int = MAX_CHARS, order: Sequence[Column] | None = None
) -> DataFrame:
    """First items in order, stopping at the first that would pass the character budget.

    Lengths are never negative, so the running sum alone marks the stop. At most `items` rows per
    context reach the running sum.
    """
    head = scale.top_k(evidence, ["context_id"], order or evidence_order(), items)
    running = Window.partitionBy("context_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("used_chars", F.sum("chars").over(running)).where(F.col("used_chars") <= chars)


def web_reservation(evidence: DataFrame, items: int = MAX_ITEMS, chars: int = MAX_CHARS) -> DataFrame:
    """Budget that reserves room for the best web row of external contexts that kept none.

    Reads is_external. Evicting from the tail until the row fits equals cutting the prefix at the
    budget minus the row.
    """
    web = F.col("source_type") == "WEB"
    # The first rows of each kind hold the first rows of all and the best row to reserve, so everything is read once.
    marked = evidence.withColumn("_spare", F.coalesce(web & F.col("is_external"), F.lit(False)))
    head = scale.top_k(marked, ["context_id", "_spare"], evidence_order(), items, "_turn")
    whole = Window.partitionBy("context_id")
    running = whole.orderBy(*evidence_order()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = head.withColumn("_rank", F.row_number().over(whole.orderBy(*evidence_order()))).withColumn("_used", F.sum("chars").over(running))
    kept = ranked.withColumn("_kept", F.coalesce((F.col("_rank") <= items) & (F.col("_used") <= chars), F.lit(False)))
    best = F.col("_spare") & (F.col("_turn") == 1) & F.coalesce(F.col("chars") <= chars, F.lit(False))
    # Rows without a context stand for no context that could make room.
    named = F.col("context_id").isNotNull()
    due = kept.withColumn("_due", best & ~(named & F.coalesce(F.bool_or(F.col("_kept") & web).over(whole), F.lit(False))))
    limited = due.withColumn("_web", F.when(named, F.max(F.when(F.col("_due"), F.col("chars"))).over(whole)))
    fits = F.col("_web").isNull() | ((F.col("_rank") <= items - 1) & (F.col("_used") <= chars - F.col("_web")))
    times = (F.col("_kept") & fits).cast("int") + F.col("_due").cast("int")
    return limited.select(*evidence.columns, F.explode(F.array_repeat(F.lit(True), times)).alias("_copy")).drop("_copy")


def memory_filter(memories: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context_id, memory_id) of fresh memories whose topic holds any context keyword as a substring.

    Contexts read query_text and task_type; without keywords every fresh memory of the corpus counts.
    """
    fresh = memories.where(~F.col("is_stale"))
    asked = contexts.withColumn(
        "_keywords", X.keywords(F.concat_ws(" ", "query_text", "task_type"))
    )
    codes = lookup.coded(asked.select(F.explode("_keywords").alias("needle")))
    held = stored(lookup.held_codes(fresh, ["repository_id", "memory_id"], F.lower("topic"), codes))
    # Keys hold the corpus; the key without a keyword is that of every fresh memory and of questions without keywords.
    # Keywords that no topic of the corpus holds are left out, and so are keys of memories that no question asks for.
    said = F.when(F.size("_keywords") == 0, F.array(F.lit(""))).otherwise(F.col("_keywords"))
    spoken = stored(asked.select("context_id", "repository_id", F.explode(said).alias("needle")).join(scale.unsent(codes), "needle", "left").select(
        "context_id", "repository_id", F.coalesce("code", F.lit(-1)).alias("code")
    ))
    told = held.select("repository_id", "memory_id", F.explode("codes").alias("code")).unionByName(
        fresh.select("repository_id", "memory_id", F.lit(-1).cast("long").alias("code"))
    )
    pairs = ["repository_id", "code"]
    keys = stored(told.select(*pairs).distinct().join(scale.unsent(spoken.select(*pairs).distinct()), pairs).withColumn("key", F.monotonically_increasing_id()))
    # A memory id in several corpora has the home '', where all contexts go too, so that no pair is found twice.
    one = F.min("repository_id") == F.max("repository_id")
    items = told.join(scale.unsent(keys), pairs).groupBy("memory_id").agg(
        F.collect_set("key").alias("keys"), F.when(one, F.min("repository_id")).when(~one, "").alias("home")
    )
    questions = spoken.join(scale.unsent(keys), pairs).groupBy("context_id").agg(F.collect_set("key").alias("keys"), F.collect_set("repository_id").alias("_homes")).select(
        "context_id", "keys", F.explode(F.array_distinct(F.array_append("_homes", F.lit("")))).alias("home")
    )
    return lookup.pairs_that_share(items, questions, "memory_id", "context_id")


def memory_budget(memories: DataFrame, used: DataFrame, chars: int = MAX_CHARS) -> DataFrame:
    """Memories in order while the budget shared with the evidence lasts.

    Reads context_id, position, memory_id, chars; `used` holds context_id and used_chars. Only rows
    with text can exhaust the budget and each takes at least one character, so no more than the
    budget's number of rows per context is ever ordered.
    """
    texts = scale.top_k(memories.where("chars > 0"), ["context_id"], [F.asc("position"), F.asc("memory_id")], chars + 1)
    running = Window.partitionBy("context_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent = texts.join(used, "context_id", "left").withColumn(
        "total", F.coalesce("used_chars", F.lit(0)) + F.sum("chars").over(running)
    )
    stop = spent.where(F.col("total") > chars).groupBy("context_id").agg(F.min("position").alias("_stop"))
    empty = memories.where("chars = 0").join(stop, "context_id", "left").where(
        F.col("_stop").isNull() | (F.col("position") < F.col("_stop"))
    )
    columns = ["context_id", "memory_id", "chars"]
    return spent.where(F.col("total") <= chars).select(*columns).unionByName(empty.select(*columns))


def file_line_counts(evidence: DataFrame) -> DataFrame:
    """Largest known line count per context and cited file."""
    placed = evidence.where(F.col("file_path").isNotNull() & F.col("end_line").isNotNull())
    return placed.groupBy("context_id", "file_path").agg(
        F.max(F.coalesce("file_line_count", "end_line")).alias("line_count")
    )


def context_summary(kept: DataFrame) -> DataFrame:
    """Context id, item count, characters and token estimate per context; reads rank, query_text, task_type."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence_id"))), lambda x: x["evidence_id"])
    grouped = kept.groupBy("context_id", "query_text", "task_type").agg(
        ids.alias("_ids"), F.sum("chars").alias("used_chars"), F.count(F.lit(1)).alias("items")
    )
    return grouped.select(
        "context_id", "items", "used_chars",
        F.ceil(F.col("used_chars") / 4).alias("estimated_tokens"),
        F.sha2(F.concat_ws("|", "query_text", "task_type", F.array_join("_ids", "|")), 256).alias("context_hash"),
    )


# ---------------------------------------------------------------- quality

def conflict_check(evidence: DataFrame) -> DataFrame:
    """Contexts where one symbol or one route is found in more than one file."""
    placed = evidence.where(F.col("file_path").isNotNull())
    claims = placed.where(F.col("symbol").isNotNull()).select(
        "context_id", F.concat(F.lit("s:"), "symbol").alias("claim"), "file_path"
    ).unionByName(
        placed.where(F.col("route").isNotNull()).select(
            "context_id", F.concat(F.lit("r:"), "route").alias("claim"), "file_path"
        )
    )
    spread = claims.groupBy("context_id", "claim").agg((F.min("file_path") != F.max("file_path")).alias("_split"))
    found = spread.groupBy("context_id").agg(F.bool_or("_split").alias("has_conflict"))
    every = evidence.select("context_id").distinct()
    return every.join(found, "context_id", "left").select(
        "context_id", F.coalesce("has_conflict", F.lit(False)).alias("has_conflict")
    )


def required_terms(n: Column) -> Column:
    return F.when(n == 1, F.lit(1)).otherwise(F.greatest(F.lit(2), F.ceil(n / 2))).cast("int")


def lexical_coverage(evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    """Whether enough distinctive question terms were matched: one of one, else at least two and half."""
    terms = contexts.select("context_id", F.explode(F.array_distinct("distinctive")).alias("term"))
    matched = evidence.select("context_id", F.explode("matched_terms").alias("term")).distinct()
    counts = terms.join(matched.withColumn("_hit", F.lit(1)), ["context_id", "term"], "left").groupBy("context_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.count("_hit").alias("n_matched")
    )
    return contexts.select("context_id").join(counts, "context_id", "left").select(
        "context_id",
        F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
        F.coalesce("n_matched", F.lit(0)).alias("n_matched"),
        F.coalesce(F.col("n_matched") >= required_terms(F.col("n_terms")), F.lit(False)).alias("covered"),
    )


def evidence_quality(evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    """NONE, CONFLICTING, STRONG or INCOMPLETE per context.

    Contexts hold context_id, distinctive terms and identifiers of the question; evidence holds
    score, raw_semantic, contained (name, match_type), matched_terms, symbol, route, file_path.
    """
    facts = evidence.groupBy("context_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("score") >= STRONG_SCORE).alias("_strong"),
        F.max(F.coalesce("raw_semantic", F.lit(0.0))).alias("_semantic"),
    )
    symbols = evidence.select("context_id", F.explode("contained").alias("c")).join(
        contexts.select("context_id", "identifiers"), "context_id"
    ).groupBy("context_id").agg(
        F.bool_or(
            F.col("c.match_type").isin(EXACT_MATCHES) | F.array_contains("identifiers", F.col("c.name"))
        ).alias("_symbol")
    )
    joined = (
        contexts.select("context_id")
        .join(facts, "context_id", "left")
        .join(symbols, "context_id", "left")
        .join(lexical_coverage(evidence, contexts).select("context_id", "covered"), "context_id")
        .join(conflict_check(evidence), "context_id", "left")
    )
    backed = F.col("covered") | F.coalesce("_symbol", F.lit(False))
    return joined.select(
        "context_id",
        F.when(F.col("_n").isNull() | (~backed & (F.col("_semantic") < MIN_SEMANTIC)), "NONE")
        .when(F.col("has_conflict"), "CONFLICTING")
        .when((F.col("_n") >= 3) & (F.col("_strong") >= 2), "STRONG")
        .otherwise("INCOMPLETE")
        .alias("quality"),
    )


def quality_override(contexts: DataFrame, parts: DataFrame) -> DataFrame:
    """NONE becomes INCOMPLETE when any clause or named field of the context passed on its own."""
    passed = parts.groupBy("context_id").agg(F.bool_or(F.col("part_quality") != "NONE").alias("_passed"))
    return contexts.join(passed, "context_id", "left").select(
        "context_id",
        F.when((F.col("quality") == "NONE") & F.coalesce("_passed", F.lit(False)), "INCOMPLETE")
        .otherwise(F.col("quality"))
        .alias("quality"),
    )


def answer_gate(answers: DataFrame, max_calls: int = 4) -> DataFrame:
    """Status per answer; the first rule that applies wins."""
    task = F.col("task_type")
    return answers.select(
        "answer_id",
        F.when(
            (F.col("quality") == "NONE") | ((task == "CHANGE_IMPACT") & (F.col("direct_items") == 0)),
            "INSUFFICIENT_EVIDENCE",
        )
        .when(
            task.isin("REPOSITORY_QA", "EXTERNAL_DOC_QUERY") & (F.col("removed") > 0) & (F.col("kept") == 0),
            "INVALID_OUTPUT",
        )
        .when((task == "EXTERNAL_DOC_QUERY") & (F.col("kept_local") == 0), "INVALID_OUTPUT")
        .when(F.col("model_calls") > max_calls, "BOUNDS_EXCEEDED")
        .otherwise("OK")
        .alias("status"),
    )


def clause_interleave(evidence: DataFrame, items: int = MAX_ITEMS) -> DataFrame:
    """Round-robin over clause groups, structural rows last, one row per file first, heavy overlaps skipped.

    A clause group holds at most one context's worth of evidence, so a query's list is bounded.
    """
    item = F.struct(
        F.col("is_structural").cast("int").alias("late"), "position", "clause", F.col("evidence_id").alias("id"),
        F.col("file_path").alias("file"), F.col("start_line").alias("s"), F.col("end_line").alias("e"),
    )
    grouped = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    passes = F.concat(
        F.transform("_items", lambda x: F.struct(x.alias("x"), F.lit(True).alias("one_per_file"))),
        F.transform("_items", lambda x: F.struct(x.alias("x"), F.lit(False).alias("one_per_file"))),
    )

    def heavy(a: Column, b: Column) -> Column:
        shared = F.greatest(F.least(a["e"], b["e"]) - F.greatest(a["s"], b["s"]) + 1, F.lit(0))
        shorter = F.least(a["e"] - a["s"], b["e"] - b["s"]) + 1
        return (a["file"] == b["file"]) & (shared * 2 > shorter)

    def step(acc: Column, entry: Column) -> Column:
        x = entry["x"]
        skip = (
            (F.size(acc) >= items)
            | F.exists(acc, lambda y: y["id"] == x["id"])
            | (entry["one_per_file"] & F.exists(acc, lambda y: y["file"].eqNullSafe(x["file"])))
            | F.exists(acc, lambda y: F.coalesce(heavy(y, x), F.lit(False)))
        )
        return F.when(skip, acc).otherwise(F.array_append(acc, x))

    chosen = F.aggregate(passes, F.slice("_items", 1, 0), step)
    return grouped.select("query_id", F.posexplode(chosen).alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("evidence_id")
    )


# ---------------------------------------------------------------- citations

def citation_check(citations: DataFrame, evidence: DataFrame, contexts: DataFrame, line_counts: DataFrame) -> DataFrame:
    """Reason of the first failing rule per citation, null when it holds.

    Order: unknown id, path, line range, version, corpus. Citations may leave file, range and
    provenance empty; contexts hold the current repository and index.
    """
    known = evidence.select(
        "context_id", "evidence_id", "source_type", F.col("file_path").alias("_file"), F.col("start_line").alias("_start"),
        F.col("end_line").alias("_end"), F.col("repository_id").alias("_repo"), F.col("index_id").alias("_index"),
        F.lit(True).alias("_found"),
    )
    scope = contexts.select(
        "context_id", F.col("repository_id").alias("_ctx_repo"), F.col("index_id").alias("_ctx_index")
    )
    counts = line_counts.groupBy("context_id").agg(F.collect_list(F.struct("file_path", "line_count")).alias("_counts"))
    local = F.col("source_type") != "WEB"
    path = F.coalesce("cited_file", "_file")
    start, end = F.coalesce("cited_start", "_start"), F.coalesce("cited_end", "_end")
    outside = (
        start.isNull() | end.isNull() | (start < 1) | (end < start)
        | F.col("_start").isNull() | F.col("_end").isNull() | (start < F.col("_start")) | (end > F.col("_end"))
    )
    foreign = F.when(F.col("cited_index").isNotNull() & (F.col("cited_index") != F.col("_index")), "INDEX_VERSION_MISMATCH").when(
        F.col("cited_repository").isNotNull() & (F.col("cited_repository") != F.col("_repo")), "REPOSITORY_MISMATCH"
    )
    # What the evidence alone decides is decided before the rows move to their context, with its scope and line counts.
    joined = citations.join(known, ["context_id", "evidence_id"], "left").select(
        "response_id", "citation_id", "context_id", "evidence_id", "_found", "_index", "_repo", path.alias("_path"), end.alias("_last"),
        local.alias("_local"), F.col("_file").eqNullSafe(path).alias("_same"), outside.alias("_outside"), foreign.alias("_foreign"),
    ).join(scope.join(counts, "context_id", "full_outer"), "context_id", "left")
    held = F.filter("_counts", lambda c: c["file_path"] == F.col("_path"))
    joined = joined.withColumn("line_count", F.try_element_at(held, F.lit(1))["line_count"])
    reason = (
        F.when(F.col("_found").isNull(), "UNKNOWN_EVIDENCE_ID")
        .when(F.col("_local") & (F.col("line_count").isNull() | ~F.col("_same")), "FILE_PATH_MISMATCH")
        .when(F.col("_local") & (F.col("_outside") | (F.col("_last") > F.col("line_count"))), "LINE_RANGE_MISMATCH")
        .when(F.col("_foreign").isNotNull(), F.col("_foreign"))
        .when(F.col("_ctx_index").isNotNull() & (F.col("_index") != F.col("_ctx_index")), "INDEX_VERSION_MISMATCH")
        .when(F.col("_ctx_repo").isNotNull() & (F.col("_repo") != F.col("_ctx_repo")), "REPOSITORY_MISMATCH")
    )
    return joined.select("response_id", "citation_id", "context_id", "evidence_id", reason.alias("reason"))


def citation_summary(checked: DataFrame) -> DataFrame:
    """Totals, reason histogram and kept ids per response, from one grouping by reason, so the checks run once."""
    good = F.col("reason").isNull()
    by_reason = checked.groupBy("response_id", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(F.when(good, F.col("evidence_id"))).alias("_kept")
    )
    histogram = F.array_sort(F.collect_list(F.when(~good, F.struct("reason", "n"))))
    return by_reason.groupBy("response_id").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(F.when(~good, F.col("n"))), F.lit(0)).alias("rejected"),
        F.array_sort(F.flatten(F.collect_list("_kept"))).alias("kept_ids"), F.map_from_entries(histogram).alias("reasons"),
    )


def confidence_downgrade(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """Confidence one level down and a limitation note when any citation was removed."""
    removed = checked.groupBy("response_id").agg((F.count("reason") > 0).alias("_removed"))
    lower = F.when(F.col("confidence") == "high", "medium").otherwise("low")
    note = F.lit("One or more citations failed evidence validation.")
    hit = F.coalesce("_removed", F.lit(False))
    return answers.join(removed, "response_id", "left").select(
        "response_id",
        F.when(hit, lower).otherwise(F.col("confidence")).alias("confidence"),
        F.when(
            hit, F.when(F.coalesce("limitations", F.lit("")) == "", note).otherwise(F.concat("limitations", F.lit(" "), note))
        ).otherwise(F.col("limitations")).alias("limitations"),
        hit.alias("downgraded"),
    )
