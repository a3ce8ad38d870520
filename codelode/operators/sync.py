"""Incremental sync between index versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import scale
from codelode.operators.ingest import READY_STATES

ACTIVE_STATES = ["PENDING", "DISCOVERING", "PARSING", "EMBEDDING", "INDEXING"]


def sync_eligibility(corpora: DataFrame, installations: DataFrame, versions: DataFrame) -> DataFrame:
    """Verdict per corpus: source, access, installation, running job, ready version, in that order."""
    states = versions.groupBy("repository_id").agg(
        F.bool_or(F.col("state").isin(ACTIVE_STATES)).alias("_busy"),
        F.bool_or(F.col("state").isin(READY_STATES)).alias("_ready"),
    )
    active = installations.where(F.col("status") == "ACTIVE").select("installation_id").distinct().withColumn("_live", F.lit(True))
    joined = corpora.join(active, "installation_id", "left").join(states, "repository_id", "left")
    return joined.select(
        "repository_id",
        F.when(F.col("source_type") != "GITHUB", "WRONG_SOURCE")
        .when(F.col("access_status") != "ACTIVE", "ACCESS_UNAVAILABLE")
        .when(F.col("_live").isNull(), "NO_INSTALLATION")
        .when(F.coalesce("_busy", F.lit(False)), "IN_PROGRESS")
        .when(~F.coalesce("_ready", F.lit(False)), "NO_READY_INDEX")
        .otherwise("OK")
        .alias("verdict"),
    )


def next_version(versions: DataFrame) -> DataFrame:
    """Next version over all states and the newest ready version it builds on."""
    ready = F.when(F.col("state").isin(READY_STATES), F.col("version"))
    return versions.groupBy("repository_id").agg(
        (F.max("version") + 1).alias("next_version"), F.max(ready).alias("base_version")
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """UNCHANGED (same path and sha, unknown equals unknown), CHANGED, NEW or DELETED per path."""
    keys = ["repository_id", "path"]
    left = old.select(*keys, F.col("sha").alias("_old"), F.lit(True).alias("_had"))
    right = new.select(*keys, F.col("sha").alias("_new"), F.lit(True).alias("_has"))
    return left.join(right, keys, "full_outer").select(
        *keys,
        F.when(F.col("_has").isNull(), "DELETED")
        .when(F.col("_had").isNull(), "NEW")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "UNCHANGED")
        .otherwise("CHANGED")
        .alias("change"),
    )


def carry_forward(rows: DataFrame, diff: DataFrame, version: int, active_model: str | None = None) -> DataFrame:
    """Rows of unchanged files under the new version; vectors stay only for the active model."""
    unchanged = diff.where(F.col("change") == "UNCHANGED").select("repository_id", "path")
    kept = rows.join(unchanged, ["repository_id", "path"], "left_semi").withColumn("index_version", F.lit(version))
    if active_model is None:
        return kept
    current = F.col("model_version").eqNullSafe(F.lit(active_model))
    return kept.withColumns({
        "embedding": F.when(current, F.col("embedding")),
        "model_version": F.when(current, F.col("model_version")),
    })


def symbol_remap(old: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """(old_id, new_id, carried): carried symbols keep their place, others match on path, name and parent."""
    keys = ["repository_id", "path"]
    unchanged = diff.where(F.col("change") == "UNCHANGED").select(*keys, F.lit(True).alias("_same"))
    place = [*keys, "name", "start_line"]
    natural = new.groupBy(*keys, "name", F.coalesce("parent", F.lit("")).alias("_parent")).agg(
        F.max_by("symbol_id", F.struct("start_line", "symbol_id")).alias("_natural")
    )
    exact = new.groupBy(*place).agg(F.max("symbol_id").alias("_exact"))
    return (
        old.withColumn("_parent", F.coalesce("parent", F.lit("")))
        .join(unchanged, keys, "left")
        .join(exact, place, "left")
        .join(natural, [*keys, "name", "_parent"], "left")
        .select(
            F.col("symbol_id").alias("old_id"),
            F.when(F.col("_same"), F.col("_exact")).otherwise(F.col("_natural")).alias("new_id"),
            F.coalesce("_same", F.lit(False)).alias("carried"),
        )
        .where(F.col("new_id").isNotNull())
    )


def edge_carry_forward(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges from carried symbols whose target maps to the new version or was unresolved."""
    source = remap.where("carried").select(F.col("old_id").alias("from_id"), F.col("new_id").alias("_from"))
    target = remap.select(F.col("old_id").alias("to_id"), F.col("new_id").alias("_to"))
    return (
        edges.join(source, "from_id")
        .join(target, "to_id", "left")
        .where(F.col("to_id").isNull() | F.col("_to").isNotNull())
        .select(F.col("_from").alias("from_id"), F.col("_to").alias("to_id"), "kind", "confidence")
    )


def edge_relink(carried: DataFrame, rebuilt: DataFrame, changed: DataFrame) -> DataFrame:
    """Carried edges plus the freshly resolved edges of changed files.

    `rebuilt` comes from the full resolver over the whole new symbol table, so route links and
    import disambiguation survive a sync.
    """
    fresh = rebuilt.join(changed.select("repository_id", "path").distinct(), ["repository_id", "path"], "left_semi")
    columns = ["from_id", "to_id", "kind", "confidence"]
    return carried.select(*columns).unionByName(fresh.select(*columns))


def memory_invalidate(memories: DataFrame, chunks: DataFrame, diff: DataFrame) -> DataFrame:
    """Fresh memories that cite any chunk of a changed or deleted path become stale."""
    touched = chunks.join(
        diff.where(F.col("change").isin("CHANGED", "DELETED", "NEW")).select("repository_id", "path"),
        ["repository_id", "path"], "left_semi",
    ).select("repository_id", "chunk_id")
    hit = (
        memories.select("repository_id", "memory_id", F.explode("evidence_ids").alias("chunk_id"))
        .join(touched, ["repository_id", "chunk_id"], "left_semi")
        .select("memory_id").distinct().withColumn("_hit", F.lit(True))
    )
    return memories.join(hit, "memory_id", "left").withColumn(
        "is_stale", F.col("is_stale") | F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def memory_remap(memories: DataFrame, chunk_map: DataFrame, version: int) -> DataFrame:
    """Surviving memories point to the new chunk ids when all ids map, otherwise they become stale."""
    cited = memories.where(~F.col("is_stale")).select("memory_id", F.posexplode("evidence_ids").alias("pos", "old_id"))
    mapped = cited.join(chunk_map, "old_id", "left").groupBy("memory_id").agg(
        F.every(F.col("new_id").isNotNull()).alias("_all"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "new_id"))), lambda x: x["new_id"]).alias("_ids"),
    )
    alive = F.coalesce("_all", ~F.col("is_stale"))
    return memories.join(mapped, "memory_id", "left").select(
        *[c for c in memories.columns if c not in ("evidence_ids", "is_stale", "index_version")],
        F.when(F.col("_all"), F.col("_ids")).otherwise(F.col("evidence_ids")).alias("evidence_ids"),
        (~alive | F.col("is_stale")).alias("is_stale"),
        F.when(alive & ~F.col("is_stale"), F.lit(version)).otherwise(F.col("index_version")).alias("index_version"),
    )


def access_status_update(corpora: DataFrame, events: DataFrame) -> DataFrame:
    """Apply access events: for a whole installation, or for one corpus of it; the newest event wins.

    Reads installation_id, repository_id (null for all), status and sequence.
    """
    def newest(frame: DataFrame, keys: list[str], name: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.max(F.struct("sequence", "status")).alias(name))

    wide = newest(events.where(F.col("repository_id").isNull()), ["installation_id"], "_wide")
    narrow = newest(events.where(F.col("repository_id").isNotNull()), ["installation_id", "repository_id"], "_narrow")
    joined = corpora.join(wide, "installation_id", "left").join(narrow, ["installation_id", "repository_id"], "left")
    latest = F.greatest("_wide", "_narrow")
    return joined.withColumn("access_status", F.coalesce(latest["status"], "access_status")).drop("_wide", "_narrow")
