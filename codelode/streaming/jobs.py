"""Structured Streaming jobs: call pairing, time-limited result cache, incremental file sync."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def pair_calls(starts: DataFrame, ends: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Starts and ends of tool calls joined on (run_id, sequence): PAIRED, or OPEN or ORPHAN once the wait is over.

    A stream-stream outer join with a time bound: an end counts at most `wait` after its start, whichever of the two
    arrives first, so the result doesn't depend on batch borders. Spark keeps a side in state only until the
    watermark shows that no partner can come. starts: run_id, sequence, tool_name, started_at; ends: run_id, sequence,
    status, duration_ms, ended_at.
    """
    left = starts.withWatermark("started_at", wait).select(
        F.col("run_id").alias("s_run"), F.col("sequence").alias("s_sequence"), "tool_name", "started_at"
    )
    right = ends.withWatermark("ended_at", wait)
    bound = F.expr(f"run_id = s_run AND sequence = s_sequence AND ended_at >= started_at AND ended_at <= started_at + INTERVAL {wait}")
    joined = left.join(right, bound, "full_outer")
    return joined.select(
        F.coalesce("run_id", "s_run").alias("run_id"), F.coalesce("sequence", "s_sequence").alias("sequence"),
        "tool_name", "status", "duration_ms",
        F.when(F.col("ended_at").isNull(), "OPEN").when(F.col("started_at").isNull(), "ORPHAN").otherwise("PAIRED").alias("verdict"),
    )


def first_results(results: DataFrame, keys: list[str], ttl_seconds: int) -> DataFrame:
    """(keys, retrieved_at): the first result of a key is kept; later ones only once the kept one has expired.

    The state of a key is the time of its kept result and is dropped when the watermark passes its expiry, so it
    holds keys of about one time limit, not of the whole history. Rows of one batch are taken in time order.
    """
    kinds = [f"{name} {results.schema[name].dataType.simpleString()}" for name in keys]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get[0] if state.exists else None
        taken = []
        for at in np.sort(np.concatenate([frame["_us"].to_numpy() for frame in batches])).tolist():
            if kept is None or at >= kept + ttl_seconds * 1_000_000:
                kept = at
                taken.append(at)
        state.update((kept,))
        state.setTimeoutTimestamp(max(kept // 1000 + ttl_seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if taken:
            yield pd.DataFrame({**{name: [value] * len(taken) for name, value in zip(keys, key, strict=True)}, "_us": taken})

    timed = results.withWatermark("retrieved_at", f"{ttl_seconds} seconds").withColumn("_us", F.unix_micros("retrieved_at"))
    found = timed.groupBy(*keys).applyInPandasWithState(
        step, ", ".join([*kinds, "_us long"]), "kept long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(*keys, F.timestamp_micros("_us").alias("retrieved_at"))


LOG_SCHEMA = "repository_id string, path string, sha string, op string, version long, bucket int"
KEYS = ["repository_id", "path"]
#: Path buckets of the log: a batch reads only those it touches.
BUCKETS = 64
#: Versions after which the log is compacted into a new base.
COMPACT_EVERY = 8


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int")


def _newest(log: DataFrame) -> DataFrame:
    newest = log.groupBy("bucket", *KEYS).agg(F.max_by(F.struct("sha", "op", "version"), "version").alias("r"))
    return newest.select("bucket", *KEYS, "r.*").where(F.col("op") == "put")


def base_version(spark: SparkSession, location: str, before: int | None = None) -> int:
    """Version up to which the log is compacted; the base of version 0 is the first snapshot."""
    marks = spark.read.schema("version long").parquet(f"{location}/bases")
    return (marks if before is None else marks.where(F.col("version") < before)).agg(F.max("version")).first()[0] or 0


def current_files(spark: SparkSession, location: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Newest row per path, deletions dropped: the last base and the log after it, of the given path buckets."""
    base = base_version(spark, location, before)
    rows = spark.read.schema(LOG_SCHEMA).parquet(f"{location}/base").where(F.col("version") == base).unionByName(
        spark.read.schema(LOG_SCHEMA).parquet(f"{location}/log").where(F.col("version") > base)
    )
    if before is not None:
        rows = rows.where(F.col("version") < before)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    return _newest(rows)


def write_log(rows: DataFrame, location: str, version: int, part: str = "log") -> None:
    rows.select(*KEYS, "sha", "op", _bucket().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(
        f"{location}/{part}/version={version}"
    )


def write_base(rows: DataFrame, location: str, version: int) -> None:
    """A whole listing as the new base; its mark is written last, so a reader never sees half of it."""
    spark = rows.sparkSession
    write_log(rows, location, version, "base")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("overwrite").parquet(f"{location}/bases/v{version}")


def start_log(rows: DataFrame, location: str) -> None:
    """First snapshot and an empty log."""
    write_log(rows.limit(0), location, 0)
    write_base(rows, location, 0)


def apply_changes(batch: DataFrame, location: str, version: int) -> None:
    """Append the effective changes of one batch as one version of the log.

    Only the touched path buckets since the last base are compared, so the cost follows the batch and not the
    history; puts that keep a sha are dropped. The version follows from the batch id, so a repeated batch overwrites
    its own folder and nothing else.
    """
    last = batch.groupBy(*KEYS).agg(F.max_by(F.struct("sha", "op"), "position").alias("r")).select(*KEYS, "r.*")
    touched = [row[0] for row in last.select(_bucket()).distinct().collect()]  # at most BUCKETS numbers
    known = current_files(batch.sparkSession, location, version, touched).join(last.select(*KEYS), KEYS, "left_semi").select(
        *KEYS, F.col("sha").alias("_sha"), F.lit(True).alias("_known")
    )
    joined = last.join(known, KEYS, "left")
    same = (F.col("op") == "put") & F.col("_known").isNotNull() & F.col("sha").eqNullSafe(F.col("_sha"))
    gone = (F.col("op") == "delete") & F.col("_known").isNull()
    write_log(joined.where(~(same | gone)), location, version)
    if version % COMPACT_EVERY == 0:
        write_base(current_files(batch.sparkSession, location, version + 1), location, version)


def sync_stream(changes: DataFrame, location: str, checkpoint: str):
    """Start the incremental sync of a change stream; version 0 of the log is the base snapshot."""
    return (
        changes.writeStream.foreachBatch(lambda batch, batch_id: apply_changes(batch, location, batch_id + 1))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, location: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain the available input into parquet and read it back."""
    running = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", location)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(location)
