"""Streaming queries, each compared with its batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.catalogue import CATALOGUE
from codelode.operators import sync as S
from codelode.plans.ingest_queries import shared_location
from codelode.sources.tables import Tables, oracle
from codelode.streaming import jobs as J

query = CATALOGUE.query


def events_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn(
        "event_time", F.col("ts").cast("timestamp")
    )


# Open and orphan calls show once the watermark, the wait behind the newest event, has passed the time of any partner.
@query("stream_call_pairing", """WITH e AS (SELECT *, CAST(ts AS TIMESTAMP) AS happened, max(CAST(ts AS TIMESTAMP)) OVER () - INTERVAL 1 HOUR AS mark FROM events)
    SELECT user_id AS run_id, event_id AS sequence, CASE WHEN event_type <> 'signup' THEN event_type END AS tool_name,
      CASE WHEN event_type <> 'error' THEN CASE WHEN value > 100 THEN 'ERROR' ELSE 'OK' END END AS status, CASE WHEN event_type <> 'error' THEN value END AS duration_ms,
      CASE event_type WHEN 'signup' THEN 'ORPHAN' WHEN 'error' THEN 'OPEN' ELSE 'PAIRED' END AS verdict
    FROM e WHERE event_type NOT IN ('error', 'signup') OR (event_type = 'error' AND happened + INTERVAL 1 HOUR < mark) OR (event_type = 'signup' AND happened < mark)""")
def stream_call_pairing(spark, sf):
    """Every event starts and ends a call; errors never end, signups never started."""
    events = events_stream(spark, sf).select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), "event_type", "value", "event_time"
    )
    starts = events.where("event_type <> 'signup'").select(
        "run_id", "sequence", F.col("event_type").alias("tool_name"), F.col("event_time").alias("started_at")
    )
    ends = events.where("event_type <> 'error'").select(
        "run_id", "sequence", F.expr("CASE WHEN value > 100 THEN 'ERROR' ELSE 'OK' END").alias("status"),
        F.col("value").alias("duration_ms"), F.col("event_time").alias("ended_at"),
    )
    paired = J.pair_calls(starts, ends, "1 hour")
    return J.run_to_table(paired, shared_location(spark, "pairs"), shared_location(spark, "pairs-checkpoint"))


@query("stream_ttl_cache", """WITH k AS (SELECT user_id, event_type, list(epoch_us(CAST(ts AS TIMESTAMP)) ORDER BY ts) AS times FROM events GROUP BY ALL),
    f AS (SELECT user_id, event_type, list_reduce(list_transform(times, lambda t: [t]), lambda kept, t:
      CASE WHEN t[1] >= kept[-1] + 259200000000 THEN list_concat(kept, t) ELSE kept END) AS kept FROM k)
    SELECT user_id, event_type, unnest(kept) AS kept_us FROM f""")
def stream_ttl_cache(spark, sf):
    results = events_stream(spark, sf).select("user_id", "event_type", F.col("event_time").alias("retrieved_at"))
    first = J.first_results(results, ["user_id", "event_type"], 3 * 86_400)
    done = J.run_to_table(first, shared_location(spark, "cache"), shared_location(spark, "cache-checkpoint"))
    return done.select("user_id", "event_type", F.unix_micros("retrieved_at").alias("kept_us"))


@query("stream_incremental_sync", oracle("SELECT repository_id, path, sha FROM snapshot_new", "snapshot_new"))
def stream_incremental_sync(spark, sf):
    """Changes between two snapshots arrive as files over several batches; the log ends at the new snapshot."""
    t = Tables(spark, sf)
    location, checkpoint = shared_location(spark, "sync"), shared_location(spark, "sync-checkpoint")
    J.start_log(t.snapshot("old").withColumn("op", F.lit("put")), location)
    diff = S.snapshot_diff(t.snapshot("old"), t.snapshot("new")).where("change <> 'UNCHANGED'")
    changes = diff.join(t.snapshot("new").drop("file_id"), ["repository_id", "path"], "left").select(
        "repository_id", "path", "sha", F.expr("CASE WHEN change = 'DELETED' THEN 'delete' ELSE 'put' END").alias("op"),
        F.lit(1).alias("position"),
    )
    incoming = shared_location(spark, "changes")
    changes.repartition(4, "path").write.parquet(incoming)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 2).parquet(incoming)
    J.sync_stream(stream, location, checkpoint).awaitTermination()
    return J.current_files(spark, location).select("repository_id", "path", "sha")
