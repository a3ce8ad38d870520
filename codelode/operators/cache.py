"""Result cache with a time limit, result mapping and argument redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.functions import scale

# Cache and redaction rules.
MAX_RESULTS = 5
REDACTED = "[REDACTED]"
SENSITIVE = "apikey|authorization|credential|password|privatekey|secret|token"


def cache_prune(rows: DataFrame, cutoff: Column) -> DataFrame:
    return rows.where(F.col("retrieved_at") >= cutoff)


def cache_lookup(rows: DataFrame, requests: DataFrame, cutoff: Column, limit: int = MAX_RESULTS) -> DataFrame:
    """First rows by position of each requested hash that are not expired."""
    hits = cache_prune(rows, cutoff).join(requests.select("query_hash").distinct(), "query_hash", "left_semi")
    return scale.top_k(hits, ["query_hash"], [F.asc("position"), F.asc("url")], limit)


def cache_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or overwrite by (query_hash, url); the newest row wins."""
    columns = [c for c in stored.columns if c not in ("query_hash", "url")]
    every = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return scale.latest_per(every, ["query_hash", "url"], columns, F.struct("retrieved_at", "_new", "position"))


def url_domain(results: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    """Results with a link: default title, lower-case domain, first `limit` per query."""
    linked = results.where(F.coalesce("url", F.lit("")) != "")
    first = scale.top_k(linked, ["query_id"], [F.asc("position"), F.asc("url")], limit)
    return first.select(
        "query_id", "url",
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("Untitled result")).alias("title"),
        F.lower(F.coalesce(F.try_parse_url("url", F.lit("AUTHORITY")), F.lit(""))).alias("source_domain"),
    )


def is_sensitive(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "").rlike(SENSITIVE)


def redact(value: Column, kind: T.DataType) -> Column:
    """Rebuild a typed value with everything under a sensitive key replaced, at any depth.

    The expression follows the schema, so it stays inside the JVM. A sensitive key of an open map
    is redacted per entry; a sensitive field of a struct becomes the marker.
    """
    if isinstance(kind, T.StructType):
        def field(item: T.StructField) -> Column:
            marker = "".join(ch for ch in item.name.lower() if ch.isalnum())
            if any(word in marker for word in SENSITIVE.split("|")):
                return F.when(value[item.name].isNotNull(), F.lit(REDACTED)).alias(item.name)
            return redact(value[item.name], item.dataType).alias(item.name)

        return F.when(value.isNotNull(), F.struct(*[field(item) for item in kind.fields]))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return F.transform_values(value, lambda k, v: F.when(is_sensitive(k), F.lit(REDACTED)).otherwise(v))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: redact(item, kind.elementType))
    return value


def redact_arguments(calls: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON argument texts with sensitive values replaced."""
    parsed = F.from_json("args", schema)
    return calls.withColumn("args", F.to_json(redact(parsed, schema)))
