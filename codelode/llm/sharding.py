"""Weighted rendezvous hashing of record keys over shards. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of a shard that are numbered on their own; bounds the table of offsets to shards * SLICES rows.
SLICES = 4096


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard with the highest weighted score for the key.

    Each shard draws a number u in (0, 1) from a hash of (key, shard) and scores -w / ln(u), so a shard gets keys in
    proportion to its weight, and a new shard only takes keys for which it scores highest. Ties go to the lower shard.
    """
    scored = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        digest = F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary"))
        drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
        score = -F.ln((drawn + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))
        scored.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    if not scored:
        raise ValueError("at least one shard needs a positive weight")
    return F.array_min(F.array(*scored))["shard"]


def assign_shards(
    docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text", grown_weight: float = 1.0
) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, grown_shard (with one more shard) and slot.

    `slot` numbers the rows of a shard from 0 without gaps. A null key counts as the empty key, a null text as no
    bytes (crc32 0, size 1). Rows with equal key and text are counted first and numbered as a run, so a key with a
    large share of all rows is never sorted row by row; every slice of a shard is ordered on its own.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    counted = rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("copies"))
    slice_hash = F.md5(F.concat(name, F.lit("/"), F.col("text_crc32").cast("string")).cast("binary"))
    placed = counted.select(
        "*",
        shard_of(name, weights).alias("shard"),
        shard_of(name, [*weights, grown_weight]).alias("grown_shard"),
        F.pmod(F.conv(F.substring(slice_hash, 1, 8), 16, 10).cast("long"), F.lit(SLICES)).alias("slice"),
    )
    inside = Window.partitionBy("shard", "slice").orderBy(key, "size", "text_crc32")
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "slice")
        .agg(F.sum("copies").alias("rows"))
        .select("shard", "slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    )
    numbered = placed.withColumn("upto", F.sum("copies").over(inside)).join(offsets, ["shard", "slice"])
    return numbered.select(
        key,
        "size",
        "text_crc32",
        "shard",
        "grown_shard",
        F.explode(F.sequence(F.expr("offset + upto - copies"), F.expr("offset + upto - 1"))).alias("slot"),
    )
