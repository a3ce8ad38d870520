"""Reusable plan shapes that stay bounded when one key holds a large share of the rows."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from codelode.session import stored

LINE_BLOCK = 256
#: Rows of a key that one task may order; the result doesn't depend on it.
LONG_KEY = 100_000
#: Every stored row belongs to one version of one corpus; searches and joins never leave it.
SCOPE = ["repository_id", "index_version"]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. The rank filter lets Spark prune to k rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def latest_per(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """Row with the greatest order value per key, with map-side combine instead of a sort."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return picked.select(*keys, "_row.*")


def within_rows(small: DataFrame, limit: int) -> bool:
    """True when the DataFrame is proven to have at most `limit` rows."""
    return small.limit(limit + 1).count() <= limit


def unsent(frame: DataFrame) -> DataFrame:
    """Side of a join that grows with the corpus. Rows made by explode count as one in Spark's estimate, so without this
    hint such a side looks small and is gathered in the driver and sent to every executor."""
    return frame.hint("merge")


def dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out over the session's tasks; a small file is one task, however many rows its rows turn into."""
    spark = frame.sparkSession
    return frame.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def cut_to_meet(
    items: DataFrame, questions: DataFrame, keys: Sequence[str], ids: tuple[str, str], slices: Column, blocks: Column,
    counted: DataFrame | None = None,
) -> tuple[GroupedData, GroupedData]:
    """Both sides grouped for a cogroup in which each question meets each item of its keys exactly once.

    Items are cut into slices and questions into blocks by their ids (item, question); `slices` and `blocks` say how many,
    over the rows of one key (of `counted` instead of the items, where given). A row is repeated once per block or slice of
    the other side. The plan has one short row per key and is sent to every task, so no key's rows gather in one.
    """
    plan = (items if counted is None else counted).groupBy(*keys).agg(F.ceil(slices).alias("_slices")).join(questions.groupBy(*keys).agg(F.ceil(blocks).alias("_blocks")), list(keys))

    def cut(frame: DataFrame, row_id: str, own: str, other: str) -> GroupedData:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)).alias(other)
        placed = frame.join(F.broadcast(plan), list(keys)).select(*frame.columns, F.pmod(F.xxhash64(row_id), F.col(f"{own}s")).alias(own), every)
        return placed.groupBy(*keys, "_slice", "_block")

    return cut(items, ids[0], "_slice", "_block"), cut(questions, ids[1], "_block", "_slice")


def line_blocks(df: DataFrame, start: str, end: str, block: str = "_block") -> DataFrame:
    """One row per line block that [start, end] touches, so one large file spreads over many tasks."""
    width = F.lit(LINE_BLOCK)
    return df.withColumn(
        block,
        F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))),
    )


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str
) -> DataFrame:
    """Inner join of points to the intervals that contain them, on keys plus line block."""
    left = points.withColumn("_block", F.floor(F.col(point) / F.lit(LINE_BLOCK)))
    right = line_blocks(intervals, start, end)
    joined = left.join(unsent(right), [*keys, "_block"])
    return joined.where(F.col(point).between(F.col(start), F.col(end))).drop("_block")


def overlapping_intervals(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
) -> DataFrame:
    """Inner join of intervals that share a line; each pair is emitted in its first common block only."""
    a, b = line_blocks(left, *left_range), line_blocks(right, *right_range)
    joined = a.join(unsent(b), [*keys, "_block"])
    first_shared = F.floor(F.greatest(F.col(left_range[0]), F.col(right_range[0])) / F.lit(LINE_BLOCK))
    return joined.where(
        (F.col(left_range[0]) <= F.col(right_range[1]))
        & (F.col(left_range[1]) >= F.col(right_range[0]))
        & (F.col("_block") == first_shared)
    ).drop("_block")


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[Column],
    value: Column,
    out: str,
    *,
    include_current: bool,
) -> DataFrame:
    """Running maximum per key, computed per block and stitched with the maxima of earlier blocks.

    `block` must not decrease along `order`. The sort runs per (key, block); only one row per
    block is ordered per key.
    """
    valued = df.withColumn("_value", value)
    last = 0 if include_current else -1
    local = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        valued.groupBy(*keys, block)
        .agg(F.max("_value").alias("_block_max"))
        .withColumn("_carry", F.max("_block_max").over(earlier))
        .drop("_block_max")
    )
    return (
        valued.withColumn("_local", F.max("_value").over(local))
        .join(carry, [*keys, block])
        .withColumn(out, F.greatest("_local", "_carry"))
        .drop("_local", "_carry", "_value")
    )


def islands(
    df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[Column], gap: int, out: str = "island"
) -> DataFrame:
    """Label runs of intervals whose start is at most `gap` after the furthest end so far.

    The label is the start line of the first interval of the run. Rows without a key or start have no run and are left out.
    Rows of a key move once and are ordered together; only keys with very many rows are cut into line blocks.
    """
    known = df.where(functools.reduce(lambda a, b: a & b, (F.col(name).isNotNull() for name in [*keys, start])))
    hashed = F.xxhash64(*keys)
    # Keys that share a hash are counted together, so no long key is missed.
    long = stored(known.groupBy(hashed.alias("_hash")).agg(F.count("*").alias("_n")).where(F.col("_n") > LONG_KEY).select("_hash"))
    if long.isEmpty():
        return _whole_islands(known, keys, start, end, order, gap, out)
    marked = known.withColumn("_hash", hashed)
    short, rest = (marked.join(F.broadcast(long), "_hash", how).drop("_hash") for how in ("left_anti", "left_semi"))
    return _whole_islands(short, keys, start, end, order, gap, out).unionByName(_cut_islands(rest, keys, start, end, order, gap, out))


def _whole_islands(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[Column], gap: int, out: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(*order)
    reach = df.withColumn("_reach", F.max(end).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > gap), F.col(start))
    return reach.withColumn(out, F.max(opens).over(before.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach")


def _cut_islands(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[Column], gap: int, out: str) -> DataFrame:
    blocked = df.withColumn("_blk", F.floor(F.col(start) / F.lit(LINE_BLOCK)))
    reach = running_max(blocked, keys, "_blk", order, F.col(end), "_reach", include_current=False)
    opens = F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > gap), F.col(start))
    labelled = running_max(reach, keys, "_blk", order, opens, out, include_current=True)
    return labelled.drop("_reach", "_blk")


def bucketed_row_number(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str
) -> DataFrame:
    """Exact row_number over a large key: `bucket` must not decrease along `order`.

    Each (key, bucket) is sorted on its own; bucket sizes give the offsets.
    """
    marked = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_local", "_offset")
    )
