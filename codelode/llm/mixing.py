"""Sources mixed to target weights by a low-discrepancy schedule of equal-word blocks. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import saved

#: Points of the golden-ratio sequence are multiples of 1 / POINTS; STEP is the odd number next to POINTS times the ratio.
POINTS = 1 << 31
STEP = 1327217885
#: The points are looked up by cell, so a slot meets the sources of its cell only.
CELL_BITS = 19
#: Slots that are numbered together, documents of a bucket that are ordered together, and copies that are made at once.
SLOT_BITS = 14
BUCKET_ROWS = 4096
COPIES = 4096


def word_count(text: Column) -> Column:
    """Number of runs of anything but blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_units(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, digest, copies): rows that are equal in all of it are counted as copies of one unit."""
    return (
        docs.select(
            F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"),
        )
        .groupBy("doc_id", "source", "size", "digest")
        .agg(F.count("*").alias("copies"))
    )


def source_targets(units: DataFrame, weights: Sequence[int] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, index, units, source_size, target, words) of every source, by code point, null last.

    The sources share all words by the repeating `weights`. A target stops at `limit` times the words of its source and
    the rest goes to the others by weight: target = min(limit * size, level * weight) with the one level that adds up
    to all words. The level is the largest of those that the sources, ordered by the level at which they stop, ask for.
    `words` is the target as whole words. The table has a row for each source and is made in one task.
    """
    sizes = units.groupBy("source").agg(F.count("*").alias("units"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    whole = Window.partitionBy()
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ordered = sizes.select("*", (F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1).alias("index"))
    ordered = ordered.select("*", F.get(cycle, F.col("index") % len(weights)).alias("weight"), (F.col("source_size") * limit).alias("most"))
    before = whole.orderBy(F.col("most") / F.col("weight"), "index").rowsBetween(Window.unboundedPreceding, -1)
    asked = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levelled = ordered.select("*", asked.alias("asked")).select("*", F.max("asked").over(whole).alias("level"))
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return levelled.select(
        "source", "index", "units", "source_size", target.alias("target"),
        F.least("most", F.floor(target + 0.5)).cast("long").alias("words"),
    )


def slot_schedule(targets: DataFrame, block: int) -> DataFrame:
    """(index, rank, slot): the slot at which each source's block number `rank` comes.

    Slot i has the point i * golden ratio mod 1, and the source in whose share of the cumulative targets the point lies,
    so any run of slots is close to the targets. Slots of a source are numbered by chunks: counts of chunks are added
    up, slots are ordered inside their chunk only. Slots beyond a source's last block are left out; blocks that the
    sequence hasn't reached (a few of each source) follow after its end.
    """
    spark = targets.sparkSession
    whole = Window.partitionBy()
    through = F.sum("words").over(whole.orderBy("index").rowsBetween(Window.unboundedPreceding, 0))
    placed = targets.select("index", "words", through.alias("to"), F.sum("words").over(whole).alias("all")).where("words > 0")
    edge = lambda c: F.floor(c / F.col("all") * POINTS).cast("long")
    placed = placed.select(
        "index", F.ceil(F.col("words") / block).alias("blocks"), edge(F.col("to") - F.col("words")).alias("low"), edge(F.col("to")).alias("high")
    )
    # the number of slots is the only figure that the driver needs
    total = targets.agg(F.sum("words")).first()[0] or 0
    count = -(-total // block)
    cell = F.explode(F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS))).alias("cell")
    cells = placed.where("low < high").select("index", "blocks", "low", "high", cell)
    point = F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * STEP, F.lit(POINTS))
    slots = spark.range(count).select(F.col("id").alias("slot"), point.alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", CELL_BITS)).join(cells, "cell").where("low <= point AND point < high")
    slots = slots.select("index", "blocks", "slot", F.shiftright("slot", SLOT_BITS).alias("chunk"))
    counts = slots.groupBy("index", "chunk").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("index").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("index", "chunk", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("index", "chunk").orderBy("slot")) - 1
    ranked = slots.join(offsets, ["index", "chunk"]).select("index", "blocks", (F.col("offset") + inside).alias("rank"), "slot")
    reached = counts.groupBy("index").agg(F.sum("n").alias("reached"))
    missing = placed.join(reached, "index", "left").select("index", "blocks", F.coalesce("reached", F.lit(0)).alias("reached"))
    missing = missing.where("reached < blocks").select("index", "reached", F.explode(F.sequence("reached", F.col("blocks") - 1)).alias("rank"))
    width = targets.agg(F.max("index") + 1).first()[0] or 1
    late = F.lit(count) + (F.col("rank") - F.col("reached")) * width + F.col("index")
    return ranked.where("rank < blocks").select("index", "rank", "slot").union(missing.select("index", "rank", late.alias("slot")))


def _each_copy(units: DataFrame) -> DataFrame:
    """A row for each copy of a unit, numbered by `copy`; no row of the plan holds more than COPIES numbers at once."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES).cast("long"))).alias("_part")
    begin = F.col("_part") * COPIES
    return units.select("*", part).select(
        "*", F.explode(F.sequence(begin, F.least(begin + COPIES, F.col("copies")) - 1)).alias("copy")
    ).drop("_part", "copies")


def shuffled_blocks(units: DataFrame, targets: DataFrame, block: int, seed: int) -> DataFrame:
    """(index, rank, doc_id, digest, size, copy, start, length): the words of documents in each source's blocks.

    A source's documents are shuffled by hash and cut into blocks of `block` words; after the last word the source is
    shuffled anew for another pass, until its target is reached. Buckets of documents are added up, and documents are
    ordered inside their bucket only, so a source with a large share of all rows is no single task.
    """
    known = targets.where("words > 0").select(
        F.col("source").alias("_source"), "index", "source_size", "words", F.greatest(F.lit(1), F.floor(F.col("units") / BUCKET_ROWS)).alias("_buckets")
    )
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size")).cast("long"))).alias("pass")
    rows = units.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("_source"))).select("*", passes)
    name = F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", "pass", F.lit(seed))
    rows = rows.withColumn("_lot", F.md5(name.cast("binary")))
    rows = rows.withColumn("_bucket", F.pmod(F.conv(F.substring("_lot", 1, 8), 16, 10).cast("long"), F.col("_buckets")))
    rows = rows.withColumn("_run", F.col("size") * F.col("copies"))
    place = ["index", "pass", "_bucket"]
    sums = rows.groupBy(*place).agg(F.sum("_run").alias("_sum"))
    so_far = Window.partitionBy("index", "pass").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*place, F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_base"))
    earlier = Window.partitionBy(*place).orderBy("_lot", "doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("pass") * F.col("source_size") + F.col("_base") + F.coalesce(F.sum("_run").over(earlier), F.lit(0))
    run = rows.join(bases, place).withColumn("_begin", begin).where("_begin < words")
    each = _each_copy(run).withColumn("_from", F.col("_begin") + F.col("copy") * F.col("size")).where("_from < words")
    each = each.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("words")))
    ranks = F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))).alias("rank")
    each = each.select("*", ranks)
    first = F.greatest(F.col("rank") * block, F.col("_from"))
    return each.select(
        "index", "rank", "doc_id", "digest", "size", "copy", (first - F.col("_from")).alias("start"),
        (F.least((F.col("rank") + 1) * block, F.col("_to")) - first).alias("length"),
    )


class Mixture:
    """Documents mixed to the targets of their sources.

    `units` and `targets` are stored tables; `spans` gives the mixture itself and `documents` what it takes of each row.
    Rows that are equal in id, source and text are told apart by `copy`. A null source is a source of its own, a null
    text has no words, ids may be null or repeated. A document is taken at most `limit` times, since every pass over its
    source takes it once. The same table gives the same mixture, whatever its files, partitions and row order.
    """

    def __init__(
        self, docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = (1, 2, 3), limit: int = 3, block: int = 1024, seed: int = 0,
    ) -> None:
        if not weights or min(weights) < 1 or limit < 1 or block < 1:
            raise ValueError("weights, limit and block must be positive")
        self.block, self.seed = block, seed
        self.units = saved(document_units(docs, key=key, text=text, source=source), "mixture-units")
        self.targets = saved(source_targets(self.units, weights, limit), "mixture-targets")

    def spans(self) -> DataFrame:
        """(slot, index, rank, doc_id, digest, size, copy, start, length): words start to start + length of a document
        stand in a slot of the mixture; `index` is the source's number in `targets`."""
        blocks = shuffled_blocks(self.units, self.targets, self.block, self.seed)
        return slot_schedule(self.targets, self.block).join(blocks, ["index", "rank"]).select(
            "slot", "index", "rank", "doc_id", "digest", "size", "copy", "start", "length"
        )

    def documents(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken) of every row."""
        known = self.targets.select(F.col("source").alias("_source"), "index", "source_size", "target")
        rows = _each_copy(self.units).join(known, F.col("source").eqNullSafe(F.col("_source")))
        unit = ["index", "doc_id", "digest", "size", "copy"]
        same = ["source", "source_size", "target"]
        none = rows.select(*unit, *same, F.lit(0).cast("long").alias("length"))
        spans = self.spans().select(*unit, *[F.lit(None).cast(none.schema[c].dataType).alias(c) for c in same], "length")
        taken = none.union(spans).groupBy(*unit).agg(*[F.max(c).alias(c) for c in same], F.sum("length").alias("taken"))
        return taken.select("doc_id", "source", "size", "source_size", "target", "taken")
