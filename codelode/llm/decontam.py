"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token places that each mask looks at; the places between them may hold other tokens. Together the masks hit every
#: aligned window of WINDOW tokens with at most SUBSTITUTIONS changed tokens, and every shorter item of SPAN tokens or
#: more under the same rate of changes (tests/llm checks all patterns).
MASKS = ((0, 1, 2, 3, 4, 6), (0, 1, 2, 4, 5, 6), (0, 3, 4, 5, 6, 7))
SPAN = 8
WINDOW = 13
SUBSTITUTIONS = 2
#: Seeds of the benchmark side that are broadcast at most (about 100 bytes each); a larger benchmark is shuffled.
BROADCAST_SEEDS = 200_000


#: Letters of scripts that are written without spaces (Thai, Lao, Myanmar, Khmer, Japanese, Chinese); each is a token.
UNSPACED = r"[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{3134F}]"


def tokens_of(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; characters of scripts without spaces one by one."""
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return F.array_remove(F.split(F.lower(spaced), r"[^\p{L}\p{M}\p{N}]+"), "")


def _seeds(rows: DataFrame, *carried: str) -> DataFrame:
    """One row per place and mask: carried columns, `at` (0-based place) and `seed` (hash of the mask's tokens)."""
    places = rows.select(*carried, "tokens", F.explode_outer(F.expr("if(size(tokens) > 5, sequence(0, size(tokens) - 6), null)")).alias("at"))
    hashed = []
    for number, mask in enumerate(MASKS):
        picked = [F.get("tokens", F.col("at") + k) for k in mask]
        hashed.append(F.when(F.col("at") + mask[-1] < F.size("tokens"), F.xxhash64(F.lit(number), *picked)))
    return places.where("at IS NOT NULL").select(*carried, "tokens", "at", F.stack(F.lit(len(MASKS)), *hashed).alias("seed")).where("seed IS NOT NULL")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, alignments, matched): documents that repeat a benchmark item.

    An item is repeated where, on one alignment of the two token sequences, WINDOW consecutive tokens (all of a
    shorter item) agree but for SUBSTITUTIONS of them (in proportion for a shorter item). `alignments` counts the
    alignments and `matched` is the largest number of agreeing tokens in a window. An item under SPAN tokens is repeated
    where all its tokens follow each other. Null and empty texts repeat nothing. Every row is aligned on its own, and the rows of one id, or without an id, are counted
    together afterwards. Rows are told apart by their place, so `docs` has to be read in the same order by a repeated
    task, as a stored table is.
    """
    items = benchmark.select("item_id", F.col("text").alias("item_text")).distinct()
    every = items.select("item_id", tokens_of(F.col("item_text")).alias("tokens"))
    items = every.where(F.size("tokens") >= SPAN)
    known = _seeds(items, "item_id").select("item_id", F.col("tokens").alias("item"), F.col("at").alias("item_at"), "seed").distinct()
    if known.count() <= BROADCAST_SEEDS:
        known = F.broadcast(known)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", tokens_of(F.col("text")).alias("tokens"))
    found = _seeds(rows, "row", "doc_id").join(known, "seed")
    shift = F.col("at") - F.col("item_at")
    begin = F.greatest(shift, F.lit(0))
    aligned = (
        found.select("row", "doc_id", "item_id", shift.alias("shift"), F.slice("tokens", begin + 1, F.size("item") - (begin - shift)).alias("ours"), "item")
        .groupBy("row", "item_id", "shift")
        .agg(F.first("doc_id").alias("doc_id"), F.first("ours").alias("ours"), F.first("item").alias("item"))
    )
    theirs = F.slice("item", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("ours"))
    hits = F.zip_with("ours", theirs, lambda x, y: (x == y).cast("int"))
    window = F.least(F.lit(WINDOW), F.size("item"))
    matched = F.array_max(
        F.transform(
            F.when(F.size("hits") >= F.col("window"), F.sequence(F.lit(1), F.size("hits") - F.col("window") + 1)),
            lambda start: F.aggregate(F.slice("hits", start, F.col("window")), F.lit(0), lambda total, hit: total + hit),
        )
    )
    checked = aligned.select("doc_id", "item_id", hits.alias("hits"), window.alias("window")).select("doc_id", "item_id", "window", matched.alias("matched"))
    repeated = checked.where(F.col("matched") >= F.col("window") - F.floor(F.col("window") * SUBSTITUTIONS / WINDOW))
    repeated = repeated.groupBy("doc_id", "item_id").agg(F.count("*").alias("alignments"), F.max("matched").cast("long").alias("matched"))
    short = every.where(F.size("tokens").between(1, SPAN - 1)).distinct()
    sizes = sorted(r["n"] for r in short.select(F.size("tokens").alias("n")).distinct().collect())  # fewer than SPAN
    return repeated.union(_whole_items(rows, short, sizes)) if sizes else repeated


def _whole_items(rows: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, item_id, alignments, matched) of the places at which all tokens of an item follow each other."""
    def runs_of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("tokens") - n + 1), lambda at: F.slice("tokens", at, n))
        return F.when(F.size("tokens") >= n, every).otherwise(F.array().cast("array<array<string>>"))

    runs = F.flatten(F.array(*map(runs_of, sizes)))
    told = rows.select("doc_id", F.explode(runs).alias("tokens")).groupBy("doc_id", "tokens").agg(F.count("*").alias("alignments"))
    return told.join(items, "tokens").select("doc_id", "item_id", "alignments", F.size("tokens").cast("long").alias("matched"))
