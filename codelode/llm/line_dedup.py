"""Line de-duplication against levelled sorted runs of line keys."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.common import saved, unused_names

_TRIM = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """Digest of a line without outer white space and in lower case (A-Z); None below `least` code points."""
    line = line.strip(_TRIM)
    if len(line) < least or (len(line) < 4 * least and len(line.decode("utf-8", "replace")) < least):
        return None
    return hashlib.blake2b(line.lower(), digest_size=16).digest()


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """Distinct (doc_id, key) pairs of each row."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if doc_id is None or not text.is_valid:
                    continue
                own = {line_key(line, least) for line in text.as_buffer().to_pybytes().split(b"\n")} - {None}
                ids += [doc_id] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(per_batch, "doc_id long, key binary")


class LineRuns:
    """Sorted runs of line keys in levels.

    A run is a table bucketed and sorted by key: a batch is dealt by key once and then merges with every run without
    moving the run. `fanout` runs of one level are compacted into one run of the next level, so a batch meets
    O(fanout * log(batches)) runs. Keys are disjoint across runs.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    def absorb(self, keys: DataFrame) -> DataFrame:
        """Add the (doc_id, key) pairs of a batch; returns the pairs that have to go.

        A key in an earlier run goes from every document of the batch, another key from all but its smallest doc_id.
        """
        own = (
            keys.groupBy("key")
            .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
            .repartition(self.buckets, "key")
            .withColumn("seen", F.lit(False))
        )
        for run in (name for level in self.levels for name in level):
            known = self.spark.table(run).withColumn("known", F.lit(True))
            own = own.join(known, "key", "left").select(
                "key", "owner", "last", (F.col("seen") | F.coalesce("known", F.lit(False))).alias("seen")
            )
        own = saved(own, "line-batch")
        self._add(own.where("not seen").select("key"), 0)
        shared = own.where("seen or owner <> last").select("key", "owner", "seen")
        return keys.join(shared, "key").where("seen or doc_id <> owner").select("doc_id", "key")

    def _add(self, keys: DataFrame, level: int) -> None:
        self.made += 1
        run = f"{self.name}_{self.made}"
        keys.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(run)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self.levels[level], []
            frame = self.spark.table(merged[0])
            for name in merged[1:]:
                frame = frame.union(self.spark.table(name))
            self._add(frame, level + 1)
            self._drop(merged)

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def dedup_lines(docs: DataFrame, *, batches: int = 4, fanout: int = 2, least: int = 10) -> DataFrame:
    """Every input row and column plus kept (text without dropped lines), n_lines, n_dropped.

    Documents enter the runs in `batches` ranges of doc_id, so a line stays in the smallest doc_id that has it. Short
    lines (under `least` code points) always stay. A null or empty text is one empty line; a row without doc_id keeps
    all its lines and claims none; rows that share a doc_id are one document.
    """
    spark = docs.sparkSession
    cuts = docs.select(
        F.percentile_approx(F.col("doc_id").cast("long"), [(i + 1) / batches for i in range(batches - 1)], 10_000)
    ).first()[0] if batches > 1 else []
    part = F.lit(0)
    for cut in sorted(set(cuts or [])):
        part = part + (F.col("doc_id") > F.lit(cut)).cast("int")
    pairs = saved(line_keys(docs, least).withColumn("part", part), "line-keys", ("part",))
    runs = LineRuns(spark, fanout)
    drops = None
    try:
        for number in range(len(set(cuts or [])) + 1):
            found = saved(runs.absorb(pairs.where(F.col("part") == number).drop("part")), "line-drops")
            drops = found if drops is None else drops.union(found)
    finally:
        runs.drop()
    own, gone_keys, out = unused_names(docs, "_doc", "_keys", "_out")
    lost = drops.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("key").alias(gone_keys))

    @F.pandas_udf("kept string, n_lines long, n_dropped long")
    def rewrite(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for body, gone in zip(text, keys, strict=True):
            lines = (body or "").split("\n")
            left = lines
            if gone is not None and len(gone):
                gone = {bytes(key) for key in gone}
                left = [line for line in lines if line_key(line.encode(), least) not in gone]
            out.append(("\n".join(left), len(lines), len(lines) - len(left)))
        return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])

    joined = docs.join(lost, F.col("doc_id").cast("long") == F.col(own), "left")
    clash = [name for name in docs.columns if name in ("kept", "n_lines", "n_dropped")]
    return joined.withColumn(out, rewrite("text", gone_keys)).select(
        *[docs[name] for name in docs.columns if name not in clash], f"{out}.kept", f"{out}.n_lines", f"{out}.n_dropped"
    )
