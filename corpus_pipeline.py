"""A corpus from raw documents to packed sequences: quality, lines, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage gets it written and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.common import saved, table
from codelode.llm.decontam import leaks
from codelode.llm.line_dedup import dedup_lines
from codelode.llm.ngram_join import near_duplicates
from codelode.llm.packing import packed_sequences, token_pieces
from codelode.llm.quality import quality_score, train


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of its own input, doesn't reject."""
    scored = quality_score(docs, train(docs, table(spark, sf_dir, "labels")), out="_score")
    return scored.where("_score >= 0.5").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier document has; n_chars follows the text."""
    done = dedup_lines(docs).withColumn("text", F.col("kept"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Rows are compared by their texts, whatever their ids: rows that share a doc_id or have none stay unless their text
    is in a group with a smaller row. Rows without id come last in a group.
    """
    keyed = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed-rows")
    found = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"), size=5, threshold=Fraction(8, 10))
    placed = found.select(F.col("doc_id").alias("_row"), "component_id").join(keyed.select("_row", "doc_id"), "_row")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    return keyed.join(first.select("first._row"), "_row", "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text repeats no benchmark item, with an id or without; texts are told apart by their SHA-256."""
    keyed = docs.withColumn("_text", F.sha2(F.col("text").cast("binary"), 256))
    found = leaks(keyed.select(F.col("_text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias("_text")).distinct(), "_text", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids: pieces of the documents with their sequence and offset."""
    import public_tokenizers

    ranks, vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    return packed_sequences(saved(token_pieces(docs, ranks, vocabulary, with_ids=True), "token-pieces"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
