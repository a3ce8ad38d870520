"""Readers for file trees and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import paths as P

MANIFEST_SCHEMA = "path string, type string, sha string, size long, truncated boolean"


def read_tree(spark: SparkSession, root: str, *, with_content: bool = False) -> DataFrame:
    """Recursive listing: path relative to root and size; excluded and secret paths dropped.

    Without content the scan lists files and opens none of them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.substring_index(F.col("path"), prefix, -1), "^file:/+", "/")
    columns = [relative.alias("path"), F.col("length").alias("size_bytes")]
    if with_content:
        columns.append(F.col("content"))
    listed = raw.select(*columns)
    return listed.where(~P.is_excluded(F.col("path")) & ~P.is_secret(F.col("path")))


def read_manifest(spark: SparkSession, location: str) -> DataFrame:
    """Stored listing of a revision as JSON lines."""
    return spark.read.schema(MANIFEST_SCHEMA).json(location)


def manifest_files(manifest: DataFrame) -> DataFrame:
    """Blobs only, excluded and secret paths dropped; a truncated listing fails the job."""
    checked = manifest.where(
        F.when(
            F.coalesce(F.col("truncated"), F.lit(False)),
            F.raise_error(F.lit("the listing is truncated")).cast("boolean"),
        ).otherwise(F.lit(True))
    )
    return checked.where(
        (F.col("type") == "blob") & ~P.is_excluded(F.col("path")) & ~P.is_secret(F.col("path"))
    ).drop("type", "truncated")
