"""Version sink: data files first, the status row last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_version(tables: dict[str, DataFrame], location: str, counters: DataFrame) -> DataFrame:
    """Publish tables under (repository_id, index_version) and then the status rows.

    Partition overwrite makes a repeated write idempotent. A reader that joins the status table
    never sees a version whose data is incomplete.
    """
    for name, frame in tables.items():
        (
            frame.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("repository_id", "index_version")
            .parquet(f"{location}/{name}")
        )
    status = counters.withColumn("state", F.when(F.col("files_failed") > 0, "PARTIAL").otherwise("READY"))
    (
        status.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repository_id", "index_version")
        .parquet(f"{location}/index_versions")
    )
    spark = counters.sparkSession
    return spark.read.parquet(f"{location}/index_versions")
