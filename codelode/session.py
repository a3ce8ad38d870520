"""Session defaults. Cluster settings already present always win."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(app: str = "codelode", cpus: str = "8") -> SparkSession:
    """Session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; a local one only for local masters."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        shared = tempfile.mkdtemp(prefix="codelode-checkpoint-")
    context.setCheckpointDir(shared)


def stored(frame: DataFrame) -> DataFrame:
    """Write an expensive result once to the checkpoint folder and read it from there.

    Reliable across lost executors, and every later use of the frame starts from the stored rows.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def saved(frame: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame as Parquet below the shared checkpoint folder and read it again.

    Unlike a checkpoint the files are compressed and can be read by column, or by the values of the columns `by`.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    frame.write.partitionBy(*by).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
