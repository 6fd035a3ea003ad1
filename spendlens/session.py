"""Session settings the operators are tuned for.

On a cluster the session usually exists already; only what is unset is filled in.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FILE_BYTES = 4 << 20  # of a staged table whose size is known, before it is compressed


def local_session(app: str = "spendlens", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a scratch one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spendlens-", dir=os.environ.get("TMPDIR")))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage", size: int | None = None) -> DataFrame:
    """Write to the shared folder and read back.

    Cuts the lineage so that a lost executor costs one read, computes a result used several
    times once, and gives the planner real sizes.  Where the caller knows about how many bytes
    there are at most (``size``), small tables do not become a file a task.
    """
    path = shared_scratch(df.sparkSession, name)
    if size is not None:
        df = df.coalesce(max(1, -(-size // FILE_BYTES)))
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
