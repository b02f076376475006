"""Spark session helpers.

The library never creates a session inside an operator; callers pass one in.
These helpers are for tests, the bench and local runs only.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "reviewlake") -> SparkSession:
    """A local session with the settings the library expects.

    AQE stays on (partition coalescing and skew-join splitting), the UI is
    off, the session zone is UTC so TIMESTAMP_NTZ casts are deterministic.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        # One BLAS thread per Python worker: the block similarity tasks run
        # one per core already; threaded BLAS would oversubscribe the cores.
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables and stream checkpoints.

    It is the one that ``spark.checkpoint.dir`` names (shared on a cluster);
    where the session sets none, a folder in the session's warehouse, which
    driver and executors share as well. The rule is the same on every master.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return folder
