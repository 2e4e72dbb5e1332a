"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on: joins on an entity key split a hot key at run time, even
# where the next step wants the same partitioning, and shuffle partitions are merged to fit.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# A shuffle partition should fit in the memory of one task.
PARTITION_BYTES = 128 * 1024 * 1024


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the SQL settings above.

    Given the size of the inputs, also start shuffles with enough partitions for them; small ones
    are merged at run time. Without it the partition count stays as the session has it.
    """
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes is not None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = max(least, -(-input_bytes // PARTITION_BYTES))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return spark


def local_session(cpus: int | str = "*", app: str = "cohortloom", **conf: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Recording the Python call site of every column costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, where every executor can write and read.

    Only a local session without that setting gets a folder of its own, which goes when Python ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="cohortloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    ``local_session`` also has Spark remove each checkpoint once its frame is no longer in use.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
