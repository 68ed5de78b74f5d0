"""Session helpers: lineage cuts that survive lost executors."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a private one only where none is set and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytes of a batch of rows on the way to Python or back, where the session sets none.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get by their bytes.

    Spark's own bounds, 10,000 rows and 64 MB, let the memory of a worker, and the buffers beside its executor's heap,
    grow with the length of the texts.  No row is left out, and a longer row comes alone.  What the session sets holds.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, spark.conf.get(name, BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder.

    What no frame needs any more is then given back: Spark deletes shuffle and
    checkpoint files when the driver collects the objects that stand for them,
    which in a job of many short steps would come too late for the disks.  The setting
    spark.colloquy.collectAfterCheckpoint = false leaves that to Spark's own cleaner.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    kept = df.checkpoint(eager=True)
    if spark.conf.get("spark.colloquy.collectAfterCheckpoint", "true") != "false":
        gc.collect()
        context._jvm.System.gc()
    return kept
