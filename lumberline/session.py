"""Session helpers: a local builder for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "lumberline", partitions: int = 8) -> SparkSession:
    """A session for one machine.  On a cluster, use the session the cluster hands out."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LUMBERLINE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # Call sites per column double the time it takes to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so the caller must configure one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="lumberline-ckpt-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and continue from the table.

    Unlike a checkpoint, what follows reads only the columns it needs.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written rows.

    Used where two branches of one plan must see the same physical partitions, or where a
    small result is read several times.  The written files outlive lost executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that a finished step has staged."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
