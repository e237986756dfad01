"""Session helpers: table access, checkpoints in the shared folder, partition sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of the dataset folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pointspark-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, lineage dropped, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_checkpoints(spark: SparkSession) -> None:
    """Deletes this session's own part of the checkpoint folder: for use once the results of its queries are written.

    A session that sets spark.cleaner.referenceTracking.cleanCheckpoints before it starts has unreachable ones deleted as it goes.
    """
    at = spark.sparkContext.getCheckpointDir()
    if at:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)
        fs.mkdirs(path)


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared checkpoint folder, for files that a query writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
