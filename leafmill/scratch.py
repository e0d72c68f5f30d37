"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set and the master is local (a single machine, as in tests) a temporary folder is
    set and used. Anywhere else that folder would be another one on each machine, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = folder.get() if folder.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; its folder is deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/leafmill-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return f"{folder}/{name}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again.

    A lost executor then costs a read of finished files, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
