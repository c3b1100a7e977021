"""Cutting lineage by tables in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the context's or the configured one; in local mode only, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-"))
    return sc.getCheckpointDir()


_OWN: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written where every executor can read it again, and read from there.

    Unlike a checkpoint, a table has its true size (small ones are then broadcast by Catalyst's own
    choice) and carries no constraints along, which loops would multiply in every round. The folder
    goes when the driver ends.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(_OWN[app])
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    at = f"{_OWN[app]}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
