"""Tables written to the folder that a cluster shares, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that names none (a test) gets a folder of its own.

    On a cluster such a folder would be another one on each machine, so a missing setting is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Renames a file or folder in one step; False, and nothing done, where ``new`` exists."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(old)
    context = jvm.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    kinds[0] = getattr(jvm.Options.Rename, "NONE")
    try:
        context.rename(context.makeQualified(at), context.makeQualified(jvm.Path(new)), kinds)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True
