"""Deleting rows of Parquet tables by file, and results that are computed once.

Neither has a log of its own: what a crash leaves is told by names, and the next call sets it right.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import moment
from tidewatch.sources.scratch import renamed

_KEPT = "kept-"


@dataclass(frozen=True)
class Deleted:
    """Rows deleted, files dropped whole, files rewritten."""

    rows: int
    dropped: int
    rewritten: int


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _kept(name: str) -> str:
    """The name of a file's rewritten form."""
    return f"{_KEPT}{hashlib.md5(name.encode()).hexdigest()}.parquet"


def _mend(spark: SparkSession, path: str) -> None:
    """Deletes files whose rewritten form is there already: a crash came between."""
    fs, at = _hadoop(spark, path)
    names = {s.getPath().getName() for s in fs.listStatus(at(path)) if s.isFile()}
    for name in names:
        if _kept(name) in names:
            fs.delete(at(f"{path}/{name}"), False)


def delete_before(spark: SparkSession, path: str, column: str, cutoff) -> Deleted:
    """Deletes the rows of a flat Parquet table whose time is before the cutoff; rows without a time stay.

    One scan of that column tells the files apart: those wholly before the cutoff are deleted, those on both sides are written anew without
    the old rows, and all others keep their names. A rewritten file appears before its old form goes, under a name that says so, so a call after a crash ends the work.
    """
    path = path.rstrip("/")
    _mend(spark, path)
    fs, at = _hadoop(spark, path)
    table = spark.read.parquet(path)
    old = F.coalesce(F.col(column) < moment(cutoff), F.lit(False))
    found = table.select(F.col("_metadata.file_name").alias("file"), old.alias("old")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("old").alias("gone")).where("gone > 0").collect()  # a row a file that loses rows
    whole = [r["file"] for r in found if r["n"] == r["gone"]]
    partly = [r["file"] for r in found if r["n"] > r["gone"]]
    if partly:
        staged = f"{path}/_rewrite-{uuid.uuid4().hex}"
        kept = table.select("*", F.col("_metadata.file_name").alias("__file")).where(F.col("__file").isin(partly) & ~old)
        kept.repartition("__file").write.partitionBy("__file").parquet(staged)
        for folder in fs.listStatus(at(staged)):
            name = folder.getPath().getName().partition("=")[2]
            if name:
                parts = sorted(s.getPath().getName() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().startswith("part-"))
                if len(parts) > 1:
                    raise RuntimeError(f"{name} was rewritten as {len(parts)} files")
                fs.rename(at(f"{staged}/__file={name}/{parts[0]}"), at(f"{path}/{_kept(name)}"))
        for name in partly:
            fs.delete(at(f"{path}/{name}"), False)
        fs.delete(at(staged), True)
    for name in whole:
        fs.delete(at(f"{path}/{name}"), False)
    return Deleted(sum(r["gone"] for r in found), len(whole), len(partly))


def archived_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id and file of every run line that an archive (see ``batch.archive_runs``) holds."""
    rows = spark.read.schema("kind string, run_id bigint").json(path)
    return rows.where("kind = 'run'").select("run_id", F.col("_metadata.file_path").alias("file")).distinct()


class Results:
    """Frames kept under a hash of (source, interval) in a shared folder, computed once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, source: str, interval) -> str:
        return f"{self.folder}/{hashlib.sha256(f'{source}{chr(10)}{interval}'.encode()).hexdigest()}"

    def get(self, source: str, interval, compute: Callable[[], DataFrame]) -> DataFrame:
        """The kept frame; ``compute`` is asked only if there is none. Written beside and renamed, so nobody reads half of it; of two writers the first counts."""
        path = self.path(source, interval)
        fs, at = _hadoop(self.spark, path)
        if not fs.exists(at(f"{path}/_SUCCESS")):
            df, staged = compute(), f"{path}.new-{uuid.uuid4().hex}"
            df.write.parquet(staged)
            if not renamed(self.spark, staged, path):
                fs.delete(at(staged), True)
        return self.spark.read.parquet(path)

    def outputs(self, source: str, interval, compute: Callable[[], DataFrame], outputs: dict[str, Callable[[DataFrame], DataFrame]], write: Callable[[str, DataFrame], None]) -> None:
        """Several outputs of one source and interval; later calls for other outputs read what the first has kept."""
        df = self.get(source, interval, compute)
        for name, f in outputs.items():
            write(name, f(df))

    def forget(self, source: str, interval) -> bool:
        fs, at = _hadoop(self.spark, self.folder)
        return bool(fs.delete(at(self.path(source, interval)), True))
