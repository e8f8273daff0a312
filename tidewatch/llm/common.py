"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Target size, in bytes of text, of the slices that numpy works on at a time.
SLICE_BYTES = 2_000_000


_MEMO: dict[object, dict] = {}


def give_back() -> None:
    """Returns freed memory of this process to the system; glibc and Arrow keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def worker_memo(owner: object) -> dict:
    """What this Python worker remembers for ``owner``. Spark reuses workers, so only one operator's memo is kept:
    when another one asks, the memory is given back."""
    if owner not in _MEMO:
        if _MEMO:
            _MEMO.clear()
            give_back()
        _MEMO[owner] = {}
    return _MEMO[owner]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session that names none (a test) gets a folder of its own; on a cluster such a folder would be
    another one on each machine, so a missing setting is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Bytes of a batch that goes between Spark and a Python worker while a table is written.
BATCH_BYTES = "16m"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of the queries run inside as soon as each has ended, and sends small batches to Python."""
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        yield


def _written(df: DataFrame, path: str) -> DataFrame:
    with short_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not the work before.
    """
    return _written(df, f"{shared_dir(df.sparkSession)}/stash-{tag}-{uuid.uuid4().hex}")


class Scratch:
    """The tables that one call writes for itself: a folder in the shared folder, deleted once at the end.

    What the call returns must not read them: ``stash`` the result inside the ``with`` block.
    """

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/scratch-{tag}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """As ``stash``, in this folder."""
        return _written(df, f"{self.path}/{tag}-{uuid.uuid4().hex}")

    def delete(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.delete()


def fresh(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(col: str | Column = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0).cast("bigint"))


def text_slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts take about ``limit`` bytes (one row at least)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def cut_at_spaces(texts: pa.StringArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of texts between spaces, the pieces of all texts in turn (by number), and where each text ends."""
    cut = pc.split_pattern(texts, " ")
    coded = cut.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False), dtype=np.int64)


def salted_rank(df: DataFrame, keys: list[str], out: str, salt_on: list[str], order: list[str] | None = None, salts: int = 64) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 among the rows of equal ``keys``.

    Two steps, so that a hot key is dealt over ``salts`` groups: rows are numbered inside
    (keys, salt), and the counts of the salts before (at most ``salts`` rows a key) are added.
    The order among salts is arbitrary but fixed. Keys may not be null.
    """
    from pyspark.sql import Window

    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_on]), F.lit(salts)).cast("int")
    rows = df.withColumn("__salt", salt)
    counts = rows.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    within = Window.partitionBy(*keys, "__salt").orderBy(*(order or salt_on))
    numbered = rows.withColumn("__k", F.row_number().over(within) - 1)
    return numbered.join(starts, [*keys, "__salt"]).withColumn(out, F.col("__from") + F.col("__k")).drop("__from", "__k", "__salt", "__n")
