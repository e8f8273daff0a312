"""Batch sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import moment


@dataclass(frozen=True)
class SourceSpec:
    """Where a source's tables are. ``kind``: table, path, iceberg, postgres or mysql; ``root``: namespace, folder or JDBC url."""

    name: str
    kind: str
    root: str
    fmt: str = "parquet"
    options: dict = field(default_factory=dict)


def read_source(spark: SparkSession, spec: SourceSpec, table: str) -> DataFrame:
    """A table of a source. Paths keep their scheme (file, gs, s3a, ...)."""
    if spec.kind in ("table", "iceberg"):
        return spark.table(f"{spec.root}.{table}" if spec.root else table)
    if spec.kind == "path":
        return spark.read.format(spec.fmt).options(**spec.options).load(f"{spec.root.rstrip('/')}/{table}.{spec.fmt}")
    if spec.kind in ("postgres", "mysql"):
        return spark.read.format("jdbc").options(url=spec.root, dbtable=table, **spec.options).load()
    raise ValueError(f"unknown kind of source: {spec.kind}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts a staged folder in the place of ``path``."""
    jvm = spark._jvm.org.apache.hadoop.fs
    a, b, old = jvm.Path(new), jvm.Path(path), jvm.Path(f"{path}.old-{uuid.uuid4().hex}")
    fs = b.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(b):
        fs.rename(b, old)
    fs.rename(a, b)
    if fs.exists(old):
        fs.delete(old, True)


def _last_rows(rows: DataFrame, keys: list[str], order_by: str | None) -> DataFrame:
    """One row of each key."""
    row = F.struct(*rows.columns)
    best = F.max_by(row, F.struct(order_by, row.alias("row")) if order_by else row)
    return rows.groupBy(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys))).agg(best.alias("row")).select("row.*")


def ingest_files(spark: SparkSession, path: str, pattern: str, fmt: str, schema, method: str, target: str, keys: list[str] | None = None, order_by: str | None = None) -> DataFrame:
    """Loads the files under ``path`` that match a glob into the Parquet table at ``target``.

    ``append`` adds, ``replace`` overwrites, ``merge`` replaces rows of equal keys: what stays and what is new is
    written beside the table and swapped in, so a path is never overwritten while it is read. Of rows of one key in the
    drop the one with the greatest ``order_by`` stays (ties, or without it: the greatest row). Null keys equal null keys, so
    loading a drop again changes nothing.
    """
    reader = spark.read.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    new = (reader.option("header", True) if fmt == "csv" else reader).load(path)
    if method == "merge" and _exists(spark, target):
        if not keys:
            raise ValueError("a merge needs keys")
        new = _last_rows(new, keys, order_by)
        old, told = spark.read.parquet(target), new.select(*(F.col(k).alias(f"new_{i}") for i, k in enumerate(keys)))
        kept = old.join(told, reduce(and_, (old[k].eqNullSafe(told[f"new_{i}"]) for i, k in enumerate(keys))), "left_anti")
        staged = f"{target}.new-{uuid.uuid4().hex}"
        kept.unionByName(new, allowMissingColumns=True).write.parquet(staged)
        _swap(spark, staged, target)
    elif method in ("append", "replace", "merge"):
        if method == "merge" and keys:
            new = _last_rows(new, keys, order_by)
        new.write.mode("append" if method == "append" else "overwrite").parquet(target)
    else:
        raise ValueError(f"unknown load method: {method}")
    return spark.read.parquet(target)


def export_files(df: DataFrame, path: str, fmt: str = "parquet", interval_start=None) -> None:
    """Writes a table; with ``interval_start`` under dt=YYYY-MM-DD, replacing that day alone."""
    writer = df.write.mode("overwrite")
    if interval_start is not None:
        writer = df.withColumn("dt", F.to_date(moment(interval_start))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def materialize(df: DataFrame, path: str, partition_by: str | None = None, granularity: str = "day", cluster_by: list[str] | None = None) -> DataFrame:
    """Replaces the table at ``path``, partitioned by a truncated time column and clustered within partitions."""
    out, parts = df, []
    if partition_by:
        out, parts = df.withColumn("part", F.to_date(F.date_trunc(granularity, F.col(partition_by)))), ["part"]
    if cluster_by:
        out = out.repartitionByRange(*parts, *cluster_by).sortWithinPartitions(*parts, *cluster_by)
    elif parts:
        out = out.hint("rebalance", *parts)  # adaptive execution splits large partitions over tasks
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def _rank(bounds: Column, value: Column) -> Column:
    return F.coalesce(F.size(F.filter(bounds, lambda v: v < value)), F.lit(0))


def z_value(df: DataFrame, columns: list[str], bits: int = 6) -> Column:
    """A column's rank among ``2 ** bits`` equal shares, for each of the columns, their bits interleaved: rows near in all columns are near in this order.

    Ranks come from approximate percentiles, one row in all; nulls are first.
    """
    shares = [k / 2**bits for k in range(1, 2**bits)]
    cuts = df.agg(*(F.percentile_approx(c, shares, 10_000).alias(f"c{i}") for i, c in enumerate(columns))).first()
    out = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        told = df.schema[c].dataType
        bounds = F.array(*(F.lit(v).cast(told) for v in cuts[i] or []))
        rank = _rank(bounds, F.col(c))
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1)).cast("bigint"), b * len(columns) + i))
    return out


def materialize_zorder(df: DataFrame, path: str, cluster_by: list[str], files: int, bits: int = 6) -> DataFrame:
    """Replaces the table at ``path`` by ``files`` files in Z-order of several columns, so that a predicate on any of them leaves files out."""
    taken = {c.lower() for c in df.columns}
    z = "z" if "z" not in taken else "__z"
    ordered = df.withColumn(z, z_value(df, cluster_by, bits)).repartitionByRange(files, z).sortWithinPartitions(z).drop(z)
    ordered.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def files_hit(table: DataFrame, column: str, low, high) -> int:
    """How many files hold values of a column between low and high, going by each file's least and greatest value."""
    span = table.select(F.col("_metadata.file_path").alias("f"), F.col(column).alias("v")).groupBy("f").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return span.where((F.col("a") <= F.lit(high)) & (F.col("b") >= F.lit(low))).count()


def load_stats(df: DataFrame, name: str, time_column: str | None = None) -> tuple[DataFrame, Observation]:
    """The frame with counters attached: rows and, if asked, first and last time, without a second scan."""
    seen = Observation(name)
    times = [F.min(time_column).alias("min_time"), F.max(time_column).alias("max_time")] if time_column else []
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *times), seen


def multi_output(df: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]], write: Callable[[str, DataFrame], None]) -> None:
    """Computes a frame once and writes several outputs of it."""
    df = df.persist()
    try:
        for name, f in outputs.items():
            write(name, f(df))
    finally:
        df.unpersist()


def archive_runs(runs: DataFrame, events: DataFrame, path: str) -> None:
    """JSON lines of runs and their events under pipeline=/year=/month=, run lines before event lines of a file.

    A month of many rows is split over tasks and files."""
    stamp = [F.year("at").alias("year"), F.month("at").alias("month")]
    r = runs.withColumn("kind", F.lit("run")).withColumn("at", F.col("started_at"))
    e = events.withColumn("kind", F.lit("event")).join(runs.select("run_id", F.col("started_at").alias("at")), "run_id")
    both = r.unionByName(e, allowMissingColumns=True).select("*", *stamp).drop("at")
    both.hint("rebalance", "pipeline", "year", "month").sortWithinPartitions("pipeline", "year", "month", "run_id", F.desc("kind")).write.mode("append").partitionBy("pipeline", "year", "month").json(path)
