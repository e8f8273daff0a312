"""Versions of models (queries, scripts) from an activation log: asset, source, source_hash, activated_at, seq, run_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_hash(c: str):
    """The content hash of a source text."""
    return F.sha2(F.col(c), 256)


def model_versions(activations: DataFrame) -> DataFrame:
    """asset, version, source_hash, activated_at, replaced_at, change: a new version whenever the hash of the source changes.

    The hash is taken of ``source``, unless the log brings its own source_hash.
    """
    if "source_hash" not in activations.columns:
        activations = activations.withColumn("source_hash", source_hash("source"))
    order = Window.partitionBy("asset").orderBy("activated_at", "seq")
    new = F.col("source_hash").eqNullSafe(F.lag("source_hash").over(order))
    rows = activations.withColumn("__first", F.lag("seq").over(order).isNull()).withColumn("__new", F.col("__first") | ~new).where("__new")
    return rows.select(
        "asset", F.row_number().over(order).alias("version"), "source_hash", "activated_at", "seq",
        F.lead("activated_at").over(order).alias("replaced_at"),
        F.when(F.row_number().over(order) == 1, "registered").otherwise("changed").alias("change"),
    )


def model_current(versions: DataFrame, activations: DataFrame) -> DataFrame:
    """The latest version of each asset and its last activation."""
    latest = versions.groupBy("asset").agg(F.max_by(F.struct("version", "source_hash", "activated_at"), "version").alias("m"))
    last = activations.groupBy("asset").agg(F.max("activated_at").alias("last_activated_at"))
    return latest.join(last, "asset").select("asset", "m.version", "m.source_hash", "m.activated_at", "last_activated_at")


def model_diff(versions: DataFrame) -> DataFrame:
    """Positional line differences of consecutive versions (asset, version, source): asset, version, line_no, old_line, new_line."""
    order = Window.partitionBy("asset").orderBy("version")
    pairs = versions.select("asset", "version", "source", F.lag("source").over(order).alias("old"), F.lag("version").over(order).alias("old_version")).where("old_version IS NOT NULL")
    lines = F.arrays_zip(F.split("old", "\n").alias("o"), F.split("source", "\n").alias("n"))
    rows = pairs.select("asset", "version", F.posexplode(lines).alias("pos", "z"))
    return rows.where(~F.col("z.o").eqNullSafe(F.col("z.n"))).select("asset", "version", (F.col("pos") + 1).alias("line_no"), F.col("z.o").alias("old_line"), F.col("z.n").alias("new_line"))
