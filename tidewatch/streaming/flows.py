"""Continuous file ingest and event copying with Structured Streaming.

Checkpoints track files exactly once; both flows can run once over what is there (available_now) or keep on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _started(writer, trigger: str) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if trigger == "available_now" else writer.trigger(processingTime=trigger)).start()


def file_stream(spark: SparkSession, path: str, pattern: str, fmt: str, schema, archive: str | None = None, max_files: int = 1000) -> DataFrame:
    """A stream of new files; with ``archive``, processed files are moved there."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on is kept in RocksDB, outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_of_each(stream: DataFrame, keys: list[str], time_column: str, delay: str = "1 day") -> DataFrame:
    """The stream without rows whose keys came before, within ``delay`` of event time; state leaves as the watermark passes."""
    stamp = stream.withColumn("event_time", F.col(time_column).cast("timestamp")).withWatermark("event_time", delay)
    return stamp.dropDuplicatesWithinWatermark(keys).drop("event_time")


def ingest_stream(
    spark: SparkSession, path: str, pattern: str, fmt: str, schema, target: str, checkpoint: str, archive: str | None = None, trigger: str = "available_now",
    unique: list[str] | None = None, time_column: str | None = None, delay: str = "1 day", max_files: int = 1000,
) -> StreamingQuery:
    """Loads new files into a Parquet table. With ``archive``, files of batches that are done are moved there; with ``unique`` and ``time_column`` rows that are delivered again (in another file, or by a sender that crashed) are dropped."""
    rows = file_stream(spark, path, pattern, fmt, schema, archive, max_files)
    if unique:
        keep_state_in_rocksdb(spark)
        rows = first_of_each(rows, unique, time_column, delay)
    return _started(rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append"), trigger)


#: Event types and run statuses that count as failures.
FAILURES = ("asset_failed", "node_failed", "run_failed")
FAILED_STATUS = ("failed", "completed_with_failures")


def event_sink_stream(stream: DataFrame, runs_path: str, failures_path: str, checkpoint: str, trigger: str = "available_now") -> StreamingQuery:
    """Copies events to files by run, and failures to a second place.

    Each batch writes under its own number, so a batch that is repeated after a crash replaces itself.
    """
    bad = F.col("event_type").isin(*FAILURES) | F.coalesce(F.get_json_object("details", "$.status").isin(*FAILED_STATUS), F.lit(False))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            keyed = batch.withColumn("key", F.concat_ws(":", "pipeline", "run_id"))
            keyed.write.mode("overwrite").json(f"{runs_path}/batch={number}")
            keyed.where(bad).write.mode("overwrite").json(f"{failures_path}/batch={number}")
        finally:
            batch.unpersist()

    return _started(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger)
