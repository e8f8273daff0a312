"""A log of interval states that is compacted: a snapshot by buckets, and a tail of what was appended since.

A compacted log is a log, too: of each (asset, interval_start) it keeps the row that last opened the interval and the last row, which is all that
``interval_state_upsert`` needs. So the snapshot and the tail together give what the full log would, and compaction may be repeated or die anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.intervals import interval_state_upsert
from tidewatch.sources.slices import SliceTable

LOG = "asset string, interval_start timestamp_ntz, status string, run_id string, at timestamp_ntz, seq bigint"
_COLUMNS = [c.split()[0] for c in LOG.split(", ")]


def compacted(log: DataFrame) -> DataFrame:
    """At most two rows of each interval, from its last opening on; intervals that were never opened have none."""
    last_open = F.max(F.when(F.col("status") == "in_progress", F.col("seq"))).over(key := Window.partitionBy("asset", "interval_start"))
    rows = log.select(*_COLUMNS).withColumns({"last_open": last_open, "last": F.max("seq").over(key)})
    return rows.where((F.col("seq") == F.col("last_open")) | ((F.col("seq") == F.col("last")) & F.col("last_open").isNotNull())).select(*_COLUMNS)


class StateLog:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.snapshot = SliceTable(spark, f"{self.path}/snapshot")

    def append(self, rows: DataFrame) -> None:
        """Adds rows; ``seq`` must be above that of all rows before."""
        rows.select(*_COLUMNS).write.mode("append").parquet(f"{self.path}/tail")

    def upto(self) -> int:
        """The greatest seq that the snapshot covers; -1: none."""
        told = self.snapshot.state().where("status = 'complete'").agg(F.min(F.col("run_id").cast("bigint"))).first()[0]
        return -1 if told is None else told

    def tail(self, upto: int) -> DataFrame:
        """Rows after the snapshot; Parquet statistics leave out files of older rows."""
        return self.spark.read.schema(LOG).parquet(f"{self.path}/tail").where(F.col("seq") > upto)

    def read(self) -> DataFrame:
        """A log that says what the full one says."""
        upto = self.upto()
        return self.tail(upto) if upto < 0 else self.snapshot.read().select(*_COLUMNS).unionByName(self.tail(upto))

    def state(self) -> DataFrame:
        return interval_state_upsert(self.read())

    def compact(self, at) -> int:
        """Takes the tail into the snapshot and deletes what it covers; returns the greatest seq taken in."""
        upto = self.upto()
        newest = self.tail(upto).agg(F.max("seq")).first()[0]
        if newest is None:
            return upto
        # rows that are appended meanwhile stay in the tail
        rows = compacted(self.read().where(F.col("seq") <= newest)).withColumn("slice", F.format_string("%05d", F.pmod(F.xxhash64("asset"), F.lit(self.buckets))))
        slices = self.spark.range(self.buckets).select(F.format_string("%05d", "id").alias("slice"))
        self.snapshot.load(rows, slices, str(newest), at)
        self.snapshot.vacuum(1)
        files = self.spark.read.schema(LOG).parquet(f"{self.path}/tail").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.max("seq").alias("last")).where(F.col("last") <= newest).collect()  # a row a file
        for r in files:
            self.snapshot._fs().delete(self.snapshot.jvm.Path(f"{self.path}/tail/{r['f']}"), False)
        return newest
