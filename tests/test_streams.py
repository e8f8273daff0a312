"""Streams that are stopped and go on: alarms, repeated deliveries, moved files."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from tidewatch.streaming import flows, freshness

START = dt.datetime(2025, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=float(hours))


def deliver(spark, path, rows):
    spark.createDataFrame(rows, "asset string, completed_at timestamp").coalesce(1).write.mode("append").json(path)


def test_alarms_equal_the_batch_answer_over_restarts(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(f"a{k}", at(round(h, 3))) for k in range(6) for h in np.cumsum(rng.exponential(5, 40))] + [("quiet", at(1)), ("twice", at(2)), ("twice", at(2)), (None, at(3)), ("gone", None)]
    late = rng.permutation(len(rows))
    found, target, mark = (str(tmp_path / x) for x in ("found", "alarms", "mark"))
    for i, part in enumerate(np.array_split(late, 3)):  # in any order, within the delay
        deliver(spark, found, [rows[j] for j in part])
        stream = flows.file_stream(spark, found, "*.json", "json", "asset string, completed_at timestamp", max_files=1)
        freshness.freshness_alarms(stream, 6, "400 hours").writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.schema(freshness.ALARMS).parquet(target).count() == 0 or i == 2  # nothing is told before it is sure
    deliver(spark, found, [("end", at(500))])
    for _ in range(2):  # a run without new files tells nothing again
        stream = flows.file_stream(spark, found, "*.json", "json", "asset string, completed_at timestamp", max_files=1)
        freshness.freshness_alarms(stream, 6, "400 hours").writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(freshness.ALARMS).parquet(target)
    want = freshness.freshness_gaps(spark.createDataFrame(rows, "asset string, completed_at timestamp").distinct(), 6, at(100))
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(got) == order(want.where("due_at < timestamp'2025-01-05 04:00:00'")) and got.where("asset = 'quiet'").count() == 1


def test_repeated_deliveries_and_archive(spark, tmp_path):
    found, target, mark, away = (str(tmp_path / x) for x in ("found", "t", "mark", "away"))
    schema = "id bigint, at timestamp"

    def load():
        flows.ingest_stream(spark, found, "*.json", "json", schema, target, mark, away, unique=["id"], time_column="at", delay="2 days", max_files=1).awaitTermination()

    rows = spark.range(50).select("id", F.lit(START).cast("timestamp").alias("at"))
    for _ in range(2):  # a file delivered twice
        rows.coalesce(1).write.mode("append").json(found)
    load()
    rows.where("id >= 40").union(spark.range(50, 55).select("id", F.lit(at(1)).cast("timestamp"))).coalesce(1).write.mode("append").json(found)
    load()
    rows.limit(0).write.mode("append").json(found)
    load()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(55))
    moved = [f for _, _, names in os.walk(away) for f in names if f.endswith(".json")]
    left = [f for f in os.listdir(found) if f.endswith(".json")]
    assert len(moved) >= 2 and not set(moved) & set(left)
