"""Deletion by file, results computed once, and merged sketches."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import sketches
from tidewatch.sources import files
from tidewatch.sources.slices import SliceTable

AT = dt.datetime(2025, 1, 1)


def stored(path):
    return {f for f in os.listdir(path) if f.endswith(".parquet")}


def timed(spark, path):
    for day in range(1, 7):  # one file each; two days in each file
        spark.createDataFrame([(day, dt.datetime(2025, 1, day)), (day + 1, dt.datetime(2025, 1, day + 1))] + ([(99, None)] if day == 1 else []), "id int, at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)


def test_delete_before_rewrites_boundary_files_only(spark, tmp_path):
    path = str(tmp_path / "t")
    timed(spark, path)
    before = stored(path)
    told = files.delete_before(spark, path, "at", "2025-01-04 00:00:00")
    assert (told.rows, told.dropped, told.rewritten) == (5, 1, 2)  # days 1-2 (with a row without a time) and 3-4 are rewritten, 2-3 is dropped
    after = stored(path)
    assert len(after & before) == 3 and len(after - before) == 2
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [4, 4, 5, 5, 6, 6, 7, 99]
    assert files.delete_before(spark, path, "at", "2025-01-04 00:00:00") == files.Deleted(0, 0, 0) and stored(path) == after
    assert files.delete_before(spark, path, "at", "2026-01-01 00:00:00").rows == 7
    assert [r["id"] for r in spark.read.schema("id int, at timestamp_ntz").parquet(path).collect()] == [99]


def test_delete_before_after_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    timed(spark, path)
    real = files._hadoop

    class Dying:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def delete(self, *_):
            raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(files, "_hadoop", lambda s, p: (Dying(real(s, p)[0]), real(s, p)[1]))
        files.delete_before(spark, path, "at", "2025-01-04 00:00:00")
    files.delete_before(spark, path, "at", "2025-01-04 00:00:00")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [4, 4, 5, 5, 6, 6, 7, 99]


def test_results_are_computed_once(spark, tmp_path):
    kept, base = files.Results(spark, str(tmp_path / "kept")), str(tmp_path / "base")
    spark.range(10).write.parquet(base)
    calls = []
    source = lambda n: lambda: calls.append(n) or spark.read.parquet(base).where(f"id < {n}")
    first, again = kept.get("s", "2025-01-01", source(3)), kept.get("s", "2025-01-01", source(4))
    assert first.count() == again.count() == 3 and calls == [3]
    assert base not in again._jdf.queryExecution().toString() and not any(base in f for f in again.inputFiles())
    assert kept.get("s", "2025-01-02", source(5)).count() == 5 and kept.get("t", "2025-01-01", source(6)).count() == 6 and calls == [3, 5, 6]
    assert kept.forget("s", "2025-01-01") and kept.get("s", "2025-01-01", source(7)).count() == 7


def test_merged_sketches_keep_their_bound(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=20_000), rng.exponential(5, 20_000)])
    rows = spark.createDataFrame([(float(v), f"s{i % 7}", "ab"[i % 2] if i % 5 else None) for i, v in enumerate(values)] + [(None, "s0", "a")], "v double, slice string, k string")
    store = SliceTable(spark, str(tmp_path / "sketches"))
    for part in ("slice < 's4'", "slice >= 's3'"):
        sketches.update_sketches(store, rows, rows.where(part).select("slice").distinct(), ["v"], "r", AT, "k")
    told = sketches.quantile_metrics(store.read(), "t", {"p10": 0.1, "median": 0.5, "p99": 0.99}).collect()
    for r in told:
        want = {"p10": 0.1, "median": 0.5, "p99": 0.99}[r["metric_name"]]
        assert abs((values <= r["value"]).mean() - want) <= 1.7 / sketches.K and r["segment_value"] == ""
    assert {r["segment_value"]: r["n"] for r in sketches.merged(store.read(), ["segment_value"]).collect()} == {"k=a": 16_000, "k=b": 16_000, "k=<nil>": 8_000}
    assert sketches.merged(store.read().where(F.lit(False))).isEmpty()
