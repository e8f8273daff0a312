"""Slices: write, audit, publish."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import intervals
from tidewatch.sources import slices
from tidewatch.sources.slices import Conflict, SliceTable, rule_audit

SCHEMA = "id int, ts timestamp_ntz, v int"


def D(*x):
    return dt.datetime(*x)


def days(spark, *n):
    return spark.createDataFrame([(D(2025, 1, k),) for k in n], "interval_start timestamp_ntz")


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, D(2025, 1, day, 5), v) for i, day, v in rows], SCHEMA)


def held(table):
    return sorted((r["slice"], r["id"]) for r in table.read().collect())


def told(table):
    return {r["slice"]: (r["status"], r["rows"], r["run_id"], r["error"]) for r in table.state().collect()}


def test_first_load_without_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], SCHEMA)
    table = intervals.load_slices(empty, "ts", days(spark), path)
    assert held(table) == [] and told(table) == {} and table.read().columns == ["id", "ts", "v", "slice"]
    table = intervals.load_slices(empty, "ts", days(spark, 1, 2), path, run_id="r1")
    assert held(table) == [] and told(table) == {"2025-01-01": ("complete", 0, "r1", None), "2025-01-02": ("complete", 0, "r1", None)}
    assert intervals.incremental_overwrite(rows_of(spark, (1, 1, 1)), "ts", days(spark, 1), path).select("slice").first()[0] == dt.date(2025, 1, 1)


def test_death_between_stage_and_publish(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    intervals.load_slices(rows_of(spark, (1, 1, 1), (2, 2, 1)), "ts", days(spark, 1, 2), path, run_id="r1")

    def dead(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(SliceTable, "publish", dead)
        intervals.load_slices(rows_of(spark, (9, 1, 1)), "ts", days(spark, 1), path, run_id="r2")
    table = SliceTable(spark, path)
    assert held(table) == [("2025-01-01", 1), ("2025-01-02", 2)]
    assert told(table)["2025-01-01"] == ("in_progress", 1, "r2", None) and told(table)["2025-01-02"][0] == "complete"
    again = intervals.load_slices(rows_of(spark, (9, 1, 1)), "ts", days(spark, 1), path, run_id="r3")
    assert held(again) == [("2025-01-01", 9), ("2025-01-02", 2)] and told(again)["2025-01-01"] == ("complete", 1, "r3", None)
    assert again.vacuum(1) > 0 and held(again) == [("2025-01-01", 9), ("2025-01-02", 2)]


def test_failing_audit_keeps_the_old_slice_and_stops(spark, tmp_path):
    path, audit = str(tmp_path / "t"), rule_audit({"v_set": F.col("v").isNull()}, ["id"])
    load = lambda rows, n, run, **more: intervals.load_slices(rows_of(spark, *rows), "ts", days(spark, *n), path, run_id=run, audit=audit, **more)
    load([(1, 1, 1), (2, 2, 1)], (1, 2), "r1")
    table = load([(1, 1, 5), (7, 1, 5), (2, 2, None), (2, 2, 4), (3, 3, 3), (4, 4, 4)], (1, 2, 3, 4), "r2")
    assert held(table) == [("2025-01-01", 1), ("2025-01-01", 7), ("2025-01-02", 2)]
    assert told(table) == {"2025-01-01": ("complete", 2, "r2", None), "2025-01-02": ("failed", 1, "r2", "unique_grain: 1; v_set: 1")}
    table = load([(2, 2, None), (3, 3, 3)], (2, 3), "r3", stop_at_failure=False)
    assert held(table)[-1] == ("2025-01-03", 3) and told(table)["2025-01-02"][0] == "failed"
    missing = intervals.missing_intervals(
        spark.createDataFrame([("a", D(2025, 1, k), D(2025, 1, k + 1), False) for k in (1, 2, 3)], "asset string, interval_start timestamp_ntz, interval_end timestamp_ntz, partial boolean"),
        table.state().select(F.lit("a").alias("asset"), F.col("slice").cast("timestamp_ntz").alias("interval_start"), "status"),
        spark.createDataFrame([("a", 0)], "asset string, lookback int"),
    )
    assert [r["interval_start"].day for r in missing.collect()] == [2]


def test_retries_by_error_class(spark, tmp_path, monkeypatch):
    real, waits, calls = SliceTable.stage, [], []
    monkeypatch.setattr(slices, "time", SimpleNamespace(sleep=waits.append))

    def flaky(errors):
        def stage(self, rows):
            calls.append(1)
            if len(calls) <= len(errors):
                raise RuntimeError(errors[len(calls) - 1])
            return real(self, rows)

        return stage

    path = str(tmp_path / "t")
    monkeypatch.setattr(SliceTable, "stage", flaky(["HTTP 503", "connection reset by peer"]))
    table = intervals.load_slices(rows_of(spark, (1, 1, 1)), "ts", days(spark, 1), path, run_id="r1")
    assert waits == [10.0, 20.0] and [(r["status"], r["attempts"]) for r in table.state().collect()] == [("complete", 3)]
    for errors, classes, n in ((["column not found"], (), 1), (["HTTP 503"], ("network",), 1), (["HTTP 503"] * 3, (), 3)):
        calls.clear()
        monkeypatch.setattr(SliceTable, "stage", flaky(errors))
        with pytest.raises(RuntimeError):
            intervals.load_slices(rows_of(spark, (5, 1, 1)), "ts", days(spark, 1), path, run_id="r2", retry_classes=classes)
        assert [(r["status"], r["attempts"], r["error"]) for r in table.state().collect()] == [("failed", n, errors[0])] and held(table) == [("2025-01-01", 1)]


def test_two_writers(spark, tmp_path):
    table, schema = SliceTable(spark, str(tmp_path / "t")), spark.createDataFrame([], SCHEMA).schema
    one, two = (spark.createDataFrame([(s,)], "slice string") for s in ("a", "b"))
    outcome = lambda s: s.select("slice", F.lit("complete").alias("status"), F.lit(None).cast("string").alias("live"), F.lit(0).cast("bigint").alias("rows"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"))
    assert table.begin(one, schema, "r1", D(2025, 1, 1)) == 1
    assert table.begin(two, schema, "r2", D(2025, 1, 1)) == 2
    assert not table._publish(2, {})  # taken
    assert table.publish(outcome(one), schema, "r1", D(2025, 1, 2)) == 3
    table.begin(two, schema, "r3", D(2025, 1, 3))
    with pytest.raises(Conflict):
        table.publish(outcome(two), schema, "r2", D(2025, 1, 3))
    assert {k: v[0] for k, v in told(table).items()} == {"a": "complete", "b": "in_progress"}
    assert table.state(2).count() == 2 and table.state(1).count() == 1
