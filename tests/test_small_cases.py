"""Small cases with known answers, and invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import checks, history, intervals, lineage, models, monitor, outcomes, runlog, suite
from tidewatch.sources import batch

D = dt.datetime


def specs(spark, start, end, unit, lookback=0, batch_size=0):
    return spark.createDataFrame([("a", start, end, unit, lookback, batch_size)], "asset string, start timestamp_ntz, end timestamp_ntz, unit string, lookback int, batch_size int")


def starts(df):
    return [r["interval_start"] for r in df.orderBy("interval_start").collect()]


@pytest.mark.parametrize("unit,start,end,n", [
    ("day", D(2025, 1, 10), D(2025, 1, 13), 3), ("hour", D(2025, 1, 10), D(2025, 1, 11), 24), ("week", D(2025, 1, 6), D(2025, 1, 27), 3),
    ("month", D(2025, 1, 1), D(2025, 4, 1), 3), ("day", D(2025, 1, 10), D(2025, 1, 10), 0), ("day", D(2025, 1, 11), D(2025, 1, 10), 0), ("fortnight", D(2025, 1, 1), D(2025, 1, 3), 2),
])
def test_calendar_sizes(spark, unit, start, end, n):
    rows = intervals.interval_calendar(specs(spark, start, end, unit)).orderBy("interval_start").collect()
    assert len(rows) == n
    for a, b in zip(rows, rows[1:]):
        assert a["interval_end"] == b["interval_start"]
    assert not any(r["partial"] for r in rows)


def test_calendar_clips_the_last_slice(spark):
    rows = intervals.interval_calendar(specs(spark, D(2025, 1, 10), D(2025, 1, 11, 6), "day")).orderBy("interval_start").collect()
    assert [(r["interval_end"], r["partial"]) for r in rows] == [(D(2025, 1, 11), False), (D(2025, 1, 11, 6), True)]


def test_month_overflow(spark):
    s = specs(spark, D(2025, 1, 31), D(2025, 5, 10), "month")
    assert starts(intervals.interval_calendar(s)) == [D(2025, 1, 31), D(2025, 2, 28), D(2025, 3, 31), D(2025, 4, 30)]
    assert starts(intervals.interval_calendar(s, "normalize")) == [D(2025, 1, 31), D(2025, 3, 3), D(2025, 4, 3), D(2025, 5, 3)]


def test_missing_lookback_and_batches(spark):
    s = specs(spark, D(2025, 1, 1), D(2025, 1, 6), "day", 1, 2)
    state = spark.createDataFrame([("a", D(2025, 1, i), st) for i, st in ((1, "complete"), (2, "failed"), (3, "in_progress"), (4, "complete"), (5, "complete"))], "asset string, interval_start timestamp_ntz, status string")
    missing = intervals.missing_intervals(intervals.interval_calendar(s), state, s)
    assert starts(missing) == [D(2025, 1, 2), D(2025, 1, 3), D(2025, 1, 5)]
    assert starts(intervals.batch_intervals(missing, s)) == [D(2025, 1, 2), D(2025, 1, 3)]
    assert len(starts(intervals.test_interval_limit(missing, s))) == 3
    done = state.where("status = 'complete'").select("asset", "interval_start")
    assert intervals.interval_calendar(s).select("asset", "interval_start").subtract(missing.select("asset", "interval_start").union(done)).isEmpty()


def test_orphans(spark):
    now = D(2025, 1, 2)
    state = spark.createDataFrame([("a", "in_progress", now - dt.timedelta(hours=3)), ("b", "in_progress", now - dt.timedelta(hours=1)), ("c", "complete", now - dt.timedelta(hours=9))], "asset string, status string, started_at timestamp_ntz")
    assert {r["asset"]: r["status"] for r in intervals.recover_orphans(state, now).collect()} == {"a": "pending", "b": "in_progress", "c": "complete"}


def history_of(spark, points, current):
    schema = "pipeline string, table_name string, column_name string, metric_name string, segment_value string, value double, captured_at timestamp_ntz"
    h = spark.createDataFrame([("p", "t", "c", "sum", seg, v, at) for seg, v, at in points], schema)
    c = spark.createDataFrame([("p", "t", "c", "sum", seg, v) for seg, v in current], schema.rsplit(",", 1)[0])
    return c, h


AT = D(2025, 3, 10, 8)
YESTERDAY = D(2025, 3, 9, 5)


@pytest.mark.parametrize("points,current,severity", [
    ([], 115.0, None), ([100.0], 200.0, None), ([100.0, 100.0], 115.0, "warning"), ([100.0, 100.0], 150.0, "error"),
    ([100.0, 100.0], 105.0, None), ([100.0, 100.0], 60.0, "error"), ([0.0, 0.0], 5.0, None),
])
def test_drift(spark, points, current, severity):
    c, h = history_of(spark, [("", v, YESTERDAY) for v in points], [("", current)])
    rows = monitor.drift_flags(c, h, AT).collect()
    assert [r["severity"] for r in rows] == ([severity] if severity else [])


def test_drift_segments_windows_and_overrides(spark):
    c, h = history_of(spark, [("x", 100.0, YESTERDAY), ("x", 100.0, YESTERDAY), ("y", 10.0, YESTERDAY), ("y", 10.0, YESTERDAY), ("x", 50.0, D(2025, 2, 25)), ("x", 50.0, D(2025, 2, 26))], [("x", 104.0), ("y", 20.0)])
    config = spark.createDataFrame([("t", "c", "sum", 0.03, 0.5)], "table_name string, column_name string, metric_name string, warning double, error double")
    got = {(r["segment_value"], r["window"]): r["severity"] for r in monitor.drift_flags(c, h, AT, config).collect()}
    assert got == {("x", "day"): "warning", ("y", "day"): "error", ("x", "week"): "error", ("x", "month"): "error"}


def test_drift_keeps_pipelines_apart_and_windows_of_a_metric(spark):
    c, h = history_of(spark, [("x", 10.0, YESTERDAY), ("x", 10.0, YESTERDAY), ("x", 5.0, D(2025, 2, 25)), ("x", 5.0, D(2025, 2, 26))], [("x", 10.2)])
    other = h.withColumns({"pipeline": F.lit("q"), "value": F.lit(1000.0)})
    prior = {(r["pipeline"], r["window"]): r["prior_value"] for r in monitor.prior_average(h.unionByName(other), AT).collect()}
    assert prior["p", "day"] == 10.0 and prior["q", "day"] == 1000.0
    config = spark.createDataFrame([("t", "c", "sum", 0.01, 0.5, ["day"])], "table_name string, column_name string, metric_name string, warning double, error double, windows array<string>")
    flags = monitor.drift_flags(c, h.unionByName(other), AT, config)
    assert [(r["pipeline"], r["window"], r["severity"]) for r in flags.collect()] == [("p", "day", "warning")]
    e = monitor.flags_as_errors(flags, AT).first()
    assert (e["check_name"], e["message"]) == ("distribution_t_c_sum", "warning t.c sum changed 2.0% over day") and '"window":"day"' in e["details_json"]


@pytest.mark.parametrize("text,want", [
    ("HTTP 429", "rate_limit"), ("Exceeded rate limits", "rate_limit"), ("RESOURCE_EXHAUSTED", "quota"), ("quotaExceeded 500", "quota"), ("UNAVAILABLE", "network"), ("dial tcp", "network"),
    ("EOF", "network"), ("typeof thereof", "none"), ("HTTP 504", "timeout"), ("Gateway Timeout", "timeout"), ("timeout", "none"), ("Bad Gateway", "server"), ("internalError", "server"),
    ("INTERNAL", "server"), ("internal error", "none"), ("", "none"), (None, "none"),
])
def test_error_classes(spark, text, want):
    df = spark.createDataFrame([(text,)], "e string")
    assert df.select(runlog.error_class(F.col("e")).alias("c")).first()["c"] == want


def test_rollup_of_a_run(spark):
    rows = [("run_started", "", "{}"), ("asset_succeeded", "a", '{"metadata":{"estimated_cost_usd":"0.5"}}'), ("asset_failed", "b", '{"error_message":"broken"}'), ("asset_failed", "c", "{}"), ("run_failed", "", '{"duration_seconds":12.4}')]
    ev = spark.createDataFrame([(i, 7, "p", a, t, 0, d) for i, (t, a, d) in enumerate(rows)], "event_id int, run_id int, pipeline string, asset string, event_type string, duration_ms bigint, details string")
    r = runlog.run_rollup(ev).first()
    assert (r["status"], r["failed_assets"], r["errors"], r["total_cost"]) == ("completed_with_failures", "b,c", "b: broken", 0.5)
    assert r["summary"] == "p: 1 succeeded, 2 failed, 0 skipped (12s)"


def test_check_errors_need_three_parts(spark):
    rows = [("check:a", "failed", "x"), ("check:a:b:c", "failed", ""), ("check:a:d", "skipped", "why"), ("a", "failed", "x"), ("check:a:e", "success", "")]
    got = outcomes.check_errors(spark.createDataFrame(rows, "node string, status string, message string"), "p", AT).collect()
    assert sorted((r["asset"], r["check_name"], r["severity"], r["message"], r["details_json"]) for r in got) == [
        ("a", "b:c", "error", "check:a:b:c failed", '{"status":"failed"}'), ("a", "d", "warning", "why", '{"error":"why","status":"skipped"}')]


@pytest.mark.parametrize("unit", ["hour", "day", "week", "month"])
def test_emptied_slices_go(spark, tmp_path, unit):
    rows = spark.createDataFrame([(i, D(2025, 1, 6, 3) + dt.timedelta(days=k)) for i, k in enumerate((0, 0, 1, 8, 31))], "id int, ts timestamp_ntz")
    slots = intervals.assign_interval(rows, "ts", unit, D(2025, 1, 6)).select("interval_start").distinct()
    path = str(tmp_path / "t")
    first = intervals.incremental_overwrite(rows, "ts", slots, path, unit)
    assert sorted(r["id"] for r in first.collect()) == [0, 1, 2, 3, 4] and first.select("slice").distinct().count() == slots.count()
    last = slots.orderBy(F.desc("interval_start")).limit(1)
    assert sorted(r["id"] for r in intervals.incremental_overwrite(rows.where("id <> 4"), "ts", last, path, unit).collect()) == [0, 1, 2, 3]
    assert sorted(r["id"] for r in intervals.incremental_overwrite(rows.limit(0), "ts", slots.limit(0), path, unit).collect()) == [0, 1, 2, 3]


def test_completeness_follows_not_in(spark):
    def keys(*values):
        return spark.createDataFrame([(v,) for v in values], "k int")

    assert checks.completeness(keys(1, 2, None), "k", keys(1, 2, 3), "k").collect() == []  # a null on the right hides what is missing
    row = checks.completeness(keys(1, 2, 9), "k", keys(1, 2, 3, None), "k").first()
    assert (row["expected_count"], row["missing_count"], row["unexpected_count"]) == (4, 1, 0)
    empty = checks.completeness(spark.createDataFrame([], "k int"), "k", keys(1, None), "k").first()
    assert empty["missing_count"] == 2  # nothing on the right: nulls count, too


def test_checks_on_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, v string, created timestamp_ntz, updated timestamp_ntz")
    assert checks.not_empty(empty).count() == 1
    assert checks.row_count_nonzero(empty).count() == 1
    assert checks.unique_grain(empty, ["id"]).count() == 0
    assert checks.row_retention(empty, empty).count() == 0
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (1, None), (1, "x\n")], "id int, v string")
    assert [(r["id"], r["cnt"]) for r in checks.unique_grain(rows, ["id"]).collect()] == [(None, 2), (1, 2)]
    assert checks.not_null_grain(rows, ["id"]).count() == 2
    assert checks.contract_accepted_values(rows, "v", ["a", "b"], ["id"]).count() == 2
    phones = spark.createDataFrame([(1, "1-555-555-5555"), (2, "1-555-555-5555\n"), (3, None)], "id int, p string")
    assert [r["id"] for r in checks.standard_phone(phones, "p", ["id"]).collect()] == [2]
    assert checks.unique_grain(spark.createDataFrame([(i // 2,) for i in range(100)], "id int"), ["id"], 10).count() == 10


def test_suite_equals_single_checks(spark):
    df = spark.createDataFrame([(1, D(2025, 1, 1), D(2024, 12, 1), "F"), (1, D(2026, 1, 1), None, "Z"), (None, D(2025, 1, 1), D(2025, 1, 2), None)], "id int, c timestamp_ntz, u timestamp_ntz, s string")
    spec = suite.TableSpec("t", "staging", ("id",), "c", "u", ("s",), {"s": ("F",)})
    own = suite.check_suite(spec, df, "2025-06-01 00:00:00")
    summary = {r["check_name"]: r["violations"] for r in suite.check_summary(df, own).collect()}
    assert summary == {c.name: c.rows.count() for c in own}
    assert summary == {"unique_grain": 1, "not_null_grain": 1, "not_empty": 0, "no_future_timestamps": 1, "updated_at_gte_created_at": 1, "not_null:s": 1, "accepted_values:s": 2}
    assert suite.check_suite(suite.TableSpec("t", "staging", ("id",), default_checks=False), df, "2025-06-01 00:00:00") == []


def test_suite_options(spark):
    df, up = spark.range(6), spark.range(4)
    spec = suite.TableSpec("t", "intermediate", ("id",), blocking=True, fan_out=False, min_retention=2.0)
    own = suite.check_suite(spec, df, "2025-06-01 00:00:00", upstream=up)
    assert [(c.name, c.blocking, c.rows.count()) for c in own] == [("unique_grain", True, 0), ("row_retention", True, 1)]
    own = suite.check_suite(suite.TableSpec("t", "intermediate", ("id",)), df, "2025-06-01 00:00:00", upstream=up)
    assert [(c.name, c.blocking, c.rows.count()) for c in own] == [("unique_grain", False, 0), ("fan_out", False, 1), ("row_retention", False, 0)]
    whole = suite.Completeness(up, "id", additions=((spark.range(4, 6), "id"),))
    own = suite.check_suite(suite.TableSpec("t", "entity", ("id",), completeness=(whole, suite.Completeness(up, "id"))), df, "2025-06-01 00:00:00")
    assert [(c.name, c.rows.count()) for c in own] == [("unique_grain", 0), ("completeness", 0), ("completeness:1", 1)]


def test_source_suite(spark):
    df = spark.createDataFrame([(1, 0), (1, 60_000_000), (None, None)], "id int, m bigint")
    full = suite.SourceSpec("s", {"t": df}, "id", 5, "m", ("id", "ID", "x"))
    got = {c.name: c.rows.count() for c in suite.source_suite(full, "1970-01-01 00:10:00")}
    assert got == {"source:s:t:exists_not_empty": 0, "source:s:freshness": 1, "source:s:pk_not_null": 1, "source:s:pk_unique": 1, "source:s:expected_columns": 2}
    two = suite.SourceSpec("s", {"t": df, "u": None}, "id", None, None, ("x",))
    assert {c.name: c.rows.count() for c in suite.source_suite(two, "1970-01-01 00:10:00")} == {"source:s:t:exists_not_empty": 0, "source:s:u:exists_not_empty": 1}
    assert [c.rows.count() for c in suite.source_suite(suite.SourceSpec("s", {"t": None}, "id"), "1970-01-01 00:10:00")] == [1]


def test_prune_intervals(spark):
    rows = [("complete", D(2025, 1, 1)), ("complete", D(2025, 5, 1)), ("failed", D(2025, 1, 1)), ("complete", None), (None, D(2025, 1, 1))]
    state = spark.createDataFrame(rows, "status string, completed_at timestamp_ntz")
    assert [tuple(r) for r in runlog.prune_intervals(state, "2025-06-01 00:00:00").collect()] == rows[1:]


def test_fused_suite_scans_once(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") % 7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spec = suite.TableSpec("t", "", (), not_null=("id", "v"), accepted={"v": (1, 2)})
    plan = suite.check_summary(df, suite.check_suite(spec, df, "2025-01-01 00:00:00"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<id:bigint,v:bigint>" in plan


def test_signals_and_blocking(spark):
    results = spark.createDataFrame([(n, "failed") for n in "iwec"] + [("ok", "passed")], "check_name string, status string")
    own = spark.createDataFrame([("i", "info", True), ("w", "warning", True), ("e", "error", False), ("c", "critical", False), ("ok", "critical", True)], "check_name string, severity string, blocking boolean")
    got = {r["check_name"]: (r["signal"], r["blocks"], r["halts_run"]) for r in outcomes.check_signal(results, own).collect()}
    assert got == {"i": ("success", False, False), "w": ("success", False, False), "e": ("failed", False, False), "c": ("failed", True, True), "ok": ("passed", False, False)}


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "c"), ("d", "b")], "parent string, child string")
    seeds = spark.createDataFrame([("b",)], "node string")
    assert {r["node"] for r in lineage.descendants(edges, seeds).collect()} == {"c", "d"}
    assert {r["node"] for r in lineage.ancestors(edges, seeds, include_seeds=True).collect()} == {"a", "b", "d", "c", "x"}
    assert {r["node"] for r in lineage.find_cycles(edges).collect()} == {"b", "c", "d"}
    assert {r["node"]: r["level"] for r in lineage.topo_levels(edges).collect()} == {"a": 0, "x": 0}
    acyclic = edges.where("parent <> 'd'")
    assert lineage.find_cycles(acyclic).isEmpty()
    assert {r["node"]: r["level"] for r in lineage.topo_levels(acyclic).collect()} == {"a": 0, "x": 0, "b": 1, "c": 2, "d": 3}
    assert lineage.topo_levels(edges.limit(0)).isEmpty() and lineage.descendants(edges.limit(0), seeds).isEmpty()


def test_run_cost(spark):
    ok = "asset_succeeded"
    details = ['{"metadata":{"total_bytes_processed":"1073741824","estimated_cost_usd":"0.005","cache_hit":"true"}}', '{"metadata":{"total_bytes_processed":"536870912","estimated_cost_usd":"0.0025","cache_hit":"false"}}', "{}", '{"metadata":{"total_bytes_processed":"many"}}']
    ev = spark.createDataFrame([(1, ok, x) for x in details], "run_id int, event_type string, details string")
    row = runlog.run_cost(ev).first()
    assert (row["total_bytes"], row["query_nodes"], row["cached_nodes"], row["hit_rate"]) == (1610612736, 2, 1, 0.5)
    assert row["total_cost"] == pytest.approx(0.0075)


def test_model_versions(spark):
    log = spark.createDataFrame([("m", "h1", D(2025, 1, 1), 1), ("m", "h1", D(2025, 1, 2), 2), ("m", "h2", D(2025, 1, 3), 3), ("m", "h1", D(2025, 1, 4), 4)], "asset string, source_hash string, activated_at timestamp_ntz, seq int")
    rows = history.model_versions(log).orderBy("version").collect()
    assert [(r["version"], r["source_hash"], r["replaced_at"]) for r in rows] == [(1, "h1", D(2025, 1, 3)), (2, "h2", D(2025, 1, 4)), (3, "h1", None)]


def test_unknown_reference(spark):
    with pytest.raises(ValueError, match="unknown"):
        models.run_model(spark, "SELECT * FROM {nowhere}", {})


def test_merge_and_overwrite(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    a.write.json(str(tmp_path / "one"))
    spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string").write.json(str(tmp_path / "two"))
    for name in ("one", "two", "two"):
        out = batch.ingest_files(spark, str(tmp_path / name), "*.json", "json", "k int, v string", "merge", str(tmp_path / "t"), ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, "x"), (2, "z"), (3, "w")]
    with pytest.raises(ValueError, match="method"):
        batch.ingest_files(spark, str(tmp_path / "one"), "*.json", "json", "k int, v string", "upsert", str(tmp_path / "t"))


def test_merge_repeated_and_null_keys(spark, tmp_path):
    spark.createDataFrame([(1, "x", 1), (None, "n", 1)], "k int, v string, at int").write.json(str(tmp_path / "one"))
    spark.createDataFrame([(1, "a", 3), (1, "z", 2), (None, "m", 2), (2, "b", 1), (2, "c", 1)], "k int, v string, at int").write.json(str(tmp_path / "two"))
    for name in ("one", "two", "two"):
        out = batch.ingest_files(spark, str(tmp_path / name), "*.json", "json", "k int, v string, at int", "merge", str(tmp_path / "t"), ["k"], "at")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", 3), (None, "m", 2), (2, "c", 1)], key=str)


def test_clean_events_counts(spark):
    df, seen = models.clean_events(spark.createDataFrame([(1, D(2025, 1, 1)), (2, None)], "id int, ts timestamp_ntz"), "ts", "seen")
    assert df.count() == 1 and seen.get == {"rows": 2, "dropped": 1}
