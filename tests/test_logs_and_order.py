"""A compacted state log against the full one; Z-order."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.intervals import interval_state_upsert
from tidewatch.sources import batch
from tidewatch.sources.slices import SliceTable
from tidewatch.sources.statelog import LOG, StateLog

START = dt.datetime(2025, 1, 1)


def order(df):
    return sorted(map(tuple, df.select("asset", "interval_start", "status", "run_id", "started_at", "completed_at").collect()), key=str)


def test_compacted_log_equals_the_full_one(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"a{rng.integers(0, 5)}", START + dt.timedelta(days=int(rng.integers(0, 4))), str(rng.choice(["in_progress", "complete", "failed"])), f"r{i}", START + dt.timedelta(minutes=i), i) for i in range(160)]
    log = StateLog(spark, str(tmp_path / "log"), 3)
    for k in range(4):
        log.append(spark.createDataFrame(rows[40 * k : 40 * k + 40], LOG))
        full = spark.createDataFrame(rows[: 40 * k + 40], LOG)
        assert order(log.state()) == order(interval_state_upsert(full))
        if k == 1:  # a compaction that dies before it publishes, or before it deletes, changes nothing

            def dead(*_):
                raise KeyboardInterrupt

            for name in ("publish", "vacuum"):
                with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
                    m.setattr(SliceTable, name, dead)
                    log.compact(START)
                assert order(log.state()) == order(interval_state_upsert(full))
        if k in (1, 2):
            log.compact(START)
            assert log.upto() == 40 * k + 39 and order(log.state()) == order(interval_state_upsert(full))
    assert log.snapshot.read().count() <= 2 * 20 and log.tail(-1).count() == 40
    assert log.compact(START) == 159 and log.compact(START) == 159 and order(log.state()) == order(interval_state_upsert(full))


def test_zorder(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("a"), (F.col("id") * 104729 % 3989).alias("b"), F.when(F.col("id") % 50 != 0, F.col("id")).alias("z"))
    out = batch.materialize_zorder(rows, str(tmp_path / "z"), ["a", "b", "z"], 32)
    assert out.exceptAll(rows).isEmpty() and rows.exceptAll(out).isEmpty() and out.columns == rows.columns
    hit = [batch.files_hit(out, c, 1000, 1100) for c in ("a", "b")]
    assert all(h <= 20 for h in hit) and batch.files_hit(out, "a", -5, -1) == 0
    assert batch.materialize_zorder(rows.limit(0), str(tmp_path / "none"), ["a"], 4).isEmpty()
