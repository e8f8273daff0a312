"""Interval calendars and incremental loads.

Intervals are half-open slices [start, end) of an asset's time axis. ``specs``: asset, start, end (timestamps), unit
(hour, day, week, month; anything else is day), lookback, batch_size.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expressions import moment
from tidewatch.operators.runlog import is_retryable
from tidewatch.sources.slices import SliceTable

UNITS = ("hour", "day", "week", "month")


def interval_calendar(specs: DataFrame, month_overflow: str = "clamp") -> DataFrame:
    """asset, interval_start, interval_end, partial: all slices; the last one is clipped, none if end <= start.

    Months step from the start date. ``clamp``: the last day of short months; ``normalize``: the first step
    flows over into the next month, and later steps go on from there.
    """
    unit = F.when(F.col("unit").isin(list(UNITS)), F.col("unit")).otherwise("day")
    rows = specs.where(F.col("end") > F.col("start")).withColumn("unit", unit)
    fixed = rows.where("unit <> 'month'")
    step = F.when(F.col("unit") == "hour", F.expr("interval 1 hour")).when(F.col("unit") == "week", F.expr("interval 168 hour")).otherwise(F.expr("interval 24 hour"))
    fixed = fixed.select("asset", "end", F.explode(F.sequence("start", "end", step)).alias("interval_start"))
    months = rows.where("unit = 'month'")
    n = F.ceil(F.months_between("end", "start")).cast("int") + 1
    months = months.select("asset", "start", "end", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    day = F.to_date("start")
    time = F.col("start") - F.date_trunc("day", "start")
    clamped = F.add_months(day, F.col("i")).cast("timestamp_ntz") + time
    if month_overflow == "normalize":
        first = F.add_months(F.trunc(day, "month"), F.lit(1))
        over = F.date_add(first, F.dayofmonth(day) - 1)  # the day number counted on, past the month's end
        clamped = F.when(F.col("i") == 0, day.cast("timestamp_ntz")).otherwise(F.add_months(over, F.col("i") - 1).cast("timestamp_ntz")) + time
    months = months.select("asset", "end", clamped.alias("interval_start"))
    starts = fixed.unionByName(months).where(F.col("interval_start") < F.col("end")).dropDuplicates(["asset", "interval_start"])
    following = F.lead("interval_start").over(Window.partitionBy("asset").orderBy("interval_start"))
    full_end = starts.join(specs.select("asset", "unit").distinct(), "asset").withColumn("next", following)
    natural = F.when(F.col("unit") == "hour", F.col("interval_start") + F.expr("interval 1 hour")).when(F.col("unit") == "week", F.col("interval_start") + F.expr("interval 168 hour")).when(F.col("unit") == "month", F.col("interval_start") + F.expr("interval 1 month")).otherwise(F.col("interval_start") + F.expr("interval 24 hour"))
    return full_end.select("asset", "interval_start", F.least(F.coalesce("next", "end"), F.col("end")).alias("interval_end"), (F.col("next").isNull() & (natural > F.col("end"))).alias("partial"))


def missing_intervals(calendar: DataFrame, state: DataFrame, specs: DataFrame, partial_is_done: bool = True) -> DataFrame:
    """Calendar slots without a complete state (asset, interval_start, status), and always the last ``lookback`` ones."""
    done = state.where("status = 'complete'").select("asset", "interval_start").distinct().withColumn("done", F.lit(True))
    slots = calendar.join(specs.select("asset", "lookback"), "asset").join(done, ["asset", "interval_start"], "left")
    newest = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("interval_start")))
    fresh = F.col("done").isNull() if partial_is_done else F.col("done").isNull() | F.col("partial")
    return slots.withColumn("k", newest).where(fresh | (F.col("k") <= F.col("lookback"))).select("asset", "interval_start", "interval_end")


def batch_intervals(missing: DataFrame, specs: DataFrame) -> DataFrame:
    """The first ``batch_size`` slots of each asset; 0 or less: all."""
    k = F.row_number().over(Window.partitionBy("asset").orderBy("interval_start"))
    rows = missing.join(specs.select("asset", "batch_size"), "asset").withColumn("k", k)
    return rows.where((F.col("batch_size") <= 0) | (F.col("k") <= F.col("batch_size"))).select("asset", "interval_start", "interval_end")


def test_interval_limit(missing: DataFrame, specs: DataFrame) -> DataFrame:
    """The last max(3, lookback + 1) slots of each asset, for test runs."""
    k = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("interval_start")))
    rows = missing.join(specs.select("asset", "lookback"), "asset").withColumn("k", k)
    return rows.where(F.col("k") <= F.greatest(F.lit(3), F.col("lookback") + 1)).select("asset", "interval_start", "interval_end")


test_interval_limit.__test__ = False  # not a test


def interval_plan(calendar: DataFrame, state: DataFrame, specs: DataFrame, full_refresh: bool = False) -> DataFrame:
    """asset, pending: how many slots a run would process."""
    rows = calendar if full_refresh else missing_intervals(calendar, state, specs)
    counts = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("pending"))
    return specs.select("asset").distinct().join(counts, "asset", "left").select("asset", F.coalesce("pending", F.lit(0).cast("bigint")).alias("pending"))


def interval_slice(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows of [start, end)."""
    return df.where((F.col(column) >= moment(start)) & (F.col(column) < moment(end)))


def assign_interval(df: DataFrame, column: str, unit: str, start=None) -> DataFrame:
    """Adds interval_start; weeks are counted from ``start``."""
    if unit == "week":
        origin = moment(start)
        days = F.datediff(column, origin)
        value = F.date_trunc("day", origin) + F.make_dt_interval(days=F.floor(days / 7).cast("int") * 7)
    else:
        value = F.date_trunc(unit if unit in UNITS else "day", F.col(column))
    return df.withColumn("interval_start", value.cast("timestamp_ntz"))


def slice_name(c: str | Column, unit: str = "day") -> Column:
    """The name of the slice that begins at ``c``: a date, for hours with the hour."""
    return F.date_format(c, "yyyy-MM-dd-HH" if unit == "hour" else "yyyy-MM-dd")


def load_slices(df: DataFrame, column: str, pending: DataFrame, path: str, unit: str = "day", run_id: str = "", at=None, **options) -> SliceTable:
    """Loads the pending slices (interval_start) of the table at ``path`` from ``df``: staged, audited, then published with their state.

    ``unit``: hour, day, week (counted from the first pending start) or month. The scan is limited to the time that the pending slices span. Other slices
    stay as they are; a pending slice without rows is emptied; nothing pending changes nothing. ``options`` as for ``SliceTable.load``; errors are retried by their class (``retry_classes``; none given: all classes).
    """
    spark, table = df.sparkSession, SliceTable(df.sparkSession, path)
    classes = options.pop("retry_classes", ())
    options.setdefault("retryable", lambda error: is_retryable(error, classes))
    at = F.localtimestamp() if at is None else at
    length = {"hour": "1 hour", "week": "168 hour", "month": "1 month"}.get(unit, "24 hour")
    span = pending.agg(F.min("interval_start").alias("a"), F.max("interval_start").alias("b")).select("a", (F.col("b") + F.expr(f"interval {length}")).alias("b")).first()
    if span["a"] is None:
        if not table.version():
            table.begin(spark.createDataFrame([], "slice string"), df.schema, run_id, at)
        return table
    kind = df.schema[column].dataType
    rows = df.where((F.col(column) >= F.lit(span["a"]).cast(kind)) & (F.col(column) < F.lit(span["b"]).cast("timestamp_ntz")))
    rows = assign_interval(rows, column, unit, span["a"]).withColumn("slice", slice_name("interval_start", unit)).drop("interval_start")
    table.load(rows, pending.select(slice_name("interval_start", unit).alias("slice")), run_id or uuid.uuid4().hex, at, **options)
    return table


def incremental_overwrite(df: DataFrame, column: str, pending: DataFrame, path: str, unit: str = "day", **options) -> DataFrame:
    """``load_slices``, and the table's live rows; ``slice`` is the interval's start, a date or for hours a text. Running it again changes nothing."""
    rows = load_slices(df, column, pending, path, unit, **options).read()
    return rows if unit == "hour" else rows.withColumn("slice", F.to_date("slice"))


def interval_state_upsert(log: DataFrame) -> DataFrame:
    """The latest state of each (asset, interval_start) from an append-only log ordered by ``seq``.

    in_progress opens a row and clears completed_at; other statuses only count after one. Date-only keys
    (``interval_start`` as text) are taken as midnight.
    """
    key = F.col("interval_start")
    if dict(log.dtypes)["interval_start"] == "string":
        key = F.when(key.contains("T"), F.regexp_replace(key, "Z$", "")).otherwise(F.concat(key, F.lit("T00:00:00"))).cast("timestamp_ntz")
    rows = log.withColumn("interval_start", key)
    by = ["asset", "interval_start"]
    opened = F.max(F.when(F.col("status") == "in_progress", F.col("seq")))
    first = F.min(F.when(F.col("status") == "in_progress", F.col("seq")))
    firsts = rows.groupBy(*by).agg(first.alias("first"), opened.alias("last_open"))
    live = rows.join(firsts.where("first IS NOT NULL"), by).where(F.col("seq") >= F.col("first"))
    latest = live.groupBy(*by).agg(F.max_by(F.struct("status", "run_id", "at", "seq"), "seq").alias("m"), F.max_by("at", F.when(F.col("seq") == F.col("last_open"), F.lit(1))).alias("started_at"))
    return latest.select(*by, "m.status", "m.run_id", "started_at", F.when(F.col("m.status") != "in_progress", F.col("m.at")).alias("completed_at"))


def invalidate_intervals(state: DataFrame, assets: DataFrame) -> DataFrame:
    """The state without the rows of the given assets."""
    return state.join(assets.select("asset").distinct(), "asset", "left_anti")


def recover_orphans(state: DataFrame, as_of, hours: float = 2, to: str = "pending") -> DataFrame:
    """The state with rows that are in progress for longer than ``hours`` set to ``to``."""
    old = (F.col("status") == "in_progress") & (F.col("started_at") < moment(as_of) - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(hours * 60) % 60)))
    return state.withColumn("status", F.when(old, to).otherwise(F.col("status")))


def _hours(window: str) -> int:
    m = re.fullmatch(r"(\d+)([hd])", window)
    if not m:
        raise ValueError(f"a window is <n>h or <n>d, not {window!r}")
    return int(m[1]) * (24 if m[2] == "d" else 1)


def window_hours(c: Column) -> Column:
    """Hours of windows such as 6h or 2d."""
    n = F.regexp_extract(c, r"^(\d+)[hd]$", 1).try_cast("int") if hasattr(Column, "try_cast") else F.regexp_extract(c, r"^(\d+)[hd]$", 1).cast("int")
    return F.when(c.endswith("d"), n * 24).otherwise(n)


def freshness_status(specs: DataFrame, state: DataFrame, as_of) -> DataFrame:
    """asset, last_completed, age_hours, fresh, message; specs: asset, window (``6h``, ``2d``)."""
    last = state.where("status = 'complete'").groupBy("asset").agg(F.max("completed_at").alias("last_completed"))
    age = F.round((F.unix_micros(moment(as_of).cast("timestamp")) - F.unix_micros(F.col("last_completed").cast("timestamp"))) / F.lit(3.6e9), 3)
    rows = specs.join(last, "asset", "left").withColumn("age_hours", age)
    fresh = F.coalesce(F.col("age_hours") <= window_hours(F.col("window")), F.lit(False))
    message = F.when(F.col("last_completed").isNull(), "no completed interval").when(fresh, "fresh").otherwise("stale")
    return rows.select("asset", "last_completed", "age_hours", fresh.alias("fresh"), message.alias("message"))
