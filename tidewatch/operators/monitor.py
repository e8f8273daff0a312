"""Metric snapshots, table profiles and drift against earlier periods.

A snapshot row: pipeline, table_name, column_name, metric_name, segment_value, value (double), captured_at.
All metrics of a table come from one aggregate; all history windows from one conditional aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expressions import moment, one_row, ratio

KEY = ["table_name", "column_name", "metric_name", "segment_value"]
#: Snapshots of different pipelines are never compared.
SERIES = ["pipeline", *KEY]


def _long(wide: DataFrame, table: str, cells: list[tuple[str, str, str]]) -> DataFrame:
    """Rows of (column, metric) from a one-row frame; cells: column_name, metric_name, wide column."""
    parts = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("metric_name"), F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias("value")) for c, m, w in cells))
    return wide.select(F.explode(parts).alias("r")).select(F.lit(table).alias("table_name"), "r.column_name", "r.metric_name", F.lit("").alias("segment_value"), "r.value")


def metric_row_count(df: DataFrame, table: str) -> DataFrame:
    return _long(one_row(df, F.count(F.lit(1)).alias("n")), table, [("", "row_count", "n")])


def metric_null_rate(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Null counts over row count, all columns in one scan; an empty table gives 0."""
    rates = [ratio(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias(f"r{i}") for i, c in enumerate(columns)]
    return _long(one_row(df, *rates), table, [(c, "null_rate", f"r{i}") for i, c in enumerate(columns)])


def _aggregate(column: str, name: str) -> Column:
    known = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "median": lambda c: F.percentile_approx(c, 0.5, 100000)}
    return known.get(name, F.count)(column)


def metric_aggregate(df: DataFrame, table: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """(column, aggregate) pairs; aggregates: sum, avg, count, min, max, median; unknown ones count. Null gives 0."""
    wide = one_row(df, *(_aggregate(c, a).alias(f"a{i}") for i, (c, a) in enumerate(wanted)))
    return _long(wide, table, [(c, a, f"a{i}") for i, (c, a) in enumerate(wanted)])


def metric_rate(num: DataFrame, den: DataFrame, table: str, name: str) -> DataFrame:
    """count(num) / count(den), 0 if den is empty; stored under the numerator's table."""
    both = one_row(num, F.count(F.lit(1)).alias("a")).crossJoin(one_row(den, F.count(F.lit(1)).alias("b")))
    return _long(both.select(ratio(F.col("a"), F.col("b")).alias("r")), table, [(name, "rate", "r")])


def metric_segment(df: DataFrame, table: str, column: str) -> DataFrame:
    """Row counts by value of a column; null is written <nil>."""
    value = F.concat(F.lit(f"{column}="), F.coalesce(F.col(column).cast("string"), F.lit("<nil>")))
    counts = df.groupBy(value.alias("segment_value")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counts.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit("count").alias("metric_name"), "segment_value", "value")


def metric_snapshot(frames: list[DataFrame], pipeline: str, captured_at) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select(F.lit(pipeline).alias("pipeline"), *KEY, "value", moment(captured_at).alias("captured_at"))


def windows(as_of) -> dict[str, tuple[Column, Column]]:
    """Half-open periods that a snapshot is compared with."""
    day = F.date_trunc("day", moment(as_of)).cast("timestamp_ntz")
    month = F.date_trunc("month", moment(as_of)).cast("timestamp_ntz")
    year = day - F.expr("interval 1 year")
    return {
        "day": (day - F.expr("interval 24 hour"), day),
        "week": (day - F.expr("interval 336 hour"), day - F.expr("interval 168 hour")),
        "month": (month - F.expr("interval 1 month"), month),
        "year": (year, year + F.expr("interval 24 hour")),
    }


def prior_average(history: DataFrame, as_of) -> DataFrame:
    """SERIES, window, prior_value, n: averages of every metric in every window, in one pass over the history."""
    aggregates, cells = [], []
    for name, (a, b) in windows(as_of).items():
        inside = (F.col("captured_at") >= a) & (F.col("captured_at") < b)
        aggregates += [F.avg(F.when(inside, F.col("value"))).alias(f"{name}_v"), F.count_if(inside).alias(f"{name}_n")]
        cells.append(F.struct(F.lit(name).alias("window"), F.col(f"{name}_v").alias("prior_value"), F.col(f"{name}_n").alias("n")))
    wide = history.groupBy(*SERIES).agg(*aggregates)
    return wide.select(*SERIES, F.explode(F.array(*cells)).alias("w")).select(*SERIES, "w.*").where("n > 0")


def drift_flags(current: DataFrame, history: DataFrame, as_of, config: DataFrame | None = None, warning: float = 0.10, error: float = 0.25) -> DataFrame:
    """Metrics that moved by ``warning`` or more against a window with two points at least.

    ``config``: table_name, column_name, metric_name, warning, error overrides (segments share them) and, if it has
    such a column, windows (array: those that the metric is compared in; null: all); it is as small as the monitoring configuration.
    """
    both = current.select(*SERIES, F.col("value").alias("current_value")).join(prior_average(history, as_of), SERIES)
    both = both.where((F.col("n") >= 2) & (F.col("prior_value") != 0))
    if config is not None:
        own = F.col("windows") if "windows" in config.columns else F.lit(None).cast("array<string>")
        both = both.join(config.select("table_name", "column_name", "metric_name", F.col("warning").alias("w"), F.col("error").alias("e"), own.alias("own")), KEY[:3], "left")
        both = both.where(F.col("own").isNull() | F.array_contains("own", F.col("window"))).drop("own")
    else:
        both = both.withColumn("w", F.lit(None).cast("double")).withColumn("e", F.lit(None).cast("double"))
    change = (F.col("current_value") - F.col("prior_value")) / F.col("prior_value")
    both = both.withColumn("pct_change", change)
    severity = F.when(F.abs("pct_change") >= F.coalesce("e", F.lit(error)), "error").when(F.abs("pct_change") >= F.coalesce("w", F.lit(warning)), "warning")
    return both.select(*SERIES, "window", "current_value", "prior_value", "pct_change", severity.alias("severity")).where("severity IS NOT NULL")


def flags_as_errors(flags: DataFrame, run_at) -> DataFrame:
    """Flags as rows of the current errors: pipeline, asset, check_name, severity, message, details_json, run_at."""
    names = F.concat_ws("_", F.lit("distribution"), "table_name", "column_name", "metric_name")
    message = F.format_string("%s %s.%s %s changed %.1f%% over %s", F.col("severity"), F.col("table_name"), F.col("column_name"), F.col("metric_name"), F.col("pct_change") * 100, F.col("window"))
    details = F.to_json(F.struct("window", "current_value", "prior_value", "pct_change"))
    return flags.select("pipeline", F.col("table_name").alias("asset"), names.alias("check_name"), "severity", message.alias("message"), details.alias("details_json"), moment(run_at).alias("run_at"))


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """table_name, column_name, data_type, ordinal, row_count, null_count of every column, in one scan."""
    wide = one_row(df, F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)))
    cells = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(i + 1).alias("ordinal"), F.col(f"c{i}").alias("null_count")) for i, f in enumerate(df.schema.fields)))
    return wide.select(F.col("n").alias("row_count"), F.explode(cells).alias("r")).select(F.lit(name).alias("table_name"), "r.column_name", "r.data_type", "r.ordinal", "row_count", "r.null_count")


def schema_catalog(tables: dict[str, DataFrame], run_seq: int) -> DataFrame:
    """run_seq, table_name, column_name, data_type, ordinal of all tables; no data is read."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(run_seq, t, f.name, f.dataType.simpleString(), i + 1) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "run_seq int, table_name string, column_name string, data_type string, ordinal int")
