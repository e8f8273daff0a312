"""Transformations of the user-level SQL surface."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import cast_to_currency, moment


def run_model(spark: SparkSession, sql: str, tables: dict[str, DataFrame], params: dict | None = None) -> DataFrame:
    """A SELECT over logical names written as {name}, with named parameters written as :name."""
    unknown = {r for r in re.findall(r"\{(\w+)\}", sql) if r not in tables}
    if unknown:
        raise ValueError(f"unknown references: {sorted(unknown)}")
    return spark.sql(sql, args=params or {}, **tables)


def stg_orders(orders: DataFrame) -> DataFrame:
    """Orders (order_id, customer_id, order_total, created_at, status) that weren't cancelled."""
    return orders.where("status <> 'cancelled'").select("order_id", "customer_id", cast_to_currency(F.col("order_total")).alias("order_total"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), "status")


def int_order_summary(stg: DataFrame) -> DataFrame:
    return stg.groupBy("customer_id").agg(F.count(F.lit(1)).alias("total_orders"), F.sum("order_total").alias("lifetime_spend"), F.min("created_at").alias("first_order_at"), F.max("created_at").alias("last_order_at"))


def entity_customers(summary: DataFrame, as_of) -> DataFrame:
    tier = F.when(F.col("total_orders") >= 10, "high").when(F.col("total_orders") >= 3, "medium").otherwise("low")
    return summary.select("*", F.datediff(moment(as_of), "last_order_at").alias("days_since_last_order"), tier.alias("order_frequency_tier"))


def recent_orders(orders: DataFrame, as_of, days: int = 30) -> DataFrame:
    return orders.where(F.col("created_at") >= moment(as_of) - F.make_dt_interval(days=F.lit(days)))


def clean_events(events: DataFrame, ts: str, name: str = "clean_events") -> tuple[DataFrame, Observation]:
    """Rows with a timestamp; the observation counts rows and dropped rows in the same pass."""
    seen = Observation(name)
    return events.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ts).isNull()).alias("dropped")).where(F.col(ts).isNotNull()), seen


def rename_json_field(spark: SparkSession, path: str, old: str, new: str, out: str) -> DataFrame:
    """JSON lines with one field renamed, written and read back."""
    spark.read.json(path).withColumnRenamed(old, new).write.mode("overwrite").json(out)
    return spark.read.json(out)


def test_window(df: DataFrame, column: str, window: str | None, as_of) -> DataFrame:
    """Rows of the last <n>d, <n>w or <n>m days up to today (both ends in); None: 1900-01-01 to 2099-12-31."""
    c = F.to_date(column)
    if window is None:
        return df.where((c >= F.lit("1900-01-01").cast("date")) & (c <= F.lit("2099-12-31").cast("date")))
    m = re.fullmatch(r"(\d+)([dwm])", window)
    if not m:
        raise ValueError(f"a window is <n>d, <n>w or <n>m, not {window!r}")
    today, n = F.to_date(moment(as_of)), int(m[1])
    first = F.add_months(today, -n) if m[2] == "m" else F.date_sub(today, n * (7 if m[2] == "w" else 1))
    return df.where((c >= first) & (c <= today))


test_window.__test__ = False  # not a test
