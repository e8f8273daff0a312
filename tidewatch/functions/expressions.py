"""Column helpers that several operators share."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def moment(value: str | dt.datetime | Column) -> Column:
    """A timestamp without zone; all comparisons of this library are in UTC wall time."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def cast_to_currency(c: Column | str) -> Column:
    """Rounded to cents, as decimal(38,9)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 2).cast("decimal(38,9)")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sql_function(spark: SparkSession, name: str, args: dict[str, str], returns: str, body: str) -> None:
    """Registers a SQL expression with positional arguments $1..$n (or argument names) as a temporary function.

    Catalyst inlines it; no Python runs per row.
    """
    for i, a in reversed(list(enumerate(args, 1))):
        body = body.replace(f"${i}", a)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} {t}' for a, t in args.items())}) RETURNS {returns} RETURN {body}")


def one_row(df: DataFrame, *aggregates: Column) -> DataFrame:
    """A one-row summary; what crossJoin may be used on."""
    return df.agg(*aggregates)
