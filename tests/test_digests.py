"""Digest trees and key bitmaps against plain comparison."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import checks, digests
from tidewatch.sources.slices import SliceTable

AT = dt.datetime(2025, 1, 1)


def shuffled(spark):
    """Bytes that have been written for shuffles so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def pairs(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_key_differences(spark):
    n = 200_000
    a = spark.range(n).select(F.col("id").alias("pk"))
    b = a.where("pk NOT IN (5, 77777) AND pk <> 199999").union(spark.range(n, n + 2).toDF("pk"))
    missing, unexpected = digests.key_differences(a, b)
    assert pairs(missing) == [(5,), (77777,), (199999,)] and pairs(unexpected) == [(n,), (n + 1,)]
    same = digests.key_differences(a, a)
    assert [x.count() for x in same] == [0, 0]
    # everything differs, or one side is empty
    far = [x.count() for x in digests.key_differences(a, spark.range(n, 2 * n).toDF("pk"))]
    assert far == [n, n] and [x.count() for x in digests.key_differences(a, a.limit(0))] == [n, 0]
    # repeated and null keys, and text keys
    c = a.union(a.where("pk < 10")).union(spark.sql("SELECT CAST(NULL AS BIGINT) AS pk")).select(F.col("pk").cast("string").alias("pk"))
    d = a.where("pk <> 3").select(F.col("pk").cast("string").alias("pk"))
    assert [pairs(x) for x in digests.key_differences(c, d)] == [[("3",)], []]


def test_shuffle_follows_the_difference(spark):
    n = 400_000
    a = spark.range(n).select(F.col("id").alias("pk")).repartition(8)
    a.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/digest-keys")
    a = spark.read.parquet(path)
    moved = []
    for few in (1, 40, n):
        b, before = a.where(F.col("pk") % (n // few) != 0) if few < n else a.where("pk < 0"), shuffled(spark)
        assert sum(x.count() for x in digests.key_differences(a, b)) == (few if few < n else n)
        moved.append(shuffled(spark) - before)
    before = shuffled(spark)
    a.distinct().join(a.where("pk <> 7").distinct(), "pk", "left_anti").count()
    plain = shuffled(spark) - before
    assert moved[0] < plain / 4 and moved[0] < moved[1] < moved[2], (moved, plain)


def test_digests_combine(spark):
    keys = spark.range(5000).toDF("pk")
    two, one = digests.level_digests(keys, 2), digests.level_digests(keys, 1)
    columns = ("node", "n", "mix", "total")
    assert pairs(digests.combined(two).select(*columns)) == pairs(one.select(*columns))


def test_completeness_equals_the_plain_check(spark):
    day = lambda d: F.lit(dt.datetime(2025, 1, d)).cast("timestamp_ntz")
    src = spark.range(1000).select("id", day(1).alias("at")).union(spark.createDataFrame([(None, AT), (5000, dt.datetime(2026, 1, 1))], "id bigint, at timestamp"))
    stg = spark.range(10, 1003).select("id", day(1).alias("at"))
    assert pairs(digests.source_completeness(src, "id", stg, "id", "at", "2025-06-01 00:00:00")) == pairs(checks.source_completeness(src, "id", stg, "id", "at", "2025-06-01 00:00:00", None))
    own, want = spark.range(5, 1010).toDF("k"), spark.range(1000).toDF("k")
    assert pairs(digests.completeness(own, "k", want, "k")) == pairs(checks.completeness(own, "k", want, "k"))
    assert digests.completeness(want, "k", want, "k").isEmpty()


def test_bitmaps_over_slices(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(k, s) for s, ks in {"a": [1, 2, -3, 0, 70_000, None], "b": [2, 3, 32_768, 32_769], "c": [9, 9, 70_000, None], "d": [10**12]}.items() for k in ks], "k bigint, slice string")
    rows.write.partitionBy("slice").parquet(path := str(tmp_path / "rows"))
    rows = spark.read.parquet(path)
    names = lambda *s: spark.createDataFrame([(x,) for x in s], "slice string")
    index = SliceTable(spark, str(tmp_path / "bits"))
    digests.update_bitmaps(index, rows, names("a"), "k", "r1", AT)
    assert digests.repeated_keys(index, rows.where("slice = 'a'"), "k").isEmpty()
    digests.update_bitmaps(index, rows, names("b", "c", "d"), "k", "r2", AT)
    want = checks.unique_grain(rows, ["k"], None)
    assert pairs(digests.repeated_keys(index, rows, "k")) == pairs(want) == [(None, 2), (2, 2), (9, 2), (70_000, 2)]
    assert pairs(digests.distinct_keys(index)) == [(13, 10)]
    # a slice that has changed is the only one that an update reads
    seen = []
    with monkeypatch.context() as m:
        m.setattr(SliceTable, "stage", lambda self, df, real=SliceTable.stage: seen.append(df._jdf.queryExecution().toString()) or real(self, df))
        digests.update_bitmaps(index, rows, names("b"), "k", "r2", AT)
    assert "PartitionFilters: [isnotnull(slice" in seen[0] and "= b)]" in seen[0]
    digests.update_bitmaps(index, rows.where("k IS NULL OR k <> 9"), names("c"), "k", "r3", AT)
    assert pairs(digests.repeated_keys(index, rows.where("k IS NULL OR k <> 9"), "k")) == [(None, 2), (2, 2), (70_000, 2)]
