"""Checks at size: digest trees that find where two sets of keys differ, and bitmaps that count keys exactly.

Digest trees. A key's hash names a path from the root, ``BITS`` bits a level. A level's digests are the number of keys below each node and the xor and
sum of a second hash of theirs; they are combined in each task, so a level sends as many rows as it has nodes. Both sides are read at each level, but from one
level to the next only below nodes whose digests differ, and only the keys of the last level's differing nodes are compared. What is shuffled grows with the
difference, not with the keys.

Bitmaps. An integer key is a bit of a bucket of 32,768; a slice's bitmaps and row counts are small, stay valid while the slice does, and
merge across slices by or. A key is repeated exactly where a bucket has more rows than bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expressions import moment
from tidewatch.sources.scratch import written
from tidewatch.sources.slices import SliceTable

#: Bits of a level, levels at most, and the number of differing nodes from which on keys are compared at once.
BITS, LEVELS, MANY = 10, 3, 2000


def _hashed(keys: DataFrame) -> DataFrame:
    """Keys (pk, not null) with their path and a second hash."""
    return keys.where(F.col("pk").isNotNull()).select("pk", F.xxhash64("pk").alias("path"), F.xxhash64(F.lit(17), F.hash("pk"), "pk").alias("mark"))


def _node(level: int) -> Column:
    """The node of a path at a level (from 1)."""
    return F.shiftrightunsigned("path", 64 - BITS * level)


def level_digests(keys: DataFrame, level: int, below: DataFrame | None = None) -> DataFrame:
    """node, n, mix and total of the keys (pk) at a level; with ``below`` (node, of the level before) only under these."""
    rows = _hashed(keys)
    if below is not None:
        rows = rows.withColumn("up", _node(level - 1)).join(below.select(F.col("node").alias("up")), "up", "left_semi")
    low = F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.groupBy(_node(level).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("mark").alias("mix"), F.sum(low).alias("total"))


def combined(digests: DataFrame) -> DataFrame:
    """The digests of the level above."""
    return digests.groupBy(F.shiftrightunsigned("node", BITS).alias("node")).agg(F.sum("n").alias("n"), F.bit_xor("mix").alias("mix"), F.sum("total").alias("total"))


def differing_nodes(a: DataFrame, b: DataFrame, levels: int = LEVELS, many: int = MANY) -> tuple[DataFrame, int]:
    """Nodes (node) whose keys differ between a and b (pk), and their level.

    Goes down while few nodes differ; 64-bit hashes decide, together with counts and sums.
    """
    below = None
    for level in range(1, levels + 1):
        sides = [level_digests(x, level, below).select("node", F.struct("n", "mix", "total").alias(name)) for x, name in ((a, "a"), (b, "b"))]
        below = written(sides[0].join(sides[1], "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "digests")
        n = below.count()
        if n == 0 or n > many:
            break
    return below, level


def key_differences(a: DataFrame, b: DataFrame, levels: int = LEVELS, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """Keys (pk) that only a has, and that only b has, each once; null keys never count.

    Repeated keys make digests differ where the sets don't, which costs a comparison and changes no result.
    """
    nodes, level = differing_nodes(a, b, levels, many)
    left, right = (_hashed(x).withColumn("node", _node(level)).join(nodes, "node", "left_semi").select("pk").distinct() for x in (a, b))
    return left.join(right, "pk", "left_anti"), right.join(left, "pk", "left_anti")


def source_completeness(src: DataFrame, src_pk: str, stg: DataFrame, grain: str, created: str, as_of) -> DataFrame:
    """As ``checks.source_completeness``, by digest trees; null keys, which never match, are told, too (one row a side)."""
    today = F.date_trunc("day", moment(as_of))
    sides = [x.where(F.col(created) < today).select(F.col(k).alias("pk")) for x, k in ((src, src_pk), (stg, grain))]
    missing = [x.unionByName(y.where("pk IS NULL").limit(1)) for x, y in zip(key_differences(*sides), sides, strict=True)]
    names = ("MISSING_FROM_STAGING", "MISSING_FROM_SOURCE")
    out = [x.select("pk", F.lit(n).alias("issue_type")) for x, n in zip(missing, names, strict=True)]
    return out[0].unionByName(out[1])


def completeness(entity: DataFrame, grain: str, source: DataFrame, pk: str, tolerance: float = 0.01) -> DataFrame:
    """As ``checks.completeness`` without exclusions and additions, for keys that are unique and not null on both sides.

    Counts come from the first level's digests, differences from the tree. A null or repeated key would change the counts: check ``unique_grain`` and ``not_null_grain`` before.
    """
    actual, expected = entity.select(F.col(grain).alias("pk")), source.select(F.col(pk).alias("pk"))
    missing, unexpected = key_differences(expected, actual)
    counts = None
    for df, name in ((expected, "expected_count"), (actual, "entity_count"), (missing, "missing_count"), (unexpected, "unexpected_count")):
        one = df.agg(F.count("pk").alias(name))
        counts = one if counts is None else counts.crossJoin(one)  # one row each
    drift = counts.withColumn("drift_ratio", F.try_divide((F.col("missing_count") + F.col("unexpected_count")).cast("double"), F.col("expected_count").cast("double")))
    return drift.where(F.col("drift_ratio") > tolerance).withColumn("issue_type", F.lit("COMPLETENESS_IMBALANCE"))


def key_bitmaps(rows: DataFrame, key: str) -> DataFrame:
    """slice, bucket, bits and n (rows) of an integer key by slice; null keys have a null bucket."""
    k = F.col(key).cast("bigint")
    return rows.groupBy("slice", F.bitmap_bucket_number(k).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits"), F.count(F.lit(1)).alias("n"))


def update_bitmaps(index: SliceTable, rows: DataFrame, slices: DataFrame, key: str, run_id: str, at) -> DataFrame:
    """Writes the bitmaps of the pending slices (slice) anew and returns the index's state; other slices of ``rows`` are not read."""
    pending = [r["slice"] for r in slices.select("slice").distinct().collect()]  # names, so that folders are pruned
    return index.load(key_bitmaps(rows.where(F.col("slice").isin(pending)), key), slices, run_id, at)


def _suspects(bitmaps: DataFrame) -> DataFrame:
    """Buckets in which some key has more than one row."""
    whole = bitmaps.groupBy("bucket").agg(F.sum("n").alias("n"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("keys"))
    return whole.where(F.when(F.col("bucket").isNull(), F.col("n") > 1).otherwise(F.col("n") > F.col("keys"))).select("bucket")


def distinct_keys(index: SliceTable) -> DataFrame:
    """rows and keys: how many rows and how many different keys (not null) all slices have together, from the bitmaps alone."""
    whole = index.read().where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("keys"))
    return whole.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("keys"), F.lit(0)).alias("keys"))


def repeated_keys(index: SliceTable, rows: DataFrame, key: str) -> DataFrame:
    """The key's values that occur more than once over all slices, with ``cnt``: the rows of ``checks.unique_grain``.

    Of ``rows`` only the slices that have keys in suspect buckets are read.
    """
    bitmaps = index.read()
    suspects = written(_suspects(bitmaps), "suspects")
    if suspects.isEmpty():
        return rows.select(key).limit(0).withColumn("cnt", F.lit(0).cast("bigint"))
    there = bitmaps.select("slice", F.col("bucket").alias("b")).join(suspects.select(F.col("bucket").alias("b2")), F.col("b").eqNullSafe(F.col("b2"))).select("slice").distinct()
    own = rows.where(F.col("slice").isin([r["slice"] for r in there.collect()])).withColumn("b", F.bitmap_bucket_number(F.col(key).cast("bigint")))
    own = own.join(suspects, F.col("b").eqNullSafe(F.col("bucket")), "left_semi")
    return own.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
