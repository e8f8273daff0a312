"""Sharding by balanced label propagation: linked documents move together while shard sizes stay even.

Vertices are documents, links are equal keys: equal texts, and equal sketch keys. A text has ``BANDS`` sketch keys,
each made of two minimum hashes over all word shingles of the whole text, so near copies share a key wherever
they differ: at a Jaccard similarity J of the shingle sets the chance that none is shared is (1 - J^2)^BANDS (0.0003
at 0.8). Links are kept as a bipartite table of texts and keys, never as pairs, so n near copies have BANDS * n edges.
Keys that only one text has link nothing and are left out.

1. First labels know nothing of the texts: documents are numbered by a hash of their ids and dealt out in turn.
2. Rounds of label propagation. For every key the shards' shares are counted. A group of equal texts goes to the
   shard that holds most of it; one too large for a shard takes as many of its fullest shards as it needs (each
   filled to ``FILL`` at most), its documents dealt over them by hash. Such shards are claimed: smaller groups
   prefer others, and their documents there make room. Each sketch key of a text without copies votes for
   the shard that holds most of the key's documents, and the text goes where most keys point. Ties fall by a hash of key and shard, so
   all members of a key agree and no shard draws more than others. The driver gets counts by (from, to),
   n_shards squared rows, and sets quotas: what leaves a shard for another is matched by what comes back, wanted
   moves first, then documents that are free to go (without links, or in a claimed shard). So every round keeps all sizes.
   Rounds end when no quota is left, when a round leaves more than ``settle`` of the wishes to move, or after ``rounds``, if given.
3. Slots number each shard's documents from 0.

Law ``rows``: the shards' counts differ by one at most, exactly, after every round.

All numbering is done in two steps over hashed buckets (``salted_rank``), so a group of a
third of all rows is dealt over many tasks. Tables that a round reads more than once are written to the
shared folder. The driver sees only counts by shard pairs and by a fixed number of buckets.

Edge cases: a null text counts as empty (size 16, checksum 0); texts without words have no sketch
keys; a text with fewer words than a shingle is one shingle; null ids are allowed (they sort first); repeated rows are rows of their own; an empty
table gives an empty result; with fewer documents than shards some shards are empty; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import read, salted_rank, stash, text_slices
from tidewatch.llm.ngram_join import _mix, shingle_sets

N_SHARDS = 40
#: Words in a shingle, and sketch keys of a text.
WIDTH, BANDS = 5, 8
SALTS = 64
#: Buckets of the numbering of all documents, whatever their number.
DEALS = 4096
#: How much of a shard one group of equal texts may take, and the share of wishes that a worthwhile round leaves at most.
FILL, SETTLE = 0.8, 0.9
_U = np.uint64
_FACTORS = np.random.default_rng(21).integers(1, 2**63, 2 * BANDS, _U) * _U(2) + _U(1)  # fixed: the same in every task


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Sketch keys of a set of shingle hashes; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(2 * BANDS, np.iinfo(_U).max, _U)
    for i in range(0, len(shingles), 65_536):
        np.minimum(least, (shingles[i : i + 65_536] * _FACTORS[:, None]).min(1), out=least)
    return _mix(_mix(least[::2]) + least[1::2] + np.arange(BANDS, dtype=_U)).view(np.int64)


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, text_key, and the sketch keys (links) of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        text.alias("text"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("size", "text_crc32", "text_key")), T.StructField("links", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch):
                part = batch.slice(i, j - i)
                keys = [sketch(x) for x in shingle_sets([x.encode() for x in part.column(1).to_pylist()], WIDTH)]
                ends = np.cumsum([0, *(len(x) for x in keys)])
                links = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(k) for k in (2, 3, 4)), links], schema.names)

    return rows.mapInArrow(run, schema)


def _edges(rows: DataFrame) -> DataFrame:
    """text_key and key of all texts that share a sketch key with another text."""
    edges = stash(rows.select("text_key", F.explode("links").alias("key")).distinct(), "edges")
    shared = edges.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key")
    return stash(edges.join(shared, "key"), "shared")


def _starts(rows: DataFrame, n_shards: int) -> DataFrame:
    """Adds ``shard``: documents dealt out in turn, in the order of a hash of their ids."""
    return salted_rank(rows, [], "k", ["doc_id", "text_key"], salts=DEALS).withColumn("shard", F.pmod("k", F.lit(n_shards)).cast("int")).drop("k")


def _held(counts: DataFrame, key: str, claimed: list[int]) -> DataFrame:
    """For each key: its documents (n), their numbers by shard (by), its shards, fullest first (best), and that
    order with claimed shards last (other)."""
    tie = F.xxhash64(key, "shard").alias("tie")
    last = (~F.col("shard").isin(claimed)).alias("unclaimed") if claimed else F.lit(True).alias("unclaimed")
    ranked = F.sort_array(F.collect_list(F.struct(last, "n", tie, "shard")), asc=False).alias("other")
    plain = F.sort_array(F.collect_list(F.struct("n", tie, "shard")), asc=False).alias("best")
    held = counts.groupBy(key).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by"), plain, ranked)
    return held.select(key, "n", "by", F.col("best.shard").alias("best"), F.col("other.shard").alias("other"))  # lists of n_shards entries at most


def _wishes(rows: DataFrame, edges: DataFrame, capacity: float) -> DataFrame:
    """Adds ``target`` (the shard a document wants, its own if none) and ``free`` (no link holds it, or its shard is claimed)."""
    counts = stash(rows.groupBy("text_key", "shard").agg(F.count(F.lit(1)).alias("n")), "counts")
    need = F.ceil(F.col("n") / (capacity * FILL)).cast("int")
    large = _held(counts, "text_key", []).where(need > 1)
    claimed = [r[0] for r in large.select(F.explode(F.slice("best", 1, need))).distinct().collect()]  # n_shards at most
    texts = _held(counts, "text_key", claimed).withColumn("goals", F.when(need > 1, F.slice("best", 1, need)).otherwise(F.slice("other", 1, 1)))
    shares = edges.join(counts, "text_key").groupBy("key", "shard").agg(F.sum("n").alias("n"))
    # the votes of texts without copies: these have one shard
    single = texts.where(F.col("n") == 1).select("text_key", F.col("best")[0].alias("own"))
    keys = _held(shares, "key", claimed).withColumn("to", F.col("other")[0])
    gain = F.col("by")[F.col("to")] - (F.col("by")[F.col("own")] - 1)  # moving brings more members together
    votes = edges.join(single, "text_key").join(keys, "key").select("text_key", "to", gain.alias("gain"))
    votes = votes.groupBy("text_key", "to").agg(F.count(F.lit(1)).alias("keys"), F.sum("gain").alias("gain"))
    voted = votes.groupBy("text_key").agg(F.max(F.struct("keys", "gain", F.xxhash64("to").alias("tie"), "to")).alias("vote"))
    rows = rows.join(texts.select("text_key", F.col("n").alias("copies"), "goals"), "text_key").join(voted, "text_key", "left")
    dealt = F.col("goals")[F.pmod(F.xxhash64("doc_id"), F.size("goals")).cast("int")]
    together = (F.col("copies") > 1) & ~F.array_contains("goals", F.col("shard"))
    target = F.when(together, dealt).when((F.col("copies") == 1) & (F.col("vote.gain") > 0), F.col("vote.to")).otherwise(F.col("shard"))
    free = (F.col("copies") == 1) & F.col("vote").isNull()
    if claimed:
        free |= F.col("shard").isin(claimed) & (F.col("copies") <= capacity * FILL)
    return rows.withColumn("target", target).withColumn("free", free).drop("copies", "goals", "vote")


def cut_links(shards: DataFrame, edges: DataFrame, column: str = "shard") -> DataFrame:
    """One row: linked (documents in a group of equal texts or under a shared sketch key, once for each) and cut
    (those of them outside the shard that holds most of it). ``shards`` has text_key and the column."""
    counts = shards.groupBy("text_key", F.col(column).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    copies = counts.groupBy("text_key").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    near = edges.join(counts, "text_key").groupBy("key", "shard").agg(F.sum("n").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    both = copies.select("n", "most").unionByName(near.select("n", "most"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))


def quotas(wanted: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(moves, fills): how many wish moves and how many free documents go from shard s to t.

    moves <= wanted, and fills of a row <= free; moves + fills has equal row and column sums in every pair,
    so each shard gives as many as it takes.
    """
    n = len(free)
    moves, fills, left = np.zeros_like(wanted), np.zeros_like(wanted), free.copy()
    for s in range(n):
        for t in range(s + 1, n):
            both = min(wanted[s, t], wanted[t, s])
            moves[s, t] = moves[t, s] = both
            for a, b in ((s, t), (t, s)):
                more = min(wanted[a, b] - both, left[b])
                moves[a, b] += more
                fills[b, a] += more
                left[b] -= more
    return moves, fills


def _round(rows: DataFrame, edges: DataFrame, n_shards: int, capacity: float, r: int, most: float | None) -> tuple[DataFrame, int] | None:
    """One round of moves under quotas, and how many documents wanted to move.

    None if nothing can move, or if more than ``most`` want to.
    """
    rows = stash(_wishes(rows, edges, capacity), f"wishes{r}")
    counted = rows.groupBy("shard", "target", "free").agg(F.count(F.lit(1)).alias("n")).where((F.col("shard") != F.col("target")) | F.col("free")).collect()
    wanted, free = np.zeros((n_shards, n_shards), np.int64), np.zeros(n_shards, np.int64)
    for x in counted:
        if x["shard"] != x["target"]:
            wanted[x["shard"], x["target"]] += x["n"]
        elif x["free"]:
            free[x["shard"]] += x["n"]
    moves, fills = quotas(wanted, free)
    wishes = int(wanted.sum())
    if not moves.any() or (most is not None and wishes > most):
        return None
    # rank of each candidate among those of its (shard, target); free ones have their own shard as target
    candidates = rows.where((F.col("shard") != F.col("target")) | F.col("free"))
    ranked = salted_rank(candidates, ["shard", "target"], "k", ["text_key", "doc_id"], salts=SALTS)
    spans = []  # (shard, target, first rank, end, new shard)
    for s in range(n_shards):
        at = 0
        for t in range(n_shards):
            if moves[s, t]:
                spans.append((s, t, 0, int(moves[s, t]), t))
            if fills[s, t]:
                spans.append((s, s, at, at + int(fills[s, t]), t))
                at += int(fills[s, t])
    plan = rows.sparkSession.createDataFrame(spans, "shard int, target int, a bigint, b bigint, new_shard int")
    plan = plan.groupBy("shard", "target").agg(F.collect_list(F.struct("a", "b", "new_shard")).alias("spans"))
    hit = F.filter("spans", lambda x: (x["a"] <= F.col("k")) & (F.col("k") < x["b"]))
    moved = ranked.join(F.broadcast(plan), ["shard", "target"], "left").withColumn("shard", F.coalesce(F.get(hit, F.lit(0))["new_shard"], F.col("shard"))).drop("k", "spans")
    stay = rows.where((F.col("shard") == F.col("target")) & ~F.col("free"))
    return moved.unionByName(stay).drop("target", "free"), wishes


def propagate(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int | None = None, settle: float = SETTLE) -> tuple[DataFrame, DataFrame]:
    """doc_id, size, text_crc32, text_key, first_shard and shard of every document, and the table of shared sketch keys."""
    rows = stash(slim(docs), "slim")
    capacity = max(1.0, rows.count() / n_shards)
    edges = _edges(rows)
    rows = stash(_starts(rows.drop("links"), n_shards).withColumn("first_shard", F.col("shard")), "starts")
    r, most = 0, None
    while rounds is None or r < rounds:
        moved = _round(rows, edges, n_shards, capacity, r, most)
        if moved is None:
            break
        rows, most, r = stash(moved[0], f"round{r}"), settle * moved[1], r + 1
    return rows, edges


def shard(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and first_shard (before propagation) of every document."""
    rows, _ = propagate(docs, n_shards, rounds)
    return salted_rank(rows, ["shard"], "slot", ["doc_id", "text_key"], salts=4 * SALTS).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"), "first_shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 whose counts differ by one at most."""
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "first_shard")


QUERIES = {"op1_sharding": op1_sharding}
ORACLE: dict[str, str] = {}
