"""Exact top-k search by inner product with multi-resolution segment statistics.

Every vector has, at each resolution (1, 4, 16 segments), the mean and the deviation of each segment. With segments of length L,

    <q, v> <= sum over segments of L * (mean_q * mean_v + dev_q * dev_v),

which is the same as a lower bound of the distance, as |q - v|^2 = |q|^2 + |v|^2 - 2 <q, v>.

1. Candidates are dealt to groups by the nearest of at most ``MOST_GROUPS`` centres, which are rows of a bounded sample; large groups are dealt into parts of about
   ``GROUP_ROWS`` rows. Each candidate is shuffled once.
2. The least and greatest means and the greatest deviations of a group bound the scores of all its rows. A query has a score to beat from the sample, which
   is exact as sample rows are candidates, too, and is sent to those groups alone whose bound reaches it.
3. In a group, blocks of queries meet blocks of candidates, coarse to fine: only pairs whose bound reaches the query's k-th best score so far go to
   the next resolution, and only the last survivors are computed exactly, in whole numbers. At most k rows a query leave each part.

Values: each component x becomes floor(scale * x). Components whose scaled value is beyond 2^31 are computed
with Python's whole numbers; a score outside 64 bits raises.

Edge cases: null vectors and vectors with null or non-finite components take no part; vectors are only
compared with those of equal length (an empty vector scores 0 with other empty ones); equal scores are ranked
by the smaller id; null ids take no part; rows of one id are the query's own and no candidates of each other; for other queries each row of an id is a candidate, and each such query row
is answered on its own only if the rows differ (equal rows give one answer; the oracle's SQL ranks all rows of one
query id together, so the two agree where the ids of queries are unique); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import read, stash

K = 5
SCALE = 256
QUERY_BLOCK = 1024
#: Candidates compared at a time.
CANDIDATE_BLOCK = 1024
SEGMENTS = (1, 4, 16)
#: Rows of a part, about; groups at most; rows that fit centres and first scores.
GROUP_ROWS, MOST_GROUPS, SAMPLE = 16_384, 1024, 2048


def segment_stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and root sums of squared deviations of each segment, scaled so that plain products give the bound."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    n = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    return total / np.sqrt(n), np.sqrt(np.maximum(square - total * total / n, 0))


class Best:
    """The k best (score, id) of each query of a block, fed with blocks of candidates.

    ``marks`` tell queries of one id apart.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, marks: np.ndarray | None = None) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.marks = np.zeros(len(ids), np.int64) if marks is None else marks
        self.stats = [segment_stats(x.astype(np.float64), s) for s in SEGMENTS] if x.shape[1] else []
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.have = np.zeros((len(ids), k), bool)
        self.least = np.full(len(ids), np.iinfo(np.int64).min)  # known from elsewhere

    @property
    def floor(self) -> np.ndarray:
        """The score to beat of each query; the least number where k are not known."""
        return np.where(self.have[:, -1], self.score[:, -1], np.iinfo(np.int64).min)

    def feed(self, ids: np.ndarray, x: np.ndarray, stats: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        """Meets a block of candidates; ``stats``: its segment statistics, where they are known."""
        floor = np.maximum(self.floor, self.least).astype(np.float64)
        alive = self.ids[:, None] != ids[None, :]
        y = x.astype(np.float64)
        for i, (mean, dev) in enumerate(self.stats):
            if not self.have[:, -1].any() and (self.least == np.iinfo(np.int64).min).all():
                break
            m, d = stats[i] if stats else segment_stats(y, SEGMENTS[i])
            bound = mean @ m.T + dev @ d.T
            slack = 1e-9 * (np.abs(mean) @ np.abs(m).T + dev @ d.T) + 1e-6  # of rounding
            alive &= bound + slack >= floor[:, None]
        rows, columns = np.nonzero(alive)
        if not len(rows):
            return
        exact = self._exact(x, rows, columns)
        keep = (exact >= self.score[rows, -1]) | ~self.have[rows, -1]
        rows, columns, exact = rows[keep], columns[keep], exact[keep]
        order = np.lexsort((ids[columns], -exact, rows))
        rows, columns, exact = rows[order], columns[order], exact[order]
        first = np.searchsorted(rows, np.arange(len(self.ids)))
        near = np.arange(len(rows)) - first[rows] < self.k
        rows, columns, exact = rows[near], columns[near], exact[near]
        for q in np.unique(rows):
            own = rows == q
            score = np.concatenate([self.score[q][self.have[q]], exact[own]])
            who = np.concatenate([self.who[q][self.have[q]], ids[columns[own]]])
            top = np.lexsort((who, -score))[: self.k]
            n = len(top)
            self.score[q, :n], self.who[q, :n], self.have[q, :n] = score[top], who[top], True

    def _exact(self, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        if not x.shape[1]:
            return np.zeros(len(rows), np.int64)
        most = np.abs(x).max(initial=0) * np.abs(self.x).max(initial=0) * x.shape[1]
        if x.dtype != object and most < 2**53:  # whole numbers are exact in doubles
            if len(rows) * 8 > len(self.ids) * len(x):
                return (self.x.astype(np.float64) @ x.astype(np.float64).T)[rows, columns].astype(np.int64)
            return np.concatenate([(self.x[r].astype(np.float64) * x[c]).sum(1).astype(np.int64) for r, c in _parts(rows, columns)])
        out = [sum(int(a) * int(b) for a, b in zip(self.x[r], x[c], strict=True)) for r, c in zip(rows, columns, strict=True)]
        return np.array(out, np.int64)

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        for q, mark, who, score, have in zip(self.ids, self.marks, self.who, self.score, self.have, strict=True):
            for v, s in zip(who[have], score[have], strict=True):
                yield int(q), int(mark), int(v), int(s)


def _parts(rows: np.ndarray, columns: np.ndarray, n: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(rows), n):
        yield rows[i : i + n], columns[i : i + n]


def _matrix(vectors: pa.ListArray, scale: float) -> np.ndarray:
    """Scaled whole numbers of lists of equal length."""
    flat = np.asarray(vectors.flatten(), np.float64)
    x = np.floor(scale * flat).reshape(len(vectors), -1 if len(flat) else 0)
    if np.abs(x).max(initial=0) < 2**31:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def _group_bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest means and greatest deviations, at the finest resolution, of a group's rows."""
    mean, dev = segment_stats(x, SEGMENTS[-1])
    return mean.min(0), mean.max(0), dev.max(0)


def _reach(q: np.ndarray, low: np.ndarray, high: np.ndarray, dev: np.ndarray) -> np.ndarray:
    """Upper bounds (queries, groups) of the scores in groups, with what rounding may add."""
    m, d = segment_stats(q, SEGMENTS[-1])
    up, down = np.maximum(m, 0), np.minimum(m, 0)
    size = np.abs(m) @ np.maximum(np.abs(low), np.abs(high)).T + d @ dev.T
    return up @ high.T + down @ low.T + d @ dev.T + 1e-9 * size + 1e-6


def _answers(rows: DataFrame, asked: DataFrame, n: int, k: int, scale: float, query_block: int) -> DataFrame:
    """query_id, mark, vec_id, score: the k best of each part that a query was sent to; all vectors of equal length."""
    spark = rows.sparkSession
    seeds = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    centres = _matrix(seeds.column("x").combine_chunks(), scale).astype(np.float64)[: max(1, min(MOST_GROUPS, -(-n // GROUP_ROWS)))]
    sent, sample = spark.sparkContext.broadcast(centres), spark.sparkContext.broadcast(seeds)
    width = len(segment_stats(centres, SEGMENTS[-1])[0][0]) if centres.shape[1] else 0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            x = _matrix(batch.column(1), scale).astype(np.float64)
            cell = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "x", "cell"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cell = _matrix(batch.column(1), scale).astype(np.float64), batch.column(2).to_numpy()
            for g in np.unique(cell):
                bounds = _group_bounds(x[cell == g]) if width else [np.zeros(0)] * 3
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([int((cell == g).sum())], pa.int64()), *(pa.array([b], pa.list_(pa.float64())) for b in bounds)], ["cell", "n", "low", "high", "dev"])

    placed = stash(rows.mapInArrow(assign, "id bigint, x array<double>, cell int"), "groups")
    facts = placed.mapInArrow(told, "cell int, n bigint, low array<double>, high array<double>, dev array<double>").groupBy("cell")
    each = [F.array(*(f(F.col(c)[i]) for i in range(width))).alias(c) for c, f in (("low", F.min), ("high", F.max), ("dev", F.max))]
    facts = facts.agg(F.sum("n").alias("n"), *(each if width else [])).orderBy("cell").collect()  # MOST_GROUPS rows at most
    low, high, dev = (np.array([r[c] for r in facts]) if width else np.zeros((len(facts), 0)) for c in ("low", "high", "dev"))
    names, parts = np.array([r["cell"] for r in facts]), np.array([-(-r["n"] // GROUP_ROWS) for r in facts])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sample.value.column("id").to_numpy(), _matrix(sample.value.column("x").combine_chunks(), scale)
        for batch in batches:
            for i in range(0, batch.num_rows, query_block):
                own = batch.slice(i, query_block)
                q = _matrix(own.column(1), scale)
                best = Best(own.column(0).to_numpy(), q, k, own.column(2).to_numpy())
                for j in range(0, len(ids), CANDIDATE_BLOCK):
                    best.feed(ids[j : j + CANDIDATE_BLOCK], x[j : j + CANDIDATE_BLOCK])
                on = _reach(q.astype(np.float64), low, high, dev) >= best.floor[:, None] if width else np.ones((len(q), len(names)), bool)
                for p in range(int(parts.max())):
                    who, g = np.nonzero(on & (parts > p)[None, :])
                    if len(who):
                        taken = own.take(pa.array(who))
                        yield pa.RecordBatch.from_arrays([pa.array(names[g].astype(np.int32)), pa.array(np.full(len(who), p, np.int32)), pa.array(np.ones(len(who), bool)), *taken.columns, pa.array(best.floor[who])], ["cell", "part", "asks", "id", "x", "mark", "least"])

    queries = asked.select("id", "x", "mark").mapInArrow(route, "cell int, part int, asks boolean, id bigint, x array<double>, mark bigint, least bigint")
    of = F.create_map(*[F.lit(int(v)) for g, p in zip(names, parts, strict=True) for v in (g, p)])
    # rows are told apart by their place in the table, so that copies of one row don't meet in one part
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), of[F.col("cell")]).cast("int")
    zero = F.lit(0).cast("bigint")
    candidates = placed.select("cell", part.alias("part"), F.lit(False).alias("asks"), "id", "x", zero.alias("mark"), zero.alias("least"))
    dealt = candidates.unionByName(queries).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "part").sortWithinPartitions("cell", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, blocks = None, [], None
        for batch in batches:
            code = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            cuts = np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(code)], strict=True):
                if now != tuple(code[a, :2]):
                    now, held, blocks = tuple(code[a, :2]), [], None
                own = batch.slice(a, b - a)
                if not code[a, 2]:
                    held.append((own.column(3).to_numpy(), _matrix(own.column(4), scale)))
                    continue
                if blocks is None:
                    blocks = []
                    for ids, x in held:
                        for i in range(0, len(ids), CANDIDATE_BLOCK):
                            y = x[i : i + CANDIDATE_BLOCK]
                            blocks.append((ids[i : i + CANDIDATE_BLOCK], y, [segment_stats(y.astype(np.float64), s) for s in SEGMENTS] if width else None))
                    held = []
                for i in range(0, b - a, query_block):
                    part = own.slice(i, query_block)
                    best = Best(part.column(3).to_numpy(), _matrix(part.column(4), scale), k, part.column(5).to_numpy())
                    best.least = part.column(6).to_numpy()
                    for block in blocks:
                        best.feed(*block)
                    if found := list(best.rows()):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["query_id", "mark", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id bigint, mark bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row. ``is_query``: a condition on ``id``."""
    x = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"), F.coalesce(fit, F.lit(False)).alias("fit")).where("fit").select("id", "x", F.size("x").alias("dim"))
    rows = stash(rows, "vectors")
    # equal query rows are one query; the mark tells different vectors of one id apart
    asked = rows.where(is_query).distinct().withColumn("mark", F.xxhash64("x"))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length of vectors
    dims = [r["dim"] for r in asked.select("dim").distinct().collect()]
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    parts = [_answers(rows.where(F.col("dim") == d).select("id", "x"), asked.where(F.col("dim") == d).select("id", "x", "mark"), sizes[d], k, scale, query_block) for d in dims]
    partial = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every embedding whose vec_id is divisible by 50."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {"op3_topk_search": op3_topk_search}
ORACLE = {
    "op3_topk_search": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
