"""Hard-negative mining: windows of inner products, searched in cover trees over norm-augmented candidates.

A candidate v becomes (v, sqrt(M^2 - |v|^2)), M being the greatest norm of its tree, and an anchor q becomes (q, 0). Then

    <q, v> = (|q|^2 + M^2 - |q' - v'|^2) / 2,

so a node with centre c and covering radius r holds only inner products between those at distances d(q', c') + r and d(q', c') - r.

1. Candidates are dealt to cells by the nearest of at most ``MOST_CELLS`` centres, which are rows of a bounded sample; large cells are dealt
   into parts of about ``CELL_ROWS`` rows by hash, so copies of one vector never meet in one task. All rows are indexed.
2. An anchor's answers from the sample give it a score to beat, which is exact as sample rows are candidates, too.
   An anchor is sent to those cells alone whose covering radius allows a better score inside its windows.
3. A task builds the cover tree of its part: each level splits nodes at rows that are farthest from the centres so far, until these cover the node's
   rows at a smaller radius. A block of anchors descends the levels together; nodes outside all windows, without rows of a wanted
   label, or below an anchor's k-th best score are skipped. Each anchor opens the leaves left in the order of its own bounds, and their
   rows are scored exactly, in whole numbers.
4. The best of all parts are ranked. This runs once for positives (one window without limits, own label) and once for
   negatives (a window for each positive, other labels).

Edge cases: rows without id, label or vector, or with a null or non-finite component take no part; equal rows (id, label, vector) count as
one; different rows of one id are candidates of each other and are answered on their own; vectors are compared with those of equal length only;
scores of one value are ranked by the smaller id; a positive with a negative score has an empty window; components whose scaled value is
beyond 2^31 are computed in Python's whole numbers, and scores outside 64 bits raise; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import read, stash
from tidewatch.llm.topk_search import _matrix

POSITIVES, NEGATIVES = 5, 3
SCALE = 256
#: Rows of a cover tree, about.
CELL_ROWS = 16_384
MOST_CELLS = 1024
#: Rows that fit centres and first scores.
SAMPLE = 4096
#: Rows of a leaf at most (unless all are equal), children of a node, and how much smaller their radius should be.
LEAF, FAN, SHRINK = 64, 8, 0.7
ANCHORS = 256
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class CoverTree:
    """Levels of nodes over the rows of a matrix of whole numbers."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.marks, self.labels, self.x = ids, marks, labels, x
        y = x.astype(np.float64)
        square = (y * y).sum(1)
        self.m2 = float(square.max(initial=0.0))
        self.flat = y
        y = np.c_[y, np.sqrt(np.maximum(self.m2 - square, 0))]
        self.order = np.arange(len(y))
        self.levels: list[dict[str, np.ndarray]] = []
        middle = int(((y - y.mean(0)) ** 2).sum(1).argmin()) if len(y) else 0
        todo = [(0, len(y), -1, middle)] if len(y) else []
        while todo:
            nodes, following = [], []
            for a, b, parent, centre in todo:
                own = self.order[a:b]
                near = np.sqrt(((y[own] - y[centre]) ** 2).sum(1))
                radius = float(near.max())
                leaf = b - a <= LEAF or radius == 0
                told = np.unique(labels[own])
                nodes.append((a, b, parent, centre, radius, leaf, int(np.bitwise_or.reduce(np.uint64(1) << (told % 64).astype(np.uint64))), told[0], len(told) == 1))
                if leaf:
                    continue
                centres, who = [centre], np.zeros(len(own), np.int64)
                while len(centres) < FAN and near.max() > SHRINK * radius:
                    centres.append(int(own[near.argmax()]))
                    d = np.sqrt(((y[own] - y[centres[-1]]) ** 2).sum(1))
                    who[d < near] = len(centres) - 1
                    near = np.minimum(near, d)
                self.order[a:b] = own[np.argsort(who, kind="stable")]
                ends = a + np.cumsum(np.bincount(who, minlength=len(centres)))
                following += [(s, e, len(nodes) - 1, c) for s, e, c in zip(np.r_[a, ends[:-1]], ends, centres, strict=True) if e > s]
            names = ("from", "to", "parent", "centre", "radius", "leaf", "mask", "label", "one_label")
            kinds = (np.int64, np.int64, np.int64, np.int64, np.float64, bool, np.uint64, np.int64, bool)
            self.levels.append({n: np.array(c, k) for n, c, k in zip(names, zip(*nodes, strict=True), kinds, strict=True)})
            todo = following
        self.leaf_from = np.concatenate([v["from"][v["leaf"]] for v in self.levels]) if self.levels else np.zeros(0, np.int64)
        self.leaf_to = np.concatenate([v["to"][v["leaf"]] for v in self.levels]) if self.levels else np.zeros(0, np.int64)

    def _leaves(self, q: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> np.ndarray:
        """The upper bound of each anchor in each leaf; -inf where it has nothing to look for."""
        q2 = (q * q).sum(1)[:, None]
        slack = 1e-9 * (q2 + self.m2) + 1e-6
        out, alive = [], None
        for v in self.levels:
            on = np.ones((len(q), len(v["from"])), bool) if alive is None else alive[:, v["parent"]]
            far = np.sqrt(np.maximum(q2 + self.m2 - 2 * (q @ self.flat[v["centre"]].T), 0))
            top = (q2 + self.m2 - np.maximum(far - v["radius"], 0) ** 2) / 2 + slack
            least = (q2 + self.m2 - (far + v["radius"]) ** 2) / 2 - slack
            on &= np.logical_or.reduce([(top >= low[:, w, None]) & (least <= high[:, w, None]) for w in range(low.shape[1])])
            if same:
                on &= (v["mask"][None, :] >> (labels[:, None] % 64).astype(np.uint64)) & np.uint64(1) > 0
            else:
                on &= ~(v["one_label"][None, :] & (v["label"][None, :] == labels[:, None]))
            out.append(np.where(on, top, -np.inf)[:, v["leaf"]])
            alive = on
        return np.concatenate(out, 1) if out else np.zeros((len(q), 0))

    def search(self, ids: np.ndarray, marks: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(anchor, window, score, row): the k best rows of each window [low, high] of each anchor, own row left out."""
        n, windows = low.shape
        exact = q.dtype != object and self.x.dtype != object and np.abs(q).max(initial=0) * np.abs(self.x).max(initial=0) * q.shape[1] < 2**53
        a, b = (q.astype(np.float64), self.flat) if exact else (q.astype(object), self.x.astype(object))
        low = low.copy()
        bound = self._leaves(q.astype(np.float64), labels, low.astype(np.float64), high.astype(np.float64), same)
        turn = np.argsort(-bound, 1, kind="stable")
        best = tuple(np.zeros(0, np.int64) for _ in range(3))  # group, score, row
        at, width = 0, 2
        while at < turn.shape[1]:
            leaf = turn[:, at : at + width]
            told = np.take_along_axis(bound, leaf, 1)
            open_ = (told >= low.min(1, initial=_HIGH)[:, None]) & (told > -np.inf)
            if not open_.any():
                break  # bounds fall from left to right
            who, j = np.nonzero(open_)
            which = leaf[who, j]
            sort = np.argsort(which, kind="stable")
            who, which = who[sort], which[sort]
            starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            found = []
            for s, e in zip(starts, np.r_[starts[1:], len(which)], strict=True):
                mine, rows = who[s:e], self.order[self.leaf_from[which[s]] : self.leaf_to[which[s]]]
                score = b[rows] @ a[mine].T if q.shape[1] else np.zeros((len(rows), len(mine)), np.int64)
                if not exact and max(map(abs, score.ravel().tolist()), default=0) > _HIGH:
                    raise OverflowError("a score is beyond 64 bits")
                fit = (self.labels[rows][:, None] == labels[mine]) == same
                fit &= (score >= low[mine].min(1)) & (score <= high[mine].max(1))
                fit &= (self.ids[rows][:, None] != ids[mine]) | (self.marks[rows][:, None] != marks[mine])
                r, c = np.nonzero(fit)
                found.append((mine[c], rows[r], score[r, c]))
            anchor, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
            score = np.array(score.tolist(), np.int64) if score.dtype == object else score.astype(np.int64)
            parts = [best]
            for w in range(windows):
                fit = (score >= low[anchor, w]) & (score <= high[anchor, w])
                parts.append((anchor[fit] * windows + w, score[fit], row[fit]))
            group, score, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            sort = np.lexsort((self.ids[row], ~score, group))
            group, score, row = group[sort], score[sort], row[sort]
            place = np.arange(len(group)) - np.searchsorted(group, group)
            keep = place < k
            best = group, score, row = group[keep], score[keep], row[keep]
            last = place[keep] == k - 1
            low.ravel()[group[last]] = np.maximum(low.ravel()[group[last]], score[last])
            at, width = at + width, 2 * width
        group, score, row = best
        return group // max(windows, 1), group % max(windows, 1), score, row


def _tree(part: pa.RecordBatch | pa.Table) -> CoverTree:
    ids, marks, labels = (part.column(c).to_numpy().astype(np.int64) for c in ("id", "mark", "label"))
    x = part.column("x")
    return CoverTree(ids, marks, labels, _matrix(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x, 1))


_KEYS = "id bigint, mark bigint, label bigint, x array<double>"


class _Search:
    """One pass: windows of anchors over all candidates of one length."""

    def __init__(self, candidates: DataFrame, dim: int, k: int, same: bool) -> None:
        self.dealt, self.cells, self.seeds, self.k, self.same = *_deal(candidates, dim), k, same

    def answers(self, asks: DataFrame) -> DataFrame:
        """id, mark, window, score, who: the k best of each part; asks: id, mark, label, x, low and high (arrays of bigint)."""
        spark, k, same = asks.sparkSession, self.k, self.same
        cells, seeds = spark.sparkContext.broadcast(self.cells), spark.sparkContext.broadcast(self.seeds)
        fields = ["cell", "part", "asks", "id", "mark", "label", "x", "low", "high"]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, (centres, radii, masks, parts) = _tree(seeds.value), cells.value
            for batch in batches:
                for i in range(0, batch.num_rows, ANCHORS):
                    own = batch.slice(i, ANCHORS)
                    ids, marks, labels, x, low, high = _asked(own)
                    a, w, score, _ = tree.search(ids, marks, labels, x, low, high, k, same)
                    group = a * low.shape[1] + w
                    full = np.flatnonzero(np.arange(len(group)) - np.searchsorted(group, group) == k - 1)
                    low.ravel()[group[full]] = np.maximum(low.ravel()[group[full]], score[full])
                    q = x.astype(np.float64)
                    size = np.sqrt((q * q).sum(1))[:, None]
                    at, reach = q @ centres.T, size * radii[None, :]
                    slack = 1e-9 * (np.abs(q) @ np.abs(centres).T + reach) + 1e-6
                    on = np.logical_or.reduce([(at + reach + slack >= low[:, j, None]) & (at - reach - slack <= high[:, j, None]) for j in range(low.shape[1])])
                    if same:
                        on &= (masks[None, :] >> (labels[:, None] % 64).astype(np.uint64)) & np.uint64(1) > 0
                    for p in range(int(parts.max(initial=0))):
                        who, cell = np.nonzero(on & (parts > p)[None, :])
                        if len(who):
                            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(who) + 1) * low.shape[1]).astype(np.int32)), pa.array(low[who].ravel()))
                            sent = own.take(pa.array(who))
                            n = pa.nulls(len(who), pa.int32()).fill_null(p)
                            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), n, pa.array(np.ones(len(who), bool)), *(sent.column(c) for c in ("id", "mark", "label", "x")), lists, sent.column("high")], fields)

        routed = asks.select("id", "mark", "label", "x", "low", "high").mapInArrow(route, f"cell int, part int, asks boolean, {_KEYS}, low array<bigint>, high array<bigint>")
        none = F.array().cast("array<bigint>")
        rows = self.dealt.select("cell", "part", F.lit(False).alias("asks"), "id", "mark", "label", "x", none.alias("low"), none.alias("high")).unionByName(routed)
        dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "part").sortWithinPartitions("cell", "part", "asks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, tree = None, [], None
            for batch in batches:
                code = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "part", "asks")], 1)
                cuts = np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1
                for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(code)], strict=True):
                    if now != tuple(code[a, :2]):
                        now, held, tree = tuple(code[a, :2]), [], None
                    if not code[a, 2]:
                        held.append(batch.slice(a, b - a))
                        continue
                    if tree is None:
                        tree, held = _tree(pa.Table.from_batches(held) if held else batch.slice(0, 0)), []
                    for i in range(a, b, ANCHORS):
                        ids, marks, labels, x, low, high = _asked(batch.slice(i, min(ANCHORS, b - i)))
                        who, window, score, row = tree.search(ids, marks, labels, x, low, high, k, same)
                        if len(who):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[who], marks[who], window.astype(np.int32), score, tree.ids[row])], ["id", "mark", "window", "score", "who"])

        return dealt.mapInArrow(run, "id bigint, mark bigint, window int, score bigint, who bigint")


def _asked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    ids, marks, labels = (batch.column(c).to_numpy().astype(np.int64) for c in ("id", "mark", "label"))
    low, high = (np.array(batch.column(c).flatten().to_numpy(), np.int64).reshape(batch.num_rows, -1) for c in ("low", "high"))
    return ids, marks, labels, _matrix(batch.column("x"), 1), low, high


def _deal(candidates: DataFrame, dim: int) -> tuple[DataFrame, tuple[np.ndarray, ...], pa.Table]:
    """The candidates with cell and part; centres, radii, label masks and parts of the cells; the sample."""
    spark = candidates.sparkSession
    own = candidates.where(F.col("dim") == dim).drop("dim")
    n = own.count()
    seeds = own.orderBy(F.xxhash64("id", "mark"), "id", "mark").limit(SAMPLE).toArrow()
    some = min(MOST_CELLS, max(1, -(-n // CELL_ROWS)), len(seeds))
    centres = _matrix(seeds.column("x").combine_chunks(), 1)[:some].astype(np.float64)
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            x = _matrix(batch.column("x"), 1).astype(np.float64)
            cell = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - c[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "mark", "label", "x", "cell", "far"])

    placed = stash(own.select("id", "mark", "label", "x").mapInArrow(assign, f"{_KEYS}, cell int, far double"), "cells")
    facts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.bit_or(F.expr("shiftleft(1L, cast(pmod(label, 64) as int))")).alias("mask")).toArrow().to_pylist()  # MOST_CELLS rows at most
    radii, masks, parts = np.zeros(some), np.zeros(some, np.uint64), np.zeros(some, np.int64)
    for r in facts:
        radii[r["cell"]], masks[r["cell"]], parts[r["cell"]] = r["far"] * (1 + 1e-12), np.uint64(r["mask"] % 2**64), -(-r["n"] // CELL_ROWS)
    of = F.create_map(*[F.lit(int(v)) for i, p in enumerate(parts) for v in (i, max(p, 1))])
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("id", "mark", F.lit(3)), of[F.col("cell")]).cast("int"))
    return dealt, (centres, radii, masks, parts), seeds


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id", "mark", "window").orderBy(F.desc("score"), "who")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = 50, high: int = 95, scale: float = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each of the first ``positives`` rows of an anchor's label, the first ``negatives`` rows of other labels whose score is between ``low`` and
    ``high`` percent of the positive's. ``is_anchor``: a condition on ``id``.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double")).alias("x"))
    rows = stash(rows.distinct().select("id", F.xxhash64("label", "x").alias("mark"), "label", "x", F.size("x").alias("dim")), "candidates")
    dims = [r[0] for r in rows.select("dim").distinct().collect()]  # lengths of vectors
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    wide = {c: F.array(F.lit(int(v)).cast("bigint")) for c, v in (("low", _LOW), ("high", _HIGH))}
    for dim in dims:
        anchors = rows.where((F.col("dim") == dim) & is_anchor).withColumns(wide)
        search = _Search(rows, dim, positives, True)
        best = _ranked(search.answers(anchors), positives).select("id", "mark", "rank", F.col("who").alias("positive_id"), "score")
        best = stash(best.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("told")), "positives")  # ``positives`` at most
        score = F.transform("told", lambda t: t["score"].cast("decimal(38,0)"))
        # an anchor with few positives repeats an empty window, so that all have as many
        windows = {
            "low": F.transform(score, lambda s: F.ceil(s * low / F.lit(100)).cast("bigint")), "high": F.transform(score, lambda s: F.floor(s * high / F.lit(100)).cast("bigint")),
        }
        fill = {c: F.concat(w, F.array_repeat(F.lit(v).cast("bigint"), positives - F.size("told"))) for (c, w), v in zip(windows.items(), (1, 0), strict=True)}
        asks = anchors.drop("low", "high").join(best, ["id", "mark"]).withColumns(fill)
        search.k, search.same = negatives, False
        found = _ranked(search.answers(asks), negatives).join(best, ["id", "mark"])
        one = F.element_at("told", F.col("window") + 1)
        out = out.unionByName(found.select(F.col("id").alias("anchor_id"), one["positive_id"].alias("positive_id"), "rank", F.col("who").alias("negative_id"), one["score"].alias("positive_score"), F.col("score").alias("negative_score")))
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every embedding whose vec_id is divisible by 50."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("id") % 50 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {
    "op13_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.x) = len(c.x) WHERE a.vec_id % 50 = 0
),
pos AS (SELECT anchor_id, vec_id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3
"""
}
