"""N-gram Jaccard join over a tree of count vectors.

A document is the set of its distinct word shingles. Shingles are hashed into groups; the counts of a document's
shingles in the groups are its point. For sets of sizes a and b the overlap is at most the sum over groups of
the smaller count, and Jaccard >= t holds exactly if the overlap reaches t / (1 + t) * (a + b), that is, if the
sets differ in at most (a + b) * (1 - t) / (1 + t) shingles.

1. Lonely shingles. A shingle that no other set has can't be in an overlap, and a partner of a set of n shares at
   least t * n of them. So a set with more lonely shingles than (1 - t) * n has no partner. They are counted over all sets in
   two steps: among a share of the shingles (by hash), then, for the sets that are left, among all of them.
   What is left is reduced by its lonely shingles, which takes them off the overlap and off the limit of the distance.
2. Cells. A set of size class c (with limit E) and u lonely shingles may differ from partners in E - u more. For
   d = 0, 1, 2..3, 4..7, ... up to that, the groups are cut into d + 1 + e blocks, half as wide at each level: two points that differ in at most
   d agree in all counts of e + 1 blocks at least. So a node files under (class, level, block, counts of the block), and a
   pair is looked for at one level alone, that of E less the lonely shingles of both. Empty blocks tell nothing, so they are not filed: a set with more
   than e of them is cut once more, by another hash of its shingles (only after ``DEPTHS`` hashes are empty blocks filed).
3. The tree. The points of a cell are bulk-loaded into an R-tree: median splits at the coordinate of widest spread, and in each node the least and
   greatest counts, sizes and numbers of lonely shingles. Node is held against node from the root down: the sum of minima of the greatest counts, and
   what the least counts of one exceed the other's greatest by, bound the overlap of all pairs. Leaves that are left meet point by point, and the sum
   of minima of two points bounds the overlap of the pair. Survivors are verified on their sets. Cells of more than ``PART`` points are first dealt into parts by
   the mean of their widest coordinates, and part meets part only where their boxes let a pair through.

Groups of copies are not expanded into pairs: equal sets are one node from the start. A first pass compares each
node with the smallest node of its cells, a second one with the smallest node of each of its cells that is still in
another component. The nodes that are then in different components of a cell are searched through the tree,
all pairs that the bounds let through and that were not tried yet, so no link between components is lost.

Shingles and sets are compared by 64-bit hashes. Joins with whole texts are merge joins at every size, the others are left to Spark's size estimates.

Edge cases: a null text, or one without words, has an empty set and links with nothing (component_id is its own
doc_id); a text with fewer words than a shingle is one shingle of all its words; repeated rows and equal texts
fall together; null ids are allowed (component_id ignores them, and is null if no member has an id); extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import Scratch, fresh, read, stash, text_slices, worker_memo
from tidewatch.llm.components import components

#: Coordinates of the points that bounds are computed on.
GROUPS = 64
#: Groups in each block that cells are made of (fewer where there are more than 2^15 blocks).
BLOCK_GROUPS = 65_536
#: Hashes that a set with too many empty blocks is cut by.
DEPTHS = 6
#: Shingles of the sets whose cells a task makes at a time.
FILED = 200_000
#: Points of a leaf, and of a part of a cell (about).
LEAF, PART = 32, 4096
#: Points whose trees a task holds at a time, and pairs of nodes or points that it compares at a time.
SEARCHED, COMPARED = 20_000, 10_000
#: Share of a set's shingles that the first search for lonely ones looks at, as a multiple of 1 - t.
SHARE = 1.75

_U = np.uint64
_RANDOM = np.random.default_rng(20)  # fixed: nodes and keys must be the same in every task
_BYTE = _RANDOM.integers(1, 2**63, 256, _U) * _U(2) + _U(1)
_WORD = _RANDOM.integers(1, 2**63, 16, _U) * _U(2) + _U(1)
_P, _P_INVERSE = (int(x) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads differences."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, p in enumerate((_P, _P_INVERSE)):
            steps = np.full(n, p, _U)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=_U)
    return _POWERS


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    word = _mix((total[end] - total[start]) * inverse[start])
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = len(word)
    whole = np.zeros(max(0, n - width + 1), _U)
    for j in range(width if len(whole) else 0):
        whole += word[j : j + len(whole)] * _WORD[j]
    whole = _mix(whole)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(_mix((word[a:b] * _WORD[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a)))
        else:
            out.append(np.empty(0, _U))
    return out


class Limits:
    """Size classes and distance limits for a Jaccard threshold num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.begin = [1]

    def class_of(self, n: int) -> int:
        while self.begin[-1] <= n:
            self.begin.append(max(self.begin[-1] + 1, self.begin[-1] * 11 * self.den // (10 * self.num)))
        return int(np.searchsorted(self.begin, n, side="right")) - 1

    def distance(self, c: int) -> int:
        """The largest distance of two linked sets whose larger size is in class c."""
        return 2 * (self.begin[c + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def spare(self, n: int) -> int:
        """So many shingles that no partner has rule all partners of a set of n out."""
        return n - -(-n * self.num // self.den) + 1

    def spare_of(self, n: str) -> Column:
        return F.expr(f"{n} - ({n} * {self.num} + {self.den - 1}) div {self.den} + 1")

    def blocks(self, c: int, most: int) -> int:
        """How many blocks a level for ``most`` differences has: one more, and as many more as are often empty."""
        m = most + 1
        empty = m * math.exp(-max(1, self.begin[c] * self.num // self.den) / m)
        return m if empty < 0.5 else m + int(empty + 2 * math.sqrt(empty)) + 1

    def cells(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells of a set of n shingles, h of which are not lonely: their keys, and for each the least and the
        greatest number of lonely shingles that the two sets of a pair looked for in it have together."""
        out, lonely = [], n - len(h)
        for c in range(self.class_of(n), self.class_of(n * self.den // self.num) + 1):
            limit, low, high = self.distance(c), 0, 0
            while low <= limit - lonely:
                most = min(high, limit)
                m = self.blocks(c, most)
                wide = min(BLOCK_GROUPS, 2**31 // m)
                for depth in range(DEPTHS):
                    own = h if not depth else np.sort(_mix(h ^ _U(depth)))
                    group = (own >> _U(32)) * _U(m * wide) >> _U(32)
                    total = np.zeros(len(h) + 1, _U)
                    np.cumsum(_mix(group + _U(1)), out=total[1:])
                    cut = np.searchsorted(group, np.arange(m + 1, dtype=_U) * _U(wide))
                    filled = cut[1:] > cut[:-1]
                    counts = total[cut[1:]] - total[cut[:-1]]  # the same for equal counts in all groups of a block
                    key = _mix(counts ^ _mix(np.arange(m, dtype=_U) + _U((c << 48) + (m << 24)) + _mix(np.full(1, depth, _U))))
                    key = key if depth == DEPTHS - 1 else key[filled]
                    out.append((key, np.full(len(key), limit - most), np.full(len(key), limit - low)))
                    if m - filled.sum() < m - most:
                        break  # of the blocks that a partner agrees in, one is filled
                low, high = high + 1, 2 * high + 1
        if not out:
            return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def needed(self, total: Column) -> Column:
        """The least overlap of linked sets whose sizes add up to ``total``."""
        return F.ceil(total * F.lit(self.num) / F.lit(self.num + self.den) - F.lit(1e-9))

    def need(self, total: np.ndarray) -> np.ndarray:
        return -(-total.astype(np.int64) * self.num // (self.num + self.den))

    def linked(self, overlap: int, total: int) -> bool:
        return self.den * overlap >= self.num * (total - overlap)


def _node(h: np.ndarray) -> int:
    """A set's number: a hash of the whole set."""
    return int(_mix(_mix(h).sum(dtype=_U, keepdims=True) + _U(len(h))).view(np.int64)[0])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _row() -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64("doc_id", F.xxhash64(_text()))


def signatures(docs: DataFrame, width: int, share: float) -> DataFrame:
    """doc_id, row, n, node and some (that share of the shingles, by hash) of every document."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("row", "n", "node")), T.StructField("some", T.ArrayType(T.LongType()))])
    most = _U(min(2**64 - 1, int(share * 2**64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo("ngram join")  # other operators' memos leave memory
        for batch in batches:
            for i, j in text_slices(batch, 2):
                part = batch.slice(i, j - i)
                sets = shingle_sets(part.column(2).to_pylist(), width)
                some = [h[h * _U(_P) <= most].view(np.int64) for h in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(h) for h in sets], pa.int64()), pa.array([_node(h) for h in sets], pa.int64()), _lists(some, pa.int64())], schema.names)

    return docs.select("doc_id", _row().alias("row"), _text().cast("binary").alias("text")).mapInArrow(run, schema)


def _lonely(sets: DataFrame, shingles: str) -> DataFrame:
    """node and shingle: those that a single node has. Counted in each task first, so a frequent shingle costs a row a task."""
    filed = sets.select("node", F.explode(shingles).alias("shingle"))
    return filed.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where(F.col("node") == F.col("last")).select("node", "shingle")


def _sets(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """node and shingles of the chosen rows (node, row). These grow with the corpus, so the join is a merge at every size."""
    texts = docs.select(_row().alias("row"), _text().cast("binary").alias("text")).join(chosen.select("node", "row").hint("merge"), "row").dropDuplicates(["row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch, 1):
                part = batch.slice(i, j - i)
                own = shingle_sets(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([h.view(np.int64) for h in own], pa.int64())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def _filed(sets: DataFrame, limits: Limits) -> DataFrame:
    """node, n, lonely, point, shingles (those not lonely) and cells of the sets (node, shingles, alone) that may have partners."""
    schema = "node bigint, n bigint, lonely bigint, point array<int>, shingles binary, keys array<bigint>, least array<int>, most array<int>"
    names = ["node", "n", "lonely", "point", "shingles", "keys", "least", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo("ngram join")
        for batch in batches:
            # so many rows at a time that cells of long sets don't pile up
            size = np.cumsum(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64) + 400) // FILED
            cuts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]][: len(size)])
            for i, j in zip(cuts, np.r_[cuts[1:], len(size)], strict=True):
                part = batch.slice(i, j - i)
                at, n, held, cells = [], [], [], []
                for k in range(part.num_rows):
                    h, alone = (np.asarray(part.column(c)[k].values).astype(np.int64).view(_U) if part.column(c)[k].is_valid else np.empty(0, _U) for c in (1, 2))
                    if len(alone) < limits.spare(len(h)):
                        own = h[~np.isin(h, alone)]
                        at.append(k)
                        n.append(len(h))
                        held.append(own)
                        cells.append(limits.cells(own, len(h)))
                points = [np.bincount((h & _U(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32) for h in held]
                lonely = [a - len(h) for a, h in zip(n, held, strict=True)]
                columns = [part.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(lonely, pa.int64()), _lists(points, pa.int32()), pa.array([h.tobytes() for h in held], pa.binary())]
                columns += [_lists([x[0].view(np.int64) for x in cells], pa.int64()), *(_lists([x[k].astype(np.int32) for x in cells], pa.int32()) for k in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return sets.select("node", "shingles", "alone").mapInArrow(run, schema)


def _overlap_bound(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)


def _verified(pairs: DataFrame, nodes: DataFrame, limits: Limits, own: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes that are linked: the bound by points, then the sets."""
    points = nodes.select("node", "n", "lonely", "point")
    near = pairs.join(points.toDF("a", "na", "ua", "pa"), "a").join(points.toDF("b", "nb", "ub", "pb"), "b")
    total = F.col("na") + F.col("nb")
    near = near.where((F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub")) >= limits.needed(total)) & (_overlap_bound("pa", "pb") >= limits.needed(total)))
    near = own.keep(near.select("a", "b", total.alias("total")), "near")
    sets = nodes.select("node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, total in zip(batch.column(3), batch.column(4), batch.column(2).to_pylist(), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
                keep.append(limits.linked(len(np.intersect1d(x, y, assume_unique=True)), total))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "total", "x", "y")
    return own.keep(joined.mapInArrow(run, "a bigint, b bigint"), "linked")


class Trees:
    """R-trees over the points of many cells. ``x``: counts, then lonely shingles and size, of each point.

    A tree is built for each side of each group of rows; a group with one side is held against itself.
    """

    def __init__(self, x: np.ndarray, roots: np.ndarray, sides: list[tuple[int, int]]) -> None:
        self.x, self.roots, self.order = x, roots, np.arange(len(x))
        self.nodes: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        self.tops = []
        for a, b in sides:
            self.tops.append(len(self.nodes))
            self._build(a, b)
        at = np.array(self.nodes, np.int64).reshape(-1, 2)
        self.begin, self.end = at[:, 0], at[:, 1]
        self.child = np.array(self.children, np.int64).reshape(-1, 2)
        self.low, self.high = (np.zeros((len(at), x.shape[1]), x.dtype) for _ in range(2))
        self.one_root = np.zeros(len(at), bool)
        self.root = np.zeros(len(at), np.int64)
        for i in range(len(at) - 1, -1, -1):  # children have greater numbers
            l, r = self.child[i]
            if l < 0:
                rows = self.order[self.begin[i] : self.end[i]]
                own, told = x[rows], roots[rows]
                self.low[i], self.high[i], self.root[i], self.one_root[i] = own.min(0), own.max(0), told[0], (told == told[0]).all()
            else:
                self.low[i], self.high[i] = np.minimum(self.low[l], self.low[r]), np.maximum(self.high[l], self.high[r])
                self.root[i], self.one_root[i] = self.root[l], self.one_root[l] and self.one_root[r] and self.root[l] == self.root[r]

    def _build(self, a: int, b: int) -> int:
        me = len(self.nodes)
        self.nodes.append((a, b))
        self.children.append((-1, -1))
        if b - a > LEAF:
            rows = self.order[a:b]
            own = self.x[rows]
            widest = int(own.var(0).argmax())
            middle = (b - a) // 2
            self.order[a:b] = rows[np.argsort(own[:, widest], kind="stable")]
            left = self._build(a, a + middle)
            self.children[me] = left, self._build(a + middle, b)
        return me

    def meet(self, pairs: np.ndarray, least: np.ndarray, most: np.ndarray, limits: Limits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j) of different roots that the bounds let through. ``pairs``: nodes to begin with; least and most:
        bounds of the lonely shingles of both, for each."""
        while len(pairs):
            a, b = pairs.T
            ready, later = [], []
            for i in range(0, len(pairs), COMPARED):
                s = slice(i, i + COMPARED)
                p, q = a[s], b[s]
                lowp, highp, lowq, highq = self.low[p], self.high[p], self.low[q], self.high[q]
                bound = np.minimum(highp[:, :GROUPS], highq[:, :GROUPS]).sum(1)
                # what one has at least beyond what the other has at most is not in the overlap
                bound = np.minimum(bound, highp[:, -1] - lowp[:, -2] - np.maximum(lowp[:, :GROUPS] - highq[:, :GROUPS], 0).sum(1))
                bound = np.minimum(bound, highq[:, -1] - lowq[:, -2] - np.maximum(lowq[:, :GROUPS] - highp[:, :GROUPS], 0).sum(1))
                keep = (bound >= limits.need(lowp[:, -1] + lowq[:, -1])) & (lowp[:, -2] + lowq[:, -2] <= most[s]) & (highp[:, -2] + highq[:, -2] >= least[s])
                keep &= ~(self.one_root[p] & self.one_root[q] & (self.root[p] == self.root[q]))
                leaves = (self.child[p, 0] < 0) & (self.child[q, 0] < 0)
                ready.append(i + np.flatnonzero(keep & leaves))
                later.append(i + np.flatnonzero(keep & ~leaves))
            ready, later = np.concatenate(ready), np.concatenate(later)
            yield from self._points(pairs[ready], least[ready], most[ready], limits)
            new, kept = [], []
            p, q = pairs[later].T
            own = p == q
            l, r = self.child[p].T
            for x, y, on in ((l, l, own), (l, r, own), (r, r, own)):
                new.append(np.stack([x, y], 1)[on])
                kept.append(later[on])
            # of two nodes the one with more points is opened
            swap = ~own & ((self.child[p, 0] < 0) | ((self.child[q, 0] >= 0) & (self.end[q] - self.begin[q] > self.end[p] - self.begin[p])))
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            for side in range(2):
                new.append(np.stack([self.child[p, side], q], 1)[~own])
                kept.append(later[~own])
            pairs, kept = np.concatenate(new), np.concatenate(kept)
            least, most = least[kept], most[kept]

    def _points(self, pairs: np.ndarray, least: np.ndarray, most: np.ndarray, limits: Limits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(pairs):
            return
        sizes = self.end - self.begin
        n = sizes[pairs[:, 0]] * sizes[pairs[:, 1]]
        ends = np.cumsum(n)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]), COMPARED), side="right"))
        for s, e in zip(cuts, np.r_[cuts[1:], len(n)], strict=True):
            p, q, m = pairs[s:e, 0], pairs[s:e, 1], n[s:e]
            which = np.repeat(np.arange(e - s), m)
            k = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
            i, j = self.order[self.begin[p][which] + k // sizes[q][which]], self.order[self.begin[q][which] + k % sizes[q][which]]
            keep = (self.roots[i] != self.roots[j]) & ((p != q)[which] | (i < j))
            i, j, which = i[keep], j[keep], which[keep]
            lonely = self.x[i, -2] + self.x[j, -2]
            needed = limits.need(self.x[i, -1] + self.x[j, -1])
            keep = (lonely >= least[s:e][which]) & (lonely <= most[s:e][which]) & (np.minimum(self.x[i, -1] - self.x[i, -2], self.x[j, -1] - self.x[j, -2]) >= needed)
            i, j, needed = i[keep], j[keep], needed[keep]
            keep = np.minimum(self.x[i, :GROUPS], self.x[j, :GROUPS]).sum(1) >= needed
            yield i[keep], j[keep]


def _searched(batch: pa.Table, limits: Limits) -> Iterator[pa.RecordBatch]:
    """The pairs of nodes that the trees of some groups (key, p, q) let through; rows are in order of group and side."""
    key, p, q, side, node, root, lonely, size, least, most = (batch.column(c).to_numpy() for c in ("key", "p", "q", "side", "node", "root", "lonely", "n", "least", "most"))
    points = batch.column("point").combine_chunks().flatten().to_numpy().reshape(-1, GROUPS)
    x = np.concatenate([points, lonely[:, None].astype(np.int32), size[:, None].astype(np.int32)], 1)
    group = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
    sides, begin = [], []
    for a, b in zip(group, np.r_[group[1:], len(key)], strict=True):
        middle = a + int(np.searchsorted(side[a:b], 1))
        if p[a] == q[a]:
            sides.append((a, b))
            begin.append((len(sides) - 1, len(sides) - 1, a))
        elif a < middle < b:
            sides += [(a, middle), (middle, b)]
            begin.append((len(sides) - 2, len(sides) - 1, a))
    trees = Trees(x, root, sides)
    tops = np.array([(trees.tops[i], trees.tops[j]) for i, j, _ in begin], np.int64).reshape(-1, 2)
    first = np.array([a for _, _, a in begin], np.int64)
    for i, j in trees.meet(tops, least[first].astype(np.int64), most[first].astype(np.int64), limits):
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])


def _parts(points: DataFrame, limits: Limits, own: Scratch) -> DataFrame:
    """The points with group (key, p, q) and side: small cells as they are, large ones by pairs of parts whose boxes let a pair through."""
    sizes = points.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    large = own.keep(sizes.where(F.col("size") > PART), "large")
    small = points.join(large, "key", "left_anti").withColumns({"p": F.lit(0), "q": F.lit(0), "side": F.lit(0)})
    if large.isEmpty():
        return small
    hot = own.keep(points.join(large, "key"), "hot")
    spread = hot.groupBy("key").agg(*(f(F.col("point")[i]).alias(f"{n}{i}") for i in range(GROUPS) for n, f in (("v", F.var_pop), ("m", F.avg))))
    axes = F.slice(F.sort_array(F.array(*(F.struct(F.col(f"v{i}").alias("v"), F.lit(i).alias("i"), F.col(f"m{i}").alias("m")) for i in range(GROUPS))), asc=False), 1, 16)
    hot = hot.join(spread.select("key", axes.alias("axes")), "key")
    bits = F.least(F.lit(16), F.ceil(F.log2(F.col("size") / F.lit(PART))) + 1).cast("int")
    code = F.aggregate(F.slice("axes", F.lit(1), bits), F.lit(0), lambda v, x: v * 2 + (F.get(F.col("point"), x["i"]) > x["m"]).cast("int"))
    hot = own.keep(hot.withColumn("code", code).drop("axes", "size"), "coded")
    # points that no coordinate tells apart are dealt by hash
    deal = hot.groupBy("key", "code").agg(F.count(F.lit(1)).alias("held"))
    part = F.col("code") * 65536 + F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / F.lit(PART))).cast("int") % 65536
    hot = own.keep(hot.join(deal, ["key", "code"]).withColumn("part", part).drop("code", "held"), "parts")
    boxes = hot.groupBy("key", "part").agg(F.min("n").alias("n"), F.array(*(F.max(F.col("point")[i]) for i in range(GROUPS))).alias("box"))
    pairs = boxes.select("key", F.col("part").alias("p"), F.col("n").alias("np"), F.col("box").alias("bp")).join(boxes.select("key", F.col("part").alias("q"), F.col("n").alias("nq"), F.col("box").alias("bq")), "key")
    pairs = own.keep(pairs.where((F.col("p") <= F.col("q")) & (_overlap_bound("bp", "bq") >= limits.needed(F.col("np") + F.col("nq")))).select("key", "p", "q"), "part-pairs")
    left = hot.withColumnRenamed("part", "p").join(pairs, ["key", "p"]).withColumn("side", F.lit(0))
    right = hot.withColumnRenamed("part", "q").join(pairs.where("p < q"), ["key", "q"]).withColumn("side", F.lit(1))
    return small.unionByName(left).unionByName(right)


def _across(members: DataFrame, roots: DataFrame, nodes: DataFrame, tried: DataFrame, limits: Limits, own: Scratch) -> DataFrame:
    """Untried pairs of nodes of one cell but different components, as far as boxes and points let them through."""
    now = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # in a cell of two nodes the only pair was tried in the first passes
    split = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where((F.col("lo") != F.col("hi")) & (F.col("n") > 2)).select("key")
    now = own.keep(now.join(split, "key").select("key", "node", "root", "least", "most"), "split")
    points = own.keep(now.join(nodes.select("node", "n", "lonely", "point"), "node"), "points")
    dealt = _parts(points, limits, own)
    names = ["key", "p", "q", "side", "node", "root", "lonely", "n", "point", "least", "most"]
    dealt = dealt.select(names).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= SEARCHED:
                rows = pa.Table.from_batches(held)
                last = [rows.column(c)[-1].as_py() for c in ("key", "p", "q")]
                open_ = np.logical_and.reduce([rows.column(c).to_numpy() == v for c, v in zip(("key", "p", "q"), last, strict=True)])
                done = len(open_) - int(open_.sum())  # the last group may go on
                if done:
                    yield from _searched(rows.slice(0, done), limits)
                    held = rows.slice(done).to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield from _searched(rows, limits)

    pairs = dealt.mapInArrow(run, "a bigint, b bigint").distinct()
    return own.keep(pairs.join(tried, ["a", "b"], "left_anti"), "more")


def _roots(docs: DataFrame, signed: DataFrame, width: int, limits: Limits, own: Scratch) -> DataFrame:
    """node and root (the smallest node of its component) of every node that isn't its own root."""
    nodes = signed.where(F.col("n") > 0).groupBy("node").agg(F.min("n").alias("n"), F.min("row").alias("row"))
    known = _lonely(signed, "some").groupBy("node").agg(F.count(F.lit(1)).alias("known"))
    alive = nodes.join(known, "node", "left").where(F.coalesce("known", F.lit(0)) < limits.spare_of("n"))
    sets = own.keep(_sets(docs, own.keep(alive.select("node", "row"), "alive"), width), "sets")
    alone = _lonely(sets, "shingles").groupBy("node").agg(F.collect_list("shingle").alias("alone"))  # no more than the set has
    nodes = own.keep(_filed(sets.join(alone, "node", "left"), limits), "nodes")
    filed = nodes.select("node", F.explode(F.arrays_zip("keys", "least", "most")).alias("c")).select("node", F.col("c.keys").alias("key"), "c.least", "c.most")
    shared = filed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where(F.col("first") != F.col("last")).select("key", "first")
    members = own.keep(filed.join(shared, "key").select("key", "node", "first", "least", "most"), "members")
    others = members.where(F.col("node") != F.col("first"))
    tried = own.keep(others.groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a")).select("a", "b"), "tried")
    links = _verified(tried, nodes, limits, own)
    roots = components(links, "a", "b", own.keep)
    # the smallest nodes of other cells, as far as they are still apart
    apart = others.join(roots, "node", "left").join(roots.toDF("first", "first_root"), "first", "left").where(F.coalesce("root", "node") != F.coalesce("first_root", "first"))
    stars = own.keep(apart.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "stars")
    links = links.union(_verified(stars, nodes, limits, own))
    roots = components(links, "a", "b", own.keep)
    more = _across(members.select("key", "node", "least", "most"), roots, nodes, tried.union(stars), limits, own)
    return components(links.union(_verified(more, nodes, limits, own)), "a", "b", own.keep)


def join_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, root and row of every document, linked at Jaccard >= num / den."""
    limits = Limits(num, den)
    with Scratch(docs.sparkSession, "ngram-join") as own:
        signed = own.keep(signatures(docs, width, SHARE * (den - num) / den), "signed")
        roots = _roots(docs, signed, width, limits, own)
        placed = signed.select("doc_id", "row", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = own.keep(placed, "placed")
        least = placed.where(F.col("n") > 0).groupBy("root").agg(F.min("doc_id").alias("component_id"))
        id_of = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return stash(placed.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), id_of.alias("component_id"), "root", "row"), "components")


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near copies: of each component the one of the smallest doc_id (nulls last), ties by
    a hash of id and text; documents without words all stay. Rows equal in id and text stay or go together; all
    columns of ``docs`` come back as they are."""
    found = join_components(docs, width, num, den)
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")
    first = found.where(F.col("n_shingles") > 0).groupBy("root").agg(F.min(order).alias("s")).select("root", F.col("s.row").alias("first"))
    gone = found.where(F.col("n_shingles") > 0).join(first, "root").where(F.col("row") != F.col("first"))
    row = fresh("row", docs)
    return docs.withColumn(row, _row()).join(gone.select(F.col("row").alias(row)).distinct().hint("merge"), row, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at a Jaccard of 0.9 or more of their sets of 3-word shingles."""
    return join_components(read(spark, sf_dir, "documents"), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
ORACLE: dict[str, str] = {}
