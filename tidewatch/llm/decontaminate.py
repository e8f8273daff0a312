"""Benchmark decontamination: suffix arrays over the training texts, searched for every suffix of the test texts.

A window is ten consecutive words of a test item; an item with fewer words, but some, is one window.

1. The test items are cut into pieces that overlap by a window less a word, and the pieces are dealt into blocks of
   about ``block_words`` words. A block is the only thing that is broadcast, so what a task holds of the test
   set has a bound at every size of it; a larger test set takes more passes over the documents, one block each.
2. Each slice of documents (a shard of the training set) is coded by the block's words. Words that no n-gram of the
   block covers end a suffix, as the end of a document does; no window can reach across them. A suffix array of what
   is left is made by doubling the length that ranks compare.
3. Every test suffix is searched in it by bisection, word by word: the interval of suffixes that begin with its window
   holds all places where the window occurs. Windows in line (same item, places that advance together) join
   to the longest verbatim match.

Nothing of the documents is shuffled if the test set fits a block; else only the marks of hit documents are.

Edge cases: a null text has no words and no hits; words are runs of 0-9, a-z (A-Z are lower-cased) and all letters and signs beyond
ASCII; a null item id is written as an empty string; rows of one item id count as one item; items without words match
nothing; repeated documents are treated alike; very long documents are one slice; empty tables give no hits; other
columns pass through, and added ones get other names where these are taken (``n_hit_``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, fresh, read, stash, text_slices

WIDTH = 10
#: Words of test items that a task holds at a time.
BLOCK_WORDS = 200_000
#: Words of a piece of a test item.
PIECE_WORDS = 4096
#: Bytes of text of a shard.
SHARD_BYTES = 4_000_000
#: Words of more bytes are known by a digest.
LONG_WORD = 64
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.translate(_TO_WORDS).split() if text else []


def _short(w: bytes) -> bytes:
    return w if len(w) <= LONG_WORD else b"\x00" + hashlib.blake2b(w, digest_size=32).digest()


class Block:
    """Windows of some pieces of test items, coded by the block's own words (from 1)."""

    def __init__(self, pieces: list[tuple[str, int, int, list[bytes]]], width: int = WIDTH) -> None:
        self.code: dict[bytes, int] = {}
        self.items = sorted({p[0] for p in pieces})
        number = {x: i for i, x in enumerate(self.items)}
        grams, rows, owner, place = [], [], [], []
        for item, start, total, words in pieces:
            w = min(width, total)
            ids = np.array([self.code.setdefault(x, len(self.code) + 1) for x in words], np.int64)
            if not w or len(ids) < w:
                continue
            own = np.zeros((len(ids) - w + 1, width), np.int64)
            own[:, :w] = np.lib.stride_tricks.sliding_window_view(ids, w)
            rows.append(own)
            owner.append(np.full(len(own), number[item]))
            place.append(start + np.arange(len(own)))
        self.long_words = any(w[:1] == b"\x00" for w in self.code)
        rows = np.concatenate(rows) if rows else np.zeros((0, width), np.int64)
        self.windows, which = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.windows > 0).sum(1)
        # the first place of each window in each of its items, by window
        own = np.concatenate([which.reshape(-1, 1), np.concatenate(owner)[:, None], np.concatenate(place)[:, None]], 1) if len(rows) else np.zeros((0, 3), np.int64)
        own = own[np.lexsort(own.T[::-1])]
        own = own[np.r_[True, (own[1:, :2] != own[:-1, :2]).any(1)][: len(own)]]
        self.owner, self.place = own[:, 1], own[:, 2]
        self.first = np.searchsorted(own[:, 0], np.arange(len(self.windows) + 1))
        # windows of equal sets of items
        sets: dict[bytes, int] = {}
        self.of_set = np.array([sets.setdefault(self.owner[a:b].tobytes(), len(sets)) for a, b in zip(self.first, self.first[1:], strict=False)], np.int64)
        self.sets = [np.frombuffer(k, np.int64) for k in sets]
        self.gram = int(min(3, self.lengths.min(initial=3)))
        grams = [self._grams(self.windows[:, i : i + self.gram]) for i in range(width - self.gram + 1)]
        self.grams = np.unique(np.concatenate([g[(self.windows[:, i + self.gram - 1] > 0)] for i, g in enumerate(grams)])) if len(self.windows) else np.zeros(0, np.int64)

    def _grams(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for c in x.T:
            out = out * (len(self.code) + 1) + c
        return out

    def coded(self, words: list[bytes]) -> np.ndarray:
        if self.long_words:
            words = list(map(_short, words))
        get = self.code.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def covered(self, text: np.ndarray) -> np.ndarray:
        """Places of a text that an n-gram of the block covers."""
        n = len(text) - self.gram + 1
        out = np.zeros(len(text) + 1, np.int64)
        if n > 0 and len(self.grams):
            g = self._grams(np.lib.stride_tricks.sliding_window_view(text, self.gram))
            known = (np.lib.stride_tricks.sliding_window_view(text, self.gram) > 0).all(1)
            known[known] = self.grams[np.minimum(np.searchsorted(self.grams, g[known]), len(self.grams) - 1)] == g[known]
            at = np.flatnonzero(known)
            np.add.at(out, at, 1)
            np.add.at(out, at + self.gram, -1)
        return np.cumsum(out)[:-1] > 0


class SuffixArray:
    """The suffixes of a coded text in order; 0 ends a suffix."""

    def __init__(self, text: np.ndarray) -> None:
        self.text = np.r_[text, 0].astype(np.int64)
        n = len(self.text)
        ends = np.flatnonzero(self.text == 0)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words up to the end of the suffix
        values, rank = np.unique(self.text, return_inverse=True)
        classes, k = len(values), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:]
            values, rank = np.unique(rank * (classes + 1) + np.where(left > k, after, 0), return_inverse=True)
            if len(values) == classes or (k := 2 * k) >= n:
                break
            classes = len(values)
        order = np.argsort(rank, kind="stable")
        self.order = order[self.text[order] > 0]

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while len(more := np.flatnonzero(low < high)):
            mid = (low[more] + high[more]) >> 1
            seen = self.text[self.order[mid] + depth]  # these suffixes have depth words at least, and the text ends in 0
            right = (seen <= want[more]) if after else (seen < want[more])
            low[more], high[more] = np.where(right, mid + 1, low[more]), np.where(right, high[more], mid)
        return low

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes that begin with each window are in the order: (from, to)."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.order), np.int64)
        for depth in range(windows.shape[1]):
            on = np.flatnonzero((lengths > depth) & (low < high))
            if not len(on):
                break
            a, b, want = low[on], high[on], windows[on, depth]
            low[on] = self._bound(a, b, depth, want, False)
            high[on] = self._bound(low[on], b, depth, want, True)
        return low, high


def _hits(block: Block, shard: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, window) of all occurrences in a shard of coded documents."""
    sizes = np.array([len(d) for d in shard])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    for at, d in zip(begin, shard, strict=True):
        text[at : at + len(d)] = d
    covered = block.covered(text)
    kept = np.flatnonzero(covered | np.r_[False, covered[:-1]])  # and one end after each run
    if not len(kept):
        none = np.zeros(0, np.int64)
        return none, none, none
    suffixes = SuffixArray(np.where(covered, text, 0)[kept])
    low, high = suffixes.search(block.windows, block.lengths)
    n = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(n)), n)
    at = kept[suffixes.order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
    document = np.searchsorted(begin, at, side="right") - 1
    return document, at - begin[document], window


def _joined(document: np.ndarray, start: np.ndarray, end: np.ndarray, *line: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of a document (and of a line) that meet or overlap as one: (document, start, end, *line)."""
    order = np.lexsort((start, *line[::-1], document))
    document, start, end, *line = (x[order] for x in (document, start, end, *line))
    if not len(start):
        return document, start, end, *line
    group = np.cumsum(np.r_[False, (document[1:] != document[:-1]) | np.logical_or.reduce([x[1:] != x[:-1] for x in line] or [np.zeros(len(start) - 1, bool)])])
    far = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(far + end)
    new = np.r_[True, (far + start)[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)] - 1
    return document[first], start[first], (reach - far)[last], *(x[first] for x in line)


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """values by row, for n rows; ``rows`` is in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def _spans(start: np.ndarray, end: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["from", "to"])


SPANS = "array<struct<from: bigint, to: bigint>>"
MATCHES = "array<struct<item_id: string, item_word: bigint, doc_word: bigint, n_words: bigint>>"


def _marked(batch: pa.RecordBatch, column: int, block: Block) -> Iterator[tuple[int, list[pa.Array]]]:
    """Rows so far, and n_words, spans, items and matches of the next rows."""
    for a, b in text_slices(batch, column, SHARD_BYTES):
        texts = batch.column(column).slice(a, b - a).cast(pa.binary()).to_pylist()
        shard = [block.coded(words_of(t)) for t in texts]
        n = b - a
        doc, word, window = _hits(block, shard)
        d, s, e = _joined(doc, word, word + block.lengths[window])
        pairs = np.unique(np.stack([doc, block.of_set[window]], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        told = [(i, x) for i, k in pairs for x in block.sets[k]]
        told = np.unique(np.array(told, np.int64), axis=0) if told else np.zeros((0, 2), np.int64)
        items = _lists(told[:, 0], n, pa.array([block.items[i] for i in told[:, 1]], pa.string()))
        # matches in line: each occurrence with the items of its window
        many = block.first[window + 1] - block.first[window]
        pick = np.repeat(block.first[window], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        md, mw, ml = (np.repeat(x, many) for x in (doc, word, block.lengths[window]))
        md, ms, me, mi, shift = _joined(md, mw, mw + ml, block.owner[pick], mw - block.place[pick])
        match = pa.StructArray.from_arrays([pa.array([block.items[i] for i in mi], pa.string()), pa.array(ms - shift, pa.int64()), pa.array(ms, pa.int64()), pa.array(me - ms, pa.int64())], ["item_id", "item_word", "doc_word", "n_words"])
        yield a, [pa.array([len(x) for x in shard], pa.int64()), _lists(d, n, _spans(s, e)), items, _lists(md, n, match)]


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """item, start, total, words (joined by spaces) of the pieces of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = list(map(_short, words_of(text)))
                for i in range(0, max(len(words) - width + 1, 1) if words else 0, PIECE_WORDS):
                    # digests may hold any byte, so words go as hexadecimal
                    own = b" ".join(w.hex().encode() for w in words[i : i + PIECE_WORDS + width - 1])
                    yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([i], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([own.decode()])], ["item", "start", "total", "words"])

    told = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return told.mapInArrow(run, "item string, start bigint, total bigint, words string")


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with n_words, n_hit, hit_spans (words [from, to)), hit_items (as text, in order) and matches.

    ``matches`` are the longest verbatim matches: item_id, item_word, doc_word and n_words; of a window that an item holds
    several times the first place is told.
    """
    spark = docs.sparkSession
    with Scratch(spark, "pieces") as scratch:
        pieces = scratch.keep(_pieces(benchmark, item_col, item_text, width), "pieces")
        total = pieces.agg(F.coalesce(F.sum(F.size(F.split("words", " "))), F.lit(0))).first()[0]
        n_blocks = max(1, -(-total // block_words))
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "start"), F.lit(n_blocks)))

        def block(b: int) -> Block:
            rows = dealt.where(F.col("block") == b).select("item", "start", "total", "words").toArrow().to_pylist()  # about block_words words
            return Block([(r["item"], r["start"], r["total"], [bytes.fromhex(w) for w in r["words"].split(" ")]) for r in rows], width)

        names = [fresh(x, docs) for x in ("n_words", "hit_spans", "hit_items", "matches")]
        kinds = ["bigint", SPANS, "array<string>", MATCHES]
        columns, at = docs.columns, docs.columns.index(text_col)

        def passed(df: DataFrame, b: int) -> DataFrame:
            sent = spark.sparkContext.broadcast(block(b))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for a, new in _marked(batch, at, sent.value):
                        own = batch.slice(a, len(new[0]))
                        yield pa.RecordBatch.from_arrays([*own.columns, *new], [*own.schema.names, *names])

            schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {n} {k}" for n, k in zip(names, kinds, strict=True))
            return df.mapInArrow(run, schema)

        if n_blocks == 1:
            out = passed(docs, 0)
        else:
            # further blocks mark hit documents only; a row is known by its id and text
            row = fresh("row", docs)
            keyed = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c, k in docs.dtypes if k in ("bigint", "int", "string")]))
            more = None
            for b in range(1, n_blocks):
                hit = stash(passed(keyed, b).where(F.size(names[2]) > 0).select(row, *names[1:]).dropDuplicates([row]), "hits")
                more = hit if more is None else more.unionByName(hit)
            more = more.groupBy(row).agg(*[F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in names[1:]])
            both = passed(keyed, 0).join(more.hint("merge"), row, "left")
            joined = {c: F.array_distinct(F.concat(F.col(c), F.coalesce(F.col(f"more_{c}"), F.array().cast(k)))) for c, k in zip(names[1:], kinds[1:], strict=True)}
            out = both.select(*(F.col(f"`{c}`") for c in columns), names[0], *(x.alias(c) for c, x in joined.items()))
    spans = F.array_sort(names[1])
    joined = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda acc, x: F.struct((acc.n + F.greatest(x["to"] - F.greatest(x["from"], acc["to"]), F.lit(0).cast("bigint"))).alias("n"), F.greatest(acc["to"], x["to"]).alias("to")),
        lambda acc: acc.n,
    )
    return out.select(*(F.col(f"`{c}`") for c in columns), names[0], joined.alias(fresh("n_hit", docs)), spans.alias(names[1]), F.array_sort(names[2]).alias(names[2]), names[3])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any window of the benchmark, with their own columns."""
    n_hit = fresh("n_hit", docs)
    return annotate(docs, benchmark, **options).where(F.col(n_hit) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of all documents against the whole benchmark."""
    found = annotate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op11_decontaminate": op11_decontaminate}
ORACLE = {
    "op11_decontaminate": r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
),
b AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
),
bw AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
),
hits AS (SELECT r, i, n, win FROM dw SEMI JOIN bw USING (n, win)),
places AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits JOIN bw USING (n, win)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
}
