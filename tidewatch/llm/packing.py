"""Best-fit packing of tokenised documents into sequences of fixed length, by length patterns.

1. Tasks tokenise whole texts, append id 0, cut only what is longer than a sequence, and return one row a
   piece (no ids): document, piece, start, length and checksum.
2. The histogram of lengths has at most ``capacity`` rows, whatever the size of the corpus. The driver
   plans on it alone: it enumerates patterns of up to three length classes that fill a sequence, fits
   their repeat counts to the histogram by non-negative least squares (Lawson and Hanson's active set),
   rounds down, and draws actual lengths for each pattern: the longest of each class, and for the last
   part just what is missing, as long as there is such a piece. What remains is packed by best fit over counts, into bins of its own. The plan's size depends on ``capacity`` alone.
3. Each piece finds its place by its length and its rank among the pieces of that length, which is
   counted in two salted steps. No text or piece passes through the driver or one task.

Edge cases: a null or empty text is the single id 0; repeated rows are packed once each; ids may be null
(they are only carried); an empty table gives an empty result; extra columns are ignored. Ties of rank
are broken by (doc_id, piece, checksum); rows equal in all of these may swap places.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import cut_at_spaces, read, salted_rank, stash, text_slices, worker_memo

CAPACITY = 2048
END_ID = 0
#: Chunks of text that a worker remembers at most, but for those of one slice.
MEMO = 700_000
#: Marks that are units of their own after a word of letters.
_MARKS = ".,;:!?"
#: Width of the length classes that patterns are made of.
CLASS_WIDTH = 32


class Tokenizer:
    """Ids of texts as little-endian 32-bit numbers; chunks between spaces or line ends are remembered.

    The tokenizer drops white space before it merges, so no token spans a space or a line end; the literals of its
    special tokens hold neither. A text that has such a literal gets the special token's id, as by the tokenizer's default.
    A word of letters is one unit for it, with its case folded, and a mark after it another; so such words are
    learnt many at a time, and each ends at a token that ends a word.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Own

        self.own = Own.from_file(path)
        self.path = path
        vocabulary = self.own.get_vocab()
        suffix = getattr(self.own.model, "end_of_word_suffix", None) or ""
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self.marks = dict(zip(_MARKS, self._one_by_one(list(_MARKS)), strict=True))

    @property
    def memo(self) -> dict[str, bytes]:
        return worker_memo(("packing", self.path))

    def _one_by_one(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, by one call for 500."""
        out: list[bytes] = []
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            ids = np.array(self.own.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # a tokenizer that doesn't mark the ends of words
                out += self._one_by_one(part)
                continue
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def learn(self, new: set[str]) -> None:
        words: dict[str, tuple[str, str]] = {}
        for c in new:
            core, mark = (c[:-1], c[-1]) if c[-1:] in self.marks else (c, "")
            if core.isalpha():
                words[c] = core.lower() if core.isascii() else core, mark
        cores = list({w for w, _ in words.values()})
        known = dict(zip(cores, self._words(cores), strict=True))
        marks = self.marks | {"": b""}
        memo = self.memo
        memo.update((c, known[w] + marks[mark]) for c, (w, mark) in words.items())
        rest = [c for c in new if c not in words]
        for i in range(0, len(rest), 20_000):
            memo.update(zip(rest[i : i + 20_000], self._one_by_one(rest[i : i + 20_000]), strict=True))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text ends."""
        pieces, number, end = cut_at_spaces(pc.replace_substring(texts, "\n", " "))
        memo = self.memo
        new = set(pieces).difference(memo)
        if len(memo) + len(new) > MEMO and memo:
            memo.clear()
            new = set(pieces)
        self.learn(new)
        known = list(map(memo.__getitem__, pieces))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        data, begin = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        sizes = size[number]
        done = np.cumsum(sizes)
        ids = data[np.repeat(begin[number] - (done - sizes), sizes) + np.arange(int(done[-1]) if len(done) else 0)]
        return ids, np.r_[0, done][end]


_TOKENIZERS: dict[str, Tokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the tokenised documents cut into pieces of at most capacity."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _TOKENIZERS.get(tokenizer_path)
        if own is None:
            own = _TOKENIZERS[tokenizer_path] = Tokenizer(tokenizer_path)
        for batch in batches:
            for i, j in text_slices(batch, limit=3_000_000):
                part = batch.slice(i, j - i)
                row, piece, start, length, crc = [], [], [], [], []
                all_ids, ends = own.encode(part.column(1))
                for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    ids = all_ids[a:b].tobytes() + end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own_ids = ids[at : at + 4 * capacity]
                        row.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(own_ids) // 4)
                        crc.append(zlib.crc32(own_ids))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], schema.names)

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, schema)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x that minimises |a x - b|: Lawson and Hanson's active set on the normal equations.

    Goes on until no column would lower the error; raises if rounding keeps it from that.
    """
    g, h = a.T @ a, a.T @ b
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    slope = h.copy()
    for _ in range(100 * n + 100):
        slope[active] = -np.inf
        if active.all() or slope.max() <= 1e-9 * max(1.0, np.abs(h).max()):
            return x
        active[int(slope.argmax())] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.lstsq(g[np.ix_(on, on)], h[on], rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 1e-12
            step = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-300))
            x[on] += step * (z - x[on])
            active[on[(x[on] <= 1e-12) & low]] = False
            x[~active] = 0
            if not active.any():
                break
        slope = h - g @ x
    raise ArithmeticError("the pattern counts don't converge")


def patterns(classes: int) -> list[tuple[int, ...]]:
    """All ways to make ``classes`` of two or three parts, largest first."""
    two = [(classes - i, i) for i in range(1, classes // 2 + 1)]
    three = [(classes - i - j, j, i) for i in range(1, classes // 3 + 1) for j in range(i, (classes - i) // 2 + 1)]
    return two + three


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = CLASS_WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): bins of pieces that together hold each length as often as the histogram has it.

    Work and result grow with the number of different lengths, not with the counts.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    bins: list[tuple[tuple[int, ...], int]] = []
    if capacity in left:
        bins.append(((capacity,), left.pop(capacity)))
    classes = capacity // width
    if left and classes >= 2:
        counts = np.zeros(classes + 1)
        for n, c in left.items():
            counts[-(-n // width)] += c
        usable = [p for p in patterns(classes) if all(counts[k] for k in p)]
        if usable:
            a = np.zeros((classes + 1, len(usable)))
            for i, p in enumerate(usable):
                for k in p:
                    a[k, i] += 1
            repeats = np.floor(nnls(a, counts) + 1e-6).astype(np.int64)
            own = {k: sorted((n for n in left if -(-n // width) == k), reverse=True) for k in range(1, classes + 1)}
            for i in np.argsort(-repeats, kind="stable"):
                _draw(usable[i], int(repeats[i]), own, left, bins, capacity)
    return bins + _best_fit({n: c for n, c in left.items() if c}, capacity, bins)


def _draw(pattern: tuple[int, ...], repeats: int, own: dict[int, list[int]], left: dict[int, int], bins: list, capacity: int) -> None:
    """Takes actual lengths for as many repeats as fill a bin to the last token: of each class the longest,
    and in place of the last part just what is missing."""
    while repeats:
        taken: dict[int, int] = {}
        lengths: list[int] = []
        for i, k in enumerate(pattern):
            last = i == len(pattern) - 1
            room = capacity - sum(lengths)
            n = room if last else next((n for n in own[k] if left[n] > taken.get(n, 0)), 0)
            n = n if left.get(n, 0) > taken.get(n, 0) else None
            if n is None:
                return
            taken[n] = taken.get(n, 0) + 1
            lengths.append(n)
        times = min(repeats, *(left[n] // t for n, t in taken.items()))
        for n, t in taken.items():
            left[n] -= t * times
        bins.append((tuple(lengths), times))
        repeats -= times


def _best_fit(left: dict[int, int], capacity: int, bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, by counts: each length goes where least room remains, else opens bins.

    Takes over ``bins`` (and empties it), for what still fits into them.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, times in bins:
        room[capacity - sum(lengths)].append((lengths, times))
    bins.clear()
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            spot = min((r for r, held in room.items() if r >= n and held), default=None)
            if spot is None:
                per = capacity // n
                whole, rest = divmod(c, per)
                for lengths, times in (((n,) * per, whole), ((n,) * rest, 1 if rest else 0)):
                    if times:
                        room[capacity - sum(lengths)].append((lengths, times))
                break
            lengths, times = room[spot].pop()
            k = min(spot // n, c)  # of this length into each
            if times * k > c:
                use = c // k
                room[spot].append((lengths, times - use))
                times = use
            c -= times * k
            room[spot - k * n].append((lengths + (n,) * k, times))
    return [x for held in room.values() for x in held]


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of its pieces, by rank."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for n in lengths:
            out[n].append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for n, v in out.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; the pieces must be a stable table (see ``stash``)."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(plan(histogram, capacity))
    ranked = salted_rank(cut, ["length"], "__rank", ["doc_id", "piece", "ids_crc32"])
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, start, place = where[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = start[k] + rank[at] - first[k], place[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.select(*names, "__rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises, cuts and packs documents."""
    return pack(stash(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLE: dict[str, str] = {}
