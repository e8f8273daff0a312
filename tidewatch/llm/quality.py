"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its distinct words, hashed (each weighs one over the root of their number); its structure (shares of capital letters,
digits, signs, spaces and non-ASCII bytes, lines, word lengths, share of distinct words, share of the most frequent
word) and its stored length, each as the one of ``BINS`` quantile ranges it falls in. The machine scores

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

all pairs of features at a cost linear in their number. It is fitted on the driver by AdaGrad on at most
``PER_CLASS`` labelled documents of each label and scored in Spark tasks over whole texts, with a bounded
memo of words per worker.

Edge cases: a null text counts as empty; an empty text is scored by its statistics; a null n_chars is replaced by the
text's length; without training rows of both labels every score is 0; repeated rows score alike; a null id counts as
crc32 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import give_back, id_crc, read, text_slices, worker_memo
from tidewatch.llm.labelled import logistic, sample

PER_CLASS = 2500
WORDS = 2**15
BINS = 10
FACTORS = 6
#: Words that a worker remembers at most, but for those of one slice.
MEMO = 400_000
#: Texts that a fit cuts into words at a time.
BLOCK = 200

_KINDS = 6
_KIND = np.full(256, 5, np.uint8)  # other signs
_KIND[128:] = 4
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 13, 32]] = 3


def structure(texts: list[str], n_chars: list[int | None]) -> tuple[np.ndarray, list[list[str]]]:
    """Statistics (n, s) and the distinct words of each text."""
    out, words = [], []
    for text, n in zip(texts, n_chars, strict=True):
        data = text.encode()
        kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=_KINDS) / max(1, len(data))
        own = text.lower().split()
        counts = Counter(own)
        most = max(counts.values(), default=0)
        size = len(text) if n is None else n
        out.append([*kinds[[0, 2, 3, 4, 5]], data.count(b"\n") / max(1, len(data)), len(data) / max(1, len(own)), len(counts) / max(1, len(own)), most / max(1, len(own)), len(own), size])
        words.append(list(counts))
    return np.array(out, np.float64).reshape(len(out), -1), words


class Model:
    """Quantile edges and the machine's weights."""

    def __init__(self, edges: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.edges, self.w0, self.w, self.v = edges, w0, w, v
        self.slope, self.level = 1.0, 0.0

    def encode(self, stats: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, value, start of each row) from statistics and word numbers."""
        s = self.edges.shape[0]
        binned = np.stack([np.searchsorted(self.edges[k], stats[:, k], side="right") + WORDS + k * BINS for k in range(s)], 1)
        index = np.concatenate([x for pair in zip(binned, words, strict=True) for x in pair]).astype(np.int64)
        value = np.concatenate([x for w in words for x in (np.ones(s), np.full(len(w), 1 / np.sqrt(max(1, len(w)))))]).astype(np.float32)
        sizes = np.array([s + len(w) for w in words])
        return index, value, np.cumsum(sizes) - sizes

    def raw(self, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
        linear = np.add.reduceat(self.w[index] * value, start)
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, start, axis=0)
        return self.w0 + linear + 0.5 * (total * total - np.add.reduceat(vx * vx, start, axis=0)).sum(1)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw.astype(np.float64) + self.level, -30, 30)))


def word_number(word: str) -> int:
    return zlib.crc32(word.encode()) % WORDS


def fit(rows: list[tuple[str, int]], n_chars: list[int | None] | None = None, epochs: int = 12, batch: int = 64) -> Model | None:
    """Fits on labelled texts; None without both labels."""
    if len({y for _, y in rows}) < 2:
        return None
    n_chars, parts, numbers = n_chars or [None] * len(rows), [], []
    for i in range(0, len(rows), BLOCK):  # the words of a few texts at a time
        own, words = structure([t for t, _ in rows[i : i + BLOCK]], n_chars[i : i + BLOCK])
        parts.append(own)
        numbers += [np.fromiter(map(word_number, w), np.int64, len(w)) for w in words]
    stats = np.concatenate(parts)
    y = np.array([y for _, y in rows], np.float64)
    edges = np.stack([np.quantile(stats[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(stats.shape[1])])
    rng = np.random.default_rng(10)
    size = WORDS + edges.shape[0] * BINS
    m = Model(edges, 0.0, np.zeros(size, np.float32), (rng.standard_normal((size, FACTORS)) * 0.05).astype(np.float32))
    gw, gv, g0 = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), 1e-3
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rate, decay = 0.1, 1e-4
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            index, value, start = m.encode(stats[at], [numbers[i] for i in at])
            sizes = np.diff(np.r_[start, len(index)])
            p = 1 / (1 + np.exp(-np.clip(m.raw(index, value, start), -30, 30)))
            d = (weight[at] * (p - y[at]) / len(at)).astype(np.float32)
            each = np.repeat(d, sizes) * value
            vx = m.v[index] * value[:, None]
            total = np.repeat(np.add.reduceat(vx, start, axis=0), sizes, axis=0)
            unique, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, each, len(unique)).astype(np.float32) + decay * m.w[unique]
            dv = np.stack([np.bincount(back, each * (total[:, f] - vx[:, f]), len(unique)) for f in range(FACTORS)], 1).astype(np.float32) + decay * m.v[unique]
            gw[unique] += dw * dw
            gv[unique] += dv * dv
            g0 += float(d.sum()) ** 2
            m.w[unique] -= rate * dw / np.sqrt(gw[unique])
            m.v[unique] -= rate * dv / np.sqrt(gv[unique])
            m.w0 -= rate * float(d.sum()) / g0**0.5
    raw = [m.raw(*m.encode(stats[i : i + BLOCK], numbers[i : i + BLOCK])) for i in range(0, len(rows), BLOCK)]
    m.slope, m.level = logistic(np.concatenate(raw), y)
    return m


def _raw(m: Model, texts: list[str], n_chars: list[int | None]) -> np.ndarray:
    """The machine's output for each text; learns new words into this worker's memo."""
    stats, words = structure(texts, n_chars)
    memo: dict[str, int] = worker_memo("quality")
    new = set().union(*words).difference(memo)
    if memo and len(memo) + len(new) > MEMO:
        memo.clear()
        new = set().union(*words)
    memo.update((w, word_number(w)) for w in new)
    return m.raw(*m.encode(stats, [np.fromiter(map(memo.__getitem__, w), np.int64, len(w)) for w in words])).astype(np.float64)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, raw (the machine's output) and score (0 to 1) of each text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("raw", T.DoubleType()), T.StructField("score", T.DoubleType())])
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("raw"), F.lit(0.0).alias("score"))
    told = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch):
                part = batch.slice(i, j - i)
                raw = _raw(told.value, part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw), pa.array(told.value.probability(raw))], schema.names)

    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), n_chars.alias("n_chars")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The rows whose score reaches the threshold, as they are.

    Without a model (no training rows of both labels) nothing is known to be poor, and all rows stay; ``score``
    gives 0 to all of them then.
    """
    if model is None:
        return docs
    told = docs.sparkSession.sparkContext.broadcast(model)
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch, at):
                part = batch.slice(i, j - i)
                texts = [x or "" for x in part.column(at).to_pylist()]
                raw = _raw(told.value, texts, [None] * len(texts) if size is None else part.column(size).to_pylist())
                yield part.filter(pa.array(told.value.probability(raw) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fits on labels of ids whose crc32 mod 4 is not 2, with the texts' stored lengths. The driver gives the memory of the fit back."""
    model = fit(*sample(docs, labels, "quality", id_crc() % 4 != 2, per_class))
    give_back()
    return model


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "raw")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE: dict[str, str] = {}
