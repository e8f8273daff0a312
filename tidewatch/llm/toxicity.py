"""Toxicity by a string-kernel support vector machine that tolerates gapped and padded insults.

Kernel: gap-weighted subsequences. A word (lower case, look-alike digits folded, other signs
removed, with marks for its ends; once without accents and once with them) has a feature for each three of its signs in order within ``SPAN`` places,
weighted by ``DECAY`` for each sign skipped. So "i.d.i.o.t", "idxiot" and "idioot" share most features of
"idiot". Single letters in a row ("i d i o t") also count as one word. Kernels are normalised by length.

Nyström: landmark words give the map K_mm^(-1/2) k(landmarks, word); a linear SVM (squared hinge, Newton's
method) is fitted there. As kernel and map are linear in the features, the fitted model is one weight for each
feature, so a word costs the same whatever the number of landmarks.

Labels are of documents, while insults are words of single sentences. A document's score is that of its highest
word and what its next ``MORE`` different words have above 0 (or ``LONE`` times its highest word, if that is more): a few
doubtful words count as much as one clear word does, and their number is bounded, so long texts gain nothing by their length. Training starts with each toxic document's most telling words (by their runs of four, six and eight signs, and the
numbers of different sentences of toxic and clean documents that hold them: copies of a sentence count once), fits, picks the highest word of each toxic document
anew, adds the highest clean words as counter-examples, and repeats. The curve
from a document's score to a probability is fitted on the labelled documents.

The model is fitted on the driver on at most ``PER_CLASS`` documents of each label (and so many bytes of text, see ``labelled``), with ``CLEAN_WORDS`` and ``HARD_WORDS`` clean words; scoring runs in Spark tasks
over whole texts, with a bounded memo of words per worker.

Edge cases: letters of other scripts share a few codes, so such words are told apart less well; a text that is null, empty or without letters scores as the lowest possible word; without training rows of both
labels every score is 0; repeated rows score alike; null ids are kept and count as held out; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
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

PER_CLASS = 2000
LANDMARKS = 160
SPAN, DECAY = 6, 0.6
#: Longer words are scored in windows of this many signs, half overlapping.
WINDOW = 24
#: Words that a worker remembers at most, but for those of one slice.
MEMO = 400_000
#: Rows that a fit multiplies at a time.
BLOCK = 2_000
LOWEST = -4.0
#: Words that count beside the highest, and the weight of the highest word alone: chosen by ``cross_validate`` over rows that may be learnt from.
MORE, LONE = 3, 1.3
#: Clean words that a fit draws, and the highest clean words that each of its rounds adds as counter-examples.
CLEAN_WORDS, HARD_WORDS = 8_000, 2_000
RUNS = 2**20

#: Letters with codes of their own; other accents are dropped. Letters that are none of a to z even then share a few codes by number.
_OWN = "àáâäçèéêíñóöúüß"
_OTHER = 8
_BASE = 29 + len(_OWN) + _OTHER  # plain letters from 1, own ones from 27, other scripts' letters, begin, end
_BEGIN, _END = _BASE - 2, _BASE - 1
_LOOKS = str.maketrans("013457@", "oieasta")
_SENTENCE = re.compile(r"[.!?\n]+")
_INNER = re.compile(r"[^\W\d_]+")
_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
_CODES = np.zeros(256, np.uint8)
_CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODES[list(_OWN.encode("latin-1"))] = np.arange(27, 27 + len(_OWN))
_CODES[1 : 1 + _OTHER] = np.arange(27 + len(_OWN), 27 + len(_OWN) + _OTHER)


def fold(word: str, keep: bool = False) -> bytes:
    """The letters of a word in lower case, a byte each; look-alike digits count as letters.

    Accents are dropped, but with ``keep`` those letters that have codes of their own stay; letters of other scripts share ``_OTHER`` codes.
    """
    word = word.lower().translate(_LOOKS)
    if word.isascii():
        return word.encode().translate(None, _NOT_LETTERS)
    out = []
    for c in unicodedata.normalize("NFC", word):
        if keep and c in _OWN:
            out.append(c)
        else:
            out += [x if "a" <= x <= "z" else chr(1 + ord(x) % _OTHER) for x in unicodedata.normalize("NFKD", "s" if c == "ß" else c) if "a" <= x <= "z" or (x > "\x7f" and x.isalpha())]
    return "".join(out).encode("latin-1")


_NOT_LETTERS = bytes(i for i in range(256) if not 97 <= i <= 122)


def _weights(length: int) -> float:
    """Root of the kernel of a word of this many signs with itself, each place counted on its own."""
    return math.sqrt(sum(max(0, length - a - b) * DECAY ** (2 * (a + b - 2)) for a, b in _GAPS)) or 1.0


def _coded(words: list[bytes], length: int) -> np.ndarray:
    """Codes (n, length + 2) of words of equal length, with marks."""
    codes = np.empty((len(words), length + 2), np.int32)
    codes[:, 0], codes[:, -1] = _BEGIN, _END
    codes[:, 1:-1] = _CODES[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)]
    return codes


def _features(codes: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """(weight, feature of each word) for every place and gap."""
    n = codes.shape[1]
    for a, b in _GAPS:
        if n > a + b:
            yield DECAY ** (a + b - 2), codes[:, : n - a - b] * (_BASE * _BASE) + codes[:, a : n - b] * _BASE + codes[:, a + b :]


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), 20_000):
            own = at[i : i + 20_000]
            yield int(n), own, [words[k] for k in own]


def windows(word: bytes) -> list[bytes]:
    """A folded word, or the half-overlapping windows of a long one."""
    n = len(word)
    return [word] if n <= WINDOW else [word[i : i + WINDOW] for i in range(0, max(1, n - WINDOW // 2), WINDOW // 2)]


def score_words(words: list[bytes], weight: np.ndarray, offset: float) -> np.ndarray:
    """Scores of folded words by feature weights; words of under 3 letters, which no kernel tells apart, are lowest."""
    out = np.full(len(words), LOWEST)
    for n, at, own in _by_length(words):
        if n < 3:
            continue
        if n > WINDOW:
            for k, w in zip(at, own, strict=True):
                out[k] = score_words(windows(w), weight, offset).max()
            continue
        total = np.zeros(len(own))
        for f, x in _features(_coded(own, n)):
            total += f * weight[x].sum(1)
        out[at] = np.maximum(total / _weights(n + 2) + offset, LOWEST)
    return out


def _rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features that words have, and each feature's row among them (one more row: of all features that none has)."""
    known = np.zeros(_BASE**3, bool)
    for n, _, own in _by_length(words):
        for _, x in _features(_coded(own, n)):
            known[x] = True
    used = np.flatnonzero(known)
    row = np.full(_BASE**3, len(used), np.int32)
    row[used] = np.arange(len(used))
    return used, row


def _dense(words: list[bytes], row: np.ndarray | None = None) -> np.ndarray:
    """Normalised features (BASE ** 3, n) of a few words of at most WINDOW letters; with ``row`` only rows of their own."""
    out = np.zeros((_BASE**3 if row is None else int(row.max(initial=0)) + 1, len(words)), np.float32)
    for n, at, own in _by_length(words):
        for f, x in _features(_coded(own, n)):
            np.add.at(out, (x if row is None else row[x], at[:, None]), f / _weights(n + 2))
    return out


def _kernel(words: list[bytes], phi: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """Kernels (n, landmarks) of words with the landmarks whose features are ``phi`` (BASE ** 3 or by ``row``, landmarks)."""
    out = np.zeros((len(words), phi.shape[1]), np.float32)
    for n, at, own in _by_length(words):
        total = np.zeros((len(own), phi.shape[1]), np.float32)
        for f, x in _features(_coded(own, n)):
            x = x if row is None else row[x]
            for place in range(x.shape[1]):
                total += np.float32(f) * phi[x[:, place]]
        out[at] = total / np.float32(_weights(n + 2))
    return out


def _svm(a: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights and offset (last) of a linear SVM with squared hinge loss, by Newton's method; the last column of a is 1."""
    w = np.zeros(a.shape[1])
    ridge = np.ones(a.shape[1])
    ridge[-1] = 1e-3

    def value(v: np.ndarray) -> float:
        return 0.5 * (ridge * v * v).sum() + 0.5 * (cost * np.maximum(0, 1 - y * (a @ v)) ** 2).sum()

    best = value(w)
    for _ in range(rounds):
        on = np.flatnonzero(y * (a @ w) < 1)
        g, h = ridge * w, np.diag(ridge)
        for i in range(0, len(on), BLOCK):
            own, c = a[on[i : i + BLOCK]], cost[on[i : i + BLOCK]]
            g -= own.T @ (c * (y[on[i : i + BLOCK]] - own @ w))
            h += (own * c[:, None]).T @ own
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-4 and value(w - size * step) > best:
            size /= 2
        new = value(w - size * step)
        if best - new <= 1e-6 * best:
            break
        w, best = w - size * step, new
    return w


def _padded(word: bytes, k: int) -> bytes:
    """The word with a letter put in, by rule: training's picture of obfuscation."""
    at = 1 + k % max(1, len(word) - 1)
    return word[:at] + bytes([97 + (7 * k + len(word)) % 26]) + word[at:]


class Model:
    """Feature weights of words, and the curve from a document's highest words to its score."""

    def __init__(self, weight: np.ndarray, offset: float, slope: float, level: float) -> None:
        self.weight, self.offset, self.slope, self.level = weight, offset, slope, level

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.level, -30, 30)))


def split_words(text: str) -> list[str]:
    """Words between white space, and runs of three or more single letters joined."""
    words = text.lower().split()
    single = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if np.count_nonzero(single) >= 3:
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].view(np.int8)))
        words += ["".join(words[a:b]) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 3]
    return words


def forms(word: str) -> list[bytes]:
    """A word's folded form, that with its own accents, and those of its parts between other signs."""
    if not _INNER.search(word):  # numbers and signs are no words
        return [b""]
    whole = fold(word)
    out = [whole] if word.isascii() else [whole, fold(word, True)]
    if word.isalpha() or len(whole) < 3:
        return out
    parts = [fold(p) for p in _INNER.findall(word)]
    return [*out, *(p for p in parts if 3 <= len(p) < len(whole))]


def _runs(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers below RUNS of the runs of four, six and eight signs of coded words."""
    for n in (4, 6, 8):
        if codes.shape[1] >= n:
            x = np.full((len(codes), codes.shape[1] - n + 1), n, np.int64)
            for k in range(n):
                x = x * 1_000_003 + codes[:, k : k + x.shape[1]]
            yield (x * 0x2545F4914F6CDD1D >> 32) & (RUNS - 1)


def _telling(df: tuple[Counter, Counter]) -> dict[bytes, float]:
    """How much oftener a word's most telling run stands in sentences of toxic documents than of clean ones."""
    counts = []
    for own in df:
        total = np.zeros(RUNS)
        words = sorted(own)
        times = np.array([own[w] for w in words], float)
        for n, at, part in _by_length(words):
            for x in _runs(_coded(part, n)):
                total += np.bincount(x.ravel(), np.repeat(times[at], x.shape[1]), RUNS)
        counts.append(total)
    share = counts[1] / (counts[0] + 1)
    words, out = sorted(df[1]), np.zeros(len(df[1]))
    for n, at, part in _by_length(words):
        for x in _runs(_coded(part, n)):
            out[at] = np.maximum(out[at], share[x].max(1))
    return dict(zip(words, out.tolist(), strict=True))


def fit(rows: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = 4, clean_words: int = CLEAN_WORDS, hard_words: int = HARD_WORDS) -> Model | None:
    """Fits on labelled texts; None without both labels.

    Of the clean words a fit uses ``clean_words`` drawn at random and, from each round, the ``hard_words`` highest.
    """
    rows = list(dict.fromkeys(rows))
    if len({y for _, y in rows}) < 2:
        return None
    toxic: list[list[bytes]] = []  # the words of each toxic text
    seen: set[tuple[int, int]] = set()
    df = (Counter(), Counter())
    one: dict[bytes, bytes] = {}  # equal words are one object
    for text, y in rows:
        own: set[bytes] = set()
        for s in _SENTENCE.split(text):
            words = {one.setdefault(v, v) for w in split_words(s) for f in forms(w) if len(f) >= 3 for v in windows(f)}
            own |= words
            if words and (y, hash(s)) not in seen:
                seen.add((y, hash(s)))
                df[y].update(words)
        if y and own:
            toxic.append(sorted(own))
    del one, seen
    clean = sorted(df[0])
    if not toxic or not clean:
        return None
    telling = _telling(df)
    # words of clean documents that are far oftener in toxic ones are label noise, not counter-examples
    clean = [w for w in clean if df[1][w] < 20 * df[0][w]]
    usable = {w for w, n in df[1].items() if n >= 20 * df[0][w]}
    able = [[v for v in own if v in usable and telling[v] >= 2] for own in toxic]
    offered = sorted(set().union(*able))
    strongest = [max((telling[v] for v in own), default=0) for own in able]
    chosen = Counter(v for own, top in zip(able, strongest, strict=True) for v in own if telling[v] >= top / 4)
    first = chosen = chosen or Counter(max(w, key=lambda x: (telling[x], x)) for w in toxic)
    rng = np.random.default_rng(5)
    usual = [clean[i] for i in rng.permutation(len(clean))[:clean_words]]
    hard: list[bytes] = []
    model = (np.zeros(_BASE**3), 0.0)
    for r in range(rounds):
        strong = [w for w, _ in chosen.most_common(landmarks // 2)]
        points = list(dict.fromkeys(strong + hard[: landmarks // 4] + usual))[:landmarks]
        used, row = _rows(points)
        phi = _dense(points, row)
        k = (phi.T @ phi).astype(np.float64)
        values, vectors = np.linalg.eigh(k)
        keep = values > 1e-6 * values[-1]
        root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float64)
        good = list(chosen)
        padded = [_padded(w, i) for i, w in enumerate(good)]
        bad = list(dict.fromkeys(usual + hard))
        words = good + padded + bad
        x = np.ones((len(words), root.shape[1] + 1))
        for i in range(0, len(words), BLOCK):
            x[i : i + BLOCK, :-1] = _kernel(words[i : i + BLOCK], phi, row).astype(np.float64) @ root
        y = np.r_[np.ones(2 * len(good)), -np.ones(len(bad))]
        times = np.array([min(chosen[w], 20) for w in good], float)
        cost = 20 * np.r_[times / times.sum(), 0.5 * times / times.sum(), np.full(len(bad), 4.0 / len(bad))] * len(words) / 20
        w = _svm(x, y, cost)
        weight = np.zeros(_BASE**3)
        weight[used] = phi[: len(used)] @ (root @ w[:-1]).astype(np.float32)
        model = (weight, float(w[-1]))
        del x, phi
        scores = score_words(clean, *model)
        hard = list(dict.fromkeys(hard + [clean[i] for i in np.argsort(-scores)[:hard_words]]))
        vocabulary = dict(zip(offered, score_words(offered, *model).tolist(), strict=True))
        if r < rounds - 1:
            chosen = Counter()
            for own, top in zip(able, strongest, strict=True):
                best = max(own, key=lambda v: (vocabulary[v], v), default=None)
                # other words that are as telling, or clearly above the margin, are insults, too
                chosen.update(v for v in own if v == best or vocabulary[v] > 1 or telling[v] >= top / 2)
            chosen = chosen or first
    raw = [x for i in range(0, len(rows), 200) for x in _highest([split_words(t) for t, _ in rows[i : i + 200]], {}, *model)]
    slope, level = logistic(raw, [y for _, y in rows], balanced=False)
    return Model(*model, max(slope, 1e-3), level)


def cross_validate(rows: list[tuple[str, int]], choices: list[tuple[int, float]], folds: int = 5) -> dict[tuple[int, float], tuple[int, int, int, float]]:
    """(hits, misses, false alarms, log loss) of each choice of MORE and LONE over labelled texts, each scored by a model that has not seen it.

    Folds go by crc32 of the text, so equal texts share one. Give it rows that may be learnt from, and no others.
    """
    out = {c: np.zeros(4) for c in choices}
    fold_of = [zlib.crc32(t.encode()) % folds for t, _ in rows]
    for k in range(folds):
        learn, left = ([r for r, f in zip(rows, fold_of, strict=True) if (f == k) == own] for own in (False, True))
        model, memo = fit(learn), {}
        if model is None or not left:
            continue
        cut = [[split_words(t) for t, _ in part] for part in (learn, left)]
        for part in cut:
            for i in range(0, len(part), 200):
                _highest(part[i : i + 200], memo, model.weight, model.offset)
        y = [np.array([v for _, v in part]) for part in (learn, left)]
        for c in choices:
            raw, seen = (np.array([text_score(w, memo, *c) for w in part]) for part in (cut[1], cut[0]))
            slope, level = logistic(seen, y[0], balanced=False)
            p = 1 / (1 + np.exp(-np.clip(max(slope, 1e-3) * raw + level, -30, 30)))
            told = p >= 0.5
            out[c] += (told & (y[1] == 1)).sum(), (~told & (y[1] == 1)).sum(), (told & (y[1] == 0)).sum(), -np.log(np.where(y[1] == 1, p, 1 - p)).sum()
    return {c: (int(v[0]), int(v[1]), int(v[2]), float(v[3])) for c, v in out.items()}


def text_score(words: list[str], memo: dict[str, float], more: int = MORE, lone: float = LONE) -> float:
    """The score of a text's words together, by their own scores; different means: of different folded forms."""
    own = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
    best = float(own.max(initial=LOWEST))
    if best <= 0:
        return best
    held: dict[bytes, float] = {}
    for w in {words[k] for k in np.flatnonzero(own > 0)}:
        form = fold(w)
        held[form] = max(held.get(form, 0.0), memo[w])
    return max(lone * best, sum(sorted(held.values())[-1 - more :]))


def _highest(cut: list[list[str]], memo: dict[str, float], weight: np.ndarray, offset: float) -> list[float]:
    """The score of each text, given as words; new words' scores go into the memo."""
    new = set().union(*cut).difference(memo)
    if memo and len(memo) + len(new) > MEMO:
        memo.clear()
        new = set().union(*cut)
    if new:
        new = list(new)
        own = [forms(w) for w in new]
        counts = np.fromiter(map(len, own), np.int64, len(own))
        scores = score_words([f for fs in own for f in fs], weight, offset)
        memo.update(zip(new, np.maximum.reduceat(scores, np.cumsum(counts) - counts).tolist(), strict=True))
    return [text_score(c, memo) for c in cut]


def _raw(m: Model, texts: list[str]) -> np.ndarray:
    """The score of each text; learns new words into this worker's memo."""
    memo: dict[str, float] = worker_memo(("toxicity", float(m.weight.sum()), float(np.abs(m.weight).sum()), m.offset))
    return np.array(_highest([split_words(x) for x in texts], memo, m.weight, m.offset))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, raw (the SVM score of its highest words) and score (0 to 1) of each text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("raw", T.DoubleType()), T.StructField("score", T.DoubleType())])
    if model is None:
        return docs.select("doc_id", F.lit(LOWEST).alias("raw"), F.lit(0.0).alias("score"))
    told = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each of BASE ** 3 features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch, limit=3_000_000):
                part = batch.slice(i, j - i)
                raw = _raw(told.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw), pa.array(told.value.probability(raw))], schema.names)

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, as they are; all of them without a model."""
    if model is None:
        return docs
    told = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch, at, limit=3_000_000):
                part = batch.slice(i, j - i)
                raw = _raw(told.value, [x or "" for x in part.column(at).to_pylist()])
                yield part.filter(pa.array(told.value.probability(raw) < threshold))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fits on labels of ids whose crc32 mod 5 is not 0. The driver gives the memory of the fit back."""
    model = fit(sample(docs, labels, "toxic", id_crc() % 5 != 0, per_class)[0])
    give_back()
    return model


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
