"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

Spark deals the texts out. In each task the texts are cut into the matches of the tokenizer's pattern, and the
distinct new matches go to an in-process DuckDB: token-position rows (word, position, token) join the merge table, every word
contracts its leftmost pair of minimum rank, and the query recurs until no word has a pair left.
Equal pairs of one word contract in one round where that gives the same result as one at a time (see
``_merges``), so a word of many repeats doesn't need a round each. Ordered aggregation turns the rows
into ids, and ids back into bytes.

What a worker has learnt is kept in a memo of bounded size and reused by later tasks.

Edge cases: a null text is an empty text (no tokens, the digest of nothing); repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result; unpaired surrogates cannot
occur in a Spark string; bytes without a token of their own raise (the vocabulary has all 256).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import read, text_slices, worker_memo

#: Matches that a worker remembers at most, but for those of one slice; beyond it the memo starts anew.
MEMO = 1_200_000
#: Bytes of a word that the query for short words takes.
SHORT = 64
#: Words given to one DuckDB query.
WORDS = 15_000

#: One round: the token-position rows of every word (made from its list of tokens) join the merge table,
#: and the word contracts its leftmost pair of minimum rank. A key holds the merged token and the place of
#: the pair, so the smallest key is that pair. Words without a pair left drop out; a word's last list is
#: its shortest. For words of up to ``SHORT`` bytes.
_SHORT_WORDS = """
WITH RECURSIVE state(w, toks) AS (
    SELECT w, list(tok ORDER BY pos) FROM start GROUP BY w
  UNION ALL
    SELECT w, toks[:i - 1] || [best >> 16] || toks[i + 2:]
    FROM (
        SELECT w, toks, best, best & 65535 AS i
        FROM (
            SELECT p.w, any_value(p.toks) AS toks, min((m.merged << 16) | p.i) AS best
            FROM (
                SELECT w, toks, unnest(toks[:-2]) * 65536 + unnest(toks[2:]) AS pair, unnest(range(1, len(toks))) AS i
                FROM state
            ) p JOIN merges m USING (pair) GROUP BY p.w
        )
    )
),
encoded AS (SELECT w, arg_min(toks, len(toks)) AS ids FROM state GROUP BY w)
"""

#: The same for words of any length. All pairs of a word that equal its best pair contract in one round
#: if the merge is safe (of a run of one token, every second pair); else the leftmost alone.
_LONG_WORDS = """
WITH RECURSIVE state(w, pos, tok, round) AS (
    SELECT w, pos, tok, 0 FROM start
  UNION ALL
    SELECT w, pos, coalesce(made, tok), round + 1
    FROM (
        SELECT *, coalesce(lag(made IS NOT NULL) OVER (PARTITION BY w ORDER BY pos), false) AS eaten
        FROM (
            SELECT *, CASE WHEN merged = best AND (n = first_n OR safe AND (tok <> next_tok OR (n - run_from) % 2 = 0)) THEN merged END AS made
            FROM (
                SELECT *, min(CASE WHEN merged = best THEN n END) OVER (PARTITION BY w) AS first_n
                FROM (
                    SELECT p.*, m.merged, m.safe, min(m.merged) OVER (PARTITION BY p.w) AS best
                    FROM (
                        SELECT *, tok * 65536 + next_tok AS pair,
                               max(CASE WHEN last_tok IS DISTINCT FROM tok THEN n END) OVER (PARTITION BY w ORDER BY n ROWS UNBOUNDED PRECEDING) AS run_from
                        FROM (
                            SELECT *, lead(tok) OVER o AS next_tok, lag(tok) OVER o AS last_tok, row_number() OVER o AS n
                            FROM state WINDOW o AS (PARTITION BY w ORDER BY pos)
                        )
                    ) p LEFT JOIN merges m USING (pair)
                )
            )
        ) WHERE best IS NOT NULL
    ) WHERE NOT eaten
),
last AS (SELECT w, pos, tok FROM state QUALIFY round = max(round) OVER (PARTITION BY w)),
encoded AS (SELECT w, list(tok ORDER BY pos) AS ids FROM last GROUP BY w)
"""

#: Ends both: ids as text, and the bytes that they decode to, both by ordered aggregation.
_DECODE = """
SELECT string_agg(v.id::VARCHAR, ' ' ORDER BY p.pos) AS ids, unhex(string_agg(v.hex, '' ORDER BY p.pos)) AS bytes
FROM (SELECT w, unnest(ids) AS tok, unnest(range(len(ids))) AS pos FROM encoded) p
JOIN vocabulary v ON v.id = p.tok GROUP BY p.w ORDER BY p.w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int, bool]]:
    """(left, right, merged, safe) of every way to make a token from two tokens.

    A merge is safe if no pair that holds the merged token has a smaller rank: then contracting one
    occurrence makes no pair that comes before the other occurrences, and they may contract together.
    """
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    unsafe = {x for a, b, r in pairs for x in (a, b) if r < x}
    return [(a, b, r, r not in unsafe) for a, b, r in pairs]


class Codec:
    """Encodes and decodes distinct words in DuckDB, and remembers them."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks = load_ranks(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = _merges(ranks)
        tables = {
            "merges": pa.table({"pair": [m[0] * 65536 + m[1] for m in merges], "merged": [m[2] for m in merges], "safe": [m[3] for m in merges]}),
            "vocabulary": pa.table({"id": list(ranks.values()), "hex": [x.hex() for x in ranks]}),
        }
        for name, table in tables.items():
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.path = path

    def words(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        """The ids of each word, and the bytes that they decode to."""
        out: list = [None] * len(words)
        short, long = [], []
        for i, x in enumerate(words):
            (short if len(x) <= SHORT else long).append(i)
        for which, query, size in ((short, _SHORT_WORDS, WORDS), (long, _LONG_WORDS, 50)):
            for k in range(0, len(which), size):
                part = which[k : k + size]
                for i, found in zip(part, self._contract([words[i] for i in part], query), strict=True):
                    out[i] = found
        return out

    def _contract(self, words: list[bytes], query: str) -> Iterator[tuple[str, bytes]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        if (tok < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        w = np.repeat(np.arange(len(words)), lengths)
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.db.register("start", pa.table({"w": w, "pos": pos, "tok": tok}))
        found = self.db.sql(query + _DECODE).to_arrow_table()
        self.db.unregister("start")
        return zip(*(found.column(c).to_pylist() for c in ("ids", "bytes")), strict=True)

    @property
    def memo(self) -> dict[str, tuple[str, bytes]]:
        return worker_memo(("byte_bpe", self.path))

    def texts(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Number of ids, the ids joined by spaces, and the decoded bytes of each text."""
        matches = list(map(self.find, texts))
        memo = self.memo
        new = set().union(*matches).difference(memo)
        if len(memo) + len(new) > MEMO and memo:
            memo.clear()
            new = set().union(*matches)
        new = list(new)
        memo.update(zip(new, self.words([x.encode() for x in new]), strict=True))
        for own in matches:
            found = [*map(memo.__getitem__, own)]
            ids = " ".join([x[0] for x in found])
            yield ids.count(" ") + 1 if found else 0, ids, b"".join([x[1] for x in found])


_CODECS: dict[tuple[str, str], Codec] = {}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space) and decoded (bytes) of each text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.BinaryType())])
    return _mapped(docs, ranks_path, pattern, schema, lambda n, i, b: (n, i, b), [pa.int64(), pa.string(), pa.binary()])


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests in place of ids and bytes."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _mapped(docs, ranks_path, pattern, schema, lambda n, i, b: (n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(b).hexdigest()), [pa.int64(), pa.string(), pa.string()])


def _mapped(docs: DataFrame, path: str, pattern: str, schema: T.StructType, form, kinds: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODECS.get((path, pattern))
        if codec is None:
            codec = _CODECS[path, pattern] = Codec(path, pattern)
        for batch in batches:
            for i, j in text_slices(batch, limit=4_000_000):
                part = batch.slice(i, j - i)
                columns = zip(*(form(*x) for x in codec.texts(part.column(1).to_pylist())), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the byte_bpe_50k ranks."""
    import public_tokenizers

    return encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLE: dict[str, str] = {}
