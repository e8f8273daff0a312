"""Telephony audio columns: store byte payloads as companded audio, read them back, expand and resample.

A media value is a RIFF/WAVE file of one 8 kHz channel in one of three telephone codecs:

* ``mulaw`` (format tag 7) and ``alaw`` (tag 6): one byte a sample, expanded by 256-entry tables;
* ``ima`` (tag 17): ADPCM in blocks of 64 bytes (a 4-byte head and 120 nibbles, 121 samples), decoded
  step by step with numpy, all blocks of a slice of files at once.

The companded bytes are the payload itself, so storing is lossless for any bytes. Decoded audio is
brought from 8 to 16 kHz (``resample2``) and kept as a column of 16-bit PCM, four bytes a sample of the payload.

Edge cases: a null text is an empty text; an empty text gives 64 zero bytes; extra columns of the input
are ignored; repeated rows give repeated results; an empty table gives an empty result; a null or
malformed media value gives null results (``decode_media`` never raises on them).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import read, text_slices

UNIT = 64
BLOCK, BLOCK_SAMPLES = 64, 121
RATE = 8000
TAGS = {"mulaw": 7, "alaw": 6, "ima": 17}
CODECS = ("mulaw", "alaw", "ima")

# Fixed values of the IMA ADPCM format: quantiser steps and index changes.
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
IMA_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: 256 bytes to 16-bit samples."""
    b = ~np.arange(256) & 0xFF
    size = ((((b & 15) << 3) + 0x84) << (b >> 4 & 7)) - 0x84
    return np.where(b & 0x80, -size, size).astype("<i2")


def alaw_table() -> np.ndarray:
    """G.711 A-law: 256 bytes to 16-bit samples."""
    b = np.arange(256) ^ 0x55
    exponent, size = b >> 4 & 7, ((b & 15) << 4) + 8
    size = np.where(exponent > 0, size + 0x100 << np.maximum(exponent - 1, 0), size)
    return np.where(b & 0x80, size, -size).astype("<i2")


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """By 16 * index + nibble: the change of the predictor, and 16 * the next index."""
    step, code = np.array(IMA_STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (code & 1) * (step >> 2) + (code >> 1 & 1) * (step >> 1) + (code >> 2 & 1) * step
    move = np.clip(np.arange(89)[:, None] + np.array(IMA_MOVES * 2)[None, :], 0, 88) * 16
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), move.astype(np.int32).ravel()


MULAW, ALAW = mulaw_table(), alaw_table()
IMA_CHANGE, IMA_NEXT = _ima_tables()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Blocks (n, 64) of bytes to samples (n, 121); each step treats all blocks together.

    A block's step index above 88 counts as 88.
    """
    out = np.empty((BLOCK_SAMPLES, len(blocks)), np.int16)
    now = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = now
    for k in range(BLOCK_SAMPLES - 1):
        at = index + (codes[k >> 1] & 15 if k % 2 == 0 else codes[k >> 1] >> 4)
        now = np.clip(now + IMA_CHANGE[at], -32768, 32767)
        index = IMA_NEXT[at]
        out[k + 1] = now
    return np.ascontiguousarray(out.T)


def resample2(x: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples with cubic midpoints between them, in whole numbers."""
    p = np.empty(len(x) + 3, np.int32)
    p[1:-2], p[0], p[-2:] = x, x[0], x[-1]
    out = np.empty(2 * len(x), "<i2")
    out[::2] = x
    out[1::2] = np.clip((9 * (p[1:-2] + p[2:-1]) - p[:-3] - p[3:] + 8) >> 4, -32768, 32767)
    return out


def wrap(payload: bytes, codec: str) -> bytes:
    """A WAVE file of the payload."""
    ima = codec == "ima"
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, RATE * BLOCK // BLOCK_SAMPLES if ima else RATE, BLOCK if ima else 1, 4 if ima else 8)
    fmt += struct.pack("<HH", 2, BLOCK_SAMPLES) if ima else struct.pack("<H", 0)
    fact = struct.pack("<I", len(payload) // BLOCK * BLOCK_SAMPLES if ima else len(payload))
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v for k, v in ((b"fmt ", fmt), (b"fact", fact), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(media: bytes | None) -> tuple[str, bytes] | None:
    """Codec and payload of a WAVE file; None if it is none of ours."""
    if media is None or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, codec, names = 12, None, {v: k for k, v in TAGS.items()}
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            codec = names.get(int.from_bytes(media[at + 8 : at + 10], "little"))
        elif kind == b"data":
            return (codec, media[at + 8 : at + 8 + n]) if codec and len(media) >= at + 8 + n else None
        at += 8 + n + n % 2
    return None


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of each document: its UTF-8 bytes, padded by zeros to a multiple of 64, as audio.

    The codec follows from the payload's crc32, so equal texts are stored alike.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch):
                part = batch.slice(i, j - i)
                texts, media = part.column(1).to_pylist(), []
                for x in texts:
                    payload = x + bytes(-len(x) % UNIT if x else UNIT)
                    media.append(wrap(payload, CODECS[zlib.crc32(payload) % len(CODECS)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def decode_media(media: DataFrame, keep_pcm: bool = False) -> DataFrame:
    """Reads stored files back: doc_id, n_bytes, payload figures, features and, if asked, the 16 kHz PCM.

    ``feature`` is codec:samples:root mean square:sign changes:crc32 of the resampled PCM.
    """
    fields = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    fields += [("pcm", T.BinaryType())] * keep_pcm
    schema = T.StructType([media.schema["doc_id"], T.StructField("n_bytes", T.LongType()), *(T.StructField(*f) for f in fields)])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def rows(files: list[bytes | None]) -> Iterator[tuple]:
        found = [unwrap(x) for x in files]
        ima = [x[1] if x and x[0] == "ima" else b"" for x in found]
        blocks = np.frombuffer(b"".join(x[: len(x) // BLOCK * BLOCK] for x in ima), np.uint8).reshape(-1, BLOCK)
        decoded, at = decode_ima(blocks), 0
        for file, x, own in zip(files, found, ima, strict=True):
            if x is None:
                yield (None,) * len(fields)
                continue
            codec, payload = x
            if codec == "ima":
                n = len(own) // BLOCK
                pcm, at = decoded[at : at + n].ravel(), at + n
            else:
                pcm = (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(payload, np.uint8)]
            wide = resample2(pcm) if len(pcm) else np.empty(0, "<i2")
            level = pcm.astype(np.float64)
            rms = float(np.sqrt(level @ level / len(level))) if len(level) else 0.0
            turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
            feature = f"{codec}:{len(pcm)}:{rms:.3f}:{turns}:{zlib.crc32(wide)}"
            out = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature)
            yield out + ((wide.tobytes(),) if keep_pcm else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch, 2):
                part = batch.slice(i, j - i)
                columns = zip(*rows(part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], schema.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as telephone audio: digests of the stored files, and their resampled PCM."""
    return decode_media(store_media(read(spark, sf_dir, "documents")), keep_pcm=True)


QUERIES = {"op4_telephony_audio": op4_telephony_audio}
ORACLE: dict[str, str] = {}
