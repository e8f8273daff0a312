"""Tokenisers, packing, audio, sharding and line dedup against plain versions, on odd and on given documents."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, line_dedup, packing, sharding, telephony

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given():
    return [(r["doc_id"], r["text"]) for r in ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]


def key(r):
    return tuple((x is None, x) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def tiktoken_rows(rows):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        yield i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def test_byte_bpe(spark, odd_docs, odd_rows, no_docs, given):
    same(byte_bpe.op6_byte_bpe(spark, SF).collect(), tiktoken_rows(given))
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    same(byte_bpe.encode_digests(odd_docs, *args).collect(), tiktoken_rows([r[:2] for r in odd_rows]))
    assert byte_bpe.encode_digests(no_docs, *args).isEmpty()
    assert all(r["decoded"] == (t or "").encode() for r, t in zip(byte_bpe.encode_decode(odd_docs, *args).collect(), [r[1] for r in odd_rows], strict=True))


def test_byte_bpe_long_matches():
    import tiktoken

    c = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    texts = [*(" " + ("qzjx" * 20)[:n] for n in range(60, 68)), *(("é" * 40)[:n] for n in range(30, 34)), "a" * 5000, "abcab" * 900, "!?" * 700 + "!!!" * 301, " \n" * 40 + "x", "idea\t\tx  y \n z ", "\u0085x \x1cq"]
    for t, (n, ids, back) in zip(texts, c.texts(texts), strict=True):
        assert (ids, n, back) == (" ".join(map(str, enc.encode_ordinary(t))), len(enc.encode_ordinary(t)), t.encode())


def ids_of(text):
    from tokenizers import Tokenizer

    t = ids_of.own = getattr(ids_of, "own", None) or Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, docs):
    want = Counter()
    for i, t in docs:
        ids = np.array(ids_of(t), "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[i, p, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    return len(bins), sum(r["length"] for r in rows)


def test_packing(spark, odd_docs, odd_rows, no_docs, given):
    bins, tokens = check_packing(packing.op7_best_fit_packing(spark, SF).collect(), given)
    assert bins <= 1.02 * tokens / 2048 + 1
    check_packing(packing.pack_documents(odd_docs, P.path("word_bpe_49k.json")).collect(), [r[:2] for r in odd_rows])
    assert packing.pack_documents(no_docs, P.path("word_bpe_49k.json")).isEmpty()


def test_packing_words_of_any_letters():
    """Words learnt many at a time have the ids that the tokenizer gives them in their text."""
    import pyarrow as pa

    texts = ["Größe ÉTÉ été. ΣΑΣ σας, İstanbul ǅungla! ﬁn Ⅷ ª漢字かな 한국어 नमस्ते ไทย x̂y", "it's o'clock 's don't. I'll! a.b c,, \u00a0z\u3000w", "e\u0301te\u0301 \u212b \u1e9e \u0345a ʰa 𝒜𝒷 🙂a a🙂."]
    own = packing.Tokenizer(P.path("word_bpe_49k.json"))
    ids, ends = own.encode(pa.array(texts))
    for text, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert [*ids[a:b].tolist(), 0] == ids_of(text)


def test_packing_special_literals(spark):
    """Literals of special tokens get the ids that the tokenizer's own call gives."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ["end of a page <|endoftext|> next page", "<|startoftext|>Word<|endoftext|>\nÉté x<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endof text|>"]
    want = [[*own.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert 49407 in want[0] and 49406 in want[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pieces(docs, path).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)}


def test_packing_plan():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 5000), np.full(7, 1500), np.r_[np.full(99, 1024), 5], np.array([2048, 1])):
        h = dict(Counter(lengths.tolist()))
        bins = packing.plan(h)
        got = Counter()
        for own, times in bins:
            assert sum(own) <= 2048 and times > 0
            for n in own:
                got[n] += times
        assert got == Counter(h)
    x = packing.nnls(np.array([[1.0, 0, 1], [0, 1, 1]]), np.array([2.0, -1.0]))
    assert (x >= 0).all() and np.allclose(x, [2, 0, 0])


def slow_samples(kind, payload):
    """One byte or nibble at a time, by the texts of the standards."""
    if kind == 0:
        for b in payload:
            b ^= 255
            size = (((b & 15) * 2 + 33) << (b // 16 % 8)) - 33
            yield -4 * size if b >= 128 else 4 * size
    elif kind == 1:
        for b in payload:
            b ^= 85
            part, low = b // 16 % 8, b & 15
            size = low * 16 + 8 if not part else (low * 16 + 264) * 2 ** (part - 1)
            yield size if b >= 128 else -size
    else:
        for k in range(0, len(payload), 64):
            now, index = int.from_bytes(payload[k : k + 2], "little", signed=True), min(payload[k + 2], 88)
            yield now
            for code in (c for b in payload[k + 4 : k + 64] for c in (b & 15, b >> 4)):
                step = telephony.IMA_STEPS[index]
                change = step // 8 + step // 4 * (code & 1) + step // 2 * (code // 2 & 1) + step * (code // 4 & 1)
                now = max(-32768, min(32767, now - change if code & 8 else now + change))
                index = max(0, min(88, index + (2 * (code & 7) - 6 if code & 4 else -1)))
                yield now


def audio_row(i, text):
    data = (text or "").encode()
    payload = data + bytes(-len(data) % 64 if data else 64)
    kind, n = zlib.crc32(payload) % 3, len(payload)
    head = [struct.pack("<4sIHHIIHHH", b"fmt ", 18, tag, 1, 8000, 8000, 1, 8, 0) for tag in (7, 6)]
    head.append(struct.pack("<4sIHHIIHHHH", b"fmt ", 20, 17, 1, 8000, 4231, 64, 4, 2, 121))
    samples = list(slow_samples(kind, payload))
    body = b"WAVE" + head[kind] + b"fact" + struct.pack("<II", 4, len(samples)) + b"data" + struct.pack("<I", n) + payload
    media = b"RIFF" + struct.pack("<I", len(body)) + body
    wide = []
    for k, x in enumerate(samples):
        at = lambda j: samples[max(0, min(len(samples) - 1, j))]
        wide += [x, max(-32768, min(32767, (9 * (x + at(k + 1)) - at(k - 1) - at(k + 2) + 8) // 16))]
    pcm = struct.pack(f"<{len(wide)}h", *wide)
    turns = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
    feature = f"{('mulaw', 'alaw', 'ima')[kind]}:{len(samples)}:{(sum(x * x for x in samples) / len(samples)) ** 0.5:.3f}:{turns}:{zlib.crc32(pcm)}"
    return i, len(data), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, pcm


def test_telephony(spark, odd_docs, odd_rows, no_docs, given):
    same([(*r[:8], bytes(r["pcm"])) for r in telephony.op4_telephony_audio(spark, SF).collect()], [audio_row(*x) for x in given])
    rows = telephony.decode_media(telephony.store_media(odd_docs), keep_pcm=True).collect()
    same([(*r[:8], bytes(r["pcm"])) for r in rows], [audio_row(*x[:2]) for x in odd_rows])
    assert telephony.decode_media(telephony.store_media(no_docs)).columns[-1] == "feature"
    assert telephony.decode_media(telephony.store_media(no_docs)).isEmpty()
    broken = spark.createDataFrame([(1, 2, None), (2, 2, bytearray(b"RIFF....WAVEdata")), (3, 2, bytearray(b"x"))], "doc_id bigint, n_bytes bigint, media binary")
    assert all(r["payload_bytes"] is None for r in telephony.decode_media(broken).collect())


def test_codecs():
    assert telephony.MULAW[0xFF] == 0 and telephony.MULAW[0x00] == -32124 and telephony.MULAW[0x80] == 32124
    assert telephony.ALAW[0xD5] == 8 and telephony.ALAW[0x55] == -8 and telephony.ALAW[0x2A] == -32256 and telephony.ALAW[0xAA] == 32256
    for t in (telephony.MULAW, telephony.ALAW):
        assert sorted(t.tolist()) == sorted((-t.astype(int)).tolist())
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64)).astype(np.uint8)
    got = telephony.decode_ima(blocks)
    for block, samples in zip(blocks, got, strict=True):  # one nibble at a time
        now, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
        want = [now]
        for b in block[4:]:
            for code in (int(b) & 15, int(b) >> 4):
                step = telephony.IMA_STEPS[index]
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                now = max(-32768, min(32767, now - diff if code & 8 else now + diff))
                index = max(0, min(88, index + telephony.IMA_MOVES[code & 7]))
                want.append(now)
        assert want == samples.tolist()
    assert telephony.resample2(np.array([4, 4, 4], np.int16)).tolist() == [4] * 6
    for codec in telephony.CODECS:
        assert telephony.unwrap(telephony.wrap(bytes(range(64)), codec)) == (codec, bytes(range(64)))


def check_shards(rows, docs, n):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(n))


def test_sharding(spark, odd_docs, odd_rows, no_docs, given):
    rows = sharding.op1_sharding(spark, SF).collect()
    check_shards(rows, given, 40)
    assert {r["law"] for r in rows} == {"rows"}
    check_shards(sharding.shard(odd_docs, 3).collect(), [r[:2] for r in odd_rows], 3)
    check_shards(sharding.shard(odd_docs, 40).collect(), [r[:2] for r in odd_rows], 40)
    assert sharding.shard(no_docs).isEmpty()


def test_sharding_keeps_groups_together(spark):
    """A hot group of a third of the rows, small groups and single texts: groups meet in as few shards as can be."""
    texts = ["hot"] * 400 + [f"pair {i // 2}" for i in range(400)] + [f"own {i}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sharding.shard(docs, 12).collect()
    check_shards(rows, list(enumerate(texts)), 12)
    spread = defaultdict(set)
    for r in rows:
        spread[texts[r["doc_id"]]].add(r["shard"])
    assert len(spread["hot"]) <= 5  # four shards hold them
    assert sum(len(v) > 1 for k, v in spread.items() if k.startswith("pair")) <= 2


def test_sharding_links_whole_texts(spark):
    """Near copies with another opening meet in a shard; texts that share only an opening have no link."""
    rng = np.random.default_rng(12)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    texts = []
    for _ in range(150):
        body = words(300)
        texts += [words(8) + " " + body, words(8) + " " + body]
    texts += [words(60) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sharding.shard(docs, 12).collect()
    check_shards(rows, list(enumerate(texts)), 12)
    at = {r["doc_id"]: r["shard"] for r in rows}
    assert sum(at[i] != at[i + 1] for i in range(0, 300, 2)) <= 8
    opening = words(40)
    alike = spark.createDataFrame([(i, opening + " " + words(400)) for i in range(2)], "doc_id bigint, text string")
    assert sharding._edges(sharding.slim(alike)).isEmpty()


def test_propagation_cuts_few_links(spark):
    """First labels are dealt by id; propagation moves most linked documents, and cut links fall. Counted again in Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shards, edges = sharding.propagate(docs, 12)
    rows = shards.collect()
    keys = defaultdict(set)
    for e in edges.collect():
        keys[e["text_key"]].add(e["key"])
    cuts = []
    for column in ("first_shard", "shard"):
        groups = defaultdict(Counter)
        for r in rows:
            groups["text", r["text_key"]][r[column]] += 1
            for k in keys[r["text_key"]]:
                groups["key", k][r[column]] += 1
        held = [g for (kind, _), g in groups.items() if kind == "key" or sum(g.values()) > 1]
        linked, cut = sum(sum(g.values()) for g in held), sum(sum(g.values()) - max(g.values()) for g in held)
        assert sharding.cut_links(shards, edges, column).first() == (linked, cut)
        cuts.append(cut)
    assert cuts[0] > 100 and cuts[1] * 10 < cuts[0]
    linked = [r for r in rows if keys[r["text_key"]]]
    assert sum(r["shard"] != r["first_shard"] for r in linked) * 3 > len(linked)


def test_quotas_keep_sizes():
    rng = np.random.default_rng(2)
    wanted, free = rng.integers(0, 9, (6, 6)), rng.integers(0, 9, 6)
    np.fill_diagonal(wanted, 0)
    moves, fills = sharding.quotas(wanted, free)
    assert (moves <= wanted).all() and (fills.sum(1) <= free).all() and (fills >= 0).all()
    flow = moves + fills
    assert (flow.sum(0) == flow.sum(1)).all()


def dedup(rows, least):
    """Rows (doc_id, text, source) without boilerplate, in plain Python; ids are distinct and set."""
    sites, first = defaultdict(set), {}
    for i, t, s in sorted(rows):
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if k := line.strip(" \t\r"):
                sites[k] |= {s} - {None}
                first.setdefault(k, (i, p))
    out = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        gone = {p for p, x in enumerate(lines) if (k := x.strip(" \t\r")) and len(sites[k]) >= least and first[k] != (i, p)}
        out.append((i, None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), sum(bool(x.strip(" \t\r")) for x in lines), len(gone)))
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 7])
def test_line_dedup(spark, least):
    lines = [f"line {k}" for k in range(12)]
    rows = [(i, "\n".join(["", *(f" {lines[k]}\t" for k in range(12) if (i * (k + 1)) % (k + 2) < 2), f"own {i}", lines[i % 3]]), f"s{i % (i % 9 + 1)}") for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "line 1\nline 1\n\nline 1", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = line_dedup.drop_lines(docs, least).select("doc_id", "text", "n_lines", "n_removed").collect()
    same(got, dedup(rows, least))


def test_line_dedup_edges(spark, odd_docs, no_docs):
    out = line_dedup.drop_lines(odd_docs, 3)
    assert out.count() == odd_docs.count() and set(odd_docs.columns) < set(out.columns)
    assert line_dedup.drop_lines(no_docs).isEmpty()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[4]["text"] is None and by[4]["n_lines"] == 0 and by[5]["text"] == ""


def test_line_dedup_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"same line here\nown {i}", f"s{i}") for i in range(12)], "doc_id bigint, text string, source string")
    names = ("row", "__row", "gone", "__gone", "line", "pos", "n_lines", "n_removed", "Row")[:-1]
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    got = line_dedup.drop_lines(wide)
    assert got.columns == [*wide.columns, "n_lines_", "n_removed_"]
    for r in got.collect():
        assert all(r[c] == f"{c}{r['doc_id']}" for c in names)
        assert (r["text"], r["n_lines_"], r["n_removed_"]) == ((f"own {r['doc_id']}", 2, 1) if r["doc_id"] else ("same line here\nown 0", 2, 0))


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.op9_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_line_dedup_oracle(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = line_dedup.op9_line_dedup(spark, SF)
    r = c.execute(line_dedup.ORACLE["op9_line_dedup"])
    at = [[d[0] for d in r.description].index(x) for x in df.columns]
    same(df.collect(), [tuple(x[i] for i in at) for x in r.fetchall()])


def test_nnls_converges():
    """Slopes of unused columns point down, those of used ones are level, at every size."""
    rng = np.random.default_rng(8)
    for m, n in ((3, 2), (20, 60), (65, 1100)):
        a = (rng.random((m, n)) < 3 / m).astype(float)
        b = rng.integers(0, 10**6, m).astype(float)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        scale = max(1.0, np.abs(a.T @ b).max())
        assert (x >= 0).all() and slope.max() <= 1e-6 * scale and np.abs(slope[x > 0]).max(initial=0) <= 1e-6 * scale
