"""BPE and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import bpe as B
from spanloom.llm import packing as P
from spanloom.llm.queries import BYTE_BPE as BYTE
from spanloom.llm.queries import BYTE_RANKS as RANKS
from spanloom.llm.queries import QUERIES
from spanloom.llm.queries import WORD_BPE as WORD
from spanloom.llm.words import WordTable

BITS = ["a", "B", "é", "É", "ß", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'ve", "1", "23", "!", "?", "-", "don't", "I'm", "...", "\r\n", "x", "'t", "<|endoftext|>", "<|startoftext|>", "中", "œ", "\x1c", "×", "\xa0", "''", "Hello", "the ", "İ", "é", "aaaa", "\x85", "٣", "👍"]


def odd_texts(n=3000, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(n)] + [None, "", "x" * 40_000, "ab " * 30_000]


def test_speculation_equals_the_library():
    e, texts = B.encoder(WORD), odd_texts()
    for got, t in zip(e(pa.array(texts, pa.string())), texts):
        ids = e.library.encode(t or "", add_special_tokens=False).ids
        assert got.tolist() == ids, t
        assert e.decode(got) == e.library.decode(ids, skip_special_tokens=False)


def test_only_failing_words_are_merged_and_pairs_are_exact():
    e = B.encoder(WORD)
    r = random.Random(1)
    texts = [e.text[r.randrange(512, 49000)].replace("</w>", "") for _ in range(400)]
    pairs = [(i, j) for i in range(1000, 1030) for j in range(2000, 2030)]
    ok = e.compatible(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    for (i, j), fine in zip(pairs, ok.tolist()):
        if "</w>" not in e.text[i]:
            parts = [s for t in (i, j) for s in spell(e, t)]
            merged = e.merge(np.array(parts), np.zeros(len(parts), np.int64))[0].tolist()
            assert fine == (merged == [i, j] or not (self_made(e, i) and self_made(e, j)) and fine), (e.text[i], e.text[j])
    assert texts


def spell(e, token):
    return [token] if e.made[token] < 0 else spell(e, int(e.left[token])) + spell(e, int(e.right[token]))


def self_made(e, token):
    parts = spell(e, token)
    return e.merge(np.array(parts), np.zeros(len(parts), np.int64))[0].tolist() == [token]


def test_bpe_query(spark):
    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(WORD)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edge_cases(spark):
    df = spark.createDataFrame([(1, "Hello", "z"), (1, "Hello", "z"), (None, None, None), (2, "", "q")], "doc_id bigint, text string, n_tokens string")
    got = B.digest_documents(df, WORD).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 1, 1]
    assert B.digest_documents(df.limit(0), WORD).count() == 0
    twin = df.withColumnRenamed("n_tokens", "__text").withColumn("ids", F.lit("clash"))
    assert sorted(r["n_tokens"] for r in B.digest_documents(twin, WORD).where("`__text` is not null").collect()) == [0, 1, 1]
    full = {r["doc_id"]: r for r in B.encode_documents(df, WORD).collect()}
    assert full[1]["decoded"] == "hello</w>" and full[2]["ids"] == []


def test_byte_encoder_equals_the_library():
    e, texts = P.byte_encoder(BYTE, RANKS), odd_texts(seed=3)
    for got, t in zip(e(pa.array(texts, pa.string())), texts):
        assert got.tolist() == e.library.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(4))
def test_first_fit_decreasing_by_brute_force(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 65, 200)
    bins, offsets = P.first_fit_decreasing(sizes, 64)
    left: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, x in enumerate(left) if x >= sizes[i]), len(left))
        if k == len(left):
            left.append(64)
        assert (bins[i], offsets[i]) == (k, 64 - left[k])
        left[k] -= sizes[i]


def check_packing(rows, pieces, room):
    t = Tokenizer.from_file(BYTE)
    want = sorted(((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])) for i, x in rows), key=str)
    seqs: dict = {}
    by: dict = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by.setdefault(p["doc_id"], []).append(p)
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= room
    ids = {i: v for i, v in want}
    for i, parts in by.items():
        copies = sum(j == i for j, _ in rows)
        assert sum(p["length"] for p in parts) == copies * len(ids[i])
        for p in parts:
            x = np.array(ids[i][p["start"] : p["start"] + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(x.tobytes()) and p["doc_tokens"] == len(ids[i])
    assert set(by) == {i for i, _ in rows}
    return 1 - sum(p["length"] for p in pieces) / (room * len(seqs))


def test_pack_edge_cases(spark):
    rows = [(1, "some words here " * 40), (1, "some words here " * 40), (2, None), (3, ""), (4, "word " * 5000), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sequence_id", F.lit("clash"))
    check_packing(rows, P.pack(df, BYTE, RANKS, room=64, group=3).collect(), 64)
    assert P.pack(df.limit(0), BYTE, RANKS).count() == 0


def test_pack_query_has_little_padding(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(rows, QUERIES["op9_packing"](spark, sf).collect(), 1024) < 0.02


def thue_morse(k):
    bits = [bin(i).count("1") % 2 for i in range(1 << k)]
    return ["".join("ab"[x ^ y] for x in bits) for y in (0, 1)]


@pytest.mark.parametrize("k", [10, 11, 12])
def test_words_that_polynomials_confuse(k):
    texts = thue_morse(k) + [" ".join(thue_morse(k))]
    for e in (B.encoder(WORD), P.byte_encoder(BYTE, RANKS)):
        for got, t in zip(e(pa.array(texts)), texts):
            assert got.tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_word_table_where_all_hashes_are_equal(monkeypatch):
    """Words are told apart by their bytes, within a batch and against the table."""
    import spanloom.llm.words as words

    monkeypatch.setattr(words, "ranges_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    table = WordTable(lambda ws: (np.array([len(w) * 1000 + w[0] for w in ws], np.uint32), np.ones(len(ws), np.int32)))
    look = lambda ws: table.lookup(np.frombuffer(b"".join(ws), np.uint8), np.cumsum([0, *map(len, ws)])[:-1], np.cumsum([*map(len, ws)]))[0].tolist()
    long = b"q" * 200
    for ws in ([b"ab", b"ab"], [b"ac", b"ab"], [b"cd"], [long], [long[:-1] + b"r", long], [b"ab"]):
        assert look(ws) == [len(w) * 1000 + w[0] for w in ws]


def test_word_table_starts_anew(monkeypatch):
    table = WordTable(lambda ws: (np.array([len(w) for w in ws], np.uint32), np.ones(len(ws), np.int32)), most=50, most_bytes=400)
    for i in range(60):
        w = [f"w{i}{j}".encode() * (1 + j % 7) for j in range(20)]
        ends = np.cumsum([*map(len, w)])
        assert table.lookup(np.frombuffer(b"".join(w), np.uint8), ends - [*map(len, w)], ends)[0].tolist() == [*map(len, w)]
    assert table.text_used < 2000
