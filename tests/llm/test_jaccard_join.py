"""The n-gram Jaccard join against brute force, and connected components."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import jaccard_join as J
from spanloom.llm.common import components, flat


def word_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, threshold=80):
    sets = [(i, word_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            k = len(s & t)
            if s and t and 100 * k >= threshold * (len(s) + len(t) - k):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {(i, len(s), find(i)) for i, s in sets}


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    passage = [r.choice(vocab) for _ in range(20)]
    bases = [[r.choice(vocab) for _ in range(r.choice([3, 5, 9, 40, 60]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.2:
            w += passage
        rows.append((i * 7 % 1000, " ".join(x.upper() if r.random() < 0.3 else x for x in w)))
    return [*rows, (5001, None), (5002, ""), (5003, " \n\t"), (5004, "ÄÖ x"), (5005, "äö x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_shingles", F.lit("clash")).repartition(3)
    got = {tuple(r) for r in J.ngram_jaccard_components(df).collect()}
    assert got == brute(rows)


def test_border_cases_that_leaders_miss(spark):
    """A chain of texts, each close to the next only, and a group around a text that isn't its leader."""
    base = [f"a{i}" for i in range(100)]
    rows = [(1000 - k, " ".join(base[k : k + 60])) for k in range(0, 40, 4)]
    for k in range(20):
        w = list(base[:60])
        w[3 * k] = f"z{k}"
        rows.append((k, " ".join(w)))
    assert {tuple(r) for r in J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, long), (8, long + " end"), (1, "A B C D E F")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, J.ngram_jaccard_components(df).collect()), key=str)
    assert got == sorted([(3, 2, 1), (3, 2, 1), (None, 2, None), (9, 59996, 8), (8, 59997, 8), (1, 2, 1)], key=str)
    assert J.ngram_jaccard_components(df.limit(0)).count() == 0


def test_a_large_group_of_copies(spark):
    rows = [(i, "one two three four five six seven") for i in range(3000)] + [(5000 + i, f"u{i} v{i} w{i}") for i in range(50)]
    got = {r["component_id"] for r in J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id < 3000").collect()}
    assert got == {0}


def test_keep_one(spark):
    rows = [(5, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (7, None, "z"), (None, "a b c d e f", "n")]
    kept = J.keep_one_of_each_component(spark.createDataFrame(rows, "doc_id bigint, text string, extra string"))
    assert sorted(((r["doc_id"], r["extra"]) for r in kept.collect()), key=str) == sorted([(2, "y"), (7, "z"), (None, "n")], key=str)


def test_shingles_do_not_cross_rows():
    a = J.shingle_sets(*flat(pa.array(["a b c d e", "f g h", None, "a b c d e", "a  b\tc\nd e"])))
    assert [len(s) for s in a] == [1, 1, 0, 1, 1] and a[0][0] == a[3][0] == a[4][0]


def test_prefixes_of_every_order_meet():
    """Sets at the threshold share a prefix token under each order (the filter loses nothing)."""
    r = np.random.default_rng(0)
    for _ in range(200):
        both = r.integers(1, 1 << 62, r.integers(8, 80)).astype(np.uint64)
        extra = r.integers(1, 1 << 62, 40).astype(np.uint64)
        n = len(both) // 8
        x, y = np.unique(np.concatenate([both, extra[:n]])), np.unique(np.concatenate([both, extra[20 : 20 + n]]))
        if 100 * len(both) < 80 * (len(both) + 2 * n):
            continue
        level = lambda t: (t % np.uint64(7)).astype(np.uint8)
        for k in range(J.ORDERS):
            p, q = (set(s[J.ranked(s, level(s), k)[: len(s) - -(-80 * len(s) // 100) + 1]].tolist()) for s in (x, y))
            assert p & q


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(30)]
    got = {x["id"]: x["component_id"] for x in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    root = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    touched = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: root[v] for v in touched}
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_a_null_id_does_not_hide_its_copies(spark):
    """The row without an id sends nothing itself, so a copy with an id must send the text of both."""
    text = " ".join(f"c{i}" for i in range(40))
    rows = [(None, text), (2, text), (4, text + " end"), (6, None)]
    got = J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 36, None), (2, 36, 2), (4, 37, 2), (6, 0, 6)], key=str)


@pytest.mark.parametrize("bits", [6, 16, 18])
def test_tokens_come_back_whole_from_their_bucket(bits):
    """All 64 bits come back, and tokens of several documents keep their number."""
    tok = np.sort(np.random.default_rng(bits).integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    bucket = int(tok[0] >> np.uint64(64 - bits))
    tok = tok[tok >> np.uint64(64 - bits) == bucket]
    rest = tok & np.uint64((1 << 64 - bits) - 1)
    hi, lo = (rest >> np.uint64(32)).astype(np.int64), (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    idx, many = np.full(len(tok), J.SEVERAL, np.uint16), np.full(len(tok), 16, np.uint16)
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    row = (bucket, 7, idx.tobytes(), J.packed_gaps(np.diff(hi, prepend=0)), lo.tobytes(), many.tobytes())
    out = J._count(bits)(pa.table([pa.array([v], t) for v, t in zip(row, kinds)], ["bucket", "block", "idx", "hi", "lo", "many"]))
    assert np.array_equal(np.sort(np.frombuffer(out.column("tok")[0].as_py(), np.uint64)), tok)
    assert set(out.column("level")[0].as_py()) == {32}  # 8 * log2(16)


def test_gaps_of_any_size():
    r = np.random.default_rng(5)
    for high in (2, 256, 257, 65536, 65537, 1 << 30, 1 << 47):
        gap = r.integers(0, high, 500)
        assert (J.unpacked_gaps(J.packed_gaps(gap), 500).astype(np.int64) == gap).all()


def test_large_ids_beside_null_ids(spark):
    """Ids that a float can't hold stay what they are where a batch has null ids too."""
    text = " ".join(f"g{i}" for i in range(30))
    rows = [((1 << 60) + 1, text), ((1 << 60) + 3, text + " end"), (None, text), ((1 << 60) + 5, "other words of another text")]
    got = J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    want = [((1 << 60) + 1, 26, (1 << 60) + 1), ((1 << 60) + 3, 27, (1 << 60) + 1), (None, 26, None), ((1 << 60) + 5, 1, (1 << 60) + 5)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_words_with_one_polynomial_hash_stay_apart():
    """Thue-Morse words and their complements collide under any polynomial modulo a power of two."""
    for k in (10, 11, 12):
        bits = [bin(i).count("1") % 2 for i in range(1 << k)]
        a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
        one, other = J.shingle_sets(*flat(pa.array([a, b])))
        assert one[0] != other[0]


def test_blocks_are_bounded_in_rows(spark):
    """More short texts than a block's positions can number, whatever the session says about batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        rows = spark.range(140_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("k"), F.pmod("id", F.lit(70_000)).cast("string")).alias("text")).coalesce(1)
        got = J.ngram_jaccard_components(rows)
        assert got.where("component_id <> doc_id % 70000 or n_shingles <> 1").count() == 0 and got.count() == 140_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@pytest.mark.parametrize("seed", [3, 4])
def test_hot_keys_in_many_parts_give_the_same(spark, monkeypatch, seed):
    """With the least shares per part, every list, leader and class is dealt over many parts."""
    monkeypatch.setattr(J, "SHARE", 2)
    monkeypatch.setattr(J, "PARTS", 3)
    monkeypatch.setattr(J, "CHUNK", 2)
    rows = corpus(seed, 250)
    got = {tuple(r) for r in J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_components_of_a_hub_in_parts(spark):
    edges = [(0, i) for i in range(1, 400)] + [(900, i) for i in range(400, 800)] + [(5, 900)]
    got = {r["component_id"] for r in components(spark.createDataFrame(edges, "src bigint, dst bigint"), salts=3).collect()}
    assert got == {0}


def test_keep_one_keeps_versions(spark):
    rows = [(1, "alpha beta gamma delta eps"), (1, "other words of this id here"), (1, "other words of this id here"), (2, "alpha beta gamma delta eps"), (3, None), (3, None)]
    kept = J.keep_one_of_each_component(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)
