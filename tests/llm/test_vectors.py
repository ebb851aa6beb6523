"""Nearest neighbours and embedding dedup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import ann as A
from spanloom.llm import embedding_dedup as D
from spanloom.llm.queries import QUERIES

ODD = [(901, None), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7), (906, [1.0] * 5), (907, []), (None, [1.0] * 8)]


def table(spark, x, odd=True):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + (ODD if odd else [])
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))


def vectors(n, dim, seed, scale=False):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x[n // 2 : n // 2 + 20] = x[0] + 0.05 * r.standard_normal((20, dim))
    x[-5:] = x[3]
    return (x * (r.random((n, 1)) * 3 + 0.1) if scale else x).astype(np.float32).astype(float)


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    x = vectors(800, 8, 1, scale)
    got = A.nearest(table(spark, x), query_mod=20, k=20).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 800, 20))
    hit = 0
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in {r[1] for r in rows}
        s = x @ x[q]
        assert all(abs(r[2] - s[r[1]]) < 1e-9 for r in rows)
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(800), -s))[:20]) & {r[1] for r in rows})
    assert hit / (20 * len(by)) >= 0.9


def test_pigeonhole_misses_nothing():
    r = np.random.default_rng(2)
    for n, high in ((500, 1 << 62), (3000, 1 << 2), (40, 1 << 62)):
        c = r.integers(0, high, (n, 4)).astype(np.uint64)
        index = A.SubstringIndexes(c)
        for radius in (0, 2, 3, 7, 40, 110, 128, 256):
            q = c[7]
            want = [i for i in range(n) if sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(c[i], q)) <= radius]
            assert index.within(q, radius).tolist() == want


def test_probing_reaches_a_small_part_of_a_block():
    """Both where neighbours are close and where they are as far as those of random vectors."""
    r = np.random.default_rng(3)
    x = r.standard_normal((4000, 64))
    x[1000:1020] = x[7] + 0.2 * r.standard_normal((20, 64))
    rotations = A.learn_rotations(x / np.linalg.norm(x, axis=1, keepdims=True), 256)
    c = A.codes(x, rotations)
    index = A.SubstringIndexes(c)
    assert set(range(1000, 1020)) <= set(index.within(c[7], 52)) and index.visited < 0.02 * len(x)
    index.visited = 0
    for q in c[:50]:
        index.within(q, 107)
    assert index.visited < 0.2 * 50 * len(x)


def test_one_id_with_two_vectors_and_huge_components(spark):
    rows = [(i, [float(i == j) + 1e-3 * j for j in range(8)]) for i in range(8)] + [(3, [9.0] * 8), (100, [1e200] * 8), (100, [2e200] * 8)]
    a, b = (sorted(map(tuple, A.nearest(spark.createDataFrame(d, "vec_id bigint, embedding array<double>").repartition(n), query_mod=4, k=3).collect())) for d, n in ((rows, 1), (rows[::-1], 5)))
    assert a == b and len(a) == 9 and all(v == 100 for q, rank, v, _ in a if rank == 1 and q != 100)


def test_answers_of_many_blocks(spark, monkeypatch):
    x = vectors(900, 8, 11)
    want = sorted(map(tuple, A.nearest(table(spark, x)).collect()))
    monkeypatch.setattr(A, "BLOCKS_AT_ONCE", 2)
    monkeypatch.setattr(A, "BLOCK", 200)
    got = sorted(map(tuple, A.nearest(table(spark, x)).collect()))
    assert len(got) == len(want) and np.mean([p in set(want) for p in got]) > 0.95


def test_nearest_few_rows(spark):
    x = vectors(60, 8, 3)[:6]
    got = A.nearest(table(spark, x, odd=False), query_mod=2, k=20)
    assert got.groupBy("query_id").count().select("count").distinct().collect()[0][0] == 5
    assert A.nearest(table(spark, x).limit(0)).count() == 0
    twice = table(spark, x, odd=False).unionByName(table(spark, x, odd=False))
    assert A.nearest(twice, query_mod=2).count() == got.count()


def test_recall_on_driver_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got = QUERIES["op5_nearest"](spark, sf).toPandas()
    hit = sum(len(set(ids[np.lexsort((ids, -np.where(ids == q, -np.inf, x @ x[np.flatnonzero(ids == q)[0]])))[:20]]) & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert hit / len(got) >= 0.9


def brute_links(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    lab = np.arange(len(x))
    for _ in range(len(x)):
        new = lab.copy()
        i, j = np.nonzero(s)
        np.minimum.at(new, i, lab[j])
        if (new == lab).all():
            break
        lab = new
    return s.sum(1), lab


def test_dedup_by_brute_force(spark):
    x = vectors(900, 16, 5)
    n, lab = brute_links(x)
    got = {r["vec_id"]: r for r in D.near_duplicates(table(spark, x)).collect()}
    assert len(got) == 900 + len(ODD)
    found = np.array([got[i]["n_links"] for i in range(900)])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    assert np.mean([got[i]["component_id"] == lab[i] for i in range(900)]) > 0.97
    for i, _ in ODD:
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(900))


def test_dedup_with_all_cells_visited_is_exact(spark):
    x = vectors(300, 8, 6)
    n, lab = brute_links(x)
    got = {r["vec_id"]: r for r in D.near_duplicates(table(spark, x, odd=False), codewords=3, recall=1.0).collect()}
    assert [got[i]["n_links"] for i in range(300)] == n.tolist() and [got[i]["component_id"] for i in range(300)] == lab.tolist()


def test_dedup_copies_and_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(3000, [3.0, -1.0, 0.0])]
    got = D.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert {tuple(r) for r in got.where("vec_id < 3000").select("n_links", "component_id").collect()} == {(2999, 0)}
    assert got.where("vec_id = 3000").first()["n_links"] == 0 and got.where("kept").count() == 2
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert D.near_duplicates(empty).count() == 0
    assert D.near_duplicates(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")).first()["kept"]


def test_multi_sequence_order():
    r = np.random.default_rng(1)
    a, b = r.random((5, 9)), r.random((5, 7))
    cells = list(D.traverse(a, b))
    assert len(cells) == 63
    for k in range(5):
        cost = [a[k, i[k]] + b[k, j[k]] for i, j in cells]
        assert np.allclose(cost, np.sort(np.add.outer(a[k], b[k]).ravel()))
        assert len({(i[k], j[k]) for i, j in cells}) == 63


def test_calibration_stops_at_the_recall():
    """With 256 codewords a half it takes seconds, as it walks only as far as the recall asks for."""
    import time

    r = np.random.default_rng(2)
    x = r.standard_normal((4096, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = D.Grid(x, 256)
    began = time.time()
    grid.calibrate(x[:1024], 0.9, 0.97)
    assert time.time() - began < 10 and 1 < grid.visits < 65536
    y = 0.9 * x[:300] + np.sqrt(1 - 0.81) * (lambda z: z / np.linalg.norm(z, axis=1, keepdims=True))((lambda z: z - (z * x[:300]).sum(1)[:, None] * x[:300])(r.standard_normal((300, 64))))
    a, b = grid.cells(x[:300]), grid.cells(y)
    assert np.mean([p[0] in set(q) or q[0] in set(p) for p, q in zip(a.tolist(), b.tolist())]) >= 0.93


def test_groups_of_a_meeting_by_plain_search():
    r = np.random.default_rng(8)
    for share in (0.02, 0.1, 0.5):
        m = r.random((30, 25)) < share
        row, col = D.groups(m)
        label = list(range(55))
        for _ in range(55):
            for i, j in zip(*np.nonzero(m)):
                label[i] = label[30 + j] = min(label[i], label[30 + j])
        assert row.tolist() == [label[i] if m[i].any() else -1 for i in range(30)]
        assert col.tolist() == [label[30 + j] if m[:, j].any() else -1 for j in range(25)]


def test_a_dense_cell_in_many_parts(spark, monkeypatch):
    """One cell holds nearly everything, and its chunks meet in groups."""
    monkeypatch.setattr(D, "CHUNK", 16)
    monkeypatch.setattr(D, "TOGETHER", 2)
    r = np.random.default_rng(9)
    x = np.concatenate([np.array([3.0] * 8) + r.standard_normal((300, 8)), r.standard_normal((40, 8))])
    n, lab = brute_links(x)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {q["vec_id"]: q for q in D.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), codewords=2, recall=1.0).collect()}
    assert [got[i]["n_links"] for i in range(340)] == n.tolist() and [got[i]["component_id"] for i in range(340)] == lab.tolist()


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 2.0]), (4, [-1.0, 0.0])]
    got = sorted(map(tuple, D.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).select("vec_id", "n_links", "component_id").collect()))
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_dedup_recall_beside_copies(spark):
    """Pairs just above the threshold are met as often where half of all rows are copies of one vector."""
    r = np.random.default_rng(4)
    a = r.standard_normal((400, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((400, 32))
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, 0.902 * a + np.sqrt(1 - 0.902**2) * b])
    copies = [(1000 + i, [1.0] + [0.0] * 31) for i in range(800)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + copies
    got = {q["vec_id"]: q["n_links"] for q in D.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), codewords=16).where("vec_id < 1000").collect()}
    n, _ = brute_links(x)
    assert sum(got.values()) >= 0.96 * n.sum()
