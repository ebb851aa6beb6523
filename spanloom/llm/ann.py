"""Approximate nearest neighbours by multi-index hashing, for the largest inner product.

Vectors get one more component that makes all norms equal, so that order by angle is order by inner product.
Learned rotations (iterative quantisation on a bounded sample) turn them into binary codes, cut into 128-bit
substrings. A code within Hamming radius r of a query's agrees with it up to r/m bits in at least one of m
substrings (pigeonhole), so probing all substring values that near in every index finds every such code;
what is within the radius is reranked by exact inner products in double precision. The radius is learned:
exact neighbours of some queries give the distance within which nearly all neighbours lie.

Neighbours may lie at two fifths of the code length. Short substrings then reach nearly every row, so they are long, and
the values that near are too many to list: an index compares the query's substring with each distinct value it holds.

Rows are dealt by id hash into blocks of bounded size. A task reads a block, indexes its substrings once, and then
takes the queries block by block; each meeting returns each query's best few, and the best of those are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import dimension, packed, sample, scaled

BLOCK, QUERIES = 8192, 1024
WORDS = 2  # of 64 bits in a substring
#: Blocks whose answers to a query meet first, where there are more.
BLOCKS_AT_ONCE = 512


def learn_rotations(x: np.ndarray, bits: int, rounds: int = 20, seed: int = 9) -> np.ndarray:
    """Directions (dim x bits): orthogonal rotations, each refined so that signs lose least (ITQ)."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    out = []
    for _ in range(-(-bits // dim)):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ vt
        out.append(r)
    return np.concatenate(out, axis=1)[:, :bits]


def lifted(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    """Scaled, with one more component: rows all get norm 1 (``most`` is the largest norm), queries get 0."""
    x = scaled(x) if query else x / most
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, last[:, None]], axis=1)


def codes(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The code of each row as words of 64 bits; whole substrings, filled up with zeros."""
    bits = np.packbits(x @ directions > 0, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % (8 * WORDS)))).view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of words with those of ``b``."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class SubstringIndexes:
    """For each substring of a block's codes, its distinct values and the rows that have them."""

    def __init__(self, c: np.ndarray):
        self.codes, self.parts = c, [c[:, j : j + WORDS] for j in range(0, c.shape[1], WORDS)]
        self.rows = [np.lexsort(p.T) for p in self.parts]
        new = [np.concatenate([[True], (p[r][1:] != p[r][:-1]).any(1)]) for p, r in zip(self.parts, self.rows)]
        self.values = [np.ascontiguousarray(p[r[n]]) for p, r, n in zip(self.parts, self.rows, new)]
        self.first = [np.append(np.flatnonzero(n), len(c)) for n in new]
        self.visited = 0

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code is within ``radius`` of the query code ``q``."""
        each, more = divmod(radius, len(self.parts))
        hit = np.zeros(len(self.codes), bool)
        for j, values in enumerate(self.values):
            at = np.flatnonzero(distances(values, q[j * WORDS : (j + 1) * WORDS]) <= each - (j > more))
            if len(at):
                n = self.first[j][at + 1] - self.first[j][at]
                total = np.cumsum(n)
                hit[self.rows[j][np.arange(total[-1]) + np.repeat(self.first[j][at] - (total - n), n)]] = True
        rows = np.flatnonzero(hit)
        self.visited += len(rows)
        return rows[distances(self.codes[rows], q) <= radius]


def _blocks(model: dict, query: bool):
    """One row for each block: ids, vectors and codes as bytes. Of rows with one id that of the least bytes is taken."""

    def run(table: pa.Table) -> pa.Table:
        slot = table.column("slot").slice(0, 1)
        table = table.sort_by([("id", "ascending"), ("v", "ascending")])
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        x = np.stack([np.frombuffer(v.as_buffer()) for v in table.column("v").take(pa.array(first))])
        c = codes(lifted(x, model["norm"], query), model["directions"])
        return pa.table({"slot": slot, "ids": [ids.tobytes()], "x": [x.tobytes()], "c": [c.tobytes()]})

    return run


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, largest first, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k)[len(ids) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _search(model: dict, k: int, dim: int):
    """A block of rows comes before the blocks of queries of its slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = x = index = None
        for batch in batches:
            for i in range(batch.num_rows):
                slot = batch.column("slot")[i].as_py()
                mine, vectors, c = (np.frombuffer(batch.column(n)[i].as_buffer(), t) for n, t in (("ids", np.int64), ("x", np.float64), ("c", np.uint64)))
                vectors, c = vectors.reshape(len(mine), dim), c.reshape(len(mine), -1)
                if not batch.column("query")[i].as_py():
                    ids, x, index, here = mine, vectors, SubstringIndexes(c), slot
                    continue
                if index is None or here != slot:
                    continue  # no rows fell into this slot
                out = []
                for q in range(len(mine)):
                    radius = model["radius"]
                    rows = index.within(c[q], radius)
                    while len(rows) <= k and len(rows) < len(ids) and radius < 64 * c.shape[1]:  # a block never offers fewer than k while it has them
                        radius = min(2 * radius + 8, 64 * c.shape[1])
                        rows = index.within(c[q], radius)
                    rows = rows[ids[rows] != mine[q]]
                    s = np.einsum("ij,j->i", x[rows], vectors[q])
                    top = best(ids[rows], s, k)
                    out.append((np.full(len(top), mine[q]), ids[rows[top]], s[top], np.full(len(top), slot)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in zip(*out)], ["query_id", "vec_id", "score", "slot"])

    return run


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = np.stack([np.frombuffer(v.as_buffer()) for v in batch.column("v")])
            with np.errstate(over="ignore"):
                norm = (np.abs(x).max(1) * np.sqrt((scaled(x) ** 2).sum(1))).max()
            yield pa.RecordBatch.from_arrays([pa.array([min(norm, np.finfo(float).max)])], ["n"])


def fit(vectors: DataFrame, rows: int, k: int, bits: int = 256, most: int = 8192, probes: int = 64, recall: float = 0.98) -> dict:
    """Directions and radius from a bounded sample; the norm bound from all rows.

    The radius is the ``recall`` quantile of the code distances of ``probes`` sampled vectors to their exact
    ``k`` nearest: as the sample has ``len(sample)`` of ``rows`` rows, the nearest ``k * len(sample) / rows`` or
    more (at least 1) of the sample stand for the nearest ``k`` of all; with few rows the sample is all rows.
    """
    x = sample(vectors, most)
    norm = float(vectors.mapInArrow(_norms, "n double").agg(F.max("n")).first()[0])
    y = lifted(x, norm, False)
    directions = learn_rotations(y, bits)
    c, q = codes(y, directions), x[:probes]
    qc = codes(lifted(q, norm, True), directions)
    near = max(1, -(-k * len(x) // max(rows, 1)))
    far = []
    for i in range(len(q)):
        s = x @ q[i]
        s[i] = -np.inf
        top = np.argsort(-s, kind="stable")[:near]
        far += distances(c[top], qc[i]).tolist()
    return {"directions": directions, "norm": norm, "radius": int(np.quantile(far, recall)) if far else bits}


def nearest(table: DataFrame, query_mod: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id ``query_mod`` divides, its ``k`` nearest among all other rows.

    Nearness is the inner product in double precision, ties go to the smaller id; a query with fewer than ``k``
    other rows gets them all. Null and zero vectors, those with null or non-finite components, those of another
    length than most, and rows with a null id take no part, neither as queries nor as candidates. Rows with
    one id count as one row, with the vector of the least bytes. An empty table gives an empty result. Other columns
    are ignored. Components of any finite size have codes; inner products beyond double precision come out infinite.
    """
    spark = table.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    dim = dimension(table, vec_col)
    vectors = materialise(packed(table, id_col, vec_col, dim, unit=False), "vectors") if dim else None
    rows = vectors.count() if dim else 0
    if not rows:
        return spark.createDataFrame([], out)
    model = fit(vectors, rows, k, bits)
    spread = lambda d, n: d.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(n)))
    n_blocks = -(-rows // BLOCK)
    schema = "slot bigint, ids binary, x binary, c binary"
    data = spread(vectors, n_blocks).groupBy("slot").applyInArrow(_blocks(model, False), schema)
    n_queries = max(1, -(-rows // (query_mod * QUERIES)))
    queries = spread(vectors.where(F.pmod("id", F.lit(query_mod)) == 0), n_queries).groupBy("slot").applyInArrow(_blocks(model, True), schema)
    queries = queries.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    side = lambda d, query: d.select("slot", F.lit(query).alias("query"), "ids", "x", "c")
    both = side(data, False).unionByName(side(queries, True)).repartition(n_blocks, "slot").sortWithinPartitions("slot", "query")
    found = both.mapInArrow(_search(model, k, dim), "query_id bigint, vec_id bigint, score double, slot bigint")
    best_of = lambda d, *key: d.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    if n_blocks > BLOCKS_AT_ONCE:  # the same answer, but no task meets all blocks' best of a query
        found = best_of(found, "query_id", F.floor(F.col("slot") / BLOCKS_AT_ONCE))
    return best_of(found, "query_id").select("query_id", "rank", "vec_id", "score")
