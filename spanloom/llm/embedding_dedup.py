"""Near-duplicate embeddings by an inverted multi-index.

Independent codebooks on the two halves of the unit vectors span a grid of cells. Each vector lives in its
nearest cell and visits the nearest cells, found by multi-sequence traversal (public: Babenko and Lempitsky,
"The Inverted Multi-Index"), as many as the target recall of close pairs asks for. In each cell residents
meet visitors, and every pair is verified by its exact cosine in double precision.

Equal vectors are one weighted row from the start. A cell's residents and visitors are cut into chunks of
bounded size that meet by block products; a meeting returns link counts for each vector and a spanning
forest of its links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialise
from .vectors import dimension, kmeans, packed, sample

CHUNK = 512
#: Chunks of residents of a cell that meet the cell's visitors in one task.
TOGETHER = 8
MOST_CODEWORDS = 4096


def traverse(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells (i, j) of all rows at once, nearest first: by d1[row, i] + d2[row, j] (multi-sequence algorithm).

    Each codeword of the first half leads a sequence over those of the second; the next cell of a row is the head that is
    least, and only as many sequences are open as could hold it.
    """
    o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    a, b = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    b = np.concatenate([b, np.full((len(b), 1), np.inf)], 1)
    rows, at = np.arange(len(a)), np.zeros(a.shape, np.int64)
    heads = np.full(a.shape, np.inf)
    for step in range(a.shape[1] * (b.shape[1] - 1)):
        if step < a.shape[1]:
            heads[:, step] = a[:, step] + b[:, 0]
        i = heads[:, : step + 1].argmin(1)
        j = at[rows, i]
        yield o1[rows, i], o2[rows, j]
        at[rows, i] += 1
        heads[rows, i] = a[rows, i] + b[rows, j + 1]


class Grid:
    """Codebooks of both halves and how many cells a vector visits."""

    def __init__(self, x: np.ndarray, k: int):
        self.half = x.shape[1] // 2
        self.books = kmeans(x[:, : self.half], k) if self.half else np.zeros((1, 0)), kmeans(x[:, self.half :], k)
        self.visits = 1

    def walk(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The next nearest cell of each row, again and again."""
        d1, d2 = (((b**2).sum(1) - 2 * (h @ b.T)) for b, h in zip(self.books, (x[:, : self.half], x[:, self.half :])))
        for i, j in traverse(d1, d2):
            yield i * len(self.books[1]) + j

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack(list(islice(self.walk(x), self.visits)), 1).astype(np.int32)

    def calibrate(self, x: np.ndarray, threshold: float, recall: float, seed: int = 1) -> None:
        """Visits enough that of simulated partners at the threshold cosine, the hardest to meet, this share is met; walks no further."""
        rng = np.random.default_rng(seed)
        noise = rng.standard_normal(x.shape)
        noise -= np.einsum("ij,ij->i", noise, x)[:, None] * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * noise
        met, homes = np.zeros(len(x), bool), None
        for self.visits, (a, b) in enumerate(zip(self.walk(x), self.walk(y)), 1):
            homes = homes or (a, b)
            met |= (a == homes[1]) | (b == homes[0])
            if met.mean() >= recall:
                break


def _visit(grid: Grid, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(v.as_buffer()) for v in batch.column("v")])
                c = grid.cells(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(c), pa.list_(pa.int32()))], ["id", "key", "w", "v", "cells"])

    return run


def groups(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a link matrix the least row of their component, found breadth first by whole rows; -1 without links."""
    row, col = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for start in np.flatnonzero(linked.any(1)).tolist():
        if row[start] >= 0:
            continue
        new = np.array([start])
        while len(new):
            row[new] = start
            cols = np.flatnonzero(linked[new].any(0) & (col < 0))
            col[cols] = start
            new = np.flatnonzero(linked[:, cols].any(1) & (row < 0))
    return row, col


def _meet(threshold: float):
    """Chunks of residents and visitors of a cell: rows (id, key, links, other); other is null in count rows.

    ``key`` tells vectors apart that have one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.column("cell")[i].as_py()
                r, v = (batch.column(c)[i].values for c in ("r", "v"))
                rid, vid = r.field("id").to_numpy(), v.field("id").to_numpy()
                rk, vk = r.field("key").to_numpy(), v.field("key").to_numpy()
                rw, vw = r.field("w").to_numpy(), v.field("w").to_numpy()
                rx, vx = (np.stack([np.frombuffer(b.as_buffer()) for b in s.field("v")]) for s in (r, v))
                linked = (rx @ vx.T >= threshold) & ((rid[:, None] != vid[None, :]) | (rk[:, None] != vk[None, :]))
                if not linked.any():
                    continue
                rc, vc = (np.stack([np.asarray(x.values) for x in s.field("cells")]) for s in (r, v))
                count_r = (linked @ vw.astype(np.float64)).astype(np.int64)
                # a visitor that lives here too is a resident in another meeting or in this; one from elsewhere counts here
                # unless the resident visits the visitor's cell
                met = linked & (vc[:, 0] != cell)
                if met.any():
                    for c in rc.T:
                        met &= c[:, None] != vc[None, :, 0]
                count_v = (rw.astype(np.float64) @ met).astype(np.int64)
                row, col = groups(linked)
                ids, root = np.concatenate([rid, vid]), np.concatenate([row, col])
                ids, root = ids[root >= 0], rid[root[root >= 0]]
                ids, root = ids[ids != root], root[ids != root]
                some = count_r > 0, count_v > 0
                counts = np.concatenate([count_r[some[0]], count_v[some[1]]])
                out = np.concatenate([rid[some[0]], vid[some[1]], ids])
                key = np.concatenate([rk[some[0]], vk[some[1]], np.zeros(len(ids), np.int64)])
                other = np.concatenate([np.zeros(len(counts), np.int64), root])
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(key), pa.array(np.concatenate([counts, np.zeros(len(ids), np.int64)])), pa.array(other, mask=np.arange(len(out)) < len(counts))], ["id", "key", "links", "other"])

    return run


def near_duplicates(table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", codewords: int | None = None, recall: float = 0.97, most: int = 4096) -> DataFrame:
    """One row per row of ``table``: ``(id_col, n_links, component_id, kept)``.

    Rows link when the cosine is ``threshold`` or more; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id that links reach, and ``kept`` says whether the row has that id.
    Null and zero vectors, those with null or non-finite components and those of another length than most
    link with nothing: 0 links, their own component, kept. Rows with a null id do too, with a null
    component, kept. Repeated rows count as rows of their own that link with each other; different vectors under
    one id each count their own links and share a component. An empty table
    gives an empty result; other columns are ignored.

    Index: codebooks and the number of visits come from at most ``most`` sampled distinct vectors (or 8 a codeword), copies
    counting once; every row is indexed. There are as many codewords as make cells of some 512 distinct vectors, 4096
    a half at most; beyond 8 billion distinct vectors, cells grow.
    """
    spark = table.sparkSession
    dim = dimension(table, vec_col)
    ids = table.select(F.col(id_col).cast("bigint").alias("id"))
    if not dim:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    vectors = materialise(packed(table, id_col, vec_col, dim, unit=True), "unit")
    classes = vectors.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w")).select("id", F.xxhash64("v").alias("key"), "w", "v")
    classes = materialise(classes, "classes")
    codewords = codewords or min(MOST_CODEWORDS, max(4, int((classes.count() / 512) ** 0.5)))  # cells of about 512
    x = sample(classes, max(most, 8 * codewords))
    if not len(x):
        x = np.eye(1, dim)
    grid = Grid(x, min(codewords, len(x)))
    grid.calibrate(x[:1024], threshold, recall)
    at = materialise(classes.mapInArrow(_visit(grid, dim), "id bigint, key bigint, w bigint, v binary, cells array<int>"), "cells")
    # chunks are planned without vectors; a hot cell is counted and planned in parts
    plan = at.select("id", "key", F.element_at("cells", 1).alias("home"), F.explode("cells").alias("cell")).withColumn("s", F.pmod(F.xxhash64("id"), F.lit(64)))
    size = plan.groupBy("cell", "s").agg(F.count("*").alias("v"), F.sum((F.col("cell") == F.col("home")).cast("bigint")).alias("r"))
    parts = lambda c: F.ceil(F.sum(c).over(Window.partitionBy("cell")) / CHUNK)
    size = size.select("cell", "s", parts("v").alias("v_parts"), parts("r").alias("r_parts")).where("r_parts > 0").withColumn("groups", F.ceil(F.col("r_parts") / TOGETHER))
    plan = plan.join(size, ["cell", "s"])
    # a few chunks of residents meet all visitors of their cell in one task
    part = lambda parts: F.pmod(F.xxhash64("id"), parts)
    visitors = plan.select("id", "key", "cell", part(F.col("v_parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("g"))
    residents = plan.where("cell = home").select("id", "key", "cell", part(F.col("r_parts")).alias("part")).withColumn("g", F.floor(F.col("part") / TOGETHER))

    def chunks(side: DataFrame, name: str) -> DataFrame:
        one = F.struct("id", "key", "w", "v", "cells")
        return side.join(at, ["id", "key"]).repartition("cell", "g").groupBy("cell", "g", "part").agg(F.collect_list(one).alias(name)).drop("part")

    met = chunks(residents, "r").join(chunks(visitors, "v"), ["cell", "g"]).select("cell", "r", "v").mapInArrow(_meet(threshold), "id bigint, key bigint, links bigint, other bigint")
    met = materialise(met, "met")
    counts = met.where("other is null").groupBy("id", "key").agg(F.sum("links").alias("links"))
    label = components(met.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    found = classes.join(counts, ["id", "key"], "left").join(label, "id", "left")
    digest = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]  # 128 bits in place of the vector
    found = found.select(*digest, (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    # a vector with very many copies gets its result in 64 parts
    rows = vectors.select("id", *digest, F.pmod(F.xxhash64("id"), F.lit(64)).alias("s"))
    good = rows.join(rows.select("h1", "h2", "s").distinct().join(found, ["h1", "h2"]), ["h1", "h2", "s"]).select("id", "n_links", "component_id")
    bad = table.where(F.col(id_col).isNull()).select(F.lit(None).cast("bigint").alias("id"))
    rest = ids.where("id is not null").join(good.select("id").distinct(), "id", "left_anti").unionByName(bad)
    rest = rest.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
