"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes weighted counts of hashed byte 1- to 3-grams and of word-shape pairs (case, symbols, digits,
repetition of the word before); a truncated SVD of a labelled sample (bounded) turns them into short unit
vectors. The labelled vectors go to every task; exact cosines of each text with all of them come from
blocked matrix products, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, learn_in_a_task, ranges_hash, runs, slices, small_batches, with_columns

GRAMS = 2048
SHAPES = 32
SIZE = GRAMS + SHAPES * SHAPES
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
KINDS = np.zeros(256, np.uint8)  # what a byte adds to the shape of its word
KINDS[97:123] = KINDS[128:] = 1
KINDS[65:91] = 2
KINDS[48:58] = 4
KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 8


def counts(texts: pa.Array) -> np.ndarray:
    """The feature counts of each row."""
    data, offsets = flat(texts)
    rows = len(offsets) - 1
    total = np.zeros(rows * SIZE)
    if len(data):
        row = np.repeat(np.arange(rows) * SIZE, np.diff(offsets))
        wide = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint32)
        key = wide[: len(data)]
        for k in range(3):
            key = key | wide[k : len(data) + k] << np.uint32(8 * k)
            h = (key + np.uint32(k)) * np.uint32(0x9E3779B1) >> np.uint32(32 - 11)
            ok = row[: len(data) - k] == row[k:] if k else slice(None)
            total += np.bincount((row[: len(data) - k] + h[: len(data) - k])[ok], minlength=rows * SIZE)
        starts, ends, who = runs(~SPACE[data], offsets)
        if len(starts):
            shape = np.bitwise_or.reduceat(KINDS[data], starts).astype(np.int64)  # the spaces between have no kind
            word = ranges_hash(data, starts, ends)
            same = np.zeros(len(word), np.int64)
            same[1:] = (word[1:] == word[:-1]) & (who[1:] == who[:-1])
            shape += 16 * same
            before = np.concatenate([[0], shape[:-1]])
            total += np.bincount(who * SIZE + GRAMS + before * SHAPES + shape, minlength=rows * SIZE)
    return total.reshape(rows, SIZE)


def weigh(x: np.ndarray, idf: np.ndarray | None = None) -> np.ndarray:
    """Square-root counts, each of the two kinds of features with norm 1."""
    x = np.sqrt(x).astype(np.float32)
    if idf is not None:
        x *= idf
    for a, b in ((0, GRAMS), (GRAMS, SIZE)):
        x[:, a:b] /= np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(rows: list[tuple[str, int]], dim: int = 48, neighbours: int = 15, seed: int = 5) -> dict:
    """Latent-semantic vectors of (text, 0 or 1) rows by a randomised SVD. Without rows every score is 0.5."""
    if not rows:
        return {"basis": np.zeros((SIZE, 1), np.float32), "idf": np.ones(SIZE, np.float32), "vectors": np.zeros((1, 1), np.float32), "labels": np.array([0.5], np.float32), "k": 1, "prior": 0.5}
    raw = np.concatenate([counts(pa.array([t for t, _ in rows[i : i + 200]], pa.string())).astype(np.float32) for i in range(0, len(rows), 200)])
    idf = np.log1p(len(rows) / (1 + (raw > 0).sum(0))).astype(np.float32)
    x = weigh(raw, idf)
    del raw
    rng = np.random.default_rng(seed)
    dim = min(dim, len(rows), SIZE)
    q = rng.standard_normal((SIZE, dim + 10)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt.T)[:, :dim].astype(np.float32)
    y = np.array([y for _, y in rows], np.float32)
    return {"basis": basis, "idf": idf, "vectors": unit(x @ basis), "labels": y, "k": min(neighbours, len(rows)), "prior": float(y.mean())}


def learn(sample: DataFrame, most_bytes: int = 24 << 20) -> dict:
    """``fit`` of a ``labelled_sample`` in one task, on at most ``most_bytes`` bytes of text."""
    return learn_in_a_task(sample.select("text", "y", "id"), lambda rows: fit([(t, int(y)) for t, y, _ in rows]), [F.xxhash64("id"), "id"], most_bytes)


def scores(model: dict, texts: pa.Array, block: int = 256) -> np.ndarray:
    """Votes of the nearest labelled vectors, all that tie with the last among them; without any similarity the mean label."""
    out = np.empty(len(texts))
    for i in range(0, len(texts), block):
        v = unit(weigh(counts(texts.slice(i, block)), model["idf"]) @ model["basis"])
        sim = v @ model["vectors"].T
        least = -np.partition(-sim, model["k"] - 1, axis=1)[:, model["k"] - 1 : model["k"]]
        w = np.where((sim >= least) & (sim > 0), sim, 0.0).astype(np.float64)
        total = w.sum(1)
        out[i : i + block] = np.where(total > 1e-9, (w @ model["labels"]) / np.maximum(total, 1e-9), model["prior"])
    return np.clip(out, 0, 1)


def score_quality(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) appended, under these or other ``names``.

    Null and empty texts have no vector and get the mean label of the sample. A text of any length is scored whole;
    its vector has a fixed size. Other columns pass through untouched (input columns named like the two outputs are replaced); repeated rows get equal scores; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    box = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                s = scores(box.value, piece.column(text_col))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*piece.schema.names, *names])

    return docs.mapInArrow(run, with_columns(docs, f"`{names[0]}` double, `{names[1]}` int"))
