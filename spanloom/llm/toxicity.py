"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its words and of the 3-, 4- and 5-character pieces of each word with its ends marked,
hashed into buckets that each have a small vector. The mean vector goes into a two-class softmax, and
vectors and softmax are trained together. A misspelling that was never seen shares most of its pieces
with the word that was. Since mean and softmax are linear, a trained model is one number for each bucket,
so scoring a text is a table look-up at each of its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, flat, lean, learn_in_a_task, ranges_hash, runs, slices, small_batches, with_columns

BITS = 18
STEP = U64(0x9E3779B97F4A7C15)
ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


@cache
def word_characters() -> np.ndarray:
    """For each code point whether it is a letter or a digit."""
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased characters of the rows with a space before and after each; the positions of those spaces."""
    data, offsets = flat(texts, lower=True)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    c = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    rows = len(offsets) - 1
    out = np.full(len(c) + rows + 5, 32, np.uint32)
    out[np.arange(len(c)) + 1 + np.repeat(np.arange(rows), np.diff(at))] = c
    return out, at + np.arange(rows + 1)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (bucket of each position, whether there is a piece, first position of each row) for each kind of piece."""
    c, marks = padded(texts)
    word = word_characters()[c]
    c[~word] = 32
    n = int(marks[-1])
    wide = c.astype(U64)
    key = wide[:n] * STEP + wide[1 : n + 1]
    inside = np.ones(n, bool)
    for k, odd in zip((3, 4, 5), ODD):
        key = key * STEP + wide[k - 1 : n + k - 1]
        inside = inside & word[k - 2 : n + k - 2]
        yield ((key ^ key >> U64(29)) * odd >> U64(64 - BITS)).astype(np.int32), inside, marks
    starts, ends, _ = runs(word[: n + 1], np.array([0, n + 1]))
    whole = (ranges_hash(c[: n + 1].view(np.uint8), 4 * starts, 4 * ends) >> U64(64 - BITS)).astype(np.int32)
    yield whole, np.ones(len(whole), bool), np.searchsorted(starts, marks)


def _row_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return run[first[1:]] - run[first[:-1]]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's pieces and the share of each."""
    idx, n = np.unique(np.concatenate([b[m] for b, m, _ in features(pa.array([text], pa.string()))]), return_counts=True)
    return idx.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def fit(rows: list[tuple[str, int]], dim: int = 8, steps: int = 2000, batch: int = 32, rate: float = 0.5, least: int = 5, seed: int = 7) -> dict:
    """Trains vectors and softmax jointly by ``steps`` Adagrad steps on (text, 0 or 1) rows.

    Buckets in fewer than ``least`` of the texts stay out. No rows, no bucket that stays in, or one class: a constant model.
    """
    rng = np.random.default_rng(seed)
    share = float(np.mean([y for _, y in rows])) if rows else 0.0
    bags = [bag(text) for text, _ in rows]
    constant = {"table": np.zeros(1 << BITS, np.float32), "bias": float(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    seen = np.zeros(1 << BITS, np.int64)
    for i, _ in bags:
        seen[i] += 1
    known = np.flatnonzero(seen >= min(least, max(1, len(bags))))
    if not len(known) or share in (0.0, 1.0):
        return constant
    new = np.full(1 << BITS, -1, np.int32)
    new[known] = np.arange(len(known))
    # the bags end to end, without unknown buckets
    own = [new[i] >= 0 for i, _ in bags]
    idx = np.concatenate([new[i][k] for (i, _), k in zip(bags, own)])
    weight = np.concatenate([w[k] for (_, w), k in zip(bags, own)])
    size = np.array([int(k.sum()) for k in own])
    used = np.flatnonzero(size)
    first, label = (np.cumsum(size) - size)[used], np.array([y for _, y in rows])[used]
    size = size[used]
    del bags, own
    n = len(known)
    vectors = ((rng.random((n, dim), dtype=np.float32) - 0.5) / dim).astype(np.float32)
    weights, bias = (rng.standard_normal((dim, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32)
    gv, gw, gb = np.full(n, 1e-8, np.float32), np.full((dim, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    order, slot = np.empty(0, np.int64), np.empty(n, np.int64)
    for _ in range(steps):
        if not len(order):
            order = rng.permutation(len(used))
        part, order = order[:batch], order[batch:]
        ends = np.cumsum(size[part])
        here = np.arange(ends[-1]) + np.repeat(first[part] - (ends - size[part]), size[part])
        i, w = idx[here], weight[here]
        mean = np.add.reduceat(vectors[i] * w[:, None], ends - size[part], axis=0)
        z = mean @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(part)), label[part]] -= 1.0
        p /= len(part)
        d_w, d_b = mean.T @ p, p.sum(0)
        back = p @ weights.T
        # only the buckets of the batch have a gradient
        touched = np.flatnonzero(np.bincount(i, minlength=n))
        slot[touched] = np.arange(len(touched))
        at, whose = slot[i], np.repeat(np.arange(len(part)), size[part])
        grad = np.stack([np.bincount(at, w * back[whose, j], len(touched)) for j in range(dim)], 1).astype(np.float32)
        gv[touched] += (grad * grad).mean(1)
        vectors[touched] -= rate * grad / np.sqrt(gv[touched])[:, None]
        gw += d_w * d_w
        gb += d_b * d_b
        weights -= rate * d_w / np.sqrt(gw)
        bias -= rate * d_b / np.sqrt(gb)
    table = np.zeros(1 << BITS, np.float32)
    table[known] = vectors @ (weights[:, 1] - weights[:, 0])
    return {"table": table, "bias": float(bias[1] - bias[0])}


def learn(sample: DataFrame, most_bytes: int = 24 << 20) -> dict:
    """``fit`` of a ``labelled_sample`` in one task, on at most ``most_bytes`` bytes of text."""
    return learn_in_a_task(sample.select("text", "y", "id"), lambda rows: fit([(t, int(y)) for t, y, _ in rows]), [F.xxhash64("id"), "id"], most_bytes)


def scores(model: dict, texts: pa.Array) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, there, first in features(texts):
        total += _row_sums(np.where(there, model["table"][bucket], 0.0), first)
        n += _row_sums(there, first)
    z = np.clip(total / np.maximum(n, 1) + model["bias"], -60, 60)
    return 1 / (1 + np.exp(-z))


def score_toxicity(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) appended, under these or other ``names``.

    Null, empty and wordless texts get the score of the bias alone. A text of any length is scored whole, in memory
    of some tens of its bytes. Other columns pass through untouched (input columns named like the two outputs are
    replaced); repeated rows get equal scores; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    box = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB at any size

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                s = scores(box.value, piece.column(text_col))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*piece.schema.names, *names])

    return docs.mapInArrow(run, with_columns(docs, f"`{names[0]}` double, `{names[1]}` int"))
