"""Language ID by rank-order profiles (public: Cavnar and Trenkle, "N-Gram-Based Text Categorization").

A profile is the list of the most frequent letter 1- to 3-grams, most frequent first. A text belongs to
the language whose profile has the least out-of-place distance: the sum, over the text's own list, of the
difference between a gram's two ranks, or the list length where the language lacks the gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, flat, lean, learn_in_a_task, slices, small_batches, with_columns

TAGS = U64(0x1FFFFF << 42), U64(0x1FFFFE << 42)


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_keys(texts: pa.Array) -> list[np.ndarray]:
    """The letter 1-, 2- and 3-grams of each row as integers; other characters are word ends."""
    data, offsets = flat(texts, lower=True)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    c = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(U64)
    c[~letters()[c.astype(np.int64)]] = 0
    out = []
    for a, b in zip(at[:-1], at[1:]):
        x = c[a:b]
        on = x > 0
        one = x[on] | TAGS[0]
        two = (x[:-1] << U64(21) | x[1:] | TAGS[1])[on[:-1] | on[1:]]
        three = (x[:-2] << U64(42) | x[1:-1] << U64(21) | x[2:])[on[1:-1]] if len(x) > 2 else x[:0]
        out.append(np.concatenate([one, two, three]) if len(one) else one)
    return out


def top(grams: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The most frequent of sorted grams, most frequent first; of equally frequent ones the smaller code first."""
    return grams[np.argsort(-n, kind="stable")[:most]]


def ranking(keys: np.ndarray, most: int) -> np.ndarray:
    """The most frequent grams of a list."""
    return top(*np.unique(keys, return_counts=True), most)


def tally(texts: list[str], every: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all texts and how often each occurs, counted a bounded number of grams at a time."""
    grams, n, new, size = np.empty(0, U64), np.empty(0, np.int64), [], 0
    for k, text in enumerate(texts, 1):
        new += gram_keys(pa.array([text], pa.string()))
        size += len(new[-1])
        if size >= every or k == len(texts):
            g, m = np.unique(np.concatenate(new), return_counts=True)
            grams, back = np.unique(np.concatenate([grams, g]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, m]), len(grams)).astype(np.int64)
            new, size = [], 0
    return grams, n


def fit_profiles(texts: dict[str, list[str]], most: int = 300) -> dict:
    """Profiles of each language from its texts; languages whose texts have no letter are left out."""
    lists = {k: top(*tally(v), most) for k, v in sorted(texts.items())}
    lists = {k: v for k, v in lists.items() if len(v)}
    grams = np.unique(np.concatenate([*lists.values(), np.empty(0, U64)]))
    ranks = np.full((len(grams) + 1, len(lists)), most, np.int32)
    for j, v in enumerate(lists.values()):
        ranks[np.searchsorted(grams, v), j] = np.arange(len(v))
    return {"langs": list(lists), "grams": grams, "ranks": ranks, "most": most}


def classify(model: dict, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The nearest language of each row (ties: the first in the alphabet) and 1 minus its relative distance."""
    langs, grams, ranks, most = (model[k] for k in ("langs", "grams", "ranks", "most"))
    preds, scores = [], []
    for keys in gram_keys(texts):
        if not len(keys) or not langs:
            preds.append("und")
            scores.append(0.0)
            continue
        mine = ranking(keys, most)
        at = np.searchsorted(grams, mine)
        at[grams[np.minimum(at, len(grams) - 1)] != mine] = len(grams)
        theirs = ranks[at]
        d = np.where(theirs == most, most, np.abs(theirs - np.arange(len(mine))[:, None])).sum(0)
        best = int(d.argmin())
        preds.append(langs[best])
        scores.append(1.0 - float(d[best]) / (most * len(mine)))
    return preds, scores


def learn(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, max_rows: int = 6000, most: int = 300, row_bytes: int = 1 << 20, most_bytes: int = 32 << 20) -> dict:
    """Fits profiles on a bounded sample, in one task: at most ``per_language`` rows of a language, ``max_rows`` in all, those with
    the least id hashes (of equal ids the lesser text); texts of at most ``row_bytes`` bytes, ``most_bytes`` bytes in all.
    """
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= row_bytes)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    keys = rows.select("lang", F.xxhash64("id").alias("h"), "id", F.xxhash64("text").alias("t"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("part"))
    # a language with a third of all rows is ranked in each task, then in 64 parts, then as a whole
    for part in (["lang", "part"], ["lang"]):
        keys = keys.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("h", "id", "t"))).where(F.col("r") <= per_language)
    picked = keys.orderBy("r", "lang").limit(max_rows).select("lang", "id", "t").distinct()  # max_rows bounds what is broadcast
    sample = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "id", "t"]).groupBy("lang", "id", "t").agg(F.min("text").alias("text"))

    def fit(found: list[tuple]) -> dict:
        texts: dict[str, list[str]] = {}
        for lang, text, *_ in found:
            texts.setdefault(lang, []).append(text)
        return fit_profiles(texts, most)

    return learn_in_a_task(sample.select("lang", "text", "id", "t"), fit, [F.xxhash64("id"), "id", "lang", "t"], most_bytes)


def predict_language(docs: DataFrame, model: dict, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) appended, under these or other ``names``.

    Null or empty texts and texts without a letter give ``und`` and 0, as does an empty model. A text of any length is
    ranked whole. An empty table gives an empty result. All other columns pass through untouched (input columns named
    like the two outputs are replaced). Repeated rows get equal answers; of languages at the same distance the first in
    the alphabet wins.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    box = docs.sparkSession.sparkContext.broadcast(model)  # at most languages x profile length

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                preds, scores = classify(box.value, piece.column(text_col))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*piece.schema.names, *names])

    return docs.mapInArrow(run, with_columns(docs, f"`{names[0]}` string, `{names[1]}` double"))
