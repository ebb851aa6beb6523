"""Linking mentions to a vocabulary: abbreviations, vectors, top-k by cosine, caches, pluggable models (families E, G, I)."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_word, expand_abbreviations, link_score, stem_phrase


def abbreviation_registry(rows: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """One long form for each (doc_id, short): the more frequent, then the first loaded. Long forms that hold the short one as a word are refused."""
    ok = rows.where(~contains_word(F.col("long"), F.col("short")))
    ok = ok.join(frequencies, ["short", "long"], "left") if frequencies is not None else ok.withColumn("freq", F.lit(0))
    w = Window.partitionBy("doc_id", "short").orderBy(F.desc(F.coalesce("freq", F.lit(0))), "load_order")
    return ok.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("doc_id", "short", "long", "load_order")


def expand_mentions(mentions: DataFrame, registry: DataFrame, text: str = "mention") -> DataFrame:
    """E9 over a table: mentions with the abbreviations of their document written out, in ``expanded``."""
    table = registry.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("load_order", "short", "long"))), lambda x: F.struct(x["short"].alias("short"), x["long"].alias("long"))).alias("__t"))
    out = mentions.join(table, "doc_id", "left")
    return out.withColumn("expanded", expand_abbreviations(F.col(text), F.col("__t"))).drop("__t")


def hash_vectors(names: list[str], dim: int = 64) -> np.ndarray:
    """Deterministic stand-in for an encoder: hashed letter trigrams, norm 1."""
    out = np.zeros((len(names), dim), np.float32)
    for i, n in enumerate(names):
        t = f"  {n.lower()} "
        for k in range(len(t) - 2):
            h = hashlib.blake2b(t[k : k + 3].encode(), digest_size=8).digest()
            out[i, int.from_bytes(h[:4], "little") % dim] += 1.0 if h[4] & 1 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def encode(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray] = hash_vectors, batch: int = 128, out: str = "vector") -> DataFrame:
    """Vectors of texts through an iterator pandas UDF; the model is called with at most ``batch`` texts."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            parts = [model(s.iloc[i : i + batch].fillna("").tolist()) for i in range(0, len(s), batch)]
            yield pd.Series([v for p in parts for v in p.astype(np.float32).tolist()], dtype=object)

    return df.withColumn(out, run(text))


def with_retries(call: Callable, attempts: int = 5, pause: float = 0.0, fallback=None) -> Callable:
    """Calls again after an error, at most ``attempts`` times, then gives ``fallback`` (or raises)."""

    def run(x):
        for i in range(attempts):
            try:
                return call(x)
            except Exception:
                if i + 1 == attempts:
                    if fallback is None:
                        raise
                    return fallback
                time.sleep(pause)

    return run


def remote_encode(df: DataFrame, text: str, call: Callable[[list[str]], np.ndarray], cache: DataFrame | None = None, batch: int = 100, attempts: int = 5, pause: float = 1.0, out: str = "vector") -> DataFrame:
    """Vectors of distinct texts from a remote service: at most ``batch`` texts a call, calls tried again ``attempts`` times after a
    pause that grows, texts of the ``cache`` (text, vector) not asked for. Returns (text, vector), which is the next cache.
    """

    def patient(texts: list[str]) -> np.ndarray:
        for i in range(attempts):
            try:
                return np.asarray(call(texts))
            except Exception:
                if i + 1 == attempts:
                    raise
                time.sleep(pause * (i + 1))
        raise ValueError("attempts must be positive")

    texts = df.select(text).where(F.col(text).isNotNull()).distinct()
    if cache is None:
        return encode(texts, text, patient, batch, out)
    known = cache.select(text, F.col(out).cast("array<float>").alias(out))
    return encode(texts.join(known, text, "left_anti"), text, patient, batch, out).unionByName(known.join(texts, text, "left_semi"))


def generate(df: DataFrame, text: str, model: Callable[[str, int], str], tries: int = 5, out: str = "output") -> DataFrame:
    """A JSON list of strings from a model, called until its answer is one, at most ``tries`` times; else ``[]``.

    Adds ``out`` (array of strings) and ``tries`` (the number of calls, D31).
    """

    def valid(s: str) -> list[str] | None:
        try:
            v = json.loads(s)
        except (TypeError, ValueError):
            return None
        return v if isinstance(v, list) and all(isinstance(x, str) for x in v) else None

    @F.pandas_udf(f"{out} array<string>, tries int")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = []
            for t in s:
                for i in range(tries):
                    if (v := valid(model(t, i))) is not None:
                        break
                rows.append((v or [], i + 1))
            yield pd.DataFrame(rows, columns=[out, "tries"])

    return df.withColumn("__x", run(text)).select(*df.columns, f"__x.{out}", "__x.tries")


def retry_summary(df: DataFrame, tries: str = "tries", output: str = "output", most: int = 5) -> DataFrame:
    """D31."""
    late, empty = F.col(tries) > 1, (F.col(tries) >= most) & (F.size(output) == 0)
    return df.agg(F.count_if(late).alias("n_retried"), F.count_if(empty).alias("n_forced_empty"), (F.avg(late.cast("double")) * 100).alias("percent_retried"))


def top_k_cosine(queries: DataFrame, terms: DataFrame, k: int = 10, query: str = "query_id", term: str = "term_id", vector: str = "vector") -> DataFrame:
    """The k terms of greatest cosine for each query: (query, rank, term, distance); ties by term."""
    return top_k_blocked(queries, terms, k, query, term, vector)


def top_k_blocked(queries: DataFrame, terms: DataFrame, k: int = 10, query: str = "query_id", term: str = "term_id", vector: str = "vector", block: int = 4096) -> DataFrame:
    """C14 by matrix products: blocks of queries meet blocks of terms on a block key; each meeting keeps k per query.

    A zero vector has cosine 0, so distance 1, to all.
    """
    n_blocks = max(1, -(-terms.count() // block))

    def packed(d: DataFrame, key: str, slots) -> DataFrame:
        return d.select(F.col(key).alias("key"), F.col(vector).alias("v"), slots.alias("slot")).groupBy("slot").agg(F.collect_list(F.struct("key", "v")).alias("x"))

    t = packed(terms, term, F.pmod(F.xxhash64(term), F.lit(n_blocks)))
    n_queries = max(1, -(-queries.count() // block))
    q = packed(queries, query, F.pmod(F.xxhash64(query), F.lit(n_queries))).select(F.col("x").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("slot"))

    def unpacked(x: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
        rows = x.flatten()
        keys, vectors = rows.field("key"), rows.field("v")
        m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return keys, m / np.where(n > 0, n, 1.0)

    def meet(it):
        for batch in it:
            for i in range(len(batch)):
                (qk, qv), (tk, tv) = (unpacked(c.slice(i, 1)) for c in batch.columns)
                place = pc.rank(tk).to_numpy(zero_copy_only=False)
                for at in range(0, len(qk), 512):
                    d = 1.0 - qv[at : at + 512] @ tv.T
                    most = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < len(tk) else np.inf
                    row, col = np.nonzero(d <= most)  # k of each row, and all that tie with the last
                    order = np.lexsort((place[col], d[row, col], row))
                    row, col = row[order], col[order]
                    first = np.searchsorted(row, np.arange(len(d)))
                    keep = np.arange(len(row)) - first[row] < k
                    row, col = row[keep], col[keep]
                    yield pa.RecordBatch.from_arrays([qk.slice(at, 512).take(pa.array(row)), tk.take(pa.array(col)), pa.array(d[row, col])], names=[query, term, "distance"])

    kind = {c: d.schema[c].dataType.simpleString() for d, c in ((queries, query), (terms, term))}
    # blocks of queries go to every block of terms: dealt by a shuffle, never through the driver, however small the files look
    found = t.join(q.hint("merge"), "slot").select("q", "x").mapInArrow(meet, f"`{query}` {kind[query]}, `{term}` {kind[term]}, distance double")
    w = Window.partitionBy(query).orderBy("distance", term)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query, "rank", term, "distance")


def link(anns: DataFrame, terms: DataFrame, registry: DataFrame, model: Callable[[list[str]], np.ndarray] = hash_vectors, k: int = 10, cache: DataFrame | None = None) -> DataFrame:
    """The k best terms of each annotation (doc_id, ann_id, type, text): distinct expanded mentions are encoded once.

    Columns: doc_id, ann_id, mention, rank, term_id, score (squared similarity). ``cache`` holds (expanded, vector).
    """
    m = anns.where(F.col("type") != "cell_vague").withColumn("mention", stem_phrase(F.col("text")))
    e = expand_mentions(m.select("doc_id", "mention").distinct(), registry)
    texts = e.select("expanded").distinct()
    new = texts if cache is None else texts.join(cache.select("expanded"), "expanded", "left_anti")
    vectors = encode(new, "expanded", model)
    if cache is not None:
        vectors = vectors.unionByName(cache.join(texts, "expanded", "left_semi"))
    best = top_k_cosine(vectors, terms, k, query="expanded")
    return m.join(e, ["doc_id", "mention"]).join(best, "expanded").select("doc_id", "ann_id", "mention", "rank", "term_id", link_score(F.col("distance")).alias("score"))


def search_labels(terms: DataFrame, phrase: str, prefix: str = "CL:", most: int = 20) -> DataFrame:
    """I4: an ontology search by label: names that hold the phrase first, then by edit distance."""
    p = F.lit(phrase.lower())
    name = F.lower("name")
    return terms.where(F.col("id").startswith(prefix)).orderBy(F.desc(F.contains(name, p)), F.levenshtein(name, p), "id").limit(most)
