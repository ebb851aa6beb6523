"""Relational joins of the inventory (family C) that aren't interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_metadata(passages: DataFrame, meta: DataFrame, key: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """Metadata by key; with ``defaults`` a left join whose gaps are filled, else an inner join. Catalyst picks broadcast by size."""
    if defaults is None:
        return passages.join(meta, key)
    out = passages.join(meta, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_names(ids: DataFrame, names: DataFrame, key: str, name: str, default: str = "[no match]") -> DataFrame:
    """Names of ids, or the default."""
    return ids.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def missing_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys of ``rows`` that ``keys`` lacks, distinct."""
    return rows.select(key).distinct().join(keys.select(key), key, "left_anti")


def require_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows``, failing at the first key that ``keys`` lacks."""
    found = rows.join(keys.select(F.col(key)).distinct().withColumn("__ok", F.lit(True)), key, "left")
    return found.withColumn(key, F.when(F.col("__ok"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("unknown key "), F.col(key).cast("string"))).cast(rows.schema[key].dataType))).drop("__ok").select(*rows.columns)


def positional(left: DataFrame, right: DataFrame, index: list[str], text: str = "text", array: str = "annotations") -> DataFrame:
    """Two collections side by side by position; texts must be equal; arrays are concatenated. Longer tails are cut."""
    l, r = left.alias("l"), right.alias("r")
    same = F.col(f"l.{text}").eqNullSafe(F.col(f"r.{text}"))
    checked = F.when(same, F.col(f"l.{text}")).otherwise(F.raise_error(F.lit("texts differ at the same position")).cast("string"))
    empty = lambda s: F.coalesce(F.col(f"{s}.{array}"), F.slice(F.coalesce(F.col("l." + array), F.col("r." + array)), 1, 0))
    return l.join(r, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in index]).select(*(F.col(f"l.{c}") for c in index), checked.alias(text), F.concat(empty("l"), empty("r")).alias(array))


def zip_rows(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Rows of both tables with the same explicit index."""
    return left.join(right, index)


def resolve_relations(relations: DataFrame, annotations: DataFrame, long_role: str = "LongForm", short_role: str = "ShortForm") -> DataFrame:
    """(doc_id, short, long) of abbreviation relations; each node's ``refid`` is looked up within its document.

    One equi-join: the nodes are exploded, joined, and folded back by role.
    """
    nodes = relations.where(F.col("type") == "ABBR").select("doc_id", "passage_idx", "rel_id", F.explode("nodes").alias("n")).select("doc_id", "passage_idx", "rel_id", "n.refid", "n.role")
    texts = annotations.select("doc_id", F.col("ann_id").alias("refid"), "text")
    found = nodes.join(texts, ["doc_id", "refid"])
    pick = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    return found.groupBy("doc_id", "passage_idx", "rel_id").agg(pick(short_role).alias("short"), pick(long_role).alias("long")).where("short is not null and long is not null")


def verify_sets(ref: DataFrame, pred: DataFrame, doc: str = "passage_id", offset: str = "offset", text: str = "text") -> DataFrame:
    """C17: (doc, offset, problem) where two document sets differ: missing or extra documents, offsets, texts."""
    side = lambda d, s: d.select(F.col(doc).alias("doc"), F.col(offset).alias("at"), F.col(text).alias(f"{s}_text"), F.lit(True).alias(s))
    both = side(ref, "ref").join(side(pred, "pred"), ["doc", "at"], "full")
    r, p = F.coalesce("ref", F.lit(False)), F.coalesce("pred", F.lit(False))
    docs = both.groupBy("doc").agg(F.bool_or(r).alias("in_ref"), F.bool_or(p).alias("in_pred"))
    whole = docs.where(~(F.col("in_ref") & F.col("in_pred"))).select("doc", F.lit(None).cast(both.schema["at"].dataType).alias("at"), F.when(F.col("in_ref"), "missing document").otherwise("extra document").alias("problem"))
    common = both.join(docs.where("in_ref and in_pred").select("doc"), "doc")
    part = common.where(~(r & p) | ~F.col("ref_text").eqNullSafe(F.col("pred_text"))).select("doc", "at", F.when(~r, "extra offset").when(~p, "missing offset").otherwise("text differs").alias("problem"))
    return whole.unionByName(part)


def unordered_pairs(values: DataFrame, key: str) -> DataFrame:
    """All unordered pairs of the distinct values of a column that has few (annotators): (a, b), a < b.

    The values are folded into one array, so no join is planned.
    """
    arr = values.agg(F.array_sort(F.collect_set(key)).alias("v"))
    return arr.select(F.posexplode("v").alias("i", "a"), "v").select("a", F.explode(F.slice(F.col("v"), F.col("i") + 2, F.size("v"))).alias("b"))


def standardise_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Completes (pmid, pmc) from a table of known pairs in both directions.

    Of several pairs for a key the last (``pair_order``) counts. Columns: pmid, pmc, status (``ok``, ``completed``,
    ``updated`` for a contradicting pmc, ``unknown``).
    """
    by = lambda k, v: known.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"__{k}")).agg(F.max_by(v, "pair_order").alias(f"k_{v}"))
    out = rows.join(by("pmid", "pmc"), F.col("pmid") == F.col("__pmid"), "left").join(by("pmc", "pmid"), F.col("pmc") == F.col("__pmc"), "left")
    pmid, pmc = F.coalesce("pmid", "k_pmid"), F.coalesce("k_pmc", "pmc")
    status = (
        F.when(F.col("__pmid").isNull() & F.col("__pmc").isNull(), "unknown")
        .when(F.col("pmc").isNotNull() & F.col("k_pmc").isNotNull() & (F.col("pmc") != F.col("k_pmc")), "updated")
        .when(F.col("pmid").isNull() | (F.col("pmc").isNull() & F.col("k_pmc").isNotNull()), "completed")
        .otherwise("ok")
    )
    return out.select(*(c for c in rows.columns if c not in ("pmid", "pmc")), pmid.alias("pmid"), pmc.alias("pmc"), status.alias("status"))


def through_cache(rows: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """C20: results for the distinct keys of ``rows``, and the rows to add to the cache. ``compute`` sees misses only."""
    keys = rows.select(key).distinct()
    new = compute(keys.join(cache.select(key), key, "left_anti"))
    return keys.join(cache, key).unionByName(new), new


def attach_results(anns: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Results by (document, mention), a left join; ``found`` tells gaps."""
    return anns.join(results.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def flags(sets: dict[str, DataFrame], key: Column | str) -> DataFrame:
    """One row per key with a 0/1 column for each set it is in: the base of C5, G9 and G10, in one shuffle."""
    parts = [d.select(key if isinstance(key, str) else key.alias("key"), *(F.lit(int(n == m)).alias(m) for m in sets)) for n, d in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    k = key if isinstance(key, str) else "key"
    return out.groupBy(k).agg(*(F.max(m).alias(m) for m in sets))
