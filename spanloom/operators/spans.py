"""Span predicates and joins. Each join is an equi-join on the passage with a range residual, so it shuffles on
the passage key and never compares spans of different passages.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open overlap."""
    return (s1 < e2) & (s2 < e1)


def touch(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of closed intervals, so touching counts."""
    return (s1 <= e2) & (s2 <= e1)


def encloses(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The first interval holds the second."""
    return (s1 <= s2) & (e1 >= e2)


MODES = {
    "overlap": overlap,
    "touch": touch,
    "encloses": encloses,
    "enclosed": lambda s1, e1, s2, e2: encloses(s2, e2, s1, e1),
    "either": lambda s1, e1, s2, e2: encloses(s1, e1, s2, e2) | encloses(s2, e2, s1, e1),  # C10
}


def interval_join(left: DataFrame, right: DataFrame, key: str = "passage_id", mode: str = "overlap", same_type: bool = False, how: str = "inner") -> DataFrame:
    """Joins spans (``start``, ``end``) of one passage. Columns of ``right`` other than the key get the prefix ``r_``.

    Pairs meet by position as well as passage; semi and anti joins ask by a running maximum, so neither is quadratic in a passage.
    """
    if how == "inner":
        return bucketed_interval_join(left, right, key, same_type=same_type, mode=mode)
    if how in ("left_semi", "left_anti") and mode in REACH:
        return _with_partner(left, right, key, mode, same_type).where(F.col("__hit") if how == "left_semi" else ~F.col("__hit")).drop("__hit")
    r = right.select(F.col(key).alias("__k"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key))
    on = (F.col(key) == F.col("__k")) & MODES[mode](F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    if same_type:
        on = on & (F.col("type") == F.col("r_type"))
    return left.join(r, on, how)


#: Whether a span has a partner is asked of the furthest end among the other side's spans that begin before a place:
#: the place, whether a start at it counts, and what that end must reach. ``enclosed``: the other span holds this one.
REACH = {
    "overlap": ("end", False, lambda reach, start, end: reach > start),
    "touch": ("end", True, lambda reach, start, end: reach >= start),
    "enclosed": ("start", True, lambda reach, start, end: reach >= end),
}


def _with_partner(left: DataFrame, right: DataFrame, key: str, mode: str, same_type: bool) -> DataFrame:
    """``left`` with ``__hit``: one window over both sides, sorted by place; no pair is made."""
    place, closed, reaches = REACH[mode]
    inside = [F.col(key).alias("__k"), *([F.col("type").alias("__t")] if same_type else [])]
    names = ["__k", *(["__t"] if same_type else [])]
    own = left.select(F.struct(*left.columns).alias("__x"), *inside, F.col(place).alias("__p"), F.lit(None).cast(right.schema["end"].dataType).alias("__e"), F.lit(1 if closed else 0).alias("__o"))
    other = right.where(F.col("start").isNotNull()).select(F.lit(None).cast(own.schema["__x"].dataType).alias("__x"), *inside, F.col("start").alias("__p"), F.col("end").alias("__e"), F.lit(0 if closed else 1).alias("__o"))
    w = Window.partitionBy(*names).orderBy("__p", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other).withColumn("__m", F.max("__e").over(w)).where(F.col("__x").isNotNull())
    known = F.col("__k").isNotNull() & (F.col("__t").isNotNull() if same_type else F.lit(True)) & F.col("__p").isNotNull()
    hit = known & F.coalesce(reaches(F.col("__m"), F.col("__x.start"), F.col("__x.end")), F.lit(False))
    return both.select("__x.*", hit.alias("__hit"))


def bucketed_interval_join(left: DataFrame, right: DataFrame, key: str = "passage_id", width: int = 512, same_type: bool = False, mode: str = "overlap") -> DataFrame:
    """C6 for very long passages: spans are also keyed by position bucket, so one passage spreads over many tasks.

    Each pair is returned once: in the bucket where the later of the two starts lies. A span that ends before its start counts in the bucket of its start.
    """
    r = in_cells(right, width).select(F.col(key).alias("__k"), F.col("__b").alias("__rb"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key))
    on = (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__rb")) & MODES[mode](F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    on = on & (F.floor(F.greatest("start", "r_start") / width) == F.col("__b"))
    if same_type:
        on = on & (F.col("type") == F.col("r_type"))
    return in_cells(left, width).join(r.hint("merge"), on).drop("__k", "__b", "__rb")  # sizes of words are guessed from files: no broadcast by guess


def in_cells(d: DataFrame, width: int = 512) -> DataFrame:
    """A row for each position bucket ``__b`` that a span reaches, by its closed ends."""
    first, last = F.floor(F.col("start") / width), F.floor(F.greatest("end", "start") / width)
    return d.withColumn("__b", F.explode(F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))))


def pairs_within(spans: DataFrame, order: str, key: str = "passage_id") -> DataFrame:
    """Unordered overlapping pairs of one set, the one first in ``order`` on the left."""
    return interval_join(spans, spans, key).where(F.col(order) < F.col(f"r_{order}"))


def first_enclosing(points: DataFrame, passages: DataFrame, key: str, order: str) -> DataFrame:
    """C11: each span with the first passage (by ``order``) that holds it; spans without one are dropped (see ``unplaced``)."""
    found = interval_join(passages.withColumnRenamed(key, "__key").withColumn(key, F.col("__key")).drop("__key"), points, key, "encloses")
    keys = [c for c in found.columns if c.startswith("r_")]
    rank = F.row_number().over(Window.partitionBy(key, *keys).orderBy(order))
    return found.withColumn("__n", rank).where("__n = 1").drop("__n")


def unplaced(points: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """C11: spans that no passage holds."""
    return interval_join(points, passages.select(key, "start", "end"), key, "enclosed", how="left_anti")


def in_bounds(locations: Column, passage_offset: Column, text: Column | None = None, size: Column | None = None) -> Column:
    """Some length, and every location inside the passage, of which the text or its ``size`` is given."""
    size = F.length(text) if size is None else size
    total = F.aggregate(locations, F.lit(0), lambda s, x: s + x["length"])
    out = F.exists(locations, lambda x: (x["offset"] < passage_offset) | (x["offset"] + x["length"] > passage_offset + size))
    return (total > 0) & ~out


def located_text(locations: Column, passage_offset: Column, text: Column) -> Column:
    """The text at the sorted locations, joined by spaces."""
    return F.array_join(F.transform(F.array_sort(locations), lambda x: F.substring(text, x["offset"] - passage_offset + 1, x["length"])), " ")


def hull(locations: Column) -> Column:
    """From the first start to the last end."""
    start = F.array_min(F.transform(locations, lambda x: x["offset"]))
    return F.struct(start.alias("start"), F.array_max(F.transform(locations, lambda x: x["offset"] + x["length"])).alias("end"))


def greedy_longest(spans: Column) -> Column:
    """longest first (ties: input order), each kept unless it touches one kept before. Spans are structs (start, end, ...)."""
    length = lambda x: x["end"] - x["start"]
    indexed = F.transform(spans, lambda x, i: F.struct((-length(x)).alias("n"), i.alias("i"), x.alias("x")))
    ordered = F.transform(F.array_sort(indexed), lambda y: y["x"])
    kept = F.arrow_udf(_apart, "array<boolean>")(ordered["start"].cast("array<bigint>"), ordered["end"].cast("array<bigint>"))
    return F.filter(F.zip_with(ordered, kept, lambda x, k: F.when(k, x)), lambda x: x.isNotNull())


def _apart(starts: pa.Array, ends: pa.Array) -> pa.Array:
    """For each list whether a span touches none kept before it: what is kept lies apart, so the last that begins by a span's end is the only one to ask."""
    out, sizes = [], pc.fill_null(pc.list_value_length(starts), 0).to_pylist()
    first, last, at = starts.flatten().to_pylist(), ends.flatten().to_pylist(), 0
    for n in sizes:
        begins: list[int] = []
        stops: list[int] = []
        for s, e in zip(first[at : at + n], last[at : at + n]):
            if s is None or e is None:
                out.append(True)
                continue
            i = bisect_right(begins, e)
            if free := not i or stops[i - 1] < s:
                begins.insert(i, s)
                stops.insert(i, e)
            out.append(free)
        at += n
    offsets = np.cumsum([0, *sizes]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.bool_()), mask=pc.is_null(starts))


def place_mentions(passages: DataFrame, mentions: DataFrame, key: str = "passage_id") -> DataFrame:
    """predicted mentions as spans of their passages: (key, type, start, end, text), none touching another.

    ``passages`` has (key, offset, text), ``mentions`` (key, mention, type, ord). Every whole hit of a mention counts, those in
    another case only where there is no exact one; then the longest come first, ties by ``ord`` and place. Null and empty
    mentions have no hits; passages without hits give no rows.

    A passage meets all its mentions at once, in Python: they are looked up at the words where they begin, so no mention reads the text.
    """
    order = F.array_sort(F.collect_list(F.struct("ord", "mention", F.lower("mention").alias("low"), "type")))
    lists = mentions.where("mention is not null and mention <> ''").groupBy(key).agg(order.alias("__m"))
    p = passages.where(F.col("text").isNotNull()).select(key, F.col("offset").cast("bigint").alias("__o"), F.col("text").alias("__t"))
    both = p.join(lists.hint("merge"), key).select(key, "__o", "__t", F.lower("__t").alias("__l"), F.col("__m.mention").alias("m"), F.col("__m.low").alias("low"), F.col("__m.ord").alias("ord"), F.col("__m.type").alias("type"))

    def place(it):
        for batch in it:
            for i in range(len(batch)):
                offset, text, lower, names, lows, orders, types = (c[i].as_py() for c in batch.columns[1:])
                exact, loose, found = WordIndex(text), None, []
                for j, name in enumerate(names):
                    at = exact.hits(name)
                    if not at:
                        loose = loose or WordIndex(lower)
                        at = loose.hits(lows[j])
                        name = lows[j]
                    found += [(-len(name), _nulls_first(orders[j]), x, x + len(name), _nulls_first(types[j]), j) for x in at]
                begins: list[int] = []
                stops: list[int] = []
                rows = []
                for _, _, s, e, _, j in sorted(found):
                    n = bisect_right(begins, e)
                    if not n or stops[n - 1] < s:
                        begins.insert(n, s)
                        stops.insert(n, e)
                        rows.append((types[j], s, e))
                if rows:
                    n = pa.array([i] * len(rows))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(n), pa.array([t for t, _, _ in rows], pa.string()), pa.array([s + offset for _, s, _ in rows], pa.int64()), pa.array([e + offset for _, _, e in rows], pa.int64()), pa.array([text[s:e] for _, s, e in rows], pa.string())], names=[key, "type", "start", "end", "text"])

    out = both.mapInArrow(place, StructType([passages.schema[key], *(StructField(n, t) for n, t in (("type", StringType()), ("start", LongType()), ("end", LongType()), ("text", StringType())))]))
    return out.withColumns({c: F.col(c).cast(passages.schema["offset"].dataType) for c in ("start", "end")})


def _nulls_first(x):
    return (x is not None, x)


EDGES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000!-/:-@\\[-`{-~"  # white space and ASCII punctuation, as EDGE of ``functions.text``
WORD, EDGE_CHAR = re.compile(f"[^{EDGES}]+"), re.compile(f"[{EDGES}]")


class WordIndex:
    """The places of a text's words (runs without an edge character), for the hits of E13."""

    def __init__(self, text: str):
        self.text, self.words = text, {}
        for m in WORD.finditer(text):
            self.words.setdefault(m.group(), []).append(m.start())

    def hits(self, phrase: str) -> list[int]:
        """Places of a phrase that has no neighbour but edges, from the left, none overlapping another."""
        head = WORD.match(phrase)
        if head:  # it begins where a word does, with that word
            found = (x for x in self.words.get(head.group(), ()) if self.text.startswith(phrase, x))
        else:
            found = (m.start() for m in re.finditer(f"(?={re.escape(phrase)})", self.text))
        out, free = [], 0
        for x in found:
            end = x + len(phrase)
            if x >= free and (x == 0 or EDGE_CHAR.match(self.text, x - 1)) and (end == len(self.text) or EDGE_CHAR.match(self.text, end)):
                out.append(x)
                free = end
        return out
