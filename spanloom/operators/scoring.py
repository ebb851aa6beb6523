"""Agreement and prediction scores: strict, optimal and any-overlap matching, ranked links, ROC."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .spans import in_cells, interval_join


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; all zero without a true positive."""
    zero = tp == 0
    p, r = tp / (tp + fp), tp / (tp + fn)
    return [F.when(zero, 0.0).otherwise(p).alias("precision"), F.when(zero, 0.0).otherwise(r).alias("recall"), F.when(zero, 0.0).otherwise(2.0 * p * r / (p + r)).alias("f1")]


def matched(ref: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct annotation with ``in_ref`` and ``in_pred``; null keys are equal to null. One shuffle, no join."""
    both = ref.select(*keys, F.lit(1).alias("in_ref"), F.lit(0).alias("in_pred")).unionByName(pred.select(*keys, F.lit(0).alias("in_ref"), F.lit(1).alias("in_pred")))
    return both.groupBy(*keys).agg(F.max("in_ref").alias("in_ref"), F.max("in_pred").alias("in_pred"))


def strict(ref: DataFrame, pred: DataFrame, keys: list[str], by: str | None = "type", total: str = "Total") -> DataFrame:
    """Strict scores, by a column and in all."""
    m = matched(ref, pred, keys)
    counts = [F.sum(F.col("in_ref") * F.col("in_pred")).alias("tp"), F.sum((1 - F.col("in_ref")) * F.col("in_pred")).alias("fp"), F.sum(F.col("in_ref") * (1 - F.col("in_pred"))).alias("fn")]
    if by is None:
        out = m.agg(*counts)
    else:
        out = m.rollup(by).agg(*counts, F.grouping(by).alias("__g")).withColumn(by, F.when(F.col("__g") == 1, total).otherwise(F.col(by))).drop("__g")
    return out.select(*([by] if by else []), "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def any_overlap(ref: DataFrame, pred: DataFrame, pool: bool = False, key: str = "passage_id") -> DataFrame:
    """Hits of each side that overlap any span of the other; precision and recall have their own true positives."""
    r = interval_join(ref, pred, key, same_type=not pool, how="left_semi").agg(F.count("*").alias("tp_ref"))
    p = interval_join(pred, ref, key, same_type=not pool, how="left_semi").agg(F.count("*").alias("tp_pred"))
    n = ref.agg(F.count("*").alias("n_ref")).join(F.broadcast(pred.agg(F.count("*").alias("n_pred"))))
    all_ = r.join(F.broadcast(p)).join(F.broadcast(n))
    zero = F.col("tp_ref") + F.col("tp_pred") == 0
    prec, rec = F.try_divide("tp_pred", "n_pred"), F.try_divide("tp_ref", "n_ref")
    return all_.select("tp_ref", "tp_pred", "n_ref", "n_pred", F.when(zero, 0.0).otherwise(prec).alias("precision"), F.when(zero, 0.0).otherwise(rec).alias("recall"), F.when(zero, 0.0).otherwise(F.try_divide(2.0 * prec * rec, prec + rec)).alias("f1"))


def maximum_matching(edges: list[list[int]], n_right: int) -> int:
    """The size of a maximum matching of a bipartite graph: one breadth-first search for an augmenting path per left node."""
    left, right = [-1] * len(edges), [-1] * n_right
    for root in range(len(edges)):
        came: dict[int, int] = {}
        queue, end = [root], -1
        for u in queue:
            for v in edges[u]:
                if v not in came:
                    came[v] = u
                    if right[v] < 0:
                        end = v
                        break
                    queue.append(right[v])
            if end >= 0:
                break
        while end >= 0:  # flip the path
            u = came[end]
            left[u], right[end], end = end, u, left[u]
    return sum(v >= 0 for v in left)


def _pair_counts(ref: DataFrame, pred: DataFrame, tp: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn and scores from matched pairs and the sizes of both sides, in all or by columns."""
    side = lambda d, r, p: d.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(0).cast("bigint").alias("tp"), (F.col("n") * r).alias("n_ref"), (F.col("n") * p).alias("n_pred"))
    none = F.lit(0).cast("bigint")
    parts = side(ref, 1, 0).unionByName(side(pred, 0, 1)).unionByName(tp.select(*by, F.col("tp").cast("bigint").alias("tp"), none.alias("n_ref"), none.alias("n_pred")))
    c = parts.groupBy(*by).agg(*(F.coalesce(F.sum(x), none).alias(x) for x in ("tp", "n_ref", "n_pred")))
    c = c.select(*by, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_ref") - F.col("tp")).alias("fn"))
    return c.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def optimal(ref: DataFrame, pred: DataFrame, pool: bool = False, key: str = "passage_id", by: list[str] | None = None) -> DataFrame:
    """Scores of an optimal one-to-one matching of overlapping spans (of one type unless ``pool``), in all or ``by`` columns.

    Rows are annotations: (key, type, locations), any pair of locations may overlap. The overlap graph is a join
    in the JVM, by position as well as passage; only its edges go to Python, sorted by passage and type, where a
    maximum matching is found of whole batches of them (``matching_by_group``). What no edge touches is counted in the JVM.
    """
    by = by or []
    inside = [*by, key, *([] if pool else ["type"])]  # spans of different values of these never meet

    def side(d: DataFrame, name: str) -> DataFrame:
        """(__g, __b, start, end, name1, name2, name_n): equal annotations are one node with their number; dealt as the join asks, so counted without another exchange."""
        x = d.select(F.struct(*inside).alias("__g"), F.xxhash64("type", "locations").alias(f"{name}1"), F.hash("type", "locations").alias(f"{name}2"), F.explode(F.array_distinct("locations")).alias("x"))
        x = in_cells(x.select("__g", f"{name}1", f"{name}2", F.col("x.offset").alias("start"), (F.col("x.offset") + F.col("x.length")).alias("end")), 512)
        return x.repartition("__g", "__b").groupBy("__g", "__b", "start", "end", f"{name}1", f"{name}2").agg(F.count("*").alias(f"{name}n"))

    r, p = side(ref, "r"), side(pred, "p").select(F.col("__g").alias("__h"), F.col("__b").alias("__c"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "p1", "p2", "pn")
    meet = (F.col("__g") == F.col("__h")) & (F.col("__b") == F.col("__c")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    edges = r.join(p.hint("merge"), meet).select("__g", "r1", "r2", "rn", "p1", "p2", "pn")
    grouped = edges.repartition("__g").sortWithinPartitions("__g")
    types = ", ".join([*(f"`{c}` {ref.schema[c].dataType.simpleString()}" for c in by), "tp bigint"])
    width = len(by)

    def match(it):
        held: list[pa.RecordBatch] = []
        for batch in it:
            if not len(batch):
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            first = _group_starts(t.column(0))
            if first[-1]:
                yield from counted(t.slice(0, first[-1]), first[:-1])
            held = [t.slice(first[-1])]  # its group may go on
        if held:
            yield from counted(held[0], np.zeros(1, np.int64))

    def counted(t: pa.RecordBatch, first: np.ndarray):
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
        r1, r2, rn, p1, p2, pn = (t.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7))
        tp = matching_by_group(group, _codes(group, r1, r2), _codes(group, p1, p2), rn, pn, len(first))
        fields = t.column(0).flatten()[:width]
        yield pa.RecordBatch.from_arrays([*(f.take(pa.array(first)) for f in fields), pa.array(tp)], names=[*by, "tp"])

    return _pair_counts(ref, pred, grouped.mapInArrow(match, types), by)


def _group_starts(keys: pa.StructArray) -> np.ndarray:
    """Rows where a sorted struct column changes, 0 included."""
    new = np.zeros(len(keys), bool)
    new[0] = True
    for field in keys.flatten():
        code = pc.fill_null(field.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers of distinct rows."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def matching_by_group(group: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, groups: int) -> np.ndarray:
    """The size of a maximum matching of each group of a bipartite graph of edges; nodes are numbers that no two groups share and stand for several equal ones.

    An edge that shares no node is counted as it is. Of the rest, a node with one edge left can always take it, so those go first, from a
    queue; augmenting paths remain for what has cycles only.
    """
    found = np.zeros(groups, np.int64)
    alone = (np.bincount(left)[left] == 1) & (np.bincount(right)[right] == 1)
    np.add.at(found, group[alone], np.minimum(n_left, n_right)[alone])
    around: dict[int, set[int]] = {}
    room: dict[int, int] = {}
    home: dict[int, int] = {}
    for g, a, b, x, y in zip(*(c[~alone].tolist() for c in (group, left, -1 - right, n_left, n_right))):
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
        room[a], room[b], home[a] = x, y, g
    queue = [u for u, near in around.items() if len(near) == 1]
    while queue:
        u = queue.pop()
        if len(around[u]) != 1:
            continue
        (v,) = around[u]
        n = min(room[u], room[v])
        found[home[u if u >= 0 else v]] += n
        room[v] -= n
        around[u].clear()
        around[v].discard(u)
        if not room[v]:
            for w in around[v]:
                around[w].discard(v)
                if len(around[w]) == 1:
                    queue.append(w)
            around[v].clear()
        elif len(around[v]) == 1:
            queue.append(v)
    cyclic: dict[int, list[int]] = {}
    for u, near in around.items():
        if u >= 0 and near:
            cyclic.setdefault(home[u], []).append(u)
    for g, nodes in cyclic.items():
        copies, end = {}, 0
        for v in {v for u in nodes for v in around[u]}:
            copies[v], end = range(end, end + room[v]), end + room[v]
        found[g] += maximum_matching([[i for v in around[u] for i in copies[v]] for u in nodes for _ in range(room[u])], end)
    return found


def greedy(ref: DataFrame, pred: DataFrame, pool: bool = False, key: str = "passage_id") -> DataFrame:
    """One-to-one matching in order of start: each reference span takes the first free overlapping prediction.

    Pairs of a passage follow one another in a sorted partition, and Python goes through them once; a pair met again finds its ends taken.
    """
    order = ["start", "end", "type", "r_start", "r_end", "r_type"]
    edges = interval_join(ref.select(key, *order[:3]), pred.select(key, *order[:3]), key, same_type=not pool).select(key, *order)
    grouped = edges.repartition(key).sortWithinPartitions(key, *(F.col(c).asc_nulls_last() for c in order))

    def match(it):
        now, used, taken, n = object(), set(), set(), 0
        for batch in it:
            for k, s, e, t, rs, re, rt in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    n += len(used)
                    now, used, taken = k, set(), set()
                if (a := (s, e, t)) not in used and (b := (rs, re, rt)) not in taken:
                    used.add(a)
                    taken.add(b)
        yield pa.RecordBatch.from_arrays([pa.array([n + len(used)], pa.int64())], names=["tp"])

    return _pair_counts(ref, pred, grouped.mapInArrow(match, "tp bigint"), [])


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def token_overlap(a: DataFrame, b: DataFrame, key: str = "passage_id") -> DataFrame:
    """The mean share of a span's words that same-type spans of the other side cover, averaged over both directions."""

    def one(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        j = interval_join(x, y.select(key, "type", "start", "end"), key, same_type=True)
        lo, hi = F.greatest("start", "r_start") - F.col("start"), F.least("end", "r_end") - F.col("start")
        part = F.try_divide(_words(F.substring("text", (lo + 1).cast("int"), (hi - lo).cast("int"))).cast("double"), _words(F.col("text")))
        total = j.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("s"))
        return total.join(F.broadcast(x.agg(F.count("*").alias("n")))).select(F.when(F.col("n") == 0, 0.0).otherwise(F.col("s") / F.col("n")).alias(name))

    return one(a, b, "x").join(F.broadcast(one(b, a, "y"))).select(((F.col("x") + F.col("y")) / 2).alias("overlap"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ancestor_distances(parents: DataFrame) -> DataFrame:
    """(id, anc, d): all ancestors with the least number of steps, each id being its own at 0. Rounds double the reach and end when nothing is new."""
    ids = parents.select("id").unionByName(parents.select(F.col("parent").alias("id"))).distinct()
    closure = ids.select("id", F.col("id").alias("anc"), F.lit(0).alias("d")).unionByName(parents.where("id <> parent").select("id", F.col("parent").alias("anc"), F.lit(1).alias("d")).distinct())
    closure, before = _kept(closure, "distances"), None
    while (now := closure.agg(F.count("*"), F.sum("d")).first()) != before:
        before = now
        up = closure.select(F.col("id").alias("anc"), F.col("anc").alias("up"), F.col("d").alias("e"))
        far = closure.join(up, "anc").groupBy("id", F.col("up").alias("anc")).agg(F.min(F.col("d") + F.col("e")).alias("d"))
        closure = _kept(far.select("id", "anc", "d"), "distances")
    return closure


def lowest_common_macro(ref: DataFrame, pred: DataFrame, parents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """D18 by lowest common ancestors: macro averages over documents of scores on augmented id sets.

    Each id of a document is paired with the nearest ids of the other side by way of their lowest common ancestors (the least
    sum of steps, ties all); both sides get the ids on the shortest ways up to those ancestors. Ids that share no ancestor
    stay as they are, so far roots add nothing.
    """
    steps = ancestor_distances(parents)
    a, b = (d.select(doc, F.col("id").alias(n)).distinct() for d, n in ((ref, "r"), (pred, "p")))
    up = lambda n, d: steps.select(F.col("id").alias(n), F.col("anc").alias("l"), F.col("d").alias(d))
    meet = a.join(b, doc).join(up("r", "dr"), "r").join(up("p", "dp"), ["p", "l"]).withColumn("s", F.col("dr") + F.col("dp"))
    pairs = _kept(meet.select(doc, "r", "p", "l", "dr", "dp", "s"), "meetings")
    near = lambda n: pairs.withColumn("m", F.min("s").over(Window.partitionBy(doc, n))).where("s = m").select(doc, "r", "p", "l", "dr", "dp")
    best = near("r").unionByName(near("p")).distinct()

    def grown(side: DataFrame, n: str, d: str) -> DataFrame:
        first = steps.select(F.col("id").alias(n), F.col("anc").alias("x"), F.col("d").alias("d1"))
        rest = steps.select(F.col("id").alias("x"), F.col("anc").alias("l"), F.col("d").alias("d2"))
        way = best.select(doc, n, "l", d).distinct().join(first, n).join(rest, ["x", "l"]).where(F.col("d1") + F.col("d2") == F.col(d))
        return side.select(doc, F.col(n).alias("id")).unionByName(way.select(doc, F.col("x").alias("id"))).distinct()

    return _macro(matched(grown(a, "r", "dr"), grown(b, "p", "dp"), [doc, "id"]), doc)


def _macro(m: DataFrame, doc: str) -> DataFrame:
    per = m.groupBy(doc).agg(F.sum(F.col("in_ref") * F.col("in_pred")).alias("tp"), F.sum((1 - F.col("in_ref")) * F.col("in_pred")).alias("fp"), F.sum(F.col("in_ref") * (1 - F.col("in_pred"))).alias("fn"))
    return per.select(*prf(F.col("tp"), F.col("fp"), F.col("fn"))).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def augmented_macro(ref: DataFrame, pred: DataFrame, parents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Macro averages over documents of scores on id sets that are closed under all ancestors (D18 by lowest common ones: ``lowest_common_macro``).

    ``parents`` is (id, parent). Each round joins the closure with itself, which doubles the levels it reaches, and
    writes it to the shared folder; the rounds end when nothing is new, however deep the ids lie, cycles included.
    """
    def kept(df: DataFrame) -> tuple[DataFrame, int]:
        out = _kept(df, "closure")
        return out, out.count()

    (closure, n), before = kept(parents.select("id", F.col("parent").alias("anc")).distinct()), -1
    while n != before:
        before = n
        up = closure.select(F.col("id").alias("anc"), F.col("anc").alias("up"))
        closure, n = kept(closure.unionByName(closure.join(up, "anc").select("id", F.col("up").alias("anc"))).distinct())
    grow = lambda d: d.select(doc, "id").unionByName(d.join(closure, "id").select(doc, F.col("anc").alias("id"))).distinct()
    return _macro(matched(grow(ref), grow(pred), [doc, "id"]), doc)


def at_k(gold: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10), keys: list[str] | None = None, mention: str = "mention") -> DataFrame:
    """Precision, recall and F1 of the ids ranked among the first k of each mention, as sets of ``keys``.

    Empty ids are dropped before ranks are counted. ``gold`` has the keys; ``ranked`` has them, the mention and ``rank``.
    """
    keys = keys or ["passage_id", "type", "id"]
    full = ranked.where(~F.lower("id").isin("", "-", "none") & F.col("id").isNotNull())
    full = full.withColumn("pos", F.row_number().over(Window.partitionBy("passage_id", "type", mention).orderBy("rank")))
    best = full.groupBy(*keys).agg(F.min("pos").alias("pos"))
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    both = best.join(g, keys, "full")
    agg = [x for k in ks for x in (F.count_if((F.col("pos") <= k) & (F.col("g") == 1)).alias(f"tp{k}"), F.count_if(F.col("pos") <= k).alias(f"np{k}"))]
    one = both.agg(F.count_if(F.col("g") == 1).alias("ng"), *agg)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"tp{k}").alias("tp"), F.col(f"np{k}").alias("n_pred"), F.col("ng").alias("n_gold")) for k in ks])).alias("x")).select("x.*")
    return rows.select("k", "tp", "n_pred", "n_gold", *prf(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gold") - F.col("tp")))


def _falling(df: DataFrame, label: str, score: str, parts: int) -> DataFrame:
    """(score, pos, neg, tp, fp): counts at each distinct score, and at it and all greater ones.

    Scores are dealt by quantiles into at most ``parts`` ranges; sums run within a range, and start from the sum of the greater ranges.
    """
    per = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    cuts = sorted(set(per.select(F.col("score").cast("double").alias("s")).approxQuantile("s", [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    at = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("score")))
    per = per.withColumn("__r", at)
    up = Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)
    start = per.groupBy("__r").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    start = start.select("__r", *(F.coalesce(F.sum(c).over(up), F.lit(0)).alias(c) for c in ("__p", "__n")))  # one row a range
    w = Window.partitionBy("__r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return per.join(F.broadcast(start), "__r").select("score", "pos", "neg", (F.col("__p") + F.sum("pos").over(w)).alias("tp"), (F.col("__n") + F.sum("neg").over(w)).alias("fp"))


def _totals(df: DataFrame, label: str) -> DataFrame:
    return F.broadcast(df.agg(F.count_if(F.col(label) == 1).alias("all_pos"), F.count_if(F.col(label) != 1).alias("all_neg")))


def roc(df: DataFrame, label: str, score: str, parts: int = 64) -> DataFrame:
    """The points of the ROC curve, by falling score. Ties share a point."""
    points = _falling(df, label, score, parts).join(_totals(df.where(F.col(label).isNotNull()), label))
    return points.select("score", F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide("fp", "all_neg").alias("fpr"))


def auc(df: DataFrame, label: str, score: str, parts: int = 64) -> DataFrame:
    """The area under the curve by trapezoids; null with one class only. A point's step is its own counts, so no row needs the one before."""
    points = _falling(df, label, score, parts)
    area = points.agg(F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))).alias("a"))
    return area.join(_totals(df.where(F.col(label).isNotNull()), label)).select(F.try_divide(F.col("a").cast("double"), 2.0 * F.col("all_pos") * F.col("all_neg")).alias("auc"))


def score_matrix(ref: DataFrame, pred: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """Strict scores of every group (model, corpus, type set ...) in one job."""
    m = matched(ref, pred, [*groups, *[k for k in keys if k not in groups]])
    c = m.groupBy(*groups).agg(F.sum(F.col("in_ref") * F.col("in_pred")).alias("tp"), F.sum((1 - F.col("in_ref")) * F.col("in_pred")).alias("fp"), F.sum(F.col("in_ref") * (1 - F.col("in_pred"))).alias("fn"))
    return c.select(*groups, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def approx_matrix(ref: DataFrame, pred: DataFrame, groups: list[str], pool: bool = False) -> DataFrame:
    """Scores of an optimal matching in every group (model, corpus ...) in one job."""
    return optimal(ref, pred, pool, by=groups)


def evaluate(ref: DataFrame, pred: DataFrame, evaluation: str = "span", method: str = "strict", types: list[str] | None = None, pool: bool = False) -> DataFrame:
    """Routes a metric. ``strict`` for span, identifier and span_identifier rows; ``approx`` for spans only."""
    if types is not None:
        ref, pred = (d.where(F.col("type").isin(types)) for d in (ref, pred))
    if method == "strict":
        keys = {"span": ["passage_id", "type", "locations", "text"], "identifier": ["passage_id", "type", "identifier"], "span_identifier": ["passage_id", "type", "locations", "text", "identifier"]}[evaluation]
        return strict(ref, pred, keys, by=None)
    if method == "approx" and evaluation == "span":
        return optimal(ref, pred, pool)
    raise ValueError(f"no metric {method} for {evaluation}")


def annotator_pairs(anns: DataFrame, keys: list[str], annotator: str = "annotator", known_false: tuple[str, ...] = ()) -> DataFrame:
    """Strict scores of every unordered pair of annotators, in one pass.

    Each annotation is one row with the set of its annotators (few); pairs are made from that set and the set of all.
    """
    rows = anns.where(F.col(annotator).isNotNull() & ~F.col(annotator).isin(*known_false)) if known_false else anns.where(F.col(annotator).isNotNull())
    everyone = rows.agg(F.array_sort(F.collect_set(annotator)).alias("everyone"))
    who = rows.groupBy(*keys).agg(F.collect_set(annotator).alias("who"))
    pairs = F.flatten(F.transform("everyone", lambda a: F.transform(F.filter("everyone", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    x = who.join(F.broadcast(everyone)).select("who", F.explode(pairs).alias("x")).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.array_contains("who", F.col("x.a")).alias("in_a"), F.array_contains("who", F.col("x.b")).alias("in_b"))
    c = x.groupBy("a", "b").agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("tp"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("fp"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("fn"))
    return c.select("a", "b", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))

