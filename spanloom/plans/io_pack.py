"""Queries that go through files: round trips of the formats, merged folders, streams, and the metric dispatcher."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import filters, joins, scoring, sequences
from ..session import scratch, table
from ..sources import annotated as A
from ..sources import tables as T
from ..streaming import growth
from .derive import pred, ref, sql
from .spans_pack import MATCHING, _tokens

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _flat(spark, d):
    docs = table(spark, d, "documents")
    pid = F.col("doc_id").cast("string")
    infons = F.create_map(F.lit("passage_id"), F.concat(pid, F.lit("_0")), F.lit("article-id_pmid"), pid)
    p = docs.select(pid.alias("doc_id"), F.lit(0).alias("passage_idx"), F.lit(0).alias("offset"), "text", infons.alias("infons"))
    a = pred(spark, d)
    loc = F.array(F.struct(F.col("start").cast("int").alias("offset"), (F.col("end") - F.col("start")).cast("int").alias("length")))
    ann = a.select(F.col("passage_id").cast("string").alias("doc_id"), F.lit(0).alias("passage_idx"), F.col("pos").alias("ann_idx"), F.concat(F.lit("a"), F.col("pos")).alias("ann_id"), "text", loc.alias("locations"), F.create_map(F.lit("type"), F.col("type"), F.lit("identifier"), F.col("identifier")).alias("infons"))
    return p, ann


def _written(spark, d):
    path = scratch(spark, "xml")
    A.write_collection(A.nest(*_flat(spark, d)), path, per_file=100_000, compression="gzip")
    return path


@query("a1_a8_xml_round_trip", sql(" SELECT type, count(*)::BIGINT AS n, count(DISTINCT passage_id)::BIGINT AS n_docs, sum(s)::BIGINT AS sum_start, sum(length(text))::BIGINT AS sum_length FROM p GROUP BY 1"))
def a1(spark, d):
    a = A.annotations(A.read_collection(spark, _written(spark, d), pattern=""))
    start = F.element_at("locations", 1)["offset"]
    return a.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.sum(start).alias("sum_start"), F.sum(F.length("text")).alias("sum_length"))


@query("a2_evaluation_spans", sql(" SELECT type, count(*)::BIGINT AS n FROM (SELECT DISTINCT p.passage_id, p.type, p.s, p.e, p.text FROM p JOIN documents d ON d.doc_id = p.passage_id WHERE p.e <= length(d.text) AND lower(p.text) NOT IN ('the', 'of')) GROUP BY 1"))
def a2(spark, d):
    docs = A.read_collection(spark, _written(spark, d), pattern="")
    return A.evaluation_spans(docs, blacklist=["the", "of"]).groupBy("type").agg(F.count("*").alias("n"))


@query("b20_b21_nested_split", sql(" SELECT name, count(*)::BIGINT AS n FROM p, (VALUES ('cell_phenotype', ['cell_phenotype']), ('cell_hetero', ['cell_hetero']), ('cell_vague', ['cell_vague']), ('pheno_hetero_merged', ['cell_phenotype', 'cell_hetero'])) v(name, types) WHERE list_contains(types, type) GROUP BY 1"))
def b20(spark, d):
    docs = A.read_collection(spark, _written(spark, d), pattern="")
    # the files are parsed once for all splits
    return _annotation_counts(filters.split_nested(docs, filters.TYPE_SPLITS), "name")


def _annotation_counts(docs, by):
    return docs.select(by, F.explode("passage").alias("p")).select(by, F.explode("p.annotation").alias("a")).groupBy(by).agg(F.count("*").alias("n"))


@query("g7_merged_folders", sql(" SELECT set_name, count(*)::BIGINT AS n FROM p, (VALUES ('one'), ('two')) v(set_name) GROUP BY 1"))
def g7(spark, d):
    path = _written(spark, d)
    from functools import reduce

    from pyspark.sql import DataFrame

    both = reduce(DataFrame.unionByName, [A.read_collection(spark, path, recursive=True, pattern="").withColumn("set_name", F.lit(k)) for k in ("one", "two")])
    return _annotation_counts(both, "set_name")


@query("a16_a19_jsonl_round_trip", "SELECT event_type, count(*)::BIGINT AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def a16(spark, d):
    path = scratch(spark, "jsonl")
    T.write_jsonl(table(spark, d, "events").select("event_id", "user_id", "event_type"), path)
    back = T.require_unique(spark.read.schema("event_id bigint, user_id bigint, event_type string").json(path), "event_id")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("a10_a21_tsv_round_trip", "SELECT p_brand, count(*)::BIGINT AS n, count(DISTINCT p_name)::BIGINT AS n_names FROM part GROUP BY 1")
def a10(spark, d):
    path = scratch(spark, "tsv")
    T.write_tsv(table(spark, d, "part").select("p_name", "p_brand"), path)
    back = spark.read.schema("p_name string, p_brand string").option("sep", "\t").option("header", "true").csv(path)
    return back.groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("n_names"))


@query("a22_predictions", "SELECT len(string_split(text, ' '))::INT AS size, count(*)::BIGINT AS n FROM conversations GROUP BY 1")
def a22(spark, d):
    path = scratch(spark, "predictions")
    T.write_predictions(table(spark, d, "conversations").select(F.transform(F.split("text", " "), lambda x, i: F.concat(F.lit("B-"), i.cast("string"))).alias("labels")), "labels", path)
    return spark.read.text(f"{path}/text").select(F.size(F.split("value", " ")).alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("a12_c15_relations", "SELECT lang AS short, source AS long, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2")
def a12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    node = lambda r, t: F.struct(F.lit(r).alias("refid"), F.lit(t).alias("role"))
    rel = docs.select("doc_id", F.lit(0).alias("passage_idx"), F.lit("r").alias("rel_id"), F.lit("ABBR").alias("type"), F.array(node("s", "ShortForm"), node("l", "LongForm")).alias("nodes"))
    ann = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("s").alias("ann_id"), F.col("lang").alias("text")), F.struct(F.lit("l").alias("ann_id"), F.col("source").alias("text")))).alias("x")).select("doc_id", "x.*")
    return joins.resolve_relations(rel, ann).groupBy("short", "long").agg(F.count("*").alias("n"))


@query("g14_partition_export", "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2")
def g14(spark, d):
    path = scratch(spark, "export")
    G.export_partitions(table(spark, d, "documents").select("doc_id", "lang", "source"), path, "lang", "source")
    return spark.read.schema("doc_id bigint, lang string, source string").json(path).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("d34_g15_dispatch", sql(", m AS (SELECT type, max(a) AS a, max(b) AS b FROM (SELECT passage_id, type, s, e, text, 1 AS a, 0 AS b FROM r UNION ALL SELECT passage_id, type, s, e, text, 0, 1 FROM p) GROUP BY passage_id, type, s, e, text), i AS (SELECT type, max(a) AS a, max(b) AS b FROM (SELECT passage_id, type, identifier, 1 AS a, 0 AS b FROM r UNION ALL SELECT passage_id, type, identifier, 0, 1 FROM p) GROUP BY passage_id, type, identifier) SELECT 'span' AS evaluation, sum(a * b)::BIGINT AS tp, sum((1 - a) * b)::BIGINT AS fp, sum(a * (1 - b))::BIGINT AS fn FROM m WHERE type <> 'cell_vague' UNION ALL SELECT 'identifier', sum(a * b)::BIGINT, sum((1 - a) * b)::BIGINT, sum(a * (1 - b))::BIGINT FROM i WHERE type <> 'cell_vague'"))
def d34(spark, d):
    loc = F.array(F.struct(F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length")))
    r, p = (x.withColumn("locations", loc) for x in (ref(spark, d), pred(spark, d)))
    types = ["cell_phenotype", "cell_hetero"]
    return G.union_all({e: scoring.evaluate(r, p, e, "strict", types).select("tp", "fp", "fn") for e in ("span", "identifier")}, "evaluation")


@query("d36_tokens_near", sql(", t AS (SELECT doc_id AS passage_id, s, e FROM w WHERE length(tok) > 0) SELECT p.type, count(*)::BIGINT AS n FROM p JOIN t ON t.passage_id = p.passage_id AND ((t.s BETWEEN p.s AND p.e) OR (t.e BETWEEN p.s AND p.e)) GROUP BY 1"))
def d36(spark, d):
    return sequences.tokens_near(_tokens(spark, d), pred(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@query("f12_head_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def f12(spark, d):
    return G.head(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")], 25)


@query("j_stream_first_seen", "SELECT event_type, count(DISTINCT user_id)::BIGINT AS n FROM events GROUP BY 1")
def j(spark, d):
    """The same answer from a stream over files as from the batch."""
    src, out, cp = (scratch(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    e.write.parquet(src)
    stream = growth.read_batches(spark, src, "event_id bigint, ts timestamp, user_id bigint, event_type string")
    growth.run_available(growth.first_seen(stream, "ts", ["user_id", "event_type"], late="3650 days"), out, cp).awaitTermination()
    return spark.read.schema(e.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("d34_approx_dispatch", MATCHING)
def d34a(spark, d):
    """The approximate method through the dispatcher."""
    loc = F.array(F.struct(F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length")))
    return scoring.evaluate(ref(spark, d).withColumn("locations", loc), pred(spark, d).withColumn("locations", loc), "span", "approx")


@query("b21_cleared", "SELECT count(*)::BIGINT AS n_docs, 0::BIGINT AS n_annotations, count(*)::BIGINT AS n_passages FROM documents")
def b21(spark, d):
    docs = filters.clear_annotations(A.nest(*_flat(spark, d)).withColumn("file", F.lit("f")), relations=False)
    sizes = F.aggregate("passage", F.lit(0), lambda a, p: a + F.coalesce(F.size(p["annotation"]), F.lit(0)))
    return docs.agg(F.count("*").alias("n_docs"), F.sum(F.greatest(sizes, F.lit(0))).alias("n_annotations"), F.sum(F.size("passage")).alias("n_passages"))


@query("j_windowed_counts", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def jw(spark, d):
    """Windowed counts of a stream, closed by a last event far ahead, add up to those of the batch."""
    src, out, cp = (scratch(spark, f"windows-{x}") for x in ("in", "out", "checkpoint"))
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = spark.sql("SELECT timestamp'2999-01-01' AS ts, 'end' AS event_type")
    e.write.parquet(src)
    stream = growth.read_batches(spark, src, "ts timestamp, event_type string")
    growth.run_available(growth.windowed_counts(stream, "ts", ["event_type"], late="3650 days"), out, cp).awaitTermination()
    last.write.mode("append").parquet(src)
    growth.run_available(growth.windowed_counts(stream, "ts", ["event_type"], late="3650 days"), out, cp).awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n bigint").parquet(out).where("event_type <> 'end'").groupBy("event_type").agg(F.sum("n").alias("n"))
