"""Queries on side files: each writes a file of the format from the driver's tables and reads it with its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..session import scratch, table
from ..sources import annotated as A
from ..sources import tables as T
from .derive import sql
from .io_pack import _flat

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _lines(df, path, *columns):
    """Tab-separated lines without a header."""
    df.select(F.concat_ws("\t", *columns).alias("value")).write.option("maxRecordsPerFile", 100_000).text(path)
    return path


@query("a3_spans_by_annotator", sql(" SELECT 'ann' || (pos % 3) AS annotator, type, count(DISTINCT (p.passage_id, p.s, p.e, p.text))::BIGINT AS n FROM p JOIN documents d ON d.doc_id = p.passage_id WHERE p.e <= length(d.text) AND pos % 3 > 0 GROUP BY 1, 2"))
def a3(spark, d):
    p, a = _flat(spark, d)
    who = F.when(F.col("ann_idx") % 3 > 0, F.map_concat("infons", F.create_map(F.lit("annotator"), F.concat(F.lit("ann"), (F.col("ann_idx") % 3).cast("string"))))).otherwise(F.col("infons"))
    path = scratch(spark, "annotators")
    A.write_collection(A.nest(p, a.withColumn("infons", who)), path, compression="gzip")
    return A.evaluation_spans(A.read_collection(spark, path, pattern=""), by_annotator=True).groupBy("annotator", "type").agg(F.count("*").alias("n"))


@query("a11_abbreviations", "WITH a AS (SELECT c_custkey % 50 AS doc_id, 'K' || (c_custkey % 7) || CASE WHEN c_custkey % 2 = 0 THEN 's' ELSE '' END AS short, lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN 's' ELSE '' END AS long FROM customer), b AS (SELECT doc_id, short, long FROM a UNION SELECT doc_id, left(short, length(short) - 1), left(long, length(long) - 1) FROM a WHERE ends_with(short, 's') AND ends_with(long, 's')) SELECT doc_id::VARCHAR AS doc_id, count(*)::BIGINT AS n, count(DISTINCT short)::BIGINT AS n_short FROM b GROUP BY 1")
def a11(spark, d):
    k = F.col("c_custkey")
    s = lambda c, when: F.concat(c, F.when(when, "s").otherwise(""))
    rows = table(spark, d, "customer").select((k % 50).cast("string").alias("doc_id"), s(F.concat(F.lit("K"), (k % 7).cast("string")), k % 2 == 0).alias("short"), s(F.lower("c_mktsegment"), k % 3 == 0).alias("long"))
    found, bad = T.read_abbreviations(spark, _lines(rows, scratch(spark, "abbreviations"), "doc_id", "short", "long"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("short").alias("n_short"))


@query("a27_abbreviation_files", "SELECT c_custkey::VARCHAR AS doc_id, 'S' || c_nationkey AS short, c_mktsegment || ' unit' AS long FROM customer")
def a27(spark, d):
    """A folder with collections (first by name), tables of lines that say otherwise, and files of neither kind; files are bounded, however few tasks write them."""
    path = scratch(spark, "abbreviation-files")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("short"), F.concat("c_mktsegment", F.lit(" unit")).alias("long"))
    infon = F.array(F.struct(F.lit("type").alias("_key"), F.lit("ABBR").alias("_VALUE")))
    ann = lambda i: F.struct(F.lit(i).alias("_id"), infon.alias("infon"), F.array(F.struct(F.lit(0).alias("_offset"), F.lit(1).alias("_length"))).alias("location"), F.col(i).alias("text"))
    node = lambda i, role: F.struct(F.lit(i).alias("_refid"), F.lit(role).alias("_role"))
    none = F.array().cast("array<struct<_key:string,_VALUE:string>>")
    relation = F.array(F.struct(F.lit("r").alias("_id"), infon.alias("infon"), F.array(node("long", "LongForm"), node("short", "ShortForm")).alias("node")))
    passage = F.array(F.struct(none.alias("infon"), F.lit(0).alias("offset"), F.lit("t").alias("text"), F.array(ann("short"), ann("long")).alias("annotation"), relation.alias("relation")))
    A.write_collection(c.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), none.alias("infon"), passage.alias("passage")), f"{path}/x", per_file=20_000)  # a file of collections is read by one task
    _lines(c, f"{path}/t", "doc_id", "short", "long")
    _lines(c.withColumn("long", F.lit("never")), f"{path}/n", "doc_id", "short", "long")
    fs = spark._jvm.org.apache.hadoop.fs.Path
    store = fs(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for kind, name, ending in (("x", "a", "xml"), ("t", "b", "tsv"), ("n", "c", "txt")):
        parts = [x.getPath() for x in store.listStatus(fs(f"{path}/{kind}")) if x.getPath().getName().startswith("part-")]
        for i, part in enumerate(parts):
            store.rename(part, fs(f"{path}/{name}-{i:06}.{ending}"))
    return A.read_abbreviation_files(spark, path).select("doc_id", "short", "long")


@query("a13_docids", "SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'PMC' || c_custkey END IS NULL AS no_pmc, c_custkey % 2 = 0 AS full_text, count(*)::BIGINT AS n FROM customer GROUP BY 1, 2")
def a13(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.cast("string").alias("a"), F.when(k % 4 == 0, " None").otherwise(F.concat(F.lit("PMC"), k.cast("string"))).alias("b"), F.when(k % 2 == 0, "True").otherwise("false").alias("c"))
    ids = T.read_docids(spark, _lines(rows.unionByName(rows), scratch(spark, "docids"), "a", "b", "c"))
    return ids.groupBy(F.col("pmc").isNull().alias("no_pmc"), "full_text").agg(F.count("*").alias("n"))


@query("a14_line_set", "SELECT DISTINCT lower(c_mktsegment) AS id FROM customer")
def a14(spark, d):
    path = scratch(spark, "lines")
    table(spark, d, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")).alias("value")).write.option("compression", "gzip").text(path)
    return T.read_line_set(spark, path)


@query("a15_rules", "SELECT CASE WHEN n_regionkey = 0 THEN 'none' WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS type, count(*)::BIGINT AS n FROM nation WHERE n_nationkey <> 7 GROUP BY 1")
def a15(spark, d):
    """Rules from a file, updates and a deletion, applied to annotations."""
    n = table(spark, d, "nation")
    lines = n.where("n_nationkey % 2 = 0 and n_regionkey <> 0").select(F.col("n_name").alias("m"), F.lit("*").alias("t"), F.lit("*").alias("i"), F.lit("even").alias("nt"), F.lit("x").alias("ni"))
    zero = n.where("n_regionkey = 0").select(F.col("n_name").alias("m"), F.lit("*").alias("t"), F.lit("*").alias("i"), F.lit("none").alias("nt"), F.lit("x").alias("ni"))
    path = _lines(lines.unionByName(zero), scratch(spark, "rules"), "m", "t", "i", "nt", "ni")
    _lines(n.where("n_nationkey = 7").select("n_name", F.lit("*").alias("a"), F.lit("*").alias("b")), f"{path}-deletions", "n_name", "a", "b")
    rules = filters.rule_array(T.read_rules(spark, path)) + filters.rule_array(T.read_rules(spark, f"{path}-deletions"))
    anns = n.select(F.col("n_name").alias("text"), F.col("n_name").alias("type"), F.lit("CL:1").alias("identifier"))
    return filters.apply_rules(anns, rules).groupBy("type").agg(F.count("*").alias("n"))


@query("a17_names", "SELECT 'CL:' || p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'None', 'N/A'")
def a17(spark, d):
    path = scratch(spark, "names")
    rows = table(spark, d, "part").select(F.col("p_name").alias("cl_name"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("CL:"), F.col("p_partkey").cast("string"))).alias("id"))
    rows.write.option("header", "true").csv(path)
    return T.read_names(spark, path)


@query("a18_json_list", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def a18(spark, d):
    path = scratch(spark, "json")
    T.json_document(table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name")), ["k"]).write.text(path)  # A20: a whole-file list
    return T.read_json(spark, path, "k bigint, name string")


@query("a18_json_keys", "SELECT n_name AS id FROM nation")
def a18k(spark, d):
    path = scratch(spark, "keys")
    table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "n_regionkey")))).alias("value")).write.text(path)
    return T.read_json_keys(spark, path)


@query("a25_dataset", "SELECT 'tokens' AS text_column, 'ner_tags' AS label_column, count(*)::BIGINT AS n, sum(len(string_split(text, ' ')))::BIGINT AS n_tokens FROM conversations")
def a25(spark, d):
    path = scratch(spark, "dataset")
    c = table(spark, d, "conversations").select(F.split("text", " ").alias("tokens"))
    c.withColumn("ner_tags", F.transform("tokens", lambda x: F.lit("O"))).write.json(path)
    df, text, label = T.read_dataset(spark, path)
    return df.agg(F.lit(text).alias("text_column"), F.lit(label).alias("label_column"), F.count("*").alias("n"), F.sum(F.size(text)).alias("n_tokens"))


@query("a9_bounded_files", "SELECT count(*)::BIGINT AS n_docs, ceil(count(*) / 25)::BIGINT AS n_files FROM documents")
def a9(spark, d):
    """Files of at most 25 documents each, all but the last full."""
    path = scratch(spark, "bounded")
    p, a = _flat(spark, d)
    A.write_bounded(p, a.where("ann_idx < 10"), path, 25)
    return A.read_collection(spark, path, pattern="").agg(F.count("*").alias("n_docs"), F.countDistinct("file").alias("n_files"))


@query("a29_passages", "SELECT count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents")
def a29(spark, d):
    p, a = _flat(spark, d)
    q = A.passages(A.nest(p, a).withColumn("file", F.lit("f")))
    return q.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query("a7_batches", "SELECT count(*)::BIGINT AS n, count(DISTINCT n_name)::BIGINT AS n_ids FROM nation")
def a7(spark, d):
    spark.dataSource.register(A.BatchSource)
    ids = ",".join(r[0] for r in table(spark, d, "nation").select("n_name").collect())  # 25 names: the request itself
    return spark.read.format("annotated_batches").option("ids", ids + "," + ids).option("batchsize", "10").load().agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query("i2_remote_encoder", "SELECT count(*)::BIGINT AS n, 64::INT AS dim, (SELECT count(DISTINCT p_type) FROM part)::BIGINT AS n_types FROM (SELECT DISTINCT p_type FROM part)")
def i2(spark, d):
    """Batches of 100 at most, calls that fail twice, and a cache that half of the texts are in."""
    from ..operators import linking

    seen: dict[int, int] = {}

    def call(texts):
        if len(texts) > 100:
            raise ValueError("too many")
        key = len(texts)
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= 2:
            raise OSError("busy")
        return linking.hash_vectors(texts)

    t = table(spark, d, "part").select(F.col("p_type").alias("text")).distinct()
    cache = linking.encode(t.where(F.pmod(F.xxhash64("text"), F.lit(2)) == 0), "text")
    out = linking.remote_encode(t, "text", call, cache, pause=0.0)
    return out.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.countDistinct("text").alias("n_types"))
