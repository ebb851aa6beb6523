"""Queries on stemming, abbreviations, vectors, models and other text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as G
from ..operators import filters, linking, scoring
from ..session import table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


STEM = """CASE WHEN NOT ends_with(t, 's') THEN t WHEN ends_with(t, 'viruses') THEN regexp_replace(t, 'uses$', 'us')
 WHEN ends_with(t, 'ies') AND NOT ends_with(t, 'eies') AND NOT ends_with(t, 'aies') THEN regexp_replace(t, 'ies$', 'y')
 WHEN ends_with(t, 'es') AND NOT ends_with(t, 'aes') AND NOT ends_with(t, 'ees') AND NOT ends_with(t, 'oes') THEN CASE WHEN ends_with(t, 'sses') THEN regexp_replace(t, 'es$', '') ELSE regexp_replace(t, 'es$', 'e') END
 WHEN NOT ends_with(t, 'us') AND NOT ends_with(t, 'ss') THEN regexp_replace(t, 's$', '') ELSE t END"""


@query("e2_e5_stems", f"SELECT s, count(*)::BIGINT AS n FROM (SELECT {STEM} AS s FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}_\\s]|_|,')) AS t FROM documents)) GROUP BY 1 ORDER BY n DESC, s LIMIT 200")
def e5(spark, d):
    t = table(spark, d, "documents").select(F.explode(X.link_tokens(F.col("text"))).alias("t"))
    return G.frequencies(t.select(X.s_stem(F.col("t")).alias("s")), "s", k=200)


@query("e6_b30_stemmed_mentions", f"WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(p_name, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}_\\s]|_|,')) AS t, generate_subscripts(regexp_extract_all(p_name, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}_\\s]|_|,'), 1) AS i FROM part), s AS (SELECT p_partkey, string_agg({STEM}, ' ' ORDER BY i) AS mention FROM t GROUP BY 1) SELECT DISTINCT p_brand AS pmid, mention FROM s JOIN part USING (p_partkey)")
def e6(spark, d):
    a = table(spark, d, "part").select(F.col("p_brand").alias("pmid"), F.lit("cell_phenotype").alias("type"), F.col("p_name").alias("text"))
    return filters.distinct_mentions(a, X.stem_phrase(F.col("text")))


@query("e3_sentences", "SELECT lang, sum(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')))::BIGINT AS n FROM documents GROUP BY 1")
def e3(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(X.sentences(F.col("text")))).alias("n"))


@query("e4_split_punctuation", "SELECT count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_'']+|[!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^`{|}~]')) FROM benchmark)")
def e4(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text")
    return b.select(F.explode(X.split_punctuation(F.col("text"), F.lit(0))).alias("x")).agg(F.count("*").alias("n"))


# the phrase has no edge characters in it, so whole hits are pieces between edges; where there is none, pieces in any case count
EDGES = r"[\s!-/:-@\[-`{-~]"
HITS = f"SELECT doc_id, CASE WHEN a > 0 THEN a ELSE b END::BIGINT AS n FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{EDGES}'), lambda x: x = '<phrase>')) AS a, len(list_filter(regexp_split_to_array(lower(text), '{EDGES}'), lambda x: x = lower('<phrase>'))) AS b FROM documents) WHERE a > 0 OR b > 0"


def _hits(spark, d, phrase):
    n = F.size(X.phrase_hits(F.col("text"), F.lit(phrase))).cast("bigint")
    return table(spark, d, "documents").select("doc_id", n.alias("n")).where("n > 0")


@query("e13_find_phrase", HITS.replace("<phrase>", "the"))
def e13(spark, d):
    return _hits(spark, d, "the")


@query("e14_other_case", HITS.replace("<phrase>", "THE"))
def e14(spark, d):
    return _hits(spark, d, "THE")


@query("e19_bio_fields", "SELECT string_split(l, '-')[1] AS prefix, string_split(l, '-')[2] AS type, count(*)::BIGINT AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'B-' || event_type ELSE 'I-' || event_type || '-x' END AS l FROM events) GROUP BY 1, 2")
def e19(spark, d):
    k = F.col("event_id") % 3
    label = F.when(k == 0, "O").when(k == 1, F.concat(F.lit("B-"), "event_type")).otherwise(F.concat(F.lit("I-"), F.col("event_type"), F.lit("-x")))
    return table(spark, d, "events").select(X.bio_fields(label).alias("x")).select("x.*").groupBy("prefix", "type").agg(F.count("*").alias("n"))


@query("e7_registry", "WITH a AS (SELECT c_custkey // 10 AS doc_id, left(c_name, 1 + (c_custkey % 3)::INT) AS short, c_mktsegment AS long, c_custkey AS load_order FROM customer) SELECT doc_id, short, min_by(long, load_order) AS long, min(load_order) AS load_order FROM a GROUP BY 1, 2")
def e7(spark, d):
    c = table(spark, d, "customer")
    rows = c.selectExpr("c_custkey div 10 AS doc_id", "left(c_name, 1 + c_custkey % 3) AS short", "c_mktsegment AS long", "c_custkey AS load_order")
    return linking.abbreviation_registry(rows)


@query("e8_e9_expansion", "SELECT o_orderkey, regexp_replace(regexp_replace(s, '\\bHIGH\\b', 'very high', 'g'), '\\bURG\\b', 'urgent (now)', 'g') AS expanded FROM (SELECT o_orderkey, replace(replace(o_orderpriority, 'URGENT', 'URG'), '-', ' ') || ' HIGH' AS s FROM orders)")
def e8(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "concat(replace(replace(o_orderpriority, 'URGENT', 'URG'), '-', ' '), ' HIGH') AS s")
    pairs = F.array(*[F.struct(F.lit(a).alias("short"), F.lit(b).alias("long")) for a, b in (("HIGH", "very high"), ("URG", "urgent (now)"))])
    return o.select("o_orderkey", X.expand_abbreviations(F.col("s"), pairs).alias("expanded"))


@query("e10_e11_normalise", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'PMC' || doc_id WHEN doc_id % 4 = 2 THEN 'PMC' || doc_id ELSE NULL END AS pmc FROM documents")
def e11(spark, d):
    from ..functions.identifiers import pmc_id

    k, s = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    raw = F.when(k == 0, "None").when(k == 1, F.concat(F.lit(" "), s)).when(k == 2, F.concat(F.lit("PMC"), s)).otherwise(" ")
    return table(spark, d, "documents").select("doc_id", pmc_id(raw).alias("pmc"))


@query("e17_e20_prompts", "SELECT turn, count(*)::BIGINT AS n, sum(length('Passage: ' || text || chr(10) || 'Role: ' || role))::BIGINT AS total, sum(greatest(length(text) - 11, 0))::BIGINT AS rest FROM conversations GROUP BY 1")
def e17(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("turn").agg(F.count("*").alias("n"), F.sum(F.length(X.prompt("Passage: %s\nRole: %s", F.col("text"), F.col("role")))).alias("total"), F.sum(F.length(X.after_prefix(F.col("text")))).alias("rest"))


@query("e18_json_lists", "SELECT event_id % 5 AS k, count(*) FILTER (event_id % 5 IN (0, 1))::BIGINT AS n_valid FROM events GROUP BY 1")
def e18(spark, d):
    k = F.col("event_id") % 5
    s = F.when(k == 0, '["a", "b"]').when(k == 1, "[]").when(k == 2, "[1]").when(k == 3, '{"a": 1}').otherwise("[oops")
    return table(spark, d, "events").select(k.alias("k"), X.is_json_string_list(s).alias("ok")).groupBy("k").agg(F.count_if("ok").alias("n_valid"))


@query("e21_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def e21(spark, d):
    return table(spark, d, "embeddings").select("vec_id", X.argmax(F.col("embedding")).alias("best"))


COS = "WITH s AS (SELECT q.vec_id AS query_id, t.vec_id AS term_id, 1 - list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(t.embedding, lambda x: x::DOUBLE)) AS dist FROM embeddings q JOIN embeddings t ON q.vec_id % 10 = 0 AND t.vec_id % 10 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, term_id)::INT AS rank FROM s) "


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return q, e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("term_id"), F.col("embedding").alias("vector"))


@query("c14_g1_top_k", COS + "SELECT query_id, rank, term_id, dist AS distance FROM k WHERE rank <= 10")
def c14(spark, d):
    return linking.top_k_cosine(*_vectors(spark, d))


@query("c14_top_k_blocked", COS + "SELECT query_id, rank, term_id, dist AS distance FROM k WHERE rank <= 10")
def c14b(spark, d):
    return linking.top_k_blocked(*_vectors(spark, d))


@query("g2_e16_wide_links", COS + "SELECT query_id, max(term_id) FILTER (rank = 1)::VARCHAR AS id_0, max(term_id) FILTER (rank = 2)::VARCHAR AS id_1, max(term_id) FILTER (rank = 3)::VARCHAR AS id_2, '-' AS id_3, max(power(1 - dist, 2)) FILTER (rank = 1) AS score FROM k GROUP BY 1")
def g2(spark, d):
    top = linking.top_k_cosine(*_vectors(spark, d), k=3)
    best = top.where("rank = 1").select("query_id", X.link_score(F.col("distance")).alias("score"))
    return G.wide(top, ["query_id"], "rank", "term_id", 4).join(best, "query_id")


@query("d22_hit_at_k", COS + ", g AS (SELECT query_id, rank, (q.label = t.label)::INT AS hit FROM k JOIN embeddings q ON q.vec_id = query_id JOIN embeddings t ON t.vec_id = term_id WHERE rank <= 10) SELECT n::INT AS k, avg(h) AS hit_rate FROM (SELECT query_id, n, max(CASE WHEN rank <= n THEN hit ELSE 0 END) AS h FROM g, (VALUES (1), (5), (10)) v(n) GROUP BY 1, 2) GROUP BY 1")
def d22(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    top = linking.top_k_cosine(*_vectors(spark, d))
    g = top.join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(e.select(F.col("vec_id").alias("term_id"), F.col("label").alias("b")), "term_id")
    first = g.groupBy("query_id").agg(F.min(F.when(F.col("a") == F.col("b"), F.col("rank"))).alias("r"))
    one = first.agg(*(F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))).alias(str(k)) for k in (1, 5, 10)))
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("hit_rate")) for k in (1, 5, 10)])).alias("x")).select("x.*")


@query("i1_i3_link_parts")
def i3(spark, d):
    p = table(spark, d, "part")
    anns = p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("ann_id"), F.lit("cell_phenotype").alias("type"), F.col("p_name").alias("text"))
    terms = linking.encode(p.select(F.col("p_type").alias("term_id")).distinct(), "term_id")
    reg = linking.abbreviation_registry(spark.createDataFrame([("Brand#1", "x", "express", 1)], "doc_id string, short string, long string, load_order long"))
    return linking.link(anns, terms, reg, k=3)


@query("i4_search_labels", "SELECT 'CL:' || n_nationkey AS id, n_name AS name FROM nation ORDER BY contains(lower(n_name), 'nation') DESC, levenshtein(lower(n_name), 'nation'), id LIMIT 20")
def i4(spark, d):
    t = table(spark, d, "nation").select(F.concat(F.lit("CL:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    return linking.search_labels(t, "nation")


@query("i7_d31_generation", "SELECT count(*) FILTER (p_partkey % 3 <> 0)::BIGINT AS n_retried, count(*) FILTER (p_partkey % 3 = 2)::BIGINT AS n_forced_empty, avg((p_partkey % 3 <> 0)::INT) * 100 AS percent_retried FROM part")
def i7(spark, d):
    def model(text: str, attempt: int) -> str:
        k = int(text) % 3
        return '["x"]' if k == 0 or (k == 1 and attempt == 2) else "no list"

    return linking.retry_summary(linking.generate(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("t")), "t", model))


@query("d18_augmented_macro", "WITH RECURSIVE par AS (SELECT n_nationkey + 100 AS id, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, 1000 FROM region), clo AS (SELECT id, parent AS anc FROM par UNION SELECT c.id, p.parent FROM clo c JOIN par p ON p.id = c.anc), a AS (SELECT DISTINCT c_custkey // 5 AS doc_id, c_nationkey + 100 AS id FROM customer), b AS (SELECT DISTINCT c_custkey // 5 AS doc_id, (c_nationkey + c_custkey % 2) % 25 + 100 AS id FROM customer), aa AS (SELECT * FROM a UNION SELECT doc_id, anc FROM a JOIN clo USING (id)), bb AS (SELECT * FROM b UNION SELECT doc_id, anc FROM b JOIN clo USING (id)), m AS (SELECT coalesce(aa.doc_id, bb.doc_id) AS doc_id, aa.id IS NOT NULL AS x, bb.id IS NOT NULL AS y FROM aa FULL JOIN bb ON aa.doc_id = bb.doc_id AND aa.id = bb.id), c AS (SELECT doc_id, count(*) FILTER (x AND y) AS tp, count(*) FILTER (NOT x AND y) AS fp, count(*) FILTER (x AND NOT y) AS fn FROM m GROUP BY 1), f AS (SELECT CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM c) SELECT avg(p) AS precision, avg(r) AS recall, avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) AS f1 FROM f")
def d18(spark, d):
    par = table(spark, d, "nation").selectExpr("n_nationkey + 100 AS id", "n_regionkey AS parent").unionByName(table(spark, d, "region").selectExpr("r_regionkey AS id", "1000 AS parent"))
    c = table(spark, d, "customer")
    a = c.selectExpr("c_custkey div 5 AS doc_id", "c_nationkey + 100 AS id").distinct()
    b = c.selectExpr("c_custkey div 5 AS doc_id", "cast((c_nationkey + c_custkey % 2) % 25 + 100 as int) AS id").distinct()
    return scoring.augmented_macro(a, b, par)


@query("d18_lowest_common", """WITH RECURSIVE par AS (SELECT n_nationkey + 100 AS id, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, 1000 FROM region),
ids AS (SELECT id FROM par UNION SELECT parent FROM par), st AS (SELECT id, id AS anc, 0 AS d FROM ids UNION ALL SELECT s.id, p.parent, s.d + 1 FROM st s JOIN par p ON p.id = s.anc),
a AS (SELECT DISTINCT c_custkey // 5 AS doc_id, c_nationkey + 100 AS id FROM customer), b AS (SELECT DISTINCT c_custkey // 5 AS doc_id, (c_nationkey + c_custkey % 2) % 25 + 100 AS id FROM customer),
m AS (SELECT a.doc_id, a.id AS r, b.id AS p, x.anc AS l, x.d AS dr, y.d AS dp FROM a JOIN b USING (doc_id) JOIN st x ON x.id = a.id JOIN st y ON y.id = b.id AND y.anc = x.anc),
best AS (SELECT doc_id, r, p, l, dr, dp FROM (SELECT *, min(dr + dp) OVER (PARTITION BY doc_id, r) AS q FROM m) WHERE dr + dp = q UNION SELECT doc_id, r, p, l, dr, dp FROM (SELECT *, min(dr + dp) OVER (PARTITION BY doc_id, p) AS q FROM m) WHERE dr + dp = q),
aa AS (SELECT * FROM a UNION SELECT doc_id, x.anc FROM best JOIN st x ON x.id = r JOIN st y ON y.id = x.anc AND y.anc = l WHERE x.d + y.d = dr),
bb AS (SELECT * FROM b UNION SELECT doc_id, x.anc FROM best JOIN st x ON x.id = p JOIN st y ON y.id = x.anc AND y.anc = l WHERE x.d + y.d = dp),
f0 AS (SELECT coalesce(aa.doc_id, bb.doc_id) AS doc_id, aa.id IS NOT NULL AS x, bb.id IS NOT NULL AS y FROM aa FULL JOIN bb ON aa.doc_id = bb.doc_id AND aa.id = bb.id),
c AS (SELECT doc_id, count(*) FILTER (x AND y) AS tp, count(*) FILTER (NOT x AND y) AS fp, count(*) FILTER (x AND NOT y) AS fn FROM f0 GROUP BY 1), f AS (SELECT CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM c)
SELECT avg(p) AS precision, avg(r) AS recall, avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) AS f1 FROM f""")
def d18l(spark, d):
    par = table(spark, d, "nation").selectExpr("n_nationkey + 100 AS id", "n_regionkey AS parent").unionByName(table(spark, d, "region").selectExpr("r_regionkey AS id", "1000 AS parent"))
    c = table(spark, d, "customer")
    a = c.selectExpr("c_custkey div 5 AS doc_id", "c_nationkey + 100 AS id").distinct()
    b = c.selectExpr("c_custkey div 5 AS doc_id", "cast((c_nationkey + c_custkey % 2) % 25 + 100 as int) AS id").distinct()
    return scoring.lowest_common_macro(a, b, par)
