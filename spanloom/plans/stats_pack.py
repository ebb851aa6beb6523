"""Queries on corpus statistics: counts, distributions, cross-tabs, sets, growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as X
from ..operators import aggregates as G
from ..operators import filters, joins, scoring
from ..session import table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


TOK = "regexp_extract_all(lower(replace(text, '_', ' ')), '[\\p{L}\\p{N}_]+')"


@query("d2_d3_length_stats", "SELECT CASE WHEN grouping(lang) = 1 THEN 'Total' ELSE lang END AS lang, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS n_distinct, avg(length(text)) AS mean_len, median(length(text))::DOUBLE AS median_len, min(length(text))::BIGINT AS min_len, max(length(text))::BIGINT AS max_len, stddev_pop(length(text)) AS std_len FROM documents GROUP BY ROLLUP (lang)")
def d2(spark, d):
    n = F.length("text")
    return G.with_total(docs(spark, d), "lang", F.count("*").alias("n"), F.countDistinct("text").alias("n_distinct"), F.avg(n).alias("mean_len"), F.median(n).alias("median_len"), F.min(n).cast("bigint").alias("min_len"), F.max(n).cast("bigint").alias("max_len"), F.stddev_pop(n).alias("std_len"))


@query("d1_counts", f"SELECT lang, count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS n_sources, sum(len({TOK}))::BIGINT AS n_tokens, sum(greatest(length(text) - length(replace(text, '.', '')), 1))::BIGINT AS n_sentences FROM documents GROUP BY 1")
def d1(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.sum(F.size(X.corpus_tokens(F.col("text")))).alias("n_tokens"), F.sum(X.sentence_estimate(F.col("text"))).cast("bigint").alias("n_sentences"))


def tokens(spark, d):
    return docs(spark, d).select("doc_id", "lang", F.explode(X.corpus_tokens(F.col("text"))).alias("tok"))


T = f"t AS (SELECT doc_id, lang, unnest({TOK}) AS tok FROM documents)"


@query("e1_d4_top_tokens", f"WITH {T} SELECT tok, count(*)::BIGINT AS n FROM t GROUP BY 1 ORDER BY n DESC, tok LIMIT 100")
def e1(spark, d):
    return G.frequencies(tokens(spark, d), "tok", k=100)


@query("d5_repeated_texts", "SELECT md5(text) AS digest, count(*)::BIGINT AS n FROM documents GROUP BY text HAVING count(*) > 1")
def d5(spark, d):
    return G.repeated(docs(spark, d).select(F.md5(F.col("text").cast("binary")).alias("digest")), "digest")


@query("d6_shares", f"WITH {T}, c AS (SELECT lang, count(*)::BIGINT AS n FROM t GROUP BY 1) SELECT lang, n, n * 100.0 / (SELECT sum(n) FROM c) AS percent FROM c")
def d6(spark, d):
    return G.shares(tokens(spark, d).groupBy("lang").agg(F.count("*").alias("n")), "n")


@query("d6_rate_per_100_tokens", f"WITH {T}, a AS (SELECT lang, count(*)::BIGINT AS n_docs FROM documents GROUP BY 1) SELECT lang, n_docs, n_tokens, n_docs * 100.0 / n_tokens AS per_100 FROM a JOIN (SELECT lang, count(*)::BIGINT AS n_tokens FROM t GROUP BY 1) USING (lang)")
def d6r(spark, d):
    x = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(X.corpus_tokens(F.col("text")))).alias("n_tokens"))
    return x.withColumn("per_100", F.col("n_docs") * 100.0 / F.col("n_tokens"))


@query("d7_floor_percent", "SELECT lang, floor(count(*) FILTER (n_chars > 1000) * 100 / count(*))::BIGINT AS percent_long FROM documents GROUP BY 1")
def d7(spark, d):
    return docs(spark, d).groupBy("lang").agg(G.floor_percent(F.col("n_chars") > 1000).alias("percent_long"))


@query("d8_crosstab", "WITH x AS (SELECT source, lang FROM documents), c AS (SELECT source, count(*) FILTER (lang = 'en')::BIGINT AS n_en, count(*) FILTER (lang = 'de')::BIGINT AS n_de, count(*) FILTER (lang = 'xx')::BIGINT AS n_xx FROM x GROUP BY 1) SELECT source, n_en, n_en * 100.0 / (SELECT sum(n_en) FROM c) AS p_en, n_de, n_de * 100.0 / (SELECT sum(n_de) FROM c) AS p_de, n_xx, NULL::DOUBLE AS p_xx FROM c")
def d8(spark, d):
    return G.crosstab(docs(spark, d), "source", "lang", ["en", "de", "xx"])


@query("d9_element_counts", "WITH p AS (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS element FROM part) SELECT element, count(*)::BIGINT AS n, count(*) / (SELECT count(*) FROM part) AS share FROM p GROUP BY 1")
def d9(spark, d):
    return G.element_counts(table(spark, d, "part").select(F.split("p_name", " ").alias("a")), "a")


@query("d10_membership", "SELECT count(*) FILTER (list_contains(a, 'Brand#1'))::BIGINT AS n_a, count(*) FILTER (list_contains(a, 'B'))::BIGINT AS n_b, count(*) FILTER (list_contains(a, 'Brand#1') AND list_contains(a, 'B'))::BIGINT AS n_both FROM (SELECT [p_brand, left(p_brand, 1)] AS a FROM part)")
def d10(spark, d):
    return G.membership_counts(table(spark, d, "part").select(F.array("p_brand", F.substring("p_brand", 1, 1)).alias("a")), "a", "Brand#1", "B")


@query("d11_fraction", "SELECT lang, count(*) FILTER (n_chars > 1000) || '/' || count(*) AS fraction FROM documents GROUP BY 1")
def d11(spark, d):
    x = docs(spark, d).groupBy("lang").agg(F.count_if(F.col("n_chars") > 1000).alias("a"), F.count("*").alias("b"))
    return x.select("lang", F.substring_index(X.fraction(F.col("a"), F.col("b"), 4), " (", 1).alias("fraction"))


@query("d20_entity_counts", "SELECT count(*) FILTER (event_type = 'click')::BIGINT AS n_click, count(*) FILTER (event_type = 'view')::BIGINT AS n_view, count(*) FILTER (value > 50)::BIGINT AS n_high FROM events")
def d20(spark, d):
    c = F.col
    return G.count_ifs(table(spark, d, "events"), n_click=c("event_type") == "click", n_view=c("event_type") == "view", n_high=c("value") > 50)


@query("d21_type_histogram", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def d21(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("d23_roc_auc", "WITH x AS (SELECT l.quality AS y, (d.n_chars % 1000) / 1000.0 AS s FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM x GROUP BY 1), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) / (SELECT sum(p) FROM g) AS t, sum(n) OVER (ORDER BY s DESC) / (SELECT sum(n) FROM g) AS f FROM g), k AS (SELECT *, coalesce(lag(t) OVER (ORDER BY s DESC), 0) AS t0, coalesce(lag(f) OVER (ORDER BY s DESC), 0) AS f0 FROM c) SELECT sum((f - f0) * (t + t0) / 2) AS auc FROM k")
def d23(spark, d):
    x = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("quality", (F.col("n_chars") % 1000 / 1000.0).alias("s"))
    return scoring.auc(x, "quality", "s")


@query("d23_roc_points", "WITH x AS (SELECT l.quality AS y, (d.n_chars % 100) / 100.0 AS s FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM x GROUP BY 1) SELECT s::DOUBLE AS score, sum(p) OVER (ORDER BY s DESC) / (SELECT sum(p) FROM g) AS tpr, sum(n) OVER (ORDER BY s DESC) / (SELECT sum(n) FROM g) AS fpr FROM g")
def d23p(spark, d):
    x = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("quality", (F.col("n_chars") % 100 / 100.0).alias("s"))
    return scoring.roc(x, "quality", "s")


@query("d24_histogram", "SELECT quality, least(floor(s * 20)::INT + 1, 20)::INT AS bin, count(*)::BIGINT AS n FROM (SELECT l.quality, (d.n_chars % 257) / 256.0 AS s FROM documents d JOIN labels l USING (doc_id)) GROUP BY 1, 2")
def d24(spark, d):
    x = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("quality", (F.col("n_chars") % 257 / 256.0).alias("s"))
    return G.histogram(x, "s", by=["quality"])


@query("d25_frequency_cdf", f"WITH {T}, c AS (SELECT tok, count(*) AS c FROM t GROUP BY 1) SELECT x::INT AS x, count(*) FILTER (c <= x) / count(*) AS share FROM c, range(1, 9) r(x) GROUP BY 1")
def d25(spark, d):
    return G.frequency_cdf(tokens(spark, d), "tok")


@query("d26_reciprocal_frequency", f"WITH {T}, c AS (SELECT c AS frequency, count(*) * c AS m FROM (SELECT tok, count(*) AS c FROM t GROUP BY 1) GROUP BY 1), w AS (SELECT frequency, m, sum(m) OVER (ORDER BY frequency) AS u, greatest(sum(m) OVER () - 1, 1) AS sc FROM c) SELECT frequency::BIGINT AS frequency, 1.0 / frequency AS y, (u - m) / sc AS from_x, (u - 1) / sc AS to_x FROM w")
def d26(spark, d):
    return G.reciprocal_frequency(tokens(spark, d), "tok").select("frequency", F.col("y").cast("double").alias("y"), "from_x", "to_x")


@query("d27_by_value_set", "SELECT values, count(*)::BIGINT AS n FROM (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS values FROM events WHERE event_id % 7 = 0 GROUP BY 1) GROUP BY 1".replace("WHERE event_id % 7 = 0 ", ""))
def d27(spark, d):
    return G.by_value_set(table(spark, d, "events"), "user_id", "event_type")


@query("d28_mean_over_time", "SELECT strftime(ts, '%Y-%m-%d') AS day, avg(value) AS mean_value FROM events GROUP BY 1")
def d28(spark, d):
    return G.mean_over_time(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value"), "day", "value")


@query("d30_label_vocabulary", "SELECT (row_number() OVER (ORDER BY label) - 1)::INT AS label_id, label FROM (SELECT DISTINCT unnest([lang, source]) AS label FROM documents)")
def d30(spark, d):
    return G.label_vocabulary(docs(spark, d).select(F.array("lang", "source").alias("a")), "a")


@query("d33_c1_metadata_counts", "SELECT coalesce(l.quality::VARCHAR, 'missing') AS quality, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def d33(spark, d):
    meta = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return joins.with_metadata(docs(spark, d), meta, "doc_id", {"quality": "missing"}).groupBy("quality").agg(F.count("*").alias("n"))


@query("c2_names", "SELECT c.c_custkey, coalesce(n.n_name, '[no match]') AS n_name FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) n ON n.n_nationkey = c.c_nationkey")
def c2(spark, d):
    names = table(spark, d, "nation").where("n_nationkey < 12").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.with_names(table(spark, d, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("c3_missing_keys", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c3(spark, d):
    return joins.missing_keys(docs(spark, d), table(spark, d, "labels"), "doc_id")


@query("c12_c13_positional", "SELECT conv_id, turn, len(text) AS size FROM conversations")
def c12(spark, d):
    c = table(spark, d, "conversations")
    a = c.select("conv_id", "turn", "text", F.array(F.lit("a")).alias("annotations"))
    b = c.select("conv_id", "turn", "text", F.array(F.lit("b")).alias("annotations"))
    j = joins.positional(a, b, ["conv_id", "turn"])
    return j.where(F.size("annotations") == 2).select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))


@query("c19_standardise_ids", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id::VARCHAR END IS NULL AS was_null, CASE WHEN doc_id % 10 = 9 THEN (CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id::VARCHAR END) ELSE doc_id::VARCHAR END AS pmid, CASE WHEN doc_id % 10 = 9 THEN (CASE WHEN doc_id % 3 = 1 THEN NULL WHEN doc_id % 3 = 2 THEN 'PMCx' ELSE 'PMC' || doc_id END) ELSE 'PMC' || doc_id END AS pmc, CASE WHEN doc_id % 10 = 9 THEN 'unknown' WHEN doc_id % 3 = 2 THEN 'updated' ELSE 'completed' END AS status FROM documents")
def c19(spark, d):
    i = F.col("doc_id")
    s = i.cast("string")
    rows = docs(spark, d).select("doc_id", (i % 3 == 0).alias("was_null"), F.when(i % 3 != 0, s).alias("pmid"), F.when(i % 3 == 2, "PMCx").when(i % 3 == 0, F.concat(F.lit("PMC"), s)).alias("pmc"))
    known = docs(spark, d).where(i % 10 != 9).select(s.alias("pmid"), F.concat(F.lit("PMC"), s).alias("pmc"), i.alias("pair_order"))
    return joins.standardise_ids(rows, known)


@query("c16_c20_cached_results", "SELECT lang, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS total FROM documents GROUP BY 1")
def c16(spark, d):
    rows = docs(spark, d).select("doc_id", "lang", "text")
    cache = rows.where("doc_id % 2 = 0").select("text").distinct().withColumn("size", F.length("text"))
    found, _ = joins.through_cache(rows, cache, "text", lambda k: k.withColumn("size", F.length("text")))
    return joins.attach_results(rows, found, ["text"]).where("found").groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


@query("g4_head_tail", "SELECT * FROM (SELECT 'head' AS part, doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'tail' AS part, doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 10)")
def g4(spark, d):
    x = docs(spark, d).select("doc_id", "n_chars")
    return G.union_all({"head": G.head(x, [F.desc("n_chars"), F.col("doc_id")]), "tail": G.head(x, [F.col("n_chars"), F.col("doc_id")])}, "part")


@query("g5_g17_distinct_dates", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events")
def g5(spark, d):
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().orderBy("day")


@query("g6_g8_union", "SELECT dataset, count(*)::BIGINT AS n FROM (SELECT lang AS dataset FROM documents UNION ALL SELECT 'all other' FROM documents WHERE lang <> 'en') GROUP BY 1")
def g6(spark, d):
    x = docs(spark, d)
    named = x.select(F.col("lang").alias("dataset"))
    return named.unionByName(x.where("lang <> 'en'").select(F.lit("all other").alias("dataset"))).groupBy("dataset").agg(F.count("*").alias("n"))


@query("g9_two_sets", f"WITH {T}, k AS (SELECT tok, max((lang = 'en')::INT) AS en, max((lang = 'de')::INT) AS de FROM t WHERE lang IN ('en', 'de') GROUP BY 1) SELECT en, de, count(*)::BIGINT AS n FROM k GROUP BY 1, 2")
def g9(spark, d):
    t = tokens(spark, d)
    return G.venn(joins.flags({k: t.where(F.col("lang") == k) for k in ("en", "de")}, "tok"), ["en", "de"])


@query("g10_three_sets", f"WITH {T}, k AS (SELECT tok, max((doc_id % 10 < 8)::INT) AS train, max((doc_id % 10 = 8)::INT) AS val, max((doc_id % 10 = 9)::INT) AS test FROM t GROUP BY 1) SELECT train, val, test, count(*)::BIGINT AS n FROM k GROUP BY 1, 2, 3")
def g10(spark, d):
    t = tokens(spark, d)
    s = F.col("doc_id") % 10
    return G.venn(joins.flags({"train": t.where(s < 8), "val": t.where(s == 8), "test": t.where(s == 9)}, "tok"), ["train", "val", "test"])


@query("g11_later_duplicates", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def g11(spark, d):
    return G.later_duplicates(docs(spark, d), ["text"], ["doc_id"]).select("doc_id")


CUM = "SELECT day, sum(coalesce(n, 0)) OVER (ORDER BY day)::BIGINT AS cumulative FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events) LEFT JOIN (SELECT day, count(*) AS n FROM (SELECT min(strftime(ts, '%Y-%m-%d')) AS day FROM events GROUP BY {k}) GROUP BY 1) USING (day)"


@query("g12_cumulative_users", CUM.format(k="user_id"))
def g12(spark, d):
    return G.cumulative_distinct(table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", ["user_id"])


@query("g12_cumulative_pairs", CUM.format(k="user_id, event_type"))
def g12p(spark, d):
    return G.cumulative_distinct(table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", ["user_id", "event_type"])


@query("g13_report", "SELECT metric, max(v) FILTER (ds = 'en')::BIGINT AS en, max(v) FILTER (ds = 'fr')::BIGINT AS fr FROM (SELECT lang AS ds, unnest(['n_docs', 'n_chars']) AS metric, unnest([count(*), sum(n_chars)]) AS v FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1) GROUP BY 1")
def g13(spark, d):
    def one(lang):
        x = docs(spark, d).where(F.col("lang") == lang).agg(F.count("*").alias("a"), F.sum("n_chars").alias("b"))
        return x.select(F.explode(F.array(F.struct(F.lit("n_docs").alias("metric"), F.col("a").alias("v")), F.struct(F.lit("n_chars").alias("metric"), F.col("b").alias("v")))).alias("x")).select("x.*")

    return G.report({k: one(k) for k in ("en", "fr")}, "metric", "v")


@query("b1_annotatable", "SELECT v::INT AS variant, count(*) FILTER (CASE v WHEN 1 THEN length(text) > 0 AND f <> 'no' WHEN 2 THEN f NOT IN ('False', 'no') WHEN 3 THEN f <> '' ELSE f <> '' AND length(text) > 0 END)::BIGINT AS n FROM (SELECT text, CASE doc_id % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'False' WHEN 2 THEN '' ELSE 'yes' END AS f FROM documents), range(1, 5) r(v) GROUP BY 1")
def b1(spark, d):
    k = F.col("doc_id") % 4
    x = docs(spark, d).withColumn("f", F.when(k == 0, "no").when(k == 1, "False").when(k == 2, "").otherwise("yes"))
    one = x.agg(*(F.count_if(filters.annotatable(F.col("text"), F.col("f"), v)).alias(str(v)) for v in (1, 2, 3, 4)))
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(str(v)).alias("n")) for v in (1, 2, 3, 4)])).alias("x")).select("x.*")


@query("b14_ellipsis", "SELECT count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, ' ')) AS t FROM documents) WHERE t[:-2] = upper(t[:-2]) AND t[:-2] <> lower(t[:-2]) AND NOT regexp_matches(t, 'neuron|cyte|blast|clast|phage|cell|precursor|neutrophil|platelet|glia|troph|sperm|fiber|phore|tube')")
def b14(spark, d):
    return docs(spark, d).select(F.explode(F.split("text", " ")).alias("t")).where(X.is_ellipsis(F.col("t"))).agg(F.count("*").alias("n"))


SEC = "CASE doc_id % 9 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'RESULTS' WHEN 2 THEN 'FIG' WHEN 3 THEN 'TABLE' WHEN 4 THEN 'INTRO' WHEN 5 THEN 'DISCUSS' WHEN 6 THEN 'ABBR' WHEN 7 THEN NULL ELSE 'ABSTRACT' END"
KIND = "CASE (doc_id // 9) % 7 WHEN 0 THEN 'front' WHEN 1 THEN 'title_2' WHEN 2 THEN 'paragraph' WHEN 3 THEN 'table' WHEN 4 THEN 'table_caption' WHEN 5 THEN 'fig_caption' ELSE NULL END"


@query("b15_b16_sections", f"WITH x AS (SELECT coalesce({SEC}, 'None') AS a, coalesce({KIND}, 'None') AS b FROM documents), y AS (SELECT *, a || '/' || b AS c FROM x) SELECT CASE WHEN c IN ('TITLE/front', 'None/title') THEN 'Title' WHEN lower(c) LIKE '%title%' THEN 'Section title' WHEN lower(c) LIKE '%abstract%' THEN 'Abstract' WHEN a = 'INTRO' THEN 'Intro' WHEN lower(c) LIKE '%results%' THEN 'Results' WHEN a IN ('DISCUSS', 'CONCL') THEN 'Discussion & Conclusion' WHEN c = 'TABLE/table' THEN 'Table' WHEN c LIKE '%table%' OR c LIKE '%fig%' THEN 'Table and figure captions' ELSE 'Other [abbreviations, appendix]' END AS bucket, CASE WHEN c = 'INTRO/paragraph' THEN 'intro_paragraph' WHEN c = 'RESULTS/paragraph' THEN 'results_paragraph' WHEN c IN ('FIG/fig_caption', 'TABLE/table_caption') THEN 'fig_or_table_caption' WHEN c = 'DISCUSS/paragraph' THEN 'discussion_paragraph' WHEN c = 'ABBR/paragraph' THEN 'abbreviations' WHEN c IN ('RESULTS/title_2', 'TITLE/front', 'DISCUSS/title_2') THEN 'title_and_subsection_titles' WHEN c = 'TABLE/table' THEN 'table' WHEN c = 'INTRO/title_2' THEN 'other' END AS category, count(*)::BIGINT AS n FROM y GROUP BY 1, 2")
def b15(spark, d):
    x = docs(spark, d).selectExpr(f"{SEC} AS a", KIND.replace("(doc_id // 9)", "(doc_id div 9)") + " AS b")
    both = F.concat_ws("/", F.coalesce("a", F.lit("None")), F.coalesce("b", F.lit("None")))
    return x.select(X.section_bucket(F.col("a"), F.col("b")).alias("bucket"), X.passage_category(both).alias("category")).groupBy("bucket", "category").agg(F.count("*").alias("n"))


@query("b17_b18_paths", "SELECT doc_id, (doc_id % 13)::INT AS set_number, '2025-0' || (doc_id % 9 + 1) || '-10' AS day FROM documents")
def b17(spark, d):
    s = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/x/2025-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-10_round/"), s, F.lit("_set"), (F.col("doc_id") % 13).cast("string"), F.lit("b.xml"))
    return docs(spark, d).select("doc_id", X.set_number(F.element_at(F.split(path, "/"), -1)).alias("set_number"), X.path_date(path).alias("day"))


@query("b19_split", "SELECT 'low' AS side, count(*)::BIGINT AS n FROM documents WHERE doc_id % 13 < 6 UNION ALL SELECT 'high', count(*)::BIGINT FROM documents WHERE NOT doc_id % 13 < 6")
def b19(spark, d):
    lo, hi = filters.split_by(docs(spark, d), F.col("doc_id") % 13 < 6)
    return lo.agg(F.lit("low").alias("side"), F.count("*").alias("n")).unionByName(hi.agg(F.lit("high").alias("side"), F.count("*").alias("n")))


@query("b27_b29_lookup", "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.none'), 'None') AS missing FROM events WHERE user_id = 7")
def b27(spark, d):
    e = filters.lookup(table(spark, d, "events"), "user_id", 7).withColumn("m", F.from_json("props", "map<string,string>"))
    return e.select("event_id", I.infon(F.col("m"), "k").alias("k"), I.infon(F.col("m"), "none", "None").alias("missing"))


RULES = [
    {"is_update": True, "mention": "the", "type": None, "identifier": None, "new_type": "article", "new_identifier": "A"},
    {"is_update": True, "mention": None, "type": "article", "identifier": "A", "new_type": "word", "new_identifier": "W"},
    {"is_update": True, "mention": "of", "type": "en", "identifier": None, "new_type": "preposition", "new_identifier": "P"},
    {"is_update": False, "mention": None, "type": "word", "identifier": None},
    {"is_update": False, "mention": "and", "type": "de", "identifier": None},
]


@query("b22_b24_rules", "SELECT CASE WHEN t = 'of' AND lang = 'en' THEN 'preposition' ELSE lang END AS type, CASE WHEN t = 'of' AND lang = 'en' THEN 'P' ELSE 'None' END AS identifier, count(*)::BIGINT AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS t FROM documents) WHERE t <> 'the' AND NOT (t = 'and' AND lang = 'de') GROUP BY 1, 2")
def b22(spark, d):
    a = docs(spark, d).select(F.col("lang").alias("type"), F.lit("None").alias("identifier"), F.explode(F.split("text", " ")).alias("text"))
    return filters.apply_rules(a, RULES).groupBy("type", "identifier").agg(F.count("*").alias("n"))
