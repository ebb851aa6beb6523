"""Queries on spans: joins, scores, validation, sequences, identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import aggregates as G
from ..operators import filters, joins, scoring, sequences, spans, validation
from ..session import table
from .derive import PRF, TYPES, pred, ref, sql, words

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


KEYS = ["passage_id", "type", "start", "end", "text"]
STRICT = ", m AS (SELECT passage_id, type, s, e, text, max(a) AS a, max(b) AS b {g} FROM (SELECT passage_id, type, s, e, text, 1 AS a, 0 AS b {g} FROM r UNION ALL SELECT passage_id, type, s, e, text, 0, 1 {g} FROM p) GROUP BY passage_id, type, s, e, text {g})"
COUNTS = "sum(a * b)::BIGINT AS tp, sum((1 - a) * b)::BIGINT AS fp, sum(a * (1 - b))::BIGINT AS fn"


@query("d13_strict_eval", sql(STRICT.format(g="") + f", c AS (SELECT coalesce(type, 'Total') AS type, {COUNTS} FROM m GROUP BY ROLLUP (type)) SELECT type, tp, fp, fn, {PRF} FROM c"))
def d13(spark, d):
    return scoring.strict(ref(spark, d), pred(spark, d), KEYS)


@query("c5_match_flags", sql(STRICT.format(g="") + " SELECT a AS in_ref, b AS in_pred, count(*)::BIGINT AS n FROM m GROUP BY 1, 2"))
def c5(spark, d):
    return G.venn(scoring.matched(ref(spark, d), pred(spark, d), KEYS), ["in_ref", "in_pred"])


@query("g16_score_matrix", sql(STRICT.format(g=", lang, source") + f", c AS (SELECT lang, source, {COUNTS} FROM m GROUP BY 1, 2) SELECT lang, source, tp, fp, fn, {PRF} FROM c"))
def g16(spark, d):
    return scoring.score_matrix(ref(spark, d), pred(spark, d), KEYS, ["lang", "source"])


@query("b3_merged_eval", sql(", m AS (SELECT passage_id, s, e, text, max(a) AS a, max(b) AS b FROM (SELECT passage_id, s, e, text, 1 AS a, 0 AS b FROM r UNION ALL SELECT passage_id, s, e, text, 0, 1 FROM p) GROUP BY 1, 2, 3, 4), " + f"c AS (SELECT {COUNTS} FROM m) SELECT tp, fp, fn, {PRF} FROM c"))
def b3(spark, d):
    return scoring.strict(filters.relabel_all(ref(spark, d)), filters.relabel_all(pred(spark, d)), KEYS, by=None)


@query("b6_identifier_eval", sql(", x AS (SELECT DISTINCT passage_id, type, unnest(CASE WHEN lower(identifier) IN ('none', '') THEN [] ELSE regexp_split_to_array(identifier, '[,;]') END) AS id, 1 AS a, 0 AS b FROM r UNION ALL SELECT DISTINCT passage_id, type, unnest(CASE WHEN lower(identifier) IN ('none', '') THEN [] ELSE regexp_split_to_array(identifier, '[,;]') END), 0, 1 FROM p), m AS (SELECT passage_id, type, id, max(a) AS a, max(b) AS b FROM x GROUP BY 1, 2, 3), " + f"c AS (SELECT coalesce(type, 'Total') AS type, {COUNTS} FROM m GROUP BY ROLLUP (type)) SELECT type, tp, fp, fn, {PRF} FROM c"))
def b6(spark, d):
    ids = lambda s: s.select("passage_id", "type", F.explode(I.evaluation_ids(F.col("identifier"))).alias("identifier"))
    return scoring.strict(ids(ref(spark, d)), ids(pred(spark, d)), ["passage_id", "type", "identifier"])


@query("b7_agreement_ids", sql(" SELECT id, count(*)::BIGINT AS n FROM (SELECT CASE WHEN contains(x, 'CL:') THEN x ELSE 'placeholder' END AS id FROM (SELECT unnest(string_split(identifier, ',')) AS x FROM r)) GROUP BY 1"))
def b7(spark, d):
    return ref(spark, d).select(F.explode(I.agreement_ids(F.col("identifier"))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


NONE = "len(list_filter(regexp_split_to_array(regexp_replace({c}, '\\(skos:(related|exact)\\)', '', 'g'), '[,;]'), lambda x: lower(x) NOT IN ('none', '-', ''))) = 0".format(c="identifier")


@query("b8_b9_linked_share", sql(f" SELECT type, count(*)::BIGINT AS n, count(*) FILTER ({NONE})::BIGINT AS n_none, count(*) FILTER (identifier NOT LIKE '%(skos:related)%' AND identifier NOT LIKE '%-%' AND identifier LIKE '%(skos:exact)%')::BIGINT AS n_exact, floor(count(*) FILTER (NOT (identifier NOT LIKE '%(skos:related)%' AND identifier NOT LIKE '%-%' AND identifier LIKE '%(skos:exact)%')) * 100 / count(*))::BIGINT AS percent_not_exact FROM r GROUP BY type"))
def b8(spark, d):
    c = F.col("identifier")
    return ref(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if(I.is_none(c)).alias("n_none"), F.count_if(I.is_exact(c)).alias("n_exact"), G.floor_percent(~I.is_exact(c)).alias("percent_not_exact"))


IDS = "regexp_split_to_array(regexp_replace(identifier, '\\(skos:(related|exact)\\)', '', 'g'), '[,;]')"


@query("b11_top_ids", sql(f" SELECT id, count(*)::BIGINT AS n FROM (SELECT CASE WHEN lower(x) IN ('none', '-', '') THEN 'None' ELSE x END AS id FROM (SELECT unnest({IDS}) AS x FROM r)) GROUP BY 1 ORDER BY n DESC, id LIMIT 100"))
def b11(spark, d):
    return G.frequencies(ref(spark, d).select(F.explode(I.all_ids(F.col("identifier"), include_none=True)).alias("id")), "id", k=100)


@query("b12_b13_comparison", sql(f" SELECT lang, count(DISTINCT x)::BIGINT AS n_ids, any_value(nv)::BIGINT AS n_novel FROM (SELECT lang, unnest(CASE WHEN identifier = 'None' THEN [NULL] ELSE {IDS} END) AS x FROM r) JOIN (SELECT lang, count(DISTINCT CASE WHEN identifier = 'None' OR identifier LIKE '%rel%' OR identifier LIKE '%,%' OR identifier NOT LIKE '%CL%' THEN text END) AS nv FROM r GROUP BY 1) USING (lang) GROUP BY lang"))
def b12(spark, d):
    r = ref(spark, d)
    ids = r.select("lang", F.explode(I.comparison_ids(F.col("identifier"))).alias("x")).groupBy("lang").agg(F.countDistinct("x").alias("n_ids"))
    return ids.join(r.groupBy("lang").agg(F.countDistinct(F.when(I.is_novel(F.col("identifier")), F.col("text"))).alias("n_novel")), "lang")


@query("b10_exact_pieces", sql(" SELECT type, sum(len(list_filter(regexp_split_to_array(identifier, '[,;]'), lambda x: contains(x, 'skos:exact'))))::BIGINT AS n FROM r GROUP BY 1"))
def b10(spark, d):
    return ref(spark, d).groupBy("type").agg(F.sum(F.size(I.exact_pieces(F.col("identifier")))).alias("n"))


@query("b25_linkage", sql(" SELECT CASE WHEN identifier LIKE '%;%' THEN NULL WHEN identifier LIKE '%(skos:related)%' THEN 'related' WHEN identifier LIKE '%(skos:exact)%' THEN 'exact' ELSE 'none' END AS linkage, count(*)::BIGINT AS n FROM r WHERE identifier <> '-' AND type <> 'cell_vague' GROUP BY 1"))
def b25(spark, d):
    return ref(spark, d).where((F.col("identifier") != "-") & (F.col("type") != "cell_vague")).select(I.linkage(F.col("identifier")).alias("linkage")).groupBy("linkage").agg(F.count("*").alias("n"))


@query("b26_gold_rows", sql(f" SELECT 'exact' AS rows, count(*)::BIGINT AS n, count(DISTINCT replace(identifier, '(skos:exact)', ''))::BIGINT AS n_ids FROM r WHERE starts_with(identifier, '(skos:exact)') AND identifier NOT LIKE '%,%' AND identifier NOT LIKE '%;%' UNION ALL SELECT 'all', count(*)::BIGINT, count(DISTINCT x)::BIGINT FROM (SELECT unnest({IDS}) AS x FROM r WHERE type <> 'cell_vague')"))
def b26(spark, d):
    r = ref(spark, d)
    one = r.select(I.single_exact(F.col("identifier")).alias("x")).where("x is not null").agg(F.lit("exact").alias("rows"), F.count("*").alias("n"), F.countDistinct("x").alias("n_ids"))
    every = r.where("type <> 'cell_vague'").select(F.explode(I.pieces(I.strip_qualifiers(F.col("identifier")))).alias("x")).agg(F.lit("all").alias("rows"), F.count("*").alias("n"), F.countDistinct("x").alias("n_ids"))
    return one.unionByName(every)


@query("c6_overlap_join", sql(" SELECT r.type, p.type AS r_type, count(*)::BIGINT AS n FROM r JOIN p ON r.passage_id = p.passage_id AND r.s < p.e AND p.s < r.e GROUP BY 1, 2"))
def c6(spark, d):
    return spans.interval_join(ref(spark, d), pred(spark, d)).groupBy("type", "r_type").agg(F.count("*").alias("n"))


@query("c6_bucketed_overlap", sql(" SELECT r.type, count(*)::BIGINT AS n FROM r JOIN p ON r.passage_id = p.passage_id AND r.type = p.type AND r.s < p.e AND p.s < r.e GROUP BY 1"))
def c6b(spark, d):
    return spans.bucketed_interval_join(ref(spark, d), pred(spark, d), same_type=True).groupBy("type").agg(F.count("*").alias("n"))


@query("c7_self_overlap", sql(" SELECT a.type, b.type AS r_type, count(*)::BIGINT AS n FROM p a JOIN p b ON a.passage_id = b.passage_id AND a.pos < b.pos AND a.s < b.e AND b.s < a.e GROUP BY 1, 2"))
def c7(spark, d):
    return spans.pairs_within(pred(spark, d), "pos").groupBy("type", "r_type").agg(F.count("*").alias("n"))


@query("c8_enclosing", sql(" SELECT p.lang, count(*)::BIGINT AS n FROM p JOIN r ON p.passage_id = r.passage_id AND p.s <= r.s AND p.e >= r.e GROUP BY 1"))
def c8(spark, d):
    return spans.interval_join(pred(spark, d), ref(spark, d), mode="encloses").groupBy("lang").agg(F.count("*").alias("n"))


@query("c9_touching", sql(" SELECT p.lang, count(*)::BIGINT AS n FROM p JOIN r ON p.passage_id = r.passage_id AND p.s <= r.e AND r.s <= p.e GROUP BY 1"))
def c9(spark, d):
    return spans.interval_join(pred(spark, d), ref(spark, d), mode="touch").groupBy("lang").agg(F.count("*").alias("n"))


TOKS = "t AS (SELECT doc_id AS passage_id, pos, s, e FROM w WHERE length(tok) > 0)"
EITHER = "((t.s <= p.s AND t.e >= p.e) OR (p.s <= t.s AND p.e >= t.e))"


def _tokens(spark, d):
    return words(spark, d).where(F.length("tok") > 0).select(F.col("doc_id").alias("passage_id"), "pos", "start", "end")


@query("c10_token_containment", sql(f", {TOKS} SELECT p.type, count(*)::BIGINT AS n FROM t JOIN p ON t.passage_id = p.passage_id AND {EITHER} GROUP BY 1"))
def c10(spark, d):
    return spans.interval_join(pred(spark, d), _tokens(spark, d), mode="either").groupBy("type").agg(F.count("*").alias("n"))


PARTS = "q0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), q AS (SELECT doc_id, i, t, e - length(t) AS s, e FROM (SELECT *, (sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i)) - 1 AS e FROM q0))"


def _passages(spark, d):
    """Documents cut at line breaks: (doc_id, passage_idx, offset, text)."""
    lines = sequences.words_with_offsets(table(spark, d, "documents"), "text", ["doc_id"], separator="\n")
    return lines.select("doc_id", F.col("pos").alias("passage_idx"), F.col("start").alias("offset"), F.col("tok").alias("text"))


@query("c11_place_in_passages", sql(f", {PARTS} SELECT q.i AS passage_idx, count(*)::BIGINT AS n, count(*) FILTER (substr(q.t, (p.s - q.s + 1)::INT, length(p.text)) = p.text)::BIGINT AS n_same FROM (SELECT DISTINCT passage_id, s, e, type, text FROM p) p JOIN q ON q.doc_id = p.passage_id AND q.s <= p.s AND q.e >= p.e WHERE NOT EXISTS (SELECT 1 FROM q q2 WHERE q2.doc_id = q.doc_id AND q2.i < q.i AND q2.s <= p.s AND q2.e >= p.e) GROUP BY 1"))
def c11(spark, d):
    p = pred(spark, d).select(F.col("passage_id").alias("doc_id"), "start", "end", "type", F.length("text").alias("size"), "text")
    placed = sequences.place_spans(p, _passages(spark, d))
    j = placed.join(p.withColumnRenamed("text", "own").hint("merge"), ["doc_id", "start", "end", "type"])
    return j.groupBy("passage_idx").agg(F.count("*").alias("n"), F.count_if(F.expr("left(text, size)") == F.col("own")).alias("n_same"))


@query("c11_unplaced", sql(f", {PARTS} SELECT p.type, count(*)::BIGINT AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc_id = p.passage_id AND q.s <= p.s AND q.e >= p.e) GROUP BY 1"))
def c11u(spark, d):
    q = _passages(spark, d).select("doc_id", F.col("offset").alias("start"), (F.col("offset") + F.length("text")).alias("end"))
    return spans.unplaced(pred(spark, d).withColumnRenamed("passage_id", "doc_id"), q, "doc_id").groupBy("type").agg(F.count("*").alias("n"))


@query("b4_located_text", sql(" SELECT type, count(*)::BIGINT AS n, count(*) FILTER (inside)::BIGINT AS n_inside, count(*) FILTER (there = text)::BIGINT AS n_same FROM (SELECT p.type, p.text, p.e <= length(d.text) AS inside, substr(d.text, p.s::INT + 1, (p.e - p.s)::INT) AS there FROM p JOIN documents d ON d.doc_id = p.passage_id) GROUP BY 1"))
def b4(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), F.col("text").alias("whole"))
    loc = F.array(F.struct(F.col("start").cast("int").alias("offset"), (F.col("end") - F.col("start")).cast("int").alias("length")))
    j = pred(spark, d).join(docs, "passage_id").withColumn("locations", loc)
    return j.groupBy("type").agg(F.count("*").alias("n"), F.count_if(spans.in_bounds(F.col("locations"), F.lit(0), F.col("whole"))).alias("n_inside"), F.count_if(spans.located_text(F.col("locations"), F.lit(0), F.col("whole")) == F.col("text")).alias("n_same"))


@query("c4_b28_semi", sql(" SELECT type, count(*)::BIGINT AS n FROM p WHERE passage_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1"))
def c4(spark, d):
    return filters.in_documents(pred(spark, d), table(spark, d, "labels").where("quality = 1").select("doc_id")).groupBy("type").agg(F.count("*").alias("n"))


@query("b2_b5_filters", sql(" SELECT type, count(*)::BIGINT AS n FROM r WHERE type IN ('cell_phenotype', 'cell_hetero') AND lower(text) NOT IN ('the', 'of', 'and') GROUP BY 1"))
def b2(spark, d):
    return filters.not_blacklisted(filters.of_types(ref(spark, d), list(TYPES[:2])), ["the", "of", "and"]).groupBy("type").agg(F.count("*").alias("n"))


@query("d15_any_overlap", sql(", x AS (SELECT (SELECT count(*) FROM r WHERE EXISTS (SELECT 1 FROM p WHERE p.passage_id = r.passage_id AND p.type = r.type AND r.s < p.e AND p.s < r.e)) AS tp_ref, (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM r WHERE p.passage_id = r.passage_id AND p.type = r.type AND r.s < p.e AND p.s < r.e)) AS tp_pred, (SELECT count(*) FROM r) AS n_ref, (SELECT count(*) FROM p) AS n_pred) SELECT *, tp_pred / n_pred AS precision, tp_ref / n_ref AS recall, 2.0 * (tp_pred / n_pred) * (tp_ref / n_ref) / (tp_pred / n_pred + tp_ref / n_ref) AS f1 FROM x"))
def d15(spark, d):
    return scoring.any_overlap(ref(spark, d), pred(spark, d))


def _located(s):
    return s.withColumn("locations", F.array(F.struct(F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"))))


# Words of one text are disjoint, and so are predictions, five words apart: edges lie along a line, where taking each edge whose ends
# both come after the last taken ones, in order of the earlier end, is optimal.
WALK = """
, e AS (SELECT {g} r.passage_id, r.type, r.s AS rs, p.s AS ps, row_number() OVER (PARTITION BY {k} r.passage_id, r.type ORDER BY p.s, r.s) AS i FROM r JOIN p ON r.passage_id = p.passage_id AND r.type = p.type AND r.s < p.e AND p.s < r.e),
walk AS (SELECT {n} passage_id, type, i, rs AS lr, ps AS lp, 1 AS tp FROM e WHERE i = 1 UNION ALL
  SELECT {m} w.passage_id, w.type, e.i, CASE WHEN e.rs > w.lr AND e.ps > w.lp THEN e.rs ELSE w.lr END, CASE WHEN e.rs > w.lr AND e.ps > w.lp THEN e.ps ELSE w.lp END, w.tp + (e.rs > w.lr AND e.ps > w.lp)::INT
  FROM walk w JOIN e ON e.passage_id = w.passage_id AND e.type = w.type AND e.i = w.i + 1),
best AS (SELECT {n} passage_id, type, max(tp) AS tp FROM walk GROUP BY ALL)"""
MATCHING = sql(WALK.format(g="", k="", n="", m="") + f", c AS (SELECT (SELECT sum(tp) FROM best)::BIGINT AS tp, (SELECT count(*) FROM p) AS n_p, (SELECT count(*) FROM r) AS n_r), d AS (SELECT tp, n_p - tp AS fp, n_r - tp AS fn FROM c) SELECT tp, fp, fn, {PRF} FROM d").replace("WITH ", "WITH RECURSIVE ", 1)


@query("d14_optimal_matching", MATCHING)
def d14(spark, d):
    return scoring.optimal(_located(ref(spark, d)), _located(pred(spark, d)))


@query("d16_greedy_matching", MATCHING)
def d16(spark, d):
    return scoring.greedy(ref(spark, d), pred(spark, d))


@query("g16_approx_matrix", sql(WALK.format(g="r.lang, r.source,", k="", n="lang, source,", m="w.lang, w.source,") + f", c AS (SELECT lang, source, sum(tp)::BIGINT AS tp, sum(n_p)::BIGINT AS n_p, sum(n_r)::BIGINT AS n_r FROM (SELECT lang, source, tp, 0 AS n_p, 0 AS n_r FROM best UNION ALL SELECT lang, source, 0, 1, 0 FROM p UNION ALL SELECT lang, source, 0, 0, 1 FROM r) GROUP BY 1, 2), d AS (SELECT lang, source, tp, n_p - tp AS fp, n_r - tp AS fn FROM c) SELECT lang, source, tp, fp, fn, {PRF} FROM d").replace("WITH ", "WITH RECURSIVE ", 1))
def g16a(spark, d):
    """The approximate half of the matrix."""
    return scoring.approx_matrix(_located(ref(spark, d)), _located(pred(spark, d)), ["lang", "source"])


@query("d17_token_overlap", sql("""
, j AS (SELECT r.text, p.text AS t2, greatest(r.s, p.s) AS lo, least(r.e, p.e) AS hi, r.s AS rs, p.s AS ps FROM r JOIN p ON r.passage_id = p.passage_id AND r.type = p.type AND r.s < p.e AND p.s < r.e),
n(t, c) AS (SELECT 'r', count(*) FROM r UNION ALL SELECT 'p', count(*) FROM p),
wc AS (SELECT len(list_filter(regexp_split_to_array(substr(text, (lo - rs + 1)::INT, (hi - lo)::INT), '\\s+'), lambda x: x <> '')) / len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS a, len(list_filter(regexp_split_to_array(substr(t2, (lo - ps + 1)::INT, (hi - lo)::INT), '\\s+'), lambda x: x <> '')) / len(list_filter(regexp_split_to_array(t2, '\\s+'), lambda x: x <> '')) AS b FROM j)
SELECT ((SELECT sum(a) FROM wc) / (SELECT c FROM n WHERE t = 'r') + (SELECT sum(b) FROM wc) / (SELECT c FROM n WHERE t = 'p')) / 2 AS overlap""".replace("\\\\", "\\")))
def d17(spark, d):
    """D17. Spans of white space only don't occur in the derivation."""
    clean = lambda s: s.where(F.trim("text") != "")
    return scoring.token_overlap(clean(ref(spark, d)), clean(pred(spark, d)))


@query("d19_annotator_pairs", sql(", x AS (SELECT passage_id, type, s, e, text, 'a' AS ann FROM r UNION SELECT passage_id, type, s, e, text, 'b' FROM p UNION SELECT passage_id, type, s, e, text, 'c' FROM r WHERE pos % 2 = 0), k AS (SELECT passage_id, type, s, e, text, list(ann) AS who FROM x GROUP BY 1, 2, 3, 4, 5), c AS (SELECT q.a, q.b, count(*) FILTER (list_contains(who, q.a) AND list_contains(who, q.b))::BIGINT AS tp, count(*) FILTER (NOT list_contains(who, q.a) AND list_contains(who, q.b))::BIGINT AS fp, count(*) FILTER (list_contains(who, q.a) AND NOT list_contains(who, q.b))::BIGINT AS fn FROM k, (VALUES ('a', 'b'), ('a', 'c'), ('b', 'c')) q(a, b) GROUP BY 1, 2) " + f"SELECT a, b, tp, fp, fn, {PRF} FROM c"))
def d19(spark, d):
    r, p = ref(spark, d), pred(spark, d)
    x = r.select(*KEYS).withColumn("annotator", F.lit("a")).unionByName(p.select(*KEYS).withColumn("annotator", F.lit("b"))).unionByName(r.where("pos % 2 = 0").select(*KEYS).withColumn("annotator", F.lit("c")))
    return scoring.annotator_pairs(x, KEYS)


@query("d19_weighted_average", sql(STRICT.format(g=", lang") + f", c AS (SELECT lang, {COUNTS}, sum(a) AS weight FROM m GROUP BY 1), f AS (SELECT weight, {PRF} FROM c) SELECT sum(f1 * weight) / sum(weight) AS weighted, avg(f1) AS unweighted FROM f"))
def d19w(spark, d):
    s = scoring.score_matrix(ref(spark, d), pred(spark, d), KEYS, ["lang"]).withColumn("weight", F.col("tp") + F.col("fn"))
    return s.agg(G.weighted_average(s, "f1", "weight").alias("weighted"), F.avg("f1").alias("unweighted"))


@query("c18_pairs", "WITH v AS (SELECT DISTINCT source FROM documents) SELECT a.source AS a, b.source AS b FROM v a JOIN v b ON a.source < b.source")
def c18(spark, d):
    return joins.unordered_pairs(table(spark, d, "documents"), "source")


@query("c17_verify_sets", "SELECT doc_id AS doc, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 0 END::INT AS at, CASE WHEN doc_id % 7 = 0 THEN 'missing document' ELSE 'text differs' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def c17(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), F.lit(0).alias("offset"), "text")
    other = docs.where("passage_id % 7 <> 0").withColumn("text", F.when(F.col("passage_id") % 11 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return joins.verify_sets(docs, other)



@query("f1_bio_encode", sql(f", {TOKS}, h AS (SELECT t.passage_id, t.pos, p.pos AS o, CASE WHEN row_number() OVER (PARTITION BY p.passage_id, p.pos ORDER BY t.pos) = 1 THEN 'B-' ELSE 'I-' END || p.type AS label FROM t JOIN p ON t.passage_id = p.passage_id AND {EITHER}), l AS (SELECT passage_id, pos, max_by(label, o) AS label FROM h GROUP BY 1, 2) SELECT coalesce(label, 'O') AS label, count(*)::BIGINT AS n FROM t LEFT JOIN l USING (passage_id, pos) GROUP BY 1"))
def f1(spark, d):
    a = pred(spark, d).select("passage_id", F.col("pos").alias("ann_idx"), "type", "start", "end")
    return sequences.bio_encode(_tokens(spark, d), a).groupBy("label").agg(F.count("*").alias("n"))


LABELS = "CASE pos % 7 WHEN 0 THEN 'B-A' WHEN 1 THEN 'I-A' WHEN 2 THEN 'I-B' WHEN 3 THEN 'O' WHEN 4 THEN 'I-A' WHEN 5 THEN 'B-B' ELSE 'I-B' END"


def _label(pos):
    """``LABELS`` of a position."""
    return F.get(F.array(*(F.lit(x) for x in ("B-A", "I-A", "I-B", "O", "I-A", "B-B", "I-B"))), pos % 7)


def _labelled(spark, d):
    return words(spark, d).select("doc_id", "pos", "start", "end", _label(F.col("pos")).alias("label"))


def _label_array(other=False):
    """The labels of a text's words; ``other`` ones are O at every eleventh place."""
    at = lambda i: F.when(i % 11 == 0, "O").otherwise(_label(i)) if other else _label(i)
    return F.transform(F.split("text", " "), lambda x, i: at(i))


DECODE = f", l AS (SELECT doc_id, pos, s, e, {LABELS} AS label FROM w), g AS (SELECT *, left(label, 1) AS pr, nullif(substr(label, 3), '') AS ty, lag(label) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l), k AS (SELECT *, sum(CASE WHEN pr <> 'O' AND (pr = 'B' OR prev IS NULL OR prev = 'O' OR substr(prev, 3) <> ty) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM g), sp AS (SELECT doc_id, grp, min(ty) AS type, min(pos)::INT AS first, max(pos)::INT AS last, count(*)::BIGINT AS n FROM k WHERE pr <> 'O' GROUP BY 1, 2)"


@query("f8_bio_decode", sql(DECODE + " SELECT type, n, count(*)::BIGINT AS spans, sum(first)::BIGINT AS s1, sum(last)::BIGINT AS s2 FROM sp GROUP BY 1, 2"))
def f8(spark, d):
    s = sequences.bio_decode(_labelled(spark, d), ["doc_id"])
    return s.groupBy("type", "n").agg(F.count("*").alias("spans"), F.sum("first").alias("s1"), F.sum("last").alias("s2"))


@query("f8_bio_decode_arrays", sql(DECODE + " SELECT type, count(*)::BIGINT AS spans, sum(first)::BIGINT AS s1, sum(last)::BIGINT AS s2 FROM sp GROUP BY 1"))
def f8a(spark, d):
    # a label is made where its word is: sequences stay whole and are not shuffled
    arr = table(spark, d, "documents").select("doc_id", _label_array().alias("labels"))
    s = arr.select(F.explode(sequences.bio_decode_array(F.col("labels"))).alias("x")).select("x.*")
    return s.groupBy("type").agg(F.count("*").alias("spans"), F.sum("first").alias("s1"), F.sum("last").alias("s2"))


@query("f2_chunks", "SELECT c::INT AS chunk, len::INT AS size, count(*)::BIGINT AS n FROM (SELECT c, least(96, greatest(0, t - c * 96)) AS len FROM (SELECT len(string_split(text, ' ')) AS t, unnest(generate_series(0, greatest(1, ceil(len(string_split(text, ' ')) / 96))::INT - 1)) AS c FROM documents)) GROUP BY 1, 2")
def f2(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    return sequences.chunks(t, ["tokens"], ["doc_id"]).select("chunk", F.size("tokens").alias("size")).groupBy("chunk", "size").agg(F.count("*").alias("n"))


@query("f2_running_ids", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id FROM documents")
def f2n(spark, d):
    return sequences.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "id")


@query("f4_mismatches", sql(" SELECT count(*)::BIGINT AS n, count(*) FILTER (substr(d.text, p.s::INT + 1, (p.e - p.s)::INT) <> p.text)::BIGINT AS n_mismatch, count(*) FILTER (p.text LIKE '% %')::BIGINT AS n_space FROM p JOIN documents d ON d.doc_id = p.passage_id"))
def f4(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), F.lit(0).alias("offset"), "text")
    a = pred(spark, d).select("passage_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text")
    return sequences.mismatches(a, docs)


@query("f5_generative_rows", sql(" SELECT passage_id, count(*)::BIGINT AS n, md5(string_agg(text, '|' ORDER BY s, e, text)) AS digest FROM r GROUP BY 1"))
def f5(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    g = sequences.generative_rows(docs, ref(spark, d)).where(F.size("output") > 0)
    return g.select("passage_id", F.size("output").cast("bigint").alias("n"), F.md5(F.array_join("output", "|")).alias("digest"))


@query("f7_greedy_longest", sql(""", o AS (SELECT passage_id, list([{'s': s::BIGINT, 'e': e::BIGINT}] ORDER BY e - s DESC, pos) AS l FROM p GROUP BY 1),
k AS (SELECT passage_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s <= x[1].e AND x[1].s <= y.e)) > 0 THEN a ELSE list_concat(a, x) END)) AS x FROM o)
SELECT passage_id, x.s AS start, x.e AS "end" FROM k"""))
def f7(spark, d):
    s = pred(spark, d).groupBy("passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "start", "end"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("s"))
    return s.select("passage_id", F.explode(spans.greedy_longest(F.col("s"))).alias("x")).select("passage_id", "x.*")


OTHER = f"CASE WHEN pos % 11 = 0 THEN 'O' ELSE {LABELS} END"
SPANS = "{x}0 AS (SELECT doc_id, pos, {l} AS label FROM w), {x}1 AS (SELECT *, left(label, 1) AS pr, nullif(substr(label, 3), '') AS ty, lag(label) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM {x}0), {x}2 AS (SELECT *, sum(CASE WHEN pr <> 'O' AND (pr = 'B' OR prev IS NULL OR prev = 'O' OR substr(prev, 3) <> ty) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM {x}1), {x} AS (SELECT doc_id, min(ty) AS type, min(pos) AS first, max(pos) AS last FROM {x}2 WHERE pr <> 'O' GROUP BY doc_id, grp)"


@query("d29_sequence_scores", sql(", " + SPANS.format(x="gs", l=LABELS) + ", " + SPANS.format(x="os", l=OTHER) + f", m AS (SELECT doc_id, type, first, last, max(a) AS a, max(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM gs UNION ALL SELECT *, 0, 1 FROM os) GROUP BY 1, 2, 3, 4), c AS (SELECT coalesce(type, 'Total') AS type, {COUNTS} FROM m GROUP BY ROLLUP (type)) SELECT type, tp, fp, fn, {PRF}, (SELECT avg((({LABELS}) = ({OTHER}))::INT) FROM w) AS accuracy FROM c"))
def d29(spark, d):
    arr = table(spark, d, "documents").select("doc_id", _label_array().alias("g"), _label_array(other=True).alias("p"))
    return sequences.sequence_scores(arr, "g", "p", "doc_id")


@query("f10_f11_align", sql(" SELECT sum(CASE WHEN pos % 2 = 0 THEN length(tok) ELSE 0 END)::BIGINT AS kept, count(*) FILTER (pos % 2 = 0)::BIGINT AS n_kept FROM w"))
def f10(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("tok"))
    # every even token is the first piece of its word, every odd one its second
    t = t.withColumn("labels", F.transform(F.filter("tok", lambda x, i: i % 2 == 0), lambda x: F.length(x))).withColumn("word_ids", F.transform("tok", lambda x, i: F.floor(i / 2).cast("int")))
    aligned = t.withColumn("a", sequences.align_labels(F.col("word_ids"), F.col("labels")))
    kept = aligned.select(F.explode(sequences.without_ignored(F.col("word_ids"), F.col("a"))).alias("x"))
    return kept.agg(F.sum("x.l").cast("bigint").alias("kept"), F.count("*").alias("n_kept"))


@query("d22_at_k", sql("""
, g AS (SELECT DISTINCT passage_id, type, text AS id FROM r WHERE type <> 'cell_vague'),
k AS (SELECT passage_id, type, (pos // 30) AS mention, text AS id, pos AS rank FROM p),
b AS (SELECT passage_id, type, id, min(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY passage_id, type, mention ORDER BY rank) AS n FROM k WHERE lower(id) NOT IN ('', '-', 'none')) GROUP BY 1, 2, 3),
f AS (SELECT b.n, g.id IS NOT NULL AS hit, b.id IS NOT NULL AS pr FROM b FULL JOIN g ON b.passage_id = g.passage_id AND b.type = g.type AND b.id = g.id),
c AS (SELECT k, count(*) FILTER (n <= k AND hit AND pr) AS tp, count(*) FILTER (n <= k) AS n_pred, count(*) FILTER (hit) AS n_gold FROM f, (VALUES (1), (5), (10)) v(k) GROUP BY 1)
SELECT k, tp, n_pred, n_gold, CASE WHEN tp = 0 THEN 0.0 ELSE tp / n_pred END AS precision, CASE WHEN tp = 0 THEN 0.0 ELSE tp / n_gold END AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold) END AS f1 FROM c"""))
def d22(spark, d):
    gold = ref(spark, d).where("type <> 'cell_vague'").select("passage_id", "type", F.col("text").alias("id"))
    ranked = pred(spark, d).select("passage_id", "type", F.floor(F.col("pos") / 30).alias("mention"), F.col("text").alias("id"), F.col("pos").alias("rank"))
    return scoring.at_k(gold, ranked)


VALID = """
, g AS (SELECT *, row_number() OVER (PARTITION BY passage_id, s, e, text, identifier, type ORDER BY pos) AS dup FROM p),
pt AS (SELECT g.passage_id, g.pos, unnest(CASE WHEN identifier = 'None' THEN [] ELSE list_filter(string_split(identifier, ';'), lambda x: NOT (x = '-' AND identifier LIKE '%;%')) END) AS part FROM g),
pq AS (SELECT *, CASE WHEN part LIKE '%)%' THEN left(part, strpos(part, ')')::INT) END AS q, string_split(CASE WHEN part LIKE '%)%' THEN substr(part, strpos(part, ')')::INT + 1) ELSE part END, ',') AS ids FROM pt),
z AS (SELECT g.*, e <= length(d.text) AS inside, substr(d.text, s::INT + 1, (e - s)::INT) = g.text AS same, substr(d.text, s::INT + 1, (e - s)::INT) AS there FROM g JOIN documents d ON d.doc_id = g.passage_id),
pr AS (SELECT a.text AS t1, b.text AS t2, a.type = 'cell_vague' AS v1, b.type = 'cell_vague' AS v2, (a.s < b.e AND b.s < a.e) AS meet, ((a.s <= b.s AND a.e >= b.e) OR (b.s <= a.s AND b.e >= a.e)) AS whole FROM z a JOIN z b ON a.passage_id = b.passage_id AND a.pos < b.pos WHERE a.inside AND a.same),
al AS (
SELECT 'H6: duplicate annotation' AS general FROM g WHERE dup > 1
UNION ALL SELECT 'H9: part has no exact or related qualifier' FROM pq WHERE q IS NULL OR q NOT IN ('(skos:exact)', '(skos:related)')
UNION ALL SELECT 'H10: several ids without related' FROM pq WHERE len(ids) > 1 AND q IS DISTINCT FROM '(skos:related)'
UNION ALL SELECT 'H11: id is not in the ontology' FROM (SELECT unnest(ids) AS id FROM pq) WHERE id NOT IN (SELECT 'CL:' || i FROM range(0, 40) t(i))
UNION ALL SELECT 'H12: vague annotation with an identifier' FROM g WHERE type = 'cell_vague' AND identifier <> 'None'
UNION ALL SELECT 'H14: span outside of the passage' FROM z WHERE NOT inside
UNION ALL SELECT 'H15: text differs from the passage' FROM z WHERE inside AND NOT same
UNION ALL SELECT 'H16: overlap' FROM pr WHERE meet AND v1 = v2
UNION ALL SELECT 'H17: partial overlap of vague and other' FROM pr WHERE meet AND v1 <> v2 AND NOT whole
UNION ALL SELECT 'H18: the vague annotation is the inner one' FROM pr WHERE meet AND v1 <> v2 AND whole AND least(length(t1), length(t2)) >= length(CASE WHEN v1 THEN t1 ELSE t2 END)
UNION ALL SELECT 'H19: vague and other with the same text' FROM pr WHERE v1 <> v2 AND t1 = t2)
SELECT CASE WHEN general LIKE 'H19%' THEN 'WARNING' ELSE 'ERROR' END AS severity, general, count(*)::BIGINT AS n FROM al GROUP BY 1, 2"""


@query("h_validation", sql(VALID))
def h(spark, d):
    docs = table(spark, d, "documents")
    pas = docs.select(F.lit("documents").alias("file"), F.col("doc_id").cast("string").alias("passage_uid"), F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("passage_id"), F.col("doc_id").cast("string").alias("pmid"), F.lit(None).cast("string").alias("pmc"), F.lit(0).alias("offset"), "text")
    anns = pred(spark, d).select(F.col("passage_id").cast("string").alias("passage_uid"), F.col("pos").alias("ann_idx"), "type", "identifier", "text", F.array(F.struct(F.col("start").cast("int").alias("offset"), (F.col("end") - F.col("start")).cast("int").alias("length"))).alias("locations"))
    onto = spark.range(40).select(F.concat(F.lit("CL:"), F.col("id").cast("string")).alias("id"))
    return validation.validate(pas, anns, onto).groupBy("severity", "general").agg(F.count("*").alias("n"))


@query("h_all_rules", """WITH k AS (SELECT doc_id, doc_id % 20 AS c FROM documents),
x(c, general, severity) AS (VALUES (0, 'H2: passage has no passage_id', 'ERROR'), (1, 'H3: passage has no pmid', 'ERROR'), (2, 'H4: passage_id does not start with the pmid', 'ERROR'), (3, 'H5: pmid and pmc do not match the document ids', 'ERROR'),
(4, 'H6: duplicate annotation', 'ERROR'), (4, 'H16: overlap', 'ERROR'), (5, 'H7: annotation has no type', 'ERROR'), (6, 'H7: unknown type', 'ERROR'), (7, 'H8: annotation has no identifier', 'ERROR'), (8, 'H9: part has no exact or related qualifier', 'ERROR'), (9, 'H10: several ids without related', 'ERROR'),
(10, 'H11: id is not in the ontology', 'ERROR'), (11, 'H12: vague annotation with an identifier', 'ERROR'), (12, 'H13: not exactly one location', 'ERROR'), (13, 'H13: not exactly one location', 'ERROR'), (14, 'H14: span outside of the passage', 'ERROR'), (15, 'H15: text differs from the passage', 'ERROR'), (16, 'H16: overlap', 'ERROR'),
(17, 'H17: partial overlap of vague and other', 'ERROR'), (18, 'H18: the vague annotation is the inner one', 'ERROR'), (19, 'H18: the vague annotation is the inner one', 'ERROR'), (19, 'H19: vague and other with the same text', 'WARNING'))
SELECT severity, general, count(*)::BIGINT AS n FROM k JOIN x USING (c) GROUP BY 1, 2 UNION ALL SELECT 'WARNING', 'not an XML file', count(*)::BIGINT FROM documents WHERE doc_id % 20 = 0""")
def h_all(spark, d):
    """Each document becomes a passage that breaks one rule, by the last digits of its id: every rule H1-H19 answers."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 20).alias("c"))
    c, pmid, text = F.col("c"), F.col("doc_id").cast("string"), "abcdefghijklmnopqrst"
    pas = docs.select(
        F.lit("f.xml").alias("file"), pmid.alias("passage_uid"), F.when(c == 0, None).when(c == 2, F.concat(F.lit("x"), pmid)).otherwise(F.concat(pmid, F.lit("_1"))).alias("passage_id"),
        F.when(c == 1, None).otherwise(pmid).alias("pmid"), F.when(c == 3, "PMC0").otherwise(F.concat(F.lit("PMC"), pmid)).alias("pmc"), F.lit(7).alias("offset"), F.lit(text).alias("text"),
    )
    good = ("cell_phenotype", "(skos:exact)CL:1")
    at = lambda s, e: ((7 + s, e - s),)
    cases = {
        4: [(*good, text[0:3], at(0, 3)), (*good, text[0:3], at(0, 3))], 5: [(None, good[1], text[0:3], at(0, 3))], 6: [("odd", good[1], text[0:3], at(0, 3))], 7: [(good[0], None, text[0:3], at(0, 3))],
        8: [(good[0], "CL:1", text[0:3], at(0, 3))], 9: [(good[0], "(skos:exact)CL:1,CL:2", text[0:3], at(0, 3))], 10: [(good[0], "(skos:exact)CL:77", text[0:3], at(0, 3))], 11: [("cell_vague", "(skos:exact)CL:1", text[0:3], at(0, 3))],
        12: [(*good, text[0:3], ())], 13: [(*good, text[0:3], at(0, 3) + at(5, 6))], 14: [(*good, text[18:] + "zz", at(18, 22))], 15: [(*good, "zzz", at(0, 3))], 16: [(*good, text[0:5], at(0, 5)), (*good, text[3:8], at(3, 8))],
        17: [("cell_vague", "None", text[0:5], at(0, 5)), (*good, text[3:8], at(3, 8))], 18: [(*good, text[0:9], at(0, 9)), ("cell_vague", "None", text[2:5], at(2, 5))], 19: [("cell_vague", "None", text[0:5], at(0, 5)), (*good, text[0:5], at(0, 5))],
    }
    kinds = "c int, ann_idx int, type string, identifier string, text string, locations array<struct<offset:int,length:int>>"
    table_ = spark.createDataFrame([(k, i, *x[:3], list(x[3])) for k, v in cases.items() for i, x in enumerate(v)], kinds)
    anns = docs.select(pmid.alias("passage_uid"), "c").join(F.broadcast(table_), "c").drop("c")
    onto = spark.createDataFrame([("CL:1",), ("CL:2",)], "id string")
    known = docs.select(pmid.alias("pmid"), F.concat(F.lit("PMC"), pmid).alias("pmc"))
    files = docs.select(F.when(c == 0, F.concat(pmid, F.lit(".txt"))).otherwise(F.concat(pmid, F.lit(".XML"))).alias("path"))
    errors = validation.validate(pas, anns, onto, known).unionByName(validation.file_warnings(files))
    return errors.groupBy("severity", "general").agg(F.count("*").alias("n"))


@query("f3_unchunked", "SELECT len(string_split(text, ' '))::INT AS size, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def f3(spark, d):
    """the export without chunks: sequences stay whole, with running ids."""
    t = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    return sequences.numbered(t, ["doc_id"]).select(F.size("tokens").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("f6_place_mentions", sql(", m AS (SELECT DISTINCT passage_id, text FROM p WHERE length(text) >= 4 AND pos % 20 = 0 AND regexp_full_match(text, '[a-z]+')), h AS (SELECT m.passage_id, w.s, w.e, w.tok AS text FROM m JOIN w ON w.doc_id = m.passage_id AND w.tok = m.text) SELECT passage_id, count(*)::BIGINT AS n, sum(s)::BIGINT AS s, sum(e)::BIGINT AS e FROM h GROUP BY 1"))
def f6(spark, d):
    """F6 where mentions are lower-case words: every place of each word of its text, found anew, none touching another."""
    from ..operators.spans import place_mentions

    plain = F.transform(F.split("text", " "), lambda x: F.when(x.rlike("^[a-z]+$"), x).otherwise(F.translate(F.regexp_replace(x, ".", "#"), " ", "#")))
    w = table(spark, d, "documents").select("doc_id", F.array_join(plain, " ").alias("text"))
    docs = w.select(F.col("doc_id").alias("passage_id"), F.lit(0).alias("offset"), "text")
    m = pred(spark, d).where("length(text) >= 4 and pos % 20 = 0 and text rlike '^[a-z]+$'").select("passage_id", F.col("text").alias("mention"), "type").groupBy("passage_id", "mention").agg(F.min("type").alias("type")).withColumn("ord", F.lit(0))
    return place_mentions(docs, m).groupBy("passage_id").agg(F.count("*").alias("n"), F.sum("start").alias("s"), F.sum("end").alias("e"))
