"""Hand-checked cases and properties of the operators."""

from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import aggregates as G
from spanloom.operators import filters, joins, linking, scoring, sequences, spans, validation

SPAN = "passage_id string, type string, start int, end int"


def span_rows(spark, rows):
    return spark.createDataFrame([("p", t, s, e) for t, s, e in rows], SPAN).withColumn("text", F.lit("x")).withColumn("locations", F.array(F.struct(F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"))))


def test_three_matchings(spark):
    ref, pred = span_rows(spark, [("A", 0, 5), ("A", 4, 9)]), span_rows(spark, [("A", 3, 6)])
    assert scoring.strict(ref, pred, ["passage_id", "type", "start", "end"], by=None).first()["f1"] == 0
    best = scoring.optimal(ref, pred).first()
    assert (best["tp"], best["fp"], best["fn"]) == (1, 0, 1) and abs(best["f1"] - 2 / 3) < 1e-12
    loose = scoring.any_overlap(ref, pred).first()
    assert (loose["precision"], loose["recall"], loose["f1"]) == (1, 1, 1)


def test_optimal_beats_greedy(spark):
    ref, pred = span_rows(spark, [("A", 0, 10), ("A", 0, 3)]), span_rows(spark, [("A", 0, 2), ("A", 8, 9)])
    assert scoring.optimal(ref, pred).first()["tp"] == 2
    assert scoring.optimal(ref, pred.withColumn("type", F.lit("B"))).first()["tp"] == 0
    assert scoring.optimal(ref, pred.withColumn("type", F.lit("B")), pool=True).first()["tp"] == 2
    assert scoring.optimal(ref.limit(0), pred).first()["fp"] == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=4, unique=True), max_size=5))
def test_matching_is_maximum(edges):
    pairs = [(u, v) for u, vs in enumerate(edges) for v in vs]
    best = max((k for k in range(len(edges) + 1) for c in combinations(pairs, k) if len({u for u, _ in c}) == len({v for _, v in c}) == k), default=0)
    assert scoring.maximum_matching(edges, 5) == best


def test_roc(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.3), (0, 0.1)], "y int, s double")
    assert abs(scoring.auc(df, "y", "s").first()["auc"] - 0.75) < 1e-12
    assert abs(scoring.auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"] - 0.25) < 1e-12


def test_histogram_and_growth(spark):
    h = {r["bin"] for r in G.histogram(spark.createDataFrame([(1.0,), (0.05,)], "v double"), "v").collect()}
    assert h == {20, 2}
    rows = [(d, k) for d, ks in (("d1", "ab"), ("d2", "a"), ("d3", "bc")) for k in ks]
    got = [r["cumulative"] for r in G.cumulative_distinct(spark.createDataFrame(rows, "d string, k string"), "d", ["k"]).orderBy("d").collect()]
    assert got == [2, 2, 3]


def test_greedy_spans(spark):
    df = spark.createDataFrame([([(0, 3), (2, 9), (9, 12)],), ([(0, 2), (5, 9), (3, 4)],), ([],)], "s array<struct<start:int,end:int>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(spans.greedy_longest(F.col("s"))).collect()]
    assert got == [[(2, 9)], [(5, 9), (0, 2), (3, 4)], []]


def test_greedy_spans_are_not_quadratic(spark):
    import time

    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct((i * 3).alias("start"), (i * 3 + 1).alias("end"))).alias("s"))
    began = time.time()
    assert df.select(F.size(spans.greedy_longest(F.col("s")))).first()[0] == 100_000 and time.time() - began < 60  # 5 billion tests if each asks all before
    assert spark.sql("SELECT cast(null AS array<struct<start:int,end:int>>) AS s").select(spans.greedy_longest(F.col("s"))).first()[0] is None


def test_word_index_hits_as_phrase_hits(spark):
    from spanloom.functions.text import phrase_hits

    texts = ["a-b a a-b_a\u00a0a", "b,b,b b", "", "x \u0130b (a) a", "aa a aa", "- a -", ", , ,"]
    phrases = ["a", "b", "a-b", "a a", "-", "b,b", ", ,", "aa", "(a)", "\u0130b"]
    df = spark.createDataFrame([(t, p) for t in texts for p in phrases], "t string, p string")
    exact = [(r["t"], r["p"], [h["start"] for h in r["h"]]) for r in df.select("t", "p", phrase_hits(F.col("t"), F.col("p")).alias("h")).collect()]
    for t, p, want in exact:
        assert (spans.WordIndex(t).hits(p) or spans.WordIndex(t.lower()).hits(p.lower())) == want, (t, p)


def test_mentions_are_placed_in_one_pass(spark):
    import time

    words = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    p = spark.range(1).select("id", F.lit(0).alias("offset"), F.array_join(words, " ").alias("text"))
    m = spark.range(1).select("id", F.explode(words).alias("mention")).withColumns({"type": F.lit("A"), "ord": F.lit(0)})
    began = time.time()
    assert spans.place_mentions(p, m, "id").count() == 20_000 and time.time() - began < 60  # each mention read all the text


def test_top_k_keeps_ties_and_is_not_broadcast(spark):
    v = spark.range(30).select("id", F.array(F.lit(1.0), F.when(F.col("id") < 25, 1.0).otherwise(2.0)).cast("array<float>").alias("vector"))
    top = linking.top_k_blocked(v.where("id = 0").withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "term_id"), k=3, block=7)
    assert [(r["rank"], r["term_id"]) for r in top.orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]
    assert "Broadcast" not in top._jdf.queryExecution().toString()
    assert linking.top_k_blocked(v.withColumnRenamed("id", "query_id"), v.limit(2).withColumnRenamed("id", "term_id"), k=3).count() == 60


def test_placed_spans_keep_texts(spark):
    p = spark.createDataFrame([("d", 0, 0, "caf\u00e9 ab"), ("d", 1, 8, "\U0001f600x y")], "doc_id string, passage_idx int, offset int, text string")
    s = spark.createDataFrame([("d", 5, 7, "A"), ("d", 5, 7, "A"), ("d", 8, 10, "B"), ("d", 6, 9, "C")], "doc_id string, start int, end int, type string")
    out = sequences.place_spans(s, p)
    assert sorted(map(tuple, out.collect())) == [("d", 0, 5, 7, "A", "ab"), ("d", 1, 8, 10, "B", "\U0001f600x")]
    assert out.columns == ["doc_id", "passage_idx", "start", "end", "type", "text"]


def test_texts_at_block_bounds(spark):
    text = "".join(chr(97 + i % 23) if i % 7 else "\u00e9" for i in range(1500))
    at = [(0, 3), (510, 4), (511, 1), (512, 512), (1023, 477), (100, 1000), (0, 1500), (1499, 1), (1000, 512), (1499, 2)]
    p = spark.createDataFrame([("f", "u", "1_0", "1", None, 7, text)], "file string, passage_uid string, passage_id string, pmid string, pmc string, offset int, text string")
    a = spark.createDataFrame([("u", i, "cell_phenotype", "None", text[s : s + n], [(s + 7, n)]) for i, (s, n) in enumerate(at)], "passage_uid string, ann_idx int, type string, identifier string, text string, locations array<struct<offset:int,length:int>>")
    found = {r["ann_idx"]: (r["inside"], r["there"]) for r in validation._narrow(a, p).collect()}
    assert found == {i: (s + n <= 1500, text[s : s + n] if s + n <= 1500 else None) for i, (s, n) in enumerate(at)}


def test_bio(spark):
    labels = ["B-A", "I-A", "O", "I-A", "I-B", "B-B"]
    toks = spark.createDataFrame([("d", i, i, i + 1, x) for i, x in enumerate(labels)], "doc_id string, pos int, start int, end int, label string")
    want = [("A", 0, 1), ("A", 3, 3), ("B", 4, 4), ("B", 5, 5)]
    assert sorted((r["type"], r["first"], r["last"]) for r in sequences.bio_decode(toks, ["doc_id"]).collect()) == want
    arr = spark.createDataFrame([(labels,)], "l array<string>").select(F.explode(sequences.bio_decode_array(F.col("l"))).alias("x")).select("x.*")
    assert sorted(tuple(r) for r in arr.collect()) == want


def test_matching_of_batches():
    import random

    import numpy as np

    rng = random.Random(5)
    for _ in range(300):
        rows, want, at = [], [], 0
        for g in range(rng.randint(1, 4)):
            n, m = rng.randint(1, 5), rng.randint(1, 5)
            many = [rng.choice((1, 1, 2)) for _ in range(n + m)]
            edges = [(a, b) for a in range(n) for b in range(m) if rng.random() < 0.5] or [(0, 0)]
            rows += [(g, at + a, at + b, many[a], many[n + b]) for a, b in edges + edges[:1]]
            copies = [(b, i) for b in range(m) for i in range(many[n + b])]
            want.append(scoring.maximum_matching([[j for j, (b, _) in enumerate(copies) if (a, b) in edges] for a in range(n) for _ in range(many[a])], len(copies)))
            at += 10
        assert scoring.matching_by_group(*(np.array(c) for c in zip(*rows)), len(want)).tolist() == want


def test_matchings_over_batch_bounds(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.range(40).select(F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("passage_id"), F.lit("A").alias("type"), (F.col("id") * 4).cast("int").alias("start"), (F.col("id") * 4 + 20).cast("int").alias("end"))
        rows = rows.unionByName(rows.limit(1)).withColumn("locations", F.array(F.struct(F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"))))
        assert tuple(scoring.optimal(rows, rows).first())[:3] == (41, 0, 0)
        assert tuple(scoring.greedy(rows, rows).first())[:3] == (40, 1, 1)
        by = scoring.approx_matrix(rows.withColumn("m", F.col("passage_id")), rows.withColumn("m", F.col("passage_id")), ["m"])
        assert sorted(r["tp"] for r in by.collect()) == [10, 10, 10, 11]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_joins_are_not_quadratic_in_a_passage(spark):
    import time

    a = spark.range(200_000).select(F.lit("p").alias("passage_id"), F.lit("A").alias("type"), (F.col("id") * 4).alias("start"), (F.col("id") * 4 + 2).alias("end"))
    b = a.select("passage_id", "type", (F.col("start") + 2).alias("start"), (F.col("end") + 1).alias("end"))
    began = time.time()
    assert spans.interval_join(a, b, mode="touch").count() == 200_000 and spans.interval_join(a, b).count() == 0
    assert spans.interval_join(a, b, mode="touch", how="left_semi").count() == 200_000 and spans.interval_join(a, b, how="left_anti").count() == 200_000
    assert spans.unplaced(a, b, "passage_id").count() == 200_000 and spans.unplaced(a, a, "passage_id").count() == 0
    assert time.time() - began < 60  # 40 billion pairs a join otherwise


@pytest.mark.parametrize("mode", ["overlap", "touch", "enclosed"])
def test_partners_match_the_join(spark, mode):
    import random

    rng = random.Random(3)
    side = lambda: spark.createDataFrame([(rng.choice("pq") if rng.random() < 0.9 else None, rng.choice("AB"), s, s + rng.randint(0, 6)) for s in (rng.randint(0, 60) for _ in range(40))], SPAN)
    a, b = side().withColumn("i", F.monotonically_increasing_id()), side()
    met = {r["i"] for r in spans.interval_join(a, b, mode=mode, same_type=True).collect()}
    got = {how: {r["i"] for r in spans.interval_join(a, b, mode=mode, same_type=True, how=how).collect()} for how in ("left_semi", "left_anti")}
    assert got["left_semi"] == met and got["left_anti"] == {r["i"] for r in a.collect()} - met


def test_bio_arrays_are_linear(spark):
    import time

    odd = [["I-A", None, "I-A"], [], None, ["B", "I", "X-A", "I-A-x", "", "O"]]
    got = [r[0] and [tuple(x) for x in r[0]] for r in spark.createDataFrame([(x,) for x in odd], "l array<string>").select(sequences.bio_decode_array(F.col("l"))).collect()]
    assert got == [[("A", 0, 0), ("A", 2, 2)], [], None, [(None, 0, 1), ("A", 2, 3), (None, 4, 4)]]
    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.lit("B-A")).alias("g")).withColumn("p", F.transform("g", lambda x, i: F.when(i % 2 == 0, x).otherwise("O")))
    began = time.time()
    rows = {r["type"]: (r["tp"], r["fp"], r["fn"], r["accuracy"]) for r in sequences.sequence_scores(df, "g", "p", "id").collect()}
    assert rows["Total"] == (100_000, 0, 100_000, 0.5) and time.time() - began < 60  # a fold that appends copies 20 billion entries


def test_words_with_offsets(spark):
    texts = ["a  b\u00e9\U0001f600 c", "", None, " ", "x", "\u4e00 " * 70, "ab " * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sequences.words_with_offsets(df.repartition(1), "t", ["id"])
    few = sorted(tuple(r) for r in got.where("id < 6").select("id", "pos", "tok", "start", "end").collect())
    want, at = [], 0
    for i, t in enumerate(texts[:6]):
        at = 0
        for pos, tok in enumerate((t or "").split(" ") if t is not None else []):
            want.append((i, pos, tok, at, at + len(tok)))
            at += len(tok) + 1
    assert few == sorted(want)
    assert tuple(got.where("id = 6 and pos = 1000000").first())[1:] == (1_000_000, "", 3_000_000, 3_000_000)
    third = sequences.words_with_offsets(df, "t", ["id"], every=3).where("id < 6")
    assert sorted(tuple(r) for r in third.select("id", "pos", "tok", "start", "end").collect()) == sorted(x for x in want if x[1] % 3 == 0)
    assert "Window" not in got._jdf.queryExecution().toString() and "Exchange" not in sequences.words_with_offsets(df, "t", ["id"])._jdf.queryExecution().toString()


def test_bio_round_trip(spark):
    toks = spark.createDataFrame([("p", i, 4 * i, 4 * i + 3) for i in range(20)], "passage_id string, pos int, start int, end int")
    anns = [(0, "A", 0, 7), (1, "B", 8, 11), (2, "A", 12, 23), (3, "A", 40, 43)]
    a = spark.createDataFrame([("p", *x) for x in anns], "passage_id string, ann_idx int, type string, start int, end int")
    back = sequences.bio_decode(sequences.bio_encode(toks, a), ["passage_id"])
    assert sorted((r["start"], r["end"], r["type"]) for r in back.collect()) == sorted((s, e, t) for _, t, s, e in anns)


def test_chunks(spark):
    df = spark.createDataFrame([(n, ["t"] * n) for n in (0, 96, 97, 192, 193)], "n int, tokens array<string>")
    got = {r["n"]: r["count"] for r in sequences.chunks(df, ["tokens"], ["n"]).groupBy("n").count().collect()}
    assert got == {0: 1, 96: 1, 97: 2, 192: 2, 193: 3}


def test_alignment(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, None], [3, 7])], "w array<int>, l array<int>")
    assert df.select(sequences.align_labels(F.col("w"), F.col("l"))).first()[0] == [-100, 3, -100, 7, -100]


def test_at_k_skips_empty(spark):
    gold = spark.createDataFrame([("p", "t", "CL:1")], "passage_id string, type string, id string")
    ranked = spark.createDataFrame([("p", "t", "m", "-", 1), ("p", "t", "m", "CL:1", 2), ("p", "t", "m", "CL:2", 3)], "passage_id string, type string, mention string, id string, rank int")
    rows = {r["k"]: r for r in scoring.at_k(gold, ranked).collect()}
    assert rows[1]["tp"] == 1 and rows[1]["n_pred"] == 1 and rows[5]["n_pred"] == 2


def test_registry(spark):
    rows = spark.createDataFrame([("d", "cell", "stem cell", 0), ("d", "MSC", "first", 1), ("d", "MSC", "second", 2)], "doc_id string, short string, long string, load_order int")
    assert [(r["short"], r["long"]) for r in linking.abbreviation_registry(rows).collect()] == [("MSC", "first")]
    freq = spark.createDataFrame([("MSC", "second", 5)], "short string, long string, freq int")
    assert [r["long"] for r in linking.abbreviation_registry(rows, freq).collect()] == ["second"]


def test_rules_fold_in_order(spark):
    a = spark.createDataFrame([("m", "A", "1"), ("n", "A", "1"), (None, "C", "None")], "text string, type string, identifier string")
    rules = [
        {"is_update": True, "mention": "m", "type": None, "identifier": None, "new_type": "B", "new_identifier": "2"},
        {"is_update": True, "mention": None, "type": "B", "identifier": "2", "new_type": "D", "new_identifier": "3"},
        {"is_update": False, "mention": None, "type": "C", "identifier": None},
    ]
    got = sorted((r["text"], r["type"], r["identifier"]) for r in filters.apply_rules(a, rules).collect())
    assert got == [("m", "D", "3"), ("n", "A", "1")]


def test_vague_rules(spark):
    text = "abcdefghijklmnopqrst"
    cases = {  # pairs of (type, start, end) and the rules that answer
        "two": ([("cell_phenotype", 0, 5), ("cell_hetero", 3, 8)], {"H16"}),
        "partial": ([("cell_vague", 0, 5), ("cell_phenotype", 3, 8)], {"H17"}),
        "fine": ([("cell_vague", 0, 10), ("cell_phenotype", 2, 5)], set()),
        "inner": ([("cell_phenotype", 0, 10), ("cell_vague", 2, 5)], {"H18"}),
        "same": ([("cell_vague", 0, 5), ("cell_phenotype", 0, 5)], {"H18", "H19"}),
    }
    pas, anns = [], []
    for k, (pair, _) in cases.items():
        pas.append(("f", k, f"{k}_1", k, None, 0, text))
        anns += [(k, i, t, "None" if t == "cell_vague" else "(skos:exact)CL:1", text[s:e], [(s, e - s)]) for i, (t, s, e) in enumerate(pair)]
    pas += [("f", "no id", None, "x", None, 0, text), ("f", "bad id", "y_1", "x", None, 0, text)]
    anns += [("two", 9, "cell_phenotype", "CL:1", "zz", [(15, 2)]), ("two", 10, "odd", "(skos:exact)CL:1,CL:9", "t", [(19, 5)]), ("two", 11, "cell_hetero", "None", "q", [])]
    p = spark.createDataFrame(pas, "file string, passage_uid string, passage_id string, pmid string, pmc string, offset int, text string")
    a = spark.createDataFrame(anns, "passage_uid string, ann_idx int, type string, identifier string, text string, locations array<struct<offset:int,length:int>>")
    out = validation.validate(p, a, spark.createDataFrame([("CL:1",)], "id string"))
    got = {}
    for r in out.collect():
        got.setdefault(r["passage_id"], set()).add(r["general"].split(":")[0])
    for k, (_, want) in cases.items():
        if k != "two":
            assert got.get(f"{k}_1", set()) == want, k
    assert got["two_1"] == {"H16", "H9", "H15", "H7", "H10", "H11", "H14", "H13"}
    assert got[None] == {"H2"} and got["y_1"] == {"H4"}


def test_bucketed_join_equals_plain(spark):
    rows = [("A" if i % 3 else "B", (i * 37) % 900, (i * 37) % 900 + i % 40 + 1) for i in range(120)]
    a, b = span_rows(spark, rows[:60]).drop("text", "locations"), span_rows(spark, rows[60:]).drop("text", "locations")
    cols = ["type", "start", "end", "r_type", "r_start", "r_end"]
    plain = sorted(tuple(r) for r in spans.interval_join(a, b).select(cols).collect())
    assert plain == sorted(tuple(r) for r in spans.bucketed_interval_join(a, b, width=16).select(cols).collect())


def test_positional_merge_checks_text(spark):
    a = spark.createDataFrame([(0, "x", ["a"]), (1, "y", ["b"])], "i int, text string, annotations array<string>")
    assert joins.positional(a, a, ["i"]).orderBy("i").first()["annotations"] == ["a", "a"]
    with pytest.raises(Exception, match="differ"):
        joins.positional(a, a.withColumn("text", F.lit("z")), ["i"]).collect()


def test_require_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    assert joins.require_keys(a, a, "k").count() == 2
    with pytest.raises(Exception, match="unknown key"):
        joins.require_keys(a, a.where("k = 1"), "k").collect()


def test_retries():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x * 2

    assert linking.with_retries(flaky, attempts=5)(4) == 8 and len(calls) == 3
    assert linking.with_retries(lambda x: 1 / 0, attempts=2, fallback="no")(1) == "no"


def test_rule_table_is_never_cut(spark):
    rules = spark.range(10_001).selectExpr("id AS rule_order", "string(id) AS mention")
    with pytest.raises(ValueError, match="more than 10000 rules"):
        filters.rule_array(rules)
    assert [r["rule_order"] for r in filters.rule_array(rules.where("rule_order > 0"))] == list(range(1, 10_001))


def test_ancestors_at_any_depth(spark):
    parents = spark.range(40).selectExpr("id", "id + 1 AS parent").unionByName(spark.createDataFrame([(90, 91), (91, 90)], "id bigint, parent bigint"))
    ref, pred = (spark.createDataFrame([(1, i)], "doc_id int, id bigint") for i in (0, 40))
    got = scoring.augmented_macro(ref, pred, parents).first()  # 0 has the ancestors 1 to 40
    assert got["precision"] == 1 and got["recall"] == pytest.approx(1 / 41)
    assert scoring.augmented_macro(ref, pred.withColumn("id", F.lit(90)), parents).first()["f1"] == 0


def test_running_ids_survive_pruned_columns(spark):
    df = spark.range(5000).selectExpr("id * 7 % 5000 AS k", "repeat('x', int(id % 50)) AS text").repartition(7)
    n = sequences.numbered(df, ["k"])
    assert n.select(F.length("text").alias("l")).count() == 5000 and n.where("id <> k").count() == 0


def test_placed_mentions(spark):
    p = spark.createDataFrame([("p", 10, "T cell and T cells, a t CELL; beta cell"), ("q", 0, None), ("r", 0, "Mast CELLS")], "passage_id string, offset int, text string")
    m = spark.createDataFrame([("p", "T cell", "A", 0), ("p", "T cells", "B", 1), ("p", "cell", "A", 2), ("p", "CELL; beta", "B", 3), ("q", "x", "A", 0), ("r", "mast cells", "A", 0), ("r", None, "A", 1)], "passage_id string, mention string, type string, ord int")
    got = sorted(map(tuple, spans.place_mentions(p, m).select("passage_id", "type", "start", "end", "text").collect()))
    assert got == [("p", "A", 10, 16, "T cell"), ("p", "A", 45, 49, "cell"), ("p", "B", 21, 28, "T cells"), ("p", "B", 34, 44, "CELL; beta"), ("r", "A", 0, 10, "Mast CELLS")]


def test_roc_in_ranges_equals_one_range(spark):
    df = spark.range(3000).selectExpr("int(id % 3 = 0) AS y", "double(pmod(xxhash64(id), 500)) AS s")
    one, many = (sorted(map(tuple, scoring.roc(df, "y", "s", parts=k).collect())) for k in (1, 16))
    assert one == many and len(one) > 400 and one[0][1:] == (1, 1)
    rows = df.collect()
    pos, neg = [r["s"] for r in rows if r["y"]], [r["s"] for r in rows if not r["y"]]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(scoring.auc(df, "y", "s", parts=16).first()["auc"] - want) < 1e-9
    assert scoring.auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_lowest_common_ancestors(spark):
    """Two leaves under one node gain that node only, not the root that all share."""
    parents = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (10, 100), (11, 100), (50, 50)], "id bigint, parent bigint")
    side = lambda *ids: spark.createDataFrame([(1, i) for i in ids], "doc_id int, id bigint")
    got = scoring.lowest_common_macro(side(1), side(2), parents).first()
    assert (got["precision"], got["recall"]) == (0.5, 0.5)  # {1, 10} and {2, 10}
    got = scoring.lowest_common_macro(side(1, 3), side(1), parents).first()
    assert (got["precision"], got["recall"]) == (pytest.approx(2 / 3), 0.5)  # 3 meets 1 at the root: {1, 3, 11, 100} and {1, 10, 100}
    assert scoring.lowest_common_macro(side(50), side(1), parents).first()["f1"] == 0


def test_zero_vectors_have_distance_one(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id int, vector array<float>")
    got = sorted(map(tuple, linking.top_k_cosine(v.withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "term_id"), k=2).collect()))
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (2, 1, 2, 0.0), (2, 2, 1, 1.0)]


def test_matching_by_groups(spark):
    ref, pred = span_rows(spark, [("A", 0, 10), ("A", 0, 3)]), span_rows(spark, [("A", 0, 2), ("A", 8, 9), ("B", 20, 21)])
    both = lambda d: d.withColumn("m", F.lit("x")).unionByName(d.withColumn("m", F.lit("y")))
    got = {r["m"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.approx_matrix(both(ref), both(pred).where("m = 'x' or start > 5"), ["m"]).collect()}
    assert got == {"x": (2, 1, 0), "y": (1, 1, 1)}
