"""Language ID, toxicity, quality, licenses: edge cases, learning, brute-force comparisons."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import language_id as L
from spanloom.llm import license_scan as S
from spanloom.llm import quality as Q
from spanloom.llm import queries, toxicity as X
from spanloom.llm.common import labelled_sample, learn_in_a_task, remainder

SCHEMA = "doc_id bigint, text string, lang string, score string, predicted string, extra int"
ROWS = [(1, "the cat sat on the mat and the dog", "en", "a", "b", 1), (1, "the cat sat on the mat and the dog", "en", "a", "b", 1), (None, None, None, None, None, None), (2, "", None, "x", "y", 2), (3, "123 !!", "en", "", "", 3), (4, "der hund und die katze " * 5000, "de", "q", "r", 4)]


def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_language_edge_cases(spark):
    model = L.fit_profiles({"en": ["the cat and the dog sat on the mat with them"], "de": ["der hund und die katze sind auf der matte"]})
    got = L.predict_language(edge(spark), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[1]["lang_pred"] == "en" and by[4]["lang_pred"] == "de" and by[4]["extra"] == 4
    assert by[None]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == "und" and by[3]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got)
    assert L.predict_language(edge(spark).limit(0), model).count() == 0
    assert {r["lang_pred"] for r in L.predict_language(edge(spark), L.fit_profiles({})).collect()} == {"und"}


def test_rank_order_distance_by_brute_force():
    texts = {"a": ["abc abd abe"], "b": ["xyz xyw abc"]}
    model = L.fit_profiles(texts, most=8)
    pred, score = L.classify(model, pa.array(["abd xyz"]))
    grams = lambda t: L.ranking(L.gram_keys(pa.array([t]))[0], 8).tolist()
    mine = grams("abd xyz")
    dist = {k: sum(abs(i - p.index(g)) if g in p else 8 for i, g in enumerate(mine)) for k, v in texts.items() for p in [grams(v[0])]}
    best = min(dist, key=lambda k: (dist[k], k))
    assert pred == [best] and abs(score[0] - (1 - dist[best] / (8 * len(mine)))) < 1e-12


def test_language_accuracy_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_learning_ignores_the_fold(spark):
    docs = spark.createDataFrame([(i, "qqq www" if i % 2 else "zzz vvv", "x" if i % 2 else "y") for i in range(40)], "doc_id bigint, text string, lang string")
    fold = remainder("doc_id", 4) != 2
    base = L.learn(docs, fold)
    changed = docs.withColumn("lang", F.when(fold, F.col("lang")).otherwise("other")).withColumn("text", F.when(fold, F.col("text")).otherwise("jjj"))
    again = L.learn(changed, fold)
    assert base["langs"] == again["langs"] == ["x", "y"] and (base["grams"] == again["grams"]).all()


def toy(n=300, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    return [(" ".join([word() for _ in range(30)] + (["idiot", "stupid"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(n)]


def test_toxicity_learns_and_generalises_to_misspellings():
    model = X.fit(toy())
    s = X.scores(model, pa.array([t for t, _ in toy(60, seed=9)]))
    y = np.array([y for _, y in toy(60, seed=9)])
    assert s[y == 1].min() > s[y == 0].max()
    base = toy(2, seed=5)[1][0]
    a, b = X.scores(model, pa.array([base, base + " stupidd idiiot stupidest"]))
    assert b > a


def test_table_equals_mean_of_pieces():
    model = X.fit(toy(90))
    text = "idiot abcde"
    parts = np.concatenate([b[m] for b, m, _ in X.features(pa.array([text]))])
    z = model["table"][parts].mean() + model["bias"]
    assert abs(X.scores(model, pa.array(["zz zz", text]))[1] - 1 / (1 + np.exp(-z))) < 1e-6


def test_toxicity_edge_cases(spark):
    got = X.score_toxicity(edge(spark), X.fit(toy(60))).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    empty = {round(r["score"], 12) for r in got if r["doc_id"] in (None, 2)}
    assert len(empty) == 1
    assert X.score_toxicity(edge(spark).limit(0), X.fit([])).count() == 0
    assert X.fit([("a", 1)])["bias"] > 0 > X.fit([("a", 0)])["bias"]
    assert not X.fit([("abc", 1), ("xyz", 0)])["table"].any() and not X.fit([("", 1), (" ", 0)])["table"].any()


def test_quality_votes_by_brute_force():
    rows = [("good plain text here " + str(i), 1) for i in range(12)] + [("BAD!! $$$ ### " * (i + 1), 0) for i in range(12)]
    model = Q.fit(rows, dim=6, neighbours=5)
    texts = [t for t, _ in rows[:3]] + ["BAD $$$ ##", "plain words"]
    got = Q.scores(model, pa.array(texts), block=2)
    for t, s in zip(texts, got):
        v = Q.unit(Q.weigh(Q.counts(pa.array([t])), model["idf"]) @ model["basis"])[0]
        sim = model["vectors"] @ v
        near = sorted(sim, reverse=True)[4]
        w = np.where((sim >= near - 1e-6) & (sim > 0), sim, 0)
        assert abs(s - (w * model["labels"]).sum() / w.sum()) < 1e-3
    assert got[0] > 0.9 and got[3] < 0.1


def test_quality_edge_cases(spark):
    got = Q.score_quality(edge(spark), Q.fit([("good text", 1), ("BAD!!", 0)])).collect()
    assert len(got) == 6 and {r["score"] for r in got if r["doc_id"] in (None, 2)} == {0.5}
    assert Q.score_quality(edge(spark), Q.fit([])).count() == 6
    assert Q.score_quality(edge(spark).limit(0), Q.fit([])).count() == 0


def test_labelled_sample_is_bounded_and_keeps_to_the_fold(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, toxic int")
    rows = [(r["text"], r["y"]) for r in labelled_sample(docs, labels, "toxic", remainder("doc_id", 3) != 1, {0: 5, 1: 7}).collect()]
    held = {r[0] for r in labels.where(remainder("doc_id", 3) == 1).select("doc_id").collect()}
    assert sum(y == 0 for _, y in rows) == 5 and sum(y for _, y in rows) == 7
    assert not held & {int(t[1:]) for t, _ in rows}


@pytest.mark.parametrize("seed", range(5))
def test_increasing_is_longest(seed):
    r = random.Random(seed)
    v = r.sample(range(30), 9)
    best = [1] * 9
    for i in range(9):
        best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
    got = S.increasing(v)
    assert len(got) == max(best) and all(v[a] < v[b] for a, b in zip(got, got[1:]))


def test_patience_pairs():
    a, b = "a b c d e f".split(), "x a b q d e z f".split()
    pairs = S.patience(a, b)
    assert [a[i] for i, _ in pairs] == ["a", "b", "d", "e", "f"] and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_license_places(spark):
    mit = S.TEMPLATES["MIT"][2]
    text = "intro\n" + mit.replace("sublicense,", "") + " x " + mit + " " + "filler " * 3000 + S.TEMPLATES["CC-BY-NC-4.0"][0]
    rows = [(1, text), (2, None), (3, ""), (4, "the license of nothing"), (5, mit), (5, mit)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: r for r in S.scan_licenses(df).collect()}
    assert got[1]["n_found"] == 3 and {p["license"] for p in got[1]["places"]} == {"MIT", "CC-BY-NC-4.0"}
    for p in got[1]["places"]:
        assert text[p["start"] : p["end"]].split()[0] in ("Permission", "Licensed")
    assert all(got[i]["license"] is None and got[i]["coverage"] == 0 for i in (2, 3, 4)) and got[5]["coverage"] == 1
    assert S.scan_licenses(df.limit(0)).count() == 0


def test_licenses_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op8_license_scan"](spark, sf).collect():
        there = {k for k, v in S.TEMPLATES.items() if any(t in texts[r["doc_id"]] for t in v)}
        assert (r["license"] in there) if there else r["license"] is None


def test_licenses_without_usual_words(spark):
    rows = [(0, "Released under CC BY 4.0."), (1, "Available under CC BY 4.0."), (2, "so: LICENCED UNDER CC BY-NC 4.0, ok"), (3, "_Licensed_ under CC BY 3.0"), (4, "Offered under CC BY 3.0"), (5, "Issued under the MIT License")]
    got = {r["doc_id"]: (r["license"], r["coverage"], r["n_found"]) for r in S.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {0: ("CC-BY-4.0", 0.8, 1), 1: ("CC-BY-4.0", 0.8, 1), 2: ("CC-BY-NC-4.0", 0.8, 1), 3: ("CC-BY-3.0", 1.0, 1), 4: ("CC-BY-3.0", 0.8, 1), 5: ("MIT", 0.8, 1)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY 2.5.", None),
        ("Licensed under the BSD License.", None),
        ("Licensed under the Zlib License.", "Zlib"),
        ("Licensed under the Foo License.", None),
        ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
        ("Licensed under the Apache License, Version 1.0.", None),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 4.", None),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU Library General Public License, version 2.", None),
    ],
)
def test_relatives_of_a_license_are_not_that_license(text, want):
    got = S.Scanner().scan("before it " + text + " after it")
    assert (got[0][0] if got else None) == want and len(got) <= 1


def test_every_notice_is_found_as_its_own():
    scanner = S.Scanner()
    for k, (name, t) in enumerate(scanner.templates):
        assert scanner.phrases[k], name
        assert {x[:2] for x in scanner.scan("q0 " + " ".join(t) + " q1")} == {(name, 1.0)}, name
    three = S.TEMPLATES["BSD-3-Clause"][1]
    assert [x[0] for x in scanner.scan(three.replace("prior", "").replace("copyright holder", "owner"))] == ["BSD-3-Clause"]


@pytest.mark.parametrize("seed", range(40))
def test_alignment_by_brute_force(seed):
    """The best alignment that has each phrase word for word, against trying all of them."""
    r = random.Random(seed)
    template = r.choices("abcd", k=7)
    phrases = [(1, 2)] if seed % 2 else [(0, 1), (4, 2)]
    window = r.choices("abcde", k=9)

    def best(i, j):
        """Aligned words of template[i:] and window[j:]; phrases whole or nothing counts."""
        if i == len(template):
            return 0
        out = -99
        for start, size in phrases:
            if start == i:
                return max((size + best(i + size, k + size) for k in range(j, len(window) - size + 1) if window[k : k + size] == template[i : i + size]), default=-99)
        out = best(i + 1, j)
        for k in range(j, len(window)):
            if window[k] == template[i]:
                out = max(out, 1 + best(i + 1, k + 1))
                break
        return out

    assert S.covered(template, phrases, window) == max(0, best(0, 0))


def test_license_texts_have_seeds():
    scanner, r = S.Scanner(), random.Random(5)
    for (name, t), need, seeds in zip(scanner.templates, scanner.need, scanner.seeds):
        assert need / len(t) >= 0.8 > (need - 1) / len(t)
        for _ in range(60):
            out = set(r.sample(range(len(t)), len(t) - need))
            text = " ".join(["q0 q1", *(("zz" if r.random() < 0.5 else "") if i in out else w for i, w in enumerate(t)), "q2"])
            assert set(seeds) - out, name
            assert pa.compute.match_substring_regex(pa.array([text]), scanner.pattern, ignore_case=True)[0].as_py()


@pytest.mark.parametrize("k", [3, 4, 1000])
def test_licenses_in_a_row(k):
    scanner = S.Scanner()
    for name, texts in S.TEMPLATES.items():
        for t in texts:
            for copy in (t, " ".join(w for i, w in enumerate(t.split()) if i != 1)):
                copies = min(k, 12) if len(t) > 200 and k > 4 else k
                text = "some words before " + " ".join([copy] * copies) + " and after"
                got = sorted(x[2:] for x in scanner.scan(text) if x[0] == name)
                cut = copy.rstrip(".;,")
                assert [(x, y) for x, y in got] == [(18 + i * (len(copy) + 1), 18 + i * (len(copy) + 1) + len(cut)) for i in range(copies)], (copy, got[:3])


@pytest.mark.parametrize("seed", range(30))
def test_licenses_by_patience_on_every_window(seed):
    """Every window that patience alignment accepts meets a place, whole copies are found as such, and no place is made up."""
    r = random.Random(seed)
    templates = {"A": ("a b a c d",), "B": ("b c d e f b a",), "C": ("the license of a b c the d e the f g",)}
    scanner = S.Scanner(templates)
    tokens: list[str] = []
    while len(tokens) < 60:
        t = S.words(r.choice(list(templates.values()))[0])[0]
        tokens += [w for w in t if r.random() < 0.9] * r.choice((1, 1, 3)) + r.choices("abcdefgxyz", k=r.choice((0, 0, 1, 5)))
    ends = [0]
    for w in tokens:
        ends.append(ends[-1] + len(w) + 1)
    got = scanner.scan(" ".join(tokens))
    whole = False
    for _, t in scanner.templates:
        for s in range(len(tokens)):
            for e in range(s + 1, min(len(tokens), s + 2 * len(t) + 5) + 1):
                whole |= tokens[s:e] == t
                if len(S.patience(t, tokens[s:e])) / len(t) >= 0.8:
                    assert any(x < ends[e] and y > ends[s] for _, _, x, y in got), (t, s, e)
    assert not whole or got[0][1] == 1
    for name, cov, x, y in got:
        t, part = S.words(templates[name][0])[0], " ".join(tokens)[x:y].split()
        rows = [[0] * (len(part) + 1)]
        for w in t:
            rows.append([0])
            for j, v in enumerate(part, 1):
                rows[-1].append(max(rows[-1][-1], rows[-2][j], rows[-2][j - 1] + (w == v)))
        assert cov == rows[-1][-1] / len(t) >= 0.8 and len(part) <= 2 * len(t) + 5
    assert all(a[3] <= b[2] or b[3] <= a[2] for i, a in enumerate(got) for b in got[:i])


def test_any_words_but_the_phrases_may_miss():
    scanner, r = S.Scanner(), random.Random(7)
    for (name, t), need, phrases in zip(scanner.templates, scanner.need, scanner.phrases):
        fixed = {i for start, size in phrases for i in range(start, start + size)}
        rest = [i for i in range(len(t)) if i not in fixed]
        for _ in range(30):
            out = set(r.sample(rest, min(len(rest), len(t) - need)))
            text = " ".join(["q0 q1", *(("zz" if r.random() < 0.5 else "") if i in out else w for i, w in enumerate(t)), "q2"])
            assert any(c >= 0.8 and n in (name, S.LONGER.get(name)) for n, c, _, _ in scanner.scan(text)), (name, out)


def test_sample_and_training_bounds(spark):
    """Repeated ids and labels give one example each; rows and bytes beyond the bounds are no examples; order is fixed."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "x" * 50), (4, "dd"), (None, "n")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 1), (4, 0), (4, None), (None, 1)], "doc_id bigint, toxic int")
    got = sorted(map(tuple, labelled_sample(docs, labels, "toxic", F.lit(True), {0: 9, 1: 9}, row_bytes=40).collect()))
    assert got == [(1, "a", 1), (4, "dd", 0)]
    sample = spark.createDataFrame([(i, "t" * 10, i) for i in range(20)], "id bigint, text string, y int").repartition(3)
    keep = lambda rows: {"rows": rows}
    assert learn_in_a_task(sample, keep, [F.desc("id")], 55)["rows"] == [(i, "t" * 10, i) for i in range(19, 14, -1)]
    assert learn_in_a_task(sample.limit(0), keep, ["id"], 55)["rows"] == []


def test_training_by_plain_loops():
    """The same Adagrad steps, one number at a time."""
    rows, dim, steps, batch, rate, seed = toy(40, 3), 2, 12, 8, 0.5, 7
    rng = np.random.default_rng(seed)
    bags = [dict(zip(*(x.tolist() for x in X.bag(t)))) for t, _ in rows]
    seen = {}
    for b in bags:
        for i in b:
            seen[i] = seen.get(i, 0) + 1
    known = sorted(i for i, n in seen.items() if n >= 5)
    v = dict(zip(known, ((rng.random((len(known), dim), dtype=np.float32) - 0.5) / dim).tolist()))
    w = (rng.standard_normal((dim, 2)) * 0.5).tolist()
    bias, gb, gw, gv, order = [0.0, 0.0], [1e-8] * 2, [[1e-8] * 2 for _ in range(dim)], dict.fromkeys(known, 1e-8), []
    for _ in range(steps):
        order = order or rng.permutation(len(rows)).tolist()
        part, order = order[:batch], order[batch:]
        dw, db, dv = [[0.0] * 2 for _ in range(dim)], [0.0] * 2, {}
        for r in part:
            bag = {i: x for i, x in bags[r].items() if i in v}
            mean = [sum(x * v[i][j] for i, x in bag.items()) for j in range(dim)]
            z = [sum(mean[j] * w[j][c] for j in range(dim)) + bias[c] for c in (0, 1)]
            e = [np.exp(x - max(z)) for x in z]
            d = [(e[c] / sum(e) - (c == rows[r][1])) / len(part) for c in (0, 1)]
            for c in (0, 1):
                db[c] += d[c]
                for j in range(dim):
                    dw[j][c] += mean[j] * d[c]
            for i, x in bag.items():
                g = dv.setdefault(i, [0.0] * dim)
                for j in range(dim):
                    g[j] += x * sum(d[c] * w[j][c] for c in (0, 1))
        for i, g in dv.items():
            gv[i] += sum(x * x for x in g) / dim
            v[i] = [a - rate * x / gv[i] ** 0.5 for a, x in zip(v[i], g)]
        for c in (0, 1):
            gb[c] += db[c] ** 2
            for j in range(dim):
                gw[j][c] += dw[j][c] ** 2
                w[j][c] -= rate * dw[j][c] / gw[j][c] ** 0.5
            bias[c] -= rate * db[c] / gb[c] ** 0.5
    model = X.fit(rows, dim=dim, steps=steps, batch=batch, rate=rate, seed=seed)
    want = [sum(v[i][j] * (w[j][1] - w[j][0]) for j in range(dim)) for i in known]
    assert np.abs(model["table"][known] - want).max() < 1e-3 * max(map(abs, want)) and abs(model["bias"] - (bias[1] - bias[0])) < 1e-3


def test_pieces_are_of_characters():
    """A Cyrillic word has the pieces of its letters, whatever bytes they take."""
    count = lambda t: [int(m.sum()) for _, m, _ in X.features(pa.array([t]))]
    assert count("\u0441\u043b\u043e\u0432\u043e") == count("words") == [5, 4, 3, 1]


def test_language_sample_in_parts(spark):
    """Ids that repeat, hot languages and rows beyond the byte bounds: the sample is of the least hashes still."""
    rows = [(i, f"word{i} text", "a") for i in range(200)] + [(7, "another text", "a"), (9, None, "a"), (500, "z" * 5000, "b"), (501, "kleines wort", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.learn(df, F.lit(True), per_language=3, row_bytes=1000)
    ids = [r["doc_id"] for r in df.where("lang = 'a' and text is not null").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(3).collect()]
    want = L.fit_profiles({"a": [next(t for j, t, _ in rows if j == i) for i in ids], "b": ["kleines wort"]})
    assert model["langs"] == ["a", "b"] and (model["grams"] == want["grams"]).all() and (model["ranks"] == want["ranks"]).all()


def test_tally_in_parts():
    texts = ["the cat", "sat on the mat", "", "12"]
    for a, b in zip(L.tally(texts, every=3), L.tally(texts)):
        assert (a == b).all()
