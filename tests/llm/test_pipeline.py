"""The pipeline against its stages' brute-force versions."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as C  # noqa: E402

from tests.llm.test_jaccard_join import brute  # noqa: E402
from tests.llm.test_tokens import check_packing  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5), (0, docs.where("doc_id = 0").first()["text"], "en", "s", 1)], docs.schema)
    docs = docs.unionByName(odd)
    kept = C.language(spark, docs, SF)
    assert kept.columns == docs.columns
    assert not {9001, 9002, 9003} & {r["doc_id"] for r in kept.collect()} and kept.count() == docs.count() - 3
    clean = C.toxic(spark, kept, SF)
    assert clean.columns == docs.columns and clean.count() <= kept.count()
    rows = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    one = C.near_duplicates(spark, kept, SF)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in brute(list({i: t for i, t in rows}.items()))})
    left = [(r["doc_id"], r["text"]) for r in one.select("doc_id", "text").collect()]
    check_packing(left, C.packed(spark, one, SF).collect(), 1024)


def test_run(spark):
    out = C.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language ID", "toxicity", "n-gram Jaccard join", "packing"]
    assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
    # clean documents stay: labelled not toxic, not a copy of another
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0")
    firsts = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    there = out.select("doc_id").distinct()
    good = firsts.join(labels, "doc_id").count()
    assert firsts.join(labels, "doc_id").join(there, "doc_id").count() >= 0.9 * good


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_columns_of_documents_are_left_alone(spark):
    """Columns with the names of the operators' outputs come through as they are, and so do very long texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.withColumns({"Score": F.concat(F.lit("s"), F.col("doc_id")), "predicted": F.lit("p"), "lang_pred": F.lit("l"), "component_id": F.lit("c"), "n_shingles": F.lit("n")})
    long = more.where("doc_id = 0").withColumns({"doc_id": F.lit(77_777).cast("bigint"), "Score": F.lit("s77777"), "text": F.concat_ws(" ", F.array_repeat("text", 200), F.lit("and an end"))})
    more = more.unionByName(long)
    for name, stage in C.STAGES[:3]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns and dict(out.dtypes) == dict(more.dtypes), name
        assert out.where("Score <> concat('s', doc_id) or predicted <> 'p' or lang_pred <> 'l' or component_id <> 'c' or n_shingles <> 'n'").count() == 0, name
    assert C.language(spark, more, SF).where("doc_id = 77777").count() == 1


def test_decisions_by_brute_force(spark):
    """Language: profiles learned and compared in plain Python. Toxicity: the model of the stage, piece by piece."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = C.language_id.learn(docs, F.lit(True))

    def profile(text):
        n = {}
        low = "".join(c if c.isalpha() else "\0" for c in text.lower())
        for k in (1, 2, 3):
            for i in range(len(low) - k + 1):
                g = low[i : i + k]
                if (g[0] != "\0") if k == 1 else (g != "\0\0") if k == 2 else g[1] != "\0":
                    n[g] = n.get(g, 0) + 1
        key = {1: lambda g: ord(g) | 0x1FFFFF << 42, 2: lambda g: ord(g[0]) * (g[0] != "\0") << 21 | ord(g[1]) | 0x1FFFFE << 42, 3: lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])}
        return sorted((key[len(g)](g) for g in n), key=lambda x, m={key[len(g)](g): c for g, c in n.items()}: (-m[x], x))[:300]

    theirs = [dict(zip(model["grams"][(r := model["ranks"][:-1, j]) < 300].tolist(), r[r < 300].tolist())) for j in range(len(model["langs"]))]
    want = set()
    for i, r in rows.items():
        mine = profile(r["text"] or "")
        if mine and 1 - min(sum(abs(k - t[g]) if g in t else 300 for k, g in enumerate(mine)) for t in theirs) / (300 * len(mine)) >= C.LEAST_LANGUAGE_SCORE:
            want.add(i)
    assert {r["doc_id"] for r in C.language(spark, docs, SF).select("doc_id").collect()} == want
    sample = C.labelled_sample(docs, spark.read.parquet(f"{SF}/labels.parquet"), "toxic", C.remainder("doc_id", 3) != 1, per_class={1: 1500, 0: 3000})
    tox = C.toxicity.learn(sample)
    keep = set()
    for i, r in rows.items():
        idx, w = C.toxicity.bag(r["text"] or "")
        z = float((tox["table"][idx].astype(float) * w).sum()) + tox["bias"]
        if 1 / (1 + 2.718281828459045**-z) < 0.7:
            keep.add(i)
    assert {r["doc_id"] for r in C.toxic(spark, docs, SF).select("doc_id").collect()} == keep


def test_driver_stays_flat(spark):
    """The driver's Python holds neither texts nor training: repeated runs of one session leave it as large as it was."""
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6
    sf = "/root/testdata/sf0.01"
    C.run(spark, sf).count()
    before = resident()
    for _ in range(2):
        assert C.run(spark, sf).count() > 0
    assert resident() - before < 60


def test_workers_hold_one_operator_at_a_time(spark):
    """Python workers outlive stages: the packing's table of words must not stay beside the work of the next stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def held(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "ByteEncoder" for x in gc.get_objects())], pa.int64())], ["n"])

    encoders = lambda: spark.range(64, numPartitions=64).mapInArrow(held, "n bigint").agg(F.sum("n")).first()[0]
    C.packed(spark, docs.repartition(64), SF).count()
    assert encoders() > 0
    C.toxicity.score_toxicity(docs.repartition(64), {"table": C.toxicity.fit([])["table"], "bias": 0.0}).agg(F.sum("score")).first()
    assert encoders() == 0


def test_a_kernel_gives_freed_memory_back():
    """What a task freed in small pieces goes back to the system when the task is over."""
    from spanloom.llm.common import lean

    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6

    @lean
    def kernel(batches):
        pieces = [bytes(2000) for _ in range(60_000)]
        last = bytes(2000)  # above the pieces, so that the heap's end does not fall by itself
        del pieces
        after.append(last)
        full.append(resident())
        yield 0

    after, full = [], []
    assert list(kernel(iter([]))) == [0]
    assert resident() < full[0] - 60
