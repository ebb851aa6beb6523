"""Round trips of the file formats, and the streaming forms."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import aggregates as G
from spanloom.operators import filters, joins
from spanloom.sources import annotated as A
from spanloom.sources import tables as T
from spanloom.streaming import growth

XML = """<collection><document><id>d1</id><passage><infon key="passage_id">1_0</infon><infon key="article-id_pmid">1</infon><offset>0</offset><text> T cells &lt; MSC 𝛼</text>
<annotation id="a1"><infon key="type">cell_phenotype</infon><infon key="identifier">(skos:exact)CL:1</infon><infon key="annotator">x</infon><location offset="1" length="7"/><text>T cells</text></annotation>
<annotation id="a2"><infon key="type">cell_vague</infon><infon key="identifier">None</infon><location offset="11" length="3"/><text>MSC</text></annotation>
<annotation id="a3"><infon key="type">cell_hetero</infon><location offset="90" length="3"/><text>out</text></annotation>
<relation id="r1"><infon key="type">ABBR</infon><node refid="a1" role="LongForm"/><node refid="a2" role="ShortForm"/></relation></passage>
<passage><infon key="passage_id">1_1</infon><offset>30</offset><text>empty</text></passage></document></collection>"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(XML)
    (tmp_path / "in" / "note.txt").write_text("no")
    return tmp_path


def test_collection(spark, folder):
    docs = A.read_collection(spark, str(folder / "in"))
    p = {r["passage_id"]: r for r in A.passages(docs).collect()}
    assert p["1_0"]["text"] == " T cells < MSC 𝛼" and p["1_0"]["pmid"] == "1" and p["1_1"]["offset"] == 30
    a = {r["ann_id"]: r for r in A.annotations(docs).collect()}
    assert a["a1"]["identifier"] == "(skos:exact)CL:1" and a["a1"]["locations"][0]["length"] == 7 and a["a3"]["identifier"] is None
    assert sorted(r["text"] for r in A.evaluation_spans(docs).collect()) == ["MSC", "T cells"]
    assert [r["annotator"] for r in A.evaluation_spans(docs, by_annotator=True).collect()] == ["x"]
    rel = joins.resolve_relations(A.relations(docs), A.annotations(docs)).collect()
    assert [(r["short"], r["long"]) for r in rel] == [("MSC", "T cells")]


def test_write_and_read(spark, folder):
    docs = A.read_collection(spark, str(folder / "in"))
    for i, again in enumerate((docs, A.nest(A.passages(docs), A.annotations(docs)))):
        out = str(folder / f"out{i}")
        A.write_collection(again, out, per_file=1)
        back = A.read_collection(spark, out, pattern="")
        key = lambda d: sorted(map(str, A.annotations(d).select("doc_id", "passage_idx", "ann_id", "type", "identifier", "text", "locations").collect()))
        assert key(back) == key(docs)
        assert sorted(r["text"] for r in A.passages(back).collect()) == sorted(r["text"] for r in A.passages(docs).collect())


def test_nested_transforms(spark, folder):
    docs = A.read_collection(spark, str(folder / "in"))
    part = filters.split_nested_by_type(docs, ["cell_phenotype", "cell_hetero"], relabel="merged")
    assert sorted(r["type"] for r in A.annotations(part).collect()) == ["merged", "merged"]
    assert A.passages(part).count() == 2 and A.annotations(filters.clear_annotations(docs)).count() == 0
    assert A.merge_collections(spark, {"one": str(folder / "in"), "two": str(folder / "in")}).select("set_name").distinct().count() == 2


def test_splits_in_one_pass(spark, folder):
    docs = A.read_collection(spark, str(folder / "in"))
    got = filters.split_nested(docs, filters.TYPE_SPLITS)
    for name, types in filters.TYPE_SPLITS.items():
        want = filters.split_nested_by_type(docs, types, "merged" if len(types) > 1 else None)
        show = lambda d: sorted(map(str, A.annotations(d).select("ann_id", "type").collect()))
        assert show(got.where(F.col("name") == name)) == show(want)


def test_bounded_files_by_many_tasks(spark, tmp_path):
    p = spark.range(60).select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("passage_idx"), F.lit(0).alias("offset"), F.lit("t").alias("text"), F.create_map(F.lit("a"), F.lit("b")).alias("infons"))
    a = p.where("doc_id < '3'").select("doc_id", "passage_idx", F.lit(0).alias("ann_idx"), F.lit("x").alias("ann_id"), "infons", F.array(F.struct(F.lit(0).alias("offset"), F.lit(1).alias("length"))).alias("locations"), "text")
    A.write_bounded(p, a, str(tmp_path / "out"), 25, compression="gzip")
    back = A.read_collection(spark, str(tmp_path / "out"), pattern="")
    assert sorted(r["count"] for r in back.groupBy("file").count().collect()) == [10, 25, 25]
    assert A.annotations(back).count() == a.count() and back.select("id").distinct().count() == 60
    assert all(f.name.endswith(".gz") for f in (tmp_path / "out").glob("part-*"))


def test_abbreviations_of_many_files(spark, tmp_path):
    xml = XML.replace("cell_phenotype", "ABBR").replace("cell_vague", "ABBR")
    (tmp_path / "a 1.xml").write_text(xml)
    (tmp_path / "b.xml").write_text(xml.replace(">MSC<", ">TC<"))  # the same ids: relations stay in their file
    for i in range(30):
        (tmp_path / f"c{i:02}.tsv").write_text(f"d1\tMSC\tlong {i}\nd{i}x\tQ\tlong {i}\n")
    out = A.read_abbreviation_files(spark, str(tmp_path))
    rows = {(r["doc_id"], r["short"]): r["long"] for r in out.collect()}
    assert rows[("d1", "MSC")] == rows[("d1", "TC")] == "T cell" and rows[("d7x", "Q")] == "long 7" and len(rows) == 32
    assert out._jdf.queryExecution().toString().count("FileScan text") <= 4  # one read of all such files, not one a file


def test_side_tables(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    terms = T.read_terms(spark, write("t.tsv", "T cells\tCL:1\n\nB cell\tCL:2\n"))
    assert sorted(r["stem"] for r in terms.collect()) == ["B cell", "T cell"]
    with pytest.raises(Exception, match="not two fields"):
        T.read_terms(spark, write("bad.tsv", "a\tb\tc\n")).collect()
    abbr, bad = T.read_abbreviations(spark, write("a.tsv", "d\tMSCs\tmesenchymal stem cells\nbroken\n"))
    assert sorted((r["short"], r["long"]) for r in abbr.collect()) == [("MSC", "mesenchymal stem cell"), ("MSCs", "mesenchymal stem cells")]
    assert bad.count() == 1
    ids = T.read_docids(spark, write("d.tsv", "1\tPMC1\ttrue\n2\tNone\tfalse\n1\tPMC1\ttrue\n"))
    assert sorted(map(tuple, ids.collect()), key=str) == [("1", "PMC1", True), ("2", None, False)]
    with pytest.raises(Exception, match="not a boolean"):
        T.read_docids(spark, write("d2.tsv", "1\tPMC1\tmaybe\n")).collect()
    assert T.read_line_set(spark, write("l.txt", " a \n\na\nb\n")).count() == 2
    rules = filters.rule_array(T.read_rules(spark, write("r.tsv", "*\tA\t*\nm\tA\t*\tB\tX\nm\tA\t*\tC\tY\n")))
    assert [(r["is_update"], r["mention"], r["new_type"]) for r in rules] == [(False, None, None), (True, "m", "C")]
    meta = write("m.jsonl", '{"passage_id":"1","data":{"JOURNAL_NAME":"J"}}\n{"passage_id":"2","data":{"JOURNAL_NAME":"K"}}\n')
    assert T.read_metadata(spark, meta).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        T.read_metadata(spark, write("m2.jsonl", '{"passage_id":"1"}\n{"passage_id":"1"}\n')).collect()
    names = T.read_names(spark, write("n.csv", "cl_name,id\nT cell,CL:1\n,CL:2\n"))
    assert sorted(map(tuple, names.collect())) == [("CL:1", "T cell"), ("None", "N/A")]
    assert sorted(r["id"] for r in T.read_json_keys(spark, write("k.json", '{"CL:1": 1, "CL:2": {}}')).collect()) == ["CL:1", "CL:2"]
    assert T.read_dataset(spark, write("s.json", '{"tokens":["a"],"ner_tags":["O"]}\n'))[1:] == ("tokens", "ner_tags")
    assert T.pair_paths(str(tmp_path), str(tmp_path))[0][0] == T.pair_paths(str(tmp_path), str(tmp_path))[0][1]
    with pytest.raises(ValueError):
        T.pair_paths(str(tmp_path), str(tmp_path / "l.txt"))
    assert len(T.checksum(spark, str(tmp_path / "l.txt")).first()[0]) == 32


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, ["O", "B-A"]), (1, ["O"])], "i int, labels array<string>")
    T.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert T.json_document(df, ["i"]).first()[0] == '[{"i":1,"labels":["O"]},{"i":2,"labels":["O","B-A"]}]'
    T.write_tsv(df.select("i"), str(tmp_path / "t"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).count() == 2
    T.write_predictions(df, "labels", str(tmp_path / "p"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "p" / "text")).collect()) == ["O", "O B-A"]
    G.export_partitions(df.withColumn("k", F.col("i")), str(tmp_path / "e"), "k")
    assert (tmp_path / "e" / "k=1").is_dir()


def test_batch_source(spark):
    spark.dataSource.register(A.BatchSource)
    df = spark.read.format("annotated_batches").option("ids", "a,b,a,c").option("batchsize", "2").load()
    assert sorted(r["id"] for r in df.collect()) == ["a", "b", "c"] and df.rdd.getNumPartitions() == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = growth.read_batches(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "), per_trigger=1)
    q = growth.run_available(growth.first_seen(stream, "ts", ["user_id"], late="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("user_id").distinct().count()
    q = growth.run_available(growth.windowed_counts(stream, "ts", ["event_type"], late="60 days"), str(tmp_path / "w"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert q.exception() is None


def test_batches_that_fail(spark):
    spark.dataSource.register(A.BatchSource)
    read = lambda **o: spark.read.format("annotated_batches").options(ids="a,b,c", batchsize="2", tries="2", fetch="tests.test_sources:broken", **o).load()
    with pytest.raises(Exception, match="no answer after 2 tries"):
        read().collect()
    assert sorted(tuple(r) for r in read(onerror="null").collect()) == [("a", None), ("b", None), ("c", "<c/>")]


def broken(ids):
    if "a" in ids:
        raise OSError("busy")
    return [(i, f"<{i}/>") for i in ids]


def test_no_local_folder_on_a_cluster(monkeypatch):
    """Without a shared folder a cluster's run fails at once; local mode makes a folder of its own."""
    from types import SimpleNamespace

    from spanloom.session import scratch

    def fake(master, folder=None):
        settings = {"spark.checkpoint.dir": folder} if folder else {}
        conf = SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch(fake(master), "x")
        assert scratch(fake(master, "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert scratch(fake("local[4]"), "x")
