"""Side tables and sinks (A10-A22, A25, A26): explicit schemas, strict or tolerant as each file needs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem_phrase
from ..model import METADATA


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A10: a vocabulary of (name, id); any other number of fields is an error; names are stemmed in ``stem``."""
    parts = F.split("value", "\t")
    ok = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), F.col("value"))).cast("array<string>"))
    return _lines(spark, path).select(ok.alias("f")).select(F.col("f")[0].alias("name"), F.col("f")[1].alias("id")).withColumn("stem", stem_phrase(F.col("name")))


def read_abbreviations(spark: SparkSession, path: str | list[str], files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, short, long, load_order), where both forms end in ``s`` with a second row without it, and the malformed lines.

    Of several files the order is that of ``files`` (__name, __i).
    """
    rows = _lines(spark, path).withColumn("n", F.monotonically_increasing_id())
    if files is not None:
        rows = rows.withColumn("__name", F.col("_metadata.file_name")).join(F.broadcast(files), "__name").withColumn("n", F.col("__i") * F.lit(1 << 47) + F.col("n"))
    rows = rows.select("value", "n", F.split("value", "\t").alias("f"))
    good = rows.where(F.size("f") >= 3).select("n", *(F.col("f")[i].alias(c) for i, c in enumerate(("doc_id", "short", "long"))))
    return with_singular(good), rows.where(F.size("f") < 3).select("value")


def with_singular(rows: DataFrame) -> DataFrame:
    """(doc_id, short, long, load_order) of rows (doc_id, short, long, n): where both forms end in ``s``, a second row has them without it."""
    cut = lambda c: F.expr(f"left({c}, length({c}) - 1)").alias(c)
    single = F.when(F.col("short").endswith("s") & F.col("long").endswith("s"), F.struct(cut("short"), cut("long"), F.lit(1).alias("k")))
    both = rows.select("doc_id", "n", F.explode(F.array_compact(F.array(F.struct("short", "long", F.lit(0).alias("k")), single))).alias("x"))
    return both.select("doc_id", "x.short", "x.long", (F.col("n") * 2 + F.col("x.k")).alias("load_order")).groupBy("doc_id", "short", "long").agg(F.min("load_order").alias("load_order"))


def read_docids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (pmid, pmc, full_text); a flag other than true or false is an error."""
    f = F.split("value", "\t")
    flag = F.lower(F.trim(f[2]))
    ok = F.when(flag == "true", True).when(flag == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), flag)).cast("boolean"))
    miss = lambda c: F.when(F.lower(F.trim(c)).isin("", "none"), None).otherwise(F.trim(c))
    return _lines(spark, path).select(miss(f[0]).alias("pmid"), miss(f[1]).alias("pmc"), ok.alias("full_text")).distinct()


def read_line_set(spark: SparkSession, path: str, column: str = "id") -> DataFrame:
    """Distinct trimmed lines; gzip by ending."""
    return _lines(spark, path).select(F.trim("value").alias(column)).distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Relabelling (5 fields) and deletion (3 fields) rules in order; ``*`` is null. Of repeated keys the last value counts, at the first place."""
    rows = _lines(spark, path).withColumn("f", F.split("value", "\t")).withColumn("n", F.monotonically_increasing_id())
    star = lambda i: F.when(F.get("f", F.lit(i)) == "*", None).otherwise(F.get("f", F.lit(i)))
    rows = rows.where(F.size("f").isin(3, 5)).select("n", (F.size("f") == 5).alias("is_update"), *(star(i).alias(c) for i, c in enumerate(("mention", "type", "identifier", "new_type", "new_identifier"))))
    return rows.groupBy("is_update", "mention", "type", "identifier").agg(F.max_by("new_type", "n").alias("new_type"), F.max_by("new_identifier", "n").alias("new_identifier"), F.min("n").alias("rule_order"))


def read_metadata(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Passage metadata, one JSON object a line; a repeated passage id is an error."""
    m = spark.read.schema(METADATA).json(path).select("passage_id", "data.*")
    return require_unique(m, "passage_id") if check else m


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Fails when a key repeats; otherwise the same rows."""
    n = df.groupBy(key).agg(F.count("*").alias("__n"))
    ok = F.when(F.col("__n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast(df.schema[key].dataType))
    return df.join(n, key).withColumn(key, ok).drop("__n")


def read_names(spark: SparkSession, path: str, name: str = "cl_name", position: int = 1) -> DataFrame:
    """(id, name) of a CSV whose id is in a column by position; rows with a gap are dropped; ``None`` is named N/A."""
    df = spark.read.option("header", "true").csv(path).na.drop()
    return df.select(F.col(df.columns[position]).alias("id"), F.col(name).alias("name")).unionByName(spark.createDataFrame([("None", "N/A")], "id string, name string"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON list (or object) of a given schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_json_keys(spark: SparkSession, path: str) -> DataFrame:
    """The keys of a whole-file JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.json_object_keys("value")).alias("id"))


def read_dataset(spark: SparkSession, path: str, task: str = "ner", text: str | None = None, label: str | None = None) -> tuple[DataFrame, str, str]:
    """A CSV or JSON data set and its text and label columns: as named, else ``tokens`` and ``<task>_tags``, else the first two."""
    df = spark.read.option("header", "true").csv(path) if path.rstrip("/").endswith(".csv") else spark.read.json(path)
    cols = df.columns
    t = text or ("tokens" if "tokens" in cols else cols[0])
    return df, t, label or (f"{task}_tags" if f"{task}_tags" in cols else cols[min(1, len(cols) - 1)])


def pair_paths(inputs: str, outputs: str) -> list[tuple[str, str]]:
    """A folder with a folder by file name, a file with a file; anything else is an error."""
    if os.path.isdir(inputs) and os.path.isdir(outputs):
        return [(os.path.join(inputs, f), os.path.join(outputs, f)) for f in sorted(os.listdir(inputs))]
    if os.path.isfile(inputs) and not os.path.isdir(outputs):
        return [(inputs, outputs)]
    raise ValueError("give two folders, or a file and a file name")


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """md5 of each file, and of all those digests in order of name."""
    files = spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))
    return files.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "md5"))), lambda x: x["md5"]), "").cast("binary")).alias("md5"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """A19."""
    df.write.mode("overwrite").json(path)


def json_document(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """All rows (a report) as one JSON list in one row."""
    rows = F.struct(*order, F.struct(*df.columns).alias("__r"))
    return df.agg(F.to_json(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["__r"])).alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    """A21."""
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_predictions(df: DataFrame, labels: str, path: str) -> None:
    """A line of labels per sequence as text, and the same as JSON, in two folders."""
    df.select(F.array_join(labels, " ").alias("value")).write.mode("overwrite").text(f"{path}/text")
    df.select(labels).write.mode("overwrite").json(f"{path}/json")
