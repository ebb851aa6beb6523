"""The corpus pipeline over ``documents``: language ID, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame,
which ``run`` writes as Parquet to the shared folder and reads again. All stages but the last return the
columns of ``documents`` as they are, whatever their names.

All stages: an empty table gives an empty result; texts of any length are worked on whole; repeated rows get equal decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import language_id, packing, toxicity
from spanloom.llm.common import drop_tables, labelled_sample, materialise, read_table, remainder, unused
from spanloom.llm.jaccard_join import keep_one_of_each_component
from spanloom.llm.queries import BYTE_BPE, BYTE_RANKS

#: A text further than this from every profile (score below it) is in no known language.
LEAST_LANGUAGE_SCORE = 0.2


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language: those with letters and a profile near enough.

    Null and empty texts and texts without a letter go; a null ``lang`` teaches nothing; null ids are kept like others.
    """
    model = language_id.learn(docs, F.lit(True))
    names = unused(docs, "lang_pred", "score")
    found = language_id.predict_language(docs, model, names=names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_LANGUAGE_SCORE)).select(*_columns(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't predicted toxic.

    Null, empty and wordless texts get the model's bias alone, by which they stay; rows with a null id or without a label
    teach nothing. Without labels of both kinds no document goes, unless all labels are toxic.
    """
    sample = labelled_sample(docs, read_table(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 3) != 1, per_class={1: 1500, 0: 3000})
    names = unused(docs, "score", "predicted")
    return toxicity.score_toxicity(docs, toxicity.learn(sample), names=names).where(F.col(names[1]) == 0).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Documents without words and those with a null id stay; of rows equal in id and text one stays; different texts under one
    id stay, as long as that id is the smallest of its group.
    """
    return keep_one_of_each_component(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens: the columns of ``packing.pack``. A null text is empty, a null id stays null."""
    return packing.pack(docs, BYTE_BPE, BYTE_RANKS)


STAGES = [("language ID", language), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("packing", packed)]
ORACLE_SQL = None  # classifiers and tokenizers have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop_tables(*before)
        before = [docs]
    return docs
