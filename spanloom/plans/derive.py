"""Annotated-text inputs derived from the driver's tables, and the same as DuckDB CTEs.

Words of documents split at single spaces are tokens; every third is a reference span, every fifth a predicted
one (its end moved by 3 at odd positions). Types and identifiers follow from length and position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import words_with_offsets
from ..session import table

TYPES = ("cell_phenotype", "cell_hetero", "cell_vague")


def words(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """(doc_id, lang, source, pos, tok, start, end), of every word or those at multiples of ``every``."""
    return words_with_offsets(table(spark, sf_dir, "documents"), "text", ["doc_id", "lang", "source"], every)


def _type():
    n = F.length("tok") % 3
    return F.when(n == 0, TYPES[0]).when(n == 1, TYPES[1]).otherwise(TYPES[2])


def _identifier():
    k, a, b = F.col("pos") % 6, (F.length("tok") * F.col("pos") % 50).cast("string"), (F.length("tok") % 50).cast("string")
    e, r = F.lit("(skos:exact)CL:"), F.lit("(skos:related)CL:")
    return (
        F.when(k == 0, F.lit("None"))
        .when(k == 1, F.concat(e, a))
        .when(k == 2, F.concat(r, a, F.lit(",CL:"), b))
        .when(k == 3, F.concat(e, a, F.lit(";-;"), r, b))
        .when(k == 4, F.lit("-"))
        .otherwise(F.concat(e, b))
    )


def ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference spans: (passage_id, lang, source, pos, type, start, end, text, identifier)."""
    w = words(spark, sf_dir, every=3).where(F.length("tok") > 0)
    return w.select(F.col("doc_id").alias("passage_id"), "lang", "source", "pos", _type().alias("type"), "start", "end", F.col("tok").alias("text"), _identifier().alias("identifier"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir, every=5).where(F.length("tok") > 0)
    end = F.col("end") + F.when(F.col("pos") % 2 == 1, 3).otherwise(0)
    return w.select(F.col("doc_id").alias("passage_id"), "lang", "source", "pos", _type().alias("type"), "start", end.alias("end"), F.col("tok").alias("text"), _identifier().alias("identifier"))


SQL = r"""
w0 AS (SELECT doc_id, lang, source, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
w AS (SELECT *, e - length(tok) AS s FROM (SELECT *, (sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY pos)) - 1 AS e FROM w0)),
typed AS (SELECT *, CASE length(tok) % 3 WHEN 0 THEN 'cell_phenotype' WHEN 1 THEN 'cell_hetero' ELSE 'cell_vague' END AS type,
  CASE pos % 6 WHEN 0 THEN 'None' WHEN 1 THEN '(skos:exact)CL:' || (length(tok) * pos % 50) WHEN 2 THEN '(skos:related)CL:' || (length(tok) * pos % 50) || ',CL:' || (length(tok) % 50)
    WHEN 3 THEN '(skos:exact)CL:' || (length(tok) * pos % 50) || ';-;(skos:related)CL:' || (length(tok) % 50) WHEN 4 THEN '-' ELSE '(skos:exact)CL:' || (length(tok) % 50) END AS identifier FROM w WHERE length(tok) > 0),
r AS (SELECT doc_id AS passage_id, lang, source, pos, type, s, e, tok AS text, identifier FROM typed WHERE pos % 3 = 0),
p AS (SELECT doc_id AS passage_id, lang, source, pos, type, s, e + CASE WHEN pos % 2 = 1 THEN 3 ELSE 0 END AS e, tok AS text, identifier FROM typed WHERE pos % 5 = 0)
"""


def sql(body: str) -> str:
    """A DuckDB query over the CTEs ``w`` (words), ``r`` (reference) and ``p`` (predicted)."""
    return f"WITH {SQL}{body}"


PRF = "CASE WHEN tp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1"
