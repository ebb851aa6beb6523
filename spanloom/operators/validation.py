"""Integrity rules of annotated collections (family H) as one table of errors.

Input tables: passages (file, passage_uid, passage_id, pmid, pmc, offset, text) and annotations (passage_uid,
ann_idx, type, identifier, text, locations). ``passage_uid`` identifies a passage even where its id is missing.
Rules stop early as a sequential check would: H2-H5 end a passage; H13-H15 end an annotation as the left one
of pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import grammar_parts
from ..model import ENTITY_TYPES
from ..session import scratch
from .spans import bucketed_interval_join, encloses

BLOCK = 512
REPORT = ("severity", "file", "passage_id", "general", "specific")


def _error(df: DataFrame, general: str | Column, specific: Column | None = None, severity: str = "ERROR") -> DataFrame:
    g = F.lit(general) if isinstance(general, str) else general
    return df.select(F.lit(severity).alias("severity"), "file", "passage_id", g.alias("general"), (g if specific is None else specific).alias("specific"))


def file_warnings(files: DataFrame) -> DataFrame:
    """H1: (path) rows that are no XML files."""
    return files.where(~F.lower("path").endswith(".xml")).select(F.lit("WARNING").alias("severity"), F.col("path").alias("file"), F.lit(None).cast("string").alias("passage_id"), F.lit("not an XML file").alias("general"), F.col("path").alias("specific"))


def passage_status(passages: DataFrame, docids: DataFrame | None = None) -> DataFrame:
    """H2-H5: the first failing rule of each passage in ``stop`` (null: sound)."""
    p = passages
    bad = F.lit(False)
    if docids is not None:
        known = docids.groupBy(F.col("pmid").alias("__pmid")).agg(F.max("pmc").alias("__pmc"))
        p = p.join(known, F.col("pmid") == F.col("__pmid"), "left")
        bad = F.col("__pmid").isNull() | ~F.col("pmc").eqNullSafe(F.col("__pmc"))
    stop = (
        F.when(F.col("passage_id").isNull(), "H2: passage has no passage_id")
        .when(F.col("pmid").isNull(), "H3: passage has no pmid")
        .when(~F.col("passage_id").startswith(F.concat("pmid", F.lit("_"))), "H4: passage_id does not start with the pmid")
        .when(bad, "H5: pmid and pmc do not match the document ids")
    )
    return p.withColumn("stop", stop).drop("__pmid", "__pmc")


def _narrow(anns: DataFrame, passages: DataFrame) -> DataFrame:
    """Annotations of sound passages with what the rules ask of the passage's text, without that text; a table in the shared folder.

    Adds n (locations), start and end of the first, ``inside`` (within the passage) and ``there`` (what the passage says there).
    """
    # the text goes in blocks of code points: a place is then found without a walk from the text's beginning for each annotation
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / BLOCK).cast("int")), lambda j: F.substring(F.col("text"), j * BLOCK + 1, F.lit(BLOCK)))
    p = passages.select("file", "passage_uid", "passage_id", F.col("offset").alias("__o"), F.length("text").alias("__n"), blocks.alias("__t"))
    first = F.try_element_at("locations", F.lit(1))
    start, end = first["offset"], first["offset"] + first["length"]
    inside = (start >= F.col("__o")) & (end <= F.col("__o") + F.col("__n"))
    at, size = start - F.col("__o"), end - start
    j = F.floor(at / BLOCK).cast("int")
    near = F.substring(F.concat(F.get("__t", j), F.coalesce(F.get("__t", j + 1), F.lit(""))), at % BLOCK + 1, size)
    there = F.when(inside, F.when(size <= BLOCK, near).otherwise(F.substring(F.array_join("__t", ""), at + 1, size)))
    out = anns.join(p, "passage_uid").select("file", "passage_uid", "passage_id", "ann_idx", "type", "identifier", "text", "locations", F.size("locations").alias("n"), start.alias("start"), end.alias("end"), inside.alias("inside"), there.alias("there"))
    path = scratch(anns.sparkSession, "validation")
    out.write.parquet(path)
    return anns.sparkSession.read.schema(out.schema).parquet(path)


def _own_errors(a: DataFrame) -> DataFrame:
    """What one annotation alone shows, in one pass."""
    kind, ident, text = F.col("type"), F.col("identifier"), F.col("text")
    error = lambda when, general, specific: F.array(F.when(when, F.struct(F.lit(general).alias("g"), specific.alias("s"))))
    each = lambda parts, when, general: F.transform(F.filter(parts, when), lambda x: F.struct(F.lit(general).alias("g"), x["part"].alias("s")))
    parts = F.when(ident.isNotNull(), grammar_parts(ident)).otherwise(F.array().cast("array<struct<part:string,qualifier:string,ids:array<string>>>"))
    known = lambda x: F.coalesce(x["qualifier"].isin("(skos:exact)", "(skos:related)"), F.lit(False))
    found = F.concat(
        error(kind.isNull(), "H7: annotation has no type", text),
        error(~kind.isin(*ENTITY_TYPES), "H7: unknown type", kind),
        error(ident.isNull(), "H8: annotation has no identifier", text),
        each(parts, lambda x: ~known(x), "H9: part has no exact or related qualifier"),
        each(parts, lambda x: (F.size(x["ids"]) > 1) & ~x["qualifier"].eqNullSafe(F.lit("(skos:related)")), "H10: several ids without related"),
        error((kind == "cell_vague") & ~ident.eqNullSafe(F.lit("None")), "H12: vague annotation with an identifier", ident),
        error(F.col("n") != 1, "H13: not exactly one location", text),
        error((F.col("n") >= 1) & ~F.col("inside"), "H14: span outside of the passage", text),
        error((F.col("n") >= 1) & F.col("inside") & (F.col("there") != text), "H15: text differs from the passage", F.concat_ws(" / ", text, "there")),
    )
    x = a.select("file", "passage_id", F.explode(F.array_compact(found)).alias("x"))
    return _error(x, F.col("x.g"), F.col("x.s"))


def _pair_errors(a: DataFrame) -> list[DataFrame]:
    """Pairs of a passage, the earlier one sound; overlaps by position as well as passage, so that no long passage is one task."""
    cols = ("file", "passage_uid", "passage_id", "ann_idx", "type", "text", "start", "end")
    one = a.where("n >= 1")
    left, right = one.where("inside and there = text").select(*cols), one.select("passage_uid", "ann_idx", "type", "text", "start", "end")
    v1, v2 = F.col("type") == "cell_vague", F.col("r_type") == "cell_vague"
    mixed, both = v1 != v2, F.concat_ws(" / ", "text", "r_text")
    whole = encloses(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) | encloses(F.col("r_start"), F.col("r_end"), F.col("start"), F.col("end"))
    vague = F.length(F.when(v1, F.col("text")).otherwise(F.col("r_text")))
    tag = F.array_compact(F.array(
        F.when(~mixed, "H16: overlap"),
        F.when(mixed & ~whole, "H17: partial overlap of vague and other"),
        F.when(mixed & whole & (F.least(F.length("text"), F.length("r_text")) >= vague), "H18: the vague annotation is the inner one"),
    ))
    meet = bucketed_interval_join(left, right, "passage_uid").where("ann_idx < r_ann_idx")
    found = meet.select("file", "passage_id", F.explode(tag).alias("g"), both.alias("s"))
    # H19 asks for equal texts, not for overlap: an equi-join of its own, so that no passage is paired with itself as a whole
    r = right.select("passage_uid", "text", *(F.col(c).alias(f"r_{c}") for c in ("ann_idx", "type")))
    same = left.join(r, ["passage_uid", "text"]).where((F.col("ann_idx") < F.col("r_ann_idx")) & mixed)
    return [_error(found, F.col("g"), F.col("s")), _error(same, "H19: vague and other with the same text", F.concat_ws(" / ", "text", "text"), "WARNING")]


def validate(passages: DataFrame, anns: DataFrame, ontology: DataFrame, docids: DataFrame | None = None) -> DataFrame:
    """All rules H2-H19: rows (severity, file, passage_id, general, specific). ``ontology`` has a column ``id``."""
    status = passage_status(passages, docids)
    a = _narrow(anns, status.where("stop is null"))
    w = Window.partitionBy("passage_uid", "locations", "text", "identifier", "type").orderBy("ann_idx")
    again = a.withColumn("__n", F.row_number().over(w)).where("__n > 1")
    ids = a.where("identifier is not null").select("file", "passage_id", F.explode(F.flatten(F.transform(grammar_parts(F.col("identifier")), lambda x: x["ids"]))).alias("id"))
    unknown = ids.join(ontology.select("id").distinct(), "id", "left_anti")
    out = [_error(status.where("stop is not null"), F.col("stop")), _own_errors(a), _error(again, "H6: duplicate annotation", F.col("text")), _error(unknown, "H11: id is not in the ontology", F.col("id")), *_pair_errors(a)]
    return reduce(DataFrame.unionByName, out)
