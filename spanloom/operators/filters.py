"""Filters, relabelling and rule tables over annotations (families B and C of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import infon


def annotatable(text: Column, flag: Column, variant: int = 1) -> Column:
    """B1, four rules: 1 text and flag not ``no``; 2 flag neither ``False`` nor ``no``; 3 flag not empty; 4 flag and text not empty."""
    has_text, f = F.coalesce(F.length(text), F.lit(0)) > 0, F.coalesce(flag, F.lit(""))
    return {
        1: has_text & (f != "no"),
        2: ~f.isin("False", "no"),
        3: f != "",
        4: (f != "") & has_text,
    }[variant]


def of_types(anns: DataFrame, types: list[str] | None) -> DataFrame:
    """B2: rows of the types; None keeps all."""
    return anns if types is None else anns.where(F.col("type").isin(types))


def relabel_all(anns: DataFrame, label: str = "merged", distinct: bool = False) -> DataFrame:
    """One type for all. Kept as a bag unless ``distinct``."""
    out = anns.withColumn("type", F.lit(label))
    return out.distinct() if distinct else out


def not_blacklisted(anns: DataFrame, words: list[str] | DataFrame) -> DataFrame:
    """Drops rows whose lower-case text is in a list, or in the column ``word`` of a table (anti join)."""
    if isinstance(words, DataFrame):
        return anns.join(words.select(F.col("word").alias("__w")).distinct(), F.lower("text") == F.col("__w"), "left_anti")
    return anns.where(~F.lower("text").isin(words)) if words else anns


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that fulfil the condition, and all others."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(ok), df.where(~ok)


TYPE_SPLITS = {
    "cell_phenotype": ["cell_phenotype"],
    "cell_hetero": ["cell_hetero"],
    "cell_vague": ["cell_vague"],
    "pheno_hetero_merged": ["cell_phenotype", "cell_hetero"],
}


def _of_types(passages: str, types: Column, relabel: Column) -> Column:
    """Nested passages with the annotations of some types only, their type replaced where ``relabel`` isn't null."""
    renamed = lambda a: a.withField("infon", F.transform(a["infon"], lambda i: F.when((i["_key"] == "type") & relabel.isNotNull(), i.withField("_VALUE", relabel)).otherwise(i)))
    keep = lambda a: F.coalesce(F.exists(a["infon"], lambda i: (i["_key"] == "type") & F.array_contains(types, i["_VALUE"])), F.lit(False))
    return F.transform(passages, lambda p: p.withField("annotation", F.transform(F.filter(p["annotation"], keep), renamed)))


def split_nested_by_type(docs: DataFrame, types: list[str], relabel: str | None = None) -> DataFrame:
    """Nested documents with the annotations of some types only; passages left empty stay."""
    return docs.withColumn("passage", _of_types("passage", F.array(*map(F.lit, types)).cast("array<string>"), F.lit(relabel).cast("string")))


def split_nested(docs: DataFrame, splits: dict[str, list[str]]) -> DataFrame:
    """Every split of nested documents, by its ``name``, in one pass over them; several types of a split are relabelled ``merged``."""
    kinds = F.array(*(F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, v)).cast("array<string>").alias("types"), F.lit("merged" if len(v) > 1 else None).cast("string").alias("relabel")) for k, v in splits.items()))
    x = docs.select("*", F.explode(kinds).alias("__k"))
    return x.withColumn("passage", _of_types("passage", F.col("__k.types"), F.col("__k.relabel"))).withColumn("name", F.col("__k.name")).drop("__k")


def clear_annotations(docs: DataFrame, relations: bool = True) -> DataFrame:
    """Nested documents without annotations (and relations)."""

    def bare(p: Column) -> Column:
        p = p.withField("annotation", F.slice(p["annotation"], 1, 0))
        return p.withField("relation", F.slice(p["relation"], 1, 0)) if relations else p

    return docs.withColumn("passage", F.transform("passage", bare))


MOST_RULES = 10_000


def rule_array(rules: DataFrame) -> list[dict]:
    """A rule table, in ``rule_order``, as rows for the folds below. Rule files are small by nature: more than ``MOST_RULES`` are an error."""
    rows = rules.orderBy("rule_order").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [r.asDict() for r in rows]


def _matches(rule: dict, mention: Column, kind: Column, identifier: Column) -> Column:
    out = F.lit(True)
    for want, have in ((rule["mention"], mention), (rule["type"], kind), (rule["identifier"], identifier)):
        if want is not None:
            out = out & have.eqNullSafe(F.lit(want))
    return out


def update_annotations(anns: DataFrame, rules: list[dict]) -> DataFrame:
    """Rewrites (type, identifier) by rules in order; each rule sees what earlier ones made. None in a rule fits all."""
    if not rules:
        return anns
    rule = "struct<mention:string,type:string,identifier:string,new_type:string,new_identifier:string>"
    lit = lambda v: F.lit(v).cast("string")
    table = F.array(*[F.struct(*(lit(r.get(k)).alias(k) for k in ("mention", "type", "identifier", "new_type", "new_identifier"))) for r in rules]).cast(f"array<{rule}>")
    start = F.struct(F.col("type").alias("type"), F.col("identifier").alias("identifier"))
    mention = F.coalesce("text", F.lit(""))

    def step(acc: Column, r: Column) -> Column:
        fits = (r["mention"].isNull() | (r["mention"] == mention)) & (r["type"].isNull() | r["type"].eqNullSafe(acc["type"])) & (r["identifier"].isNull() | r["identifier"].eqNullSafe(acc["identifier"]))
        new = F.struct(F.coalesce(r["new_type"], acc["type"]).alias("type"), F.coalesce(r["new_identifier"], acc["identifier"]).alias("identifier"))
        return F.when(fits, new).otherwise(acc)

    return anns.withColumn("__n", F.aggregate(table, start, step)).withColumns({"type": F.col("__n.type"), "identifier": F.col("__n.identifier")}).drop("__n")


def delete_annotations(anns: DataFrame, rules: list[dict]) -> DataFrame:
    """Drops rows that any rule fits."""
    hit = F.lit(False)
    for r in rules:
        hit = hit | _matches(r, F.coalesce("text", F.lit("")), F.col("type"), F.col("identifier"))
    return anns.where(~hit)


def apply_rules(anns: DataFrame, rules: list[dict], infons: str | None = None) -> DataFrame:
    """Updates (5-field rules), then deletions (3-field rules). With ``infons`` the identifier is taken from
    ``identifier``, else ``Identifier``, else ``None``."""
    if infons:
        m = F.col(infons)
        anns = anns.withColumns({"identifier": F.coalesce(infon(m, "identifier"), infon(m, "Identifier"), F.lit("None")), "type": infon(m, "type", "None")})
    out = update_annotations(anns, [r for r in rules if r["is_update"]])
    return delete_annotations(out, [r for r in rules if not r["is_update"]])


def in_documents(rows: DataFrame, ids: DataFrame, key: str = "passage_id") -> DataFrame:
    """Rows whose key is in the first column of ``ids`` (semi join)."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi")


def lookup(passages: DataFrame, column: str, value: object) -> DataFrame:
    """The rows with a value: a pushed-down filter."""
    return passages.where(F.col(column) == F.lit(value))


def distinct_mentions(anns: DataFrame, stem: Column, doc: str = "pmid") -> DataFrame:
    """Distinct (document, stemmed mention) of all but vague annotations."""
    return anns.where(F.col("type") != "cell_vague").select(doc, stem.alias("mention")).distinct()
