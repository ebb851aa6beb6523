"""Linked-identifier strings: ``None``, or parts joined by ``;``, each a qualifier and ids joined by ``,``.

All functions map a string column to a column and stay inside the JVM. Ids refer to the operator inventory.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two qualifiers, and what counts as no id.
EXACT, RELATED = "(skos:exact)", "(skos:related)"
NONE_LIKE = ("none", "-", "")


def strip_qualifiers(c: Column) -> Column:
    """E10."""
    return F.regexp_replace(c, r"\(skos:(related|exact)\)", "")


def pieces(c: Column) -> Column:
    return F.split(c, "[,;]")


def is_none(c: Column) -> Column:
    """Whether all ids are none-like."""
    return F.forall(pieces(strip_qualifiers(c)), lambda x: F.lower(x).isin(*NONE_LIKE))


def is_exact(c: Column) -> Column:
    """Related or a gap: false; exact: true; ``None``: false; anything else is an error."""
    bad = F.raise_error(F.concat(F.lit("qualifiers not as expected: "), c)).cast("boolean")
    return (
        F.when(c.contains(RELATED) | c.contains("-"), False)
        .when(c.contains(EXACT), True)
        .when(c == "None", False)
        .otherwise(bad)
    )


def exact_pieces(c: Column) -> Column:
    """The pieces that carry the exact qualifier."""
    return F.filter(pieces(c), lambda x: x.contains("skos:exact"))


def all_ids(c: Column, include_none: bool = False) -> Column:
    """The ids as a bag, none-like ones as ``None`` or left out."""
    ids = F.transform(pieces(strip_qualifiers(c)), lambda x: F.when(F.lower(x).isin(*NONE_LIKE), "None").otherwise(x))
    return ids if include_none else F.filter(ids, lambda x: x != "None")


def comparison_ids(c: Column) -> Column:
    """Ids as the comparison of corpora counts them: gaps and empty ids stay."""
    return F.when(c.isNull() | (c == "None"), F.array().cast("array<string>")).otherwise(pieces(strip_qualifiers(c)))


def is_novel(c: Column) -> Column:
    """No id, a related one, several, or none of the ontology."""
    v = F.coalesce(c, F.lit(""))
    return c.isNull() | (c == "None") | v.contains("rel") | v.contains(",") | ~v.contains("CL")


def evaluation_ids(c: Column) -> Column:
    """Pieces with their qualifiers; none and empty give nothing."""
    v = F.coalesce(c, F.lit(""))
    return F.when(F.lower(v).isin("none", ""), F.array().cast("array<string>")).otherwise(pieces(v))


def span_identifier(c: Column) -> Column:
    """B6, for spans with identifiers: the whole string, or empty."""
    v = F.coalesce(c, F.lit(""))
    return F.when(F.lower(v) == "none", "").otherwise(v)


def agreement_ids(c: Column) -> Column:
    """Pieces at commas; what is no ontology id, or missing, is ``placeholder``."""
    return F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.when(x.contains("CL:"), x).otherwise("placeholder"))


def agreement_type(kind: Column, identifier: Column, keep_quirk: bool = True) -> Column:
    """B7, for spans with identifiers: a missing identifier blanks the type (``keep_quirk``)."""
    return F.when(identifier.isNull(), "").otherwise(kind) if keep_quirk else kind


def grammar_parts(c: Column) -> Column:
    """Parts as structs (part, qualifier, ids); gaps of a coordination are left out."""
    parts = F.split(c, ";")
    kept = F.filter(parts, lambda p: ~((p == "-") & (F.size(parts) > 1)))

    def one(p: Column) -> Column:
        cut = F.instr(p, ")")
        qualifier = F.when(cut > 0, F.substring(p, F.lit(1), cut))
        ids = F.split(F.when(cut > 0, F.substring(p, cut + 1, F.length(p))).otherwise(p), ",")
        return F.struct(p.alias("part"), qualifier.alias("qualifier"), ids.alias("ids"))

    return F.when(c == "None", F.array().cast("array<struct<part:string,qualifier:string,ids:array<string>>>")).otherwise(F.transform(kept, one))


def linkage(c: Column) -> Column:
    """Related, exact or none; several parts give null; anything else is an error."""
    bad = F.raise_error(F.concat(F.lit("identifier not as expected: "), c)).cast("string")
    return F.when(c.contains(";"), None).when(c.contains(RELATED), "related").when(c.contains(EXACT), "exact").when(c == "None", "none").otherwise(bad)


def single_exact(c: Column) -> Column:
    """The id of a single exact link, else null."""
    v = F.regexp_replace(c, r"^\(skos:exact\)", "")
    return F.when(c.startswith(EXACT) & ~c.contains(",") & ~c.contains(";"), v)


def missing(c: Column) -> Column:
    """Null for the spellings of a missing value: blank, ``None``, ``none``."""
    t = F.trim(c)
    return F.when(F.lower(t).isin("", "none"), None).otherwise(t)


def pmc_id(c: Column) -> Column:
    """A PMC id with its prefix, null if missing."""
    v = missing(c)
    return F.when(v.startswith("PMC"), v).otherwise(F.concat(F.lit("PMC"), v))


def infon(m: Column, key: str, default: str | None = None) -> Column:
    """An attribute of the map, or the default."""
    v = F.try_element_at(m, F.lit(key))
    return v if default is None else F.coalesce(v, F.lit(default))
