"""Canonical forms of identifiers and of small vocabularies, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any sort, for Java patterns (``\s`` alone is ASCII there).
ANY_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
#: A character that is not white space.
NON_SPACE = r"[^\s\p{Z}\x{85}\x{1c}-\x{1f}]"

# Agency names by their letters alone.
AGENCIES = {
    "army": "Army",
    "navy": "Navy",
    "airforce": "Air Force",
    "af": "Air Force",
    "spaceforce": "Space Force",
    "sf": "Space Force",
    "defensewide": "Defense-Wide",
    "dw": "Defense-Wide",
    "ote": "OT&E",
}


def canonical_pe_number(c: Column) -> Column:
    """Seven digits (lost leading zeros restored) and the suffix in upper case; null for a value without digits in front."""
    bare = F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    digits = F.regexp_extract(bare, "^([0-9]+)", 1)
    padded = F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits)
    return F.when(F.length(digits) > 0, F.concat(padded, F.regexp_extract(bare, "^[0-9]+(.*)$", 1)))


def canonical_agency(c: Column) -> Column:
    """One of the six agencies; an unknown value keeps its own trimmed text."""
    letters = F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    known = F.create_map(*[F.lit(x) for pair in AGENCIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, letters), F.trim(c))


def canonical_funding_type(c: Column) -> Column:
    """``PY Actual``, ``CY Request`` or ``BY Request``; null where none of them is meant."""
    letters = F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    return (
        F.when(letters.rlike("^(py|prioryear)"), F.lit("PY Actual"))
        .when(letters.rlike("^(cy|currentyear)"), F.lit("CY Request"))
        .when(letters.rlike("^(by|budgetyear)"), F.lit("BY Request"))
    )


def four_digit_year(c: Column, first: int = 1996) -> Column:
    """A year in ``first .. first + 99`` for one written with two digits; other values as they are."""
    y = c.cast("int")
    century = first - first % 100
    full = F.when(y + century < first, y + century + 100).otherwise(y + century)
    return F.when(y.between(0, 99), full).otherwise(y)


def folded_text(c: Column) -> Column:
    """Lower case, each run of white space one blank, none at the ends; null stays null."""
    one = F.regexp_replace(F.lower(F.upper(c)), ANY_SPACE + "+", " ")
    return F.trim(one)


def usable_number(c: Column) -> Column:
    """``c`` where it is a finite number, else null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
