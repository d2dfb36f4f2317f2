"""Text as column expressions: query preparation, acronyms, pages, paragraphs, listing rows.

Patterns are Java's: ``(?U)`` makes ``\\w``, ``\\s`` and ``\\b`` cover Unicode, ``(?d)`` makes only a line feed end a line.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal in a title.
STOP_WORDS = [
    "program", "programs", "project", "projects",
    "system", "systems", "development", "technologies", "technology",
    "demonstration", "prototype", "prototypes", "management", "support",
    "research", "test", "evaluation", "initiative", "initiatives",
    "capability", "capabilities", "activities", "activity",
    "advanced",
    "the", "and", "for", "of", "in", "with", "to", "a", "an",
]

# Stop words of the older normaliser.
LEGACY_STOP_WORDS = [
    "project", "program", "system", "systems", "development",
    "advanced", "demonstration", "prototype", "prototypes", "management", "support",
]

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "uav": "unmanned aerial vehicle",
    "uas": "unmanned aircraft system",
    "uavs": "unmanned aerial vehicles",
    "ugv": "unmanned ground vehicle",
    "usv": "unmanned surface vehicle",
    "uuv": "unmanned undersea vehicle",
    "atk": "attack",
    "aaw": "anti air warfare",
    "amd": "air missile defense",
    "amdr": "air missile defense radar",
    "sam": "surface to air missile",
    "gbsd": "ground based strategic deterrent",
    "lrasm": "long range anti ship missile",
    "lrpf": "long range precision fires",
    "himars": "high mobility artillery rocket system",
    "jassm": "joint air to surface standoff missile",
    "jdam": "joint direct attack munition",
    "ew": "electronic warfare",
    "isr": "intelligence surveillance reconnaissance",
    "sigint": "signals intelligence",
    "elint": "electronic intelligence",
    "imint": "imagery intelligence",
    "geoint": "geospatial intelligence",
    "aesa": "active electronically scanned array",
    "irst": "infrared search and track",
    "lidar": "light detection and ranging",
    "c2": "command control",
    "c3": "command control communications",
    "c3i": "command control communications intelligence",
    "c4isr": "command control communications computers intelligence surveillance reconnaissance",
    "jadc2": "joint all domain command and control",
    "link16": "link 16 tactical data link",
    "satcom": "satellite communications",
    "comms": "communications",
    "ltamds": "lower tier air missile defense sensor",
    "ltamd": "lower tier air missile defense",
    "ngad": "next generation air dominance",
    "b21": "b 21 raider bomber",
    "f35": "f 35 lightning joint strike fighter",
    "f22": "f 22 raptor",
    "ch47": "chinook helicopter",
    "uh60": "black hawk helicopter",
    "ah64": "apache helicopter",
    "v22": "v 22 osprey tiltrotor",
    "ftuas": "future tactical unmanned aircraft system",
    "m-shorad": "maneuver short range air defense",
    "mshorad": "maneuver short range air defense",
    "shorad": "short range air defense",
    "ibcs": "integrated battle command system",
    "ngcv": "next generation combat vehicle",
    "omfv": "optionally manned fighting vehicle",
    "abrams": "m1 abrams tank",
    "bradley": "m2 bradley infantry fighting vehicle",
    "gps": "global positioning system",
    "pnt": "positioning navigation timing",
    "sbirs": "space based infrared system",
    "opir": "overhead persistent infrared",
    "leo": "low earth orbit",
    "geo": "geosynchronous orbit",
    "meo": "medium earth orbit",
    "ai": "artificial intelligence",
    "ml": "machine learning",
    "c2c": "cyber to cyber",
    "a2ad": "anti access area denial",
    "adv": "advanced",
    "dev": "development",
    "dem": "demonstration",
    "val": "validation",
    "eng": "engineering",
    "mod": "modernization",
    "mil": "military",
    "ops": "operations",
    "intel": "intelligence",
    "recon": "reconnaissance",
    "surv": "surveillance",
    "maint": "maintenance",
    "log": "logistics",
    "med": "medical",
    "chem": "chemical",
    "bio": "biological",
    "nuc": "nuclear",
    "cbrn": "chemical biological radiological nuclear",
    "wmd": "weapons of mass destruction",
    "socom": "special operations command",
    "sof": "special operations forces",
    "darpa": "defense advanced research projects agency",
    "mda": "missile defense agency",
    "disa": "defense information systems agency",
    "dia": "defense intelligence agency",
    "nga": "national geospatial intelligence agency",
    "nro": "national reconnaissance office",
    "nsa": "national security agency",
    "dtra": "defense threat reduction agency",
}

# Capitals that are no acronym of a program.
GENERIC_CAPITALS = ["US", "DoD", "NATO", "RDT", "MIP", "OCO", "LEO", "GEO", "MEO", "SOF", "OSD"]

# Budget activities by act code.
BUDGET_ACTIVITIES = {
    "01": "BA1 - Basic Research",
    "02": "BA2 - Applied Research",
    "03": "BA3 - Advanced Technology Development",
    "04": "BA4 - Advanced Component Development & Prototypes",
    "05": "BA5 - System Development & Demonstration",
    "06": "BA6 - Management Support",
    "07": "BA7 - Operational Systems Development",
    "08": "BA8 - Software And Digital Technology Pilot Programs",
    "20": "BA20 - Continuing Resolution Programs",
}

# Labels of subtotal lines.
SUBTOTAL_LABELS = [
    "basic research",
    "applied research",
    "advanced technology development",
    "advanced component development & prototypes",
    "advanced component development and prototypes",
    "system development & demonstration",
    "system development and demonstration",
    "management support",
    "operational systems development",
    "software and digital technology pilot programs",
]

# Components by abbreviation and by a part of their name, in order.
COMPONENT_ABBREVIATIONS = {"af": "Air Force", "ar": "Army", "na": "Navy", "dw": "Defense-Wide", "ote": "OT&E", "sf": "Space Force"}
COMPONENT_NAMES = {
    "army": "Army",
    "navy": "Navy",
    "air force": "Air Force",
    "space force": "Space Force",
    "defense-wide": "Defense-Wide",
    "defense wide": "Defense-Wide",
    "defensewide": "Defense-Wide",
    "operational test": "OT&E",
}

# Patterns of the listing and of policy documents.
PE_NUMBER = "^[0-9]{7,9}[A-Z0-9]{0,3}$"
APPROPRIATION = (
    r"(?imdU)Appropriation:\s*\S+\s+(Research,\s+Development,\s+Test(?:,?\s+and\s+Evaluation|\s*&\s*Eval)[,\s]+(.+?))\s*$"
)
OTE_APPROPRIATION = r"(?imdU)Appropriation:\s*\S+\s+Operational\s+Test\s+and\s+Evaluation"
OTHER_APPROPRIATION = (
    r"(?idU)Appropriation:\s*\S+\s+(?:Defense Health Program|Office of the Inspector General|Chemical Agents|National Defense Sealift)"
)
DATA_ROW = r"(?sd)^\s*(\d+)\s+([0-9]{7,9}[A-Z0-9]{0,3})\s+(.+?)\s{2,}(\d{2})\s+(.*?)\s*$"
CONTINUATION = r"(?d)^\s{5,}([A-Za-z(].+?)\s*$"
SECTION = r"^(?:SEC(?:TION)?\.?\s+)(\d+[A-Z]?)\.\s*(.{0,200}?)(?:\.|$)"
SKIPPED_TITLE = (
    r"(?i)^(?:short title|table of contents|definitions|authorization of appropriations|amounts authorized|findings|sense of congress"
    r"|effective date|severability|repeals?|amendments? to title)"
)
HEADING = r"(?md)^([A-Z][A-Z\s\&\-]{3,60}|[IVX]+\.\s+[A-Z][A-Z\s]{3,})\s*$"
PAGE_FURNITURE = r"(?i)^(UNCLASSIFIED|PUBLIC LAW|ENROLLED BILL|GPO|U\.S\. GOVERNMENT|www\.|https?://)"
PRIORITY_WORDS = (
    r"(?i)\b(program|system|capability|technology|development|research|weapon|missile|aircraft|ship|cyber|space|intelligence|hypersonic"
    r"|unmanned|autonomous|artificial intelligence|directed energy|electronic warfare|C2|command and control|modernization|acquisition"
    r"|prototype|demonstration)\b"
)


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def stripped(c: Column) -> Column:
    """Without white space of any sort at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The parts between white space; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


# -- queries and titles --------------------------------------------------------------------------------------------------


def detected_pe_number(c: Column) -> Column:
    """The PE number that a text is, or holds; null if none."""
    whole = F.replace(F.upper(stripped(c)), F.lit(" "), F.lit(""))
    inside = F.regexp_extract(F.upper(c), r"(?U)\b([0-9]{7,9}[A-Z0-9]{0,3})\b", 1)
    return F.when(whole.rlike(PE_NUMBER), whole).when(inside != "", inside)


def query_acronyms(c: Column) -> Column:
    """Acronym candidates of a query, those in parentheses first, each once."""
    found = F.concat(
        F.regexp_extract_all(c, F.lit(r"\(([A-Z0-9][A-Z0-9\-]{1,})\)"), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"(?U)\b([A-Z][A-Z0-9\-]{1,})\b"), F.lit(1)),
    )
    bare = F.transform(found, lambda a: F.regexp_replace(a, "^-+|-+$", ""))
    return F.array_distinct(F.filter(bare, lambda a: a != ""))


def acronym_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)[\s\-]", ""))


def title_acronyms(c: Column) -> Column:
    """Acronym keys of a title: those in parentheses, else its words in capitals that are not generic."""
    inside = F.regexp_extract_all(c, F.lit(r"\(([A-Z][A-Z0-9\-]{1,})\)"), F.lit(1))
    capitals = F.regexp_extract_all(c, F.lit(r"(?U)\b([A-Z][A-Z0-9]{2,})\b"), F.lit(1))
    use = F.when(F.size(inside) > 0, inside).otherwise(F.filter(capitals, lambda a: ~a.isin(GENERIC_CAPITALS)))
    return F.array_distinct(F.transform(use, acronym_key))


def normalized(c: Column) -> Column:
    """Lower case, punctuation and hyphens to blanks, stop words gone."""
    plain = F.replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s\-]", " "), F.lit("-"), F.lit(" "))
    return F.array_join(F.filter(words(plain), lambda w: ~w.isin(STOP_WORDS)), " ")


def expanded(normal: Column, extra: Mapping[str, str] | None = None) -> Column:
    """Abbreviations replaced word by word; ``extra`` adds to or overrides the built-in ones."""
    known = literal_map({**ABBREVIATIONS, **(extra or {})})
    return F.array_join(F.transform(words(normal), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def processed_query(c: Column, extra: Mapping[str, str] | None = None) -> Column:
    """raw, pe_number_detected, acronyms, normalized, expanded and tokens of a query as a struct.

    A query that is or holds a PE number is that number and nothing else. Null is treated as an empty text.
    """
    raw = stripped(F.coalesce(c, F.lit("")))
    number = detected_pe_number(raw)
    normal = F.coalesce(number, normalized(raw))
    full = F.coalesce(number, expanded(normalized(raw), extra))
    none = F.array().cast("array<string>")
    return F.struct(
        raw.alias("raw"),
        number.alias("pe_number_detected"),
        F.when(number.isNull(), query_acronyms(raw)).otherwise(none).alias("acronyms"),
        normal.alias("normalized"),
        full.alias("expanded"),
        words(full).alias("tokens"),
    )


def legacy_normalized(c: Column) -> Column:
    """The older normaliser: lower case, ASCII punctuation deleted, its stop words gone; empty for null."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{Punct}", "")
    return F.array_join(F.filter(words(bare), lambda w: ~w.isin(LEGACY_STOP_WORDS)), " ")


# -- listing -------------------------------------------------------------------------------------------------------------


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first letter."""
    parts = F.split(F.lower(c), r"(?<=[^a-z])(?=[a-z])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def component(c: Column) -> Column:
    """A component from the text of a page header; an unknown one in title case."""
    clean = F.lower(stripped(F.regexp_replace(c, r"(?U)\s+", " ")))
    short = literal_map(COMPONENT_ABBREVIATIONS)
    first = F.trim(F.substring_index(clean, ",", 1))
    out = F.coalesce(F.try_element_at(short, clean), F.try_element_at(short, first))
    by_name = F.coalesce(*[F.when(clean.contains(part), F.lit(name)) for part, name in COMPONENT_NAMES.items()])
    return F.coalesce(out, by_name, title_case(stripped(c)))


def appropriation(page: Column) -> Column:
    """``appropriation`` and ``component`` of a page header as a struct; null without one."""
    name = F.regexp_extract(page, APPROPRIATION, 1)
    raw = F.regexp_replace(F.regexp_extract(page, APPROPRIATION, 2), r"(?idU)\s+Date:.*$", "")
    who = component(F.regexp_replace(stripped(raw), r"[.,]+$", ""))
    ote = F.struct(F.lit("Operational Test and Evaluation, Defense").alias("appropriation"), F.lit("OT&E").alias("component"))
    found = F.struct(stripped(name).alias("appropriation"), who.alias("component"))
    return F.when(page.rlike(APPROPRIATION), found).when(page.rlike(OTE_APPROPRIATION), ote)


def is_subtotal(c: Column) -> Column:
    return F.lower(stripped(F.regexp_replace(c, r"[\d,\s*]+$", ""))).isin(SUBTOTAL_LABELS)


def amounts(c: Column) -> Column:
    """``py``, ``cy`` and ``by`` of an amounts string by its gaps of two blanks or more: of two values the second is ``by``."""
    parts = F.filter(F.split(stripped(F.coalesce(c, F.lit(""))), r"\s{2,}"), lambda p: F.trim(p) != "")

    def number(i: int) -> Column:
        return F.regexp_replace(F.trim(F.get(parts, i)), "[,*]", "").try_cast("double")

    n = F.size(parts)
    return F.struct(
        number(0).alias("py"), F.when(n >= 3, number(1)).alias("cy"), F.when(n >= 3, number(2)).when(n == 2, number(1)).alias("by")
    )


def budget_activity(act_code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(BUDGET_ACTIVITIES), act_code), F.concat(F.lit("BA"), act_code))


def surrogate_pe_number(number: Column, agency: Column, act_code: Column, fiscal_year: Column, classified: Column) -> Column:
    """The number, or a made-up key for a classified or unnumbered line."""
    made = F.concat_ws("_", F.lit("CLASSIFIED"), agency, F.coalesce(act_code, F.lit("")), fiscal_year.cast("string"))
    bare = F.trim(F.coalesce(number, F.lit("")))
    return F.when(classified | (bare == ""), made).otherwise(bare)


# -- pages and paragraphs ------------------------------------------------------------------------------------------------


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def cleaned_page(c: Column) -> Column:
    """Lines trimmed, page numbers and furniture gone, at most one empty line in a row."""
    lines = F.transform(F.split(c, "\n", -1), stripped)
    kept = F.filter(lines, lambda x: (x == "") | ~(x.rlike(r"(?U)^\d+$") | x.rlike(PAGE_FURNITURE)))
    return stripped(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def paragraphs(c: Column, separator: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(c, separator, -1), stripped), lambda p: p != "")


def carried(items: Column, kind: str, default: Column) -> Column:
    """``items`` with each null replaced by the last element before it, ``default`` until the first; ``kind`` is the element type."""
    none = F.array().cast(f"array<{kind}>")
    return F.aggregate(
        items, none, lambda done, x: F.concat(done, F.array(F.coalesce(x, F.try_element_at(done, F.lit(-1)), default).cast(kind)))
    )
