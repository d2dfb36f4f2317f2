"""What paths, names, URLs and pages say about a document, as column expressions, and directory scans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Component keys and labels, in the order in which they are tried.
COMPONENTS = {
    "army": "Army",
    "navy": "Navy",
    "af": "AirForce",
    "usmc": "Marines",
    "socom": "SOCOM",
    "darpa": "DARPA",
    "mda": "MDA",
    "disa": "DISA",
    "dia": "DIA",
    "nga": "NGA",
    "nro": "NRO",
    "nsa": "NSA",
    "dod_wide": "OSD",
}
# Exhibit types by a part of a path, and by a part of a URL.
EXHIBITS_IN_PATH = {"rdtee": r"r-?2|rdtee|rdte", "procurement": r"p-?40|procurement", "om": r"o-?1|o&m|oper"}
EXHIBITS_IN_URL = {
    "rdtee": r"[-_](r2|rdtee|rdte)[-_.]",
    "procurement": r"[-_](p40|p-40|procurement)[-_.]",
    "om": r"[-_](o1|o-1|om|o&m)[-_.]",
}
BUDGET_PAGE = "https://comptroller.defense.gov/Budget-Materials/Budget{year}/"
# Strategy documents by year.
STRATEGY_URLS = [
    ("NDS", 2022, "https://media.defense.gov/2022/Oct/27/2003103845/-1/-1/1/2022-NATIONAL-DEFENSE-STRATEGY-NPR-MDR.PDF"),
    ("NDS", 2018, "https://dod.defense.gov/Portals/1/Documents/pubs/2018-National-Defense-Strategy-Summary.pdf"),
    ("NDS", 2014, "https://media.defense.gov/2014/Mar/14/2001384272/-1/-1/1/2014_QUADRENNIAL_DEFENSE_REVIEW.PDF"),
    ("NSS", 2025, "https://www.whitehouse.gov/wp-content/uploads/2025/12/2025-National-Security-Strategy.pdf"),
    (
        "NSS",
        2022,
        "https://bidenwhitehouse.archives.gov/wp-content/uploads/2022/10/Biden-Harris-Administrations-National-Security-Strategy-10.2022.pdf",
    ),
    ("NSS", 2017, "https://trumpwhitehouse.archives.gov/wp-content/uploads/2017/12/NSS-Final-12-18-2017-0905.pdf"),
    ("NSS", 2015, "https://obamawhitehouse.archives.gov/sites/default/files/docs/2015_national_security_strategy_2.pdf"),
    ("NSS", 2010, "https://obamawhitehouse.archives.gov/sites/default/files/rss_viewer/national_security_strategy.pdf"),
    ("NSS", 2006, "https://georgewbush-whitehouse.archives.gov/nsc/nss/2006/nss2006.pdf"),
    ("NSS", 2002, "https://georgewbush-whitehouse.archives.gov/nsc/nss/2002/nss.pdf"),
]
# Fiscal year, congress, bill, chamber, number of the public law. The one of 2019 is that of 2018 as published.
AUTHORIZATION_BILLS = [
    (2025, 118, 5009, "hr", 159),
    (2024, 118, 2670, "hr", 31),
    (2023, 117, 7776, "hr", 263),
    (2022, 117, 1605, "s", 81),
    (2021, 116, 6395, "hr", 283),
    (2020, 116, 2500, "hr", 92),
    (2019, 115, 2810, "hr", 91),
    (2018, 115, 2810, "hr", 91),
    (2017, 114, 4909, "hr", 328),
    (2016, 114, 1735, "hr", 92),
    (2015, 113, 4435, "hr", 291),
    (2014, 113, 1960, "hr", 66),
    (2013, 112, 4310, "hr", 239),
    (2012, 112, 1540, "hr", 81),
    (2011, 111, 5136, "hr", 383),
    (2010, 111, 2647, "hr", 84),
    (2009, 110, 4986, "hr", 417),
    (2008, 110, 1585, "hr", 181),
    (2007, 109, 5122, "hr", 364),
    (2006, 109, 1815, "hr", 163),
    (2005, 108, 4200, "hr", 375),
]


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def fiscal_year_of_path(path: Column) -> Column:
    """A part that is a year from 2000 to 2040, else the year after ``fy`` or ``pb`` anywhere, else null."""
    years = F.filter(F.split(path, "/"), lambda p: p.rlike("^[0-9]{4}$") & p.try_cast("int").between(2000, 2040))
    named = F.nullif(F.regexp_extract(path, r"(?i)(?:fy|pb)(\d{4})", 1), F.lit(""))
    return F.coalesce(F.get(years, 0).cast("int"), named.cast("int"))


def fiscal_year_of_name(path: Column) -> Column:
    """The same for listings: the name alone is searched, and 0 stands for unknown."""
    years = F.filter(F.split(path, "/"), lambda p: p.rlike("^[0-9]{4}$") & p.try_cast("int").between(2000, 2040))
    named = F.nullif(F.regexp_extract(file_name(path), r"(?:fy|pb|FY)(\d{4})", 1), F.lit(""))
    return F.coalesce(F.get(years, 0).cast("int"), named.cast("int"), F.lit(0))


def year_of_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d{4})", 1), F.lit("")).cast("int"), F.lit(0))


def exhibit_of_path(path: Column) -> Column:
    """The exhibit type of the first part that has one; of several in a part, the first type listed."""
    found = F.transform(
        F.split(F.lower(path), "/"), lambda p: F.coalesce(*[F.when(p.rlike(r), F.lit(t)) for t, r in EXHIBITS_IN_PATH.items()])
    )
    return F.coalesce(F.get(F.filter(found, lambda t: t.isNotNull()), 0), F.lit("unknown"))


def component_of(text: Column) -> Column:
    """The first component whose key or label occurs in a name or URL."""
    low = F.lower(text)
    tests = [F.when(low.contains(k) | low.contains(v.lower()), F.lit(k)) for k, v in COMPONENTS.items()]
    return F.coalesce(*tests, F.lit("unknown"))


def safe_file_name(url: Column, default: str = "document.pdf") -> Column:
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit(default))


def joined_url(base: Column, href: Column) -> Column:
    """``href`` made absolute against the page it stands on."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.substring_index(base, "//", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )


def document_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Links to PDF and ZIP files on HTML pages: page, absolute URL, file name, component and each exhibit type it fits."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    links = (
        pages.select(F.col(url).alias("page_source"), F.explode(hrefs).alias("href"))
        .select("page_source", F.trim("href").alias("href"))
        .where(F.col("href").rlike(r"(?i)\.(pdf|zip)$"))
        .withColumn("url", joined_url(F.col("page_source"), F.col("href")))
    )
    kinds = F.array_compact(F.array(*[F.when(F.col("url").rlike(f"(?i){r}"), F.lit(t)) for t, r in EXHIBITS_IN_URL.items()]))
    return links.select(
        "page_source", "url", safe_file_name(F.col("url")).alias("filename"), component_of(F.col("url")).alias("component"), F.explode_outer(kinds).alias("exhibit_type")
    )


def strategy_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Strategy documents linked on a page, with the year in their address (0 if none)."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    links = pages.select(F.col(url).alias("page_source"), F.explode(hrefs).alias("href"))
    low = F.lower("href")
    wanted = low.contains(".pdf") & (low.contains("nds") | low.contains("defense-strategy") | low.contains("strategy"))
    year = F.coalesce(F.nullif(F.regexp_extract("href", r"(20\d{2})", 1), F.lit("")).cast("int"), F.lit(0))
    return links.where(wanted).select("page_source", year.alias("year"), joined_url(F.col("page_source"), F.col("href")).alias("url"))


def govinfo_url(congress: Column, bill: Column, chamber: Column) -> Column:
    name = F.concat(F.lit("BILLS-"), congress.cast("string"), chamber, bill.cast("string"), F.lit("enr"))
    return F.concat(F.lit("https://www.govinfo.gov/content/pkg/"), name, F.lit("/pdf/"), name, F.lit(".pdf"))


def public_law_url(congress: Column, law: Column) -> Column:
    name = F.concat(F.lit("PLAW-"), congress.cast("string"), F.lit("publ"), law.cast("string"))
    return F.concat(F.lit("https://www.govinfo.gov/content/pkg/"), name, F.lit("/pdf/"), name, F.lit(".pdf"))


def bill_page_url(congress: Column, bill: Column, chamber: Column) -> Column:
    kind = F.when(chamber == "hr", "house-bill").otherwise("senate-bill")
    return F.concat(
        F.lit("https://www.congress.gov/bill/"), congress.cast("string"), F.lit("th-congress/"), kind, F.lit("/"), bill.cast("string"), F.lit("/text")
    )


def authorization_candidates(spark: SparkSession, fiscal_years: Iterable[int] | None = None) -> DataFrame:
    """Per fiscal year the addresses to try in order; a year that is not known gives none."""
    known = spark.createDataFrame(AUTHORIZATION_BILLS, "fiscal_year int, congress int, bill int, chamber string, law int")
    if fiscal_years is not None:
        known = known.where(F.col("fiscal_year").isin(*fiscal_years))
    c, b, h, n = (F.col(x) for x in ("congress", "bill", "chamber", "law"))
    return known.select("fiscal_year", F.posexplode(F.array(govinfo_url(c, b, h), public_law_url(c, n), bill_page_url(c, b, h))).alias("attempt", "url"))


def is_html_body(content_type: Column, body: Column) -> Column:
    """Whether a download that should be a PDF is a web page instead."""
    head = F.lower(F.decode(F.substring(body, 1, 500), "ISO-8859-1"))
    return F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html") | head.contains("<html")


def fiscal_year_filter(fiscal_year: Column) -> Column:
    """Start and end date that the award service takes for a fiscal year."""
    return F.struct(
        F.date_format(F.make_date(fiscal_year - 1, F.lit(10), F.lit(1)), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.make_date(fiscal_year, F.lit(9), F.lit(30)), "yyyy-MM-dd").alias("end_date"),
    )


def canonical_names(names: Sequence[str]) -> list[str]:
    """Column names in lower case with blanks and slashes as underscores and nothing else but letters, digits, underscores."""
    import re

    return [re.sub(r"[^a-z0-9_]", "", re.sub(r"[\s/]+", "_", n.strip().lower())) for n in names]


def scan_folder(
    spark: SparkSession,
    folder: str,
    fiscal_years: Sequence[int] = (),
    exhibit_types: Sequence[str] = (),
    pattern: str = "*.{pdf,zip}",
    components: Sequence[str] = (),
) -> DataFrame:
    """The manifest of a directory tree: path, name, size and what the path says. Contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    )
    path = F.col("path")
    out = files.select(
        "path",
        file_name(path).alias("filename"),
        F.col("length").alias("size_bytes"),
        fiscal_year_of_path(path).alias("fiscal_year"),
        exhibit_of_path(path).alias("exhibit_type"),
        component_of(file_name(path)).alias("component"),
    )
    if fiscal_years:
        out = out.where(F.col("fiscal_year").isin(*fiscal_years))
    if exhibit_types:
        out = out.where(F.col("exhibit_type").isin(*exhibit_types))
    if components:
        out = out.where(F.col("component").isin(*components))
    return out


def read_page_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Extracted texts of documents, whole: path, filename, text with pages divided by form feeds."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
