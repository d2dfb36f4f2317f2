"""Whole acquisition runs: pages to links to files, budget documents and policy documents."""

from __future__ import annotations

import http.cookiejar
import urllib.request
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalith.session import cut_lineage, ship_package
from fiscalith.sources import discovery as D
from fiscalith.sources.download import HEADERS, as_links, download

_PAGES = "fiscal_year int, page string, html string, error string"


def warmed_opener(home: str | None = None, timeout: float = 30.0):
    """An opener that keeps cookies and has called on ``home`` once, as a browser would have; a home that does not answer is no fault."""
    opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()))
    opener.addheaders = list(HEADERS.items())
    if home:
        try:
            opener.open(home, timeout=timeout).read()
        except OSError:
            pass
    return opener


def fetch_pages(pages: DataFrame, home: str | None = None, parallel: int = 4) -> DataFrame:
    """``fiscal_year``, ``page``, ``html`` and ``error`` of web pages: one that does not answer has an error and stops no other."""
    ship_package(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = warmed_opener(home)
        for frame in frames:
            rows = []
            for year, page in zip(frame["fiscal_year"], frame["page"]):
                try:
                    with opener.open(page, timeout=60) as answer:
                        rows.append((year, page, answer.read().decode("utf-8", "replace"), None))
                except OSError as fault:
                    rows.append((year, page, None, f"{type(fault).__name__}: {fault}"))
            yield pd.DataFrame(rows, columns=["fiscal_year", "page", "html", "error"])

    return pages.select("fiscal_year", "page").repartition(parallel).mapInPandas(run, _PAGES)


def budget_pages(spark: SparkSession, fiscal_years: Sequence[int], address: str = D.BUDGET_PAGE) -> DataFrame:
    return spark.createDataFrame([(y, address.format(year=y)) for y in fiscal_years], "fiscal_year int, page string")


def budget_documents(
    spark: SparkSession,
    fiscal_years: Sequence[int],
    folder: str,
    exhibit_types: Sequence[str] = tuple(D.EXHIBITS_IN_URL),
    components: Sequence[str] = (),
    discover_only: bool = False,
    address: str = D.BUDGET_PAGE,
    home: str | None = None,
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Years times exhibits: the manifest of documents linked on the budget pages, the outcome of each download, and the pages that did not answer.

    A link counts once for each exhibit type that its address fits; ``components`` limits them further. With ``discover_only`` nothing is fetched but the
    pages, and the outcome is null. Files go to ``folder``/year/exhibit/name; what is there already is not fetched again.
    """
    pages = cut_lineage(fetch_pages(budget_pages(spark, fiscal_years, address), home))
    links = D.document_links(pages.where(F.col("html").isNotNull()), "page", "html").where(F.col("exhibit_type").isin(*exhibit_types))
    if components:
        links = links.where(F.col("component").isin(*components))
    manifest = links.join(pages.select(F.col("page").alias("page_source"), "fiscal_year"), "page_source").distinct()
    unread = pages.where(F.col("error").isNotNull()).select("fiscal_year", "page", "error")
    if discover_only:
        return manifest, None, unread
    manifest = cut_lineage(manifest)
    place = F.concat_ws("/", F.lit(folder), F.col("fiscal_year").cast("string"), "exhibit_type", "filename")
    wanted = manifest.groupBy(place.alias("path")).agg(F.array_sort(F.collect_set("url")).alias("urls"))
    return manifest, cut_lineage(download(wanted)), unread


def policy_documents(spark: SparkSession, folder: str, fiscal_years: Sequence[int] | None = None, doc_types: Sequence[str] = ("NDAA", "NDS", "NSS")) -> DataFrame:
    """Acts and strategies by type: the outcome of each download, with ``doc_type`` and ``year``; acts are tried at each of their addresses in turn."""
    acts = D.authorization_candidates(spark, fiscal_years).select(F.lit("NDAA").alias("doc_type"), F.col("fiscal_year").alias("year"), "attempt", "url")
    known = spark.createDataFrame(D.STRATEGY_URLS, "doc_type string, year int, url string").withColumn("attempt", F.lit(0))
    wanted = acts.unionByName(known).where(F.col("doc_type").isin(*doc_types))
    links = as_links(wanted, folder, ["doc_type", "year"])
    return cut_lineage(download(links).join(links.select("path", "doc_type", "year"), "path"))


def policy_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Policy documents in a folder: doc_type and year by name (``TYPE_year.pdf``), size in KB."""
    files = D.scan_folder(spark, folder, pattern="*.pdf")
    parts = F.split(F.regexp_replace("filename", r"\.pdf$", ""), "_")
    return files.select(F.get(parts, 0).alias("doc_type"), D.year_of_name(F.col("filename")).alias("year"), "filename", F.floor(F.col("size_bytes") / 1024).alias("size_kb"))
