"""Whole runs: listing files to tables, tables to a report, policy files to chunks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiscalith.plans.chunking import section_chunks, window_chunks
from fiscalith.plans.ingest import replace_documents, star_schema
from fiscalith.plans.linking import link_two_stage
from fiscalith.plans.listing import deduplicated, file_rows
from fiscalith.plans.trends import agency_trends, facts, funding_gaps, elements, pe_trends
from fiscalith.sources.discovery import file_name, fiscal_year_of_name, year_of_name
from fiscalith.sources.pages import TEXT, extract, extract_with_fallback, read_binary
from fiscalith.session import cut_lineage
from fiscalith.sources.sinks import save_by, write_workbook
from fiscalith.sources.tables import table_exists

LISTING_COLUMNS = [
    "fiscal_year", "component", "appropriation", "budget_activity", "pe_number", "pe_title", "line_no", "act_code", "is_classified",
    "py_amount", "cy_amount", "by_amount", "source_file", "extraction_method",
]


def parse_listings(
    files: DataFrame, extractor: Callable[[bytes], str], recognizer: Callable[[bytes], str], out: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of all listing files in one job, and the files that could not be read with the reason.

    ``files`` has path and content. Rows are deduplicated and sorted by year, component and line; with ``out`` they are also written, partitioned by
    fiscal year, so that a later run of some years replaces only these.
    """
    texts = extract_with_fallback(files, extractor, recognizer)
    bad = texts.where(F.col("error").isNotNull()).select("path", "error")
    named = texts.where(F.col("error").isNull()).withColumn("source_file", file_name(F.col("path")))
    parsed = file_rows(named, "source_file", "text")
    about = named.select("source_file", "extraction_method", fiscal_year_of_name(F.col("path")).alias("fiscal_year")).distinct()
    rows = deduplicated(parsed.join(about, "source_file"), ["line_no", "page", "line"]).select(*LISTING_COLUMNS)
    if out is not None:
        save_by(rows, out, ["fiscal_year"])
    order = [F.asc_nulls_last(c) for c in ("fiscal_year", "component", "line_no")]
    return rows.orderBy(*order), bad


def parse_policies(
    texts: DataFrame, existing: DataFrame | None = None, replace: bool = False, doc_types: Sequence[str] = (), years: Sequence[int] = ()
) -> DataFrame:
    """Chunks of policy texts (filename, doc_type, text): acts by sections, all others, those of no type included, by windows.

    Documents that ``existing`` has are skipped, or with ``replace`` swapped. The fiscal year is that of the name for acts alone.
    """
    chosen = texts.withColumn("doc_year", year_of_name(F.col("filename")))
    if doc_types:
        chosen = chosen.where(F.col("doc_type").isin(*doc_types))
    if years:
        chosen = chosen.where(F.col("doc_year").isin(*years))
    is_act = F.col("doc_type").eqNullSafe("NDAA")
    acts = section_chunks(chosen.where(is_act), "filename", "text")
    others = window_chunks(chosen.where(~is_act), "filename", "text").select(
        "filename",
        (F.row_number().over(Window.partitionBy("filename").orderBy("page_number", "window")) - 1).alias("chunk_index"),
        "page_number",
        F.lit(None).cast("string").alias("section_id"),
        "section_title",
        "text",
        "token_count",
    )
    about = chosen.select("filename", "doc_type", "doc_year", F.when(F.col("doc_type") == "NDAA", F.col("doc_year")).alias("fiscal_year"))
    fresh = acts.unionByName(others).join(about, "filename")
    return fresh if existing is None else replace_documents(existing, fresh, "filename", replace)


def read_policies(spark: SparkSession, folders: Mapping[str, str], extractor: Callable[[bytes], str] = TEXT, pattern: str = "*.pdf") -> tuple[DataFrame, DataFrame]:
    """Texts of the policy files in the folder of each type, as ``parse_policies`` takes them, and the files that could not be read."""
    found = None
    for doc_type, folder in folders.items():
        one = extract(read_binary(spark, folder, pattern), extractor).withColumn("doc_type", F.lit(doc_type))
        found = one if found is None else found.unionByName(one)
    found = cut_lineage(found.withColumn("filename", file_name(F.col("path"))))
    return found.where("error IS NULL").select("filename", "doc_type", "text"), found.where("error IS NOT NULL").select("path", "error")


def load_star(rows: DataFrame, out: str) -> dict[str, DataFrame]:
    """Parsed rows put to the star schema in ``out``, which is made if it is not there; running it again changes nothing.

    All three tables are worked out and written to the shared folder before the first of the old ones is replaced.
    """
    spark = rows.sparkSession
    names = ("source_documents", "program_elements", "funding_lines")
    existing = {n: spark.read.parquet(f"{out}/{n}.parquet") for n in names} if table_exists(spark, f"{out}/{names[0]}.parquet") else None
    tables = {name: cut_lineage(df) for name, df in star_schema(rows, ["filename", "line_no", "pe_title"], existing).items()}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    return {name: spark.read.parquet(f"{out}/{name}.parquet") for name in names}


def executive_report(spark: SparkSession, folder: str, queries: Sequence[str], first: int, last: int, path: str) -> dict[str, DataFrame]:
    """Links ``queries``, and writes gaps, agency trends and the fifty largest element trends as a workbook."""
    e, f = elements(spark, folder), facts(spark, folder)
    linked = link_two_stage(spark.createDataFrame([(q,) for q in queries], "query string"), e)
    sheets = {
        "Funding Gaps": funding_gaps(linked, f, last - 1, last),
        "Agency Trends": agency_trends(f, e, first, last).orderBy(F.desc(f"`{last}`")),
        "Top Elements": pe_trends(f, e, first, last).orderBy(F.desc(f"`{last}`"), "pe_number").limit(50),
    }
    write_workbook(sheets, path)
    return sheets
