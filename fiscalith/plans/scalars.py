"""Queries that hold single functions against SQL, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalith.functions import numeric as N
from fiscalith.functions import text as X
from fiscalith.plans.registry import query
from fiscalith.sources import discovery as D
from fiscalith.sources.tables import read_table

_PATH = "'comptroller/' || publication_year || '/rdtee/' || filename"


@query(
    f"""SELECT id, CAST(coalesce(CASE WHEN publication_year BETWEEN 2000 AND 2040 THEN publication_year END, nullif(regexp_extract(p, '(?i)(?:fy|pb)(\\d{{4}})', 1), '')::INTEGER) AS INTEGER) AS fiscal_year,
      CAST(coalesce(CASE WHEN publication_year BETWEEN 2000 AND 2040 THEN publication_year END, nullif(regexp_extract(filename, '(?:fy|pb|FY)(\\d{{4}})', 1), '')::INTEGER, 0) AS INTEGER) AS listing_year,
      'rdtee' AS exhibit_type, CASE WHEN contains(lower(filename), 'army') THEN 'army' WHEN contains(lower(filename), 'navy') THEN 'navy'
        WHEN contains(lower(filename), 'af') THEN 'af' WHEN contains(lower(filename), 'osd') THEN 'dod_wide' ELSE 'unknown' END AS component
      FROM (SELECT *, {_PATH} AS p FROM source_documents)"""
)
def src02_path_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Year, exhibit type and component of paths (SRC-02..05)."""
    path = F.concat(F.lit("comptroller/"), F.col("publication_year").cast("string"), F.lit("/rdtee/"), "filename")
    return read_table(spark, folder, "source_documents").select(
        "id",
        D.fiscal_year_of_path(path).alias("fiscal_year"),
        D.fiscal_year_of_name(path).alias("listing_year"),
        D.exhibit_of_path(path).alias("exhibit_type"),
        D.component_of(F.col("filename")).alias("component"),
    )


@query(
    r"""SELECT id, 'https://example.org/budget/' || filename AS url, CASE WHEN contains(filename, 'army') THEN 'army'
      WHEN contains(filename, 'navy') THEN 'navy' WHEN contains(filename, 'af') THEN 'af' ELSE 'unknown' END AS component, nullif(regexp_extract(filename, '[-_](r2|rdtee|rdte)[-_.]', 1), '') AS kind
      FROM source_documents"""
)
def src06_page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of generated index pages, relative ones made absolute (SRC-06, SRC-07)."""
    documents = read_table(spark, folder, "source_documents")
    pages = documents.select(
        F.concat(F.lit("https://example.org/budget/index.html?id="), F.col("id").cast("string")).alias("page"),
        F.concat(F.lit("<p><A class='x' href='"), "filename", F.lit("'>t</A><a href=\"/about.html\">no</a></p>")).alias("html"),
    )
    links = D.document_links(pages, "page", "html")
    return links.select(
        F.regexp_extract("page_source", r"id=(\d+)$", 1).cast("bigint").alias("id"),
        "url",
        "component",
        F.nullif(F.regexp_extract("filename", r"[-_](r2|rdtee|rdte)[-_.]", 1), F.lit("")).alias("kind"),
    )


@query(
    """SELECT id, 'https://media.example.org/' || filename AS url, CAST(coalesce(nullif(regexp_extract(filename, '(20\\d{2})', 1), '')::INTEGER, 0) AS INTEGER) AS year
      FROM policy_documents WHERE contains(filename, 'nds')"""
)
def src15_strategy_links(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "policy_documents")
    pages = documents.select(
        F.concat(F.lit("https://media.example.org/?"), F.col("id").cast("string")).alias("page"),
        F.concat(F.lit('<a href="/'), "filename", F.lit('">x</a>')).alias("html"),
    )
    links = D.strategy_links(pages, "page", "html")
    return links.select(F.regexp_extract("page_source", r"\?(\d+)$", 1).cast("bigint").alias("id"), "url", "year")


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({y}, {i}, '{u}')"
        for y, c, b, h, n in D.AUTHORIZATION_BILLS
        for i, u in enumerate(
            (
                f"https://www.govinfo.gov/content/pkg/BILLS-{c}{h}{b}enr/pdf/BILLS-{c}{h}{b}enr.pdf",
                f"https://www.govinfo.gov/content/pkg/PLAW-{c}publ{n}/pdf/PLAW-{c}publ{n}.pdf",
                f"https://www.congress.gov/bill/{c}th-congress/{'house-bill' if h == 'hr' else 'senate-bill'}/{b}/text",
            )
        )
    )
    + ") t(fiscal_year, attempt, url)"
)
def src12_authorization_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of authorization acts in the order in which they are tried (SRC-11..13)."""
    return D.authorization_candidates(spark)


@query(
    "SELECT doc_type, year, url FROM (VALUES " + ", ".join(f"('{t}', {y}, '{u}')" for t, y, u in D.STRATEGY_URLS) + ") t(doc_type, year, url)"
)
def src11_strategy_urls(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(D.STRATEGY_URLS, "doc_type string, year int, url string")


@query(
    """SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
      (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END - 1) || '-10-01' AS start_date,
      (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END) || '-09-30' AS end_date,
      CASE WHEN year(o_orderdate) <= 2001 THEN 'legacy' ELSE 'modern1' END AS era FROM orders"""
)
def scd1_fiscal_years(spark: SparkSession, folder: str) -> DataFrame:
    """Fiscal year windows and eras (SC-D1, SRC-19, SC-M11)."""
    fy = N.fiscal_year_of(F.col("o_orderdate"))
    return read_table(spark, folder, "orders").select(
        "o_orderkey", fy.alias("fiscal_year"), D.fiscal_year_filter(fy).alias("w"), N.era(F.year("o_orderdate")).alias("era")
    ).select("o_orderkey", "fiscal_year", "w.start_date", "w.end_date", "era")


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing,
      strftime(ts, '%Y-%m-%d') AS day FROM events"""
)
def sca5_json_values(spark: SparkSession, folder: str) -> DataFrame:
    """Nested values with a default (SC-A5), timestamps from text or null (SC-D2)."""
    day = F.date_format(F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd")
    return read_table(spark, folder, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"),
        day.alias("day"),
    )


@query(
    """SELECT id, coalesce(nullif(trim(appropriation), ''), 'Unknown') AS appropriation, substr(program_name, 1, 20) AS short_name,
      translate(trim(pe_number), '/-', '__') AS cache_key, program_name || ': ' || coalesce(budget_activity, '') AS context,
      'CLASSIFIED_' || agency || '_' || coalesce(act_code, '') || '_2025' AS surrogate, (line_item_number IS NOT NULL)::INTEGER + (appropriation IS NOT NULL)::INTEGER
        + (budget_activity IS NOT NULL)::INTEGER AS n_filled, TRY_CAST(line_item_number AS INTEGER) AS line_number FROM program_elements"""
)
def prj05_projections(spark: SparkSession, folder: str) -> DataFrame:
    """Defaults, truncation, keys, contexts and casts (PRJ-01, PRJ-05, PRJ-07, PRJ-08, SC-S22..S24, AGG-13)."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("appropriation", "budget_activity")), F.col("line_item_number").isNotNull().cast("int"))
    return read_table(spark, folder, "program_elements").select(
        "id",
        F.coalesce(F.nullif(F.trim("appropriation"), F.lit("")), F.lit("Unknown")).alias("appropriation"),
        F.substring("program_name", 1, 20).alias("short_name"),
        F.translate(F.trim("pe_number"), "/-", "__").alias("cache_key"),
        F.concat("program_name", F.lit(": "), F.coalesce("budget_activity", F.lit(""))).alias("context"),
        X.surrogate_pe_number(F.lit(""), F.col("agency"), F.col("act_code"), F.lit(2025), F.lit(True)).alias("surrogate"),
        filled.alias("n_filled"),
        F.col("line_item_number").try_cast("int").alias("line_number"),
    )


@query(
    """SELECT pe_number, agency, name, CASE WHEN raw_score >= 0.9 THEN 'HIGH' WHEN raw_score >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS badge FROM (
      SELECT p_partkey AS pe_number, p_type AS agency, p_name AS name, (p_size % 50) / 50.0::DOUBLE AS raw_score FROM part)"""
)
def scm9_badges(spark: SparkSession, folder: str) -> DataFrame:
    score = (F.col("p_size") % 50) / F.lit(50.0)
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("pe_number"), F.col("p_type").alias("agency"), F.col("p_name").alias("name"), N.confidence_badge(score, 0.9, 0.65).alias("badge")
    )


@query(
    """SELECT p_type AS agency, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,4))) AS DOUBLE) AS total, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"""
)
def join01_star_sums(spark: SparkSession, folder: str) -> DataFrame:
    """The agency-by-year sum on the larger star schema."""
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = read_table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("fiscal_year"))
    parts = read_table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("agency"))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("agency", "fiscal_year")
        .agg(N.exact_sum(F.col("l_extendedprice")).alias("total"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "SELECT c_mktsegment AS segment, c_custkey AS id, upper(regexp_replace(c_name, '[\\s\\-]', '', 'g')) AS key, starts_with(c_name, 'Customer') AS named FROM customer UNION ALL "
    "SELECT 'SUPPLIER', s_suppkey, upper(regexp_replace(s_name, '[\\s\\-]', '', 'g')), starts_with(s_name, 'Customer') FROM supplier"
)
def set01_union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of different shape one under the other (SET-01), acronym keys (SC-S5)."""
    a = read_table(spark, folder, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = read_table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("segment", F.coalesce("segment", F.lit("SUPPLIER")))
    return both.select("segment", "id", X.acronym_key(F.col("name")).alias("key"), F.col("name").startswith("Customer").alias("named"))


@query(
    """SELECT fiscal_year, list_sort(list(filename)) AS filenames, count(*) AS n FROM (SELECT filename, publication_year AS fiscal_year FROM source_documents) GROUP BY ALL"""
)
def agg15_manifest_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest grouped by year; a year has few files by nature."""
    m = read_table(spark, folder, "source_documents").select("filename", F.col("publication_year").alias("fiscal_year"))
    return m.groupBy("fiscal_year").agg(F.array_sort(F.collect_list("filename")).alias("filenames"), F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT doc_id, greatest(1, length(text) // 4)::INTEGER AS tokens, CAST(len(list_filter(string_split(text, chr(10)),
      lambda p: regexp_matches(p, '[^\s\x{0b}\x{85}\p{Z}]'))) AS INTEGER) AS n_paragraphs FROM documents WHERE text IS NOT NULL"""
)
def scs20_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and paragraphs of all documents with a text."""
    return (
        read_table(spark, folder, "documents")
        .where(F.col("text").isNotNull())
        .select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"), F.size(X.paragraphs(F.col("text"), "\n")).alias("n_paragraphs"))
    )
