"""Funding over the years: facts, pivots, trends, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiscalith.functions.identifiers import canonical_agency, canonical_funding_type, canonical_pe_number, four_digit_year, usable_number
from fiscalith.functions.numeric import cagr_pct, exact_sum, rounded, total_delta_pct, trend_arrow, trend_label, yoy_pct
from fiscalith.plans.registry import query
from fiscalith.plans.sql_terms import AGENCY, FUNDING_TYPE, YEAR, canonical_number
from fiscalith.sources.tables import read_table

FIRST_YEAR, LAST_YEAR = 1996, 2026


def elements(spark: SparkSession, folder: str) -> DataFrame:
    """Program elements in canonical spelling; ``pe_id`` is the row's own id."""
    return read_table(spark, folder, "program_elements").select(
        F.col("id").alias("pe_id"),
        canonical_pe_number(F.col("pe_number")).alias("pe_number"),
        "program_name",
        canonical_agency(F.col("agency")).alias("agency"),
        "budget_activity",
        "is_classified",
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Funding lines with a year, a type and a usable amount."""
    return (
        read_table(spark, folder, "funding_lines")
        .select(
            "id",
            F.col("program_element_id").alias("pe_id"),
            four_digit_year(F.col("fiscal_year")).alias("fiscal_year"),
            canonical_funding_type(F.col("funding_type")).alias("funding_type"),
            usable_number(F.col("amount_thousands")).alias("amount"),
        )
        .where(F.col("amount").isNotNull() & F.col("fiscal_year").isNotNull() & F.col("funding_type").isNotNull())
    )


def by_element_and_year(facts: DataFrame) -> DataFrame:
    """Sums by element and year: what a join with the elements then carries, however many lines there are."""
    return facts.groupBy("pe_id", "fiscal_year").agg(F.sum(F.col("amount").cast("decimal(20,4)")).alias("amount"))


def pivot_years(facts: DataFrame, keys: Sequence[str], first: int, last: int, name: str = "{}", value: str = "amount") -> DataFrame:
    """One row per key, one column per year ``first .. last``; years without money are 0.

    The years are given, so no job has to find them and the columns do not depend on the data.
    """
    years = range(first, last + 1)
    sums = [exact_sum(F.when(F.col("fiscal_year") == y, F.col(value))).alias(name.format(y)) for y in years]
    return facts.where(F.col("fiscal_year").between(first, last)).groupBy(*keys).agg(*sums).na.fill(0.0)


def with_growth(wide: DataFrame, first: int, last: int) -> DataFrame:
    """``total_delta_pct`` and ``cagr_pct`` between the end years, most money in the last year first."""
    a, b = F.col(f"`{first}`"), F.col(f"`{last}`")
    return wide.withColumns({"total_delta_pct": total_delta_pct(a, b), "cagr_pct": cagr_pct(a, b, last - first)})


def trends_by(
    facts: DataFrame, elements: DataFrame, keys: Sequence[str], first: int, last: int, funding_types: Sequence[str] | None = None
) -> DataFrame:
    """Money by ``keys`` of the element and by year, with growth.

    Years become columns in the first aggregate, by element: its shuffle serves the join as well, and the join carries one row an element.
    """
    rows = facts if funding_types is None else facts.where(F.col("funding_type").isin(*funding_types))
    years = range(first, last + 1)
    amount = F.col("amount").cast("decimal(20,4)")
    by_element = (
        rows.where(F.col("fiscal_year").between(first, last))
        .groupBy("pe_id")
        .agg(*[F.sum(F.when(F.col("fiscal_year") == y, amount)).alias(str(y)) for y in years])
    )
    joined = by_element.join(elements.select("pe_id", *keys), "pe_id")
    wide = joined.groupBy(*keys).agg(*[F.sum(F.col(f"`{y}`")).cast("double").alias(str(y)) for y in years]).na.fill(0.0)
    return with_growth(wide, first, last)


def agency_trends(facts: DataFrame, elements: DataFrame, first: int, last: int, funding_types: Sequence[str] | None = None) -> DataFrame:
    """Money by agency and year, with growth. ``funding_types`` None sums all three books, as the reference does."""
    return trends_by(facts, elements, ["agency"], first, last, funding_types)


def pe_trends(facts: DataFrame, elements: DataFrame, first: int, last: int, funding_types: Sequence[str] | None = None) -> DataFrame:
    """Money by program element and year, with growth."""
    return trends_by(facts, elements, ["pe_number", "program_name", "agency"], first, last, funding_types)


def latest_funding(facts: DataFrame, funding_type: str = "BY Request") -> DataFrame:
    """Per element the first and last amount of one type by year (of equal years the larger id), and the arrow between."""
    place = F.struct("fiscal_year", "id")
    ends = (
        facts.where(F.col("funding_type") == funding_type)
        .groupBy("pe_id")
        .agg(
            F.max("fiscal_year").alias("latest_fy"),
            F.max_by("amount", place).alias("__last"),
            F.min_by("amount", place).alias("__first"),
            F.count(F.lit(1)).alias("__n"),
        )
    )
    return ends.select(
        "pe_id",
        "latest_fy",
        rounded(F.col("__last") / 1000, 2).alias("latest_by_request_m"),
        F.when(F.col("__n") == 1, "→").otherwise(trend_arrow(F.col("__first"), F.col("__last"))).alias("trend"),
    )


def funding_gaps(linked: DataFrame, facts: DataFrame, base_year: int, budget_year: int) -> DataFrame:
    """Year-on-year gap of each linked query: amounts 0 and flag null where nothing is matched."""
    matched = linked.where(F.col("matched_pe_id").isNotNull()).select(F.col("matched_pe_id").alias("pe_id")).distinct()
    money = facts.where(F.col("fiscal_year").isin(base_year, budget_year)).join(matched, "pe_id", "left_semi")
    sums = money.groupBy("pe_id").agg(
        *[exact_sum(F.when(F.col("fiscal_year") == y, F.col("amount"))).alias(n) for y, n in ((base_year, "__a"), (budget_year, "__b"))]
    ).na.fill(0.0)
    rated = sums.withColumn("__yoy", yoy_pct(F.col("__a"), F.col("__b")))
    out = linked.join(rated, linked.matched_pe_id == rated.pe_id, "left")
    return out.select(
        "query",
        "matched_name",
        "match_strategy",
        F.round("confidence_score", 2).alias("confidence_score"),
        F.coalesce("__a", F.lit(0.0)).alias(f"FY{base_year}_$K"),
        F.coalesce("__b", F.lit(0.0)).alias(f"FY{budget_year}_$K"),
        F.coalesce(rounded(F.col("__yoy"), 2), F.lit(0.0)).alias("YoY_Change_%"),
        (F.col("__yoy") < 0).alias("funding_gap_flag"),
    )


def wide_millions(facts: DataFrame, first: int, last: int, funding_type: str = "BY Request") -> DataFrame:
    """``pe_id``, ``FY{year}_$M`` for each year and the trend between the first and last year that hold any row."""
    rows = facts.where((F.col("funding_type") == funding_type) & F.col("fiscal_year").between(first, last))
    names = [f"FY{y}_$M" for y in range(first, last + 1)]
    wide = pivot_years(rows, ["pe_id"], first, last, "FY{}_$M")
    ends = rows.agg(F.min("fiscal_year").alias("__lo"), F.max("fiscal_year").alias("__hi"))
    by_year = F.create_map(*[x for y, n in zip(range(first, last + 1), names) for x in (F.lit(y), F.col(f"`{n}`"))])
    trend = trend_label(F.try_element_at(by_year, F.col("__lo")), F.try_element_at(by_year, F.col("__hi")))
    return wide.join(F.broadcast(ends)).select(
        "pe_id", *[rounded(F.col(f"`{n}`") / 1000, 3).alias(n) for n in names], trend.alias("funding_trend")
    )


def _rounded(trends: DataFrame) -> DataFrame:
    return trends.withColumns({c: rounded(F.col(c), 6) for c in ("total_delta_pct", "cagr_pct")})


# -- queries -------------------------------------------------------------------------------------------------------------

_ELEMENTS = f"""elements AS (SELECT id AS pe_id, {canonical_number('pe_number')} AS pe_number, program_name, {AGENCY} AS agency,
  budget_activity, is_classified FROM program_elements)"""
_FACTS = f"""facts AS (SELECT * FROM (SELECT id, program_element_id AS pe_id, {YEAR} AS fiscal_year, {FUNDING_TYPE} AS funding_type,
  CASE WHEN isfinite(amount_thousands) THEN amount_thousands END AS amount FROM funding_lines)
  WHERE amount IS NOT NULL AND fiscal_year IS NOT NULL AND funding_type IS NOT NULL)"""
BASE_SQL = f"WITH {_ELEMENTS}, {_FACTS} "


def _wide_sql(first: int, last: int, name: str = "{}", scale: str = "", value: str = "amount") -> str:
    return ", ".join(
        f"coalesce(CAST(sum(CASE WHEN fiscal_year = {y} THEN CAST({value} AS DECIMAL(20,4)) END) AS DOUBLE), 0.0){scale} AS \"{name.format(y)}\""
        for y in range(first, last + 1)
    )


def rounded_sql(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def _growth_sql(a: int, b: int) -> str:
    total = f"""CASE WHEN "{a}" > 0 THEN ("{b}" - "{a}") / "{a}" * 100 ELSE 0.0 END"""
    yearly = f"""CASE WHEN "{a}" > 0 AND "{b}" > 0 THEN (pow("{b}" / "{a}", 1.0 / {b - a}::DOUBLE) - 1) * 100 ELSE 0.0 END"""
    return f"{rounded_sql(total, 6)} AS total_delta_pct, {rounded_sql(yearly, 6)} AS cagr_pct"


@query(
    BASE_SQL
    + f"""SELECT *, {_growth_sql(2016, 2026)} FROM (SELECT agency, {_wide_sql(2016, 2026)} FROM facts JOIN elements USING (pe_id)
      WHERE fiscal_year BETWEEN 2016 AND 2026 GROUP BY agency)"""
)
def ana01_agency_trends(spark: SparkSession, folder: str) -> DataFrame:
    out = agency_trends(facts(spark, folder), elements(spark, folder), 2016, 2026)
    return _rounded(out).orderBy(F.desc("`2026`"), "agency")


@query(
    BASE_SQL
    + f"""SELECT *, {_growth_sql(2016, 2026)} FROM (SELECT agency, {_wide_sql(2016, 2026)} FROM facts JOIN elements USING (pe_id)
      WHERE fiscal_year BETWEEN 2016 AND 2026 AND funding_type = 'BY Request' GROUP BY agency)"""
)
def ana03_agency_trends_by_request(spark: SparkSession, folder: str) -> DataFrame:
    """The same for one book only."""
    out = agency_trends(facts(spark, folder), elements(spark, folder), 2016, 2026, ["BY Request"])
    return _rounded(out).orderBy(F.desc("`2026`"), "agency")


@query(
    BASE_SQL
    + f"""SELECT *, {_growth_sql(2020, 2025)} FROM (SELECT pe_number, program_name, agency, {_wide_sql(2020, 2025)}
      FROM facts JOIN elements USING (pe_id) WHERE fiscal_year BETWEEN 2020 AND 2025 GROUP BY ALL)"""
)
def ana02_pe_trends(spark: SparkSession, folder: str) -> DataFrame:
    out = pe_trends(facts(spark, folder), elements(spark, folder), 2020, 2025)
    return _rounded(out).orderBy(F.desc("`2025`"), "pe_number", "agency")


@query(
    BASE_SQL
    + """SELECT agency, fiscal_year, CAST(sum(CAST(amount AS DECIMAL(20,4))) AS DOUBLE) AS total
      FROM facts JOIN elements USING (pe_id) GROUP BY ALL"""
)
def agg01_sum_by_agency_year(spark: SparkSession, folder: str) -> DataFrame:
    joined = by_element_and_year(facts(spark, folder)).join(elements(spark, folder).select("pe_id", "agency"), "pe_id")
    return joined.groupBy("agency", "fiscal_year").agg(exact_sum(F.col("amount")).alias("total"))


@query(
    BASE_SQL
    + """SELECT pe_number, program_name, agency, fiscal_year, CAST(sum(CAST(amount AS DECIMAL(20,4))) AS DOUBLE) AS total
      FROM facts JOIN elements USING (pe_id) GROUP BY ALL"""
)
def agg02_sum_by_pe_year(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["pe_number", "program_name", "agency"]
    joined = by_element_and_year(facts(spark, folder)).join(elements(spark, folder).select("pe_id", *keys), "pe_id")
    return joined.groupBy(*keys, "fiscal_year").agg(exact_sum(F.col("amount")).alias("total"))


@query(BASE_SQL + "SELECT pe_id, fiscal_year, CAST(sum(CAST(amount AS DECIMAL(20,4))) AS DOUBLE) AS total FROM facts GROUP BY ALL")
def agg03_sum_by_id_year(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).groupBy("pe_id", "fiscal_year").agg(exact_sum(F.col("amount")).alias("total"))


@query(
    BASE_SQL
    + """, l AS (SELECT pe_id, max(fiscal_year) AS latest_fy, arg_max(amount, (fiscal_year, id)) AS b, arg_min(amount, (fiscal_year, id)) AS a,
        count(*) AS n FROM facts WHERE funding_type = 'BY Request' GROUP BY pe_id)
      SELECT e.pe_id, e.pe_number, l.latest_fy, CAST(round(CAST(b / 1000 AS DECIMAL(28,8)), 2) AS DOUBLE) AS latest_by_request_m,
        CASE WHEN n IS NULL THEN 'N/A' WHEN n = 1 THEN '→' WHEN b > a * 1.05 THEN '↑' WHEN b < a * 0.95 THEN '↓' ELSE '→' END AS trend
      FROM elements e LEFT JOIN l USING (pe_id)"""
)
def agg04_latest_funding(spark: SparkSession, folder: str) -> DataFrame:
    last = latest_funding(facts(spark, folder))
    return (
        elements(spark, folder)
        .select("pe_id", "pe_number")
        .join(last, "pe_id", "left")
        .withColumn("trend", F.coalesce("trend", F.lit("N/A")))
    )


@query(
    """SELECT (SELECT count(*) FROM source_documents) AS n_sources, (SELECT count(*) FROM program_elements) AS n_elements,
      (SELECT count(*) FROM funding_lines) AS n_lines"""
)
def agg05_table_counts(spark: SparkSession, folder: str) -> DataFrame:
    def counted(name: str, alias: str) -> DataFrame:
        return read_table(spark, folder, name).agg(F.count(F.lit(1)).alias(alias))

    # Three one-row sides.
    return (
        counted("source_documents", "n_sources")
        .join(counted("program_elements", "n_elements"))
        .join(counted("funding_lines", "n_lines"))
    )


@query(BASE_SQL + "SELECT agency, count(*) AS n FROM elements GROUP BY agency")
def agg06_count_by_agency(spark: SparkSession, folder: str) -> DataFrame:
    return elements(spark, folder).groupBy("agency").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "agency")


@query(
    BASE_SQL
    + """SELECT agency, count(pe_number) AS n_elements, coalesce(CAST(sum(CAST(amount AS DECIMAL(20,4))) AS DOUBLE), 0.0) / 1000 AS by_request_m,
      count(*) FILTER (is_classified) AS n_classified FROM elements LEFT JOIN (SELECT pe_id, sum(CAST(amount AS DECIMAL(20,4))) AS amount FROM facts
      WHERE funding_type = 'BY Request' GROUP BY pe_id) USING (pe_id) GROUP BY agency"""
)
def agg07_component_summary(spark: SparkSession, folder: str) -> DataFrame:
    money = facts(spark, folder).where("funding_type = 'BY Request'").groupBy("pe_id").agg(
        F.sum(F.col("amount").cast("decimal(20,4)")).alias("amount")
    )
    return (
        elements(spark, folder)
        .join(money, "pe_id", "left")
        .groupBy("agency")
        .agg(
            F.count("pe_number").alias("n_elements"),
            (F.coalesce(exact_sum(F.col("amount")), F.lit(0.0)) / 1000).alias("by_request_m"),
            F.count_if("is_classified").alias("n_classified"),
        )
        .orderBy(F.desc("by_request_m"))
    )


@query(
    """SELECT d.id AS document_id, d.filename, d.doc_type, d.doc_year, count(c.id) AS n_chunks
      FROM policy_documents d LEFT JOIN policy_chunks c ON c.document_id = d.id GROUP BY ALL"""
)
def agg08_chunks_per_document(spark: SparkSession, folder: str) -> DataFrame:
    # Counted before the join: few documents hold most chunks.
    n = read_table(spark, folder, "policy_chunks").groupBy("document_id").agg(F.count("id").alias("n_chunks"))
    documents = read_table(spark, folder, "policy_documents").select(F.col("id").alias("document_id"), "filename", "doc_type", "doc_year")
    return documents.join(n, "document_id", "left").na.fill(0, ["n_chunks"]).orderBy("doc_type", "doc_year", "document_id")


@query(
    BASE_SQL
    + """SELECT agency, count(DISTINCT pe_number) AS n_numbers, list_sort(list(DISTINCT budget_activity) FILTER (budget_activity IS NOT NULL)) AS activities FROM elements GROUP BY agency"""
)
def agg09_distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return (
        elements(spark, folder)
        .groupBy("agency")
        .agg(F.count_distinct("pe_number").alias("n_numbers"), F.array_sort(F.collect_set("budget_activity")).alias("activities"))
    )


@query(
    BASE_SQL
    + """, e AS (SELECT pe_id, min(fiscal_year) AS first_fy, max(fiscal_year) AS last_fy FROM facts WHERE funding_type = 'BY Request' GROUP BY pe_id),
      s AS (SELECT pe_id, first_fy, last_fy, CAST(sum(CASE WHEN fiscal_year = first_fy THEN CAST(amount AS DECIMAL(20,4)) END) AS DOUBLE) AS first_amount,
        CAST(sum(CASE WHEN fiscal_year = last_fy THEN CAST(amount AS DECIMAL(20,4)) END) AS DOUBLE) AS last_amount
        FROM facts JOIN e USING (pe_id) WHERE funding_type = 'BY Request' GROUP BY ALL)
      SELECT *, CAST(round(CAST(CASE WHEN first_amount > 0 THEN (last_amount - first_amount) / first_amount * 100 ELSE 0.0 END AS DECIMAL(28,8)), 6) AS DOUBLE) AS change_pct,
        CAST(round(CAST(CASE WHEN first_amount > 0 AND last_amount > 0 AND last_fy > first_fy
          THEN (pow(last_amount / first_amount, 1.0::DOUBLE / (last_fy - first_fy)) - 1) * 100 ELSE 0.0 END AS DECIMAL(28,8)), 6) AS DOUBLE) AS cagr_pct FROM s"""
)
def ana14_pe_kpis(spark: SparkSession, folder: str) -> DataFrame:
    """First and last year of each element with its money, change and yearly growth (AGG-10)."""
    # One shuffle: per element and year first, then the ends are picked from the years.
    by_year = (
        facts(spark, folder)
        .where("funding_type = 'BY Request'")
        .groupBy("pe_id", "fiscal_year")
        .agg(exact_sum(F.col("amount")).alias("amount"))
        .groupBy("pe_id")
        .agg(
            F.min("fiscal_year").alias("first_fy"),
            F.max("fiscal_year").alias("last_fy"),
            F.min_by("amount", "fiscal_year").alias("first_amount"),
            F.max_by("amount", "fiscal_year").alias("last_amount"),
        )
    )
    a, b, n = F.col("first_amount"), F.col("last_amount"), F.col("last_fy") - F.col("first_fy")
    growth = F.when((a > 0) & (b > 0) & (n > 0), (F.pow(b / a, F.try_divide(F.lit(1.0), n)) - 1) * 100).otherwise(F.lit(0.0))
    return by_year.withColumns({"change_pct": rounded(total_delta_pct(a, b), 6), "cagr_pct": rounded(growth, 6)})


@query(
    BASE_SQL
    + """, w AS (SELECT agency, """
    + _wide_sql(2020, 2025)
    + """ FROM facts JOIN elements USING (pe_id) WHERE fiscal_year BETWEEN 2020 AND 2025 GROUP BY agency)
      SELECT CAST(sum(CAST("2020" AS DECIMAL(20,4))) AS DOUBLE) AS first_total, CAST(sum(CAST("2025" AS DECIMAL(20,4))) AS DOUBLE) AS last_total,
        arg_max(agency, "2025") AS largest, count(*) FILTER ("2025" > "2020") AS n_up, count(*) FILTER ("2025" < "2020") AS n_down FROM w"""
)
def ana16_period_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = agency_trends(facts(spark, folder), elements(spark, folder), 2020, 2025)
    a, b = F.col("`2020`"), F.col("`2025`")
    return t.agg(
        exact_sum(a).alias("first_total"),
        exact_sum(b).alias("last_total"),
        F.max_by("agency", b).alias("largest"),
        F.count_if(b > a).alias("n_up"),
        F.count_if(b < a).alias("n_down"),
    )


@query(
    BASE_SQL
    + f"SELECT pe_id, funding_type, {_wide_sql(2020, 2026)} FROM facts WHERE fiscal_year BETWEEN 2020 AND 2026 GROUP BY ALL"
)
def ana13_funding_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_years(facts(spark, folder), ["pe_id", "funding_type"], 2020, 2026)


@query(
    BASE_SQL
    + f"SELECT pe_id, {_wide_sql(FIRST_YEAR, LAST_YEAR)} FROM facts WHERE fiscal_year BETWEEN {FIRST_YEAR} AND {LAST_YEAR} GROUP BY ALL"
)
def pvt01_all_years(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_years(facts(spark, folder), ["pe_id"], FIRST_YEAR, LAST_YEAR)


_BY_SQL = f"""SELECT pe_id, {_wide_sql(2018, 2026, 'FY{}_$M')} FROM facts
  WHERE funding_type = 'BY Request' AND fiscal_year BETWEEN 2018 AND 2026 GROUP BY pe_id"""


@query(
    BASE_SQL
    + f""", w AS ({_BY_SQL}), y AS (SELECT min(fiscal_year) AS lo, max(fiscal_year) AS hi FROM facts
        WHERE funding_type = 'BY Request' AND fiscal_year BETWEEN 2018 AND 2026),
      t AS (SELECT w.*, CASE lo {' '.join(f'WHEN {y} THEN "FY{y}_$M"' for y in range(2018, 2027))} END AS a,
        CASE hi {' '.join(f'WHEN {y} THEN "FY{y}_$M"' for y in range(2018, 2027))} END AS b FROM w, y)
      SELECT pe_id, {', '.join(f'CAST(round(CAST("FY{y}_$M" / 1000 AS DECIMAL(28,8)), 3) AS DOUBLE) AS "FY{y}_$M"' for y in range(2018, 2027))},
        CASE WHEN b > a * 1.05 THEN '↑ UP' WHEN b < a * 0.95 THEN '↓ DOWN' ELSE '→ FLAT' END AS funding_trend FROM t"""
)
def win11_wide_millions(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly requests in millions with the trend between the first and last year present (PRJ-04, WIN-11)."""
    return wide_millions(facts(spark, folder), 2018, 2026)


@query(
    BASE_SQL
    + f""", w AS ({_BY_SQL}), y AS (SELECT min(fiscal_year) AS lo, max(fiscal_year) AS hi FROM facts
        WHERE funding_type = 'BY Request' AND fiscal_year BETWEEN 2018 AND 2026),
      t AS (SELECT CASE lo {' '.join(f'WHEN {y} THEN "FY{y}_$M"' for y in range(2018, 2027))} END AS a,
        CASE hi {' '.join(f'WHEN {y} THEN "FY{y}_$M"' for y in range(2018, 2027))} END AS b FROM w, y)
      SELECT count(*) AS n, count(*) FILTER (b > a * 1.05) AS n_up, count(*) FILTER (b < a * 0.95) AS n_down,
        count(*) FILTER (b <= a * 1.05 AND b >= a * 0.95) AS n_flat FROM t"""
)
def ana17_trend_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = wide_millions(facts(spark, folder), 2018, 2026)
    label = F.col("funding_trend")
    return t.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(label == "↑ UP").alias("n_up"),
        F.count_if(label == "↓ DOWN").alias("n_down"),
        F.count_if(label == "→ FLAT").alias("n_flat"),
    )


@query(
    BASE_SQL
    + """, s AS (SELECT pe_id, coalesce(CAST(sum(CASE WHEN fiscal_year = 2024 THEN CAST(amount AS DECIMAL(20,4)) END) AS DOUBLE), 0.0) AS a,
        coalesce(CAST(sum(CASE WHEN fiscal_year = 2025 THEN CAST(amount AS DECIMAL(20,4)) END) AS DOUBLE), 0.0) AS b
        FROM facts WHERE fiscal_year IN (2024, 2025) GROUP BY pe_id),
      y AS (SELECT pe_id, a, b, CASE WHEN a > 0 THEN (b - a) / a * 100 WHEN b > 0 THEN 100.0 ELSE 0.0 END AS yoy FROM s)
      SELECT program_name AS query, program_name AS matched_name, 'NAME' AS match_strategy, 1.0::DOUBLE AS confidence_score,
        coalesce(a, 0.0) AS "FY2024_$K", coalesce(b, 0.0) AS "FY2025_$K", coalesce(CAST(round(CAST(yoy AS DECIMAL(28,8)), 2) AS DOUBLE), 0.0) AS "YoY_Change_%", yoy < 0 AS funding_gap_flag
      FROM (SELECT *, min(pe_id) OVER (PARTITION BY program_name) AS m FROM elements) e LEFT JOIN y ON y.pe_id = e.m"""
)
def ana04_funding_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Gap analysis with every program name as a query, linked to the smallest id of that name."""
    e = elements(spark, folder)
    first = e.groupBy("program_name").agg(F.min("pe_id").alias("matched_pe_id"))
    linked = e.join(first, "program_name").select(
        F.col("program_name").alias("query"),
        "matched_pe_id",
        F.col("program_name").alias("matched_name"),
        F.lit("NAME").alias("match_strategy"),
        F.lit(1.0).alias("confidence_score"),
    )
    return funding_gaps(linked, facts(spark, folder), 2024, 2025)


@query()
def pvt02_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded listing records as long facts: one row per amount, dated by the book it comes from."""
    from fiscalith.plans.quality import p4_rows

    return unpivot_amounts(p4_rows(spark, folder).withColumn("fiscal_year", F.expr("try_cast(fiscal_year AS INT)")), ["raw_id", "pe_number"])


def unpivot_amounts(wide: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``py``, ``cy`` and ``by`` amounts of a book as rows of the years they are for; empty amounts give no row."""
    parts = F.array(
        *[
            F.struct((F.col("fiscal_year") - back).alias("fiscal_year"), F.lit(kind).alias("funding_type"), F.col(c).alias("amount_thousands"))
            for back, kind, c in ((2, "PY Actual", "py_amount"), (1, "CY Request", "cy_amount"), (0, "BY Request", "by_amount"))
        ]
    )
    long = wide.select(*keep, F.explode(parts).alias("__p")).select(*keep, "__p.*")
    return long.where(F.col("amount_thousands").isNotNull() & ~F.isnan("amount_thousands") & F.col("fiscal_year").isNotNull())


@query(
    BASE_SQL
    + """SELECT DISTINCT ON (pe_number) pe_number, agency, program_name FROM elements ORDER BY pe_number, pe_id"""
)
def flt03_first_name(spark: SparkSession, folder: str) -> DataFrame:
    """The first name of each number: the smallest id stands for it."""
    return elements(spark, folder).groupBy("pe_number").agg(F.min_by("agency", "pe_id").alias("agency"), F.min_by("program_name", "pe_id").alias("program_name"))


def explore(elements: DataFrame, agencies: Sequence[str] = (), activities: Sequence[str] = (), text: str = "", limit: int | None = None) -> DataFrame:
    """The explorer: unclassified elements, optional lists, optional case-insensitive substring, in order."""
    out = elements.where(~F.col("is_classified"))
    if agencies:
        out = out.where(F.col("agency").isin(*agencies))
    if activities:
        out = out.where(F.col("budget_activity").isin(*activities))
    if text:
        out = out.where(F.col("program_name").ilike(f"%{text}%") | F.col("pe_number").ilike(f"%{text}%"))
    out = out.orderBy("agency", "pe_number", "pe_id")
    return out if limit is None else out.limit(limit)


@query(
    BASE_SQL
    + """SELECT pe_id, pe_number, program_name, agency, budget_activity FROM elements WHERE NOT is_classified AND agency IN ('Army', 'Navy')
      AND (program_name ILIKE '%radio%' OR pe_number ILIKE '%radio%' )"""
)
def ana15_explorer(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-01, FLT-04, FLT-05 and SRT-05 together."""
    return explore(elements(spark, folder), ["Army", "Navy"], text="radio").drop("is_classified")


@query(
    BASE_SQL
    + """SELECT agency, fiscal_year, CAST(sum(CAST(amount AS DECIMAL(20,4))) AS DOUBLE) / 1e6 AS billions FROM facts JOIN elements USING (pe_id)
      WHERE funding_type = 'BY Request' AND fiscal_year BETWEEN 2010 AND 2026 AND pe_id IN (SELECT pe_id FROM elements WHERE NOT is_classified)
      GROUP BY ALL"""
)
def snk09_agency_series(spark: SparkSession, folder: str) -> DataFrame:
    """The series behind the agency chart, in billions (FLT-06..08, JOIN-07 within the join that gives the agency, PRJ-04)."""
    open_elements = elements(spark, folder).where(~F.col("is_classified")).select("pe_id", "agency")
    rows = facts(spark, folder).where((F.col("funding_type") == "BY Request") & F.col("fiscal_year").between(2010, 2026))
    return (
        by_element_and_year(rows)
        .join(open_elements, "pe_id")
        .groupBy("agency", "fiscal_year")
        .agg((exact_sum(F.col("amount")) / 1e6).alias("billions"))
    )


@query(
    BASE_SQL
    + """SELECT pe_number, agency, total, place FROM (SELECT pe_number, agency, CAST(sum(CAST(amount AS DECIMAL(20,4))) AS DOUBLE) AS total,
        row_number() OVER (ORDER BY sum(CAST(amount AS DECIMAL(20,4))) DESC, pe_number, agency) AS place FROM facts JOIN elements USING (pe_id)
        WHERE funding_type = 'BY Request' AND fiscal_year = 2025 GROUP BY pe_number, agency) WHERE place <= 20"""
)
def srt02_top_elements(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty largest requests of a year; a report, so the limit is the feature (TOP-04)."""
    rows = facts(spark, folder).where("funding_type = 'BY Request' AND fiscal_year = 2025")
    joined = by_element_and_year(rows).join(elements(spark, folder).select("pe_id", "pe_number", "agency"), "pe_id")
    top = joined.groupBy("pe_number", "agency").agg(exact_sum(F.col("amount")).alias("total"))
    order = [F.desc("total"), F.col("pe_number"), F.col("agency")]
    return top.orderBy(*order).limit(20).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


@query(
    BASE_SQL
    + """SELECT pe_id, list(amount_m ORDER BY fiscal_year) AS trend_series FROM (SELECT pe_id, fiscal_year,
        CAST(sum(CAST(amount AS DECIMAL(20,4))) AS DOUBLE) / 1000 AS amount_m FROM facts WHERE funding_type = 'BY Request' GROUP BY ALL) GROUP BY pe_id"""
)
def snk06_trend_series(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly amounts as one array per element, for sparklines."""
    by_year = facts(spark, folder).where("funding_type = 'BY Request'").groupBy("pe_id", "fiscal_year").agg((exact_sum(F.col("amount")) / 1000).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("fiscal_year", "m")))
    return by_year.groupBy("pe_id").agg(F.transform(ordered, lambda x: x["m"]).alias("trend_series"))
