"""Fixed-layout budget listings: pages of text to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiscalith.functions import text as X
from fiscalith.operators.rejects import R1_RECORD, split_records
from fiscalith.plans.registry import query
from fiscalith.plans.sql_terms import words
from fiscalith.sources.tables import read_table

_AMOUNTS = ["py_amount", "cy_amount", "by_amount"]
CLASSIFIED_NUMBER = "999999999"


def page_rows(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """Data rows of listing pages: ``key``, ``line`` and the parsed fields.

    Lines are looked at inside the row of their page: a line that is no data row but indented text continues the title of the data row right
    before it, once; subtotal labels are swallowed without being added. Everything is an expression, nothing is shuffled.
    """
    lines = F.split(F.col(text), "\n", -1)
    numbered = pages.select(*key, F.col("__page_no") if "__page_no" in pages.columns else F.lit(0).alias("__page_no"), lines.alias("__lines"))
    # Each line goes on with the one after it, not with its page.
    paired = F.arrays_zip(F.col("__lines"), F.slice("__lines", F.lit(2), F.size("__lines")).alias("__next"))
    exploded = numbered.select(*key, "__page_no", F.posexplode(paired).alias("line", "__pair")).select(
        *key, "__page_no", "line", F.col("__pair.__lines").alias("__text"), F.col("__pair.__next").alias("__following")
    )
    following = F.col("__following")
    row = F.col("__text")

    # One pass of the pattern gives all of its groups.
    found = F.split(F.regexp_replace(row, X.DATA_ROW, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001", -1)

    def group(i: int) -> Column:
        return F.get("__groups", i - 1)

    title = X.stripped(group(3))
    continued = X.stripped(F.regexp_extract(following, X.CONTINUATION, 1))
    goes_on = following.rlike(X.CONTINUATION) & ~following.rlike(X.DATA_ROW) & ~X.is_subtotal(continued)
    rest = F.regexp_replace(F.regexp_replace(X.stripped(group(5)), r"^[A-Z]\s+", ""), r"\s+[A-Z]$", "")
    number = F.upper(group(2))
    classified = number == CLASSIFIED_NUMBER
    parsed = exploded.where(row.rlike(X.DATA_ROW)).withColumn("__groups", found).where(~X.is_subtotal(title))
    return parsed.select(
        *key,
        "__page_no",
        "line",
        F.when(classified, "").otherwise(number).alias("pe_number"),
        F.when(F.coalesce(goes_on, F.lit(False)), F.concat(title, F.lit(" "), continued)).otherwise(title).alias("pe_title"),
        group(1).try_cast("bigint").alias("line_no"),
        group(4).alias("act_code"),
        X.budget_activity(group(4)).alias("budget_activity"),
        classified.alias("is_classified"),
        X.amounts(rest).alias("__a"),
    ).select(
        "*", F.col("__a.py").alias("py_amount"), F.col("__a.cy").alias("cy_amount"), F.col("__a.by").alias("by_amount")
    ).drop("__a")


def file_rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """Data rows of listing files (pages divided by form feeds), with the appropriation and component in force on their page.

    Pages of other appropriations are passed over; a page without a header keeps the one before it, the first pages ``Unknown``.
    Headers are carried inside the row of the file: no shuffle.
    """
    numbered = F.transform(F.split(F.col(text), "\f", -1), lambda p, i: F.struct(i.alias("no"), p.alias("page")))
    kept = files.where(F.col(text).isNotNull()).select(
        F.col(key), F.filter(numbered, lambda p: ~p["page"].rlike(X.OTHER_APPROPRIATION)).alias("__pages")
    )
    unknown = F.struct(F.lit("Unknown").alias("appropriation"), F.lit("Unknown").alias("component"))
    headers = X.carried(F.transform("__pages", lambda p: X.appropriation(p["page"])), "struct<appropriation:string,component:string>", unknown)
    named = kept.select(key, F.explode(F.arrays_zip("__pages", headers.alias("__headers"))).alias("__z")).select(
        key,
        F.col("__z.__pages.no").alias("__page_no"),
        F.col("__z.__pages.page").alias("__page"),
        F.col("__z.__headers.appropriation").alias("appropriation"),
        F.col("__z.__headers.component").alias("component"),
    )
    rows = page_rows(named, [key, "appropriation", "component"], "__page")
    return rows.withColumnRenamed("__page_no", "page")


def deduplicated(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per (fiscal_year, component, pe_number, act_code): the one with most amounts, then the first in ``order``.

    Rank filters on a window are cut per task before the shuffle, so a hot key arrives as one row a task.
    """
    filled = sum((F.col(c).isNotNull().cast("int") for c in _AMOUNTS[1:]), F.col(_AMOUNTS[0]).isNotNull().cast("int"))
    best = Window.partitionBy("fiscal_year", "component", "pe_number", "act_code").orderBy(F.desc("__filled"), *[F.asc_nulls_last(c) for c in order])
    return rows.withColumn("__filled", filled).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__filled", "__n")


# -- queries -------------------------------------------------------------------------------------------------------------

#: One listing page with every kind of row.
SAMPLE_PAGE = "\n".join(
    [
        "Exhibit R-1",
        "Appropriation: 2040A Research, Development, Test and Evaluation, Army",
        "",
        "  1 0601102A  Defense Research Sciences                     01 U     386,594             296,670       310,191",
        "  2 0603001A  Warfighter Technology                         03 U      24,359                            21,349",
        "       (Continued Title)",
        "  Basic Research                                              616,802  497,455  513,917",
        "  3 0604114A  Lower Tier Air Missile Defense (LTAMD) Sensor  05 25,492   43,357   31,426   U",
        "  4 999999999  Classified Programs                           07 U  100,000",
        "  5 0605001A  No Amounts                                     06",
    ]
)


@query(
    """SELECT * FROM (VALUES
      (1, '0601102A', 'Defense Research Sciences', '01', 'BA1 - Basic Research', 'Army', false, 386594.0::DOUBLE, 296670.0::DOUBLE, 310191.0::DOUBLE),
      (2, '0603001A', 'Warfighter Technology (Continued Title)', '03', 'BA3 - Advanced Technology Development', 'Army', false, 24359.0, NULL, 21349.0),
      (3, '0604114A', 'Lower Tier Air Missile Defense (LTAMD) Sensor', '05', 'BA5 - System Development & Demonstration', 'Army', false, 25492.0, 43357.0, 31426.0),
      (4, '', 'Classified Programs', '07', 'BA7 - Operational Systems Development', 'Army', true, 100000.0, NULL, NULL))
      t(line_no, pe_number, pe_title, act_code, budget_activity, component, is_classified, py_amount, cy_amount, by_amount)"""
)
def tvf01_sample_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The sample page parsed (SC-S11..S16, WIN-06, TVF-02)."""
    files = spark.createDataFrame([("a.txt", SAMPLE_PAGE)], "file string, text string")
    rows = file_rows(files, "file", "text")
    return rows.select(
        F.col("line_no").cast("int").alias("line_no"), "pe_number", "pe_title", "act_code", "budget_activity", "component", "is_classified", *_AMOUNTS
    )


#: Records laid out on a page, and characters of a title that stay on its first line, at least and at most.
PAGE_RECORDS = 50
TITLE_LEAST, TITLE_MOST = 10, 30


def listing_files(records: DataFrame) -> DataFrame:
    """Records laid out as listing files: ``source_file`` and ``text``, whole files.

    A file has its records by component, each component from a new page under one header that its further pages do not repeat; records
    without a component come first, under none. Long titles go on in a continuation line, unless either part would read as a subtotal. A
    file is gathered in one row, as ``file_rows`` reads it.
    """
    title = X.stripped(F.regexp_replace(F.coalesce("pe_title", F.lit("Untitled")), r"\s+", " "))
    cut = rf"^(.{{{TITLE_LEAST},{TITLE_MOST}}}) ([A-Za-z(].+)$"
    first, rest = F.regexp_extract("__title", cut, 1), F.regexp_extract("__title", cut, 2)
    goes_on = (rest != "") & ~X.is_subtotal(first) & ~X.is_subtotal(rest)
    line = F.format_string(
        "  %s %s  %s   %s U  %s   %s   %s",
        F.coalesce(F.regexp_extract("line_no", "[0-9]+", 0), F.lit("0")),
        F.coalesce("pe_number", F.lit(CLASSIFIED_NUMBER)),
        F.when(goes_on, first).otherwise(F.col("__title")),
        F.lpad(F.regexp_extract("act_code", "[0-9]+", 0), 2, "0"),
        *[F.coalesce(F.format_number(c, 0), F.lit("")) for c in _AMOUNTS],
    )
    lines = F.concat(line, F.when(goes_on, F.concat(F.lit("\n       "), rest)).otherwise(""))
    component = X.stripped(F.regexp_replace(F.coalesce("component", F.lit("")), r"\s+", " "))
    header = F.concat(F.lit("Appropriation: 2040A Research, Development, Test and Evaluation, "), F.col("__component"), F.lit("\n"))
    laid = records.withColumn("__title", title).select(
        "source_file", component.alias("__component"), F.struct("file_line", "raw_id", lines.alias("text")).alias("__line")
    )
    sections = laid.groupBy("source_file", "__component").agg(F.array_sort(F.collect_list("__line"))["text"].alias("__lines"))
    starts = F.sequence(F.lit(1), F.size("__lines"), F.lit(PAGE_RECORDS))
    pages = F.array_join(F.transform(starts, lambda i: F.array_join(F.slice("__lines", i, PAGE_RECORDS), "\n")), "\f")
    headed = sections.select("source_file", F.struct("__component", F.concat(F.when(F.col("__component") != "", header).otherwise(""), pages).alias("text")).alias("__section"))
    files = headed.groupBy("source_file").agg(F.array_sort(F.collect_list("__section"))["text"].alias("__sections"))
    return files.select("source_file", F.array_join("__sections", "\f").alias("text"))



def component_sql(c: str) -> str:
    """The component rule of headers for a text without repeated blanks."""
    short = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.COMPONENT_ABBREVIATIONS.items())
    named = " ".join(f"WHEN contains(lower({c}), '{k}') THEN '{v}'" for k, v in X.COMPONENT_NAMES.items())
    cased = f"array_to_string(list_transform(regexp_extract_all(lower({c}), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || substr(w, 2)), '')"
    return f"coalesce(CASE lower(trim({c})) {short} END, CASE lower(trim(string_split({c}, ',')[1])) {short} END, CASE {named} END, {cased})"


_LABELS = words(X.SUBTOTAL_LABELS)
_ACTIVITIES = "CASE act WHEN " + " WHEN ".join(f"'{k}' THEN '{v}'" for k, v in X.BUDGET_ACTIVITIES.items()) + " ELSE 'BA' || act END"
_ONE_BLANK = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"

# Where each record comes to lie (pages of a component after those of the components before it, lines below the header and continued
# titles), and what its amounts are read as without their places.
LISTED_SQL = rf"""l AS (SELECT r.*, f.source_file, f.file_line, {_ONE_BLANK.format("coalesce(component, '')")} AS comp, {_ONE_BLANK.format("coalesce(pe_title, 'Untitled')")} AS title,
    lpad(regexp_extract(act_code, '[0-9]+'), 2, '0') AS act FROM rows r JOIN raw_r1_lines f USING (raw_id)),
  t AS (SELECT *, regexp_extract(title, '^(.{{10,30}}) ([A-Za-z(].+)$', ['a', 'b']) AS x FROM l),
  u AS (SELECT *, x.b <> '' AND lower(trim(regexp_replace(x.a, '[\d,\s*]+$', ''))) NOT IN ({_LABELS}) AND lower(trim(regexp_replace(x.b, '[\d,\s*]+$', ''))) NOT IN ({_LABELS}) AS goes_on FROM t),
  n AS (SELECT *, row_number() OVER (PARTITION BY source_file, comp ORDER BY file_line, raw_id) - 1 AS i, count(*) OVER (PARTITION BY source_file, comp) AS size FROM u),
  s AS (SELECT source_file, comp, sum(any_value((size + 49) // 50)) OVER (PARTITION BY source_file ORDER BY comp) - any_value((size + 49) // 50) AS pages_before FROM n GROUP BY source_file, comp),
  p AS (SELECT *, pages_before + i // 50 AS page, CASE WHEN i < 50 AND comp <> '' THEN 1 ELSE 0 END
    + coalesce(sum(1 + goes_on::INTEGER) OVER (PARTITION BY source_file, comp, i // 50 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line,
    list_filter([round_even(py_amount, 0), round_even(cy_amount, 0), round_even(by_amount, 0)], lambda a: a IS NOT NULL) AS v FROM n JOIN s USING (source_file, comp))
  SELECT source_file, CASE WHEN comp = '' THEN 'Unknown' ELSE 'Research, Development, Test and Evaluation, ' || comp END AS appropriation,
    CASE WHEN comp = '' THEN 'Unknown' ELSE {component_sql("regexp_replace(comp, '[.,]+$', '')")} END AS component, CAST(page AS INTEGER) AS page, CAST(line AS INTEGER) AS line,
    CASE WHEN coalesce(pe_number, '999999999') = '999999999' THEN '' ELSE pe_number END AS pe_number, title AS pe_title,
    TRY_CAST(coalesce(nullif(regexp_extract(line_no, '[0-9]+'), ''), '0') AS BIGINT) AS line_no, act AS act_code, {_ACTIVITIES} AS budget_activity,
    coalesce(pe_number, '999999999') = '999999999' AS is_classified, v[1] AS py_amount, CASE WHEN len(v) = 3 THEN v[2] END AS cy_amount, CASE WHEN len(v) >= 2 THEN v[len(v)] END AS by_amount
  FROM p WHERE regexp_matches(act, '^[0-9][0-9]$') AND lower(trim(regexp_replace(CASE WHEN goes_on THEN x.a ELSE title END, '[\d,\s*]+$', ''))) NOT IN ({_LABELS})"""


@query()
def tvf02_listing_of_records(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded records laid out as listing files again and parsed back, a file each source (TVF-02, TVF-04)."""
    raw = read_table(spark, folder, "raw_r1_lines").withColumn("__at", F.struct("raw_id", "source_file", "file_line"))
    loaded = split_records(raw, "__at", "line_text", R1_RECORD).where("reason IS NULL").select("__at.*", "record.*")
    return file_rows(listing_files(loaded), "source_file", "text")


_KEY = "fiscal_year, component, pe_number, act_code"


@query()
def tvf03_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded records, one per year, component, number and act code (AGG-13, WIN-02, SRT-01)."""
    from fiscalith.plans.quality import p4_rows

    rows = deduplicated(p4_rows(spark, folder), ["line_no", "raw_id"])
    return rows.orderBy(F.asc_nulls_last("fiscal_year"), F.asc_nulls_last("component"), F.asc_nulls_last("line_no"), "raw_id")


@query(
    rf"""SELECT id, {component_sql('a')} AS component FROM (SELECT id, {_ONE_BLANK.format('agency')} AS a FROM program_elements)"""
)
def scs10_components(spark: SparkSession, folder: str) -> DataFrame:
    """Agencies through the header's component rule, which title-cases what it does not know."""
    return read_table(spark, folder, "program_elements").select("id", X.component(F.col("agency")).alias("component"))
