"""Parsed listing rows into the star schema, idempotently."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiscalith.functions import text as X
from fiscalith.functions.numeric import safe_double
from fiscalith.plans.registry import query
from fiscalith.plans.trends import unpivot_amounts
from fiscalith.session import cut_lineage
from fiscalith.sources.tables import read_table


def first_rows(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each key with the ``values`` of its first row in ``order``; combined before the shuffle, so hot keys are cheap."""
    return rows.groupBy(*keys).agg(
        F.min(F.struct(*order)).alias("__at"), F.min_by(F.struct(*values), F.struct(*order)).alias("__v")
    ).select(*keys, "__at", *[F.col("__v")[v].alias(v) for v in values])


def numbered(dimension: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """Dense ids from ``start + 1`` in the order of the keys.

    Keys are range-partitioned and counted by partition; a prefix sum over the partitions gives where each begins, so no task
    numbers the whole dimension.
    """
    order = [F.asc_nulls_first(k) for k in keys]
    placed = cut_lineage(dimension.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row a partition.
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        placed.withColumn("__local", local)
        .join(F.broadcast(before), "__part")
        .withColumn(name, F.lit(start) + F.col("__before") + F.col("__local"))
        .drop("__part", "__before", "__local")
    )


def _highest(table: DataFrame | None) -> int:
    """The highest id of a table, 0 without one: one row to the driver."""
    return 0 if table is None else table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def _with_known(fresh: DataFrame, known: DataFrame | None, keys: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``known`` as they are, and those that ``build`` makes of ``fresh`` rows of other keys."""
    if known is None:
        return build(fresh)
    made = build(fresh.join(known.select(*keys), keys, "left_anti"))
    return known.select(*made.columns).unionByName(made)


def star_schema(
    rows: DataFrame, order: list[str], existing: Mapping[str, DataFrame] | None = None, processed: Column | None = None
) -> dict[str, DataFrame]:
    """source_documents, program_elements and funding_lines from parsed listing rows, put to the ``existing`` ones if these are given.

    Rows without a fiscal year are skipped. The first row of a file or element in ``order`` gives its attributes. A classified or
    unnumbered row gets a number made from agency, activity and year. What is known keeps its id and attributes; new files, elements (by
    number and agency) and lines are numbered on from the highest id, in the order of their keys, lines in ``order`` and by type. A file that is known
    was loaded whole before and is passed over, so that loading it again changes nothing. ``processed`` (now, unless given) is the date of new files.
    """
    known = dict(existing or {})
    usable = rows.where(F.col("fiscal_year").isNotNull())
    filename = F.coalesce(F.nullif("source_file", F.lit("")), F.lit("unknown"))
    agency = F.trim(F.coalesce("component", F.lit("Unknown")))
    clean = usable.select(
        *[c for c in usable.columns if c not in ("source_file", "component", "pe_number")],
        filename.alias("filename"),
        agency.alias("agency"),
        X.surrogate_pe_number(F.col("pe_number"), agency, F.trim("act_code"), F.col("fiscal_year"), F.coalesce("is_classified", F.lit(False))).alias("pe_number"),
    )
    old_documents, old_elements, old_lines = (known.get(t) for t in ("source_documents", "program_elements", "funding_lines"))
    if old_documents is not None:
        clean = clean.join(old_documents.select("filename"), "filename", "left_anti")

    documents = _with_known(
        first_rows(clean, ["filename"], order, ["fiscal_year"]).drop("__at"),
        old_documents,
        ["filename"],
        lambda fresh: numbered(fresh, ["filename"], "id", _highest(old_documents)).select(
            "id", "filename", F.lit("R1").alias("document_type"), F.col("fiscal_year").alias("publication_year"),
            (F.current_timestamp() if processed is None else processed).alias("processed_date"),
        ),
    )
    documents = cut_lineage(documents)
    attributes = ["filename", "line_no", "pe_title", "appropriation", "budget_activity", "act_code", "is_classified"]

    def blank_to_null(c: str) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    elements = _with_known(
        first_rows(clean, ["pe_number", "agency"], order, attributes).drop("__at"),
        old_elements,
        ["pe_number", "agency"],
        lambda fresh: numbered(fresh, ["pe_number", "agency"], "id", _highest(old_elements))
        .join(documents.select(F.col("id").alias("source_document_id"), "filename"), "filename")
        .select(
            "id", "source_document_id", "pe_number", F.col("line_no").cast("string").alias("line_item_number"),
            F.trim(F.coalesce("pe_title", F.lit("Unknown"))).alias("program_name"), "agency", blank_to_null("appropriation").alias("appropriation"),
            blank_to_null("budget_activity").alias("budget_activity"), blank_to_null("act_code").alias("act_code"),
            F.coalesce("is_classified", F.lit(False)).alias("is_classified"),
        ),
    )
    elements = cut_lineage(elements)
    typed = clean.withColumns({c: safe_double(F.col(c)) for c in ("py_amount", "cy_amount", "by_amount")})
    long = unpivot_amounts(typed, ["pe_number", "agency", *order])
    lines = long.join(elements.select(F.col("id").alias("program_element_id"), "pe_number", "agency"), ["pe_number", "agency"]).select(
        "program_element_id", "fiscal_year", "funding_type", "amount_thousands", *order
    )
    lines = numbered(lines, [*order, "funding_type", "program_element_id"], "id", _highest(old_lines))
    lines = lines.select("id", "program_element_id", "fiscal_year", "funding_type", "amount_thousands", *order)
    if old_lines is not None:
        lines = old_lines.select(*lines.columns).unionByName(lines)
    return {"source_documents": documents, "program_elements": elements, "funding_lines": lines}


def replace_documents(existing: DataFrame, fresh: DataFrame, key: str, replace: bool) -> DataFrame:
    """Rows of ``existing`` and ``fresh`` by document: known documents are skipped, or with ``replace`` swapped for the new rows."""
    if replace:
        kept = existing.join(fresh.select(key).distinct(), key, "left_anti")
        return kept.unionByName(fresh)
    return existing.unionByName(fresh.join(existing.select(key).distinct(), key, "left_anti"))


def cascade(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


# -- queries -------------------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded delivery records in the shape of the listing parser's output."""
    from fiscalith.plans.quality import p4_records

    files = read_table(spark, folder, "raw_r1_lines").select("raw_id", "source_file")
    loaded = p4_records(spark, folder).where("reason IS NULL").select("raw_id", "record.*")
    return loaded.join(files, "raw_id").select(
        "raw_id", "source_file", F.expr("try_cast(fiscal_year AS INT)").alias("fiscal_year"), "component",
        F.lit(None).cast("string").alias("appropriation"), X.budget_activity(F.col("act_code")).alias("budget_activity"),
        F.when(F.col("pe_number") == "999999999", "").otherwise(F.col("pe_number")).alias("pe_number"), "pe_title",
        F.expr("try_cast(line_no AS BIGINT)").alias("line_no"), "act_code",
        F.coalesce(F.col("pe_number") == "999999999", F.lit(False)).alias("is_classified"), "py_amount", "cy_amount", "by_amount",
    )


@query()
def dml03_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Program elements from the delivered records (WIN-13, SC-S22, PRJ-05, JOIN-08)."""
    return star_schema(_records(spark, folder), ["raw_id"])["program_elements"]


@query()
def dml03_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Funding lines from the delivered records (PVT-02, DML-03, SC-M7, SC-D3)."""
    return star_schema(_records(spark, folder), ["raw_id"])["funding_lines"]


def _second_load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The files of even years put to those of odd years, which were loaded before."""
    rows = _records(spark, folder)
    year = F.regexp_extract("source_file", "([0-9]{4})", 1).try_cast("int")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    first = star_schema(rows.where(year % 2 == 1), ["raw_id"], processed=at)
    first["funding_lines"] = cut_lineage(first["funding_lines"])
    return star_schema(rows, ["raw_id"], first, F.lit("2026-02-01 00:00:00").cast("timestamp"))


@query()
def dml01_second_load(spark: SparkSession, folder: str) -> DataFrame:
    """Program elements after a second load: those of the first keep their ids (DML-01)."""
    return _second_load(spark, folder)["program_elements"]


@query()
def dml01_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Files after a second load, with the day each was loaded on (DML-01, SC-D4)."""
    out = _second_load(spark, folder)["source_documents"]
    return out.withColumn("processed_date", F.date_format("processed_date", "yyyy-MM-dd"))


@query()
def dml01_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Funding lines after a second load (DML-01, DML-03)."""
    return _second_load(spark, folder)["funding_lines"]


@query(
    """SELECT c.id AS chunk_id FROM policy_chunks c WHERE c.document_id IN (SELECT id FROM policy_documents WHERE doc_type = 'NDAA')"""
)
def dml06_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks left when only one document type is kept."""
    documents = read_table(spark, folder, "policy_documents").where("doc_type = 'NDAA'")
    return cascade(read_table(spark, folder, "policy_chunks"), "document_id", documents, "id").select(F.col("id").alias("chunk_id"))


@query(
    """WITH f AS (SELECT document_id, id + 1000000000 AS id FROM policy_chunks WHERE document_id % 2 = 0)
      SELECT document_id, id FROM policy_chunks WHERE document_id % 2 = 1 UNION ALL SELECT document_id, id FROM f"""
)
def dml05_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of even id parsed again: their chunks are replaced, the others stay."""
    chunks = read_table(spark, folder, "policy_chunks").select("document_id", "id")
    fresh = chunks.where("document_id % 2 = 0").withColumn("id", F.col("id") + 1000000000)
    return replace_documents(chunks, fresh, "document_id", replace=True)
