"""Queries on delivered tables: records that do not load, changes between deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalith.functions.identifiers import canonical_pe_number, folded_text
from fiscalith.operators.rejects import R1_RECORD, split_records
from fiscalith.operators.snapshots import snapshot_changes, validity_intervals
from fiscalith.sources.tables import read_table


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    return split_records(read_table(spark, folder, "raw_r1_lines"), "raw_id", "line_text", R1_RECORD)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_records(spark, folder).where(F.col("reason").isNotNull()).select("raw_id", "reason")


def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The records that load, typed."""
    return p4_records(spark, folder).where(F.col("reason").isNull()).select("raw_id", "record.*")


def _snapshot_terms() -> tuple[dict, dict]:
    keys = {"pe_number": canonical_pe_number(F.col("pe_number")), "fiscal_year": F.col("fiscal_year")}
    values = {"pe_title": folded_text(F.col("pe_title")), "budget_activity": folded_text(F.col("budget_activity"))}
    return keys, values


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(read_table(spark, folder, "pe_snapshots"), "snapshot_id", *_snapshot_terms(), "loaded_at")


def p5_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """How long each state of a record held: first and last snapshot of it."""
    spans = validity_intervals(read_table(spark, folder, "pe_snapshots"), "snapshot_id", *_snapshot_terms(), "loaded_at")
    return spans.select("pe_number", "fiscal_year", "first_snapshot", "last_snapshot")


QUERIES = {f.__name__: f for f in (p4_found, p4_rows, p5_found, p5_intervals)}
