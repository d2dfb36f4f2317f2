"""Queries of this package over a folder of tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalith.functions.identifiers import (
    NON_SPACE,
    canonical_agency,
    canonical_funding_type,
    canonical_pe_number,
    four_digit_year,
    usable_number,
)
from fiscalith.llm.encoding import decode_ids, encode_texts
from fiscalith.llm.leakage import leaked_items, reparameterised_items
from fiscalith.llm.lookalike import lookalike_classes, lookalike_pairs, normalize_texts
from fiscalith.llm.splitting import split_texts, token_chars
from fiscalith.llm.survivor import best_representatives
from fiscalith.llm.topn import top_n_per_group
from fiscalith.sources.tables import read_table

TOP_N = 10
MAX_TOKENS, OVERLAP_TOKENS = 800, 40


def scored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """pe_number (canonical), chunk_id and the highest counting score, for chunks whose text shows something."""
    score = F.col("relevance_score")
    hits = (
        read_table(spark, folder, "chunk_hits")
        .where((score >= 0) & (score <= 1) & ~F.isnan(score))
        .select(canonical_pe_number(F.col("pe_number")).alias("pe_number"), "chunk_id", "relevance_score")
        .where(F.col("pe_number").isNotNull())
        .groupBy("pe_number", "chunk_id")
        .agg(F.max("relevance_score").alias("score"))
    )
    usable = read_table(spark, folder, "policy_chunks").where(F.col("text").rlike(NON_SPACE)).select(F.col("id").alias("chunk_id"))
    return hits.join(usable, "chunk_id", "left_semi")


def p1_top_chunks(spark: SparkSession, folder: str) -> DataFrame:
    best = top_n_per_group(scored_chunks(spark, folder), "pe_number", "score", "chunk_id", TOP_N)
    return best.select("pe_number", "position", "chunk_id", "score")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_top_chunks(spark, folder).select("pe_number", "chunk_id")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read_table(spark, folder, "parsed_chunks")
    return split_texts(chunks, "parsed_id", "text", ["section_id"], MAX_TOKENS, OVERLAP_TOKENS)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    # Shorter texts come out whole; the filter spares them the way through Python.
    over = read_table(spark, folder, "parsed_chunks").where(F.length("text") > token_chars(MAX_TOKENS))
    pieces = split_texts(over, "parsed_id", "text", ["section_id"], MAX_TOKENS, OVERLAP_TOKENS)
    return pieces.where("piece_index = 0").select("parsed_id", "boundary")


def duplicate_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Funding lines with the element, year and type they belong to, their source's type and what their own row of the element says."""
    elements = read_table(spark, folder, "program_elements").select(
        F.col("id").alias("row_id"),
        canonical_pe_number(F.col("pe_number")).alias("number"),
        canonical_agency(F.col("agency")).alias("agency"),
        F.col("line_item_number").try_cast("bigint").alias("line_number"),
        F.col("act_code").try_cast("int").alias("activity"),
    )
    first = elements.groupBy("number", "agency").agg(F.min("row_id").alias("program_element_id"))
    element = elements.join(first, elements.number.eqNullSafe(first.number) & elements.agency.eqNullSafe(first.agency)).select(
        "row_id", "program_element_id", "line_number", "activity"
    )
    sources = read_table(spark, folder, "source_documents").select(F.col("id").alias("source_document_id"), "document_type")
    lines = read_table(spark, folder, "funding_lines").select(
        "id",
        F.col("program_element_id").alias("row_id"),
        four_digit_year(F.col("fiscal_year")).alias("fiscal_year"),
        canonical_funding_type(F.col("funding_type")).alias("funding_type"),
        usable_number(F.col("amount_thousands")).alias("amount_thousands"),
        "source_document_id",
        "loaded_at",
    )
    return (
        lines.where(F.col("fiscal_year").isNotNull() & F.col("funding_type").isNotNull())
        .join(element, "row_id")
        .join(sources, "source_document_id", "left")
    )


LINE_KEYS = ["program_element_id", "fiscal_year", "funding_type"]
#: Types of source documents by trust, the least first.
TRUST = ["R1-DRAFT", "R1-OCR", "R1-AMENDED", "R1"]


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """Field by field: the most complete line survives, and lacks are made good from lines of later layers (of other rows of the element)."""
    trust = F.array_position(F.array(*map(F.lit, TRUST)), F.coalesce("document_type", F.lit(""))) - 1
    values = ["amount_thousands", "line_number", "activity"]
    return best_representatives(duplicate_lines(spark, folder), LINE_KEYS, values, "loaded_at", trust, len(TRUST), "id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    trust = F.col("document_type").eqNullSafe("R1").cast("int")
    best = best_representatives(duplicate_lines(spark, folder), LINE_KEYS, ["amount_thousands"], "loaded_at", trust, 2, "id")
    return best.select(*LINE_KEYS, "survivor_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(read_table(spark, folder, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts again, from their ids; null texts come back empty."""
    return decode_ids(p6_ids(spark, folder), "doc_id", "ids")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(read_table(spark, folder, "documents"), "doc_id", read_table(spark, folder, "eval_items"), "item_id")


def p7_reparameterised(spark: SparkSession, folder: str) -> DataFrame:
    return reparameterised_items(
        read_table(spark, folder, "documents"), "doc_id", read_table(spark, folder, "eval_items"), "item_id"
    )


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_texts(read_table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(read_table(spark, folder, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_classes(read_table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found,
        p1_top_chunks,
        p2_found,
        p2_pieces,
        p3_found,
        p3_survivors,
        p6_ids,
        p6_decoded,
        p7_found,
        p7_reparameterised,
        p8_found,
        p8_forms,
        p8_classes,
    )
}
