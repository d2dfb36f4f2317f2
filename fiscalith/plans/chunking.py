"""Policy documents to chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscalith.functions import documents as D
from fiscalith.functions import text as X
from fiscalith.operators.sequences import carry_forward
from fiscalith.plans.registry import query
from fiscalith.session import ship_package
from fiscalith.sources.pages import is_native
from fiscalith.sources.tables import read_table

#: Characters of chunks that a task gathers before it hands them on.
GATHERED = 1 << 24

_SECTIONS = "chunk_index int, page_number int, section_id string, section_title string, text string, token_count int"
_WINDOWS = "page_number int, window int, section_title string, text string, token_count int"


def _cut(documents: DataFrame, key: str, text: str, cutter: Callable[[str], Iterator[tuple]], columns: str) -> DataFrame:
    """``key`` and ``columns`` of what ``cutter`` makes of each text. A document is cut as it is read; chunks go on in bounded batches."""
    ship_package(documents.sparkSession)
    fields = T.StructType.fromDDL(columns).fields
    schema = T.StructType([documents.schema[key], *fields])
    kinds = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: pa.Array, index: list[int], rows: list[tuple]) -> pa.RecordBatch:
            made = [pa.array(list(c), kind) for c, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(index, pa.int64())), *made], names=schema.names)

        for batch in batches:
            index: list[int] = []
            rows: list[tuple] = []
            size = 0
            for i, one in enumerate(batch.column(1)):
                for row in cutter(one.as_py()):
                    index.append(i)
                    rows.append(row)
                    size += len(row[-2])
                    if size > GATHERED:
                        yield emit(batch.column(0), index, rows)
                        index, rows, size = [], [], 0
            yield emit(batch.column(0), index, rows)

    return documents.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)


def section_chunks(documents: DataFrame, key: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Chunks of documents that are divided into sections: key, chunk_index, page, section id and title, text, tokens.

    Text is cut before each section heading; what comes before the first is left out, as are boilerplate and very
    short sections. A section over the limit is packed by paragraphs; any other stays whole and gets the page
    whose end its start reaches. Documents without a heading are packed by paragraphs. A document is cut in one pass and one task, so there is
    no shuffle, and the time grows with its length. Null and empty texts give no chunk.
    """

    def cutter(raw: str) -> Iterator[tuple]:
        return ((i, *chunk) for i, chunk in enumerate(D.section_chunks(raw, separator)))

    return _cut(documents, key, text, cutter, _SECTIONS)


def window_chunks(documents: DataFrame, key: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Chunks of documents by overlapping windows of four paragraphs a page, under the last heading met.

    The last heading of a page labels all of its windows; pages without one take the heading before, the first pages
    ``Introduction``. Windows under 30 tokens are left out. One pass over each document: no shuffle.
    """
    return _cut(documents, key, text, lambda raw: D.window_chunks(raw, separator), _WINDOWS)


# -- queries -------------------------------------------------------------------------------------------------------------


_CLEAN_SQL = r"""regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x = '' OR NOT (regexp_matches(x, '^\d+$')
  OR regexp_matches(x, '(?i)^(UNCLASSIFIED|PUBLIC LAW|ENROLLED BILL|GPO|U\.S\. GOVERNMENT|www\.|https?://)'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'),
  '^\s+|\s+$', '', 'g')"""


_ENDS = r"^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$"


def _stripped_sql(c: str) -> str:
    return f"regexp_replace({c}, '{_ENDS}', '', 'g')"


# Parts of each text from heading to heading with their places, the whole text as one part where there is none; paragraphs packed one by one.
_SECTIONS_SQL = (
    r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, parsed_id, text AS raw, replace(text, chr(12), chr(10)) AS text FROM parsed_chunks WHERE text IS NOT NULL),
  c AS (SELECT k, parsed_id, raw, """
    + _CLEAN_SQL
    + rf""" AS clean FROM d),
  m AS (SELECT *, regexp_matches(clean, '(?im){X.SECTION}') AS headed, string_split(regexp_replace(clean, '(?im)({X.SECTION})', chr(1) || '\1', 'g'), chr(1)) AS ps FROM c),
  p AS (SELECT k, parsed_id, raw, headed, generate_subscripts(ps, 1) AS i, unnest(ps) AS part FROM m),
  s AS (SELECT *, sum(length(part)) OVER (PARTITION BY k ORDER BY i) - length(part) AS start, {_stripped_sql('part')} AS body, regexp_extract(part, '(?im){X.SECTION}', 1) AS number,
    regexp_replace({_stripped_sql(f"regexp_extract(part, '(?im){X.SECTION}', 2)")}, '\.+$', '') AS title FROM p),
  u AS (SELECT *, greatest(1, length(body) // 4) AS tokens FROM s WHERE NOT headed OR (number <> '' AND greatest(1, length(body) // 4) >= 50 AND NOT regexp_matches(title, '{X.SKIPPED_TITLE}'))),
  e AS (SELECT k, i, len(list_filter(list_transform(range(1, len(string_split(raw, chr(12))) + 1), lambda n: list_sum(list_transform(string_split(raw, chr(12))[:CAST(n AS BIGINT)], lambda x: length(x)))),
    lambda x: x < start)) AS before, len(string_split(raw, chr(12))) AS pages FROM u),
  g AS (SELECT k, i, CASE WHEN headed THEN 800 ELSE 500 END AS budget, list_filter(list_transform(string_split(body, chr(10)), lambda x: {_stripped_sql('x')}), lambda x: x <> '') AS xs
    FROM u WHERE NOT headed OR tokens > 800),
  w AS (SELECT k, i, 1 AS j, 0 AS pack, greatest(1, length(xs[1]) // 4) AS total FROM g WHERE len(xs) > 0 UNION ALL
    SELECT w.k, w.i, j + 1, CASE WHEN total + greatest(1, length(xs[j + 1]) // 4) > budget THEN pack + 1 ELSE pack END,
      CASE WHEN total + greatest(1, length(xs[j + 1]) // 4) > budget THEN greatest(1, length(xs[j + 1]) // 4) ELSE total + greatest(1, length(xs[j + 1]) // 4) END
    FROM w JOIN g ON g.k = w.k AND g.i = w.i WHERE j < len(xs)),
  o AS (SELECT w.k, w.i, pack, string_agg(xs[j], chr(10) || chr(10) ORDER BY j) AS text, max(total) AS token_count FROM w JOIN g ON g.k = w.k AND g.i = w.i GROUP BY ALL),
  a AS (SELECT k, i, pack, NULL::INTEGER AS page_number, text, token_count FROM o UNION ALL
    SELECT u.k, u.i, 0, CASE WHEN before < pages THEN before + 1 END, body, tokens FROM u JOIN e ON e.k = u.k AND e.i = u.i WHERE headed AND tokens <= 800)
  SELECT parsed_id, CAST(row_number() OVER (PARTITION BY a.k ORDER BY a.i, pack) - 1 AS INTEGER) AS chunk_index, CAST(page_number AS INTEGER) AS page_number,
    CASE WHEN headed THEN 'SEC. ' || number END AS section_id, CASE WHEN headed THEN nullif(substr(title, 1, 500), '') END AS section_title, a.text, CAST(token_count AS INTEGER) AS token_count
  FROM a JOIN u ON u.k = a.k AND u.i = a.i"""
)


@query(_SECTIONS_SQL)
def tvf05_section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of the long texts (WIN-07, WIN-09, WIN-10, WIN-12, FLT-14, TVF-06)."""
    return section_chunks(read_table(spark, folder, "parsed_chunks"), "parsed_id", "text", "\n")


@query(
    r"""WITH c AS (SELECT parsed_id, """
    + _CLEAN_SQL
    + r""" AS clean FROM parsed_chunks WHERE text IS NOT NULL),
      h AS (SELECT *, list_filter(list_transform(regexp_extract_all(clean, '(?m)^([A-Z][A-Z\s\&\-]{3,60}|[IVX]+\.\s+[A-Z][A-Z\s]{3,})\s*$', 1),
          lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 5) AS hs,
        list_filter(list_transform(string_split(clean, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps
        FROM c WHERE clean <> ''),
      w AS (SELECT parsed_id, coalesce(hs[len(hs)], 'Introduction') AS section_title, i - 1 AS w, array_to_string(list_slice(ps, 3 * (i - 1) + 1, 3 * (i - 1) + 4), chr(10) || chr(10)) AS text
        FROM (SELECT *, unnest(range(1, CAST((len(ps) - 1) // 3 + 2 AS BIGINT))) AS i FROM h WHERE len(ps) > 0))
      SELECT parsed_id, 1 AS page_number, CAST(w AS INTEGER) AS "window", section_title, text, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_count
      FROM w WHERE length(text) // 4 >= 30"""
)
def tvf07_window_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping paragraph windows (SC-S17, SC-S20, WIN-05, WIN-08)."""
    return window_chunks(read_table(spark, folder, "parsed_chunks"), "parsed_id", "text", "\n")


@query(
    """SELECT document_id, id, coalesce(last_value(section_title IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Introduction') AS section_title FROM policy_chunks"""
)
def win05_carried_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles carried forward through each document in chunk order; a few documents hold most chunks (WIN-04)."""
    chunks = read_table(spark, folder, "policy_chunks").select("document_id", "id", "chunk_index", "section_title")
    out = carry_forward(chunks, ["document_id"], "chunk_index", "section_title", tie="id")
    return out.select("document_id", "id", F.coalesce("section_title", F.lit("Introduction")).alias("section_title"))


@query(
    """SELECT document_id, id, sum(length(coalesce(text, ''))) OVER (PARTITION BY document_id ORDER BY chunk_index, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS end_position FROM policy_chunks"""
)
def win10_running_length(spark: SparkSession, folder: str) -> DataFrame:
    """Where each chunk ends in its document (AGG-17)."""
    from fiscalith.operators.sequences import running_sum

    chunks = read_table(spark, folder, "policy_chunks").select(
        "document_id", "id", "chunk_index", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n")
    )
    return running_sum(chunks, ["document_id"], "chunk_index", "n", "end_position", tie="id").select("document_id", "id", "end_position")


@query(
    f"""SELECT id AS chunk_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, regexp_matches(text, '{X.PRIORITY_WORDS}') AS priority,
      substr(text, 1, 400) AS excerpt FROM policy_chunks WHERE text IS NOT NULL"""
)
def scs18_tokens_and_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate tokens, the priority-word test and the excerpt of a chunk (SC-S18, SC-S19, PRJ-08)."""
    return (
        read_table(spark, folder, "policy_chunks")
        .where(F.col("text").isNotNull())
        .select(
            F.col("id").alias("chunk_id"),
            X.approx_tokens(F.col("text")).alias("tokens"),
            F.col("text").rlike(X.PRIORITY_WORDS).alias("priority"),
            F.substring("text", 1, 400).alias("excerpt"),
        )
    )


@query(
    r"""SELECT parsed_id, CAST(len(string_split(text, chr(12))) AS INTEGER) AS n_pages,
      length(array_to_string(list_slice(string_split(text, chr(12)), 1, 3), '')) > 200 AS is_native,
      CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INTEGER) AS n_lines FROM parsed_chunks WHERE text IS NOT NULL"""
)
def src24_native_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a text and whether the first three hold enough of it to need no OCR (SRC-23, SRC-24, SRC-26, SC-S26)."""
    pages = F.split("text", "\f", -1)
    return (
        read_table(spark, folder, "parsed_chunks")
        .where(F.col("text").isNotNull())
        .select(
            "parsed_id",
            F.size(pages).alias("n_pages"),
            is_native(F.col("text")).alias("is_native"),
            F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).alias("n_lines"),
        )
    )
