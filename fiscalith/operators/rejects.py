"""Delimited records that fail to parse: valid rows and rejects with the reason."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscalith.session import ship_package

#: A field wholly enclosed in quotes; possessive, so that a text is read once however it is broken.
_ENCLOSED = re.compile(r'(?:(?<=,)|\A)"(?:[^"]++|"")*+"(?=,|\Z)', re.S)
_UNUSED = range(0xE000, 0xF900)


class BadRecord(Exception):
    """Carries the reason for which a record is set aside, and what the reader said, if it was the reader."""

    def __init__(self, reason: str, detail: str | None = None):
        super().__init__(reason)
        self.reason, self.detail = reason, detail


@dataclass(frozen=True)
class FieldSpec:
    """A column of the record; ``pattern`` holds for the value without blanks at its ends, empty is null."""

    name: str
    pattern: str | None = None
    make: Callable[[str], object] = str


@dataclass(frozen=True)
class RecordSpec:
    """The columns of a record in order."""

    fields: Sequence[FieldSpec]
    types: dict[str, T.DataType] = field(default_factory=dict)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, self.types.get(f.name, T.StringType())) for f in self.fields])


def assemble(text: str) -> tuple[str, dict[int, str]]:
    """One record for the reader out of its physical lines, and what to put back into its fields.

    Within quotes line breaks stay. Outside them a break is a character of its field here, which the reader does not take, so
    characters that the text does not use stand in for it.
    """
    if "\n" not in text and "\r" not in text:
        return text, {}
    free = (c for c in _UNUSED if chr(c) not in text)
    breaks = {ord("\n"): chr(next(free)), ord("\r"): chr(next(free))}
    parts = text.split('"')
    parts[::2] = [part.translate(breaks) for part in parts[::2]]
    return '"'.join(parts), {ord(stand_in): chr(code) for code, stand_in in breaks.items()}


def parse_record(text: str | None) -> list[str]:
    """The fields of one record, or ``BadRecord("quoting")`` with what the strict reader of the standard library raised.

    That reader decides. One fault it lets pass, a quote inside a field that is not enclosed in quotes; it is looked for
    in what is left of an accepted record without its enclosed fields. Null and empty texts have no fields.
    """
    if text is None:
        return []
    record, put_back = assemble(text.rstrip("\r\n"))
    try:
        fields = next(csv.reader([record], strict=True), [])
    except csv.Error as fault:
        raise BadRecord("quoting", str(fault)) from fault
    if '"' in record and '"' in _ENCLOSED.sub("", record):
        raise BadRecord("quoting", "quote inside a field that is not enclosed")
    return [f.translate(put_back) for f in fields] if put_back else fields


def build_row(fields: list[str], spec: RecordSpec, checks: Sequence[tuple[str, re.Pattern | None, Callable]]) -> list:
    """Typed values of a record, or ``BadRecord`` with the first reason that applies."""
    if len(fields) != len(spec.fields):
        raise BadRecord("columns")
    values = []
    for raw, (name, pattern, make) in zip(fields, checks):
        bare = raw.strip(" \t")
        if pattern is None:
            values.append(raw)
        elif not bare:
            values.append(None)
        elif pattern.fullmatch(bare):
            values.append(make(bare))
        else:
            raise BadRecord(name)
    return values


def split_records(df: DataFrame, id_column: str, text_column: str, spec: RecordSpec) -> DataFrame:
    """Every record of ``df`` as ``id_column``, ``reason``, ``detail`` and a ``record`` struct; nothing is dropped.

    ``reason`` is null for a record that loads, else ``quoting``, ``columns`` or the name of the first field
    whose value is invalid, and then ``record`` is null; ``detail`` is the reader's message for ``quoting``. One narrow pass over Arrow batches: no shuffle, memory
    bounded by a batch. Null and empty texts have no fields (``columns``); repeated records are judged one by one.
    Only the two named columns are read, so others may have any name.
    """
    ship_package(df.sparkSession)
    if id_column in ("reason", "detail", "record"):
        raise ValueError(f"rename {id_column}: the result has a column of that name")
    schema = T.StructType(
        [
            T.StructField(id_column, df.schema[id_column].dataType),
            T.StructField("reason", T.StringType()),
            T.StructField("detail", T.StringType()),
            T.StructField("record", spec.schema()),
        ]
    )
    patterns = [(f.name, f.pattern, f.make) for f in spec.fields]
    record_type = pa.struct(
        [(f.name, pa.float64() if isinstance(spec.types.get(f.name), T.DoubleType) else pa.string()) for f in spec.fields]
    )
    names = [f.name for f in spec.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        checks = [(n, None if p is None else re.compile(p), m) for n, p, m in patterns]
        for batch in batches:
            reasons: list[str | None] = []
            details: list[str | None] = []
            records: list[dict | None] = []
            for text in batch.column(1).to_pylist():
                try:
                    records.append(dict(zip(names, build_row(parse_record(text), spec, checks))))
                    reasons.append(None)
                    details.append(None)
                except BadRecord as fault:
                    records.append(None)
                    reasons.append(fault.reason)
                    details.append(fault.detail)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(reasons, pa.string()), pa.array(details, pa.string()), pa.array(records, record_type)],
                names=[id_column, "reason", "detail", "record"],
            )

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


def _amount(text: str) -> float:
    return float(text.replace(",", ""))


_PE, _MONEY = r"[0-9]{7,9}[A-Z0-9]{0,3}", r"-?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?"

#: The nine columns of a budget listing record.
R1_RECORD = RecordSpec(
    fields=(
        FieldSpec("fiscal_year"),
        FieldSpec("component"),
        FieldSpec("pe_number", _PE),
        FieldSpec("pe_title"),
        FieldSpec("line_no"),
        FieldSpec("act_code"),
        FieldSpec("py_amount", _MONEY, _amount),
        FieldSpec("cy_amount", _MONEY, _amount),
        FieldSpec("by_amount", _MONEY, _amount),
    ),
    types={"py_amount": T.DoubleType(), "cy_amount": T.DoubleType(), "by_amount": T.DoubleType()},
)
