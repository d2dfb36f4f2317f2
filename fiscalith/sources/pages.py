"""Page texts of binary documents by a pluggable extractor, with the route by whether a document has text at all."""

from __future__ import annotations

import io
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalith.session import ship_package

SCHEMA = "path string, text string, error string"


def pdf_to_text(content: bytes) -> str:
    """Layout-preserving text with pages divided by form feeds, by the ``pdftotext`` program."""
    if shutil.which("pdftotext") is None:
        raise RuntimeError("pdftotext is not installed")
    done = subprocess.run(["pdftotext", "-layout", "-", "-"], input=content, capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def plumber_text(content: bytes) -> str:
    """The same by the pdfplumber library, where it is installed."""
    try:
        import pdfplumber
    except ImportError as fault:
        raise RuntimeError("pdfplumber is not installed") from fault
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "\f".join(page.extract_text(layout=True) or "" for page in pdf.pages)


def recognized_text(content: bytes, dpi: int = 300) -> str:
    """Text of scanned pages by Tesseract, where it and its page renderer are installed."""
    try:
        import pdf2image
        import pytesseract
    except ImportError as fault:
        raise RuntimeError("pdf2image and pytesseract are not installed") from fault
    return "\f".join(pytesseract.image_to_string(page, config="--psm 6") for page in pdf2image.convert_from_bytes(content, dpi=dpi))


def first_that_works(*extractors: Callable[[bytes], str]) -> Callable[[bytes], str]:
    """An extractor that tries each in turn; the fault of the last one counts."""

    def run(content: bytes) -> str:
        for i, extractor in enumerate(extractors):
            try:
                return extractor(content)
            except Exception:  # noqa: BLE001 - the next one may do
                if i + 1 == len(extractors):
                    raise
        raise ValueError("no extractor")

    return run


#: What reads PDF files that have text, and those that have none.
TEXT, RECOGNIZED = first_that_works(pdf_to_text, plumber_text), recognized_text


def extract(files: DataFrame, extractor: Callable[[bytes], str] = TEXT) -> DataFrame:
    """``path``, ``text`` and ``error`` of each file of ``binaryFile`` shape; a file that cannot be read has an error and stops no other."""

    ship_package(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows.append((path, extractor(bytes(content)), None))
                except Exception as fault:  # noqa: BLE001 - the reason goes into the table
                    rows.append((path, None, f"{type(fault).__name__}: {fault}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def is_native(text: Column, sample_pages: int = 3, least: int = 200) -> Column:
    """Whether the first pages hold more than ``least`` characters of text."""
    return F.length(F.array_join(F.slice(F.split(text, "\f", -1), 1, sample_pages), "")) > least


def extract_with_fallback(files: DataFrame, extractor: Callable[[bytes], str] = TEXT, recognizer: Callable[[bytes], str] = RECOGNIZED) -> DataFrame:
    """Texts by ``extractor``; documents it finds no text in by ``recognizer`` (OCR): path, text, error, extraction_method."""
    first = extract(files, extractor).withColumn("extraction_method", F.lit("native"))
    native = F.coalesce(is_native(F.col("text")), F.lit(False)) | F.col("error").isNotNull()
    scanned = files.join(first.where(~native).select("path"), "path", "left_semi")
    return first.where(native).unionByName(extract(scanned, recognizer).withColumn("extraction_method", F.lit("ocr")))


def read_binary(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    )
