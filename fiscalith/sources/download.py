"""Downloads as a distributed, resumable step: a table of links in, a table of outcomes out."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalith.session import ship_package

OUTCOME = "path string, url string, attempt int, status string, size_bytes bigint"
#: What a browser says of itself.
HEADERS = {"User-Agent": "Mozilla/5.0", "Accept": "text/html,application/xhtml+xml,application/pdf;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9"}
#: Bytes read at a time.
PIECE = 1 << 20
#: Answers after which a link is given up at once.
GIVEN_UP = frozenset([403, 404])


def looks_like_html(content_type: str | None, body: bytes) -> bool:
    return "text/html" in (content_type or "").lower() or b"<html" in body[:500].lower()


def fetch(
    url: str, path: str, attempts: int = 3, pause: float = 2.0, allow_html: bool = False, opener: Callable = urllib.request.urlopen
) -> tuple[str, int | None]:
    """Status and size: ``present`` for a file that is there already, ``saved``, ``html`` for a page instead of a document, ``http <code>``
    or ``failed``. A file appears under its name only when it is whole."""
    if os.path.exists(path):
        return "present", os.path.getsize(path)
    status = "failed"
    for attempt in range(attempts):
        try:
            with opener(urllib.request.Request(url, headers=HEADERS), timeout=120) as answer:
                body = answer.read(PIECE)
                if not allow_html and looks_like_html(answer.headers.get("Content-Type"), body):
                    return "html", None
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                part = f"{path}.{os.getpid()}.part"
                size = 0
                with open(part, "wb") as f:
                    while body:
                        f.write(body)
                        size += len(body)
                        body = answer.read(PIECE)
            announced = answer.headers.get("Content-Length")
            if announced is not None and int(announced) != size:  # it broke off
                os.remove(part)
                status = "failed"
                continue
            os.replace(part, path)
            return "saved", size
        except urllib.error.HTTPError as fault:
            status = f"http {fault.code}"
            if fault.code in GIVEN_UP:
                return status, None
        except (urllib.error.URLError, OSError):
            status = "failed"
        if attempt + 1 < attempts:
            time.sleep(pause * 2**attempt)
    return status, None


def download(links: DataFrame, attempts: int = 3, pause: float = 2.0, parallel: int = 8) -> DataFrame:
    """Outcome of each document: ``links`` has ``path`` (in storage that all executors see) and ``urls``, the addresses to try in order.

    A document is done with the first address that gives it; the outcome names it, or the last one tried. Running it again fetches
    only what is missing. At most ``parallel`` tasks ask at the same time. Write the result down: the step has side effects.
    """

    ship_package(links.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, urls in zip(frame["path"], frame["urls"]):
                row = (path, None, -1, "unknown", None)
                for i, url in enumerate(urls if urls is not None else []):
                    status, size = fetch(url, path, attempts, pause)
                    row = (path, url, i, status, size)
                    if status in ("saved", "present"):
                        break
                out.append(row)
            frame = pd.DataFrame(out, columns=["path", "url", "attempt", "status", "size_bytes"])
            yield frame.astype({"size_bytes": "Int64", "attempt": "int32"})

    return links.select("path", "urls").repartition(parallel).mapInPandas(run, OUTCOME)


def as_links(candidates: DataFrame, folder: str, keys: Sequence[str], name: str = "{}.pdf") -> DataFrame:
    """``path`` and ``urls`` from rows of ``keys``, ``attempt`` and ``url``: the addresses of a document in the order of attempts."""
    label = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    before, after = name.split("{}")
    urls = F.transform(F.array_sort(F.collect_list(F.struct("attempt", "url"))), lambda x: x["url"])
    path = F.concat(F.lit(f"{folder}/{before}"), label, F.lit(after))
    return candidates.groupBy(*keys).agg(urls.alias("urls")).withColumn("path", path)
