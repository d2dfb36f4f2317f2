"""Cleaning and cutting of whole documents, each in one pass over its text however long it is. For use over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

from fiscalith.functions import text as X

MIN_SECTION_TOKENS, MAX_SECTION_TOKENS, FLAT_TOKENS, MIN_WINDOW_TOKENS = 50, 800, 500, 30


def _python(pattern: str) -> str:
    """A pattern of ``text`` without the flag for line ends, which Python's patterns need not have."""
    return re.sub(r"^\(\?([a-z]*)d([a-zA-Z]*)\)", lambda m: f"(?{m.group(1)}{m.group(2)})" if m.group(1) + m.group(2) else "", pattern)


_NUMBER_LINE = re.compile(r"\d+")
_FURNITURE = re.compile(X.PAGE_FURNITURE)
_SECTION = re.compile(X.SECTION, re.I | re.M)
_LINE_LIKE_HEADING = re.compile(r"\n[Ss][Ee][Cc]")
_SKIPPED = re.compile(X.SKIPPED_TITLE)
_HEADING = re.compile(_python(X.HEADING))


class Chunk(NamedTuple):
    page_number: int | None
    section_id: str | None
    section_title: str | None
    text: str
    token_count: int


class Window(NamedTuple):
    page_number: int
    window: int
    section_title: str
    text: str
    token_count: int


def approx_tokens(text: str) -> int:
    return max(1, len(text) // 4)


def cleaned(page: str) -> str:
    """Lines trimmed, page numbers and furniture gone, at most one empty line in a row."""
    lines = (line.strip() for line in page.split("\n"))
    kept = [x for x in lines if not x or not (_NUMBER_LINE.fullmatch(x) or _FURNITURE.match(x))]
    return re.sub("\n{3,}", "\n\n", "\n".join(kept)).strip()


def paragraphs(text: str, separator: str) -> list[str]:
    return [p for part in text.split(separator) if (p := part.strip())]


def packs(items: Sequence[str], budget: int, joiner: str = "\n\n") -> Iterator[tuple[str, int]]:
    """Greedy packing in order: an item opens a new pack when it would take the open one over ``budget`` tokens.

    Gives text and tokens of each pack; the count is the sum over items, and an item larger than the budget is a pack of its own.
    """
    held: list[str] = []
    total = 0
    for item in items:
        n = approx_tokens(item)
        if held and total + n > budget:
            yield joiner.join(held), total
            held, total = [], 0
        held.append(item)
        total += n
    if held:
        yield joiner.join(held), total


def sliding(items: Sequence[str], size: int = 4, overlap: int = 1) -> Iterator[Sequence[str]]:
    """Windows of ``size`` items, each beginning with the last ``overlap`` of the one before; the ragged end is kept."""
    for start in range(0, len(items), max(1, size - overlap)):
        yield items[start : start + size]


def section_chunks(raw: str, separator: str) -> Iterator[Chunk]:
    """Chunks of a document by its section headings, or by paragraphs if it has none."""
    text = cleaned(raw.replace("\f", "\n"))
    # Every line is tried, also one that the heading before it reaches over.
    starts = [at for at in (0, *(m.start() + 1 for m in _LINE_LIKE_HEADING.finditer(text))) if _SECTION.match(text, at)]
    if not starts:
        for body, tokens in packs(paragraphs(text, separator), FLAT_TOKENS):
            yield Chunk(None, None, None, body, tokens)
        return
    page_ends = list(accumulate(len(p) for p in raw.split("\f")))
    page = 0
    for start, end in zip(starts, [*starts[1:], len(text)]):
        part = text[start:end]
        head = _SECTION.match(part)
        title = re.sub(r"\.+$", "", head.group(2).strip())
        body = part.strip()
        tokens = approx_tokens(body)
        while page < len(page_ends) and page_ends[page] < start:  # pages whose text ends before the section begins
            page += 1
        if tokens < MIN_SECTION_TOKENS or _SKIPPED.match(title):
            continue
        number, name = f"SEC. {head.group(1)}", title[:500] or None
        if tokens > MAX_SECTION_TOKENS:
            for piece, n in packs(paragraphs(body, separator), MAX_SECTION_TOKENS):
                yield Chunk(None, number, name, piece, n)
        else:
            yield Chunk(page + 1 if page < len(page_ends) else None, number, name, body, tokens)


def window_chunks(raw: str, separator: str) -> Iterator[Window]:
    """Overlapping windows of four paragraphs a page, under the last heading met."""
    heading = "Introduction"
    for number, page in enumerate(raw.split("\f"), 1):
        text = cleaned(page)
        found = [h for m in _HEADING.finditer(text) if len(h := m.group(1).strip()) > 5 and not h.isdigit()]
        heading = found[-1] if found else heading
        for i, items in enumerate(sliding(paragraphs(text, separator))):
            body = "\n\n".join(items)
            tokens = approx_tokens(body)
            if tokens >= MIN_WINDOW_TOKENS:
                yield Window(number, i, heading[:500], body, tokens)
