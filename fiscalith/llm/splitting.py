"""Splitting of long texts at their strongest natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscalith.session import ship_package

#: Strength of a cut, from none to the strongest.
BOUNDARIES = ("none", "word", "sentence", "line", "paragraph")

#: Characters a token stands for.
CHARS_PER_TOKEN = 4

# White space outside the Basic Latin block, and the space-like control characters.
_SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_IS_SPACE = np.zeros(0x3001, dtype=bool)
_IS_SPACE[_SPACES] = True

_SLAB = 1 << 22


class RangeMax:
    """Maximum over any index range in constant time from a sparse table; ``int8`` throughout."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values.astype(np.int8)]
        span = 1
        while 2 * span <= min(longest, len(values)):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-span], below[span:]))
            span *= 2

    def query(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Maxima of ``[low, high)``, 0 for an empty range."""
        low, high = np.atleast_1d(low), np.atleast_1d(high)
        out = np.zeros(len(low), dtype=np.int8)
        width = high - low
        some = np.flatnonzero(width > 0)
        level = np.floor(np.log2(width[some])).astype(np.int64)
        for k in np.unique(level):
            at = some[level == k]
            table = self.levels[k]
            out[at] = np.maximum(table[low[at]], table[high[at] - (1 << k)])
        return out


class Cuts:
    """The places at which a text can be cut.

    A cut is a run of white space: the piece before it ends at ``end`` and the next may begin at ``start``.
    ``strength`` indexes ``BOUNDARIES``. A run with two line feeds holds an empty or blank line.
    """

    def __init__(self, text: str, max_chars: int):
        self.length, self.max_chars = len(text), max_chars
        ends, starts, strengths = [], [], []
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if self.length <= _SLAB else None
        space = np.empty(self.length, dtype=bool)
        feed = np.empty(self.length, dtype=bool)
        stop = np.empty(self.length, dtype=bool)
        for a in range(0, self.length, _SLAB):
            part = code if code is not None else np.frombuffer(text[a : a + _SLAB].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            b = a + len(part)
            space[a:b] = _IS_SPACE[np.minimum(part, 0x3000)] & (part <= 0x3000)
            feed[a:b] = part == 10
            stop[a:b] = (part == ord(".")) | (part == ord("?")) | (part == ord("!"))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], space, [False]]).astype(np.int8)))
        ends, starts = edge[0::2], edge[1::2]
        feeds = np.concatenate([[0], np.cumsum(feed, dtype=np.int64)])
        n_feeds = feeds[starts] - feeds[ends]
        after_stop = np.zeros(len(ends), dtype=bool)
        inner = ends > 0
        after_stop[inner] = stop[ends[inner] - 1]
        strengths = np.where(n_feeds >= 2, 4, np.where(n_feeds == 1, 3, np.where(after_stop, 2, 1)))
        self.end, self.start, self.strength = ends, starts, strengths.astype(np.int8)
        self.index = RangeMax(self.strength, max_chars + 1)
        self.of_strength = [np.flatnonzero(self.strength == s) for s in range(len(BOUNDARIES))]

    def weakest_needed(self) -> int:
        """The strongest level at which cutting everywhere leaves no unit above the limit.

        Every window of the permissible length must hold a cut at least that strong: the least, over all
        places where a unit can begin, of the range maximum over the cuts that the window reaches.
        """
        begin = np.concatenate([[0], self.start])
        first = np.arange(len(begin))
        open_ended = self.length - begin > self.max_chars
        if not open_ended.any():
            return len(BOUNDARIES) - 1
        reach = np.searchsorted(self.end, begin[open_ended] + self.max_chars, side="right")
        return int(self.index.query(first[open_ended], reach).min())

    def strongest(self, low: int, high: int) -> int:
        """Index of the strongest cut with ``low < end <= high``, the rightmost of equals; -1 if there is none."""
        a, b = np.searchsorted(self.end, low, side="right"), np.searchsorted(self.end, high, side="right")
        if a >= b:
            return -1
        best = self.of_strength[int(self.index.query(a, b)[0])]
        return int(best[np.searchsorted(best, b) - 1])

    def pieces(self, overlap: int, least: int) -> Iterator[tuple[int, int, int]]:
        """``(start, end, strength of the cut at the end)``; the last piece has the strength of a paragraph."""
        begin, done = 0, 0
        while self.length - begin > self.max_chars:
            limit = begin + self.max_chars
            at = self.strongest(begin + least - 1, limit)
            if at < 0:
                at = self.strongest(done + overlap, limit)
            if at < 0:
                end, strength = limit, 0
            else:
                end, strength = int(self.end[at]), int(self.strength[at])
            yield begin, end, strength
            # Back by the overlap, on to the next beginning of a word if one lies within it.
            back = end - overlap
            k = int(np.searchsorted(self.start, back))
            begin = int(self.start[k]) if k < len(self.start) and self.start[k] < end else back
            done = end
        if begin < self.length or begin == 0:
            yield begin, self.length, len(BOUNDARIES) - 1


def token_chars(tokens: int) -> int:
    """The greatest number of characters that count as ``tokens``."""
    return tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1


def split_texts(
    df: DataFrame,
    id_column: str,
    text_column: str,
    keep: list[str],
    max_tokens: int = 800,
    overlap_tokens: int = 40,
    least_fill: float = 0.5,
) -> DataFrame:
    """Pieces of at most ``max_tokens`` of every text: id, ``keep``, piece_index, start, text, token_count, cut, boundary.

    In each window of permissible lengths (``least_fill`` of the limit up to the limit) the strongest cut is
    taken, the rightmost of equals, from a sparse-table range-maximum index; a window without any cut is widened
    downwards and then cut hard. The next piece begins ``overlap_tokens`` back, moved forward to the beginning of
    a word if there is one. Joined without their overlaps the pieces give the text back, but for white space at
    cuts. ``boundary`` says at what kind of place cutting alone would keep all units within the limit; it is
    null for texts within the limit, which come out as one piece.

    Narrow: one pass, no shuffle. A text is split whole, however long; memory is a few bytes a character.
    Null text gives one piece with null text, empty text one empty piece. ``token_count`` is counted from the
    piece, whatever a column of that name says. Repeated rows are each split. ``keep`` lists columns to carry, which must
    not be called like those of the pieces; all others, whatever their names, are left out.
    """
    ship_package(df.sparkSession)
    made = {"piece_index", "start", "text", "token_count", "cut", "boundary"}
    if made & {id_column, *keep}:
        raise ValueError(f"rename {sorted(made & {id_column, *keep})}: the pieces have columns of that name")
    max_chars, overlap = token_chars(max_tokens), overlap_tokens * CHARS_PER_TOKEN
    least = max(overlap + 1, int(max_chars * least_fill))
    schema = T.StructType(
        [
            df.schema[id_column],
            *[df.schema[c] for c in keep],
            T.StructField("piece_index", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("token_count", T.IntegerType()),
            T.StructField("cut", T.StringType()),
            T.StructField("boundary", T.StringType()),
        ]
    )
    result = T.ArrayType(T.StructType(schema.fields[1 + len(keep) :]))

    @F.pandas_udf(result)
    def cut_up(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is None:
                out.append([(0, 0, None, None, None, None)])
                continue
            if len(text) <= max_chars:
                out.append([(0, 0, text, max(1, len(text) // CHARS_PER_TOKEN), None, None)])
                continue
            cuts = Cuts(text, max_chars)
            boundary = BOUNDARIES[cuts.weakest_needed()]
            spans = list(cuts.pieces(overlap, least))
            out.append(
                [
                    (
                        i,
                        a,
                        text[a:b],
                        max(1, (b - a) // CHARS_PER_TOKEN),
                        BOUNDARIES[s] if i + 1 < len(spans) else None,
                        boundary,
                    )
                    for i, (a, b, s) in enumerate(spans)
                ]
            )
        return pd.Series([[dict(zip(("piece_index", "start", "text", "token_count", "cut", "boundary"), p)) for p in ps] for ps in out])

    return df.select(id_column, *keep, F.explode(cut_up(F.col(text_column))).alias("__piece")).select(
        id_column, *keep, "__piece.*"
    )
