"""Encoding of texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscalith.session import ship_package

#: Where the vocabulary files are by default.
VOCABULARIES = "/opt/tokenizers"

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose ids a worker remembers at most; beyond it the memory is emptied.
REMEMBERED = 400_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its id a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the pair of lowest rank merges first, of equal ranks the leftmost.

    Symbols form a doubly linked list; candidate pairs wait in a priority queue. A merge changes its neighbours'
    pairs, so an entry is stale, and skipped, when either of its symbols is gone or has grown. Every merge
    adds at most two entries: n log n for a word of n bytes.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    symbol: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue: list[tuple[int, int, bytes, bytes]] = []

    def offer(left: int) -> None:
        right = after[left]
        if left >= 0 and right >= 0:
            rank = ranks.get(symbol[left] + symbol[right])
            if rank is not None:
                heapq.heappush(queue, (rank, left, symbol[left], symbol[right]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, left, a, b = heapq.heappop(queue)
        right = after[left]
        if symbol[left] is not a or right < 0 or symbol[right] is not b:
            continue
        symbol[left], symbol[right] = a + b, None
        after[left] = after[right]
        if after[left] >= 0:
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [ranks[s] for s in symbol if s is not None]


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, data: bytes):
        self.ranks = parse_ranks(data)
        self.words = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; an empty list for null and for empty text."""
        ids: list[int] = []
        if not text:
            return ids
        known = self.known
        for match in self.words.finditer(text) if len(text) > 1 << 20 else self.words.findall(text):
            word = match if isinstance(match, str) else match.group()
            found = known.get(word)
            if found is None:
                found = tuple(merge_word(word.encode("utf-8", "surrogatepass"), self.ranks))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(word) <= 64:
                    known[word] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of ``ids``, joined."""
        return b"".join(map(self.tokens().__getitem__, ids)).decode("utf-8", "replace")

    def tokens(self) -> dict[int, bytes]:
        if not hasattr(self, "_tokens"):
            self._tokens = {i: t for t, i in self.ranks.items()}
        return self._tokens


@lru_cache(maxsize=4)
def _encoder(data: bytes) -> Encoder:
    return Encoder(data)


def read_vocabulary(name: str, folder: str = VOCABULARIES) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def encode_texts(
    df: DataFrame,
    id_column: str,
    text_column: str,
    vocabulary: str = "byte_bpe_50k",
    folder: str = VOCABULARIES,
    ids_column: str = "ids",
) -> DataFrame:
    """``id_column`` and the ids of the whole text of every row; ``[]`` for null and for empty text.

    One narrow pass over Arrow batches. The vocabulary file, whose size is fixed (under 1 MB), is read once where the
    plan is built and broadcast; workers keep the ids of words they have met, up to a fixed number. Repeated
    rows are encoded each; other columns are not read.
    """
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary, folder))
    schema = T.StructType([df.schema[id_column], T.StructField(ids_column, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for text in batch.column(1):
                flat += encoder.encode(text.as_py())
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, ids_column])

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


def decode_ids(
    df: DataFrame,
    id_column: str,
    ids_column: str,
    vocabulary: str = "byte_bpe_50k",
    folder: str = VOCABULARIES,
    text_column: str = "text",
) -> DataFrame:
    """``id_column`` and the text that ``ids_column`` stands for; empty text for an empty list, null for null."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary, folder))
    schema = T.StructType([df.schema[id_column], T.StructField(text_column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, text_column])

    return df.select(F.col(id_column), F.col(ids_column)).mapInArrow(run, schema)
