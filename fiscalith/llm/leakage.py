"""Passages of evaluation items inside a training corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fiscalith.llm.lookalike import consistent_form, look
from fiscalith.session import cut_lineage, row_bound_holds, ship_package

#: Words of a window. Passages with fewer words, re-parameterised or not, share no window and are not found.
WINDOW = 10
#: Windows of all items that may be broadcast at most; more are joined through a shuffle.
MOST_BROADCAST = 500_000
#: Literal words that a template must have. A window with fewer, a run of a table of figures, would stand for any other and is compared
#: word by word instead.
LEAST_LITERAL = 2
#: Words of a literal run that are looked for before names are.
ANCHOR = 4
#: Share of capitals within sentences above which, in texts of so many words, they do not tell names (German, headlines).
MOST_CAPITALS, TELLING_WORDS = 0.3, 30
#: Bits of the filter that stands for more windows than are broadcast.
FILTER_BITS = 27

# Cardinal numbers in words, by language (one, which is an article too, left out).
_NUMBER_WORDS = {
    "en": "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion",
    "fr": "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille milliard",
    "de": "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend",
    "es": "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta cien mil",
    "ru": "два три четыре пять шесть семь восемь девять десять двадцать тридцать сорок пятьдесят сто тысяча тысяч миллион",
}
_CARDINALS = frozenset(look(w) for words in _NUMBER_WORDS.values() for w in words.split())
_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"[.?!]\W*$")
_OTHER_SCRIPTS = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\u2dff\ua4d0-\ua69f\uab30-\uabbf]")

NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"


def is_number(word: str) -> bool:
    """Whether a lower-case word is a number: it begins with a digit, or is a cardinal in words."""
    return word[0].isdigit() or word in _CARDINALS


def _code(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=seed)


_NUMBER_CODE, _UNIT_CODE, _NAME_CODE = (np.uint64(_code(kind)) for kind in (NUMBER, UNIT, NAME))
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, WINDOW - 1 - j, 1 << 64) for j in range(WINDOW)], dtype=np.uint64)


def _signed(code: int) -> int:
    return code - (1 << 64) if code >= 1 << 63 else code


def _mixed(total: np.ndarray) -> np.ndarray:
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (total ^ (total >> np.uint64(32))).view(np.int64)


class Codes(dict):
    """Words as numbers, all numbers as one; the memory is emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = code = int(_NUMBER_CODE) if is_number(word) else _code(word)
        return code


def name_flags(text: str, lowered: list[str]) -> list[int]:
    """Which words are names (1): capitalised within a sentence and no numbers. One that opens the text or a sentence may be a name (2).

    Capitals tell nothing, and there are no names, in a text all in capitals and in one of ``TELLING_WORDS`` words or more of which more than
    ``MOST_CAPITALS`` are capitalised within sentences.
    """
    found = list(_WORD.finditer(text))
    if len(found) != len(lowered) or text.isupper():
        return [0] * len(lowered)
    flags, end, within = [], 0, 0
    for m, low in zip(found, lowered):
        opens = not end or _SENTENCE_END.search(text[max(0, end - 1) : m.start()]) is not None
        within += not opens
        flags.append(0 if not text[m.start()].isupper() or is_number(low) else 2 if opens else 1)
        end = m.end()
    if within >= TELLING_WORDS and flags.count(1) > MOST_CAPITALS * within:
        return [0] * len(lowered)
    return flags


class Exactly:
    """Hashes that are sought, all of them: a small table first, then the sorted hashes."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.astype(np.int64))
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[self._short(self.sorted)] = True

    @staticmethod
    def _short(hashes: np.ndarray) -> np.ndarray:
        return (hashes.view(np.uint64) >> np.uint64(44)).view(np.int64)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ``hashes`` that are sought."""
        at = np.flatnonzero(self.table[self._short(hashes)])
        if not len(at):
            return at
        near = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        return at[self.sorted[near] == hashes[at]]


class Roughly:
    """Hashes that are sought as bits of a filter of fixed size: it lets some others pass and holds back none of them."""

    def __init__(self, words: np.ndarray, values: np.ndarray):
        self.bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
        self.bits[words] = values.view(np.uint64)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        word = self.bits[((h >> np.uint64(6)) & np.uint64(len(self.bits) - 1)).view(np.int64)]
        return np.flatnonzero((word >> (h & np.uint64(63))) & np.uint64(1))


def _grams(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    n = len(codes) - length + 1
    total = np.full(max(n, 0), np.uint64(length), dtype=np.uint64)
    for j in range(length if n > 0 else 0):
        total = total * np.uint64(_BASE) + codes[j : j + n]
    return _mixed(total)


def anchor(part: list[str]) -> tuple[int, int]:
    """Length and hash of the first ``ANCHOR`` words of the longest literal run of a template; a text without this run has no such window."""
    kinds = (NUMBER, UNIT, NAME)
    best, start = (0, 0), 0
    for j in range(len(part) + 1):
        if j == len(part) or part[j] in kinds:
            best = max(best, (j - start, -start))
            start = j + 1
    length, at = min(best[0], ANCHOR), -best[1]
    codes = np.array([_code(w) for w in part[at : at + length]], dtype=np.uint64)
    return length, int(_grams(codes, length)[0])


class Windows:
    """Windows over the words of many texts at once."""

    def __init__(self, names: bool, codes: Codes, anchors: dict[int, Exactly] | None = None):
        self.names, self.codes, self.anchors = names, codes, anchors
        self.words: list[str] = []
        self.shown: list[str | None] = []
        self.fresh: list[bool] = []
        self.ends: list[int] = [0]
        self.rows: list[int] = []

    def add(self, row: int, text: str) -> None:
        """The text by its looks, and where its letters in lower case look otherwise than their looks in lower case, these too.

        Capitals of other scripts can look Latin while their small letters do not, so neither order alone meets both a passage in
        the other letter case and one with single letters exchanged.
        """
        shown = look(text)
        words = _WORD.findall(shown.lower())
        self._append(row, words, shown, [True] * len(words))
        if not text.isascii() and _OTHER_SCRIPTS.search(text):
            others = _WORD.findall(look(consistent_form(text).lower()))
            if others != words:
                same = len(others) == len(words)
                fresh = [a != b for a, b in zip(others, words)] if same else [True] * len(others)
                self._append(row, others, shown if same else None, fresh)

    def _append(self, row: int, words: list[str], shown: str | None, fresh: list[bool]) -> None:
        if len(words) >= WINDOW:
            self.words += words
            self.fresh += fresh
            self.shown.append(shown)
            self.ends.append(len(self.words))
            self.rows.append(row)

    def _flags(self, codes: np.ndarray) -> np.ndarray:
        """Names of all texts; with anchors, of those texts only that have one."""
        flags = np.zeros(len(codes), dtype=np.int8)
        texts = np.arange(len(self.rows))
        if self.anchors is not None:
            hits = [sought.among(_grams(codes, length)) for length, sought in self.anchors.items()]
            places = np.concatenate(hits) if hits else np.zeros(0, dtype=np.int64)
            texts = np.unique(np.searchsorted(np.array(self.ends), places, side="right") - 1)
        for t in texts.tolist():
            shown, start, end = self.shown[t], self.ends[t], self.ends[t + 1]
            if shown is not None:
                flags[start:end] = name_flags(shown, self.words[start:end])
        return flags

    def found(self, sought: Exactly | Roughly | None) -> Iterator[tuple]:
        """``(row, named, h1, h2, slots, at, of, anchor_length, anchor)`` of each window, or of those whose hash is sought."""
        n = len(self.words) - WINDOW + 1
        if n <= 0:
            return
        codes = np.fromiter(map(self.codes.__getitem__, self.words), dtype=np.uint64, count=len(self.words))
        ends = np.array(self.ends)
        inside = np.ones(n, dtype=bool)
        for k in range(1, WINDOW):  # windows that run over the end of a text
            cut = ends[1:-1] - k
            inside[cut[cut < n]] = False
        if not all(self.fresh):
            fresh = np.concatenate([[0], np.cumsum(self.fresh)])
            inside &= fresh[WINDOW:] > fresh[:-WINDOW]  # of a second form only what differs from the first
        number = codes == _NUMBER_CODE
        unit = np.zeros(len(codes), dtype=bool)
        unit[1:] = number[:-1] & ~number[1:]
        yield from self._variant(0, codes, number, unit, None, inside, sought)
        if self.names:
            flags = self._flags(codes)
            for variant, name in ((1, flags == 1), (2, flags > 0)):
                counts = np.concatenate([[0], np.cumsum(flags == variant)])
                holds = inside & (counts[WINDOW:] > counts[:-WINDOW])
                if holds.any():
                    yield from self._variant(variant, codes, number, unit, name, holds, sought)

    def _variant(
        self, variant: int, codes: np.ndarray, number: np.ndarray, unit: np.ndarray, name: np.ndarray | None, use: np.ndarray, sought: Exactly | Roughly | None
    ) -> Iterator[tuple]:
        """Windows of one way to tell names. A word is a unit if it follows a number of its window, so that a template depends on the words
        of its window alone."""
        n = len(use)
        first = codes if name is None else np.where(name, _NAME_CODE, codes)
        later = np.where(unit, _UNIT_CODE, first)
        total = first[:n] * _POWERS[0]
        for j in range(1, WINDOW):
            total += later[j : j + n] * _POWERS[j]
        hashes = _mixed(total)
        is_first = number if name is None else number | name
        is_later = is_first | unit
        counts = np.concatenate([[0], np.cumsum(is_later)])
        literal = WINDOW - is_first[:n].astype(np.int64) - (counts[WINDOW : n + WINDOW] - counts[1 : n + 1])
        bare = use & (literal < LEAST_LITERAL)
        use = use & ~bare
        found = np.flatnonzero(use) if sought is None else (at := sought.among(hashes))[use[at]]
        yield from self._rows(variant, hashes, found, unit, number, name)
        if variant == 0 and bare.any():  # with names these would be the same again
            at = np.flatnonzero(bare)
            whole = np.array([_signed(_code(" ".join(self.words[i : i + WINDOW]), seed=2)) for i in at.tolist()], dtype=np.int64)
            if sought is not None:
                kept = sought.among(whole)
                at, whole = at[kept], whole[kept]
            hashes[at] = whole
            yield from self._rows(0, hashes, at, None, None, None)

    def _rows(
        self, variant: int, hashes: np.ndarray, at: np.ndarray, unit: np.ndarray | None, number: np.ndarray | None, name: np.ndarray | None
    ) -> Iterator[tuple]:
        ends = np.array(self.ends)
        owner = np.searchsorted(ends, at, side="right") - 1
        for i, o in zip(at.tolist(), owner.tolist()):
            part, slots = [], []
            for j in range(i, i + WINDOW):
                kind = None
                if number is not None:
                    kind = NUMBER if number[j] else UNIT if j > i and unit[j] else NAME if name is not None and name[j] else None
                part.append(kind or self.words[j])
                if kind:
                    slots.append(self.words[j])
            length, run = anchor(part) if variant and self.anchors is None else (0, 0)
            start, end = self.ends[o], self.ends[o + 1]
            second = _signed(_code(" ".join(part), seed=1))
            yield self.rows[o], variant, int(hashes[i]), second, slots, i - start, end - start - WINDOW + 1, length, run


#: Words gathered before their windows are looked at.
GATHERED = 300_000


def template_windows(
    df: DataFrame,
    id_column: str,
    text_column: str,
    sought: Exactly | Roughly | None = None,
    anchors: dict[int, Exactly] | None = None,
    names: bool = True,
) -> DataFrame:
    """Windows of every text as templates: ``id``, ``named``, ``h1``, ``h2`` (hashes of the template), ``slots``, ``at``, ``of`` (its place among
    how many windows), ``run_length`` and ``run`` (a literal run that any text with a template with names has).

    Placeholders: a number is a word that begins with a digit or a cardinal in words, a unit the word after a number of the window, a name a word
    capitalised within a sentence. Each window comes without names replaced (``named`` 0) and, with ``names``, if it holds a name, once more with names
    replaced too (1), and if a capitalised word opens a text or sentence in it, with that word and the names replaced (2). The first kind depends on
    the lower-case words of the window alone, so windows of the same words always meet there.
    ``sought`` limits the output to windows of those hashes, ``anchors`` the search for names to texts that have one of these runs. Narrow; whole texts.
    """
    schema = T.StructType(
        [
            T.StructField("id", df.schema[id_column].dataType),
            T.StructField("named", T.IntegerType()),
            T.StructField("h1", T.LongType()),
            T.StructField("h2", T.LongType()),
            T.StructField("slots", T.ArrayType(T.StringType())),
            T.StructField("at", T.LongType()),
            T.StructField("of", T.LongType()),
            T.StructField("run_length", T.IntegerType()),
            T.StructField("run", T.LongType()),
        ]
    )
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((sought, anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        wanted, runs = shared.value

        def emit(ids: pa.Array, windows: Windows) -> pa.RecordBatch:
            rows = list(windows.found(wanted))
            index, named, h1, h2, slots, at, of, length, first = zip(*rows) if rows else ((),) * 9
            columns = [
                ids.take(pa.array(index, pa.int64())),
                pa.array(named, pa.int32()),
                pa.array(h1, pa.int64()),
                pa.array(h2, pa.int64()),
                pa.array(slots, pa.list_(pa.string())),
                pa.array(at, pa.int64()),
                pa.array(of, pa.int64()),
                pa.array(length, pa.int32()),
                pa.array(first, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            windows = Windows(names, codes, runs)
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    windows.add(row, text)
                if len(windows.words) >= GATHERED:
                    yield emit(batch.column(0), windows)
                    windows = Windows(names, codes, runs)
            yield emit(batch.column(0), windows)

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


def _filter_of(wanted: DataFrame) -> Roughly:
    """The hashes of ``wanted`` as bits, put together by the executors; its size does not depend on how many there are."""
    word = F.shiftrightunsigned("h1", 6).bitwiseAND((1 << (FILTER_BITS - 6)) - 1).alias("word")
    bit = F.expr("shiftleft(1L, CAST(h1 & 63 AS INT))").alias("bit")
    bits = wanted.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    return Roughly(bits.column("word").to_numpy(), bits.column("bits").to_numpy())


def leaked_windows(
    corpus: DataFrame,
    corpus_id: str,
    items: DataFrame,
    item_id: str,
    text_column: str = "text",
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """Corpus windows joined to item windows of the same template: ``corpus_id``, ``item_id``, ``exact``, ``consistent``, ``n_slots``, and the
    item's window ``at`` ``of``.

    ``consistent``: equal slot values of the item are equal in the corpus text and different ones differ, so the passage may be the item with other
    parameters. ``exact``: all slots hold the same words, so the ten words are the same.

    The items are the stated query set and are held against all of the corpus. If their windows are few enough, which
    is counted, their hashes go to every worker and only matching corpus windows leave Python, to be joined
    without a shuffle. Otherwise a filter of fixed size goes there instead, which holds back most of the others, and what passes is joined by a
    shuffle on the template's hashes. Both give the same rows.
    """
    own = template_windows(items, item_id, text_column)
    wanted = cut_lineage(own.select(F.col("id").alias("__item"), "named", "h1", "h2", F.col("slots").alias("__slots"), "at", "of", "run_length", "run").distinct())
    small = row_bound_holds(wanted, most_broadcast)
    if small:
        sought: Exactly | Roughly = Exactly(wanted.select("h1").distinct().toArrow().column(0).to_numpy())
        runs = wanted.where("run_length > 0").select("run_length", "run").distinct().toPandas()
        anchors = {int(n): Exactly(part.to_numpy()) for n, part in runs.groupby("run_length")["run"]}
    else:
        sought, anchors = _filter_of(wanted), None
    wanted = wanted.drop("run_length", "run")
    found = template_windows(corpus, corpus_id, text_column, sought, anchors).select("id", "named", "h1", "h2", "slots")
    joined = found.join(F.broadcast(wanted) if small else wanted, ["named", "h1", "h2"])
    pairs = F.arrays_zip(F.col("slots"), F.col("__slots"))
    ways = F.size(F.array_distinct(pairs))
    consistent = (ways == F.size(F.array_distinct("slots"))) & (ways == F.size(F.array_distinct("__slots")))
    return joined.select(
        F.col("id").alias(corpus_id),
        F.col("__item").alias(item_id),
        (F.col("slots") == F.col("__slots")).alias("exact"),
        consistent.alias("consistent"),
        F.size("slots").alias("n_slots"),
        "at",
        "of",
    )


def leaked_items(corpus: DataFrame, corpus_id: str, items: DataFrame, item_id: str, text_column: str = "text") -> DataFrame:
    """``corpus_id`` and ``item_id``, once for each corpus text that shares ten consecutive words with an item.

    Windows meet by their templates, numbers, units and names replaced; of those with consistent slots the ones whose slots are
    filled alike hold the item's own words. Words are runs of letters and digits by their looks, letter case ignored. Null, empty and
    shorter texts share none; repeated rows and passages give one row; only the named columns are read.
    """
    hits = leaked_windows(corpus, corpus_id, items, item_id, text_column)
    return hits.where("consistent AND exact").select(corpus_id, item_id).distinct()


def reparameterised_items(
    corpus: DataFrame, corpus_id: str, items: DataFrame, item_id: str, text_column: str = "text", most_slots: int = 4
) -> DataFrame:
    """Leaks in the same words or with other parameters: ``corpus_id``, ``item_id``, ``exact_windows``, ``changed_windows``, ``dense_windows``,
    ``least_slots``, ``share`` and ``rank``.

    Windows of the item that the text holds are counted as exact if its words are the same, as changed if their slots are filled otherwise but
    consistently, and as dense if so with more than ``most_slots`` slots; ``least_slots`` is the number of slots of the changed or dense window that has
    fewest, the smaller the surer. ``share`` is the part of the item's windows that the text holds in any of these ways, and ``rank`` the place of the
    item among those of its text by share, exact windows and smaller id: items that share their wording are one another's variants, and the one
    meant is among those of the highest share. Pairs of no kind are left out.
    """
    hits = leaked_windows(corpus, corpus_id, items, item_id, text_column).where("consistent")
    refilled = ~F.col("exact")
    # Once a window of the item, in its best way.
    windows = hits.groupBy(corpus_id, item_id, "at").agg(
        F.max("exact").alias("exact"), F.min(F.when(refilled, F.col("n_slots"))).alias("n_slots"), F.max("of").alias("of")
    )
    only, few = ~F.col("exact"), F.col("n_slots") <= most_slots
    place = Window.partitionBy(corpus_id).orderBy(F.desc("share"), F.desc("exact_windows"), item_id)
    return (
        windows.groupBy(corpus_id, item_id)
        .agg(
            F.count_if(F.col("exact")).alias("exact_windows"),
            F.count_if(only & few).alias("changed_windows"),
            F.count_if(only & ~few).alias("dense_windows"),
            F.min("n_slots").alias("least_slots"),
            F.round(F.count(F.lit(1)) / F.max("of"), 4).alias("share"),
        )
        .withColumn("rank", F.row_number().over(place))
    )
