"""One consistent form for texts that look the same."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscalith.session import cut_lineage, ship_package

# Letters drawn alike, by script: the letters, and below them the Latin ones that they look like.
_ALIKE = {
    "CYRILLIC": (
        "АВСЕԌНІӀЈКМОРԚЅТѴԜХУҮасԁеһіјӏорԛѕѵԝхуү",
        "ABCEGHIIJKMOPQSTVWXYYacdehijlopqsvwxyy",
    ),
    "GREEK": (
        "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖονϲϳ",
        "ABEHIKMNOPTXYZovcj",
    ),
    "ARMENIAN": (
        "ՕՍՏօսհոցզյ",
        "OUSouhngqj",
    ),
    "CHEROKEE": (
        "ᎠᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏙᏚᏞᏟᏢᏦᏴ",
        "DTAJEWMHYGZRVSLCPKB",
    ),
    "LISU": (
        "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ",
        "BPDTGKJCZFMNLSRVHWXYAEIOU",
    ),
    "LATIN": (
        "ɡɑ",
        "ga",
    ),
}
# Greek letters that are like these Latin ones in some typefaces only. They count as such in a word that Greek cannot write.
_SOMETIMES = ("αρσυ", "apou")
# Signs drawn alike, and signs of category Cf that do show.
_SIGNS = {
    0x00B5: "μ",
    0x01C0: "|",
    0x01C3: "!",
    0x02BC: "’",
    0x055A: "’",
    0x0589: ":",
    0x2010: "-",
    0x2011: "-",
    0x2024: ".",
    0x2044: "/",
    0x2215: "/",
    0x2216: "\\",
    0x2223: "|",
    0x2236: ":",
    0x29F8: "/",
    0xA789: ":",
}
# Blocks whose one-character compatibility forms are drawn as what they stand for (numerals, radicals, letter-like symbols).
_SAME_DRAWING = (range(0x2135, 0x2139), range(0x2160, 0x2180), range(0x2E80, 0x2FE0), range(0x3038, 0x303B))
_SHOWN_FORMATS = frozenset([*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD])
_HIDDEN_OTHERS = frozenset([0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])

LATIN, CYRILLIC, GREEK = "LATIN", "CYRILLIC", "GREEK"

#: What a letter looks like: its Latin prototype, itself for a letter without look-alikes.
PROTOTYPE = {x: p for letters, latin in _ALIKE.values() for x, p in zip(letters, latin)}

_TO_PROTOTYPE = str.maketrans(PROTOTYPE)
_ASCII = frozenset(map(chr, range(128)))

#: How a prototype is written in each script that has the look; the first of several is used.
SPELLINGS: dict[str, dict[str, str]] = {}
for _script, (_letters, _latin) in _ALIKE.items():
    for _x, _p in zip(_letters, _latin):
        if _script != LATIN:
            SPELLINGS.setdefault(_p, {LATIN: _p}).setdefault(_script, _x)

_ALL = frozenset(["*"])
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_VISIBLE = re.compile(r"[^\s\x00-\x1f\x7f-\x9f]")


def _fold_sign(code: int) -> str:
    """What stands for one character before letters are looked at; empty for one that shows nothing."""
    ch = chr(code)
    if code in _SIGNS:
        return _SIGNS[code]
    kind = unicodedata.category(ch)
    if (kind == "Cf" and code not in _SHOWN_FORMATS) or code in _HIDDEN_OTHERS:
        return ""
    if kind == "Cc":
        return "" if 0x80 <= code <= 0x9F and code != 0x85 else ch
    if kind == "Zs":
        return " "
    tag, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    tag = tag.lstrip("<")
    if tag in ("wide", "narrow", "initial", "medial", "final", "isolated"):
        return "".join(_fold_sign(int(x, 16)) for x in rest.split())
    if tag == "compat":
        parts = [int(x, 16) for x in rest.split()]
        if (len(parts) > 1 and parts[0] != 0x20) or any(code in block for block in _SAME_DRAWING):
            return "".join(map(_fold_sign, parts))
    return ch


class _Fold(dict):
    """A table for ``str.translate`` that fills itself; characters are at most a few thousand in practice."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _fold_sign(code)
        return out


_FOLD = _Fold()


def visible(text: str) -> bool:
    """Whether ``text``, in consistent form, shows anything."""
    return _VISIBLE.search(text) is not None


@lru_cache(maxsize=1 << 16)
def scripts_of(ch: str) -> frozenset[str]:
    """Scripts in which this look can be written; ``*`` for a mark or numeral, which goes with any."""
    prototype = PROTOTYPE.get(ch, ch)
    if prototype in SPELLINGS:
        return frozenset(SPELLINGS[prototype])
    if unicodedata.category(ch)[0] in "MN":
        return _ALL
    if ch.isascii():
        return frozenset([LATIN])
    return frozenset([unicodedata.name(ch, "OTHER").partition(" ")[0]])


@lru_cache(maxsize=1 << 16)
def resolved_scripts(token: str) -> frozenset[str]:
    """The scripts in which all of the token can be written: none for a token of mixed script, several for a
    whole-script confusable."""
    left: frozenset[str] | None = None
    for ch in token:
        s = scripts_of(ch)
        if s is not _ALL:
            left = s if left is None else left & s
            if not left:
                break
    return left if left is not None else _ALL


@lru_cache(maxsize=1 << 16)
def spell(token: str, script: str) -> str:
    """The token's look in ``script``; a letter without a look-alike there takes its prototype."""
    out = []
    for ch in token:
        prototype = PROTOTYPE.get(ch, ch)
        out.append(SPELLINGS.get(prototype, {}).get(script, prototype))
    return "".join(out)


_SOMETIMES_LATIN = str.maketrans(*_SOMETIMES)
_ANY_SOMETIMES = re.compile(f"[{_SOMETIMES[0]}]")


def _foreign(match: re.Match) -> str:
    """A token in which Greek letters stand for Latin ones: Greek cannot write the others of it."""
    token = match.group()
    other = any(c not in _SOMETIMES[0] and (s := scripts_of(c)) is not _ALL and GREEK not in s for c in token)
    return token.translate(_SOMETIMES_LATIN) if other else token


def _separated(text: str) -> str:
    """Signs folded, nothing hidden, accents apart from their letters, no Greek letters among others."""
    text = unicodedata.normalize("NFD", text.translate(_FOLD))
    return _TOKEN.sub(_foreign, text) if _ANY_SOMETIMES.search(text) else text


@lru_cache(maxsize=1 << 16)
def _plain(ch: str) -> bool:
    """Whether a character stands for itself in any company: nothing folds it, and its letter is Latin without look-alikes."""
    apart = unicodedata.normalize("NFD", ch)
    if _FOLD[ord(ch)] != ch or unicodedata.category(ch).startswith("M") or unicodedata.normalize("NFC", apart) != ch:
        return False
    return all(c not in PROTOTYPE and (not c.isalpha() or LATIN in scripts_of(c)) for c in apart)


def _settled(text: str) -> bool:
    """Whether ``text`` is seen to be its own consistent form without taking it apart."""
    return all(map(_plain, set(text) - _ASCII)) and unicodedata.is_normalized("NFC", text)


def consistent_form(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``; null for null.

    Widths, blanks, hidden signs, joined letters and accent encodings are made one. Then each token is written in
    a single script: the only one in which all of its looks exist; for a whole-script confusable the script in which
    most of the text's unambiguous tokens are (Latin if none is, or at equal numbers); for a token that no one script can
    write, each letter takes its prototype. All choices depend on looks alone, so texts that look the same
    come out equal, and different looks never become the same.
    """
    if text is None or text.isascii() or _settled(text):
        return text
    text = _separated(text)
    if text.isascii():
        return text
    if all(not c.isalpha() or LATIN in scripts_of(c) for c in set(text)):
        # Nothing in it can only be written otherwise, so every token can be Latin, and is.
        return unicodedata.normalize("NFC", text.translate(_TO_PROTOTYPE))
    count: Counter[str] = Counter()
    for token in _TOKEN.findall(text):
        scripts = resolved_scripts(token)
        if len(scripts) == 1 and scripts is not _ALL:
            count[next(iter(scripts))] += 1
    most = max(count.values(), default=0)
    leading = [s for s, n in count.items() if n == most]
    main = LATIN if not leading or LATIN in leading else min(leading)

    def respell(match: re.Match) -> str:
        token = match.group()
        scripts = resolved_scripts(token)
        if len(scripts) == 1:
            return spell(token, next(iter(scripts)))
        return spell(token, main if main in scripts else LATIN)

    return unicodedata.normalize("NFC", _TOKEN.sub(respell, text))


def look(text: str) -> str:
    """The text by its looks, each letter by its prototype: equal for exactly the texts of equal consistent form."""
    if text.isascii() or _settled(text):
        return text
    text = _separated(text)
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_TO_PROTOTYPE))


def _halves(text: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def normalize_texts(df: DataFrame, id_column: str, text_column: str, form_column: str = "form") -> DataFrame:
    """``id_column``, ``form_column`` (the consistent form) and ``shows`` (whether any character of it is visible).

    Narrow, over Arrow batches; whole texts. Null text has a null form and shows nothing; repeated rows are
    normalized each; other columns are not read.
    """
    ship_package(df.sparkSession)
    schema = T.StructType([df.schema[id_column], T.StructField(form_column, T.StringType()), T.StructField("shows", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [consistent_form(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(forms, pa.string()), pa.array([f is not None and visible(f) for f in forms])],
                names=[id_column, form_column, "shows"],
            )

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


def form_fingerprints(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id`` and 128-bit fingerprints of the consistent form (``f1``, ``f2``) and of the text (``t1``, ``t2``),
    for rows whose text shows something."""
    ship_package(df.sparkSession)
    longs = [T.StructField(c, T.LongType()) for c in ("f1", "f2", "t1", "t2")]
    schema = T.StructType([T.StructField("id", df.schema[id_column].dataType), *longs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, prints = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                form = consistent_form(text)
                if form is not None and visible(form):
                    own = _halves(text)
                    kept.append(i)
                    prints.append((own if form is text else _halves(form)) + own)
            columns = [pa.array([p[k] for p in prints], pa.int64()) for k in range(4)]
            ids = batch.column(0).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *columns], names=schema.names)

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


def lookalike_rows(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows whose look is written in two ways or more: ``id`` with its four fingerprint halves.

    Fingerprints are made once, being the costly part, and written down as 40 bytes a row. Then two shuffles of these rows. Whether a look has several spellings is an aggregate combined on
    the map side, so a hot look (a third of all rows being copies, say) arrives as one row a task.
    """
    prints = cut_lineage(form_fingerprints(df, id_column, text_column))
    several = (
        prints.groupBy("f1", "f2")
        .agg(F.min("t1").alias("a1"), F.max("t1").alias("b1"), F.min("t2").alias("a2"), F.max("t2").alias("b2"))
        .where((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")))
        .select("f1", "f2")
    )
    return prints.join(several, ["f1", "f2"], "left_semi")


def lookalike_classes(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id_column``, ``class_id``, ``class_size``, ``spellings`` and ``links`` of each row that looks like a row of other characters.

    A class holds all rows of one look; its id is the smallest of theirs. ``links`` is with how many rows of the class a row differs in characters:
    the pairs of ``lookalike_pairs`` that it is in, counted without making them. Rows repeated under one id count each. Texts that are null or show
    nothing are in no class. Both aggregates are combined on the map side; nothing is gathered by class.
    """
    rows = cut_lineage(lookalike_rows(df, id_column, text_column))
    texts = rows.groupBy("f1", "f2", "t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    classes = texts.groupBy("f1", "f2").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("spellings"))
    about = texts.drop("least").join(classes, ["f1", "f2"]).drop("f1", "f2")
    return rows.select("id", "t1", "t2").join(about, ["t1", "t2"]).select(
        F.col("id").alias(id_column), "class_id", "class_size", "spellings", (F.col("class_size") - F.col("copies")).alias("links")
    )


#: Spellings of one look that one task links with the others at most, about.
SPELLINGS_A_TASK = 1000


def lookalike_pairs(df: DataFrame, id_column: str, text_column: str, at_once: int = SPELLINGS_A_TASK) -> DataFrame:
    """Pairs ``(<id>_a, <id>_b)``, a < b, of rows whose texts look the same but differ in characters.

    Links are made between distinct spellings of a look, never between copies of one, and only then handed on
    to the rows that hold those spellings: a hot group of exact copies costs as many rows as it has links to other
    texts. The spellings of a look that has many are dealt out to as many tasks as it takes for ``at_once`` of them in each, which
    all get the others. Texts that are null or show nothing pair with none. Fingerprints have 128 bits.
    """
    rows = cut_lineage(lookalike_rows(df, id_column, text_column))
    spellings = rows.select("f1", "f2", "t1", "t2").distinct()
    shares = spellings.groupBy("f1", "f2").agg(F.ceil(F.count(F.lit(1)) / at_once).cast("int").alias("shares"))
    spellings = spellings.join(shares, ["f1", "f2"])
    mine = spellings.withColumn("share", F.pmod("t1", "shares").cast("int")).drop("shares")
    other = spellings.select("f1", "f2", F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    before = (F.col("t1") < F.col("u1")) | ((F.col("t1") == F.col("u1")) & (F.col("t2") < F.col("u2")))
    links = mine.join(other, ["f1", "f2", "share"]).where(before).select("t1", "t2", "u1", "u2")
    left = rows.select("t1", "t2", F.col("id").alias("x"))
    right = rows.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("id").alias("y"))
    return (
        links.join(left, ["t1", "t2"])
        .join(right, ["u1", "u2"])
        .select(F.least("x", "y").alias(f"{id_column}_a"), F.greatest("x", "y").alias(f"{id_column}_b"))
        .where(F.col(f"{id_column}_a") < F.col(f"{id_column}_b"))
        .distinct()
    )
