import random
import unicodedata

from pyspark.sql import functions as F

from fiscalith.llm.lookalike import PROTOTYPE, consistent_form, look, lookalike_classes, lookalike_pairs, normalize_texts, resolved_scripts, visible


def test_same_look():
    same = [
        ("Café ｆull", "Café full"),
        ("ra​dar­﻿ set", "radar set"),
        ("a b c　d", "a b c d"),
        ("ﬁeld oﬃce", "field office"),
        ("Раyрal", "Paypal"),  # Cyrillic letters inside a Latin word
        ("Οne", "One"),
        ("e͏́", "é"),
        ("non‑stop", "non-stop"),
        ("K9", "K9"),
        ("МОСКВА стоит", "MOCKBA cтоит"),
        ("ệ", "ệ"),
        ("ё", "ë"),
        ("сору", "copy"),  # a word of look-alikes only
    ]
    for a, b in same:
        assert consistent_form(a) == consistent_form(b), (a, b)
        assert look(a) == look(b)


def test_other_scripts_and_signs():
    same = [
        ("ρrοgrαm", "program"),  # Greek alpha and rho among Latin letters
        ("wσrd", "word"),
        ("fυll", "full"),
        ("rօad", "road"),  # Armenian
        ("Ꭺrmy", "Army"),  # Cherokee
        ("ꓮrmy", "Army"),  # Lisu
        ("ᎪᏢ", "AP"),
        ("Ⅰ and ⅼ and Ⅻ", "I and l and XII"),
        ("1∕2", "1/2"),
        ("9∶30", "9:30"),
        ("aǀb", "a|b"),
        ("⼀", "一"),
    ]
    for a, b in same:
        assert consistent_form(a) == consistent_form(b) == b, (a, b)
        assert look(a) == look(b)
    # Where Greek can write the word, and in a sign that stands alone, these letters are what they are.
    for a, b in [("σας", "οας"), ("α", "a"), ("3 σ", "3 o"), ("λόγου", "λόγoυ".replace("υ", "u")), ("ſ", "s"), ("ϑ", "θ"), ("ㄱㅏ", "가")]:
        assert consistent_form(a) != consistent_form(b), (a, b)
    assert consistent_form("η σωστή αρχή") == "η σωστή αρχή"


def test_different_look():
    different = [("a", "A"), ("e", "é"), ("1", "l"), ("2", "²"), ("1/2", "½"), ("a b", "a  b"), ("a\nb", "a b"), ("a-b", "a–b"), ("rn", "m"), ("0", "O"), ("к", "k"), ("a\r\n", "a\n"), ("ß", "ss"), ("'", "’")]
    for a, b in different:
        assert consistent_form(a) != consistent_form(b), (a, b)


def test_one_script_is_chosen():
    assert consistent_form("pаypal") == "paypal"  # mixed: only Latin can write it all
    assert consistent_form("Mосква") == "Москва"  # only Cyrillic can
    assert consistent_form("она сказала cop") == "она сказала сор"  # could be either: the text is Cyrillic
    assert consistent_form("cop said naïve сор") == "cop said naïve cop"
    assert resolved_scripts("жg") == frozenset() and consistent_form("жаg") == "жag"


def test_form_and_look_agree():
    rng = random.Random(4)
    alphabet = "aceopxyABHTgж日éëασρυλօꓮⅠ \n ​́ｅ" + "".join(list(PROTOTYPE)[:40])
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 6))) for _ in range(3000)]
    by_look, by_form = {}, {}
    for t in texts:
        by_look.setdefault(look(t), set()).add(consistent_form(t))
        by_form.setdefault(consistent_form(t), set()).add(look(t))
        assert consistent_form(consistent_form(t)) == consistent_form(t)
        assert unicodedata.is_normalized("NFC", consistent_form(t))
    assert all(len(v) == 1 for v in by_look.values()) and all(len(v) == 1 for v in by_form.values())


def test_visible():
    assert [visible(consistent_form(t)) for t in ("", " \n\t", "​﻿", " ", "\x00", ".", "́")] == [False] * 5 + [True] * 2


def pairs(spark, rows, **extra):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return sorted(tuple(r) for r in lookalike_pairs(df, "doc_id", "text").collect())


def test_pairs(spark):
    rows = [(1, "radar"), (2, "rаdar"), (3, "radar"), (4, "Radar"), (5, None), (6, ""), (7, " "), (8, " "), (9, "ra­dar"), (10, "solo"), (10, "solo")]
    assert pairs(spark, rows, f1=1, id="x", t1=None) == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9)]
    assert pairs(spark, []) == []


def test_hot_copies_cost_links_only(spark):
    rows = [(i, "copy of a text") for i in range(2000)] + [(5000, "cоpy of a text")]
    assert pairs(spark, rows) == [(i, 5000) for i in range(2000)]


def test_long_text(spark):
    long = "wordé " * 300_000
    assert pairs(spark, [(1, long), (2, long.replace("o", "о")), (3, long + "x")]) == [(1, 2)]


def test_forms_table(spark):
    df = spark.createDataFrame([(1, "ｒadar"), (2, None), (3, "​"), (1, "ｒadar")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.form, r.shows) for r in normalize_texts(df, "doc_id", "text").collect()), key=str)
    assert got == [(1, "radar", True), (1, "radar", True), (2, None, False), (3, "", False)]


def test_classes_and_dealt_out_spellings(spark):
    forms = ["radar set", "rаdar set", "radаr set", "rаdаr set", "radar sеt"]
    rows = [(i, forms[i % 5]) for i in range(20)] + [(50, "plain"), (51, "plain"), (60, None), (61, ""), (62, "\u200b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"f1": F.lit("x"), "links": F.lit(1)})
    got = sorted(tuple(r) for r in lookalike_classes(df, "doc_id", "text").collect())
    assert got == [(i, 0, 20, 5, 16) for i in range(20)]
    want = sorted((i, j) for i in range(20) for j in range(i + 1, 20) if i % 5 != j % 5)
    for at_once in (1000, 2, 1):
        assert sorted(tuple(r) for r in lookalike_pairs(df, "doc_id", "text", at_once).collect()) == want
    assert lookalike_classes(df.where("doc_id >= 50"), "doc_id", "text").count() == 0
