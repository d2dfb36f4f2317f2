import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fiscalith.llm.encoding import PATTERN, VOCABULARIES, Encoder, decode_ids, encode_texts, merge_word, read_vocabulary

ENCODER = Encoder(read_vocabulary("byte_bpe_50k"))


def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def reference(text):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{VOCABULARIES}/byte_bpe_50k.tiktoken", "rb"))}
    if not hasattr(reference, "e"):
        reference.e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return reference.e.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_equals_the_library_on_any_text(text):
    ids = ENCODER.encode(text)
    assert ids == reference(text)
    assert ENCODER.decode(ids) == text


def test_equals_both_libraries_on_prose():
    rng = random.Random(0)
    words = ["Missile's", "we'll", "1,234", "Peñasco", "Çaldera", "ﬁeld", "привет", "\n\n", "  ", "<|endoftext|>", "🚀", "á", "aaaaaaaa", "\t", "X9"]
    for _ in range(200):
        text = rng.choice([" ", ""]).join(rng.choices(words, k=30))
        assert ENCODER.encode(text) == reference(text) == library().encode(text, add_special_tokens=False).ids


def test_long_words():
    for word in ("ab" * 50_000, "".join(random.Random(1).choices("abcdefgh", k=50_000)), "0" * 30_000):
        ids = ENCODER.encode(word)
        assert ENCODER.decode(ids) == word
    short = "".join(random.Random(2).choices("etaoin", k=400))
    assert ENCODER.encode(short) == reference(short)


def test_merge_order_is_by_rank_then_left():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    assert merge_word(b"aaa", ranks) == [2, 0]
    assert merge_word(b"aaab", ranks) == [2, 3]
    assert merge_word(b"aab", {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3}) == [2, 1]


def test_table(spark):
    rows = [(1, "Radio set"), (2, ""), (3, None), (4, "Radio set"), (5, " ﻿")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' ids", "1 __piece")
    out = encode_texts(df, "doc_id", "text")
    assert dict(out.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got[2] == [] and got[3] == [] and got[1] == got[4] == reference("Radio set")
    back = {r.doc_id: r.text for r in decode_ids(out, "doc_id", "ids").collect()}
    assert back == {1: "Radio set", 2: "", 3: "", 4: "Radio set", 5: " ﻿"}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
