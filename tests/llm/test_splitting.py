import random
import re

import numpy as np
import pytest

from fiscalith.llm.splitting import BOUNDARIES, Cuts, RangeMax, split_texts, token_chars

LIMIT = token_chars(800)


def kind(text, limit=LIMIT):
    units = (
        ("paragraph", re.split(r"\s*\n\s*\n\s*", text)),
        ("line", re.split(r"\s*\n\s*", text)),
        ("sentence", re.split(r"\s*\n\s*|(?<=[.?!])\s+", text)),
        ("word", re.split(r"\s+", text)),
    )
    return next((name for name, u in units if max(map(len, u)) <= limit), "none")


def random_text(rng, length):
    out = []
    while sum(map(len, out)) < length:
        out.append("x" * rng.randint(1, 60) + rng.choice([" ", " ", " ", ". ", "! ", "\n", "\r\n", "\n\n", "\n \t\n", "　"]))
    return "".join(out)


def test_range_maximum():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, 200)
    index = RangeMax(v, 200)
    low, high = rng.integers(0, 200, 500), rng.integers(0, 201, 500)
    want = [v[a:b].max() if a < b else 0 for a, b in zip(low, high)]
    assert index.query(low, high).tolist() == want


@pytest.mark.parametrize("seed", range(30))
def test_boundary_and_pieces_against_brute_force(seed):
    rng = random.Random(seed)
    limit, overlap, least = 200, 20, 100
    text = random_text(rng, rng.choice([210, 900, 4000]))
    if seed % 5 == 0:
        text += "y" * rng.choice([150, 201, 700]) + " end"
    cuts = Cuts(text, limit)
    assert BOUNDARIES[cuts.weakest_needed()] == (kind(text, limit) if len(text) > limit else "paragraph")
    runs = [(m.start(), m.end()) for m in re.finditer(r"\s+", text)]
    strength = {}
    for a, b in runs:
        feeds = text[a:b].count("\n")
        strength[a] = 4 if feeds > 1 else 3 if feeds else 2 if a and text[a - 1] in ".?!" else 1
    begin, done, want = 0, 0, []
    while len(text) - begin > limit:
        some = [a for a, _ in runs if begin + least - 1 < a <= begin + limit] or [a for a, _ in runs if done + overlap < a <= begin + limit]
        end = max(some, key=lambda a: (strength[a], a)) if some else begin + limit
        want.append((begin, end))
        back = end - overlap
        begin = next((b for _, b in runs if back <= b < end), back)
        done = end
    want.append((begin, len(text)))
    got = [(a, b) for a, b, _ in cuts.pieces(overlap, least)]
    assert got == want
    assert all(b - a <= limit for a, b in got)


def pieces_of(spark, texts):
    df = spark.createDataFrame([(i, t, "S", 7) for i, t in enumerate(texts)], "id int, text string, section_id string, token_count int")
    out = {}
    for r in split_texts(df, "id", "text", ["section_id"]).orderBy("id", "piece_index").collect():
        out.setdefault(r.id, []).append(r)
    return out


def test_pieces_cover_the_text(spark):
    rng = random.Random(9)
    texts = [random_text(rng, 20_000), "word " * 5000, "z" * 10_000, "short", "", None, random_text(rng, 20_000)]
    got = pieces_of(spark, texts)
    for i, text in enumerate(texts):
        rows = got[i]
        assert all(r.section_id == "S" for r in rows)
        if text is None:
            assert [(r.text, r.token_count) for r in rows] == [(None, None)]
            continue
        assert all(r.token_count <= 800 and r.text == text[r.start : r.start + len(r.text)] for r in rows)
        for a, b in zip(rows, rows[1:]):
            end = a.start + len(a.text)
            assert a.start < b.start <= end and 0 < end - b.start <= 160 or not text[end : b.start].strip()
        assert rows[-1].start + len(rows[-1].text) == len(text)
        if len(text) > LIMIT:
            assert rows[0].boundary == kind(text)
    assert [r.text for r in got[4]] == [""]


def test_very_long_text_and_reserved_names(spark):
    got = pieces_of(spark, ["ab " * 2_000_000, "q" * 1_000_000])
    assert all(r.token_count <= 800 for rows in got.values() for r in rows)
    assert got[0][0].boundary == "word" and got[1][0].boundary == "none"
    df = spark.createDataFrame([], "id int, text string, start int")
    assert split_texts(df, "id", "text", []).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "id", "text", ["start"])


def test_limit_is_exact(spark):
    got = pieces_of(spark, ["a" * 3203, "a" * 3204])
    assert len(got[0]) == 1 and len(got[1]) == 2
