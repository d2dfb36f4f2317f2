import pytest
from pyspark.sql import functions as F

from fiscalith.functions import numeric as N
from fiscalith.functions import text as X
from fiscalith.functions.documents import cleaned, packs, section_chunks, sliding, window_chunks
from fiscalith.functions.identifiers import canonical_agency, canonical_funding_type, canonical_pe_number, four_digit_year
from fiscalith.functions.similarity import common_subsequence, partial_ratio, ratio, token_set_ratio, token_sort_ratio, weighted_ratio
from fiscalith.sources import discovery as D


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_canonical_numbers(spark):
    rows = ["0604114A", " 0604 114a ", "604114A", "06-04-114a", "206M", "0023759-D8Z", None, "", "abc"]
    want = ["0604114A", "0604114A", "0604114A", "0604114A", "0000206M", "0023759D8Z", None, None, None]
    assert values(spark, canonical_pe_number, rows) == want


def test_canonical_vocabularies(spark):
    assert values(spark, canonical_agency, ["army ", "AF", "Defensewide", "ot&e", "air  force", None]) == ["Army", "Air Force", "Defense-Wide", "OT&E", "Air Force", None]
    rows = ["PY\xa0Actual", "prior year actual", "CY_REQUEST", "BY Req.", "else", None]
    assert values(spark, canonical_funding_type, rows) == ["PY Actual", "PY Actual", "CY Request", "BY Request", None, None]
    assert values(spark, four_digit_year, [0, 26, 95, 96, 99, 2004, None], "int") == [2000, 2026, 2095, 1996, 1999, 2004, None]


@pytest.mark.parametrize(
    "raw, number, acronyms, normalized, expanded",
    [
        ("LTAMDS", None, ["LTAMDS"], "ltamds", "lower tier air missile defense sensor"),
        (" 0604 114a ", "0604114A", [], "0604114A", "0604114A"),
        ("fund 0604114A now", "0604114A", [], "0604114A", "0604114A"),
        (
            "Future Tactical UAS (FTUAS) Advanced Dev", None, ["FTUAS", "UAS"], "future tactical uas ftuas dev",
            "future tactical unmanned aircraft system future tactical unmanned aircraft system development",
        ),
        ("M SHORAD", None, ["SHORAD"], "m shorad", "m short range air defense"),
    ],
)
def test_query_preparation(spark, raw, number, acronyms, normalized, expanded):
    p = values(spark, X.processed_query, [raw])[0]
    assert (p.pe_number_detected, p.acronyms, p.normalized, p.expanded) == (number, acronyms, normalized, expanded)


def test_query_preparation_of_nothing(spark):
    for p in values(spark, X.processed_query, [None, "", "  "]):
        assert (p.raw, p.pe_number_detected, p.acronyms, p.tokens) == ("", None, [], [])


def test_title_acronyms(spark):
    rows = ["Lower Tier Air Missile Defense (LTAMD) Sensor", "Maneuver - Short Range Air Defense (M-SHORAD)", "JOINT FIRES NATO Upgrade", None]
    assert values(spark, X.title_acronyms, rows) == [["LTAMD"], ["MSHORAD"], ["JOINT", "FIRES"], None]


def test_amounts(spark):
    rows = ["386,594             296,670       310,191", "24,359                            21,349", "27,833              34,572", "", "5,000", "1*  x  3", None]
    want = [(386594, 296670, 310191), (24359, None, 21349), (27833, None, 34572), (None,) * 3, (5000, None, None), (1, None, 3), (None,) * 3]
    assert [tuple(a) for a in values(spark, X.amounts, rows)] == want


def test_components(spark):
    rows = ["AF", "Dw, Ra", "space  force", "ote", "Defensewide", "o'hare-field"]
    assert values(spark, X.component, rows) == ["Air Force", "Defense-Wide", "Space Force", "OT&E", "Defense-Wide", "O'Hare-Field"]


def test_headers(spark):
    page = "x\nAppropriation: 3600F Research, Development, Test & Eval, AF                 Date: Feb 2010\ny"
    ote = "Appropriation: 0460 Operational Test and Evaluation, Defense"
    a, b, c = values(spark, X.appropriation, [page, ote, "nothing"])
    assert a.component == "Air Force" and b.component == "OT&E" and c is None


def test_cleaning_and_windows(spark):
    assert values(spark, X.cleaned_page, ["  a  \n12\nUNCLASSIFIED\n\n\n\nb"]) == ["a\n\nb"]
    assert values(spark, lambda c: X.approx_tokens(c), ["abc", "abcdefgh", ""]) == [1, 2, 1]
    assert cleaned("  a  \n12\nUNCLASSIFIED\n\n\n\nb") == "a\n\nb"
    assert list(sliding("abcdefgh")) == ["abcd", "defg", "gh"] and list(sliding("a")) == ["a"] and list(sliding("")) == []
    assert [n for _, n in packs(["x" * 4 * n for n in (300, 300, 300, 900, 10)], 800)] == [600, 300, 900, 10]


def test_headings_one_after_the_other():
    body = "word " * 60
    text = f"SEC. 1.\nSEC. 2.\n{body}\n\nsection 3A. Radars\n{body}SEC. 4. Not at the beginning of a line"
    got = [c.section_id for c in section_chunks(text, "\n")]
    assert got == ["SEC. 2", "SEC. 3A"]


def test_one_very_long_document():
    import time

    line = "The committee directs the department to report on the state of the program before the end of the year.\n\n"
    long = line * (50_000_000 // len(line))
    began = time.perf_counter()
    chunks = list(section_chunks(long, "\n\n"))
    assert sum(c.token_count for c in chunks) == long.count("\n\n") * ((len(line) - 2) // 4)
    headed = list(section_chunks("SEC. 1. Long section\n" + long, "\n\n"))
    assert len(headed) > 10_000 and {c.section_id for c in headed} == {"SEC. 1"}
    assert sum(1 for _ in window_chunks(long, "\n\n")) > 100_000
    assert time.perf_counter() - began < 120  # all that a step takes grows with the length alone


def test_growth_rules(spark):
    df = spark.createDataFrame([(386.0, 513.0), (0.0, 5.0), (5.0, 0.0), (100.0, 106.0), (100.0, 105.0), (100.0, 94.0), (0.0, 0.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = df.select(N.total_delta_pct(a, b), N.cagr_pct(a, b, 3), N.yoy_pct(a, b), N.trend_label(a, b)).collect()
    assert rows[0][0] == pytest.approx(32.901554) and rows[0][1] == pytest.approx(9.945305)
    assert [r[0] for r in rows[1:3]] == [0.0, -100.0] and [r[1] for r in rows[1:3]] == [0.0, 0.0]
    assert rows[1][2] == 100.0 and rows[6][2] == 0.0
    assert [r[3] for r in rows[3:]] == ["↑ UP", "→ FLAT", "↓ DOWN", "→ FLAT"]
    assert df.select(N.cagr_pct(a, b, 0)).first()[0] == 0.0


def test_similarity():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    for a, b in (("kitten", "sitting"), ("", "x"), ("abcab", "bca"), ("radio set", "set of radios")):
        assert common_subsequence(a, b) == plain(a, b) == common_subsequence(b, a)
    assert ratio("kitten", "sitting") == pytest.approx(61.538462)
    assert ratio("abc", "abc") == 100 and ratio("abc", "xyz") == 0
    assert token_sort_ratio("b a", "a b") == 100 and token_set_ratio("a b", "a b c d") == 100 and token_set_ratio("", "a") == 0
    assert partial_ratio("radar", "the radar set") == 100
    assert weighted_ratio("", "a") == 0 and weighted_ratio("radar", "radar") == 100


def test_paths(spark):
    rows = ["comptroller/1998/rdtee/fy1998_r1.pdf", "comptroller/2025/rdtee/army_r2.pdf", "draft_budget.zip"]
    assert values(spark, D.fiscal_year_of_path, rows) == [1998, 2025, None]
    assert values(spark, D.fiscal_year_of_name, rows) == [1998, 2025, 0]
    assert values(spark, D.exhibit_of_path, rows) == ["rdtee", "rdtee", "unknown"]
    assert values(spark, lambda c: D.component_of(D.file_name(c)), rows) == ["unknown", "army", "af"]
    assert values(spark, D.safe_file_name, ["https://a.b/c/d.pdf?x=1", "https://a.b/", "x.zip"]) == ["d.pdf", "document.pdf", "x.zip"]
    joined = values(spark, lambda c: D.joined_url(F.lit("https://a.b/c/d.html?q"), c), ["e.pdf", "/e.pdf", "http://x/y.pdf", "//x/y.pdf"])
    assert joined == ["https://a.b/c/e.pdf", "https://a.b/e.pdf", "http://x/y.pdf", "https://x/y.pdf"]
    assert D.canonical_names([" Award ID", "Place of Performance State Code", "a/b%"]) == ["award_id", "place_of_performance_state_code", "a_b"]


def test_shortcuts_change_no_result():
    import random

    from fiscalith.functions.similarity import partial_bound, partial_token_ratio

    rng = random.Random(8)
    words = "radar radio set of the glide body missile sonar dome".split()
    for _ in range(400):
        a = " ".join(rng.choices(words, k=rng.randint(1, 3)))
        b = " ".join(rng.choices([*words, "xqz", "radarr"], k=rng.randint(1, 9)))
        assert partial_ratio(a, b) <= partial_bound(a, b) + 1e-9
        longer = max(len(a), len(b)) / min(len(a), len(b))
        full = ratio(a, b)
        if longer < 1.5:
            full = max(full, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
        else:
            scale = 0.9 if longer <= 8 else 0.6
            full = max(full, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))
        assert weighted_ratio(a, b) == pytest.approx(full)
        cut = weighted_ratio(a, b, least=70.0)
        assert cut == pytest.approx(full) if full >= 70 else cut < 70


def test_bounds_and_the_best_of_many():
    import heapq  # noqa: F401
    import random

    from fiscalith.functions.similarity import Candidates, token_set_ratio, weighted_ratio

    rng = random.Random(8)
    words = "radar radars system systems of Next generation gen naval air defence defense a b é missile missiles 12 x-ray".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(300)] + ["", "radar", "  radar   system ", "z" * 3000, "radar system " * 40]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    queries = ["radar system", "next generation radar", "missle defence", "q", "naval  air", "radar", "z", "x" * 500, "", "System radar of gen air a b"]
    for scorer, bound in ((weighted_ratio, "weighted_bounds"), (token_set_ratio, "set_bounds")):
        for q in queries:
            parts = [Candidates(ids[a:b], texts[a:b]) for a, b in ((0, 100), (100, 101), (101, len(ids)))]
            for c in parts:
                for t, limit in zip(c.texts, getattr(c, bound)(q)):
                    assert scorer(q, t) <= limit + 1e-9, (scorer, q, t)
            for cutoff, keep in ((55.0, 5), (0.0, 15), (85.5, 3)):
                heap = []
                for c in parts:
                    c.best(getattr(c, bound)(q), lambda t: scorer(q, t), cutoff, keep, heap)
                want = sorted(((s, -i) for i, t in zip(ids, texts) if (s := scorer(q, t)) >= cutoff), reverse=True)[:keep]
                assert sorted(heap, reverse=True) == want, (scorer, q, cutoff)


def test_a_score_equal_to_the_least_is_exact():
    for a, b in (("radar", "the radar set"), ("dome sonar", "big sonar dome of xy"), ("abc", "xx abd xx"), ("glide body", "glidebody glidebody")):
        assert weighted_ratio(a, b, least=weighted_ratio(a, b)) == weighted_ratio(a, b)


def test_equal_texts_are_compared_once_and_sure_scores_spare_comparisons():
    import random

    from fiscalith.functions.similarity import Candidates

    rng = random.Random(3)
    words = "radar sonar system systems glide body missile dome of gen é naval".split()
    texts = sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(900)})
    free = list(range(3 * len(texts)))
    rng.shuffle(free)
    ids = [sorted(free.pop() for _ in range(rng.randint(1, 3))) for _ in texts]
    for q in ("radar system", "glide body missile", "missle", "sonar dome of gen", "qqq"):
        for scorer, limits, told in ((weighted_ratio, "weighted_limits", True), (token_set_ratio, "set_limits", False)):
            exact = {t: scorer(q, t) for t in texts}
            want = sorted(((s, -i) for at, t in zip(ids, texts) if (s := exact[t]) >= 55 for i in at), reverse=True)[:15]
            calls, heap = [], []

            def score(t, *least):
                calls.append(t)
                return scorer(q, t, *least)

            for a, b in ((0, 2), (2, len(texts))):
                c = Candidates(ids[a:b], texts[a:b])
                sure, most = getattr(c, limits)(q)
                assert all(lo - 1e-9 <= exact[t] <= hi + 1e-9 for t, lo, hi in zip(c.texts, sure, most))
                c.best(most, score, 55.0, 15, heap, told, sure)
            assert sorted(heap, reverse=True) == want, (scorer, q)
            assert len(calls) == len(set(calls))
            if q == "radar system":
                assert len(calls) < len(texts) / 3
