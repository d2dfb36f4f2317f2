import json
import random

from pyspark.sql import functions as F

from fiscalith.operators.sequences import carry_forward, running_sum
from fiscalith.operators.vectors import cached_vectors, invalidate_vectors, missing_vectors, top_k_cosine
from fiscalith.plans.chunking import section_chunks, window_chunks
from fiscalith.plans.ingest import cascade, numbered, replace_documents, star_schema
from fiscalith.plans.linking import (
    acronym_index,
    acronym_lookup,
    acronym_matches,
    best_fuzzy_match,
    best_semantic_match,
    fuzzy_matches,
    link_queries,
    link_two_stage,
    semantic_matches,
)
from fiscalith.plans.listing import SAMPLE_PAGE, deduplicated, file_rows
from fiscalith.plans.policy import gap_analysis, policy_to_elements, search_chunks, section_mapping, section_representatives
from fiscalith.plans.trends import agency_trends, explore, funding_gaps, latest_funding

ELEMENTS = "pe_id bigint, pe_number string, program_name string, agency string, budget_activity string, is_classified boolean"


def elements(spark):
    return spark.createDataFrame(
        [
            (1, "0604114A", "Lower Tier Air Missile Defense (LTAMD) Sensor", "Army", "BA5", False),
            (2, "0604115A", "Maneuver - Short Range Air Defense (M-SHORAD)", "Army", "BA5", False),
            (3, "0604116F", "JOINT FIRES NATO Upgrade", "Air Force", None, False),
            (4, "0604117N", "Hypersonic Glide Body Prototype", "Navy", "BA4", False),
            (5, "0604114A", "Lower Tier Copy", "Navy", "BA5", False),
        ],
        ELEMENTS,
    )


def test_listing_page(spark):
    files = spark.createDataFrame([("a", SAMPLE_PAGE + "\f" + "page without header\n  7 0603002A  Second Page Title  03 U  1,000  2,000  3,000"), ("b", None)], "f string, t string")
    rows = {r.line_no: r for r in file_rows(files, "f", "t").collect()}
    assert sorted(rows) == [1, 2, 3, 4, 7]
    assert rows[2].pe_title == "Warfighter Technology (Continued Title)"
    assert rows[4].pe_number == "" and rows[4].is_classified and rows[4].py_amount == 100000
    assert rows[7].component == "Army" and (rows[7].py_amount, rows[7].cy_amount, rows[7].by_amount) == (1000, 2000, 3000)


def test_records_as_listing_files(spark, tmp_path):
    from fiscalith.catalog import QUERIES

    long = "Hypersonic Glide Body Prototype and Flight Demonstration"
    titles = [long, "Short Title", "Next Generation Program Advanced Technology Development"]
    rows = [
        (i, f"f{i % 2}", i, f"2020,{('Army', 'Navy', '')[i % 3]},{600000 + i:07d}A,{titles[i % 5 % 3]},{i + 1},05,{i + 1},2,3") for i in range(400)
    ]
    spark.createDataFrame(rows, "raw_id bigint, source_file string, file_line int, line_text string").write.parquet(f"{tmp_path}/raw_r1_lines.parquet")
    got = QUERIES["tvf02_listing_of_records"](spark, str(tmp_path)).collect()
    want = {(f, ("Army", "Navy", "Unknown")[i % 3], f"{600000 + i:07d}A", titles[i % 5 % 3], i + 1, i + 1.0, 2.0, 3.0) for i, f, *_ in rows}
    assert len(got) == 400
    assert {(r.source_file, r.component, r.pe_number, r.pe_title, r.line_no, r.py_amount, r.cy_amount, r.by_amount) for r in got} == want
    assert max(r.page for r in got) >= 5 and max(r.line for r in got) > 50  # pages without a header, continuation lines


def test_deduplication_keeps_most_amounts(spark):
    rows = [(2020, "Army", "1A", "01", 2, 1.0, None, None), (2020, "Army", "1A", "01", 1, 1.0, 2.0, 3.0), (2020, "Army", "1A", "01", 0, 1.0, None, 3.0)]
    df = spark.createDataFrame(rows, "fiscal_year int, component string, pe_number string, act_code string, line_no int, py_amount double, cy_amount double, by_amount double")
    assert [r.line_no for r in deduplicated(df, ["line_no"]).collect()] == [1]


def test_star_schema_is_idempotent(spark):
    rows = [
        (1, 2025, "Army", "0601102A", "Title A", 1, "01", False, 10.0, None, 30.0, "a.pdf"),
        (2, 2024, "Army", "0601102A", "Title A old", 1, "01", False, 7.0, 8.0, float("nan"), "b.pdf"),
        (3, 2025, "Army", "", "Classified Programs", 4, "07", True, 100.0, None, None, "a.pdf"),
        (4, None, "Army", "0601102A", "x", 1, "01", False, 1.0, 1.0, 1.0, "a.pdf"),
    ]
    schema = (
        "pos int, fiscal_year int, component string, pe_number string, pe_title string, line_no bigint, act_code string, is_classified boolean, "
        "py_amount double, cy_amount double, by_amount double, source_file string"
    )
    df = spark.createDataFrame(rows, schema).withColumns({"appropriation": F.lit(" "), "budget_activity": F.lit("BA1")})
    out = star_schema(df, ["pos"])
    assert [(r.filename, r.publication_year) for r in out["source_documents"].orderBy("id").collect()] == [("a.pdf", 2025), ("b.pdf", 2024)]
    names = {r.pe_number: (r.id, r.program_name, r.appropriation) for r in out["program_elements"].collect()}
    assert names["0601102A"][1] == "Title A" and names["0601102A"][2] is None
    assert "CLASSIFIED_Army_07_2025" in names
    lines = sorted((r.program_element_id, r.fiscal_year, r.funding_type, r.amount_thousands) for r in out["funding_lines"].collect())
    a, c = names["0601102A"][0], names["CLASSIFIED_Army_07_2025"][0]
    assert lines == sorted(
        [(a, 2023, "PY Actual", 10.0), (a, 2025, "BY Request", 30.0), (a, 2022, "PY Actual", 7.0), (a, 2023, "CY Request", 8.0), (c, 2023, "PY Actual", 100.0)]
    )
    again = star_schema(df.orderBy(F.desc("pos")), ["pos"])
    assert sorted(map(tuple, again["program_elements"].collect())) == sorted(map(tuple, out["program_elements"].collect()))


def test_second_load_keeps_ids(spark):
    schema = (
        "pos int, fiscal_year int, component string, pe_number string, pe_title string, line_no bigint, act_code string, is_classified boolean, "
        "py_amount double, cy_amount double, by_amount double, source_file string, appropriation string, budget_activity string"
    )
    row = lambda pos, number, file, year=2025: (pos, year, "Army", number, f"T{pos}", pos, "01", False, 1.0, None, 2.0, file, None, None)
    first = star_schema(spark.createDataFrame([row(1, "0600002A", "m.pdf")], schema), ["pos"], processed=F.lit("2026-01-01").cast("timestamp"))
    both = spark.createDataFrame([row(1, "0600002A", "m.pdf"), row(2, "0600001A", "a.pdf"), row(3, "0600002A", "a.pdf", 2026)], schema)
    second = star_schema(both, ["pos"], first, F.lit("2026-02-01").cast("timestamp"))
    assert {r.pe_number: (r.id, r.program_name) for r in second["program_elements"].collect()} == {"0600002A": (1, "T1"), "0600001A": (2, "T2")}
    assert {r.filename: (r.id, r.processed_date.month) for r in second["source_documents"].collect()} == {"m.pdf": (1, 1), "a.pdf": (2, 2)}
    lines = sorted((r.id, r.program_element_id, r.fiscal_year) for r in second["funding_lines"].collect())
    assert lines == [(1, 1, 2025), (2, 1, 2023), (3, 2, 2025), (4, 2, 2023), (5, 1, 2026), (6, 1, 2024)]
    third = star_schema(both, ["pos"], second)
    for name, table in second.items():
        assert sorted(map(tuple, third[name].collect())) == sorted(map(tuple, table.collect()))
    empty = star_schema(spark.createDataFrame([], schema), ["pos"])
    assert [t.count() for t in empty.values()] == [0, 0, 0]


def test_numbering_is_dense(spark):
    ids = [r.id for r in numbered(spark.range(500).select(F.col("id").alias("k")), ["k"], "id").orderBy("k").collect()]
    assert ids == list(range(1, 501))


def test_replace_and_cascade(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "f string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "f string, n int")
    assert sorted(map(tuple, replace_documents(old, new, "f", True).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, replace_documents(old, new, "f", False).collect())) == [("a", 1), ("b", 2), ("c", 4)]
    assert [r.n for r in cascade(old, "f", new, "f").collect()] == [2]


def test_sequences_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, i % 7, rng.choice([None, None, str(i)]), rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, pos int, tie int, v string, n int")
    carried = {(r.g, r.pos): r.v for r in carry_forward(df, ["g"], "pos", "v", tie="tie", block=16).collect()}
    summed = {(r.g, r.pos): r.s for r in running_sum(df, ["g"], "pos", "n", "s", tie="tie", block=16).collect()}
    last, total = {}, {}
    for g, pos, _, v, n in rows:
        last[g] = v or last.get(g)
        total[g] = total.get(g, 0) + n
        assert carried[g, pos] == last[g] and summed[g, pos] == total[g]


def test_acronyms(spark):
    index = acronym_index(elements(spark))
    assert {(r.pe_id, r.acronym) for r in index.collect()} == {(1, "LTAMD"), (2, "MSHORAD"), (3, "JOINT"), (3, "FIRES")}
    keys = ["LTAMD", "LTAMDS", "LTA", "LT", "MSHORAD", "ZZZ", ""]
    lookups = spark.createDataFrame([(k, 0, k) for k in keys], "query string, position int, key string")
    got = {(r.query, r.pe_id, r.score) for r in acronym_lookup(lookups, index).collect()}
    assert got == {("LTAMD", 1, 1.0), ("LTAMDS", 1, 0.85), ("LTA", 1, 0.9), ("MSHORAD", 2, 1.0)}


def test_the_first_lookup_that_finds_an_element_scores_it(spark):
    index = spark.createDataFrame([(1, "n", "RAD"), (2, "n", "SHIP"), (1, "n", "RADS")], "pe_id int, pe_number string, acronym string")
    lookups = spark.createDataFrame([("q", 0, "RA"), ("q", 1, "RAD"), ("q", 2, "SHIP")], "query string, position int, key string")
    assert {(r.pe_id, r.acronym, r.score) for r in acronym_matches(lookups, index).collect()} == {(1, "RAD", 0.9), (2, "SHIP", 1.0)}


def test_waterfall(spark):
    asked = ["0604114A", "LTAMDS", "Hypersonic Glide Bodies", "", None, "qqq zzz"]
    rows = link_queries(spark.createDataFrame([(q,) for q in asked], "query string"), elements(spark)).collect()
    stages = {}
    for r in rows:
        stages.setdefault(r.query, set()).add(r.match_stage)
    assert stages == {"0604114A": {"PE_NUMBER"}, "LTAMDS": {"ACRONYM"}, "Hypersonic Glide Bodies": {"FUZZY"}, "": {"NONE"}, "qqq zzz": {"NONE"}}
    assert sorted((r.rank, r.agency) for r in rows if r.query == "0604114A") == [(1, "Army"), (2, "Navy")]
    none = next(r for r in rows if r.query == "qqq zzz")
    assert (none.rank, none.program_name, none.score, none.pe_id) == (0, "MANUAL_REVIEW", 0.0, None)


def test_linking_takes_the_acronyms_from_titles_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        read.add(1)
        return name

    once = elements(spark).withColumn("program_name", counted.asNondeterministic()("program_name"))
    rows = link_queries(spark.createDataFrame([("LTAMDS",), ("NATO",)], "query string"), once).collect()
    assert {(r.query, r.match_stage, r.pe_id) for r in rows} >= {("LTAMDS", "ACRONYM", 1)}
    assert read.value <= 5 * 5  # index, spelling, vectors, names of what was found


def test_two_stage(spark):
    rows = link_two_stage(spark.createDataFrame([("Hypersonic Glide Body Prototype",), ("",), ("qqq",)], "query string"), elements(spark)).collect()
    got = {r.query: (r.match_strategy, r.matched_name) for r in rows}
    assert got == {"Hypersonic Glide Body Prototype": ("FUZZY", "Hypersonic Glide Body Prototype"), "": ("NONE", "INVALID_INPUT"), "qqq": ("NONE", "MANUAL_REVIEW")}


def test_fuzzy_blocks_lose_nothing(spark):
    q = spark.createDataFrame([("hypersonic glide",), ("air defense",), ("fires",)], "query string")
    whole = sorted(map(tuple, fuzzy_matches(q, elements(spark)).collect()))
    assert whole and whole == sorted(map(tuple, fuzzy_matches(q, elements(spark), block=1).collect()))


def test_fuzzy_over_repeated_titles_is_as_by_brute_force(spark, monkeypatch):
    from fiscalith.functions.similarity import token_set_ratio, weighted_ratio
    from fiscalith.plans import linking

    rng = random.Random(5)
    words = "radar sonar glide body missile dome naval laser bus kit".split()
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, "0604114A", rng.choice(names) if i % 3 else names[0], "Army", None, i % 10 == 9) for i in range(1, 400)]
    titles = spark.createDataFrame(rows, ELEMENTS)
    asked = sorted({*names[:8], "sonnar dome", "radarr kit glide"})
    want = set()
    for q in asked:
        legs = []
        for scorer in (weighted_ratio, token_set_ratio):
            scored = [(-scorer(q, r[2]), r[0]) for r in rows if not r[5]]
            legs.append(sorted(x for x in scored if x[0] <= -55)[:15])
        places = {}
        for leg, found in enumerate(legs):
            for n, (s, i) in enumerate(found):
                places.setdefault(i, []).append((s, leg, n))
        order = sorted((min(at)[0], min((leg, n) for _, leg, n in at), i, min(at)[1]) for i, at in places.items())
        want |= {(q, i, ("normalized", "original")[leg], n + 1) for n, (_, _, i, leg) in enumerate(order[:5])}
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    for task_rows, task_queries, tile in ((1 << 16, 16, 1 << 15), (100, 3, 7)):
        monkeypatch.setattr(linking, "TASK_ROWS", task_rows)
        monkeypatch.setattr(linking, "TASK_QUERIES", task_queries)
        monkeypatch.setattr(linking, "TILE_TEXTS", tile)
        for block in (4096, 4):
            got = {(r.query, r.pe_id, r.match_on, r["rank"]) for r in fuzzy_matches(queries, titles, block=block).collect()}
            assert got == want


def test_queries_of_stop_words_only(spark):
    titles = spark.createDataFrame(
        [(1, "0604114A", "Advanced Technology Development", "Army", None, False), (2, "0604115A", "Hypersonic Glide Body", "Navy", None, False)], ELEMENTS
    )
    asked = spark.createDataFrame([("Advanced Technology Development",), ("advanced development",), ("\t",)], "query string")
    got = {(r.query, r.pe_id, r.score, r.match_on) for r in fuzzy_matches(asked, titles).collect()}
    assert ("Advanced Technology Development", 1, 100.0, "original") in got
    assert {q for q, i, *_ in got if i == 1} >= {"Advanced Technology Development", "advanced development"} and "\t" not in {g[0] for g in got}
    near = {(r.query, r.pe_id): r.score for r in semantic_matches(asked, titles).collect()}
    assert near["Advanced Technology Development", 1] > 0.999 and ("advanced development", 1) in near
    linked = {r.query: (r.match_stage, r.pe_id) for r in link_queries(asked, titles).where("rank < 2").collect()}
    assert linked["Advanced Technology Development"] == ("FUZZY", 1)
    assert {r.query: r.match_strategy for r in link_two_stage(asked, titles).collect()}["Advanced Technology Development"] == "FUZZY"


def test_vectors_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(80)] + [(80, None), (81, []), (82, [0.0] * 8), (83, [1.0])]
    rows.append((84, rows[3][1]))  # a tie
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    good = {r.id: r.v for r in df.collect() if r.v and len(r.v) == 8 and any(r.v)}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for block in (100, 3):
        got = top_k_cosine(df.where("id < 10").withColumnRenamed("id", "q"), "q", "v", df, "id", "v", 5, block=block).collect()
        for q in range(10):
            want = sorted((-round(sum(a * b for a, b in zip(good[q], v)) / norm(good[q]) / norm(v), 6), i) for i, v in good.items())[:5]
            assert [i for _, i in want] == [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)]
    assert top_k_cosine(df.where("id = 80").withColumnRenamed("id", "q"), "q", "v", df, "id", "v", 5).count() == 0


def test_filters_come_after_overfetch(spark):
    meta = spark.createDataFrame([(i, 1, 0, None, None, "t", "X" if i == 6 else "Y", 2020, None) for i in range(1, 7)],
        "chunk_id bigint, document_id bigint, chunk_index int, section_id string, section_title string, text string, doc_type string, doc_year int, fiscal_year int")
    hits = spark.createDataFrame([(0, i, 1.0 - i / 10, i) for i in range(1, 7)], "query int, chunk_id bigint, score double, rank int")
    assert search_chunks(hits, meta, 1, 0.0, ["X"]).count() == 0
    assert search_chunks(hits, meta, 2, 0.0, ["X"]).count() == 1


def test_sections(spark):
    body = "word " * 60
    text = f"intro\n\nSEC. 101. SHORT TITLE.\n{body}\n\nSec. 215. Missile program\n{body}\nSECTION 1501A. CYBER.\n{body}"
    big = "SEC. 7. Big one.\n\n" + "\n\n".join("p" * 4 * n for n in (300, 300, 300, 900, 10))
    flat = "\n\n".join("q" * 4 * n for n in (300, 100, 200))
    df = spark.createDataFrame([(1, text), (2, big), (3, flat), (4, None), (5, "")], "id int, t string")
    rows = section_chunks(df, "id", "t").orderBy("id", "chunk_index").collect()
    assert [(r.section_id, r.section_title, r.page_number) for r in rows if r.id == 1] == [("SEC. 215", "Missile program", 1), ("SEC. 1501A", "CYBER", 1)]
    assert [r.token_count for r in rows if r.id == 2] == [604, 300, 900, 10]
    assert [(r.token_count, r.section_id) for r in rows if r.id == 3] == [(400, None), (200, None)]
    assert [r.id for r in rows if r.id > 3] == []


def test_windows_label_pages(spark):
    para = "x" * 130
    pages = "\f".join([para, "STRATEGIC GOALS\n\n" + para, para])
    rows = window_chunks(spark.createDataFrame([(1, pages)], "id int, t string"), "id", "t").orderBy("page_number").collect()
    assert [r.section_title for r in rows] == ["Introduction", "STRATEGIC GOALS", "STRATEGIC GOALS"]


def facts(spark):
    rows = [(1, 1, 2024, "BY Request", 100.0), (2, 1, 2025, "BY Request", 80.0), (3, 2, 2025, "BY Request", 50.0), (4, 3, 2024, "CY Request", 9.0)]
    return spark.createDataFrame(rows, "id bigint, pe_id bigint, fiscal_year int, funding_type string, amount double")


def test_trends_and_gaps(spark):
    t = {r.agency: r.asDict() for r in agency_trends(facts(spark), elements(spark), 2024, 2025).collect()}
    assert (t["Army"]["2024"], t["Army"]["2025"], t["Army"]["total_delta_pct"]) == (100.0, 130.0, 30.0)
    one = agency_trends(facts(spark), elements(spark), 2025, 2025).collect()
    assert all(r.cagr_pct == 0.0 for r in one)
    f = {r.pe_id: r for r in latest_funding(facts(spark)).collect()}
    assert (f[1].latest_fy, f[1].latest_by_request_m, f[1].trend) == (2025, 0.08, "↓") and f[2].trend == "→" and 3 not in f
    linked = spark.createDataFrame([("a", 1, "A", "S", 1.0), ("b", None, "MANUAL_REVIEW", "NONE", 0.0), ("c", 2, "C", "S", 0.5)],
        "query string, matched_pe_id bigint, matched_name string, match_strategy string, confidence_score double")
    g = {r.query: tuple(r)[4:] for r in funding_gaps(linked, facts(spark), 2024, 2025).collect()}
    assert g == {"a": (100.0, 80.0, -20.0, True), "b": (0.0, 0.0, 0.0, None), "c": (0.0, 50.0, 100.0, False)}
    assert [r.pe_id for r in explore(elements(spark), ["Army"], text="short").collect()] == [2]


def test_paragraphs_of_all_texts(spark, tmp_path):
    from fiscalith.catalog import QUERIES

    texts = ["plain\n\n two \t\n", "caf\u00e9\n\u00a0\u2003\nна \u2028\n\u3000", "\u00a0\n\u0085", "\U0001f600\nx", "", None, "é" * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (max(1, len(t) // 4), sum(1 for p in t.split("\n") if p.strip())) for i, t in enumerate(texts) if t is not None}
    assert {r.doc_id: (r.tokens, r.n_paragraphs) for r in QUERIES["scs20_paragraphs"](spark, str(tmp_path)).collect()} == want


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    json.dumps(sql)


def test_best_matches(spark):
    asked = spark.createDataFrame([("hypersonic glide body prototypes",), ("qqq",), (" ",)], "query string")
    assert [tuple(r)[:3] for r in best_fuzzy_match(asked, elements(spark)).collect()] == [("hypersonic glide body prototypes", 4, "Hypersonic Glide Body Prototype")]
    assert [tuple(r)[:3] for r in best_semantic_match(asked, elements(spark)).collect()] == [("hypersonic glide body prototypes", 4, "Hypersonic Glide Body Prototype")]


def test_sections_without_titles(spark):
    rows = [(1, i, 7, i // 2, t, f"text {i}", "NDS", 2018 + (i >= 30), None) for i, t in enumerate([None, " "] * 15 + ["A", "B", "A", " A ", None])]
    meta = spark.createDataFrame(rows, "document_id int, chunk_id int, x int, chunk_index int, section_title string, text string, doc_type string, doc_year int, fiscal_year int")
    got = {(r.doc_year, r.section.strip(), r.chunk_id) for r in section_representatives(meta, ["doc_year"]).collect()}
    assert got == {(2018, "", i) for i in range(20)} | {(2019, "A", 30), (2019, "B", 31)}
    mapped = section_mapping(meta.withColumn("text", F.lit("hypersonic glide body prototype")), elements(spark), years=[2019]).collect()
    assert {(r.nds_year, r.nds_section) for r in mapped} == {(2019, "A"), (2019, "B")} and mapped[0].pe_id == 4
    assert section_mapping(meta, elements(spark), "NSS").count() == 0


def test_context_filters(spark):
    meta = spark.createDataFrame(
        [(i, i, 0, None, f"t{i}", "text", "NDS" if i < 3 else "NDAA", 2000 + i, None) for i in range(6)],
        "chunk_id bigint, document_id bigint, chunk_index int, section_id string, section_title string, text string, doc_type string, doc_year int, fiscal_year int",
    )
    hits = spark.createDataFrame([(0, i, 0.9 - i / 10, i + 1) for i in range(5)], "query int, chunk_id bigint, score double, rank int")
    about = (hits.withColumnRenamed("chunk_id", "pe_id"), hits, meta, elements(spark), facts(spark))
    plain = policy_to_elements(*about).first().policy_context
    assert plain == "[NDS 2000 t0]; [NDS 2001 t1]; [NDS 2002 t2]"
    assert policy_to_elements(*about, doc_types=["NDAA"]).first().policy_context == "[NDAA 2003 t3]; [NDAA 2004 t4]"
    assert policy_to_elements(*about, years=[2001]).first().policy_context == "[NDS 2001 t1]"
    gaps = {r.pe_id: r for r in gap_analysis(*about, 2024, 2025, ["NDAA", "NDS"], least=0.5).collect()}
    assert gaps[1].policy_context == "[NDAA 2003 t3]; [NDAA 2004 t4]" and gaps[1]["FY2025_$M"] == 0.08 and gaps[4]["FY2025_$M"] is None


def test_vector_cache(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    df = spark.createDataFrame([(1, "radar"), (2, None), (3, "ship"), (3, "ship")], "id int, t string")
    first = {r.id: r.vector for r in cached_vectors(df, "id", "t", path).collect()}
    assert sorted(first) == [1, 3]
    changed = spark.createDataFrame([(1, "radars"), (3, "ship"), (4, "new")], "id int, t string")
    assert {r.id for r in missing_vectors(changed, "id", "t", spark.read.parquet(path)).collect()} == {1, 4}
    again = {r.id: r.vector for r in cached_vectors(changed, "id", "t", path).collect()}
    assert sorted(again) == [1, 3, 4] and again[3] == first[3] and again[1] != first[1]
    assert invalidate_vectors(spark, path) and not invalidate_vectors(spark, path)
    assert cached_vectors(df.where("id = 1"), "id", "t", path).count() == 1
