import random

from pyspark.sql import functions as F

from fiscalith.llm.leakage import leaked_items, leaked_windows, name_flags, reparameterised_items

ITEM = "A retired planner recomputes the merged account while the model predicts 632 tons of ballast near North Ridge."


def frame(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} bigint, text string")


def found(spark, documents, items):
    return sorted(tuple(r) for r in leaked_items(frame(spark, documents), "doc_id", frame(spark, items, "item_id"), "item_id").collect())


def test_exact_leaks(spark):
    documents = [
        (1, "Before it. " + ITEM + " After it."),
        (2, ITEM.upper()),
        (3, "retired, planner: recomputes (the) merged - account while the model predicts!"),  # ten words
        (4, "planner recomputes the merged account while the model predicts"),  # nine
        (5, ITEM.replace("632", "633").replace("recomputes", "x")),
        (6, ITEM.replace("o", "о").replace(" ", " ")),
        (7, None),
        (8, ""),
        (9, "short"),
        (1, "Before it. " + ITEM),
        (10, "word " * 200_000 + ITEM + " word" * 200_000),
    ]
    assert found(spark, documents, [(1, ITEM), (1, ITEM), (2, None), (3, "too short")]) == [(1, 1), (2, 1), (3, 1), (6, 1), (10, 1)]
    assert found(spark, [], [(1, ITEM)]) == [] and found(spark, [(1, ITEM)], []) == []


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = "alpha beta Gamma 12 seven tons North Ridge the of".split()
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(30)) for i in range(5)]
    documents = []
    for d in range(60):
        w = text(20).split()
        if d % 3 == 0:
            src = rng.choice(items)[1].split()
            at = rng.randint(0, 20)
            w[5:5] = src[at : at + rng.choice([8, 9, 10, 12])]
        documents.append((d, " ".join(w)))
    grams = lambda t: {tuple(w[i : i + 10]) for w in [t.lower().split()] for i in range(len(w) - 9)}
    want = sorted((d, i) for d, t in documents for i, s in items if grams(t) & grams(s))
    assert want and found(spark, documents, items) == want


def test_both_joins_agree(spark):
    documents = frame(spark, [(1, ITEM), (2, ITEM.replace("632", "99")), (3, "other words " * 20)])
    items = frame(spark, [(1, ITEM)], "item_id")
    small = leaked_windows(documents, "doc_id", items, "item_id")
    large = leaked_windows(documents, "doc_id", items, "item_id", most_broadcast=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and small.count() > 0


def test_other_parameters(spark):
    changed = ITEM.replace("632", "99").replace("tons", "pages").replace("North Ridge", "Port Elm")
    documents = frame(spark, [(1, ITEM), (2, changed), (3, "A quite unrelated sentence about radios and " * 3)]).withColumns({"h1": F.lit(1), "exact": F.lit("x")})
    rows = reparameterised_items(documents, "doc_id", frame(spark, [(1, ITEM)], "item_id"), "item_id").collect()
    # Two of the nine windows end before the first changed word.
    got = {r.doc_id: (r.exact_windows, r.changed_windows, r.dense_windows, r.share, r.rank) for r in rows}
    assert got == {1: (9, 0, 0, 1.0, 1), 2: (2, 7, 0, 1.0, 1)}


def test_units_and_names_by_form(spark):
    item = "Der Bericht nennt 40 Kisten mit altem Draht die noch heute fehlen"
    rows = reparameterised_items(
        frame(spark, [(1, item.replace("40 Kisten", "drei Fässer")), (2, item.replace("Bericht", "Vermerk"))]), "doc_id", frame(spark, [(1, item)], "item_id"), "item_id"
    ).collect()
    assert sorted((r.doc_id, r.exact_windows, r.changed_windows) for r in rows) == [(1, 0, 3), (2, 1, 2)]
    text = " ".join(f"der {w} und" for w in "Bericht Vermerk Aktenplan".split()) * 5 + " Das Haus steht in der Stadt am Fluss bei dem Wald und dem Berg"
    assert not any(name_flags(text, [w.lower() for w in text.split()]))


def test_runs_without_literal_words(spark):
    table = "1 ton 2 tons 3 crates 4 miles 5 cases"
    documents = [(1, "so: " + table + " x"), (2, table.replace("5", "6")), (3, "9 tons 8 tons 7 crates 6 miles 5 cases")]
    assert found(spark, documents, [(1, table)]) == [(1, 1)]
    rows = reparameterised_items(frame(spark, documents), "doc_id", frame(spark, [(1, table)], "item_id"), "item_id").collect()
    assert [(r.doc_id, r.exact_windows) for r in rows] == [(1, 1)]


def test_inconsistent_slots(spark):
    item = "a pays 5 and b pays 5 so both pay 5 in all today"
    same = item.replace("5", "8")
    mixed = "a pays 5 and b pays 6 so both pay 7 in all today"
    rows = reparameterised_items(frame(spark, [(1, same), (2, mixed)]), "doc_id", frame(spark, [(1, item)], "item_id"), "item_id").collect()
    assert [r.doc_id for r in rows] == [1]


def test_windows_dense_in_slots(spark):
    item = "load 5 tons and 7 crates in 9 hours or 11 days for 13 dollars"
    other = "load 6 pounds and 8 barrels in 10 minutes or 12 weeks for 14 percent"
    rows = reparameterised_items(frame(spark, [(1, other), (2, "no such words " * 9)]), "doc_id", frame(spark, [(1, item)], "item_id"), "item_id").collect()
    assert [(r.doc_id, r.exact_windows, r.changed_windows) for r in rows] == [(1, 0, 0)] and rows[0].dense_windows > 0 and rows[0].least_slots > 4


def test_sentences_that_open_with_a_name(spark):
    item = "Maria buys pears and sells them. Maria keeps the rest."
    texts = [item.replace("Maria", "Omar"), "Omar buys pears and sells them. Elena keeps the rest."]
    rows = reparameterised_items(frame(spark, list(enumerate(texts))), "doc_id", frame(spark, [(1, item)], "item_id"), "item_id").collect()
    assert [(r.doc_id, r.exact_windows, r.changed_windows) for r in rows] == [(0, 0, 1)]


def test_other_scripts_in_other_case(spark):
    item = "вода и трава на берегу той реки не видна нам сегодня вечером"
    greek = "αβηκ νερο και θαλασσα στην ακρη της πολης μενει παντα βαθυ"
    documents = [(1, item.upper()), (2, "Before. " + item.title()), (3, greek.upper()), (4, ITEM.upper().replace("B", "В").replace("M", "М")), (5, item[7:])]
    assert found(spark, documents, [(1, item), (2, greek), (3, ITEM)]) == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 1)]
