import datetime as dt
import random

from pyspark.sql import functions as F

from fiscalith.functions.identifiers import canonical_pe_number, folded_text
from fiscalith.operators.snapshots import snapshot_changes, validity_intervals

SCHEMA = "snapshot_id int, pe_number string, fiscal_year int, pe_title string, budget_activity string, loaded_at timestamp_ntz"


def at(day):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=day)


def changes(spark, rows, schema=SCHEMA, **extra):
    df = spark.createDataFrame(rows, schema)
    for k in extra:
        df = df.withColumn(k, F.lit(extra[k]))
    keys = {"pe_number": canonical_pe_number(F.col("pe_number")), "fiscal_year": F.col("fiscal_year")}
    values = {"pe_title": folded_text(F.col("pe_title")), "budget_activity": folded_text(F.col("budget_activity"))}
    out = snapshot_changes(df, "snapshot_id", keys, values, "loaded_at")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_kinds(spark):
    rows = [
        (1, "0000001A", 2020, "Radio", "BA1", at(1)),
        (2, "1a", 2020, "RADIO ", "ba1", at(2)),  # spelling only
        (3, "0000001A", 2020, "Radios", "BA1", at(3)),  # changed
        (1, "0000002A", 2020, None, "BA1", at(1)),
        (2, "0000002A", 2020, "", "BA1", at(2)),  # null differs from empty
        (2, "0000003A", 2020, "New", "BA1", at(2)),  # added, then gone
        (1, "0000004A", 2020, "X", "BA1", at(1)),
        (3, "0000004A", 2020, "X", "BA1", at(3)),  # gone, then back
    ]
    assert changes(spark, rows) == sorted(
        [
            (3, "0000001A", 2020, "changed"),
            (2, "0000002A", 2020, "changed"),
            (3, "0000002A", 2020, "removed"),
            (2, "0000003A", 2020, "added"),
            (3, "0000003A", 2020, "removed"),
            (2, "0000004A", 2020, "removed"),
            (3, "0000004A", 2020, "added"),
        ],
        key=str,
    )


def test_latest_row_counts_and_repeats(spark):
    rows = [(1, "1A", 2020, "Old", None, at(1)), (1, "1A", 2020, "New", None, at(2)), (1, "1A", 2020, "New", None, at(2)), (2, "1A", 2020, "new", None, at(9))]
    assert changes(spark, rows) == []
    # equal load times: the same choice whatever the order of rows
    tie = [(1, "1A", 2020, "A", None, at(1)), (1, "1A", 2020, "B", None, at(1)), (2, "1A", 2020, "A", None, at(2))]
    assert changes(spark, tie) == changes(spark, tie[::-1])


def test_nulls_empty_and_clashing_names(spark):
    assert changes(spark, []) == []
    rows = [(1, None, None, None, None, None), (2, None, None, "T", None, None), (None, "1A", 2020, "T", None, at(1))]
    assert changes(spark, rows, __pos=1, __hash="x", change_kind="y") == [(2, None, None, "changed")]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for s in (1, 2, 4, 7):
        for k in range(40):
            for _ in range(rng.choice([0, 1, 1, 2])):
                rows.append((s, f"{k}A", 2020, rng.choice(["a", "A ", "b", None]), rng.choice(["x", None]), at(rng.randint(0, 10**6))))
    norm = lambda v: None if v is None else v.strip().lower()
    state = {}
    for s, k, y, t, b, when in rows:
        held = state.setdefault(s, {})
        if k not in held or held[k][0] < when:
            held[k] = (when, norm(t), norm(b))
    want = []
    for a, b in ((1, 2), (2, 4), (4, 7)):
        for k in {*state[a], *state[b]}:
            name = k[:-1].zfill(7) + "A"
            if k not in state[a]:
                want.append((b, name, 2020, "added"))
            elif k not in state[b]:
                want.append((b, name, 2020, "removed"))
            elif state[a][k][1:] != state[b][k][1:]:
                want.append((b, name, 2020, "changed"))
    assert changes(spark, rows) == sorted(want, key=str)


def test_intervals_cover_each_presence(spark):
    df = spark.createDataFrame([(s, "1A", 2020, "t", None, at(s)) for s in (1, 2, 3)], SCHEMA)
    out = validity_intervals(df, "snapshot_id", {"k": F.col("pe_number")}, {"t": F.col("pe_title")}, "loaded_at").collect()
    assert [(r.first_snapshot, r.last_snapshot, r.next_snapshot) for r in out] == [(1, 3, None)]
