import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fiscalith.llm.survivor import best_representatives

SCHEMA = "k string, a double, b string, at timestamp_ntz, trust int, id bigint"
T0 = dt.datetime(2024, 1, 1)


def brute(rows, levels):
    """The latest record of each completeness and trust, and of those with each value; peeled layer by layer."""
    out = {}
    for k in {r[0] for r in rows}:
        mine = []
        for _, a, b, at, trust, i in (r for r in rows if r[0] == k):
            when = (at - T0).total_seconds() if at else -1e18
            mine.append(((a is not None) + (b is not None), trust if trust is not None and 0 <= trust < levels else 0, when, -i, a, b))
        if len(mine) < 2:
            continue
        rest = set()
        for cell in {r[:2] for r in mine}:
            same = [r for r in mine if r[:2] == cell]
            for some in (same, [r for r in same if r[4] is not None], [r for r in same if r[5] is not None]):
                if some:
                    rest.add(max(some, key=lambda r: r[2:4]))
        layers, n = [], 0
        while rest:
            sky = [x for x in rest if not any(all(p >= q for p, q in zip(y[:3], x[:3])) and y[:3] != x[:3] for y in rest)]
            layers += sorted(sky, key=lambda c: tuple(-v for v in c[:4]))
            n = n or len(sky)
            rest -= set(sky)
        fill = lambda j: next(((c[j], -c[3]) for c in layers if c[j] is not None), (None, None))
        out[k] = (len(mine), -layers[0][3], n, *fill(4), *fill(5))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["hot"] * 5 + [f"k{j}" for j in range(30)] + [None]), rng.choice([None, 1.0, 2.0]), rng.choice([None, "x", "y"]),
         rng.choice([None, T0 + dt.timedelta(microseconds=rng.randint(0, 20))]), rng.choice([None, 0, 1, 2, 9, -1]), i)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit(1), "c0": F.lit("x"), "v0": F.lit("y")})
    got = {r[0]: tuple(r)[1:] for r in best_representatives(df, ["k"], ["a", "b"], "at", F.col("trust"), 3, "id").collect()}
    assert got == brute(rows, 3)


def test_policy_order(spark):
    later = T0 + dt.timedelta(days=1)
    rows = [
        ("p", None, "x", later, 1, 1), ("p", 5.0, "x", T0, 0, 2),  # a value beats trust and time
        ("q", 1.0, "x", later, 0, 3), ("q", 2.0, "x", T0, 1, 4),  # trust beats time
        ("r", 1.0, "x", T0, 1, 5), ("r", 2.0, "x", later, 1, 6),  # time
        ("s", 1.0, "x", T0, 1, 8), ("s", 2.0, "x", T0, 1, 7),  # smaller id
        ("t", 1.0, "x", T0, 1, 9),  # alone: no group
        ("u", None, None, T0, 1, 10), ("u", None, "z", T0, 0, 11),
    ]
    out = best_representatives(spark.createDataFrame(rows, SCHEMA), ["k"], ["a", "b"], "at", F.col("trust"), 2, "id")
    got = {r.k: (r.survivor_id, r.a, r.b, r.b_from) for r in out.collect()}
    assert got == {"p": (2, 5.0, "x", 2), "q": (4, 2.0, "x", 4), "r": (6, 2.0, "x", 6), "s": (7, 2.0, "x", 7), "u": (11, None, "z", 11)}


def test_gaps_are_filled_from_later_layers(spark):
    rows = [("k", 1.0, None, T0, 1, 1), ("k", None, "x", T0, 0, 2)]
    r = best_representatives(spark.createDataFrame(rows, SCHEMA), ["k"], ["a", "b"], "at", F.col("trust"), 2, "id").first()
    assert (r.survivor_id, r.a, r.a_from, r.b, r.b_from) == (1, 1.0, 1, "x", 2)


def test_empty_and_repeated(spark):
    assert best_representatives(spark.createDataFrame([], SCHEMA), ["k"], ["a"], "at", F.col("trust"), 2, "id").count() == 0
    rows = [("k", 1.0, "x", T0, 1, 1)] * 2
    r = best_representatives(spark.createDataFrame(rows, SCHEMA), ["k"], ["a"], "at", F.col("trust"), 2, "id").first()
    assert (r.group_size, r.survivor_id) == (2, 1)
    with pytest.raises(ValueError):
        best_representatives(spark.createDataFrame([], SCHEMA), ["k"], ["a"], "at", F.col("trust"), 2, "id", weighed=["b"])


def test_many_values(spark):
    names = [f"c{j}" for j in range(12)]
    schema = "k int, " + ", ".join(f"{c} int" for c in names) + ", at timestamp_ntz, trust int, id bigint"
    rows = [(i % 7, *[i * 100 + j if (i + j) % 5 == 0 else None for j in range(12)], T0 + dt.timedelta(seconds=i), i % 4, i) for i in range(700)]
    df = spark.createDataFrame(rows, schema)
    out = best_representatives(df, ["k"], names, "at", F.col("trust"), 4, "id")
    got = {r.k: r for r in out.collect()}
    for k, r in got.items():
        mine = [x for x in rows if x[0] == k]
        full = lambda x: sum(v is not None for v in x[1:13])
        best = max(mine, key=lambda x: (full(x), x[14], x[13], -x[15]))
        assert r.survivor_id == best[15] and r.group_size == len(mine)
        for j, c in enumerate(names):
            source = next(x for x in mine if x[15] == r[f"{c}_from"])
            assert r[c] == source[1 + j] is not None and (best[1 + j] is None or source is best)


def test_both_plans_agree(spark, monkeypatch):
    from fiscalith.llm import survivor

    rng = random.Random(11)
    rows = [(f"k{rng.randint(0, 40)}", rng.choice([None, 1.0, 2.0]), None, rng.choice([None, T0, T0 + dt.timedelta(rng.randint(0, 3))]), rng.randint(0, 3), i) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    side = sorted(map(tuple, best_representatives(df, ["k"], ["a"], "at", F.col("trust"), 4, "id").collect()))
    monkeypatch.setattr(survivor, "SIDE_BY_SIDE", 0)
    assert side and side == sorted(map(tuple, best_representatives(df, ["k"], ["a"], "at", F.col("trust"), 4, "id").collect()))


def test_hash_aggregates(spark):
    df = spark.createDataFrame([], "k int, a double, b int, at timestamp_ntz, trust int, id bigint")
    plan = best_representatives(df, ["k"], ["a", "b"], "at", F.col("trust"), 2, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_weighed_values_alone_decide(spark):
    rows = [("k", 1.0, None, T0, 1, 1), ("k", None, "x", T0 + dt.timedelta(1), 1, 2), ("k", 3.0, "y", T0, 0, 3)]
    r = best_representatives(spark.createDataFrame(rows, SCHEMA), ["k"], ["a", "b"], "at", F.col("trust"), 2, "id", weighed=["a"]).first()
    # Line 3 is dominated by line 1, line 2 by none: it is the latest.
    assert (r.survivor_id, r.skyline_size, r.a_from, r.b, r.b_from) == (1, 2, 1, "x", 2)
