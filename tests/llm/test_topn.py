import math
import random

import pytest

from fiscalith.llm.topn import top_n_per_group


def brute(rows, n):
    groups = {}
    for g, s, i in rows:
        groups.setdefault(g, []).append((0 if s is not None and not math.isnan(s) else 1, -(s if s is not None and not math.isnan(s) else 0), i is not None, i or 0))
    return sorted((str(g), k + 1, r[3]) for g, v in groups.items() for k, r in enumerate(sorted(v)[:n]))


@pytest.mark.parametrize("n", [1, 3, 10])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None, "c"]), rng.choice([None, float("nan"), rng.randint(0, 5) / 5]), k) for k, _ in enumerate(range(3000))]
    rows += [(f"g{k}", 0.5, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, s double, i bigint").repartition(7)
    got = sorted((str(r.g), r.position, r.i) for r in top_n_per_group(df, "g", "s", "i", n).collect())
    assert got == brute(rows, n)


def test_hot_group_spans_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).selectExpr("'h' g", "cast(id % 3 as double) s", "id i")
        got = [(r.position, r.i) for r in top_n_per_group(df, "g", "s", "i", 2000).orderBy("position").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(range(5000), key=lambda i: (-(i % 3), i))[:2000]
    assert got == list(zip(range(1, 2001), want))


def test_clashing_names_empty_and_repeated(spark):
    df = spark.createDataFrame([("a", 1.0, 1, "x", "y"), ("a", 1.0, 1, "x", "y")], "g string, s double, i bigint, position string, __group string")
    out = top_n_per_group(df, "g", "s", "i", 5)
    assert out.columns == ["g", "s", "i", "__group", "position"]
    assert sorted(r.position for r in out.collect()) == [1, 2]
    assert top_n_per_group(df.limit(0), "g", "s", "i", 5).count() == 0


def test_integer_scores(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, None, 2), (1, 7, None)], "g int, s int, i int")
    assert [(r.s, r.position) for r in top_n_per_group(df, "g", "s", "i", 9).orderBy("position").collect()] == [(7, 1), (5, 2), (None, 3)]
