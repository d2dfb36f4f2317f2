"""One surviving record for each group of duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More than twice any 64-bit identifier, so that recency decides before it when both are packed into one number.
_STEP = Decimal(2 * 10**19)
#: Cells of completeness and trust that one aggregate holds side by side at most; more are rows of their own first. Both give the same.
SIDE_BY_SIDE = 8
#: A time before all others.
_NEVER = -(2**61)


def _scaled(at: Column) -> Column:
    return at.cast("decimal(19,0)") * F.lit(_STEP)


def best_representatives(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    recency: str,
    trust: Column,
    trust_levels: int,
    identifier: str,
    least_size: int = 2,
    weighed: Sequence[str] | None = None,
) -> DataFrame:
    """The best record of each group of equal ``keys`` that has at least ``least_size`` records.

    Columns: the keys, ``group_size``, ``survivor_id``, ``skyline_size``, each of ``values`` (of the survivor, nulls filled)
    and ``<value>_from`` (the identifier it was taken from).

    Three merits are compared: completeness (how many of the ``weighed`` values are there; all ``values`` unless given), trust (``0 ..
    trust_levels - 1``) and recency. A record dominates another if it is at least as good in all three and better in one. Of the records of equal
    completeness and trust the candidates are the latest (of equals the smallest identifier), the only one that can be on the skyline, and
    for each value the latest that has it. Layer 1 is the skyline of the candidates, layer 2 the skyline of the rest, and so on. The survivor
    is the first of layer 1 by completeness, then trust, recency and smaller identifier; a value it lacks is taken from the first candidate that has
    it, by layer and then by the same order.

    A group is first aggregated by completeness and trust with map-side combining, into at most ``trust_levels * (len(weighed) + 1)`` rows
    however hot it is, and these rows then into one (for a single value and few levels at once, side by side): nothing depends on how many ways
    there are to fill the values. Recency and
    identifier are compared as one number of 128 bits, so for values of fixed width (no strings) both are hash aggregates.

    Null keys form groups like other values (filter them beforehand if they should not). Null values are gaps; NaN in a
    ``values`` column must be null already. A null or out-of-range trust is the lowest, null recency the
    earliest. Repeated rows count as records each. Other columns, whatever their names, are ignored. Identifiers are whole numbers.
    """
    n = len(values)
    counted = list(values if weighed is None else weighed)
    unknown = [v for v in counted if v not in values]
    if unknown:
        raise ValueError(f"weighed but no values: {unknown}")
    level = F.when(trust.between(0, trust_levels - 1), trust.cast("int")).otherwise(0)
    full = sum((F.col(v).isNotNull().cast("int") for v in counted), F.lit(0))
    key_names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(name) for k, name in zip(keys, key_names)],
        level.alias("trust"),
        full.alias("full"),
        F.coalesce(F.unix_micros(F.col(recency).cast("timestamp")), F.lit(_NEVER)).alias("at"),
        F.col(identifier).alias("id"),
        *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)],
    )
    rows = rows.withColumn("place", (_scaled(F.col("at")) - F.col("id").cast("decimal(20,0)")).cast("decimal(38,0)"))
    kinds = [rows.schema[f"v{i}"].dataType.simpleString() for i in range(n)]
    id_kind = rows.schema["id"].dataType.simpleString()
    record = f"struct<full:int,trust:int,at:bigint,neg:{id_kind},{','.join(f'v{i}:{k}' for i, k in enumerate(kinds))}>"

    def identifier_of(at: Column, place: Column) -> Column:
        return (_scaled(at) - place).cast(id_kind)

    def candidate(full: Column, trust: Column, at: Column, who: Column, own: list[Column]) -> Column:
        return F.when(
            who.isNotNull(), F.struct(full.alias("full"), trust.alias("trust"), at.alias("at"), (-who).alias("neg"), *[v.alias(f"v{i}") for i, v in enumerate(own)]).cast(record)
        )

    if n == 1 and counted == list(values) and 2 * trust_levels <= SIDE_BY_SIDE:
        # Completeness says who has the one value, so each cell has one candidate; the cells stand side by side in one aggregate.
        cells = [(c, t, c // trust_levels) for c, t in ((c, c % trust_levels) for c in range(2 * trust_levels))]
        merits = []
        for c, t, there in cells:
            inside = (F.col("trust") == t) & (F.col("full") == there)
            merits += [F.max(F.when(inside, F.col("at"))).alias(f"a{c}"), F.max(F.when(inside, F.col("place"))).alias(f"p{c}")]
            merits += [F.max_by("v0", F.when(inside, F.col("place"))).alias(f"w{c}")] if there else []
        groups = rows.groupBy(*key_names).agg(F.count(F.lit(1)).alias("size"), *merits).where(F.col("size") >= least_size)
        one = [
            candidate(F.lit(there), F.lit(t), F.col(f"a{c}"), identifier_of(F.col(f"a{c}"), F.col(f"p{c}")), [F.col(f"w{c}") if there else F.lit(None)])
            for c, t, there in cells
        ]
        groups = groups.select(*key_names, "size", F.array_compact(F.array(*one)).alias("all"))
    else:
        latest = []
        for i in range(n):  # of each value the latest record that has it
            there = F.col(f"v{i}").isNotNull()
            place = F.when(there, F.col("place"))
            latest += [F.max(F.when(there, F.col("at"))).alias(f"a{i}"), F.max(place).alias(f"p{i}"), F.max_by(f"v{i}", place).alias(f"w{i}")]
        cells = rows.groupBy(*key_names, "full", "trust").agg(F.count(F.lit(1)).alias("size"), F.max("at").alias("at"), F.max("place").alias("place"), *latest)
        who = {f"i{i}": identifier_of(F.col(f"a{i}"), F.col(f"p{i}")) for i in range(n)}
        cells = cells.withColumns({"id": identifier_of(F.col("at"), F.col("place"))} | who)
        # Of a record the values that it is the latest of its cell to have.
        own = lambda who: [F.when(F.col(f"i{i}") == who, F.col(f"w{i}")) for i in range(n)]
        found = [candidate(F.col("full"), F.col("trust"), at, who, own(who)) for at, who in [(F.col("at"), F.col("id")), *[(F.col(f"a{i}"), F.col(f"i{i}")) for i in range(n)]]]
        groups = (
            cells.select(*key_names, "size", F.array_distinct(F.array_compact(F.array(*found))).alias("of_cell"))
            .groupBy(*key_names)
            .agg(F.sum("size").alias("size"), F.flatten(F.collect_list("of_cell")).alias("all"))
            .where(F.col("size") >= least_size)
        )

    def dominates(a: Column, b: Column) -> Column:
        no_worse = (a["full"] >= b["full"]) & (a["trust"] >= b["trust"]) & (a["at"] >= b["at"])
        better = (a["full"] > b["full"]) | (a["trust"] > b["trust"]) | (a["at"] > b["at"])
        return no_worse & better

    def layer_of(done: Column, x: Column) -> Column:
        above = F.transform(F.filter(done, lambda y: dominates(y["c"], x)), lambda y: y["layer"])
        return F.coalesce(F.array_max(above), F.lit(0)) + 1

    # Best first: a record is dominated only by records before it. Only the merits and the identifier decide.
    ordered = F.reverse(F.array_sort("all"))
    element = f"struct<layer:int,c:{record}>"
    layered = F.aggregate(
        F.col("ordered"),
        F.array().cast(f"array<{element}>"),
        lambda done, x: F.concat(done, F.array(F.struct(layer_of(done, x).alias("layer"), x.alias("c")).cast(element))),
    )
    # Stable by construction: within a layer the lexicographic order is kept by ``place``.
    by_layer = F.array_sort(
        F.transform(layered, lambda y, i: F.struct(y["layer"].alias("layer"), i.alias("place"), (-y["c"]["neg"]).alias("id"), y["c"].alias("c")))
    )
    result = groups.select("*", ordered.alias("ordered")).select("*", by_layer.alias("layers"))

    def taken(i: int) -> Column:
        return F.get(F.filter(F.col("layers"), lambda y: y["c"][f"v{i}"].isNotNull()), 0)

    return result.select(
        *[F.col(name).alias(k) for k, name in zip(keys, key_names)],
        F.col("size").alias("group_size"),
        F.get("layers", 0)["id"].alias("survivor_id"),
        F.size(F.filter("layers", lambda y: y["layer"] == 1)).alias("skyline_size"),
        *[x for i, v in enumerate(values) for x in (taken(i)["c"][f"v{i}"].alias(v), taken(i)["id"].alias(f"{v}_from"))],
    )
