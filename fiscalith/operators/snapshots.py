"""Change events from full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiscalith.session import cut_lineage, row_bound_holds


#: More than twice any 64-bit number, so that in a sum with one the number multiplied by it decides.
_STEP = Decimal(2 * 10**19)
#: A time before all others.
_NEVER = -(2**61)
#: Deliveries whose order may be broadcast at most.
MOST_DELIVERIES = 100_000


def content_hash(columns: Sequence[Column]) -> Column:
    """64 bits over ``columns``; null differs from every value. It is compared with that of the same key in the delivery before alone."""
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))])


def latest_per_snapshot(
    df: DataFrame, snapshot: str, keys: dict[str, Column], values: dict[str, Column], loaded_at: str
) -> DataFrame:
    """One row per snapshot and key: ``snapshot``, the keys and ``__hash`` of the row loaded last.

    Rows of one snapshot and key loaded at the same time are told apart by their hash, so the choice is
    the same on every run. A row without load time comes before all others. Map-side combining leaves one row
    per key and task before the shuffle, however often a key is repeated; time and hash are compared as one number of fixed width, so that it is
    a hash aggregate.
    """
    at = F.coalesce(F.unix_micros(F.col(loaded_at).cast("timestamp")), F.lit(_NEVER))
    rows = df.select(F.col(snapshot).alias("__snapshot"), *[c.alias(k) for k, c in keys.items()], at.alias("__at"), content_hash(list(values.values())).alias("__h"))
    place = _scaled(F.col("__at")) + F.col("__h").cast("decimal(20,0)")
    latest = rows.groupBy("__snapshot", *keys).agg(F.max("__at").alias("__last"), F.max(place.cast("decimal(38,0)")).alias("__place"))
    return latest.select("__snapshot", *keys, (F.col("__place") - _scaled(F.col("__last"))).cast("bigint").alias("__hash"))


def _scaled(at: Column) -> Column:
    return at.cast("decimal(19,0)") * F.lit(_STEP)


def validity_intervals(
    df: DataFrame, snapshot: str, keys: dict[str, Column], values: dict[str, Column], loaded_at: str
) -> DataFrame:
    """Islands of consecutive snapshots in which a key has the same content.

    Columns: the keys, ``first_pos``, ``last_pos`` (positions of snapshots in delivery order, from 0),
    ``first_snapshot``, ``last_snapshot`` and ``next_snapshot`` (the delivery after the last, if any). A key absent from a snapshot ends its island. Null keys are keys
    like any other; rows without ``snapshot`` belong to no delivery.
    """
    latest = latest_per_snapshot(df.where(F.col(snapshot).isNotNull()), snapshot, keys, values, loaded_at)
    # One row per delivery, whatever the number of records in it.
    deliveries = df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("__snapshot")).distinct()
    in_order = Window.orderBy("__snapshot")
    order = cut_lineage(
        deliveries.select(
            "__snapshot", (F.row_number().over(in_order) - 1).alias("__pos"), F.lead("__snapshot").over(in_order).alias("__next")
        )
    )
    order = F.broadcast(order) if row_bound_holds(order, MOST_DELIVERIES) else order
    by_key = Window.partitionBy(*keys).orderBy("__pos")
    prev_pos, prev_hash = F.lag("__pos").over(by_key), F.lag("__hash").over(by_key)
    starts = F.when((F.col("__pos") == prev_pos + 1) & (F.col("__hash") == prev_hash), 0).otherwise(1)
    islands = latest.join(order, "__snapshot").withColumn("__island", F.sum(starts).over(by_key))
    return (
        islands.groupBy(*keys, "__island")
        .agg(
            F.min("__pos").alias("first_pos"),
            F.max("__pos").alias("last_pos"),
            F.min("__snapshot").alias("first_snapshot"),
            F.max("__snapshot").alias("last_snapshot"),
            F.max_by("__next", "__pos").alias("next_snapshot"),
        )
        .drop("__island")
    )


def snapshot_changes(
    df: DataFrame, snapshot: str, keys: dict[str, Column], values: dict[str, Column], loaded_at: str
) -> DataFrame:
    """What changed between consecutive full snapshots: ``snapshot``, the keys, ``change_kind``.

    From the validity intervals: one that begins where another of the key ended just before is ``changed``,
    one that begins anywhere else but in the first snapshot is ``added``, and one that ends before the last
    snapshot with no interval next to it is ``removed`` (in the snapshot after its end). Repeated rows count
    once; an empty table or a single snapshot has no changes. ``keys`` and ``values`` name the compared
    expressions, so further columns of ``df``, whatever their names, make no difference.
    """
    spans = validity_intervals(df, snapshot, keys, values, loaded_at)
    by_key = Window.partitionBy(*keys).orderBy("first_pos")
    touched = spans.select(
        *keys,
        "first_pos",
        "last_pos",
        "first_snapshot",
        "next_snapshot",
        F.lag("last_pos").over(by_key).alias("__before"),
        F.lead("first_pos").over(by_key).alias("__after"),
    )
    adjacent = F.col("__before") == F.col("first_pos") - 1
    begins = F.when(adjacent, F.lit("changed")).when(F.col("first_pos") > 0, F.lit("added"))
    gone = F.col("__after").isNull() | (F.col("__after") > F.col("last_pos") + 1)
    ends = F.when(gone & F.col("next_snapshot").isNotNull(), F.lit("removed"))
    event = F.explode(
        F.array(
            F.struct(F.col("first_snapshot").alias("at"), begins.alias("kind")),
            F.struct(F.col("next_snapshot").alias("at"), ends.alias("kind")),
        )
    )
    return (
        touched.select(*keys, event.alias("__e"))
        .where(F.col("__e.kind").isNotNull())
        .select(F.col("__e.at").alias(snapshot), *keys, F.col("__e.kind").alias("change_kind"))
    )
