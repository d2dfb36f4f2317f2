"""Sequential rules over long ordered groups, in blocks so that a hot group fits no single task's window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of one block; what crosses blocks is one row a block.
BLOCK = 4096


def _joined(rows: DataFrame, blocks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of their block; null keys meet null keys."""
    named = blocks.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__block").alias("__of"), value)
    same = F.col("__block") == F.col("__of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return rows.join(named, same, "left")


def _order(order: str, tie: str | None) -> list[str]:
    return [order] if tie is None else [order, tie]


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, column: str, tie: str | None = None, block: int = BLOCK) -> DataFrame:
    """``column`` with each null replaced by the last value before it in its group; null until the first value.

    ``order`` is an integer position. A group is cut into blocks of positions; values are carried inside a block by one
    window and from block to block by another, over one row a block. Rows of equal position are ordered by ``tie``.
    Null positions come first. Other columns pass through.
    """
    blocked = df.withColumn("__block", F.floor(F.coalesce(F.col(order), F.lit(-1)) / block))
    inside = Window.partitionBy(*keys, "__block").orderBy(*_order(order, tie)).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("__here", F.last(column, ignorenulls=True).over(inside))
    rank = F.struct(*[F.col(c) for c in _order(order, tie)])
    # Every block, also one without a value, must know what came before it.
    place = F.when(F.col(column).isNotNull(), rank)
    ends = blocked.groupBy(*keys, "__block").agg(F.max_by(column, place).alias("__end"))
    across = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(across)).select(*keys, "__block", "__before")
    joined = _joined(local, before, keys, "__before")
    return joined.withColumn(column, F.coalesce("__here", "__before")).select(*df.columns)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, column: str, name: str, tie: str | None = None, block: int = BLOCK
) -> DataFrame:
    """``name``: the sum of ``column`` from the first row of the group to this one; nulls add nothing."""
    blocked = df.withColumn("__block", F.floor(F.coalesce(F.col(order), F.lit(-1)) / block))
    inside = Window.partitionBy(*keys, "__block").orderBy(*_order(order, tie)).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        blocked.groupBy(*keys, "__block")
        .agg(F.sum(column).alias("__total"))
        .withColumn("__before", F.sum("__total").over(across))
        .select(*keys, "__block", "__before")
    )
    local = blocked.withColumn("__here", F.sum(column).over(inside))
    zero = F.lit(0)
    joined = _joined(local, totals, keys, "__before")
    return joined.withColumn(name, F.coalesce("__here", zero) + F.coalesce("__before", zero)).select(*df.columns, name)
