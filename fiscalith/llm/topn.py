"""The N best items of every group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fiscalith.session import cut_lineage, ship_package


def _run_starts(group: pa.Array) -> np.ndarray:
    """Offsets at which a run of equal values begins; nulls equal one another."""
    ends = pc.run_end_encode(group).run_ends.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)


def _local_ranks(n: int):
    """Rank within the group inside one sorted partition; keeps ranks up to ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carried, seen, first = None, 0, True  # last group so far, its rows so far, whether it is the partition's first
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0)
            starts = _run_starts(group)
            rank = np.arange(1, batch.num_rows + 1) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            head = int(starts[1]) if len(starts) > 1 else batch.num_rows
            continues = carried is not None and group[0].equals(carried)
            if continues:
                rank[:head] += seen
            elif carried is not None:
                first = False
            leading = np.zeros(batch.num_rows, dtype=bool)
            leading[:head] = first
            if len(starts) > 1:
                first = False
            carried, seen = group[batch.num_rows - 1], int(rank[-1])
            keep = pa.array(rank <= n)
            columns = [c.filter(keep) for c in batch.columns]
            extra = [pa.array(rank), pa.array(leading)]
            kept = [c.filter(keep) for c in extra]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([part] * len(kept[0]), pa.int32()), *kept],
                names=[*batch.schema.names, "__part", "__rank", "__leading"],
            )

    return run


def top_n_per_group(df: DataFrame, group: str, score: str, identifier: str, n: int, position: str = "position") -> DataFrame:
    """The ``n`` rows of each ``group`` with the highest ``score``, ties by smaller ``identifier``, with their position.

    The rows are range-partitioned and sorted on (group, score, identifier), so that a hot group spreads over as
    many partitions as its size asks for and no group is ever gathered in one task. Each partition counts its
    rows by group; a prefix sum of those counts over the partitions before turns ranks inside a partition into
    exact positions. A partition's counts stop at ``n``, which changes no position up to ``n``. Only a
    partition's first group can have begun before it, so the sums concern one group a partition and their table,
    which is broadcast, has fewer rows than there are partitions.

    The cut rows are written to the shared folder before their counts are read: sampled range bounds need not
    come out the same twice.

    Nulls: a null group is a group; null and NaN scores come last, null identifiers first. Rows equal in all
    three keep one of their orders. Columns of any other name pass through; one called like ``position`` is
    replaced. An empty table gives an empty result.
    """
    ship_package(df.sparkSession)
    kind = df.schema[score].dataType
    value = F.col(score)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value), value)
    names = [c for c in df.columns if c != position]
    sorted_rows = (
        df.select(
            F.col(group).alias("__group"),
            value.alias("__score"),
            F.col(identifier).alias("__id"),
            F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"),
        )
        .repartitionByRange(F.asc_nulls_first("__group"), F.desc_nulls_last("__score"), F.asc_nulls_first("__id"))
        .sortWithinPartitions(F.asc_nulls_first("__group"), F.desc_nulls_last("__score"), F.asc_nulls_first("__id"))
        .select("__group", "__row")
    )
    schema = T.StructType(
        [
            *sorted_rows.schema.fields,
            T.StructField("__part", T.IntegerType()),
            T.StructField("__rank", T.LongType()),
            T.StructField("__leading", T.BooleanType()),
        ]
    )
    cut = cut_lineage(sorted_rows.mapInArrow(_local_ranks(n), schema))

    split = cut.where(F.col("__leading")).select(F.col("__group").alias("__g")).distinct()
    counts = (
        cut.join(F.broadcast(split), F.col("__group").eqNullSafe(F.col("__g")), "left_semi")
        .groupBy("__group", "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("__group").alias("__g"), F.col("__part").alias("__p"), F.sum("__n").over(before).alias("__before")
    ).where(F.col("__before") > 0)
    exact = F.col("__rank") + F.coalesce(F.col("__before"), F.lit(0))
    return (
        cut.join(F.broadcast(offsets), F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")), "left")
        .withColumn("__position", exact.cast("int"))
        .where(F.col("__position") <= n)
        .select(*[F.col("__row")[c].alias(c) for c in names], F.col("__position").alias(position))
    )
