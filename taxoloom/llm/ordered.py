"""Running sums over a sorted table, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.scratch import settle

# monotonically_increasing_id keeps the partition in the bits above this one.
_POSITION_BITS = 33


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``, the sum of ``value`` up to and with each row of its group, and ``row``, the row's place.

    Rows are range-partitioned and sorted by group and order. Each partition adds up its own
    rows, and what earlier partitions hold of the group is added from one small row per
    partition and group. So a group that fills many partitions is summed by as many tasks.
    """
    groups = [F.col(c) for c in group]
    placed = settle(
        df.orderBy(*[c.asc_nulls_last() for c in groups], *order).withColumn("row", F.monotonically_increasing_id()), "sorted"
    )
    placed = placed.withColumn("_part", F.shiftright("row", _POSITION_BITS))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part", *groups).agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .select(F.col("_part").alias("_at"), "_before", *[c.alias(f"_g_{n}") for c, n in zip(groups, group)])
    )
    here = Window.partitionBy("_part", *groups).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_at")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return (
        placed.withColumn("_own", F.sum(value).over(here))
        .join(offsets, same)
        .withColumn(name, F.col("_own") + F.col("_before"))
        .drop("_part", "_at", "_own", "_before", *[f"_g_{c}" for c in group])
    )
