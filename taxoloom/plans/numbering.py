"""Contiguous row numbers without a single-task window."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .local import local_frame
from .scratch import settle

# monotonically_increasing_id keeps the partition in the bits above this one.
_POSITION_BITS = 33


def contiguous_ids(
    df: DataFrame,
    name: str,
    order_by: list[Column | str] | None = None,
    start: int = 0,
) -> DataFrame:
    """Add ``name`` = start, start+1, … in ``order_by`` order (or input order).

    Rows are range-partitioned and sorted, settled with their in-partition
    position, and shifted by the number of rows in earlier partitions. Only
    one count per partition reaches the driver.
    """
    spark = df.sparkSession
    if order_by:
        df = df.orderBy(*order_by)
    staged = settle(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _POSITION_BITS)
    counts = (
        staged.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("_part")
        .collect()
    )
    offsets, running = [], start
    for row in counts:
        offsets.append((row["_part"], running))
        running += row["n"]
    shift = local_frame(spark, offsets, "_part long, _shift long")
    position = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        staged.withColumn("_part", part)
        .join(shift, "_part")
        .withColumn(name, F.col("_shift") + position)
        .drop("_part", "_at", "_shift")
    )


def ids_in_file_order(df: DataFrame, name: str) -> DataFrame | None:
    """Add ``name`` = 0, 1, … by file name, block start and position in the block; None if ``df`` reads no files.

    The read planner packs blocks by size, so the order of the partitions is not that of the input. Only a
    count per block reaches the driver. Rows that have been moved between tasks since they were read are
    put back into the order of their blocks by a sort.
    """
    if "_metadata" in df.columns:
        return None
    try:
        placed = df.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_pos"),
        )
    except AnalysisException:
        return None
    staged = settle(placed, "numbered")
    blocks = (
        staged.groupBy("_file", "_block")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first"), F.max("_pos").alias("last"))
        .orderBy("_file", "_block").collect()
    )
    if any(b["last"] - b["first"] + 1 != b["n"] for b in blocks):
        return contiguous_ids(staged, name, ["_file", "_block", "_pos"]).drop("_file", "_block", "_pos")
    shifts, running = [], 0
    for b in blocks:
        shifts.append((b["_file"], b["_block"], running - b["first"]))
        running += b["n"]
    shift = local_frame(df.sparkSession, shifts, "_file string, _block long, _shift long")
    numbered = staged.join(shift, ["_file", "_block"]).withColumn(name, F.col("_pos") + F.col("_shift"))
    return numbered.drop("_file", "_block", "_pos", "_shift")
