"""Row identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.numbering import contiguous_ids, ids_in_file_order

ROW_ID = "row_id"


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """Add ``row_id``: a copy of ``key``, else 0, 1, 2, … in input order.

    Input order is by file name, then by position in the file; a table that is not read from files counts in
    the order of its partitions. A key column costs nothing. Without one the table is settled first, so
    that the ids stay the same when a lost task is run again.
    """
    if key is not None:
        return df.withColumn(ROW_ID, F.col(f"`{key}`"))
    numbered = ids_in_file_order(df, ROW_ID)
    return contiguous_ids(df, ROW_ID) if numbered is None else numbered
