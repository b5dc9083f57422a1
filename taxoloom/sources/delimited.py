"""Delimited files whose quoted cells hold line breaks, read by many tasks.

A line alone does not tell whether it begins inside a quoted cell, but it tells what it makes of either
case: no quotes keep the state, and others set, clear or swap it. So every task follows the lines of its
file blocks for both cases at once, the driver puts the few states of the blocks together, and then every
line knows its state. Only lines of records with breaks are grouped; all others are records as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.local import local_frame
from ..plans.scratch import settle

# Where a scan of a line is: at the start of a cell, in a plain cell, in a quoted cell, after a quote in a
# quoted cell; and before a line that begins outside or inside a quoted cell.
_START, _PLAIN, _QUOTED, _QUOTE, _OUTSIDE, _INSIDE = range(6)
_FOLLOWED = "value string, file string, block long, pos long, before array<boolean>, after array<boolean>, first array<long>"


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, block)``: lines without their line feed, and the file block that each is read from."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def open_after(line: Column, sep: str, inside: bool) -> Column:
    """Whether a quoted cell is open at the end of ``line``; ``inside`` if one is open at its beginning.

    A quote opens a cell only at its start, a doubled one stands for itself, and what follows a closing
    quote up to the next separator is plain.
    """

    def step(state: Column, text: Column) -> Column:
        quoted = (
            F.when(state.isin(_START, _QUOTE, _INSIDE), _QUOTED).when(state == _QUOTED, _QUOTE).when(state == _OUTSIDE, _START).otherwise(state)
        )
        ended = F.when(F.endswith(text, F.lit(sep)), _START).otherwise(_PLAIN)
        return F.when((quoted == _QUOTED) | (text == ""), quoted).otherwise(ended)

    # What stands between quotes; the first piece is not after a quote.
    pieces = F.split(line, '"')
    begin = F.lit(_INSIDE if inside else _OUTSIDE)
    return F.aggregate(pieces, begin, step) == _QUOTED


def spans_lines(lines: DataFrame, sep: str) -> bool:
    return not lines.where(F.contains("value", F.lit('"')) & open_after(F.col("value"), sep, False)).isEmpty()


def _after(kind: np.ndarray, start: bool) -> np.ndarray:
    """The state after each line. Kinds: 0 clears, 1 swaps, 2 keeps, 3 sets."""
    swaps = np.cumsum(kind == 1)
    last = np.maximum.accumulate(np.where((kind == 0) | (kind == 3), np.arange(len(kind)), -1))
    known = np.where(last >= 0, kind[last] == 3, start)
    return known ^ ((swaps - np.where(last >= 0, swaps[last], 0)) % 2 == 1)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, pos = None, 0
    state, first = [False, True], [-1, -1]
    for batch in batches:
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        kinds = batch.column(3).to_numpy()
        changed = [k for k in range(len(files)) if k == 0 or files[k] != files[k - 1] or blocks[k] != blocks[k - 1]]
        for lo, hi in zip(changed, [*changed[1:], len(files)]):
            if (files[lo], blocks[lo]) != at:
                at, pos, state, first = (files[lo], blocks[lo]), 0, [False, True], [-1, -1]
            kind, places = kinds[lo:hi], np.arange(pos, pos + hi - lo)
            befores, afters, firsts = [], [], []
            for h in (0, 1):
                after = _after(kind, state[h])
                before = np.append(state[h], after[:-1])
                begun = np.maximum.accumulate(np.append(first[h], np.where(before, -1, places)))[1:]
                befores.append(before)
                afters.append(after)
                firsts.append(begun)
                state[h], first[h] = bool(after[-1]), int(begun[-1])
            pos += hi - lo

            def pairs(x, kind):
                flat = pa.array(np.stack(x, axis=1).reshape(-1), kind)
                return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 2, dtype=np.int32), flat)

            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(places), pairs(befores, pa.bool_()),
                 pairs(afters, pa.bool_()), pairs(firsts, pa.int64())],
                names=["value", "file", "block", "pos", "before", "after", "first"],
            )


def _block_states(lines: DataFrame) -> list[tuple]:
    """Per block: whether it begins inside a quoted cell, and where the record it begins in has begun."""
    ends = (
        lines.groupBy("file", "block").agg(F.max_by(F.struct("after", "first"), "pos").alias("end"))
        .orderBy("file", "block").collect()
    )
    out, file, inside, begun = [], None, False, (0, 0)
    for r in [*ends, None]:
        if r is None or r["file"] != file:
            if inside:
                raise ValueError(f"a quoted cell of {file} is not closed")
            if r is None:
                break
            file, inside, begun = r["file"], False, (0, 0)
        out.append((file, r["block"], int(inside), *begun))
        if r["end"]["first"][inside] >= 0:
            begun = (r["block"], r["end"]["first"][inside])
        inside = r["end"]["after"][inside]
    return out


def joined_records(lines: DataFrame, sep: str) -> DataFrame:
    """``(file, block, pos, value)``: one row per record, with the place where it begins, in input order."""
    value = F.col("value")
    either = open_after(value, sep, False).cast("int") + 2 * open_after(value, sep, True).cast("int")
    kind = F.when(F.contains(value, F.lit('"')), either).otherwise(F.lit(2)).cast("int").alias("kind")
    followed = settle(lines.select("value", "file", "block", kind).mapInArrow(_follow, _FOLLOWED), "lines")
    known = local_frame(
        lines.sparkSession, _block_states(followed), "file string, block long, inside int, from_block long, from_pos long"
    )
    case = F.col("inside")
    first = F.get("first", case)
    placed = followed.join(known, ["file", "block"]).select(
        "value", "file", "block", "pos", F.get("before", case).alias("before"), F.get("after", case).alias("after"),
        F.when(first < 0, F.col("from_block")).otherwise(F.col("block")).alias("at_block"),
        F.when(first < 0, F.col("from_pos")).otherwise(first).alias("at_pos"),
    )
    whole = ~F.col("before") & ~F.col("after")
    pieces = F.array_sort(F.collect_list(F.struct("block", "pos", "value")))
    broken = placed.where(~whole).groupBy("file", "at_block", "at_pos").agg(
        F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("value")
    )
    records = placed.where(whole).select("file", "at_block", "at_pos", "value").unionByName(broken)
    return settle(
        records.select("file", F.col("at_block").alias("block"), F.col("at_pos").alias("pos"), F.regexp_replace("value", "\r$", "").alias("value"))
        .orderBy("file", "block", "pos"),
        "records",
    )


def parse_records(records: DataFrame, names: list[str], sep: str) -> DataFrame:
    """The cells of records as text columns; the first record of each file is its header."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"'})
    body = records.where(((F.col("block") != 0) | (F.col("pos") != 0)) & (F.trim("value") != ""))
    return body.select(cells.alias("cells")).select(*[F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)])
