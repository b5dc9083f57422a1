"""Automatic discovery of sub-concepts with a feature-weighted batch SOM.

Equal rows are one weighted point, settled once as columnar blocks of places
(index, cell), one per source column. Every epoch is one job of one stage: each
task assigns its points to prototypes with dense products per block and returns
one row of partial sums; the driver updates at most 400 prototypes. What moves per
epoch is (running tasks x prototypes x features) numbers, whatever the rows.

A map of more than ``MAP_CELLS`` cells is dealt out by the features of its widest
column: a block has a part of them, with their weights and prototype cells, beside
all points that hold them. Features of the other columns, and those that many points
hold, stay with the driver. An epoch is still one stage: what the blocks need of each
other are sums over prototypes, not over features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..plans.scratch import Settled, settle
from .encode import Encoded, Span, SparseEncoded, fit_encoder
from .restriction_search import (
    characterise,
    dedupe,
    drop_subsets,
    merge_clusters,
    search_for,
)
from .taxonomy import Taxonomy

# Parameter limits.
LEAST_ROWS = 4
MAP_SIZES = (2, 20)
EPOCHS = (5, 5000)
# One full-batch weight step stands for the ten mini-batches of a pass.
WEIGHT_STEP = 0.1
#: Points of one packed block.
BLOCK_POINTS = 1 << 16
#: Points that a task of an epoch has at least, where there are as many.
TASK_POINTS = 1 << 15
#: Points of equal indices worked on at once; shorter runs are worked on together.
RUN_POINTS, SHORT_RUN = 1 << 12, 256
#: Blocks that a task of an epoch is handed at once.
BATCH_BLOCKS = 4
#: Cells of a map (prototypes x features) that the driver holds and every task is sent; a larger one is dealt out.
MAP_CELLS = 1 << 20
#: Parts of a dealt block, and of all points, that may hold one feature before it stays with the driver.
HEAVY_PARTS, HEAVY_FEATURES = 8, 1 << 10


@dataclass
class WeightedSom:
    map_size: int
    prototypes: np.ndarray
    weights: np.ndarray
    history: list[tuple[int, float, int, float]] = field(default_factory=list)

    @property
    def gate(self) -> np.ndarray:
        """Effective feature weights, between 0 and 1."""
        return _gate(self.weights)

    @property
    def centroids(self) -> np.ndarray:
        return self.prototypes

    def best_column(self, spans: list[Span]) -> tuple[str | None, dict[str, float]]:
        return select_best_column(spans, self.gate)


@dataclass
class DealtSom:
    """A map whose features of one column are dealt out; the driver has the features ``held`` and one row per unit.

    ``blocks`` has the state of the dealt features; ``mix`` makes their prototype cells of the sums of its epochs.
    """

    map_size: int
    prototypes: np.ndarray
    weights: np.ndarray
    held: np.ndarray
    place: int
    span: Span
    blocks: DataFrame
    mix: dict[int, np.ndarray]
    lengths: np.ndarray
    unseen_weight: float
    top: float
    history: list[tuple[int, float, int, float]] = field(default_factory=list)

    @property
    def gate(self) -> np.ndarray:
        """Effective weights of the held features."""
        return _gate(self.weights)

    def features(self) -> DataFrame:
        """``(feature_idx, gate, row)`` of every dealt feature that a point holds, ``row`` a cell per unit."""
        units, mix = len(self.prototypes), self.mix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                own = np.frombuffer(block["features"], np.int32)
                cells = _own_cells(block, mix, units)
                for lo in range(0, len(own), RUN_POINTS):
                    part = cells[lo : lo + RUN_POINTS]
                    ends = pa.array(np.arange(0, part.size + 1, units, dtype=np.int32))
                    gate = _gate(np.frombuffer(block["weight"])[lo : lo + RUN_POINTS])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[lo : lo + RUN_POINTS]), pa.array(gate), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))],
                        names=["feature_idx", "gate", "row"],
                    )

        return self.blocks.mapInArrow(run, "feature_idx int, gate double, row array<double>")

    @property
    def centroids(self) -> np.ndarray:
        """A row per unit, as long as and at the same angles as the prototypes, in as many dimensions as there are units."""
        units, mix = len(self.prototypes), self.mix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            product = np.zeros((units, units))
            for block in _blocks(batches):
                cells = _own_cells(block, mix, units)
                product += cells.T @ cells
            yield pa.RecordBatch.from_arrays([pa.array([product.tobytes()], pa.binary())], names=["product"])

        product = self.prototypes @ self.prototypes.T
        for r in self.blocks.mapInArrow(run, "product binary").collect():
            product += np.frombuffer(r["product"]).reshape(units, units)
        value, vector = np.linalg.eigh(product)
        found = vector * np.sqrt(np.maximum(value, 0.0))
        return np.where(np.diag(product)[:, None] > 0, found, 0.0)

    def best_column(self, spans: list[Span]) -> tuple[str | None, dict[str, float]]:
        # One value per column, its highest.
        tops, short = [], []
        for k, s in enumerate(spans):
            own = self.gate[(self.held >= s.start) & (self.held < s.start + s.size)]
            tops.append(max([*own.tolist(), *([self.top] if k == self.place else [])], default=0.0))
            short.append(Span(s.column, s.kind, k, min(1, s.size)))
        return select_best_column(short, tops)


def _gate(weights: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-weights))


def _unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    safe = np.where(norm > 0, norm, 1.0)
    return m / safe, norm[:, 0]


def _places(encoded: Encoded) -> DataFrame:
    """The rows as ``indices`` and ``cells``; a dense row has a place for each feature."""
    if isinstance(encoded, SparseEncoded):
        return encoded.df
    every = F.sequence(F.lit(0), F.lit(encoded.width - 1)) if encoded.width else F.array()
    others = [F.col(f"`{c}`") for c in encoded.df.columns if c != "features"]
    return encoded.df.select(*others, every.cast("array<int>").alias("indices"), F.col("features").alias("cells"))


def _table(indices: pa.Array, cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of equal length as matrices; a missing index becomes place 0 with cell 0."""
    n = len(indices)
    at = indices.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return np.maximum(at, 0), cells.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _first_rows(encoded: Encoded, cells: int, seed: int) -> list:
    """Up to ``cells`` rows in hash order of their key and the seed."""
    order = F.md5(F.concat(F.col(f"`{encoded.key}`").cast("string"), F.lit(f"|{seed}")))
    return (
        _places(encoded).select("indices", "cells", order.alias("h"), F.col(f"`{encoded.key}`").alias("k"))
        .orderBy("h", "k")
        .limit(cells)
        .collect()
    )


def init_codebook(encoded: Encoded, map_size: int, seed: int) -> np.ndarray:
    """map_size² rows in hash order of their key and the seed, repeated when there are fewer."""
    cells = map_size * map_size
    rows = _first_rows(encoded, cells, seed)
    picked = np.zeros((len(rows), encoded.width))
    for k, r in enumerate(rows):
        for i, x in zip(r["indices"], r["cells"]):
            if i >= 0:
                picked[k, i] = x
    return np.resize(picked, (cells, encoded.width))


def _points(encoded: Encoded) -> DataFrame:
    """The distinct rows with their number."""
    return _places(encoded).groupBy("indices", "cells").agg(F.count(F.lit(1)).alias("w"))


def settle_points(encoded: Encoded) -> DataFrame:
    """The distinct rows with their number, as columnar blocks of up to ``BLOCK_POINTS``, one row per block.

    Equal rows are one weighted point, so an epoch costs what the distinct rows cost.
    """
    points = _points(encoded)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((*_table(batch.column(0), batch.column(1)), batch.column(2).to_numpy()))
            size += batch.num_rows
            if size >= BLOCK_POINTS:
                yield _packed(held)
                held, size = [], 0
        if held:
            yield _packed(held)

    spread = points.repartition(points.sparkSession.sparkContext.defaultParallelism)
    return settle(spread.mapInArrow(pack, "n int, indices binary, cells binary, w binary"), "points")


def _packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    indices, cells, w = (np.concatenate(x) for x in zip(*parts))
    if indices.shape[1]:
        # Points of equal indices follow each other.
        order = np.lexsort(indices.T)
        indices, cells, w = indices[order], cells[order], w[order]
    columns = [pa.array([len(w)], pa.int32())]
    columns += [pa.array([x.tobytes()], pa.binary()) for x in (indices.astype(np.int32), cells.astype(np.float64), w.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["n", "indices", "cells", "w"])


def _likeness(at: np.ndarray, cells: np.ndarray, gate: np.ndarray, turned: np.ndarray):
    """Directions of gated rows, their lengths, and their cosine with every prototype, a column of ``turned``."""
    y, norm = _unit_rows(cells * gate[at])
    out = np.zeros((len(at), turned.shape[1]))
    for k in range(at.shape[1]):
        # A number column has one index for all rows.
        same = at[:1, k] if len(at) and (at[:, k] == at[0, k]).all() else at[:, k]
        out += y[:, k, None] * turned[same]
    return y, norm, out


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of pieces of up to ``RUN_POINTS`` rows, each of equal indices unless those are short."""
    starts = np.append(0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1)
    if len(at) < SHORT_RUN * len(starts):
        starts = np.array([0])
    ends = np.append(starts[1:], len(at))
    return [(lo, min(lo + RUN_POINTS, hi)) for first, hi in zip(starts.tolist(), ends.tolist()) for lo in range(first, hi, RUN_POINTS)]


def _add_points(indices, cells, weights, gate, turned, total, count, slope) -> float:
    """Add what the points of a block give to the sums; their distance is returned."""
    width, units = turned.shape
    away = 0.0
    for lo, hi in _runs(indices):
        at, x, w = indices[lo:hi], cells[lo:hi], weights[lo:hi]
        y, norm, like = _likeness(at, x, gate, turned)
        unit = like.argmax(axis=1)
        cos = like[np.arange(len(unit)), unit]
        count += np.bincount(unit, weights=w, minlength=units).astype(np.int64)
        safe = np.where(norm > 0, norm, np.inf)
        share = w / safe
        if (at[0] == at[-1]).all() and (at == at[0]).all():
            # One set of places for all rows.
            own = at[0]
            step = x * (turned[own].T[unit] - cos[:, None] * y) * share[:, None]
            for k, j in enumerate(own):
                total[j::width] += np.bincount(unit, weights=y[:, k] * w, minlength=units)
                slope[j] += step[:, k].sum()
        else:
            flat = unit[:, None] * width + at
            some, back = np.unique(flat, return_inverse=True)
            total[some] += np.bincount(back.ravel(), weights=(y * w[:, None]).ravel())
            step = x * (turned[at, unit[:, None]] - cos[:, None] * y) * share[:, None]
            np.add.at(slope, at.ravel(), step.ravel())
        away += float(((1.0 - cos) * w).sum())
    return away


def _partial_sums(prototypes: np.ndarray, gate: np.ndarray):
    """Per task: Σ direction and number of the rows of each unit, the weight gradient and the distance."""
    turned = np.ascontiguousarray(_unit_rows(prototypes)[0].T)
    units, width = prototypes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, slope = np.zeros(units * width), np.zeros(units, np.int64), np.zeros(width)
        away = 0.0
        for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
            indices = np.frombuffer(row["indices"], np.int32).reshape(row["n"], -1)
            cells = np.frombuffer(row["cells"], np.float64).reshape(row["n"], -1)
            weights = np.frombuffer(row["w"], np.int64)
            away += _add_points(indices, cells, weights, gate, turned, total, count, slope)
        used = np.flatnonzero(total)
        parts = [x.tobytes() for x in (used, total[used], count, slope)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([x], pa.binary()) for x in parts), pa.array([away])], names=["at", "total", "count", "slope", "away"]
        )

    return run


def _epoch(points: DataFrame, prototypes: np.ndarray, gate: np.ndarray):
    units, width = prototypes.shape
    partial = points.mapInArrow(_partial_sums(prototypes, gate), "at binary, total binary, count binary, slope binary, away double")
    total, count, slope, away = np.zeros(units * width), np.zeros(units, np.int64), np.zeros(width), 0.0
    # One row per running task, in the order of the partitions.
    for r in partial.collect():
        total[np.frombuffer(r["at"], np.int64)] += np.frombuffer(r["total"])
        count += np.frombuffer(r["count"], np.int64)
        slope += np.frombuffer(r["slope"])
        away += r["away"]
    return total.reshape(units, width), count, slope, away, int(count.sum())


def _nearness(map_size: int, epoch: int, epochs: int) -> np.ndarray:
    """How much the rows of each unit pull every other one."""
    x, y = np.divmod(np.arange(map_size * map_size), map_size)
    apart = (x[:, None] - x[None, :]) ** 2 + (y[:, None] - y[None, :]) ** 2
    radius = max(0.5, (map_size / 2) * (1.0 - epoch / max(1, epochs - 1)))
    return np.exp(-apart / (2 * radius * radius))


def _step(epoch: int, slope, rows: int, sparsity: float, weights, first, second):
    """The weights and their moments after the Adam step of an epoch."""
    gate = _gate(weights)
    grad = (-slope / rows + sparsity) * gate * (1.0 - gate)
    first = 0.9 * first + 0.1 * grad
    second = 0.999 * second + 0.001 * grad * grad
    step = first / (1 - 0.9 ** (epoch + 1))
    spread = np.sqrt(second / (1 - 0.999 ** (epoch + 1)))
    return weights - WEIGHT_STEP * step / (spread + 1e-8), first, second


def _widest(encoded: Encoded) -> int | None:
    """Place of the column with the most values, if rows have a place per column."""
    wide = [k for k, s in enumerate(encoded.spans) if s.kind == "categorical"] if isinstance(encoded, SparseEncoded) else []
    return max(wide, key=lambda k: encoded.spans[k].size, default=None)


@contextmanager
def _few_blocks(spark: SparkSession) -> Iterator[None]:
    """A batch is held whole by its task, and a row is a block: few of them at once."""
    rows_of_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(rows_of_batch)
    spark.conf.set(rows_of_batch, BATCH_BLOCKS)
    try:
        yield
    finally:
        spark.conf.set(rows_of_batch, usual)


def fit_wsom(
    encoded: Encoded,
    map_size: int = 5,
    sparsity: float = 0.01,
    epochs: int = 100,
    seed: int = 0,
) -> WeightedSom | DealtSom:
    """Train prototypes and feature weights.

    Minimises the mean cosine distance between a row, scaled by the feature
    weights, and its prototype, plus ``sparsity`` times the sum of the weights.
    Prototypes take the neighbourhood-weighted mean direction of their rows,
    with a radius that shrinks over the epochs; the weights take an Adam step.
    """
    place = _widest(encoded)
    if place is not None and map_size * map_size * encoded.width > MAP_CELLS:
        return _fit_dealt(encoded, place, map_size, sparsity, epochs, seed)
    prototypes = init_codebook(encoded, map_size, seed)
    weights = np.zeros(encoded.width)
    som = WeightedSom(map_size, prototypes, weights)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    points = settle_points(encoded)
    n = points.agg(F.sum("n")).first()[0] or 0
    # A task with few points costs more to start than to run.
    tasks = min(encoded.df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_POINTS))
    points = points.coalesce(max(1, tasks)).persist()
    try:
        with _few_blocks(encoded.df.sparkSession):
            prototypes = prototypes * som.gate
            for epoch in range(epochs):
                gate = som.gate
                total, count, slope, away, rows = _epoch(points, prototypes, gate)
                near = _nearness(map_size, epoch, epochs)
                mass = near @ count
                pulled = (near @ total) / np.maximum(mass, 1e-12)[:, None]
                moved = np.where(mass[:, None] > 1e-9, pulled, prototypes)
                loss = away / rows + sparsity * float(gate.sum())
                som.history.append((epoch + 1, away / rows, int((count > 0).sum()), loss))
                som.weights, first, second = _step(epoch, slope, rows, sparsity, som.weights, first, second)
                prototypes = moved
    finally:
        points.unpersist()
    som.prototypes = prototypes
    return som


# -- maps dealt out by the features of their widest column ----------------------

LAYERS = pa.list_(pa.struct([("epoch", pa.int32()), ("at", pa.binary()), ("x", pa.binary())]))
STATE = pa.schema(
    [("n", pa.int32()), *((c, pa.binary()) for c in ("places", "cells", "w", "features", "weight", "first", "second")), ("layers", LAYERS)]
)
SUMS = pa.schema(
    [
        ("task", pa.int32()), *((c, pa.binary()) for c in ("used", "total", "count", "slope", "squares")),
        *((c, pa.float64()) for c in ("away", "gates", "top")),
    ]
)
#: A block has no sums, and the sums of a task no block.
EPOCH = pa.schema([*STATE, *SUMS])


def _record(values: dict, schema: pa.Schema) -> pa.RecordBatch:
    """One row, with nulls where ``values`` has no entry."""
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist())


def _dealt(held: np.ndarray, span: Span, index: Column, salt: Column) -> Column:
    """What rows are dealt out by: the feature of the widest column, or below 0, spread out, where the driver has it."""
    heavy = [int(j) for j in held if span.start <= j < span.start + span.size]
    own = (index >= 0) & ~index.isin(heavy) if heavy else index >= 0
    return F.when(own, index).otherwise(-1 - F.pmod(salt, F.lit(1 << 30))).cast("int")


def _local(at: np.ndarray, held: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Indices as positions in the held features, followed by the own ones and a last one without cells."""
    out = np.full(at.shape, len(held) + len(own), np.int32)
    for start, some in ((0, held), (len(held), own)):
        if len(some):
            found = np.minimum(np.searchsorted(some, at), len(some) - 1)
            out = np.where(some[found] == at, start + found, out)
    return out.astype(np.int32)


def _own_cells(block: dict, mix: dict[int, np.ndarray], units: int) -> np.ndarray:
    """Prototype cells of the features of a block, a row per feature."""
    cells = np.zeros((len(block["features"]) // 4, units))
    for layer in block["layers"]:
        if layer["epoch"] in mix:
            sums = np.zeros(cells.size)
            sums[np.frombuffer(layer["at"], np.int64)] = np.frombuffer(layer["x"])
            cells += sums.reshape(cells.shape) @ mix[layer["epoch"]]
    return cells


def _deal_points(points: DataFrame, key: Column, parts: int, held: np.ndarray, place: int, book: list[tuple], units: int) -> DataFrame:
    """Blocks of points beside the state of the dealt features that they hold; ``book``: (feature, unit, cell) of the first prototypes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [[*(c.to_numpy(zero_copy_only=False) for c in (b.column(0).flatten(), b.column(1).flatten(), b.column(2)))] for b in batches]
        if not tables:
            return
        at, cells, w = (np.concatenate(x) for x in zip(*tables))
        at, cells = at.reshape(len(w), -1), cells.reshape(len(w), -1)
        order = np.lexsort([*cells.T, *at.T, at[:, place]])
        at, cells, w = at[order], cells[order], w[order]
        wide = at[:, place]
        own = np.setdiff1d(wide[wide >= 0], held).astype(np.int32)
        start = [(int(np.searchsorted(own, j)) * units + u, x) for j, u, x in book if j in own]
        none = np.zeros(len(own)).tobytes()
        yield _record(
            {
                "n": len(w), "places": _local(at, held, own).tobytes(), "cells": cells.astype(np.float64).tobytes(),
                "w": w.astype(np.int64).tobytes(), "features": own.tobytes(), "weight": none, "first": none, "second": none,
                "layers": [_layer(-1, np.array([a for a, _ in start], np.int64), np.array([x for _, x in start], np.float64))],
            },
            STATE,
        )

    return points.repartition(parts, key).mapInArrow(pack, from_arrow_schema(STATE))


def _layer(epoch: int, at: np.ndarray, x: np.ndarray) -> dict:
    return {"epoch": epoch, "at": at.astype(np.int64).tobytes(), "x": x.tobytes()}


def _dealt_epoch(epoch: int, prototypes, weights, lengths, mix, near, rows: int, sparsity: float):
    """Per block its state after the epoch, and per task the sums that the driver needs."""
    units, width = prototypes.shape
    safe = np.where(lengths > 0, lengths, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_total, held_slope = np.zeros((units, width)), np.zeros(width)
        count, squares, away, gates, top = np.zeros(units, np.int64), np.zeros(units), 0.0, 0.0, 0.0
        for block in _blocks(batches):
            weight, first, second = (np.frombuffer(block[c]) for c in ("weight", "first", "second"))
            # The features of the block, and a last one without cells for what is missing.
            turned = np.concatenate([prototypes.T, _own_cells(block, mix, units), np.zeros((1, units))]) / safe
            gate = np.concatenate([_gate(weights), _gate(weight), [0.0]])
            total, slope = np.zeros(turned.size), np.zeros(len(turned))
            places, cells = (np.frombuffer(block[c], t).reshape(block["n"], -1) for c, t in (("places", np.int32), ("cells", np.float64)))
            away += _add_points(places, cells, np.frombuffer(block["w"], np.int64), gate, turned, total, count, slope)
            total = total.reshape(units, -1)
            held_total += total[:, :width]
            held_slope += slope[:width]
            own = np.ascontiguousarray(total[:, width:-1].T)
            squares += ((own @ near.T) ** 2).sum(axis=0)
            gates += float(gate[width:].sum())
            weight, first, second = _step(epoch, slope[width:-1], rows, sparsity, weight, first, second)
            top = max(top, float(_gate(weight).max(initial=0.0)))
            used = np.flatnonzero(own)
            layers = [x for x in block["layers"] if x["epoch"] in mix] + [_layer(epoch, used, own.ravel()[used])]
            state = {"weight": weight.tobytes(), "first": first.tobytes(), "second": second.tobytes(), "layers": layers}
            yield _record(block | state, EPOCH)
        used = np.flatnonzero(held_total)
        sums = {"used": used, "total": held_total.ravel()[used], "count": count, "slope": held_slope, "squares": squares}
        yield _record(
            {c: x.tobytes() for c, x in sums.items()} | {"task": TaskContext.get().partitionId(), "away": away, "gates": gates, "top": top},
            EPOCH,
        )

    return run


def _fit_dealt(encoded: SparseEncoded, place: int, map_size: int, sparsity: float, epochs: int, seed: int) -> DealtSom:
    """The map of ``fit_wsom`` with the features of the column at ``place`` dealt out."""
    units, span = map_size * map_size, encoded.spans[place]
    points = Settled(_points(encoded), "points")
    n, rows = points.df.agg(F.count(F.lit(1)), F.sum("w")).first()
    # Points of one feature are in one block, so features that many points hold stay with the driver.
    size = max(1 << 10, min(TASK_POINTS, MAP_CELLS // units))
    most = max(size // HEAVY_PARTS, n // HEAVY_FEATURES)
    index = F.get("indices", F.lit(place))
    per = points.df.groupBy(index.alias("j")).count().where("j >= 0")
    seen = per.count()
    heavy = [r["j"] for r in per.where(F.col("count") > most).collect()]
    others = [j for s in encoded.spans if s is not span for j in range(s.start, s.start + s.size)]
    held = np.array(sorted(others + heavy), np.int32)
    width, unseen = len(held), span.size - seen

    weights, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    prototypes, own_squares, book = np.zeros((units, width)), np.zeros(units), []
    of = {int(j): k for k, j in enumerate(held)}
    picked = _first_rows(encoded, units, seed)
    for u in range(units if picked else 0):
        r = picked[u % len(picked)]
        for j, x in ((j, x * 0.5) for j, x in zip(r["indices"], r["cells"]) if j >= 0):
            if j in of:
                prototypes[u, of[j]] = x
            else:
                book.append((j, u, x))
                own_squares[u] += x * x
    # A dealt feature that no point holds has its weight from the sparsity alone.
    other, other_first, other_second = np.zeros(1), np.zeros(1), np.zeros(1)
    mix, top, history = {-1: np.eye(units)}, 0.0, []
    parts = max(encoded.df.sparkSession.sparkContext.defaultParallelism, -(-n // size))
    blocks = Settled(_deal_points(points.df, _dealt(held, span, index, F.xxhash64("indices", "cells")), parts, held, place, book, units), "blocks")
    points.drop()
    with _few_blocks(encoded.df.sparkSession):
        for epoch in range(epochs):
            gate, near = _gate(weights), _nearness(map_size, epoch, epochs)
            lengths = np.sqrt((prototypes**2).sum(axis=1) + own_squares)
            work = _dealt_epoch(epoch, prototypes, weights, lengths, mix, near, rows, sparsity)
            after = Settled(blocks.df.where("n is not null").select(*STATE.names).mapInArrow(work, from_arrow_schema(EPOCH)), "blocks")
            blocks.drop()
            blocks = after
            total, count, slope = np.zeros(units * width), np.zeros(units, np.int64), np.zeros(width)
            squares, away, gates, top = np.zeros(units), 0.0, float(gate.sum()) + unseen * float(_gate(other)[0]), 0.0
            for r in sorted(blocks.df.where("n is null").select(*SUMS.names).collect(), key=lambda r: r["task"]):
                total[np.frombuffer(r["used"], np.int64)] += np.frombuffer(r["total"])
                count += np.frombuffer(r["count"], np.int64)
                slope += np.frombuffer(r["slope"])
                squares += np.frombuffer(r["squares"])
                away, gates, top = away + r["away"], gates + r["gates"], max(top, r["top"])
            mass = near @ count
            moved, safe = mass > 1e-9, np.maximum(mass, 1e-12)
            prototypes = np.where(moved[:, None], (near @ total.reshape(units, width)) / safe[:, None], prototypes)
            own_squares = np.where(moved, squares / safe**2, own_squares)
            # A unit that is not moved keeps the cells of the epoch that moved it last.
            mix = {e: np.where(moved, 0.0, m) for e, m in mix.items()} | {epoch: np.where(moved, near.T / safe, 0.0)}
            mix = {e: m for e, m in mix.items() if m.any()}
            history.append((epoch + 1, away / rows, int((count > 0).sum()), away / rows + sparsity * gates))
            weights, first, second = _step(epoch, slope, rows, sparsity, weights, first, second)
            other, other_first, other_second = _step(epoch, np.zeros(1), rows, sparsity, other, other_first, other_second)
    if unseen:
        top = max(top, float(_gate(other)[0]))
    lengths = np.sqrt((prototypes**2).sum(axis=1) + own_squares)
    return DealtSom(
        map_size, prototypes, weights, held, place, span, blocks.df.where("n is not null").select(*STATE.names), mix, lengths, float(other[0]), top, history
    )


def _assign_dealt(encoded: SparseEncoded, som: DealtSom, keep: list[str] | None) -> DataFrame:
    """``assign_bmu`` with every row beside its own dealt feature."""
    names = list(dict.fromkeys([encoded.key, *(keep or [])]))
    others = [F.col(f"`{c}`") for c in names]
    key = _dealt(som.held, som.span, F.get("indices", F.lit(som.place)), F.xxhash64("indices", "cells", *others))
    raw = encoded.df.select(*[c.alias(f"_{k}") for k, c in enumerate(others)], "indices", "cells", key.alias("_dealt"))
    # The features are as many as the rows may be: none of the two is sent whole to every task.
    near = raw.join(som.features().hint("merge"), F.col("_dealt") == F.col("feature_idx"), "left").drop("_dealt")
    units, safe = len(som.prototypes), np.where(som.lengths > 0, som.lengths, 1.0)
    held, weights, prototypes, unseen, n = som.held, som.weights, som.prototypes, som.unseen_weight, len(names)
    place = som.place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = batch.column(n + 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            index, gates, cells = (batch.column(k) for k in range(n + 2, n + 5))
            there = index.is_valid().to_numpy(zero_copy_only=False)
            own, first = np.unique(index.drop_null().to_numpy(), return_index=True)
            cells = cells.drop_null().flatten().to_numpy().reshape(-1, units)[first]
            missing = (at[:, place] >= 0) & ~there & ~np.isin(at[:, place], held)
            turned = np.concatenate([prototypes.T, cells, np.zeros((1, units))]) / safe
            gate = np.concatenate([_gate(weights), gates.drop_null().to_numpy()[first], [0.0]])
            local = _local(at, held, own)
            if missing.any():
                # Held by no point of the fit: no cells, but a weight.
                gate[-1] = _gate(np.array([unseen]))[0]
            _, _, like = _likeness(local, x, gate, turned)
            unit = pa.array(like.argmax(axis=1), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], unit], names=[*names, "cluster"])

    return near.mapInArrow(run, encoded.df.select(*others).withColumn("cluster", F.lit(0)).schema)


def assign_bmu(encoded: Encoded, som: WeightedSom | DealtSom, keep: list[str] | None = None) -> DataFrame:
    """``(key, …keep, cluster)``: the best-matching unit of every row, x * map_size + y."""
    if isinstance(som, DealtSom):
        return _assign_dealt(encoded, som, keep)
    turned = np.ascontiguousarray(_unit_rows(som.prototypes)[0].T)
    gate = som.gate
    names = list(dict.fromkeys([encoded.key, *(keep or [])]))
    raw = _places(encoded).select(*[F.col(f"`{c}`") for c in names], "indices", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _table(batch.column(len(names)), batch.column(len(names) + 1))
            _, _, like = _likeness(at, x, gate, turned)
            unit = pa.array(like.argmax(axis=1), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], unit], names=[*names, "cluster"])

    return raw.mapInArrow(run, raw.drop("indices", "cells").withColumn("cluster", F.lit(0)).schema)


def select_best_column(spans: list[Span], gate) -> tuple[str | None, dict[str, float]]:
    """Source column of the highest effective weight; a category counts its best value."""
    weight = {s.column: float(max(gate[s.start : s.start + s.size])) for s in spans if s.size}
    best = max(weight, key=weight.get, default=None)
    return best, weight


@dataclass
class Discovery:
    column: str
    proposed: list[str]
    som: WeightedSom | DealtSom
    column_weights: dict[str, float]


def check_parameters(map_size: int, epochs: int) -> None:
    if not MAP_SIZES[0] <= map_size <= MAP_SIZES[1]:
        raise ValueError("map size must be between 2 and 20")
    if not EPOCHS[0] <= epochs <= EPOCHS[1]:
        raise ValueError("epochs must be between 5 and 5000")


def suggested_epochs(rows: int) -> int:
    """Epochs in inverse proportion to the size of the concept."""
    return max(EPOCHS[0], min(EPOCHS[1], math.floor(250_000 / rows + 0.5)))


def discover(
    tax: Taxonomy,
    concept: str,
    map_size: int = 5,
    sparsity: float = 0.01,
    epochs: int = 100,
    merge_f1: float = 0.05,
    ignore: list[str] | None = None,
    seed: int = 0,
) -> Discovery:
    """Propose sub-concepts of ``concept``, each one restriction on the same column."""
    check_parameters(map_size, epochs)
    rows = tax.rows(concept)
    if rows.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError("the concept has too few rows (at least 4 are needed)")
    # Scales come from the whole table, as the encoding is shared by all concepts.
    encoder = fit_encoder(tax.df, tax.meta, tax.key, ignore)
    if not any(s.size for s in encoder.spans):
        raise ValueError("no encoded columns")
    som = fit_wsom(encoder.transform(rows), map_size, sparsity, epochs, seed)
    best, weight = som.best_column(encoder.spans)
    m = tax.meta[best]
    clustered = assign_bmu(encoder.transform(rows, [best]), som, [best]).persist()
    try:
        search = search_for(clustered, "cluster", m, tax.key)
        found = characterise(search, sorted(search.sizes))
        centroids = som.centroids
        merged = merge_clusters(search, found, {c: centroids[c] for c in search.sizes}, merge_f1)
        kept = drop_subsets(search, dedupe(merged))
    finally:
        clustered.unpersist()
    return Discovery(best, propose(tax, concept, [list(f.restrictions) for f in kept]), som, weight)


def propose(tax: Taxonomy, parent: str, restrictions: list[list]) -> list[str]:
    """Add proposed sub-concepts of origin ``wsom``."""
    made = []
    for rs in restrictions:
        i = tax.add_subconcept(parent, rs, origin="wsom")
        tax[i].proposed = True
        made.append(i)
    return made


def resolve(tax: Taxonomy, action: str, rerun=None):
    """Accept, drop or redo the proposed concepts."""
    proposed = [c for c in tax.concepts.values() if c.proposed]
    if action == "validate":
        for c in proposed:
            c.proposed = False
        return None
    if action in ("cancel", "retry"):
        for c in proposed:
            tax.delete(c.id)
        return rerun() if action == "retry" and rerun else None
    raise ValueError("action must be validate, cancel or retry")
