"""Hierarchical clustering and the concept tree cut from it.

Rows with equal features are one weighted point. Clusters that are each other's
nearest neighbour merge in the same round, which gives the same tree as merging
one pair at a time for the linkages offered here (up to ties). Clusters that lie
together are dealt to one block. A task merges those of its block while nothing in
the boxes around the other blocks can be nearer, and only clusters that get no
further so ask the blocks that may hold their nearest. Clusters, neighbours and
merges are tables. The last ``LAST_CLUSTERS`` are merged on the driver, from
the matrix of their distances. ``micro_clusters`` reduces the points first, for
tables that are too much.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..plans.local import local_frame
from ..plans.numbering import contiguous_ids
from ..plans.scratch import Parts, Settled, settle
from .encode import Encoded

LINKAGES = ("ward", "complete", "average", "single")
METRICS = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine")
# A caller's limit on the distinct points of one call, whose pairs are all compared; none by default.
MOST_POINTS: int | None = None
# Clusters whose matrix of distances is small enough for the driver, and cells of their centres.
LAST_CLUSTERS = 1024
LAST_CELLS = 1 << 21
# Points and cells of one block of clusters.
BLOCK_POINTS = 8192
BLOCK_CELLS = 1 << 20
# Cells of the rows that a task of k-means keeps.
TRAINED_CELLS = 1 << 21
# Distances that a task works on at once.
HELD_CELLS = 1 << 18
# Clusters whose matrix of distances a task holds.
BLOCK_CLUSTERS = 2048
# Clusters in one box of a block, and cells of all boxes.
CELL_CLUSTERS = 64
BOX_CELLS = 1 << 20
# Features that place clusters on a curve.
CURVE_FEATURES = 6
# Members per cluster from which running sums are faster than pairs.
SUMMED_MEMBERS = 4
# Share of clusters that merge inside blocks below which the others are asked too.
SLOW_ROUND = 0.25

MERGES = "node long, left long, right long, distance double, size long"
JOINED = "t long, a long, b long, d double, size long"


class Dendrogram:
    """Merges over leaves 0 … n-1; the last merge is the root, node 2n-2.

    ``leaves`` maps each row key to its leaf. ``placed`` has the row key ``k`` of each leaf, its point, and the first leaf
    and number of leaves of that point; ``tops`` has the node that stands for a whole point, ``outer`` the merges of points.
    """

    def __init__(self, merges: DataFrame, placed: DataFrame, tops: DataFrame, outer: DataFrame, n: int, key: str):
        self.merges, self.placed, self.tops, self.outer, self.n, self.key = merges, placed, tops, outer, n, key
        self.leaves = placed.select(F.col("k").alias(key), "leaf")

    @property
    def root(self) -> int:
        return 2 * self.n - 2


def micro_clusters(encoded: Encoded, m: int, seed: int = 0) -> Encoded:
    """Replace each row by the centre of its k-means cluster.

    The reduction that lets ``hac`` handle any number of rows: clustering the
    centres, weighted by their rows, approximates clustering the rows.
    """
    points = encoded.df.withColumn("vector", array_to_vector("features"))
    spark = encoded.df.sparkSession
    parts = -(-points.count() * max(1, encoded.width) // TRAINED_CELLS)
    # A task keeps its rows as vectors, which take far more than they do in a file.
    trained = points.select("vector").repartition(max(parts, spark.sparkContext.defaultParallelism)) if parts > 1 else points
    model = KMeans(k=m, seed=seed, featuresCol="vector", predictionCol="micro").fit(trained)
    centers = local_frame(
        spark,
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "micro int, features array<double>",
    )
    moved = model.transform(points).drop("features", "vector").join(centers, "micro").drop("micro")
    return Encoded(moved, encoded.features, encoded.spans, encoded.key)


def hac(encoded: Encoded, linkage: str = "ward", metric: str = "euclidean") -> Dendrogram:
    """Agglomerative merges of all rows."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {', '.join(LINKAGES)}")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    if linkage == "ward" and metric != "euclidean":
        raise ValueError("ward linkage needs the euclidean metric")
    spark, key = encoded.df.sparkSession, encoded.key

    rows = settle(encoded.df.select(F.col(f"`{key}`").alias("k"), "features"), "encoded")
    grouped = rows.groupBy("features").agg(F.count(F.lit(1)).alias("w"), F.min("k").alias("first"))
    points = settle(contiguous_ids(grouped, "point", ["first"]), "points")
    found = points.agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("n")).first()
    m, n = found["m"], found["n"]
    if m == 0:
        raise ValueError("no rows to cluster")
    if MOST_POINTS is not None and m > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} distinct rows: reduce them with micro_clusters first")

    # Leaves: rows numbered point by point, so a point owns w leaves from its start.
    keyed = rows.join(points.select("features", "point"), "features").select("k", "point")
    numbered = settle(contiguous_ids(keyed, "leaf", ["point", "k"]), "leaves")
    spans = settle(numbered.groupBy("point").agg(F.min("leaf").alias("start"), F.count(F.lit(1)).alias("w")), "spans")
    leaves = numbered.join(spans, "point")

    # Node that stands for a whole point once its equal rows are merged.
    start, w = F.col("start"), F.col("w")
    tops = spans.select("point", F.when(w == 1, start).otherwise(n + start - F.col("point") + w - 2).alias("node"))
    merged = _merge_points(points.select("point", "w", "features"), m, encoded.width, linkage, metric)
    outer = settle(_number(merged, tops, m, n + (n - m)), "outer")
    tree = settle(_within_points(leaves, n).unionByName(outer), "merges")
    return Dendrogram(tree, leaves, tops, outer, n, key)


def _heap_node(h, n: int):
    """The node of a place in the heap of a point."""
    w, start = F.col("w"), F.col("start")
    return F.when(h >= w, start + h - w).otherwise(n + start - F.col("point") + w - 1 - h)


def _within_points(leaves: DataFrame, n: int) -> DataFrame:
    """Zero-distance merges of the equal rows of each point, as a balanced tree.

    Heap numbering: with w leaves, node i (1 … w-1) joins 2i and 2i+1, and
    numbers from w on are leaves. So the row of rank i yields merge i alone.
    """
    i = F.col("leaf") - F.col("start")
    w = F.col("w")

    def node(h):
        return _heap_node(h, n)

    # Leaves below heap node i: numbers w … 2w-1 that fall in one of its levels.
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.lit(2.0) * w / i)).cast("int") + 1)
    size = F.aggregate(
        F.transform(
            levels,
            lambda s: F.greatest(
                F.lit(0).cast("double"),
                F.least((i + 1) * F.pow(F.lit(2.0), s), F.lit(2.0) * w) - F.greatest(i * F.pow(F.lit(2.0), s), w.cast("double")),
            ),
        ),
        F.lit(0.0),
        lambda a, b: a + b,
    )
    one, two = node(2 * i), node(2 * i + 1)
    return leaves.where(i >= 1).select(
        node(i).alias("node"),
        F.least(one, two).alias("left"),
        F.greatest(one, two).alias("right"),
        F.lit(0.0).alias("distance"),
        size.cast("long").alias("size"),
    )


def _number(merged: DataFrame, tops: DataFrame, m: int, base: int) -> DataFrame:
    """Give the merges of points node ids in order of distance."""
    ranked = settle(contiguous_ids(merged, "node", ["d", "t"], start=base), "ranked")
    nodes = tops.select(F.col("point").alias("c"), "node").unionByName(ranked.select((m + F.col("t")).alias("c"), "node"))
    one, two = (nodes.select(F.col("c").alias(end), F.col("node").alias(f"node_{end}")) for end in ("a", "b"))
    return ranked.join(one, "a").join(two, "b").select(
        "node",
        F.least("node_a", "node_b").alias("left"),
        F.greatest("node_a", "node_b").alias("right"),
        F.col("d").alias("distance"),
        "size",
    )


def _pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - (a @ b.T) / np.outer(na, nb)
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        if metric == "cityblock":
            out += np.abs(gap, out=gap)
        elif metric == "chebyshev":
            np.maximum(out, np.abs(gap, out=gap), out=out)
        else:
            out += np.multiply(gap, gap, out=gap)
    return np.sqrt(out, out=out) if metric == "euclidean" else out


# -- merging points -----------------------------------------------------------

CLUSTERS = "c long, h double, w array<double>, x array<double>"
HELD = "b int, ids binary, first binary, h binary, w binary, x binary"
BOXES = "low binary, high binary, light binary"
LEFT = f"{HELD}, near binary, d binary, {BOXES}, made binary, heights binary"


class Block(NamedTuple):
    """Clusters by id: where the members of each begin, its height, and the weights and features of all members."""

    ids: np.ndarray
    first: np.ndarray
    h: np.ndarray
    w: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, row: dict, side: str = "") -> Block:
        ids, first = (np.frombuffer(row[f"{c}{side}"], np.int64) for c in ("ids", "first"))
        h, w, x = (np.frombuffer(row[f"{c}{side}"]) for c in ("h", "w", "x"))
        return cls(ids, first, h, w, x.reshape(len(w), -1))

    @classmethod
    def of_batch(cls, batch: pa.RecordBatch) -> Block:
        w, x = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("w", "x"))
        sizes = np.diff(batch["w"].offsets.to_numpy())
        return cls(batch["c"].to_numpy(), np.cumsum(sizes, dtype=np.int64) - sizes, batch["h"].to_numpy(), w, x.reshape(len(w), -1))

    @property
    def ends(self) -> np.ndarray:
        return np.append(self.first[1:], len(self.w))

    @property
    def sizes(self) -> np.ndarray:
        return np.add.reduceat(self.w, self.first)

    @property
    def centres(self) -> np.ndarray:
        return np.add.reduceat(self.x * self.w[:, None], self.first, axis=0) / self.sizes[:, None]

    def reach(self, linkage: str) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest features that count for the bounds of a cluster: of all members, or of the centre."""
        if linkage == "single":
            return np.minimum.reduceat(self.x, self.first, axis=0), np.maximum.reduceat(self.x, self.first, axis=0)
        return (self.centres,) * 2

    def made_of(self, parts: list[list[int]], ids: np.ndarray, h: np.ndarray) -> Block:
        """The clusters that join some of these each."""
        ends = self.ends
        at = [np.arange(self.first[p], ends[p]) for ps in parts for p in ps]
        sizes = np.array([sum(ends[p] - self.first[p] for p in ps) for ps in parts], dtype=np.int64)
        rows = np.concatenate(at) if at else np.zeros(0, np.int64)
        return Block(ids, np.cumsum(sizes) - sizes, h, self.w[rows], self.x[rows])

    def taken(self, places: np.ndarray) -> Block:
        return self.made_of([[p] for p in places.tolist()], self.ids[places], self.h[places])

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(v, t).tobytes() for v, t in zip(self, (np.int64, np.int64, float, float, float))]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist())


def _row(schema: str, values: list) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    arrays = [pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for v in values]
    return pa.RecordBatch.from_arrays(arrays, names=names)


class Boxes(NamedTuple):
    """Boxes around clusters of a block each, and the least weight of a cluster in each."""

    b: np.ndarray
    low: np.ndarray
    high: np.ndarray
    light: np.ndarray

    @classmethod
    def collect(cls, blocks: DataFrame, width: int) -> Boxes:
        got = blocks.select("b", "low", "high", "light").collect()
        low, high = (np.frombuffer(b"".join(r[c] for r in got)).reshape(-1, width) for c in ("low", "high"))
        b = np.repeat([r["b"] for r in got], [len(r["light"]) // 8 for r in got])
        return cls(b, low, high, np.frombuffer(b"".join(r["light"] for r in got)))

    def some(self, at: np.ndarray) -> Boxes:
        return Boxes(*(v[at] for v in self))

    def gaps(self, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
        """Bounds just below the distances from each of some extents to what is in each box."""
        if metric == "cosine":
            return np.zeros((len(low), len(self.b)))
        out = np.zeros((len(low), len(self.b)))
        for f in range(low.shape[1]):
            apart = np.maximum(self.low[:, f] - high[:, f, None], low[:, f, None] - self.high[:, f])
            np.maximum(apart, 0.0, out=apart)
            if metric == "cityblock":
                out += apart
            elif metric == "chebyshev":
                np.maximum(out, apart, out=out)
            else:
                out += np.multiply(apart, apart, out=apart)
        if metric in ("euclidean", "sqeuclidean"):
            np.sqrt(out, out=out)
        # Less by more than sums can be off by rounding.
        out = np.maximum(out * (1 - 1e-9) - 1e-11, 0.0, out=out)
        return out * out if metric == "sqeuclidean" else out

    def bounds(self, low: np.ndarray, high: np.ndarray, w: np.ndarray, linkage: str, metric: str) -> np.ndarray:
        """Distances that no cluster in a box is nearer than, from each of some clusters."""
        out = self.gaps(low, high, metric)
        return out * np.sqrt(2.0 * self.light * w[:, None] / (self.light + w[:, None])) if linkage == "ward" else out


def _outside(boxes: Boxes, linkage: str, metric: str):
    """How near anything in the boxes may be to each of some clusters."""

    def limits(low: np.ndarray, high: np.ndarray, w: np.ndarray) -> np.ndarray:
        out, step = np.full(len(w), np.inf), max(1, HELD_CELLS // max(1, len(boxes.b)))
        for at in range(0, len(w), step):
            part = slice(at, at + step)
            out[part] = boxes.bounds(low[part], high[part], w[part], linkage, metric).min(axis=1, initial=np.inf)
        return out

    return limits


def _cells(block: Block, linkage: str, most: int, curve: Callable) -> list[bytes]:
    """The boxes of a block, around clusters that share the leading bits of their places on a curve each."""
    (low, high), sizes, z = block.reach(linkage), block.sizes, curve(block.centres)
    order = np.argsort(z, kind="stable")
    low, high, sizes, z = low[order], high[order], sizes[order], z[order]
    size = max(CELL_CLUSTERS, -(-len(z) // most))
    todo, starts = [(0, len(z), 61)], []
    while todo:
        start, end, bit = todo.pop()
        if end - start <= size or bit < 0:
            starts.append(start)
            continue
        # The places of a part agree above the bit.
        middle = start + int(np.searchsorted(z[start:end] >> bit & 1, 1))
        todo += [(a, b, bit - 1) for a, b in ((start, middle), (middle, end)) if a < b]
    starts.sort()
    boxes = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(sizes, starts)
    return [v.astype(float).tobytes() for v in boxes]


def _extent(points: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature: the lowest and highest value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            x = batch["features"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            low, high = np.minimum(low, x.min(axis=0, initial=np.inf)), np.maximum(high, x.max(axis=0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (low, high)], names=["low", "high"])

    got = points.select("features").mapInArrow(run, "low binary, high binary").collect()
    low, high = (np.array([np.frombuffer(r[c]) for r in got]) for c in ("low", "high"))
    return low.min(axis=0), high.max(axis=0)


def _curve(extent: tuple[np.ndarray, np.ndarray], shift: float) -> Callable:
    """Places on a Z-order curve of 62 bits or fewer through the features that spread most."""
    low, span = extent[0], extent[1] - extent[0]
    widest = np.argsort(-span, kind="stable")[:CURVE_FEATURES]
    bits, unit = 62 // len(widest), max(float(span.max()), 1e-300) * 2.0

    def places(x: np.ndarray) -> np.ndarray:
        steps = ((x[:, widest] - low[widest]) / unit + shift / 2) * (1 << bits)
        steps, out = np.clip(steps, 0, (1 << bits) - 1).astype(np.int64), np.zeros(len(x), np.int64)
        for bit in range(bits - 1, -1, -1):
            for k in range(len(widest)):
                out = out << 1 | steps[:, k] >> bit & 1
        return out

    return places


def _dealt(clusters: DataFrame, n_blocks: int, linkage: str, most: int, curve: Callable) -> Settled:
    """Clusters that lie together as one row of arrays per block, with the boxes around them."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = curve(Block.of_batch(batch).centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], names=[*batch.schema.names, "z"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Block.of_batch(batch) for batch in batches if batch.num_rows]
        if held:
            at = np.cumsum([0, *[len(v.w) for v in held[:-1]]])
            first = np.concatenate([v.first + a for v, a in zip(held, at)])
            block = Block(*(np.concatenate(v) for v in zip(*held)))._replace(first=first)
            block = block.taken(np.argsort(block.ids))
            yield _row(f"{HELD}, {BOXES}", [TaskContext.get().partitionId(), *block.packed(), *_cells(block, linkage, most, curve)])

    placed = clusters.mapInArrow(place, f"{CLUSTERS}, z long")
    ranged = placed.repartitionByRange(n_blocks, "z").select("c", "h", "w", "x")
    return Settled(ranged.mapInArrow(pack, f"{HELD}, {BOXES}"), "blocks")


def _clusters(blocks: DataFrame) -> DataFrame:
    """The clusters of packed blocks as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            v = Block.of(row)
            lists = []
            for flat, ends in ((v.w, np.append(v.first, len(v.w))), (v.x.ravel(), np.append(v.first, len(v.w)) * v.x.shape[1])):
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(v.ids), pa.array(v.h), *lists], names=["c", "h", "w", "x"])

    return blocks.select(*[f.split()[0] for f in HELD.split(", ")]).mapInArrow(run, CLUSTERS)


def _summed(part: Block, x_r: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sums of cityblock distances from all members of each cluster to each row, feature by feature from running sums."""
    k, m = len(part.ids), len(x_r)
    owner = np.repeat(np.arange(k), part.ends - part.first)
    total, origin, out = part.sizes, part.centres, np.zeros((k, m))
    for f in range(x_r.shape[1]):
        xs = x_r[order[f], f]
        at = owner * (m + 1) + np.searchsorted(xs, part.x[:, f])
        off = part.w * (part.x[:, f] - origin[owner, f])
        below, moved = (np.bincount(at, v, k * (m + 1)).reshape(k, m + 1)[:, :m].cumsum(axis=1) for v in (part.w, off))
        from_origin = xs - origin[:, f, None]
        away = 2.0 * (from_origin * below - moved) + np.bincount(owner, off, k)[:, None] - from_origin * total[:, None]
        out[:, order[f]] += np.maximum(away, 0.0)
    return out


def _linked(left: Block, right: Block, linkage: str, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some clusters of ``left`` at a time, as places, with their distances to all clusters of ``right``."""
    ids, first, _, w, x = left
    _, first_r, _, w_r, x_r = right
    step = max(1, HELD_CELLS // max(1, len(w_r)))
    if linkage == "ward":
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            # With the euclidean metric, from centre to centre.
            square = _pairwise(x[part], x_r, "sqeuclidean")
            yield np.arange(len(ids))[part], np.sqrt(2.0 * w_r * w[part, None] / (w_r + w[part, None]) * square)
        return
    fold = {"complete": np.maximum, "single": np.minimum, "average": np.add}[linkage]
    ends = left.ends
    size, size_r = left.sizes, right.sizes
    if (linkage, metric) == ("average", "cityblock") and len(w) > SUMMED_MEMBERS * len(ids):
        order = [np.argsort(x_r[:, f], kind="stable") for f in range(x_r.shape[1])]
        for c in range(0, len(ids), step):
            at = np.arange(c, min(len(ids), c + step))
            rows = slice(first[c], ends[at[-1]])
            part = Block(ids[at], first[at] - first[c], left.h[at], w[rows], x[rows])
            total = np.add.reduceat(_summed(part, x_r, order) * w_r, first_r, axis=1)
            yield at, total / (size_r * size[at, None])
        return
    c = 0
    while c < len(ids):
        # Whole clusters up to the step; a larger cluster alone, in parts.
        last = max(c + 1, int(np.searchsorted(ends, first[c] + step, side="right")))
        lo, hi, total = int(first[c]), int(ends[last - 1]), None
        for at in range(lo, hi, step):
            part = slice(at, min(hi, at + step))
            d = _pairwise(x[part], x_r, metric)
            if linkage == "average":
                d = d * w_r * w[part, None]
            d = fold.reduceat(d, first_r, axis=1) if len(first_r) < len(w_r) else d
            starts = np.maximum(first[c:last] - at, 0)
            d = fold.reduceat(d, starts, axis=0) if last - c < len(d) else d
            total = d if total is None else fold(total, d)
        if linkage == "average":
            total = total / (size_r * size[c:last, None])
        yield np.arange(c, last), total
        c = last


def _agglomerate(d: np.ndarray, block: Block, next_id: int, linkage: str, outside: Callable | None):
    """Merges of clusters that are each other's nearest, in rounds on the matrix of their distances.

    Nothing ``outside`` may be as near as what is merged. Returns the merges, the parts of each cluster left, and
    its id, height, nearest other and the distance to that.
    """
    k, out = len(block.ids), []
    d[np.isnan(d)] = np.inf
    np.fill_diagonal(d, np.inf)
    ids, h, size, x = block.ids.copy(), block.h.copy(), np.rint(block.sizes).astype(np.int64), block.centres
    low, high = (v.copy() for v in block.reach(linkage))
    limit = np.full(k, np.inf) if outside is None else outside(low, high, size)
    parts = [[c] for c in range(k)]
    # Places in the matrix in order of their ids; a merge takes the place of its first cluster.
    live = np.arange(k)
    near, gap = live, np.full(k, np.inf)
    while len(live) > 1:
        part = d[np.ix_(live, live)]
        at = part.argmin(axis=1)
        near, gap = live[at], part[np.arange(len(live)), at]
        first = np.flatnonzero((at[at] == np.arange(len(at))) & (at > np.arange(len(at))))
        if outside is not None:
            first = first[gap[first] < np.minimum(limit[live[first]], limit[near[first]])]
        pairs = sorted((gap[i], ids[live[i]], ids[near[i]], live[i], near[i]) for i in first)
        if not pairs:
            if outside is not None:
                break
            i = min(range(len(live)), key=lambda i: (gap[i], ids[live[i]]))
            pairs = [(gap[i], ids[live[i]], ids[near[i]], live[i], near[i])]
        for apart, one, two, c, q in pairs:
            total = size[c] + size[q]
            # No lower than its parts, which rounding could make it.
            h[c] = max(apart, h[c], h[q])
            out.append((next_id, int(one), int(two), float(h[c]), int(total)))
            x[c] = (x[c] * size[c] + x[q] * size[q]) / total
            if linkage == "average":
                d[c] = (d[c] * size[c] + d[q] * size[q]) / total
            elif linkage != "ward":
                d[c] = (np.maximum if linkage == "complete" else np.minimum)(d[c], d[q])
            size[c], ids[c] = total, next_id
            if linkage == "ward":
                gaps = ((x - x[c]) ** 2).sum(axis=1)
                d[c] = np.sqrt(2.0 * size * total / (size + total) * gaps)
            d[c, c] = np.inf
            d[:, c] = d[c]
            low[c], high[c] = (np.minimum(low[c], low[q]), np.maximum(high[c], high[q])) if linkage == "single" else (x[c], x[c])
            parts[c] += parts[q]
            next_id += 1
        gone = {p[4] for p in pairs}
        live = np.array(sorted((c for c in live.tolist() if c not in gone), key=lambda c: ids[c]))
        if outside is not None:
            new = [p[3] for p in pairs]
            limit[new] = outside(low[new], high[new], size[new])
    if len(live) == 1:
        near, gap = live, np.array([np.inf])
    return out, [parts[c] for c in live], ids[live], h[live], ids[near], gap, x


def _merge_near(linkage: str, metric: str, boxes: Boxes, base: int, stride: int, most: int, curve: Callable):
    """Of each block: what can be merged without a look at the others, and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b, block = row["b"], Block.of(row)
            outside = _outside(boxes.some(boxes.b != b), linkage, metric)
            d = np.concatenate([d for _, d in _linked(block, block, linkage, metric)])
            d = np.minimum(d, d.T)
            merged, parts, ids, h, near, gap, x = _agglomerate(d, block, base + b * stride, linkage, outside)
            if linkage == "ward":
                at = [ps[0] for ps in parts]
                size = np.array([block.w[ps].sum() for ps in parts])
                left = Block(ids, np.arange(len(ids)), h, size, x[at])
            else:
                left = block.made_of(parts, ids, h)
            made = np.array([m[:3] + m[4:] for m in merged], np.int64).reshape(-1, 4)
            heights = np.array([m[3] for m in merged], float)
            extra = [v.tobytes() for v in (near.astype(np.int64), gap.astype(float))]
            yield _row(LEFT, [b, *left.packed(), *extra, *_cells(left, linkage, most, curve), made.tobytes(), heights.tobytes()])

    return run


def _merges(m: int):
    """The merges of packed blocks as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            made, d = np.frombuffer(row["made"], np.int64).reshape(-1, 4), np.frombuffer(row["heights"])
            columns = [made[:, 0] - m, made[:, 1], made[:, 2], d, made[:, 3]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["t", "a", "b", "d", "size"])

    return run


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest of each cluster in its own block."""
    for row in _rows(batches):
        ids, near, d = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("near", np.int64), ("d", float)))
        at = np.isfinite(d)
        yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (ids, near, d)], names=["c", "near", "d"])


def _links(linkage: str, metric: str, boxes: Boxes):
    """The other blocks in which clusters of a block may have their nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            others, block = boxes.some(boxes.b != row["b"]), Block.of(row)
            (low, high), w, d = block.reach(linkage), block.sizes, np.frombuffer(row["d"])
            may, step = np.zeros(len(others.b), bool), max(1, HELD_CELLS // max(1, len(others.b)))
            for at in range(0, len(w), step):
                part = slice(at, at + step)
                may |= (others.bounds(low[part], high[part], w[part], linkage, metric) <= d[part, None]).any(axis=0)
            to = np.unique(others.b[may])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), row["b"]), pa.int32()), pa.array(to, pa.int32())], names=["b_l", "b_r"])

    return run


def _nearest(linkage: str, metric: str, width: int):
    """Of each pair of blocks: the nearest cluster of the right one for each of the left one that may have its nearest there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            left, right, d = Block.of(row, "_l"), Block.of(row, "_r"), np.frombuffer(row["d_l"])
            low, high = (np.frombuffer(row[f"{c}_r"]).reshape(-1, width) for c in ("low", "high"))
            light = np.frombuffer(row["light_r"])
            boxes = Boxes(np.zeros(len(light), int), low, high, light)
            at = np.flatnonzero((boxes.bounds(*left.reach(linkage), left.sizes, linkage, metric) <= d[:, None]).any(axis=1))
            if not len(at):
                continue
            left = left.taken(at)
            for at, d in _linked(left, right, linkage, metric):
                place = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
                best = d[np.arange(len(at)), place]
                found = np.isfinite(best)
                columns = [pa.array(left.ids[at][found]), pa.array(right.ids[place][found]), pa.array(best[found])]
                yield pa.RecordBatch.from_arrays(columns, names=["c", "near", "d"])

    return run


def _matrix(linkage: str, metric: str):
    """Of each pair of blocks: the distances of their clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            left, right = Block.of(row, "_l"), Block.of(row, "_r")
            d = np.concatenate([d for _, d in _linked(left, right, linkage, metric)])
            columns = [pa.array([v.tobytes()], pa.binary()) for v in (left.ids, right.ids, d)]
            yield pa.RecordBatch.from_arrays(columns, names=["l", "r", "d"])

    return run


def _sides(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in blocks.columns]) for side in ("l", "r"))


def _merge_points(points: DataFrame, m: int, width: int, linkage: str, metric: str) -> DataFrame:
    """``(t, a, b, d, size)`` in merge order; ids below m are points, m + t is merge t.

    A round deals clusters that lie together to blocks. A task merges those of its block that are each other's nearest
    while the boxes around all other blocks are further away than that. Where this gets hardly anywhere, the clusters left ask
    the blocks that may hold their nearest. Bounds hold for every metric but cosine, with which all blocks are asked. With
    ward a cluster is held as its centre.
    """
    spark = points.sparkSession
    rows = points.select(F.col("point").alias("c"), F.lit(0.0).alias("h"), F.array(F.col("w").cast("double")).alias("w"), F.col("features").alias("x"))
    last = max(2, min(LAST_CLUSTERS, LAST_CELLS // max(1, width)))
    extent = _extent(points, width) if m > last else None
    clusters, old = rows, []
    done, live, base, turn = Parts(spark, "merged"), m, m, 0
    while live > last:
        n_blocks = _n_blocks(live, m, width, linkage, metric)
        most = max(1, BOX_CELLS // max(1, n_blocks * width))
        # Other borders in every round.
        curve = _curve(extent, turn * 0.618 % 1)
        blocks = _dealt(clusters, n_blocks, linkage, most, curve)
        boxes = Boxes.collect(blocks.df, width)
        left = Settled(blocks.df.mapInArrow(_merge_near(linkage, metric, boxes, base, live, most, curve), LEFT), "left")
        for table in (*old, blocks):
            table.drop()
        made = done.add(left.df.select("made", "heights").mapInArrow(_merges(m), JOINED))
        count = made.count()
        base, before, live, turn = base + (n_blocks + 1) * live, live, live - count, turn + 1
        clusters, old = _clusters(left.df), [left]
        if live > last and count < SLOW_ROUND * before:
            after, count = _merge_across(left.df, done, base, m, width, linkage, metric)
            left.drop()
            base, live = base + count, live - count
            clusters, old = after.df, [after]
    late = local_frame(spark, _merge_last(clusters, m, base, live, width, linkage, metric), JOINED)
    return late if live == m else done.all().select("t", "a", "b", "d", "size").unionByName(late)


def _n_blocks(live: int, m: int, width: int, linkage: str, metric: str) -> int:
    """Blocks whose matrix a task can hold, and whose members it can compare."""
    most = min(BLOCK_POINTS, max(1, BLOCK_CELLS // max(1, width)))
    held = live if linkage == "ward" else m
    # Sums of cityblock distances take no look at pairs of members.
    reach = SUMMED_MEMBERS * 2 if (linkage, metric) == ("average", "cityblock") else 1
    return max(1, -(-live // min(most, BLOCK_CLUSTERS)), -(-held // (most * reach)))


def _merge_across(left: DataFrame, done: Parts, base: int, m: int, width: int, linkage: str, metric: str) -> tuple[Settled, int]:
    """One round of merges of clusters that are each other's nearest in whatever blocks: the clusters after it, and how many."""
    boxes = Boxes.collect(left, width)
    links = left.mapInArrow(_links(linkage, metric, boxes), "b_l int, b_r int")
    one, two = _sides(left.drop("near", "made", "heights"))
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(len(np.unique(boxes.b)) ** 2, 2000))
    asked = links.join(one, "b_l").join(two, "b_r").repartition(tasks, "b_l", "b_r")
    answers = asked.mapInArrow(_nearest(linkage, metric, width), "c long, near long, d double")
    known = left.select("ids", "near", "d").mapInArrow(_known, "c long, near long, d double")
    best = answers.unionByName(known).groupBy("c").agg(F.min(F.struct("d", "near")).alias("best")).select("c", "best.d", "best.near")
    found = Settled(best, "nearest")
    back = found.df.select(F.col("c").alias("near"), F.col("near").alias("c"))
    pairs = settle(found.df.join(back, ["c", "near"], "left_semi").where("c < near"), "pairs")
    if pairs.isEmpty():
        # Equal distances in a circle: take the closest pair.
        pairs = settle(found.df.orderBy("d", "c").limit(1), "pairs")
    clusters = _clusters(left)
    a, b = (clusters.select(F.col("c").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in ("h", "w", "x")]) for c in ("c", "near"))
    numbered = settle(contiguous_ids(pairs, "t", ["d", "c", "near"], start=base - m), "numbered")
    w, x = F.concat("w_c", "w_near"), F.concat("x_c", "x_near")
    total = F.aggregate(w, F.lit(0.0), lambda p, q: p + q)
    if linkage == "ward":
        w_c, w_near = F.get("w_c", F.lit(0)), F.get("w_near", F.lit(0))
        w, x = F.array(total), F.zip_with("x_c", "x_near", lambda p, q: (p * w_c + q * w_near) / total)
    both = Settled(
        numbered.join(a, "c").join(b, "near")
        .select("t", "c", "near", F.greatest("d", "h_c", "h_near").alias("h"), w.alias("w"), x.alias("x"), F.round(total).cast("long").alias("size")),
        "joined",
    )
    made = done.add(both.df.select("t", F.col("c").alias("a"), F.col("near").alias("b"), F.col("h").alias("d"), "size"))
    gone = both.df.select(F.explode(F.array("c", "near")).alias("c"))
    new = both.df.select((m + F.col("t")).alias("c"), "h", "w", "x")
    after = Settled(clusters.join(gone, "c", "left_anti").unionByName(new), "clusters")
    found.drop()
    both.drop()
    return after, made.count()


def _merge_last(clusters: DataFrame, m: int, base: int, live: int, width: int, linkage: str, metric: str) -> list[tuple]:
    """The merges of the last clusters, in rounds like the others, on the matrix of their distances."""
    if live < 2:
        return []
    names = ("c", "h", "w", "x") if linkage == "ward" else ("c", "h")
    size, x = F.aggregate("w", F.lit(0.0), lambda p, q: p + q), "x"
    got = sorted(clusters.select("c", "h", size.alias("w"), *[x for _ in names[3:]]).collect())
    ids, h, w = (np.array([r[c] for r in got], t) for c, t in (("c", np.int64), ("h", float), ("w", float)))
    x = np.array([r["x"] for r in got], float).reshape(live, -1) if linkage == "ward" else np.zeros((live, 0))
    block = Block(ids, np.arange(live), h, w, x)
    if linkage == "ward":
        d = np.concatenate([v for _, v in _linked(block, block, linkage, metric)])
    else:
        d = np.zeros((live, live))
        n_blocks = min(live, _n_blocks(live, m, width, linkage, metric))
        curve = _curve(_extent(clusters.select(F.col("x").alias("features")), width), 0.0)
        held = _dealt(clusters, n_blocks, linkage, BOX_CELLS, curve)
        one, two = _sides(held.df)
        pairs = one.join(two, F.col("b_l") <= F.col("b_r")).repartition(n_blocks * (n_blocks + 1) // 2, "b_l", "b_r")
        for r in pairs.mapInArrow(_matrix(linkage, metric), "l binary, r binary, d binary").collect():
            left, right = (np.searchsorted(ids, np.frombuffer(r[c], np.int64)) for c in ("l", "r"))
            part = np.frombuffer(r["d"]).reshape(len(left), len(right))
            d[np.ix_(right, left)] = part.T
            d[np.ix_(left, right)] = part
        held.drop()
    merged = _agglomerate(d, block, base, linkage, None)[0]
    return [(c - m, *rest) for c, *rest in merged]


# -- cut ----------------------------------------------------------------------


def cut_tree(tree: Dendrogram, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(id, name, parent_id, depth, size)`` and ``(concept_id, key)``.

    The dendrogram is walked from its root, left before right, to ``max_depth``
    levels below the root concept. Only the leaves of the cut hold rows.
    """
    spark, n = tree.merges.sparkSession, tree.n
    root = local_frame(
        spark, [("root", "Root", None, 0, n)], "id string, name string, parent_id string, depth int, size long"
    )
    if n < 2:
        return root, tree.leaves.select(F.lit("root").alias("concept_id"), tree.key)
    sizes = tree.merges.select(F.col("node").alias("at"), "left", "right", F.col("size").alias("n"))
    level = local_frame(spark, [(tree.root, "0")], "node long, path string")
    nodes = Parts(spark, "nodes")
    for depth in range(1, max_depth + 1):
        # The few merges of the level first, so that the table of merges is not dealt out.
        own = sizes.join(level.select(F.col("node").alias("at")), "at", "left_semi")
        joined = level.join(own, level["node"] == own["at"], "left")
        level = nodes.add(
            joined.select(
                "node",
                "path",
                F.lit(depth).alias("depth"),
                F.coalesce("n", F.lit(1)).cast("long").alias("size"),
                "left",
                "right",
            )
        )
        inner = level.where(F.col("left").isNotNull())
        if depth == max_depth or inner.isEmpty():
            break
        level = inner.select(
            F.inline(
                F.array(
                    F.struct(F.col("left").alias("node"), F.concat("path", F.lit("0")).alias("path")),
                    F.struct(F.col("right").alias("node"), F.concat("path", F.lit("1")).alias("path")),
                )
            )
        )
    # Paths in text order are the tree in depth-first order.
    ids = settle(
        contiguous_ids(nodes.all(), "seq", ["path"], start=1).withColumn("id", F.format_string("c%02d", "seq")), "cut"
    )
    parents = ids.select(F.col("path").alias("up"), F.col("id").alias("parent"))
    up = F.expr("left(path, length(path) - 1)")
    named = ids.withColumn("up", up).join(parents, "up", "left").select(
        "id",
        F.col("id").alias("name"),
        F.coalesce("parent", F.lit("root")).alias("parent_id"),
        "depth",
        "size",
    )
    ends = ids.where((F.col("node") < n) | (F.col("depth") == max_depth)).select("node", "id")
    return root.unionByName(named), _rows_below(tree, ends)


def _rows_below(tree: Dendrogram, ends: DataFrame) -> DataFrame:
    """The row keys under each end node.

    Points reach their ends by doubling the jumps up the merges of points. Ends inside a point are met by the
    places above each of its leaves. So rows are joined with what is known of their point or place, never by end.
    """
    up = tree.outer.select(
        F.inline(
            F.array(
                F.struct(F.col("left").alias("node"), F.col("node").alias("to")),
                F.struct(F.col("right").alias("node"), F.col("node").alias("to")),
            )
        )
    )
    top = local_frame(tree.merges.sparkSession, [(tree.root, tree.root)], "node long, to long")
    stop = ends.select("node", F.lit(True).alias("end"))
    jumps = settle(
        up.join(stop, "node", "left")
        .select("node", F.when(F.col("end"), F.col("node")).otherwise(F.col("to")).alias("to"))
        .unionByName(top),
        "jumps",
    )
    arrived = stop.select(F.col("node").alias("to"))
    while True:
        reached = tree.tops.join(jumps, "node")
        if reached.where(F.col("to") != tree.root).join(arrived, "to", "left_anti").isEmpty():
            break
        on = jumps.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumps = settle(jumps.join(on, "to").select("node", F.col("next").alias("to")), "jumps")
    owner = settle(reached.join(ends.select(F.col("node").alias("to"), "id"), "to").select("point", "id"), "owner")
    held = tree.placed.join(owner, "point").select("id", "k")
    inside = settle(ends.join(jumps.select("node"), "node", "left_anti").select("node", "id"), "inside")
    if not inside.isEmpty():
        h = F.col("leaf") - F.col("start") + F.col("w")
        above = F.transform(
            F.sequence(F.lit(0), F.log2(h).cast("int")), lambda s: F.floor(h / F.pow(F.lit(2.0), s)).cast("long")
        )
        places = tree.placed.join(owner, "point", "left_anti").withColumn("h", F.explode(above))
        under = places.select("k", _heap_node(F.col("h"), tree.n).alias("node")).join(inside, "node")
        held = held.unionByName(under.select("id", "k"))
    return held.select(F.col("id").alias("concept_id"), F.col("k").alias(tree.key))


def to_taxonomy(tree: Dendrogram, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """The cut as a concept table with sizes of the rows held, and its membership."""
    concepts, membership = cut_tree(tree, max_depth)
    held = membership.groupBy(F.col("concept_id").alias("id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return concepts.join(held, "id", "left").na.fill(0, ["n_rows"]), membership
