"""Exact quantiles that never gather a whole column in one task.

The built-in ``percentile`` keeps every distinct value of a column in one
aggregation buffer. Here approximate quantiles are put around every wanted
order statistic, the rows at and between them are counted, and the gap that
holds the statistic is searched again until it pins one value or has few
enough rows to sort. Every pass is a scan with a constant-size result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Rows of a bracket that are sorted in one buffer.
SORTED_ROWS = 10_000
ACCURACY = 2_000


@dataclass
class _Target:
    """The ``rank``-th smallest of the ``inside`` rows of ``column`` strictly within (lo, hi)."""

    column: str
    rank: int
    inside: int
    lo: float | None = None
    hi: float | None = None
    value: float | None = None

    @property
    def bracket(self) -> tuple:
        return (self.column, self.lo, self.hi)


def position(value: Column, edges: list[float], exact: bool = False) -> Column:
    """How many of the sorted ``edges`` are at or below ``value``, by binary search.

    With ``exact``, twice that number, less one where ``value`` equals an edge.
    """

    def search(low: int, high: int) -> Column:
        if low == high:
            if exact and low:
                return F.when(value == F.lit(edges[low - 1]), F.lit(2 * low - 1)).otherwise(F.lit(2 * low))
            return F.lit(2 * low if exact else low)
        middle = (low + high) // 2
        return F.when(value < F.lit(edges[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(edges))


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of DOUBLE columns free of NaN; None for a column without values."""
    if not wanted:
        return {}
    names = list(wanted)
    df = df.select(*[F.col(f"`{c}`") for c in names])
    sizes = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(names)]).first()
    count = {c: sizes[f"n{i}"] for i, c in enumerate(names)}

    targets: dict[tuple[str, int], _Target] = {}
    for c, ps in wanted.items():
        for p in ps:
            if count[c]:
                spot = (count[c] - 1) * p
                for k in (math.floor(spot), math.ceil(spot)):
                    targets.setdefault((c, k), _Target(c, k, count[c]))

    while open_ := [t for t in targets.values() if t.value is None]:
        _sort_small(df, [t for t in open_ if t.inside <= SORTED_ROWS])
        _narrow(df, [t for t in open_ if t.inside > SORTED_ROWS])

    out: dict[str, list[float | None]] = {}
    for c, ps in wanted.items():
        out[c] = []
        for p in ps:
            if not count[c]:
                out[c].append(None)
                continue
            spot = (count[c] - 1) * p
            low, high = math.floor(spot), math.ceil(spot)
            a, b = targets[c, low].value, targets[c, high].value
            out[c].append(a if a == b else (high - spot) * a + (spot - low) * b)
    return out


def _by_bracket(targets: list[_Target]) -> dict[tuple, list[_Target]]:
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault(t.bracket, []).append(t)
    return groups


def _rows_inside(df: DataFrame, brackets: list[tuple]) -> DataFrame:
    """``(g, v)``: the values inside each bracket. Brackets of a column do not overlap."""
    cells = []
    for column in dict.fromkeys(b[0] for b in brackets):
        own = {b: g for g, b in enumerate(brackets) if b[0] == column}
        edges = sorted({x for _, lo, hi in own for x in (lo, hi) if x is not None})
        groups = [None] * (2 * len(edges) + 1)
        for (_, _, hi), g in own.items():
            groups[2 * (len(edges) if hi is None else edges.index(hi))] = g
        v = F.col(f"`{column}`")
        spot = position(v, edges, exact=True)
        g = F.get(F.array(*[F.lit(x).cast("int") for x in groups]), spot)
        cells.append(F.struct(F.when(v.isNotNull(), g).alias("g"), v.alias("v")))
    return df.select(F.inline(F.array(*cells))).where(F.col("g").isNotNull())


def _sort_small(df: DataFrame, targets: list[_Target]) -> None:
    """Sort the few rows left in a bracket and read the ranks off."""
    groups = _by_bracket(targets)
    if not groups:
        return
    ranks = F.array(*[F.array(*[F.lit(t.rank) for t in ts]) for ts in groups.values()])
    picked = (
        _rows_inside(df, list(groups))
        .groupBy("g")
        .agg(F.array_sort(F.collect_list("v")).alias("vs"))
        .select("g", F.transform(F.get(ranks, F.col("g")), lambda k: F.get(F.col("vs"), k)).alias("picked"))
        .collect()
    )
    found = {r["g"]: r["picked"] for r in picked}
    for g, ts in enumerate(groups.values()):
        for t, v in zip(ts, found[g]):
            t.value = v


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """Put approximate quantiles around every target and count the rows between them."""
    groups = _by_bracket(targets)
    if not groups:
        return
    inside = _rows_inside(df, list(groups))
    margin = 2.0 / ACCURACY
    aggs = []
    for g, ts in enumerate(groups.values()):
        ps = {
            min(1.0, max(0.0, (t.rank + 0.5) / t.inside + side)) for t in ts for side in (-margin, margin)
        }
        own = F.when(F.col("g") == g, F.col("v"))
        aggs.append(F.percentile_approx(own, sorted(ps), ACCURACY).alias(f"e{g}"))
    picked = inside.agg(*aggs).first()
    edges = [sorted(set(picked[f"e{g}"])) for g in range(len(groups))]

    spot = F.lit(None).cast("int")
    for g in range(len(groups)):
        spot = F.when(F.col("g") == g, position(F.col("v"), edges[g], exact=True)).otherwise(spot)
    rows = inside.groupBy("g", spot.alias("spot")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[int, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(r["g"], {})[r["spot"]] = r["n"]
    for g, ts in enumerate(groups.values()):
        for t in ts:
            _place(t, edges[g], counts[g])


def _place(t: _Target, edges: list[float], counts: dict[int, int]) -> None:
    """Move a target to the spot that holds its rank: an edge, or the gap between two."""
    before = 0
    for spot in sorted(counts):
        if t.rank < before + counts[spot]:
            at = spot // 2
            if spot % 2:
                t.value = edges[at]
            else:
                t.lo = edges[at - 1] if at else t.lo
                t.hi = edges[at] if at < len(edges) else t.hi
                t.rank, t.inside = t.rank - before, counts[spot]
            return
        before += counts[spot]
