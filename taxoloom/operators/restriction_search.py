"""From clusters to readable restrictions on one column.

Clusters partition the rows, so the counts of (cluster, value) or (cluster,
threshold bucket) hold everything the search needs: any candidate's support and
hits are sums of those counts, and so are those of a merged cluster.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quantiles import exact_quantiles, position
from ..metadata import ColumnMeta
from ..plans.local import local_frame
from ..plans.scratch import settle
from .predicate import Restriction

# The quantiles tried as thresholds.
NUMERIC_STEPS = [p / 100 for p in range(5, 100, 5)]
DATE_STEPS = [p / 100 for p in range(10, 100, 10)]


@dataclass(frozen=True)
class Found:
    """A restriction for one cluster, with the span of values it keeps."""

    restrictions: tuple[Restriction, ...]
    f1: float
    support: int
    span: tuple


def f1(hits: float, support: float, size: float) -> float:
    """Harmonic mean of precision and recall of ``support`` rows against ``size``."""
    return 2.0 * hits / (support + size) if hits else 0.0


def f1_column(hits: Column, support: Column, size: Column) -> Column:
    return F.when(hits > 0, F.lit(2.0) * hits / (support + size)).otherwise(F.lit(0.0))


# -- categories ---------------------------------------------------------------


def best_values(df: DataFrame, cluster: str, m: ColumnMeta, key: str) -> DataFrame:
    """``(cluster, value, f1, support, hits)``: the best ``=`` restriction per cluster.

    Ties go to the value seen first in key order. Clusters that hold no value
    have no row.
    """
    counts, totals, sizes = _category_counts(df, cluster, m, key)
    scored = counts.join(totals, "value").join(sizes, cluster)
    scored = scored.withColumn("f1", f1_column(F.col("hits"), F.col("support"), F.col("size")))
    order = Window.partitionBy(cluster).orderBy(F.desc("f1"), F.asc("first_key"))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == 1)
    return best.select(cluster, "value", "f1", "support", "hits")


def _category_counts(df: DataFrame, cluster: str, m: ColumnMeta, key: str):
    """Hits per (cluster, value), totals per value and rows per cluster, from one scan."""
    cells = df.groupBy(cluster, m.text.alias("value")).agg(
        F.count(F.lit(1)).alias("hits"), F.min(F.col(f"`{key}`")).alias("first_key")
    )
    cells = settle(cells, "cells")
    counts = cells.where(F.col("value").isNotNull()).select(cluster, "value", "hits")
    totals = (
        cells.where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.sum("hits").alias("support"), F.min("first_key").alias("first_key"))
    )
    sizes = cells.groupBy(cluster).agg(F.sum("hits").alias("size"))
    return counts, totals, sizes


class CategorySearch:
    """Best ``=`` restriction of any union of clusters, from a settled table of counts."""

    def __init__(self, df: DataFrame, cluster: str, m: ColumnMeta, key: str):
        self.column, self._cluster = m.name, cluster
        counts, totals, sizes = _category_counts(df, cluster, m, key)
        self._table = settle(counts.join(totals, "value"), "categories")
        self._kind = dict(self._table.dtypes)[cluster]
        self.sizes = {r[cluster]: r["size"] for r in sizes.collect()}

    def best(self, clusters: frozenset) -> Found | None:
        return self.best_of([clusters])[0]

    def best_of(self, unions: list[frozenset]) -> list[Found | None]:
        """The best restriction of each union, all from one job."""
        members = local_frame(
            self._table.sparkSession,
            [(i, sum(self.sizes[c] for c in u), c) for i, u in enumerate(unions) for c in u],
            f"u int, size long, `{self._cluster}` {self._kind}",
        )
        hits = (
            self._table.join(members, self._cluster)
            .groupBy("u", "size", "value", "support", "first_key")
            .agg(F.sum("hits").alias("hits"))
            .withColumn("f1", f1_column(F.col("hits"), F.col("support"), F.col("size")))
        )
        first = Window.partitionBy("u").orderBy(F.desc("f1"), F.asc("first_key"))
        top = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") == 1)
        out: list[Found | None] = [None] * len(unions)
        for r in top.select("u", "value", "f1", "support").collect():
            restriction = Restriction(self.column, "=", r["value"])
            out[r["u"]] = Found((restriction,), r["f1"], r["support"], (r["value"],))
        return out

    def strictly_inside(self, a: Found, b: Found) -> bool:
        """Rows of ``a`` are a proper part of those of ``b``: never for two values."""
        return False


# -- ordered columns ----------------------------------------------------------


class RangeSearch:
    """Best bound or half-open interval of any union of clusters."""

    def __init__(self, df: DataFrame, cluster: str, m: ColumnMeta, thresholds: list[float], pairs: bool, restrict):
        self.column, self.pairs, self._restrict = m.name, pairs, restrict
        self.cuts = sorted(set(thresholds))
        self.tried = thresholds
        value = m.number if m.user_type == "numeric" else m.micros.cast("double")
        bucket = F.when(value.isNotNull(), position(value, self.cuts)).otherwise(F.lit(-1))
        rows = df.groupBy(cluster, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()
        self.sizes: dict = {}
        self.counts: dict = {}
        for r in rows:
            self.sizes[r[cluster]] = self.sizes.get(r[cluster], 0) + r["n"]
            bins = self.counts.setdefault(r[cluster], [0] * (len(self.cuts) + 1))
            if r["bucket"] >= 0:
                bins[r["bucket"]] += r["n"]
        self.total = [sum(b[i] for b in self.counts.values()) for i in range(len(self.cuts) + 1)]
        self.usable = sum(self.total) >= 2
        self.tests = self._candidates()
        self._start = np.array([t[0] for t in self.tests], dtype=int)
        self._end = np.array([t[1] for t in self.tests], dtype=int)
        running = np.concatenate([[0], np.cumsum(self.total)])
        self._support = running[self._end] - running[self._start]

    def _candidates(self) -> list[tuple]:
        """``(start bucket, end bucket, low, high)`` in the order they are tried."""
        end = len(self.cuts) + 1
        out = []
        for t in self.tried:
            at = self.cuts.index(t) + 1
            out += [(at, end, t, None), (0, at, None, t)]
        if self.pairs:
            for i, low in enumerate(self.cuts):
                out += [(i + 1, j + 1, low, self.cuts[j]) for j in range(i + 1, len(self.cuts))]
        return out

    def best_of(self, unions: list[frozenset]) -> list[Found | None]:
        return [self.best(u) for u in unions]

    def best(self, clusters: frozenset) -> Found | None:
        if not self.usable:
            return None
        size = sum(self.sizes[c] for c in clusters)
        own = np.concatenate([[0], np.cumsum([self.counts[c] for c in clusters], axis=1).sum(axis=0)])
        hits = own[self._end] - own[self._start]
        scores = np.where(hits > 0, 2.0 * hits / (self._support + size), 0.0)
        top = int(scores.argmax())
        if scores[top] <= 0.0:
            return None
        start, end, low, high = self.tests[top]
        return Found(
            tuple(self._restrict(self.column, low, high)),
            float(scores[top]),
            int(self._support[top]),
            (start, end),
        )

    def strictly_inside(self, a: Found, b: Found) -> bool:
        def held(x: Found) -> set[int]:
            return {i for i in range(*x.span) if self.total[i]}

        return held(a) < held(b)


def _numeric_restrictions(column: str, low, high) -> list[Restriction]:
    out = []
    if low is not None:
        out.append(Restriction(column, ">=", low))
    if high is not None:
        out.append(Restriction(column, "<", high))
    return out


def micros_text(micros: float) -> str:
    """A date when the time of day is midnight, else the full timestamp."""
    t = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(micros))
    return t.date().isoformat() if t.time() == dt.time() else t.isoformat(sep=" ")


def _date_restrictions(column: str, low, high) -> list[Restriction]:
    return _numeric_restrictions(
        column, None if low is None else micros_text(low), None if high is None else micros_text(high)
    )


def numeric_thresholds(df: DataFrame, m: ColumnMeta) -> list[float]:
    got = exact_quantiles(df.select(m.number.alias("x")), {"x": NUMERIC_STEPS})["x"]
    return sorted({_round4(v) for v in got if v is not None})


def date_thresholds(df: DataFrame, m: ColumnMeta) -> list[float]:
    got = exact_quantiles(df.select(m.micros.cast("double").alias("x")), {"x": DATE_STEPS})["x"]
    return [float(math.floor(v)) for v in got if v is not None]


def _round4(v: float) -> float:
    return round(v, 4)


def search_for(df: DataFrame, cluster: str, m: ColumnMeta, key: str):
    """The restriction search that fits the column's type."""
    if m.user_type == "categorical":
        return CategorySearch(df, cluster, m, key)
    if m.user_type == "numeric":
        return RangeSearch(df, cluster, m, numeric_thresholds(df, m), True, _numeric_restrictions)
    if m.user_type == "date":
        return RangeSearch(df, cluster, m, date_thresholds(df, m), False, _date_restrictions)
    raise ValueError(f"no restrictions on {m.user_type} columns")


# -- merging, duplicates and subsets ------------------------------------------


def characterise(search, clusters: list) -> dict:
    """The best restriction of every cluster, or None."""
    return dict(zip(clusters, search.best_of([frozenset([c]) for c in clusters])))


def cosine(a, b) -> float:
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def merge_clusters(search, found: dict, centroids: dict, threshold: float) -> list[Found]:
    """Join clusters whose common restriction beats both of their own by ``threshold``.

    The most similar pair of centroids is tried first, ties by the larger ids;
    a refused pair is not tried again and the search restarts after a merge. All pairs
    that are new in a round are searched in one job.
    """
    live = {}
    for c, result in found.items():
        if result is not None:
            live[len(live)] = (frozenset([c]), list(centroids[c]), result)
    fresh = len(live)
    refused: set[tuple[int, int]] = set()
    similar: dict[tuple[int, int], float] = {}
    joint_of: dict[tuple[int, int], Found | None] = {}
    while True:
        ids = sorted(live)
        pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (a, b) not in refused]
        for a, b in pairs:
            if (a, b) not in similar:
                similar[a, b] = cosine(live[a][1], live[b][1])
        new = [p for p in pairs if p not in joint_of]
        if new:
            joint_of.update(zip(new, search.best_of([live[a][0] | live[b][0] for a, b in new])))
        for a, b in sorted(pairs, key=lambda p: (similar[p], p), reverse=True):
            both = live[a][0] | live[b][0]
            joint = joint_of[a, b]
            needed = max(live[a][2].f1, live[b][2].f1) + threshold
            if joint is not None and joint.f1 >= needed:
                middle = [(x + y) / 2 for x, y in zip(live[a][1], live[b][1])]
                del live[a], live[b]
                live[fresh] = (both, middle, joint)
                fresh += 1
                break
            refused.add((a, b))
        else:
            return [live[i][2] for i in live]


def dedupe(found: list[Found]) -> list[Found]:
    """The first of each set of equal restrictions."""
    seen: dict = {}
    for f in found:
        seen.setdefault(tuple((r.column, r.operator, str(r.value)) for r in f.restrictions), f)
    return list(seen.values())


def drop_subsets(search, found: list[Found]) -> list[Found]:
    """Without those whose rows are a proper part of another's."""
    return [a for a in found if not any(search.strictly_inside(a, b) for b in found)]
