"""Formal concept analysis.

The attributes of one column exclude each other (one value, or one bin), so an
intent is one code per context column, ``NONE`` where the column is free. Rows
with the same codes are one object with a count. A concept is grown by fixing a
free column to a code; the closure keeps the codes on which all remaining
objects agree, which is a plain ``min = max`` aggregate.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
import operator as op

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import exact_quantiles
from ..metadata import ColumnMeta, Metadata
from ..plans.local import local_frame
from ..plans.numbering import contiguous_ids
from ..plans.scratch import Parts, Settled, settle
from ..sources.rowid import ROW_ID
from .encode import scale_source

NONE = -1
#: Objects of a code that one part of its posting list holds.
POSTING_OBJECTS = 50_000


@dataclass
class ContextColumn:
    """A column of the context; ``edges`` are its bin bounds, None for categories."""

    meta: ColumnMeta
    edges: list[float] | None = None

    @property
    def name(self) -> str:
        return self.meta.name

    def value(self) -> Column:
        """The category text, or the ordinal of the bin."""
        if self.edges is None:
            return self.meta.text
        x, last = scale_source(self.meta), len(self.edges) - 2
        out = F.lit(None).cast("int")
        for i in range(last, -1, -1):
            lo, hi = self.edges[i], self.edges[i + 1]
            below = x <= F.lit(hi) if i == last else x < F.lit(hi)
            out = F.when((x >= F.lit(lo)) & below, F.lit(i)).otherwise(out)
        return out

    def bins(self) -> list[tuple]:
        """``(code, name, lo, hi, hi included)`` of every bin."""
        out = []
        for i in range(len(self.edges) - 1):
            lo, hi, closed = self.edges[i], self.edges[i + 1], i == len(self.edges) - 2
            if self.meta.user_type == "date":
                a, b = (_day(lo), _day(hi))
            else:
                a, b = (f"{lo:.4g}", f"{hi:.4g}")
            out.append((i, f"{self.name}∈[{a},{b}{']' if closed else ')'}", lo, hi, closed))
        return out


def _day(seconds: float) -> str:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(seconds))).date().isoformat()


@dataclass
class FormalContext:
    columns: list[ContextColumn]
    rows: DataFrame
    objects: DataFrame
    attributes: DataFrame
    key: str

    @property
    def values(self) -> list[str]:
        return [f"v{j}" for j in range(len(self.columns))]


def context_columns(df: DataFrame, meta: Metadata, n_bins: int = 3, strategy: str = "quantile") -> list[ContextColumn]:
    """The included columns with their bins. Columns without two distinct values have none."""
    if strategy not in ("quantile", "uniform"):
        raise ValueError("strategy must be 'quantile' or 'uniform'")
    used = meta.usable()
    ranged = [m for m in used if m.user_type in ("numeric", "date")]
    edges: dict[str, list[float]] = {}
    if ranged:
        steps = [i / n_bins for i in range(n_bins + 1)] if strategy == "quantile" else [0.0, 1.0]
        if strategy == "quantile":
            numbers = df.select(*[scale_source(m).alias(m.name) for m in ranged])
            found = exact_quantiles(numbers, {m.name: steps for m in ranged})
        else:
            aggs = []
            for i, m in enumerate(ranged):
                aggs += [F.min(scale_source(m)).alias(f"lo{i}"), F.max(scale_source(m)).alias(f"hi{i}")]
            got = df.agg(*aggs).first()
            found = {m.name: [got[f"lo{i}"], got[f"hi{i}"]] for i, m in enumerate(ranged)}
        for name, found_edges in found.items():
            if found_edges[0] is None or found_edges[0] == found_edges[-1]:
                continue
            if strategy == "quantile":
                edges[name] = sorted(set(found_edges))
            else:
                lo, hi = found_edges
                cuts = [lo + (hi - lo) * i / n_bins for i in range(n_bins)] + [hi]
                # The lowest edge of equal-width bins sits 0.1 % of the range lower.
                cuts[0] = lo - (hi - lo) * 0.001
                edges[name] = cuts
    out = []
    for m in used:
        if m.user_type == "categorical":
            out.append(ContextColumn(m))
        elif m.name in edges:
            out.append(ContextColumn(m, edges[m.name]))
    return out


def context_rows(df: DataFrame, columns: list[ContextColumn], key: str = ROW_ID) -> DataFrame:
    """``(key, v0, v1, …)``: the attribute of every row in each context column."""
    return df.select(F.col(f"`{key}`"), *[c.value().alias(f"v{j}") for j, c in enumerate(columns)])


def clarify(rows: DataFrame, width: int) -> DataFrame:
    """The distinct attribute combinations with their number of rows."""
    return rows.groupBy(*[f"v{j}" for j in range(width)]).agg(F.count(F.lit(1)).alias("n"))


def formal_context(
    df: DataFrame, meta: Metadata, n_bins: int = 3, strategy: str = "quantile", key: str = ROW_ID
) -> FormalContext:
    columns = context_columns(df, meta, n_bins, strategy)
    if not columns:
        raise ValueError("no column gives an attribute")
    rows = context_rows(df, columns, key)
    clear = settle(clarify(rows, len(columns)), "objects")
    dictionary, attributes = _dictionary(clear, columns)
    return FormalContext(columns, rows, _coded(clear, columns, dictionary), attributes, key)


def _dictionary(clear: DataFrame, columns: list[ContextColumn]):
    """Codes of the category values, and the table of all attributes."""
    spark = clear.sparkSession
    bins = [
        (j, code, c.name, c.meta.user_type, None, name, lo, hi, closed)
        for j, c in enumerate(columns)
        if c.edges is not None
        for code, name, lo, hi, closed in c.bins()
    ]
    attributes = local_frame(
        spark,
        bins,
        "j int, code int, column string, kind string, value string, name string, lo double, hi double, hi_incl boolean",
    )
    texts = [(j, c) for j, c in enumerate(columns) if c.edges is None]
    if not texts:
        return None, attributes
    cells = F.array(
        *[
            F.struct(F.lit(j).alias("j"), F.lit(c.name).alias("column"), F.col(f"v{j}").alias("value"))
            for j, c in texts
        ]
    )
    values = clear.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    dictionary = contiguous_ids(values, "code", ["j", "value"]).withColumn("code", F.col("code").cast("int"))
    named = dictionary.select(
        "j",
        "code",
        "column",
        F.lit("categorical").alias("kind"),
        "value",
        F.concat_ws("=", "column", "value").alias("name"),
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        F.lit(None).cast("boolean").alias("hi_incl"),
    )
    return dictionary, attributes.unionByName(named)


def _coded(clear: DataFrame, columns: list[ContextColumn], dictionary: DataFrame | None) -> DataFrame:
    """The distinct combinations with their codes as one ``obj`` array."""
    out, codes = clear, []
    for j, c in enumerate(columns):
        if c.edges is not None:
            codes.append(F.coalesce(F.col(f"v{j}"), F.lit(NONE)))
            continue
        own = dictionary.where(F.col("j") == j).select(F.col("value").alias(f"v{j}"), F.col("code").alias(f"k{j}"))
        out = out.join(own, f"v{j}", "left")
        codes.append(F.coalesce(F.col(f"k{j}"), F.lit(NONE)))
    values = [f"v{j}" for j in range(len(columns))]
    return settle(out.select(*values, "n", F.array(*codes).alias("obj")), "coded")


# -- concepts -----------------------------------------------------------------


def closure(width: int, obj: str = "obj") -> Column:
    """Aggregate: the codes on which all grouped objects agree."""
    cells = []
    for j in range(width):
        code = F.get(F.col(obj), F.lit(j))
        cells.append(F.when(F.min(code) == F.max(code), F.min(code)).otherwise(F.lit(NONE)))
    return F.array(*cells)


def close(candidates: DataFrame, ctx: FormalContext, share: int = POSTING_OBJECTS) -> DataFrame:
    """``(cand, intent, size)``: the closed intent of each candidate with a row.

    Every code has a posting list of its objects. A candidate meets its objects in the list of the rarest
    code that it fixes. A list of more than ``share`` objects is split by a salt: each object lies in one
    part, and the candidates of that code visit all parts, where they add up their objects before
    the parts meet. Candidates that fix nothing close over all objects.
    """
    width = len(ctx.columns)
    held = ctx.objects.select("obj", "n", F.posexplode("obj").alias("j", "code")).where(F.col("code") != NONE)
    lists = held.groupBy("j", "code").agg(F.count(F.lit(1)).alias("objects"))
    lists = settle(lists.withColumn("parts", F.ceil(F.col("objects") / share).cast("int")), "lists")
    wanted = candidates.select("cand").distinct()
    codes = wanted.select("cand", F.posexplode("cand").alias("j", "code")).where(F.col("code") != NONE)
    rarest = (
        codes.join(lists, ["j", "code"]).groupBy("cand")
        .agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("objects", "j", "code", "parts")).alias("at"))
        # A code without a list has no objects, and neither has the candidate.
        .where(F.col("known") == F.size(F.filter("cand", lambda c: c != NONE)))
        .select("cand", "at.j", "at.code", F.explode(F.sequence(F.lit(0), F.col("at.parts") - 1)).alias("salt"))
    )
    posted = held.join(lists.select("j", "code", "parts"), ["j", "code"]).withColumn(
        "salt", F.pmod(F.xxhash64("obj"), F.col("parts")).cast("int")
    )
    met = posted.join(rarest, ["j", "code", "salt"]).where(_within("cand", "obj", width))
    part = met.groupBy("cand").agg(closure(width).alias("intent"), F.sum("n").alias("size"))
    top = ctx.objects.agg(closure(width).alias("intent"), F.sum("n").alias("size"))
    free = wanted.where(F.forall("cand", lambda c: c == NONE)).withColumn("one", F.lit(1))
    every = free.join(top.withColumn("one", F.lit(1)), "one").select("cand", "intent", "size")
    return part.unionByName(every)


def _within(part: str, whole: str, width: int) -> Column:
    """Every code fixed in ``part`` is the same in ``whole``."""
    tests = []
    for j in range(width):
        a, b = F.get(F.col(part), F.lit(j)), F.get(F.col(whole), F.lit(j))
        tests.append((a == NONE) | (a == b))
    return reduce(op.and_, tests)


@dataclass
class Lattice:
    """Concepts found from the top down, and from which parent and code each was made.

    ``tree`` holds ``(child, parent, j, code, depth)``: every concept but the top, once.
    """

    context: FormalContext
    concepts: DataFrame
    tree: DataFrame | None
    cut: bool
    depth: int


def fca(ctx: FormalContext, max_depth: int = 3) -> Lattice:
    """All formal concepts within ``max_depth`` growth steps of the top concept.

    Canonical generation. The generator of a concept is its smallest set of columns whose codes close to
    its intent; of equally small ones the first when columns are compared from the highest down. A part of such
    a generator is the generator of its own closure, so it is enough to grow a concept by columns above those of
    its generator: each set of columns is tried from one parent only, and each concept is kept
    once. A level is one aggregate over its (concept, object) pairs; the pairs of a level are
    removed when those of the next are written.
    """
    spark, width = ctx.objects.sparkSession, len(ctx.columns)
    concepts, tree = Parts(spark, "concepts"), Parts(spark, "tree")
    top = ctx.objects.agg(closure(width).alias("intent"), F.sum("n").alias("size"))
    level = concepts.add(top.withColumn("depth", F.lit(0)))
    extent = Settled(_root_extent(ctx, level), "extent")
    depth, cut, made = 0, True, False
    while depth < max_depth:
        grown = _grown(extent.df)
        step = Settled(
            grown.groupBy(F.col("intent").alias("parent"), "generator", "j", "code").agg(
                closure(width).alias("child"), F.sum("n").alias("size")
            ),
            "steps",
        )
        fresh = (
            step.df.join(concepts.all().select(F.col("intent").alias("child")), "child", "left_anti")
            .groupBy("child")
            .agg(
                F.min(F.struct(F.concat(F.array("j"), "generator").alias("generator"), "parent", "j", "code")).alias("by"),
                F.max("size").alias("size"),
            )
        )
        fresh = settle(fresh.select("child", "by.*", "size"), "fresh")
        step.drop()
        if fresh.isEmpty():
            cut = False
            break
        depth += 1
        below = grown.select(F.col("intent").alias("parent"), "obj", "n", "j", "code").join(
            fresh.drop("size"), ["parent", "j", "code"]
        )
        last, extent = extent, Settled(below.select(F.col("child").alias("intent"), "generator", "obj", "n"), "extent")
        last.drop()
        concepts.add(fresh.select(F.col("child").alias("intent"), "size", F.lit(depth).alias("depth")))
        tree.add(fresh.select("child", "parent", "j", "code", F.lit(depth).alias("depth")))
        made = True
    extent.drop()
    return Lattice(ctx, concepts.all(), tree.all() if made else None, cut, depth)


def _root_extent(ctx: FormalContext, level: DataFrame) -> DataFrame:
    top = level.first()["intent"]
    intent = F.array(*[F.lit(c) for c in top]).cast("array<int>")
    return ctx.objects.select(intent.alias("intent"), F.array().cast("array<int>").alias("generator"), "obj", "n")


def _grown(extent: DataFrame) -> DataFrame:
    """Each (concept, object) pair once per code of the object in a free column above the concept's generator."""
    return extent.select("intent", "generator", "obj", "n", F.posexplode("obj").alias("j", "code")).where(
        (F.col("code") != NONE)
        & (F.get("intent", F.col("j")) == NONE)
        # The highest column of a generator is its first.
        & (F.col("j") > F.coalesce(F.get("generator", F.lit(0)), F.lit(-1)))
    )


def memberships(objects: DataFrame, lattice: Lattice) -> DataFrame:
    """``(obj, intents)``: all found concepts whose codes the distinct code arrays ``obj`` have.

    An object descends the tree of generators, one equi-join per level, and visits each of its concepts once.
    """
    spark = objects.sparkSession
    top = lattice.concepts.where("depth = 0").first()
    if top is None:
        return objects.select("obj", F.array().cast("array<array<int>>").alias("intents"))
    found = Parts(spark, "memberships")
    root = F.array(*[F.lit(c) for c in top["intent"]]).cast("array<int>")
    level = found.add(objects.select("obj", root.alias("intent")))
    for depth in range(1, lattice.depth + 1):
        arcs = lattice.tree.where(F.col("depth") == depth).select(F.col("parent").alias("intent"), "j", "code", "child")
        free = level.select("obj", "intent", F.posexplode("obj").alias("j", "code")).where(
            (F.col("code") != NONE) & (F.get("intent", F.col("j")) == NONE)
        )
        level = found.add(free.join(arcs, ["intent", "j", "code"]).select("obj", F.col("child").alias("intent")))
    return found.all().groupBy("obj").agg(F.sort_array(F.collect_list("intent")).alias("intents"))


def _finest(intents: Column, width: int) -> Column:
    """The antichain of an array of intents of one object: those that no other one refines.

    All hold codes of the same object, so there are at most 2^columns of them.
    """
    return F.filter(intents, lambda a: ~F.exists(intents, lambda b: (a != b) & _refines(b, a, width)))


def _refines(fine: Column, coarse: Column, width: int) -> Column:
    tests = [(F.get(coarse, F.lit(j)) == NONE) | (F.get(coarse, F.lit(j)) == F.get(fine, F.lit(j))) for j in range(width)]
    return reduce(op.and_, tests)


def hasse(lattice: Lattice) -> DataFrame:
    """``(parent, child)`` intents of the direct relations between found concepts.

    The concepts that contain a concept are found like those that contain an object, and the finest of them
    are its parents: one aggregate per concept, no comparison of relations with each other.
    """
    width = len(lattice.context.columns)
    above = memberships(lattice.concepts.select(F.col("intent").alias("obj")), lattice)
    proper = F.filter("intents", lambda a: a != F.col("obj"))
    return above.select(F.explode(_finest(proper, width)).alias("parent"), F.col("obj").alias("child"))


def leaves(lattice: Lattice, relations: DataFrame) -> DataFrame:
    """Concepts without a child."""
    return lattice.concepts.join(relations.select(F.col("parent").alias("intent")), "intent", "left_anti")


def most_specific(lattice: Lattice) -> DataFrame:
    """``(key, intent)``: the concepts of each row that no other of its concepts refines."""
    ctx, width = lattice.context, len(lattice.context.columns)
    held = memberships(ctx.objects.select("obj"), lattice)
    minimal = held.select("obj", F.explode(_finest(F.col("intents"), width)).alias("intent"))
    of_object = ctx.objects.select(*ctx.values, "obj").join(minimal, "obj")
    r, o = ctx.rows.alias("r"), of_object.alias("o")
    same = reduce(op.and_, [F.col(f"r.{v}").eqNullSafe(F.col(f"o.{v}")) for v in ctx.values])
    return r.join(o, same).select(F.col(f"r.{ctx.key}"), F.col("o.intent"))


def number_concepts(lattice: Lattice) -> DataFrame:
    """Concepts with ``seq`` and ``id``: by depth, then larger first, then intent."""
    numbered = contiguous_ids(lattice.concepts, "seq", ["depth", F.desc("size"), "intent"])
    return numbered.withColumn(
        "id", F.when(F.col("seq") == 0, F.lit("root")).otherwise(F.format_string("c%02d", "seq"))
    )


def intents(concepts: DataFrame, ctx: FormalContext) -> DataFrame:
    """``(intent, i, m, attribute fields…)``: the attributes each concept fixes."""
    codes = concepts.select("intent", F.posexplode("intent").alias("j", "code")).where(F.col("code") != NONE)
    return codes.join(ctx.attributes, ["j", "code"])


def describe(concepts: DataFrame, ctx: FormalContext) -> DataFrame:
    """The concepts with one text column per context column: the value or bin ordinal fixed."""
    parts = intents(concepts.select("intent").distinct(), ctx)
    texts = F.coalesce("value", F.col("code").cast("string"))
    wide = parts.groupBy("intent").agg(
        *[F.max(F.when(F.col("j") == j, texts)).alias(c.name) for j, c in enumerate(ctx.columns)]
    )
    return concepts.join(wide, "intent", "left")
