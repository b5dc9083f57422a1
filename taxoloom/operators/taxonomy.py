"""The concept algebra: a DAG of predicates over the rows of one table.

A concept is a boolean expression. Editing the DAG touches driver-side metadata
only; sizes, coverage and memberships of all concepts come from one scan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
import operator as op

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..metadata import Metadata, metadata_from_types
from ..plans.local import local_frame
from ..sources.rowid import ROW_ID
from .predicate import Restriction, restrictions_to_column

# Above this many concepts, per-concept totals are grouped by concept id
# instead of being separate aggregate columns of one row.
WIDE_CONCEPTS = 150
# Terms up to which one concept is a single filter over the scan.
LARGE_PREDICATE = 200
# Selections up to this size test their pairs as columns of one aggregate.
WIDE_PAIRS = 24


# A row set: ("all",), ("none",), ("where", restrictions), ("and" | "or", row sets),
# ("not", row set) or ("flag", concept id).
RowSet = tuple


@dataclass
class Concept:
    id: str
    seq: int
    name: str
    origin: str
    restrictions: list[Restriction] = field(default_factory=list)
    parent_ids: list[str] = field(default_factory=list)
    child_ids: list[str] = field(default_factory=list)
    source_ids: list[str] = field(default_factory=list)
    proposed: bool = False
    # Row set that no longer follows the definition: always in snapshot mode,
    # else only once a source has been deleted.
    snapshot: RowSet | None = None


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _combine(kind: str, parts: list[RowSet], empty: RowSet = ("none",)) -> RowSet:
    if kind == "and":
        parts = [p for p in parts if p != ("all",)] or parts[:1]
    if not parts:
        return empty
    return parts[0] if len(parts) == 1 else (kind, parts)


def _terms(rows: RowSet, known: dict[int, int]) -> int:
    """Number of terms of a row set written out in full."""
    if id(rows) not in known:
        kind, *args = rows
        if kind in ("and", "or"):
            known[id(rows)] = sum(_terms(x, known) for x in args[0])
        else:
            known[id(rows)] = _terms(args[0], known) if kind == "not" else 1
    return known[id(rows)]


def _row_set_from_json(text: str | None) -> RowSet | None:
    def build(x):
        kind, *args = x
        if kind == "where":
            return (kind, [tuple(r) for r in args[0]])
        if kind == "not":
            return (kind, build(args[0]))
        if kind in ("and", "or"):
            return (kind, [build(y) for y in args[0]])
        return tuple(x)

    return build(json.loads(text)) if text else None


class Taxonomy:
    """Concepts over ``df``.

    ``recompute="derived"`` reads every concept from its definition, so an edit
    is seen everywhere at once. ``recompute="snapshot"`` keeps the row set of
    each concept as last computed and, on an edit, recomputes descendants from
    their parents only.
    """

    def __init__(self, df: DataFrame, meta: Metadata, key: str = ROW_ID, recompute: str = "derived"):
        if recompute not in ("derived", "snapshot"):
            raise ValueError("recompute must be 'derived' or 'snapshot'")
        if key not in df.columns:
            raise ValueError(f"no key column {key!r}; see with_row_id")
        self.df, self.meta, self.key, self.recompute = df, meta, key, recompute
        self.reset()

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    # -- structure ------------------------------------------------------------

    def reset(self) -> str:
        """Back to the root concept alone."""
        self._next = 0
        self.concepts: dict[str, Concept] = {}
        self.root_id = self._add("root", name="Root").id
        return self.root_id

    def _add(self, origin: str, name: str = "", **links) -> Concept:
        concept = Concept(f"c{self._next}", self._next, name, origin, **links)
        self._next += 1
        self.concepts[concept.id] = concept
        return concept

    def __getitem__(self, concept_id: str) -> Concept:
        if concept_id not in self.concepts:
            raise KeyError(f"unknown concept {concept_id!r}")
        return self.concepts[concept_id]

    def _selected(self, ids: list[str], least: int) -> list[Concept]:
        if len(ids) < least:
            raise ValueError(f"select at least {least} concept(s)")
        return [self[i] for i in ids]

    def _common_parents(self, selected: list[Concept]) -> list[str]:
        return [p for p in selected[0].parent_ids if all(p in c.parent_ids for c in selected)]

    # -- predicates -----------------------------------------------------------

    def predicate(self, concept_id: str) -> Column:
        """The rows of a concept as one Catalyst expression."""
        return self._column(self._expanded(concept_id, {}))

    def _column(self, rows: RowSet) -> Column:
        kind, *args = rows
        if kind == "all":
            return F.lit(True)
        if kind == "none":
            return F.lit(False)
        if kind == "flag":
            return F.col(f"is_{args[0]}")
        if kind == "where":
            return restrictions_to_column([Restriction(*r) for r in args[0]], self.meta)
        if kind == "not":
            # Two-valued: a row with missing values is in the complement.
            return ~_false_if_null(self._column(args[0]))
        combine = op.and_ if kind == "and" else op.or_
        return reduce(combine, [self._column(x) for x in args[0]])

    def _expanded(self, concept_id: str, known: dict[str, RowSet]) -> RowSet:
        """The row set of a concept in terms of restrictions only."""
        if concept_id not in known:
            c = self[concept_id]
            known[concept_id] = c.snapshot or self._definition(c, lambda i: self._expanded(i, known))
        return known[concept_id]

    def _definition(self, c: Concept, of) -> RowSet:
        """The row set of ``c`` from the row sets ``of`` its sources and first parent."""
        sources = [of(i) for i in c.source_ids if i in self.concepts]
        if c.origin == "root":
            return ("all",)
        if c.origin in ("union", "intersection"):
            parts = [_combine("or" if c.origin == "union" else "and", sources)]
        else:
            parts = [of(c.parent_ids[0])] if c.parent_ids else []
        if c.origin == "complement" and sources:
            parts.append(("not", _combine("or", sources)))
        return self._restricted(c, parts)

    def _restricted(self, c: Concept, parts: list[RowSet]) -> RowSet:
        if c.restrictions:
            parts = parts + [("where", [(r.column, r.operator, r.value) for r in c.restrictions])]
        return _combine("and", parts, empty=("all",))

    def _from_parents(self, c: Concept) -> RowSet:
        """Row set as recomputed from the current row sets of the parents."""
        if c.origin == "root":
            return ("all",)
        parents = [self._expanded(p, {}) for p in c.parent_ids if p in self.concepts]
        if c.origin in ("union", "intersection"):
            parts = [_combine("or" if c.origin == "union" else "and", parents)]
        else:
            parts = parents[:1]
        return self._restricted(c, parts)

    def _freeze(self, c: Concept) -> None:
        if self.recompute == "snapshot":
            c.snapshot = self._definition(c, lambda i: self._expanded(i, {}))

    # -- operations -----------------------------------------------------------

    def add_subconcept(self, parent: str, restrictions: list[Restriction], name: str = "", origin: str = "restriction") -> str:
        """A child of ``parent`` holding the rows that meet all restrictions."""
        self[parent]
        if not restrictions:
            raise ValueError("at least one restriction is required")
        restrictions_to_column(restrictions, self.meta)
        c = self._add(
            origin, name, restrictions=list(restrictions), parent_ids=[parent], source_ids=[parent]
        )
        self._freeze(c)
        self[parent].child_ids.append(c.id)
        return c.id

    def complement(self, ids: list[str], name: str = "") -> str:
        """Rows of the one common parent that are in none of ``ids``."""
        common = self._common_parents(self._selected(ids, 1))
        if len(common) != 1:
            raise ValueError("the concepts must share exactly one parent")
        c = self._add("complement", name, parent_ids=common, source_ids=list(ids))
        self._freeze(c)
        self[common[0]].child_ids.append(c.id)
        return c.id

    def union(self, ids: list[str], name: str = "") -> str:
        """A new parent of ``ids``, itself under the root."""
        selected = self._selected(ids, 2)
        c = self._add(
            "union", name, parent_ids=[self.root_id], child_ids=list(ids), source_ids=list(ids)
        )
        self._freeze(c)
        for s in selected:
            if c.id not in s.parent_ids:
                s.parent_ids.append(c.id)
        self[self.root_id].child_ids.append(c.id)
        return c.id

    def intersection(self, ids: list[str], name: str = "") -> str:
        """A new child of all of ``ids``."""
        selected = self._selected(ids, 2)
        c = self._add("intersection", name, parent_ids=list(ids), source_ids=list(ids))
        self._freeze(c)
        for s in selected:
            if c.id not in s.child_ids:
                s.child_ids.append(c.id)
        return c.id

    def find_intersections(self, ids: list[str]) -> list[str]:
        """An intersection concept for every pair that shares rows, in selection order."""
        self._selected(ids, 2)
        hit = self.overlaps(ids)
        found = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (a, b) in hit]
        if not found:
            raise ValueError("no two of the concepts share rows")
        return [self.intersection([a, b]) for a, b in found]

    def overlaps(self, ids: list[str]) -> set[tuple[str, str]]:
        """Pairs of ``ids`` with a common row, from one scan."""
        flags = self.flags(ids)
        if len(ids) <= WIDE_PAIRS:
            pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
            got = flags.agg(
                *[F.bool_or(F.col(f"is_{a}") & F.col(f"is_{b}")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]
            ).first()
            return {pair for k, pair in enumerate(pairs) if got[f"p{k}"]}
        # Rows with the same memberships are one combination; pairs are formed
        # from the distinct combinations only.
        held = F.array_compact(F.array(*[F.when(F.col(f"is_{i}"), F.lit(n)) for n, i in enumerate(ids)]))
        combos = flags.select(held.alias("held")).where(F.size("held") > 1).distinct()
        left = combos.select("held", F.posexplode("held").alias("at", "a"))
        pairs = left.select("a", F.explode(F.slice("held", F.col("at") + 2, F.size("held"))).alias("b"))
        return {(ids[r["a"]], ids[r["b"]]) for r in pairs.distinct().collect()}

    def merge(self, ids: list[str], name: str = "") -> str:
        """Replace sibling intervals on one numeric column by their hull."""
        selected = self._selected(ids, 2)
        common = self._common_parents(selected)
        if not common:
            raise ValueError("the concepts must share a parent")
        column = self._shared_numeric_column(selected)
        if column is None:
            raise ValueError("the concepts must all restrict the same numeric column")
        hull = self._hull(selected, column)
        if not hull:
            raise ValueError("the concepts have no bound in common")
        c = self._add("merge", name, restrictions=hull, parent_ids=[common[0]], source_ids=list(ids))
        self._freeze(c)
        self[common[0]].child_ids.append(c.id)
        for i in ids:
            self.delete(i)
        return c.id

    def _shared_numeric_column(self, selected: list[Concept]) -> str | None:
        def numeric(c: Concept) -> set[str]:
            return {
                r.column
                for r in c.restrictions
                if r.column in self.meta and self.meta[r.column].user_type == "numeric"
            }

        shared = set.intersection(*[numeric(c) for c in selected])
        return min(shared, default=None)

    def _hull(self, selected: list[Concept], column: str) -> list[Restriction]:
        def bounds(c: Concept, operators: tuple[str, str]) -> list[float]:
            return [float(r.value) for r in c.restrictions if r.column == column and r.operator in operators]

        lower = [bounds(c, (">", ">=")) for c in selected]
        upper = [bounds(c, ("<", "<=")) for c in selected]
        hull = []
        if all(lower):
            hull.append(Restriction(column, ">=", min(v for vs in lower for v in vs)))
        if all(upper):
            hull.append(Restriction(column, "<", max(v for vs in upper for v in vs)))
        return hull

    def update(self, concept_id: str, restrictions: list[Restriction] | None = None, name: str | None = None) -> None:
        """Rename a concept or give it other restrictions."""
        c = self[concept_id]
        if name is not None:
            c.name = name
        if restrictions is not None:
            restrictions_to_column(restrictions, self.meta)
            c.restrictions = list(restrictions)
            if self.recompute == "snapshot":
                c.snapshot = self._from_parents(c)
                self._recompute_below(c)

    def _recompute_below(self, c: Concept) -> None:
        for i in c.child_ids:
            child = self[i]
            child.snapshot = self._from_parents(child)
            self._recompute_below(child)

    def delete(self, concept_id: str) -> None:
        """Remove a concept with all its descendants."""
        if concept_id == self.root_id:
            raise ValueError("the root cannot be deleted")
        if concept_id not in self.concepts:
            return
        doomed, stack = [], [concept_id]
        while stack:
            i = stack.pop()
            if i in self.concepts and i not in doomed:
                doomed.append(i)
                stack += self[i].child_ids
        gone = set(doomed)
        for c in self.concepts.values():
            # A concept that outlives one of its sources keeps its rows.
            if c.id not in gone and c.snapshot is None and gone & set(c.source_ids):
                c.snapshot = self._expanded(c.id, {})
        for i in doomed:
            del self.concepts[i]
        for c in self.concepts.values():
            c.child_ids = [i for i in c.child_ids if i not in gone]
            if c.origin != "root":
                c.parent_ids = [i for i in c.parent_ids if i not in gone]

    # -- rows -----------------------------------------------------------------

    def rows(self, concept_id: str) -> DataFrame:
        """The rows of one concept; its predicate reaches the scan.

        A definition that would expand to a very large predicate is evaluated
        flag by flag instead.
        """
        if concept_id == self.root_id:
            return self.df
        if _terms(self._expanded(concept_id, {}), {}) > LARGE_PREDICATE:
            flags = self.flags([concept_id], self.df.columns)
            return flags.where(F.col(f"is_{concept_id}")).drop(f"is_{concept_id}")
        return self.df.where(self.predicate(concept_id))

    def _levels(self, ids: list[str]) -> list[list[str]]:
        """The concepts ``ids`` depend on, layered so that each only uses earlier layers."""
        level: dict[str, int] = {}

        def place(i: str) -> int:
            if i not in level:
                c = self[i]
                if c.snapshot is not None:
                    level[i] = 0
                else:
                    uses = [s for s in c.source_ids if s in self.concepts]
                    if c.origin not in ("union", "intersection"):
                        uses += c.parent_ids[:1]
                    level[i] = 1 + max((place(u) for u in uses), default=-1)
            return level[i]

        for i in ids:
            place(i)
        layers: list[list[str]] = [[] for _ in range(max(level.values()) + 1)]
        for i, n in level.items():
            layers[n].append(i)
        return layers

    def flags(self, ids: list[str], keep: list[str] | None = None) -> DataFrame:
        """A boolean column ``is_<id>`` per concept, each computed once per row.

        Flags build on earlier flags rather than on nested predicates, so the
        expressions stay small however deep the DAG is.
        """
        out = self.df
        for layer in self._levels(ids):
            out = out.withColumns(
                {
                    f"is_{i}": _false_if_null(
                        self._column(self[i].snapshot or self._definition(self[i], lambda j: ("flag", j)))
                    )
                    for i in layer
                }
            )
        columns = [F.col(f"`{k}`") for k in (keep or [])]
        return out.select(*columns, *[F.col(f"is_{i}") for i in dict.fromkeys(ids)])

    def membership(self, ids: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
        """``(concept_id, …)`` for every concept a row belongs to: one scan, no shuffle."""
        ids = list(self.concepts) if ids is None else ids
        keep = [self.key] if keep is None else keep
        held = F.array_compact(F.array(*[F.when(F.col(f"is_{i}"), F.lit(i)) for i in ids]))
        return self.flags(ids, keep).select(
            F.explode(held).alias("concept_id"), *[F.col(f"`{k}`") for k in keep]
        )

    # -- totals ---------------------------------------------------------------

    def _totals(self, ids: list[str]) -> DataFrame:
        """``(seq, concept_id, size, covered)`` for every concept in one pass."""
        children = {i: [k for k in self[i].child_ids if k in self.concepts] for i in ids}
        needed = list(dict.fromkeys(ids + [k for i in ids for k in children[i]]))
        flags = self.flags(needed)

        def covered(i: str) -> Column:
            if not children[i]:
                return F.lit(False)
            return F.col(f"is_{i}") & reduce(op.or_, [F.col(f"is_{k}") for k in children[i]])

        if len(ids) <= WIDE_CONCEPTS:
            agg = []
            for i in ids:
                agg.append(F.count_if(F.col(f"is_{i}")).alias(f"n_{i}"))
                agg.append(F.count_if(covered(i)).alias(f"k_{i}"))
            rows = [
                F.struct(
                    F.lit(self[i].seq).alias("seq"),
                    F.lit(i).alias("concept_id"),
                    F.col(f"n_{i}").alias("size"),
                    F.col(f"k_{i}").alias("covered"),
                )
                for i in ids
            ]
            return flags.agg(*agg).select(F.inline(F.array(*rows)))
        held = F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(f"is_{i}"),
                        F.struct(F.lit(self[i].seq).alias("seq"), F.lit(i).alias("concept_id"), covered(i).alias("hit")),
                    )
                    for i in ids
                ]
            )
        )
        counted = (
            flags.select(F.inline(held))
            .groupBy("seq", "concept_id")
            .agg(F.count(F.lit(1)).alias("size"), F.count_if("hit").alias("covered"))
        )
        all_ids = local_frame(self.spark, [(self[i].seq, i) for i in ids], "seq int, concept_id string")
        return all_ids.join(counted, ["seq", "concept_id"], "left").na.fill(0, ["size", "covered"])

    def sizes(self, ids: list[str] | None = None) -> DataFrame:
        return self._totals(list(self.concepts) if ids is None else ids).select("concept_id", "size")

    def coverage(self, ids: list[str] | None = None) -> DataFrame:
        """Share of each concept's rows that its children hold, 4 decimals."""
        return self._totals(list(self.concepts) if ids is None else ids).select(
            "concept_id", _share().alias("coverage")
        )

    def nodes(self) -> DataFrame:
        """One row per concept with size and coverage."""
        ids = list(self.concepts)
        return self.concepts_df().join(
            self._totals(ids).select("concept_id", "size", _share().alias("coverage")),
            F.col("id") == F.col("concept_id"),
        ).drop("concept_id")

    def edges(self) -> DataFrame:
        rows = [
            (c.id, child, n)
            for c in self.concepts.values()
            for n, child in enumerate(c.child_ids)
        ]
        return local_frame(self.spark, rows, "parent_id string, child_id string, ord int")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return self.nodes(), self.edges()

    def concepts_df(self) -> DataFrame:
        rows = [
            (
                c.id,
                c.seq,
                c.name,
                c.origin,
                [{"column": r.column, "operator": r.operator, "value": str(r.value)} for r in c.restrictions],
                list(c.parent_ids),
                list(c.child_ids),
                list(c.source_ids),
                c.proposed,
                json.dumps(c.snapshot, default=str) if c.snapshot else None,
            )
            for c in self.concepts.values()
        ]
        return local_frame(
            self.spark,
            rows,
            "id string, seq int, name string, origin string, "
            "restrictions array<struct<column:string,operator:string,value:string>>, "
            "parent_ids array<string>, child_ids array<string>, source_ids array<string>, proposed boolean, snapshot string",
        )

    # -- persistence ----------------------------------------------------------

    def save(self, path: str) -> None:
        """Write concepts, edges, column types and the memberships by concept."""
        self.concepts_df().write.parquet(f"{path}/concepts")
        self.edges().write.parquet(f"{path}/edges")
        self.meta.to_df(self.spark).write.parquet(f"{path}/columns")
        self.membership().write.partitionBy("concept_id").parquet(f"{path}/membership")

    @classmethod
    def load(cls, df: DataFrame, path: str, key: str = ROW_ID, recompute: str = "derived") -> "Taxonomy":
        """Rebuild a saved taxonomy over ``df``; rows follow from the definitions."""
        spark = df.sparkSession
        columns = spark.read.parquet(f"{path}/columns").orderBy("ordinal").collect()
        meta = metadata_from_types(df, {r["column"]: (r["user_type"], r["include"]) for r in columns})
        for r in columns:
            meta[r["column"]].detected_type = r["detected_type"]
        tax = cls(df, meta, key, recompute)
        tax.concepts = {}
        for r in spark.read.parquet(f"{path}/concepts").orderBy("seq").collect():
            tax.concepts[r["id"]] = Concept(
                r["id"],
                r["seq"],
                r["name"],
                r["origin"],
                [Restriction(x["column"], x["operator"], x["value"]) for x in r["restrictions"]],
                list(r["parent_ids"]),
                list(r["child_ids"]),
                list(r["source_ids"]),
                r["proposed"],
                _row_set_from_json(r["snapshot"]),
            )
            tax._next = max(tax._next, r["seq"] + 1)
        for c in tax.concepts.values():
            if c.origin == "root":
                tax.root_id = c.id
        return tax


def _share() -> Column:
    return F.when(
        F.col("size") > 0, F.round(F.col("covered") / F.col("size"), 4)
    ).otherwise(F.lit(0.0))
