"""OWL export of taxonomies as a DataFrame of triples.

Schema triples (properties, classes, axioms) come from metadata; the triples of
values and rows are projections of the table. ``s`` and blank objects of the
form ``_:name`` are blank nodes with deterministic names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import parsing
from ..functions.names import (
    OWL,
    RDF,
    RDF_TYPE,
    RDFS,
    XSD,
    decimal_text,
    decimal_text_of,
    namespace,
    safe_name,
    safe_name_text,
)
from ..metadata import ColumnMeta, Metadata
from ..plans.local import local_frame
from .fca import Lattice, hasse, intents, most_specific, number_concepts
from .predicate import Restriction
from .profile import value_counts
from .taxonomy import Concept, Taxonomy

TRIPLE = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
RANGES = {"numeric": XSD + "decimal", "date": XSD + "date", "title_id": XSD + "string"}
FACETS = {
    ">=": [XSD + "minInclusive"],
    ">": [XSD + "minExclusive"],
    "<=": [XSD + "maxInclusive"],
    "<": [XSD + "maxExclusive"],
    "=": [XSD + "minInclusive", XSD + "maxInclusive"],
}


def _uri(s: str, p: str, o: str) -> tuple:
    return (s, p, o, "blank" if o.startswith("_:") else "uri", None, None)


def _text(s: str, p: str, o: str, datatype: str | None = None) -> tuple:
    return (s, p, o, "literal", datatype, None)


def _frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return local_frame(spark, rows, TRIPLE)


# -- columns ------------------------------------------------------------------


def property_uri(cns: str, column: str) -> str:
    return cns + safe_name_text(column)


def value_uri(cns: str, column: str, value: Column) -> Column:
    return F.concat(F.lit(f"{cns}{safe_name_text(column)}_"), safe_name(value))


def property_triples(spark: SparkSession, meta: Metadata, cns: str) -> DataFrame:
    """One property per column, included or not."""
    rows = []
    for m in meta:
        uri = property_uri(cns, m.name)
        if m.user_type == "categorical":
            rows.append(_uri(uri, RDF_TYPE, OWL + "ObjectProperty"))
        else:
            rows.append(_uri(uri, RDF_TYPE, OWL + "DatatypeProperty"))
            rows.append(_uri(uri, RDFS + "range", RANGES[m.user_type]))
    return _frame(spark, rows)


def _categories(df: DataFrame, meta: Metadata, cns: str) -> DataFrame | None:
    """Distinct ``(column, value, uri)`` of the categorical columns.

    Names are formed after the distinct, so their cost does not grow with rows.
    """
    texts = [m for m in meta if m.user_type == "categorical"]
    if not texts:
        return None
    uri = F.lit(None).cast("string")
    for m in texts:
        uri = F.when(F.col("column") == m.name, value_uri(cns, m.name, F.col("value"))).otherwise(uri)
    return value_counts(df, texts).select("column", "value", uri.alias("uri"))


def value_triples(df: DataFrame, meta: Metadata, cns: str) -> DataFrame | None:
    """One individual per distinct value of a categorical column, with its label."""
    values = _categories(df, meta, cns)
    if values is None:
        return None
    label = _column_triple(F.col("uri"), RDFS + "label", F.col("value"), "literal")
    kind = _column_triple(F.col("uri"), RDF_TYPE, F.lit(OWL + "NamedIndividual"), "uri")
    return values.select(F.inline(F.array(kind, label))).distinct()


def uri_collisions(df: DataFrame, meta: Metadata, cns: str) -> DataFrame:
    """URIs that stand for more than one value."""
    values = _categories(df, meta, cns)
    if values is None:
        raise ValueError("no categorical columns")
    return values.groupBy("uri").agg(F.count(F.lit(1)).alias("n_values")).where(F.col("n_values") > 1)


def _column_triple(s: Column, p: str, o: Column, kind: str, datatype: str | None = None) -> Column:
    return F.struct(
        s.alias("s"),
        F.lit(p).alias("p"),
        o.alias("o"),
        F.lit(kind).alias("o_kind"),
        F.lit(datatype).cast("string").alias("o_datatype"),
        F.lit(None).cast("string").alias("o_lang"),
    )


# -- rows ---------------------------------------------------------------------


def literal_text(m: ColumnMeta) -> Column:
    """Text of a cell as a literal; NULL when missing or not of the column's type."""
    if m.user_type == "numeric":
        return decimal_text(m.number)
    if m.user_type == "date":
        return F.date_format(m.time, "yyyy-MM-dd")
    return m.text


def entity(ens: str, key: Column) -> Column:
    """IRI of a row; characters of its key that an IRI cannot hold are percent-encoded."""
    return F.concat(F.lit(ens + "entity_"), F.replace(F.url_encode(key.cast("string")), F.lit("+"), F.lit("%20")))


def row_triples(
    df: DataFrame,
    meta: Metadata,
    cns: str,
    ens: str,
    key: str,
    classes: list[tuple[Column, str]] | None = None,
    values: bool = True,
) -> DataFrame:
    """The individual of each row with its property values: no shuffle.

    ``classes`` lists (condition, class URI) pairs that type the row.
    ``values=False`` leaves the property values out.
    """
    classes, columns = classes or [], list(meta) if values else []
    # Each text is computed once per row, before the row becomes triples.
    texts = [entity(ens, F.col(f"`{key}`")).alias("_s")]
    texts += [hit.alias(f"_is{i}") for i, (hit, _) in enumerate(classes)]
    for i, m in enumerate(columns):
        text = value_uri(cns, m.name, m.text) if m.user_type == "categorical" else literal_text(m)
        texts.append(text.alias(f"_o{i}"))
    s = F.col("_s")
    cells = [_column_triple(s, RDF_TYPE, F.lit(OWL + "NamedIndividual"), "uri")]
    for i, (_, uri) in enumerate(classes):
        cells.append(F.when(F.col(f"_is{i}"), _column_triple(s, RDF_TYPE, F.lit(uri), "uri")))
    for i, m in enumerate(columns):
        kind, datatype = ("uri", None) if m.user_type == "categorical" else ("literal", RANGES[m.user_type])
        cells.append(_column_triple(s, property_uri(cns, m.name), F.col(f"_o{i}"), kind, datatype))
    triples = F.array(*cells)
    names = [property_uri(cns, m.name) for m in columns] + [uri for _, uri in classes]
    if len(set(names)) < len(names):
        # Columns or concepts share a name; equal triples of a row count once.
        triples = F.array_distinct(triples)
    return df.select(*texts).select(F.inline(triples)).where(F.col("o").isNotNull())


def type_triples(membership: DataFrame, ens: str, key: str) -> DataFrame:
    """``rdf:type`` triples from ``(key, class uri as o)`` rows."""
    return membership.select(
        entity(ens, F.col(f"`{key}`")).alias("s"),
        F.lit(RDF_TYPE).alias("p"),
        F.col("o"),
        F.lit("uri").alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"),
        F.lit(None).cast("string").alias("o_lang"),
    )


# -- concepts -----------------------------------------------------------------


def name_map(tax: Taxonomy) -> dict[str, str]:
    """Given names, else ``Root``, else c01, c02, … in order of creation."""
    names, unnamed = {}, 0
    for c in tax.concepts.values():
        if c.name:
            names[c.id] = c.name
        elif c.origin == "root":
            names[c.id] = "Root"
        else:
            unnamed += 1
            names[c.id] = f"c{unnamed:02d}"
    return names


class _Axioms:
    """Equivalent-class axioms of driver-side concepts."""

    def __init__(self, tax: Taxonomy, cns: str, classes: dict[str, str], known: set[tuple[str, str]]):
        self.tax, self.cns, self.classes, self.known = tax, cns, classes, known
        self.rows: list[tuple] = []

    def _blank(self, c: Concept) -> str:
        self._used += 1
        return f"_:{c.id}_{self._used}"

    def _list(self, c: Concept, members: list[str]) -> str:
        nodes = [self._blank(c) for _ in members]
        for i, (node, member) in enumerate(zip(nodes, members)):
            self.rows.append(_uri(node, RDF + "first", member))
            self.rows.append(_uri(node, RDF + "rest", nodes[i + 1] if i + 1 < len(nodes) else RDF + "nil"))
        return nodes[0]

    def _class(self, c: Concept, p: str, o: str) -> str:
        node = self._blank(c)
        self.rows += [_uri(node, RDF_TYPE, OWL + "Class"), _uri(node, p, o)]
        return node

    def add(self, c: Concept) -> None:
        self._used = 0
        sources = [self.classes[i] for i in c.source_ids if i in self.classes]
        parents = [self.classes[i] for i in c.parent_ids if i in self.classes]
        node = None
        if c.origin in ("restriction", "wsom", "merge"):
            restrictions = self._restrictions(c)
            if parents and restrictions:
                node = self._class(c, OWL + "intersectionOf", self._list(c, [parents[0], *restrictions]))
        elif c.origin == "complement":
            if parents and sources:
                inner = sources[0]
                if len(sources) > 1:
                    inner = self._class(c, OWL + "unionOf", self._list(c, sources))
                outside = self._class(c, OWL + "complementOf", inner)
                node = self._class(c, OWL + "intersectionOf", self._list(c, [parents[0], outside]))
        elif c.origin in ("union", "intersection") and len(sources) > 1:
            p = OWL + ("unionOf" if c.origin == "union" else "intersectionOf")
            node = self._class(c, p, self._list(c, sources))
        if node:
            self.rows.append(_uri(self.classes[c.id], OWL + "equivalentClass", node))

    def _restriction(self, c: Concept, column: str, p: str, o: str) -> str:
        node = self._blank(c)
        self.rows += [
            _uri(node, RDF_TYPE, OWL + "Restriction"),
            _uri(node, OWL + "onProperty", property_uri(self.cns, column)),
            _uri(node, p, o),
        ]
        return node

    def _restrictions(self, c: Concept) -> list[str]:
        """One value restriction per category, one datatype restriction per ordered column."""
        by_column: dict[str, list[Restriction]] = {}
        for r in c.restrictions:
            by_column.setdefault(r.column, []).append(r)
        out = []
        for column, rs in by_column.items():
            kind = self.tax.meta[column].user_type
            if kind == "categorical":
                for r in rs:
                    if (column, str(r.value)) in self.known:
                        uri = f"{self.cns}{safe_name_text(column)}_{safe_name_text(str(r.value))}"
                        out.append(self._restriction(c, column, OWL + "hasValue", uri))
            elif kind in ("numeric", "date"):
                facets = []
                for r in rs:
                    text = decimal_text_of(float(r.value)) if kind == "numeric" else str(r.value)
                    for facet in FACETS.get(r.operator, []):
                        node = self._blank(c)
                        self.rows.append(_text(node, facet, text, RANGES[kind]))
                        facets.append(node)
                if facets:
                    kind_node = self._blank(c)
                    self.rows += [
                        _uri(kind_node, RDF_TYPE, RDFS + "Datatype"),
                        _uri(kind_node, OWL + "onDatatype", RANGES[kind]),
                        _uri(kind_node, OWL + "withRestrictions", self._list(c, facets)),
                    ]
                    out.append(self._restriction(c, column, OWL + "someValuesFrom", kind_node))
        return out


def _values_in_data(tax: Taxonomy) -> set[tuple[str, str]]:
    """Which restricted categories occur at all, from one aggregate."""
    wanted = sorted(
        {
            (r.column, str(r.value))
            for c in tax.concepts.values()
            for r in c.restrictions
            if tax.meta[r.column].user_type == "categorical"
        }
    )
    if not wanted:
        return set()
    got = tax.df.agg(
        *[F.max(tax.meta[c].text == F.lit(v)).alias(f"x{i}") for i, (c, v) in enumerate(wanted)]
    ).first()
    return {w for i, w in enumerate(wanted) if got[f"x{i}"]}


def class_uris(tax: Taxonomy, cns: str) -> dict[str, str]:
    return {i: cns + safe_name_text(n) for i, n in name_map(tax).items()}


def class_triples(tax: Taxonomy, cns: str) -> DataFrame:
    """Classes, their labels and their parents."""
    classes, rows = class_uris(tax, cns), []
    for c in tax.concepts.values():
        uri = classes[c.id]
        rows.append(_uri(uri, RDF_TYPE, OWL + "Class"))
        if c.name:
            rows.append(_text(uri, RDFS + "label", c.name))
        rows += [_uri(uri, RDFS + "subClassOf", classes[p]) for p in c.parent_ids if p in classes]
        if c.origin == "root":
            rows.append(_uri(uri, RDFS + "subClassOf", OWL + "Thing"))
    return _frame(tax.spark, list(dict.fromkeys(rows)))


def axiom_triples(tax: Taxonomy, cns: str) -> DataFrame:
    """What each class is equivalent to, by the way it was made."""
    axioms = _Axioms(tax, cns, class_uris(tax, cns), _values_in_data(tax))
    for c in tax.concepts.values():
        axioms.add(c)
    return _frame(tax.spark, axioms.rows)


def _union(parts: list[DataFrame | None]) -> DataFrame:
    parts = [p for p in parts if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _held_classes(tax: Taxonomy, cns: str, typing: str) -> list[tuple[Column, str]]:
    """(condition on the concept flags, class URI) of each way a row is typed.

    ``all`` gives every concept of the row, ``most_specific`` those without a
    child that also holds it, ``leaf`` those without children.
    """
    if typing not in ("all", "most_specific", "leaf"):
        raise ValueError("typing must be 'all', 'most_specific' or 'leaf'")
    classes, out = class_uris(tax, cns), []
    for c in tax.concepts.values():
        children = [k for k in c.child_ids if k in tax.concepts]
        if typing == "leaf" and children:
            continue
        hit = F.col(f"is_{c.id}")
        if typing == "most_specific":
            for k in children:
                hit = hit & ~F.col(f"is_{k}")
        out.append((hit, classes[c.id]))
    return out


def concept_types(tax: Taxonomy, cns: str, typing: str = "all") -> DataFrame:
    """``(key, o)``: the classes of each row, in one scan without a shuffle."""
    flags = tax.flags(list(tax.concepts), [tax.key])
    held = F.array_compact(F.array(*[F.when(hit, F.lit(uri)) for hit, uri in _held_classes(tax, cns, typing)]))
    return flags.select(F.col(f"`{tax.key}`"), F.explode(F.array_distinct(held)).alias("o"))


def export_triples(
    tax: Taxonomy, concept_ns: str, entity_ns: str, typing: str = "all", values: bool = True
) -> DataFrame:
    """The whole taxonomy with its table as triples.

    ``values=False`` leaves out the property values of the rows, which the
    statistics do not look at.
    """
    cns, ens = namespace(concept_ns, "#"), namespace(entity_ns, "/")
    flags = tax.flags(list(tax.concepts), list(dict.fromkeys([tax.key, *tax.meta.columns])))
    return _union(
        [
            property_triples(tax.spark, tax.meta, cns),
            class_triples(tax, cns),
            axiom_triples(tax, cns),
            value_triples(tax.df, tax.meta, cns),
            row_triples(flags, tax.meta, cns, ens, tax.key, _held_classes(tax, cns, typing), values),
        ]
    )


# -- concepts that are tables -------------------------------------------------


def _class_table(concepts: DataFrame, cns: str) -> DataFrame:
    """Class and label triples from ``(uri, name)`` rows."""
    return concepts.select(
        F.inline(
            F.array(
                _column_triple(F.col("uri"), RDF_TYPE, F.lit(OWL + "Class"), "uri"),
                _column_triple(F.col("uri"), RDFS + "label", F.col("name"), "literal"),
            )
        )
    )


def _subclass_table(pairs: DataFrame) -> DataFrame:
    """``subClassOf`` triples from ``(uri, parent)`` rows; no parent means Thing."""
    parent = F.coalesce("parent", F.lit(OWL + "Thing"))
    return pairs.select(F.inline(F.array(_column_triple(F.col("uri"), RDFS + "subClassOf", parent, "uri"))))


def intent_axioms(named: DataFrame, lattice: Lattice, meta: Metadata, cns: str) -> DataFrame:
    """Axioms of formal concepts: one restriction, or an intersection of several."""
    spark = named.sparkSession
    columns = local_frame(
        spark,
        [(m.name, property_uri(cns, m.name), f"{cns}{safe_name_text(m.name)}_") for m in meta],
        "column string, prop string, stem string",
    )
    sized = named.select("intent", "id", "uri", F.size(F.filter("intent", lambda c: c >= 0)).alias("m"))
    order = F.size(F.filter(F.slice("intent", F.lit(1), F.col("j")), lambda c: c >= 0))
    parts = (
        intents(named.select("intent"), lattice.context)
        .join(sized, "intent")
        .join(columns, "column")
        .withColumn("i", order)
    )

    def blank(kind: str, i: Column | None = None) -> Column:
        pieces = [F.lit("_:"), F.col("id"), F.lit("_" + kind)]
        return F.concat(*pieces, *([i.cast("string")] if i is not None else []))

    i, m = F.col("i"), F.col("m")
    r = blank("r", i)
    whole = F.when(m > 1, blank("x")).otherwise(r)
    category = F.col("kind") == "categorical"
    datatype = F.when(F.col("kind") == "date", F.lit(XSD + "date")).otherwise(F.lit(XSD + "decimal"))

    def day(x: Column) -> Column:
        return F.date_format(parsing.micros_to_time(F.floor(x) * 1_000_000), "yyyy-MM-dd")

    def bound(x: Column) -> Column:
        return F.when(F.col("kind") == "date", day(x)).otherwise(decimal_text(x))

    def triple(when: Column, s: Column, p, o: Column, kind: str, dt: Column | None = None) -> Column:
        return F.when(
            when,
            F.struct(
                s.alias("s"),
                (p if isinstance(p, Column) else F.lit(p)).alias("p"),
                o.alias("o"),
                F.lit(kind).alias("o_kind"),
                (dt if dt is not None else F.lit(None).cast("string")).alias("o_datatype"),
                F.lit(None).cast("string").alias("o_lang"),
            ),
        )

    first, several, ranged, always = i == 0, m > 1, ~category, F.lit(True)
    upper = F.when(F.col("hi_incl"), F.lit(XSD + "maxInclusive")).otherwise(F.lit(XSD + "maxExclusive"))
    is_last = i == m - 1
    cells = [
        triple(first, F.col("uri"), OWL + "equivalentClass", whole, "blank"),
        triple(first & several, whole, RDF_TYPE, F.lit(OWL + "Class"), "uri"),
        triple(first & several, whole, OWL + "intersectionOf", blank("l", i), "blank"),
        triple(several, blank("l", i), RDF + "first", r, "blank"),
        triple(several & ~is_last, blank("l", i), RDF + "rest", blank("l", i + 1), "blank"),
        triple(several & is_last, blank("l", i), RDF + "rest", F.lit(RDF + "nil"), "uri"),
        triple(always, r, RDF_TYPE, F.lit(OWL + "Restriction"), "uri"),
        triple(always, r, OWL + "onProperty", F.col("prop"), "uri"),
        triple(category, r, OWL + "hasValue", F.concat("stem", safe_name(F.col("value"))), "uri"),
        triple(ranged, r, OWL + "someValuesFrom", blank("d", i), "blank"),
        triple(ranged, blank("d", i), RDF_TYPE, F.lit(RDFS + "Datatype"), "uri"),
        triple(ranged, blank("d", i), OWL + "onDatatype", datatype, "uri"),
        triple(ranged, blank("d", i), OWL + "withRestrictions", blank("f", i), "blank"),
        triple(ranged, blank("f", i), RDF + "first", blank("lo", i), "blank"),
        triple(ranged, blank("f", i), RDF + "rest", blank("g", i), "blank"),
        triple(ranged, blank("g", i), RDF + "first", blank("hi", i), "blank"),
        triple(ranged, blank("g", i), RDF + "rest", F.lit(RDF + "nil"), "uri"),
        triple(ranged, blank("lo", i), XSD + "minInclusive", bound(F.col("lo")), "literal", datatype),
        triple(ranged, blank("hi", i), upper, bound(F.col("hi")), "literal", datatype),
    ]
    return parts.select(F.inline(F.array_compact(F.array(*cells))))


def export_lattice(lattice: Lattice, df: DataFrame, meta: Metadata, concept_ns: str, entity_ns: str) -> DataFrame:
    """A formal-concept lattice with its table; rows have their most specific concepts."""
    cns, ens = namespace(concept_ns, "#"), namespace(entity_ns, "/")
    key, spark = lattice.context.key, df.sparkSession
    named = number_concepts(lattice)
    named = named.withColumn("name", F.when(F.col("seq") == 0, F.lit("Root")).otherwise(F.col("id")))
    named = named.withColumn("uri", F.concat(F.lit(cns), safe_name(F.col("name"))))
    uris = named.select("intent", "uri")
    up = uris.select(F.col("intent").alias("parent_intent"), F.col("uri").alias("parent"))
    pairs = hasse(lattice).select(F.col("parent").alias("parent_intent"), F.col("child").alias("intent"))
    parents = uris.join(pairs.join(up, "parent_intent"), "intent", "left").select("uri", "parent")
    types = most_specific(lattice).join(uris.withColumnRenamed("uri", "o"), "intent").select(key, "o")
    return _union(
        [
            property_triples(spark, meta, cns),
            value_triples(df, meta, cns),
            _class_table(named, cns),
            _subclass_table(parents),
            intent_axioms(named, lattice, meta, cns),
            type_triples(types, ens, key),
            row_triples(df, meta, cns, ens, key),
        ]
    )


def export_tree(
    concepts: DataFrame, membership: DataFrame, df: DataFrame, meta: Metadata, concept_ns: str, entity_ns: str, key: str
) -> DataFrame:
    """A cluster tree with its table; rows have the leaf that holds them."""
    cns, ens = namespace(concept_ns, "#"), namespace(entity_ns, "/")
    named = concepts.withColumn("uri", F.concat(F.lit(cns), safe_name(F.col("name"))))
    up = named.select(F.col("id").alias("parent_id"), F.col("uri").alias("parent"))
    types = membership.join(named.select(F.col("id").alias("concept_id"), F.col("uri").alias("o")), "concept_id")
    return _union(
        [
            property_triples(df.sparkSession, meta, cns),
            value_triples(df, meta, cns),
            _class_table(named, cns),
            _subclass_table(named.join(up, "parent_id", "left").select("uri", "parent")),
            type_triples(types.select(key, "o"), ens, key),
            row_triples(df, meta, cns, ens, key),
        ]
    )
