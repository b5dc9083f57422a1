"""Structural statistics of taxonomies given as triples.

Every function takes the triples of one ontology, or of many with a column ``file`` that says which
one a triple is of. Then classes, edges and counts are kept apart by that column, and one batch of
jobs serves all ontologies.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.names import OWL, RDF_TYPE, RDFS
from ..plans.local import local_frame
from ..plans.scratch import Parts, Settled, settle
from ..sources.readers import malformed_lines, read_ntriples
from ..sources.writers import STATS_COLUMNS

logger = logging.getLogger(__name__)

THING = OWL + "Thing"
SUBCLASS = RDFS + "subClassOf"


# Rows that a task makes distinct or counts at once.
TASK_ROWS = 500_000


class BadOntology(ValueError):
    """An ontology that cannot be read, or whose subclass relation has a cycle."""


def _is_named(c: str):
    return ~F.col(c).startswith("_:")


def _by(df: DataFrame) -> list[str]:
    return ["file"] if "file" in df.columns else []


def _dealt(df: DataFrame, triples: DataFrame, *key: str) -> DataFrame:
    """``df``, made of rows of ``triples``, by ``key`` in as many tasks as the triples need."""
    return df.repartition(_tasks(triples), *_by(df), *key)


def _tasks(triples: DataFrame) -> int:
    usual = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-triples.count() // TASK_ROWS))


def _types(triples: DataFrame) -> DataFrame:
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "uri")).select(*_by(triples), "s", "o")


def structure(triples: DataFrame) -> DataFrame:
    """The triples the statistics look at, written once.

    The input is read a single time; every metric then scans this table with
    its filters pushed to the files.
    """
    wanted = F.col("p").isin(RDF_TYPE, SUBCLASS, OWL + "equivalentClass")
    return settle(triples.where(wanted), "structure")


def named_classes(triples: DataFrame) -> DataFrame:
    """Named classes, declared or implied by ``subClassOf``, without Thing."""
    by = _by(triples)
    declared = _types(triples).where(F.col("o") == OWL + "Class").select(*by, F.col("s").alias("class"))
    implied = triples.where(F.col("p") == SUBCLASS)
    sides = implied.select(*by, F.col("s").alias("class")).unionByName(
        implied.where(F.col("o_kind") == "uri").select(*by, F.col("o").alias("class"))
    )
    return declared.unionByName(sides).where(_is_named("class") & (F.col("class") != THING)).distinct()


def subclass_edges(triples: DataFrame) -> DataFrame:
    """``(parent, child)`` between named classes; Thing is left out."""
    return (
        triples.where((F.col("p") == SUBCLASS) & (F.col("o_kind") == "uri") & _is_named("s"))
        .where((F.col("s") != THING) & (F.col("o") != THING))
        .select(*_by(triples), F.col("o").alias("parent"), F.col("s").alias("child"))
        .distinct()
    )


def class_instances(triples: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct ``(individual, class)`` pairs."""
    by = _by(triples)
    pairs = (
        _types(triples)
        .where(_is_named("s"))
        .join(classes.select(*by, F.col("class").alias("o")), [*by, "o"], "left_semi")
        .select(*by, F.col("s").alias("individual"), F.col("o").alias("class"))
    )
    return _dealt(pairs, triples, "individual", "class").distinct()


def individuals(triples: DataFrame, classes: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """Named individuals, declared or typed by a named class."""
    by = _by(triples)
    declared = _types(triples).where((F.col("o") == OWL + "NamedIndividual") & _is_named("s"))
    typed = class_instances(triples, classes) if instances is None else instances
    every = declared.select(*by, F.col("s").alias("individual")).unionByName(typed.select(*by, "individual"))
    return _dealt(every, triples, "individual").distinct()


def _without(classes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    by = _by(classes)
    return classes.join(edges.select(*by, F.col(end).alias("class")), [*by, "class"], "left_anti")


def roots(classes: DataFrame, edges: DataFrame) -> DataFrame:
    return _without(classes, edges, "child")


def leaf_classes(classes: DataFrame, edges: DataFrame) -> DataFrame:
    return _without(classes, edges, "parent")


def multi_parent(edges: DataFrame) -> DataFrame:
    return (
        edges.groupBy(*_by(edges), F.col("child").alias("class"))
        .agg(F.count(F.lit(1)).alias("n_parents"))
        .where(F.col("n_parents") > 1)
    )


def class_depths(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest path from any root to each class.

    A class is done in the round after the last of its parents, so the round is its depth. A round joins
    the classes that have just been done with their children, of all ontologies at once; an ontology ends
    when none of its classes is left. Classes that are never done lie on or below a cycle, which raises.
    """
    found, stuck = _depths(classes, settle(edges, "edges"))
    if not stuck.isEmpty():
        raise BadOntology("the subclass relation has a cycle")
    return found


def _depths(classes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(class, depth)`` of the classes that are done, and the classes that never are."""
    by, done, k = _by(classes), Parts(classes.sparkSession, "done"), 0
    key = [*by, "class"]
    front = done.add(roots(classes, edges).withColumn("depth", F.lit(0)))
    # Parents that each class still waits for.
    waiting = Settled(edges.groupBy(*by, F.col("child").alias("class")).agg(F.count(F.lit(1)).alias("left")), "waiting")
    while not front.isEmpty():
        k += 1
        met = (
            front.select(*by, F.col("class").alias("parent")).join(edges, [*by, "parent"])
            .groupBy(*by, F.col("child").alias("class")).agg(F.count(F.lit(1)).alias("met"))
        )
        after = Settled(
            waiting.df.join(met, key, "left").select(*key, (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")), "waiting"
        )
        front = done.add(after.df.where("left = 0").select(*key, F.lit(k).alias("depth")))
        waiting.drop()
        waiting = Settled(after.df.where("left > 0"), "waiting")
        after.drop()
    return done.all(), waiting.df


def instance_counts(triples: DataFrame, classes: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """``(class, n)`` for every class, zeros included."""
    key = [*_by(classes), "class"]
    instances = class_instances(triples, classes) if instances is None else instances
    held = instances.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(held, key, "left").na.fill(0, ["n"])


def branching(edges: DataFrame) -> DataFrame:
    """``(class, n_children)`` of the classes with children."""
    return edges.groupBy(*_by(edges), F.col("parent").alias("class")).agg(F.count(F.lit(1)).alias("n_children"))


def coverage(
    triples: DataFrame, classes: DataFrame, edges: DataFrame, instances: DataFrame | None = None
) -> DataFrame:
    """Number of individuals, and the share typed by a class that is not a root."""
    by = _by(classes)
    instances = class_instances(triples, classes) if instances is None else instances
    top = settle(roots(classes, edges), "roots")
    held = instances.join(top, [*by, "class"], "left_anti").select(*by, "individual", F.lit(1).alias("hit"))
    total = individuals(triples, classes, instances).select(*by, "individual", F.lit(0).alias("hit"))
    per = _dealt(held.unionByName(total), triples, "individual").groupBy(*by, "individual").agg(F.max("hit").alias("hit"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_individuals"),
        F.coalesce(F.round(F.sum("hit") / F.count(F.lit(1)), 4), F.lit(0.0)).alias("coverage"),
    )


def axiom_counts(triples: DataFrame, classes: DataFrame) -> DataFrame:
    """Restrictions, equivalence axioms and properties, from distinct triples."""
    by = _by(classes)
    kinds = (
        _types(triples)
        .where(F.col("o").isin(OWL + "Restriction", OWL + "ObjectProperty", OWL + "DatatypeProperty"))
        .distinct()
    )
    equivalent = (
        triples.where((F.col("p") == OWL + "equivalentClass") & _is_named("s"))
        .join(classes.select(*by, F.col("class").alias("s")), [*by, "s"], "left_semi")
        .select(*by, "s", "o")
        .distinct()
        .select(*by, "s", F.lit(OWL + "equivalentClass").alias("o"))
    )
    o, blank = F.col("o"), ~_is_named("s")
    return kinds.unionByName(equivalent).groupBy(*by).agg(
        F.count_if(o == OWL + "ObjectProperty").alias("n_object_properties"),
        F.count_if(o == OWL + "DatatypeProperty").alias("n_datatype_properties"),
        F.count_if((o == OWL + "Restriction") & blank).alias("n_restrictions"),
        F.count_if(o == OWL + "equivalentClass").alias("n_equiv_class"),
    )


def _spread(df: DataFrame, column: str, mean: str, std: str) -> DataFrame:
    return df.groupBy("file").agg(
        F.coalesce(F.round(F.avg(column), 3), F.lit(0.0)).alias(mean),
        F.coalesce(F.round(F.stddev_samp(column), 3), F.lit(0.0)).alias(std),
    )


def _median(df: DataFrame, column: str, name: str) -> DataFrame:
    """The median of a whole number per ontology, from the number of rows of each distinct value.

    D distinct counts of instances take at least D² / 2 instances, so one ontology has few of them.
    """
    upto = Window.partitionBy("file").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file")
    ranked = (
        df.groupBy("file", column).agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("upto", F.sum("rows").over(upto)).withColumn("all", F.sum("rows").over(whole))
    )
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col(column)))

    return ranked.groupBy("file").agg(F.round((at(low) + at(high)) / 2, 3).alias(name))


def _long(part: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in part.columns if c != "file"]
    return part.select("file", F.inline(F.array(*cells)))


def _batch(triples: DataFrame, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row of statistics for each of ``files``, and the files with a cycle."""
    spark = triples.sparkSession
    triples = structure(triples)
    classes = settle(named_classes(triples), "classes")
    edges = settle(subclass_edges(triples), "edges")
    instances = settle(class_instances(triples, classes), "instances")
    counts = settle(instance_counts(triples, classes, instances), "counts")
    depths, stuck = _depths(classes, edges)
    leaf = counts.join(leaf_classes(classes, edges), ["file", "class"], "left_semi")
    parts = [
        depths.groupBy("file").agg(
            F.count(F.lit(1)).alias("n_classes"),
            F.coalesce(F.max("depth") + 1, F.lit(0)).cast("long").alias("n_levels"),
        ),
        _spread(depths, "depth", "avg_depth", "std_depth"),
        roots(classes, edges).groupBy("file").agg(F.count(F.lit(1)).alias("n_roots")),
        leaf.groupBy("file").agg(F.count(F.lit(1)).alias("n_leaves")),
        multi_parent(edges).groupBy("file").agg(F.count(F.lit(1)).alias("n_multi_parent")),
        _spread(branching(edges), "n_children", "avg_branching", "std_branching"),
        _spread(counts, "n", "avg_inst", "std_inst"),
        _median(counts, "n", "med_inst"),
        counts.groupBy("file").agg(F.count_if(F.col("n") == 0).alias("n_empty_classes")),
        _spread(leaf, "n", "avg_leaf_inst", "std_leaf_inst"),
        _median(leaf, "n", "med_leaf_inst"),
        coverage(triples, classes, edges, instances),
        axiom_counts(triples, classes),
    ]
    metrics = reduce(DataFrame.unionByName, [_long(p) for p in parts])
    cells = [
        F.coalesce(F.max(F.when(F.col("metric") == c, F.col("x"))), F.lit(0.0)).cast("long" if c.startswith("n_") else "double").alias(c)
        for c in STATS_COLUMNS[1:]
    ]
    # An ontology without classes has a row of zeros.
    every = local_frame(spark, [(f,) for f in files], "file string")
    cyclic = stuck.select("file").distinct()
    rows = every.join(cyclic, "file", "left_anti").join(metrics, "file", "left").groupBy("file").agg(*cells)
    return settle(rows, "statistics"), cyclic


def taxonomy_stats(triples: DataFrame, file: str) -> DataFrame:
    """One row of statistics; each metric is one aggregate over its own small table."""
    rows, cyclic = _batch(triples.withColumn("file", F.lit(file)), [file])
    if not cyclic.isEmpty():
        raise BadOntology(f"{file}: the subclass relation has a cycle")
    return rows


Source = str | DataFrame | Callable[[], DataFrame]


def stats_of_many(spark: SparkSession, sources: dict[str, Source]) -> DataFrame:
    """One row per ontology, all from one batch of jobs; an ontology that is no good is skipped.

    A source is the path of an N-Triples file or folder, a triples DataFrame, or a function that returns one
    and raises ``BadOntology`` (or another ``ValueError``) where it cannot. Bad sources are found before the
    batch: all paths are checked for malformed lines in one job. Failures inside the batch are raised, but for
    cycles, which only take their own ontology out.
    """
    good: dict[str, DataFrame] = {}
    paths = {file: source for file, source in sources.items() if isinstance(source, str)}
    bad = malformed_lines(spark, paths)
    for file, source in sources.items():
        try:
            if file in bad:
                raise BadOntology(bad[file])
            good[file] = read_ntriples(spark, source) if isinstance(source, str) else source() if callable(source) else source
        except (ValueError, AnalysisException) as problem:
            logger.warning("skipping %s: %s", file, problem)
    if not good:
        raise BadOntology("no ontology could be read")
    tagged = [t.select("s", "p", "o", "o_kind").withColumn("file", F.lit(file)) for file, t in good.items()]
    rows, cyclic = _batch(reduce(DataFrame.unionByName, tagged), list(good))
    for r in cyclic.collect():
        logger.warning("skipping %s: the subclass relation has a cycle", r["file"])
    if rows.isEmpty():
        raise BadOntology("no ontology could be read")
    return rows
