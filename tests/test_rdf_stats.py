"""Export and statistics: our own export gives the published iris figures."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from taxoloom.functions.names import OWL, RDF_TYPE, decimal_text, decimal_text_of, safe_name, safe_name_text
from taxoloom.metadata import metadata_from_types
from taxoloom.operators import fca, hac, rdf, stats
from taxoloom.operators.encode import encode
from taxoloom.operators.predicate import Restriction as R
from taxoloom.operators.taxonomy import Taxonomy
from taxoloom.sources import read_ntriples, write_ntriples, write_stats, write_turtle

from test_fca import IRIS
from test_taxonomy import iris_taxonomy, small

NS = ("http://example.org/iris/schema", "http://example.org/iris/data")
CNS = NS[0] + "#"

# Published statistics of the three builders on iris.
INTERACTIVE = dict(
    n_classes=13, n_individuals=153, n_object_properties=1, n_datatype_properties=5, n_restrictions=9,
    n_equiv_class=12, n_levels=4, n_roots=1, n_leaves=6, n_multi_parent=4, avg_depth=1.538, std_depth=0.877,
    avg_branching=2.286, std_branching=2.563, avg_inst=54.0, med_inst=50.0, std_inst=40.191,
    avg_leaf_inst=28.333, med_leaf_inst=19.5, std_leaf_inst=20.675, n_empty_classes=0, coverage=0.9804,
)
LATTICE = dict(
    n_classes=95, n_individuals=153, n_object_properties=1, n_datatype_properties=5, n_restrictions=256,
    n_equiv_class=94, n_levels=5, n_roots=1, n_leaves=24, n_multi_parent=83, avg_depth=2.621, std_depth=0.98,
    avg_branching=3.155, std_branching=1.849, avg_inst=1.579, med_inst=0.0, std_inst=4.314,
    avg_leaf_inst=6.25, med_leaf_inst=2.5, std_leaf_inst=6.752, n_empty_classes=71, coverage=0.9804,
)
TREE = dict(
    n_classes=300, n_individuals=153, n_object_properties=1, n_datatype_properties=5, n_restrictions=0,
    n_equiv_class=0, n_levels=13, n_roots=1, n_leaves=150, n_multi_parent=0, avg_depth=8.09, std_depth=2.108,
    avg_branching=1.993, std_branching=0.082, avg_inst=0.5, med_inst=0.5, std_inst=0.501,
    avg_leaf_inst=1.0, med_leaf_inst=1.0, std_leaf_inst=0.0, n_empty_classes=150, coverage=0.9804,
)


def check(row, expected):
    got = row.asDict()
    assert {k: got[k] for k in expected} == pytest.approx(expected)


def iris_meta(iris, types):
    meta = metadata_from_types(iris, types)
    del meta.columns["row_id"]
    return meta


def test_interactive_export_statistics(iris, tmp_path, spark):
    tax = iris_taxonomy(iris)
    del tax.meta.columns["row_id"]
    triples = rdf.export_triples(tax, *NS)
    write_ntriples(triples, str(tmp_path / "nt"))
    back = read_ntriples(spark, str(tmp_path / "nt"))
    assert back.exceptAll(triples.distinct()).isEmpty() and back.count() == triples.count()
    table = stats.stats_of_many(spark, {"iris": back, "gone": lambda: read_ntriples(spark, str(tmp_path / "no"))})
    rows = table.collect()
    assert [r["file"] for r in rows] == ["iris"]
    check(rows[0], INTERACTIVE)
    write_stats(table, str(tmp_path / "csv"))
    text = [p.read_text() for p in (tmp_path / "csv").glob("*.csv")]
    assert any(t.startswith("file,n_classes,n_individuals,n_object_properties") for t in text)
    row = {(r["p"], r["o"]) for r in triples.where(F.col("s") == NS[1] + "/entity_99").collect()}
    assert (CNS + "PetalLengthCm", "4.1") in row and (CNS + "Id", "100.0") in row
    assert (CNS + "Species", CNS + "Species_Iris-versicolor") in row and (RDF_TYPE, CNS + "LargePetalIris") in row


def test_lattice_export_statistics(iris):
    meta = iris_meta(iris, IRIS)
    lat = fca.fca(fca.formal_context(iris, meta), 20)
    check(stats.taxonomy_stats(rdf.export_lattice(lat, iris, meta, *NS), "fca").first(), LATTICE)


def test_tree_export_statistics(iris):
    meta = iris_meta(iris, IRIS)
    concepts, member = hac.cut_tree(hac.hac(encode(iris, meta)), 20)
    triples = rdf.export_tree(concepts, member, iris, meta, *NS, "row_id")
    check(stats.taxonomy_stats(triples, "hac").first(), TREE)


def test_turtle_text(iris, tmp_path):
    tax = iris_taxonomy(iris)
    triples = rdf.export_triples(tax, *NS)
    prefixes = {"": CNS, "ent": NS[1] + "/", "owl": OWL, "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
                "xsd": "http://www.w3.org/2001/XMLSchema#"}
    write_turtle(triples, str(tmp_path / "ttl"), prefixes)
    text = "\n".join(p.read_text() for p in (tmp_path / "ttl").glob("*.txt"))
    assert "@prefix owl: <http://www.w3.org/2002/07/owl#> ." in text
    assert ":Iris a owl:Class ;\n    :" not in text
    assert ':Iris a owl:Class ;\n    rdfs:label "Iris" ;\n    rdfs:subClassOf owl:Thing .' in text
    assert '"4.1"^^xsd:decimal' in text and "ent:entity_99 a " in text


def test_axioms_by_origin(spark):
    tax = small(spark)
    a = tax.add_subconcept(tax.root_id, [R("x", "=", 2), R("c", "=", "a"), R("c", "=", "absent")])
    b = tax.add_subconcept(tax.root_id, [R("x", ">", 1)], "two words")
    tax.complement([a, b])
    tax.complement([a])
    rows = {(r["s"], r["p"]): r for r in rdf.axiom_triples(tax, CNS).collect()}
    by = {}
    for r in rows.values():
        by.setdefault(r["p"].split("#")[1], []).append(r)
    assert len(by["equivalentClass"]) == 4 and len(by["complementOf"]) == 2 and len(by["unionOf"]) == 1
    assert len(by["minInclusive"]) == len(by["maxInclusive"]) == 1 and len(by["minExclusive"]) == 1
    assert [r["o"] for r in by["hasValue"]] == [CNS + "c_a"]
    assert rdf.name_map(tax) == {"c0": "Root", "c1": "c01", "c2": "two words", "c3": "c02", "c4": "c03"}
    assert rdf.class_uris(tax, CNS)["c2"] == CNS + "two_words"
    specific = {(r["row_id"], r["o"]) for r in rdf.concept_types(tax, CNS, "most_specific").collect()}
    assert (1, CNS + "two_words") in specific and (1, CNS + "Root") not in specific
    assert {o for _, o in {(r["row_id"], r["o"]) for r in rdf.concept_types(tax, CNS, "leaf").collect()}} == {
        CNS + "two_words", CNS + "c02", CNS + "c03"}
    with pytest.raises(ValueError):
        rdf.export_triples(tax, "", "x")


def test_names_and_decimals(spark):
    texts = ["a b", "a__b", "_x_", "9lives", "", "été!", "a-b", "日本 語", "--", "_-"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", safe_name(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in got.collect()} == {t: safe_name_text(t) for t in texts}
    numbers = [30.0, 0.1, -2.5, 1e7, 12345678.9, 1.5e-5, -3e-4, 1e20, 123456789012.0, 5e-324, 0.0]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", decimal_text(F.col("x")).alias("n"))
    for r in got.collect():
        assert r["n"] == decimal_text_of(r["x"]) or float(r["n"]) == r["x"], r
        assert "E" not in r["n"] and "." in r["n"]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in odd.select(decimal_text(F.col("x"))).collect()] == [None, None, None]


def test_escapes_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("http://x/a", "http://x/p", 'q"\\n\n\tz\\', "literal", None, None), ("_:b", "http://x/p", "_:c", "blank", None, None)],
        rdf.TRIPLE,
    )
    write_ntriples(df, str(tmp_path / "nt"))
    assert sorted(map(tuple, read_ntriples(spark, str(tmp_path / "nt")).collect()), key=str) == sorted(
        map(tuple, df.collect()), key=str
    )


def dag(spark, edges, isolated=()):
    sub = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
    rows = [(f"u:{c}", sub, f"u:{p}", "uri", None, None) for c, p in edges]
    rows += [(f"u:{c}", RDF_TYPE, OWL + "Class", "uri", None, None) for c in isolated]
    return spark.createDataFrame(rows, rdf.TRIPLE)


def test_depth_is_the_longest_path(spark):
    t = dag(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("e", "d")], ["lone"])
    classes, edges = stats.named_classes(t), stats.subclass_edges(t)
    depth = {r["class"]: r["depth"] for r in stats.class_depths(classes, edges).collect()}
    assert depth == {"u:a": 0, "u:b": 1, "u:c": 2, "u:d": 3, "u:e": 4, "u:lone": 0}
    row = stats.taxonomy_stats(t, "dag").first()
    assert (row["n_roots"], row["n_leaves"], row["n_multi_parent"], row["coverage"]) == (2, 2, 1, 0.0)
    loop = dag(spark, [("b", "a"), ("c", "b"), ("b", "c")])
    with pytest.raises(ValueError):
        stats.class_depths(stats.named_classes(loop), stats.subclass_edges(loop))


def test_many_ontologies_take_one_batch(spark, caplog):
    """Three ontologies run as many jobs as one, a cycle takes out only its own, and rows equal those alone."""
    chain = dag(spark, [(f"c{i + 1}", f"c{i}") for i in range(5)] + [("c5", "c0"), ("x", "c1")], ["lone"])
    wide = dag(spark, [(f"w{i}", "top") for i in range(30)])
    loop = dag(spark, [("b", "a"), ("c", "b"), ("b", "c")])
    typed = spark.createDataFrame([(f"i:{k}", RDF_TYPE, f"u:w{k % 7}", "uri", None, None) for k in range(50)], rdf.TRIPLE)
    sources = {"chain": chain, "wide": wide.unionByName(typed), "empty": chain.limit(0)}

    def jobs(group, given):
        spark.sparkContext.setJobGroup(group, group)
        rows = {r["file"]: r.asDict() for r in stats.stats_of_many(spark, given).collect()}
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, n

    alone, n_alone = jobs("alone", {"chain": chain})
    rows, n_all = jobs("all", sources)
    assert n_all <= n_alone + 2 and rows["chain"] == alone["chain"]
    assert rows["wide"] == stats.taxonomy_stats(sources["wide"], "wide").first().asDict()
    assert (rows["wide"]["med_inst"], rows["wide"]["med_leaf_inst"], rows["chain"]["n_levels"]) == (0.0, 0.0, 6)
    assert rows["empty"]["n_classes"] == 0 and rows["empty"]["coverage"] == 0.0
    rows, _ = jobs("loop", sources | {"loop": loop})
    assert set(rows) == {"chain", "wide", "empty"} and "loop" in caplog.text


def test_medians_are_exact(spark):
    rnd = random.Random(6)
    for n in (1, 2, 7, 40):
        held = [rnd.randrange(6) for _ in range(n)]
        rows = [(f"u:k{i}", RDF_TYPE, OWL + "Class", "uri", None, None) for i in range(n)]
        rows += [(f"i:{i}_{j}", RDF_TYPE, f"u:k{i}", "uri", None, None) for i, m in enumerate(held) for j in range(m)]
        row = stats.taxonomy_stats(spark.createDataFrame(rows, rdf.TRIPLE), "t").first()
        assert row["med_inst"] == row["med_leaf_inst"] == statistics.median(held)


def test_colliding_values(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "a_b"), (2, "c")], "row_id long, v string")
    meta = metadata_from_types(df, {"row_id": ("title_id", False), "v": ("categorical", True)})
    got = rdf.uri_collisions(df, meta, CNS).collect()
    assert [(r["uri"], r["n_values"]) for r in got] == [(CNS + "v_a_b", 2)]
    tax = Taxonomy(df, meta)
    triples = rdf.export_triples(tax, *NS)
    assert triples.count() == triples.distinct().count()


def test_tasks_of_the_statistics_grow_with_the_triples(spark, monkeypatch):
    rows = [(f"http://x/i{i}", RDF_TYPE, f"http://x/C{i % 3}", "uri") for i in range(300)] * 2
    rows += [(f"http://x/C{k}", RDF_TYPE, OWL + "Class", "uri") for k in range(3)]
    triples = spark.createDataFrame(rows, "s string, p string, o string, o_kind string").coalesce(2)
    monkeypatch.setattr(stats, "TASK_ROWS", 20, raising=False)
    classes = stats.named_classes(triples)
    pairs = stats.class_instances(triples, classes)
    every = stats.individuals(triples, classes, pairs)
    assert pairs.rdd.getNumPartitions() == every.rdd.getNumPartitions() == 31
    assert pairs.count() == every.count() == 300
    counts = {r["class"]: r["n"] for r in stats.instance_counts(triples, classes).collect()}
    assert counts == {f"http://x/C{k}": 100 for k in range(3)}
