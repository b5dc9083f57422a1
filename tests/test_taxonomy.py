"""Concept algebra: the published interactive taxonomy on iris and its edge rules."""

import pytest

from taxoloom.metadata import metadata_from_types
from taxoloom.operators.predicate import Restriction as R, interval
from taxoloom.operators.taxonomy import Taxonomy

IRIS_TYPES = {
    "row_id": ("title_id", False),
    "Id": ("numeric", True),
    "Species": ("categorical", True),
}


def iris_taxonomy(iris, recompute="derived"):
    tax = Taxonomy(iris, metadata_from_types(iris, IRIS_TYPES), recompute=recompute)
    tax.update(tax.root_id, name="Iris")
    root = tax.root_id
    narrow = tax.add_subconcept(root, [R("PetalWidthCm", "<", 1.0)], "NarrowPetalIris")
    short = tax.add_subconcept(root, [R("PetalLengthCm", "<", 3.33)], "ShortPetalIris")
    long = tax.add_subconcept(root, [R("PetalLengthCm", ">=", 4.1)], "LongPetalIris")
    wide = tax.add_subconcept(root, [R("PetalWidthCm", ">=", 1.16)], "WidePetalIris")
    tax.add_subconcept(root, interval("PetalWidthCm", 1.0, 1.16), "MediumWidthPetalris")
    mshort = tax.add_subconcept(root, interval("PetalLengthCm", 1.7, 3.9), "MediumShortPetalIris")
    mlong = tax.add_subconcept(root, interval("PetalLengthCm", 3.33, 4.1), "MediumLongPetalIris")
    tax.union([mshort, mlong], "MerdiumLengthPetalIris")
    tax.intersection([short, narrow], "SmallPetalIris")
    large = tax.intersection([long, wide], "LargePetalIris")
    tax.add_subconcept(large, [R("SepalWidthCm", ">=", 3.04)], "LargePetalWideSepalIris")
    tax.add_subconcept(large, [R("SepalWidthCm", "<", 3.04)], "LargePetalNarrowSepalIris")
    return tax


PUBLISHED = {
    "Iris": (150, 1.0),
    "NarrowPetalIris": (50, 1.0),
    "ShortPetalIris": (53, 0.9434),
    "LongPetalIris": (84, 0.9881),
    "WidePetalIris": (90, 0.9222),
    "MediumWidthPetalris": (10, 0.0),
    "MediumLongPetalIris": (13, 0.0),
    "MediumShortPetalIris": (14, 0.0),
    "MerdiumLengthPetalIris": (22, 1.0),
    "SmallPetalIris": (50, 0.0),
    "LargePetalIris": (83, 1.0),
    "LargePetalWideSepalIris": (25, 0.0),
    "LargePetalNarrowSepalIris": (58, 0.0),
}


@pytest.mark.parametrize("recompute", ["derived", "snapshot"])
def test_published_iris_taxonomy(iris, recompute):
    tax = iris_taxonomy(iris, recompute)
    nodes, edges = tax.graph()
    assert {r["name"]: (r["size"], r["coverage"]) for r in nodes.collect()} == PUBLISHED
    assert edges.count() == sum(len(c.child_ids) for c in tax.concepts.values()) == 16


def test_grouped_totals_equal_wide_totals(iris, monkeypatch):
    tax = iris_taxonomy(iris)
    wide = sorted(tuple(r) for r in tax._totals(list(tax.concepts)).collect())
    monkeypatch.setattr("taxoloom.operators.taxonomy.WIDE_CONCEPTS", 0)
    assert sorted(tuple(r) for r in tax._totals(list(tax.concepts)).collect()) == wide


def test_membership_equals_rows(iris):
    tax = iris_taxonomy(iris)
    held = {}
    for r in tax.membership().collect():
        held.setdefault(r["concept_id"], set()).add(r["row_id"])
    for i in tax.concepts:
        assert held[i] == {r["row_id"] for r in tax.rows(i).collect()}


def small(spark, **kw):
    df = spark.createDataFrame(
        [(0, 1.0, "a"), (1, 2.0, "b"), (2, None, "a"), (3, float("nan"), None), (4, 5.0, "nan")],
        "row_id long, x double, c string",
    )
    meta = metadata_from_types(df, {"row_id": ("title_id", False), "c": ("categorical", True)})
    return Taxonomy(df, meta, **kw)


def ids(tax, c):
    return {r["row_id"] for r in tax.rows(c).collect()}


def test_missing_values(spark):
    tax = small(spark)
    big = tax.add_subconcept(tax.root_id, [R("x", ">=", 2)])
    assert ids(tax, big) == {1, 4}
    assert ids(tax, tax.complement([big])) == {0, 2, 3}
    text = tax.add_subconcept(tax.root_id, [R("c", ">", "nan")])
    assert ids(tax, text) == {4}
    assert ids(tax, tax.add_subconcept(tax.root_id, [R("row_id", "=", 3)])) == {0, 1, 2, 3, 4}


def test_identities(spark):
    tax = small(spark)
    a = tax.add_subconcept(tax.root_id, [R("x", ">", 1)])
    b = tax.add_subconcept(tax.root_id, [R("c", "=", "a")])
    comp = tax.complement([a, b])
    assert ids(tax, tax.union([a, b])) == ids(tax, a) | ids(tax, b)
    assert ids(tax, comp) == ids(tax, tax.root_id) - ids(tax, a) - ids(tax, b)
    assert tax.concepts[comp].parent_ids == [tax.root_id]


def test_guards(spark):
    tax = small(spark)
    a = tax.add_subconcept(tax.root_id, [R("x", ">", 1)])
    child = tax.add_subconcept(a, [R("x", "<", 4)])
    with pytest.raises(ValueError):
        tax.complement([a, child])
    with pytest.raises(ValueError):
        tax.union([a])
    with pytest.raises(ValueError):
        tax.intersection([a])
    with pytest.raises(ValueError):
        tax.add_subconcept(a, [])
    with pytest.raises(ValueError):
        tax.add_subconcept(a, [R("x", "~", 1)])
    with pytest.raises(ValueError):
        tax.add_subconcept(a, [R("x", "=", "many")])
    with pytest.raises(ValueError):
        tax.delete(tax.root_id)
    with pytest.raises(KeyError):
        tax.add_subconcept("nope", [R("x", ">", 1)])


def test_merge_replaces_sources(spark):
    df = spark.range(40).selectExpr("id as row_id", "cast(id as double) as x")
    tax = Taxonomy(df, metadata_from_types(df, {"row_id": ("title_id", False)}))
    a = tax.add_subconcept(tax.root_id, [R("x", ">", 5), R("x", "<=", 15)])
    b = tax.add_subconcept(tax.root_id, interval("x", 20, 30))
    under = tax.add_subconcept(b, [R("x", "<", 25)])
    m = tax.merge([a, b])
    assert [(r.operator, r.value) for r in tax[m].restrictions] == [(">=", 5.0), ("<", 30.0)]
    assert set(tax.concepts) == {tax.root_id, m} and under not in tax.concepts
    assert ids(tax, m) == set(range(5, 30))
    open_a = tax.add_subconcept(tax.root_id, [R("x", ">=", 1)])
    open_b = tax.add_subconcept(tax.root_id, [R("x", "<", 9)])
    with pytest.raises(ValueError):
        tax.merge([open_a, open_b])


def test_find_intersections_orders_pairs(spark, monkeypatch):
    for wide in (24, 0):
        monkeypatch.setattr("taxoloom.operators.taxonomy.WIDE_PAIRS", wide)
        df = spark.range(40).selectExpr("id as row_id", "cast(id as double) as x")
        tax = Taxonomy(df, metadata_from_types(df, {"row_id": ("title_id", False)}))
        a, b, c = [tax.add_subconcept(tax.root_id, interval("x", lo, lo + 10)) for lo in (0, 5, 12)]
        made = tax.find_intersections([a, b, c])
        assert [tax[i].source_ids for i in made] == [[a, b], [b, c]]
        d = tax.add_subconcept(tax.root_id, interval("x", 30, 35))
        with pytest.raises(ValueError):
            tax.find_intersections([a, d])


def test_edit_reaches_or_skips_a_union(spark):
    for mode, expected in (("derived", {1, 4, 0, 2}), ("snapshot", {4, 0, 2})):
        tax = small(spark, recompute=mode)
        a = tax.add_subconcept(tax.root_id, [R("x", ">", 2)])
        b = tax.add_subconcept(tax.root_id, [R("c", "=", "a")])
        u = tax.union([a, b])
        tax.update(a, restrictions=[R("x", ">=", 2)])
        assert ids(tax, a) == {1, 4}
        assert ids(tax, u) == expected


def test_snapshot_recompute_of_complement_uses_the_parent(spark):
    for mode, expected in (("derived", {1}), ("snapshot", {1, 4})):
        tax = small(spark, recompute=mode)
        top = tax.add_subconcept(tax.root_id, [R("x", ">=", 1)])
        inner = tax.add_subconcept(top, [R("x", ">", 4)])
        comp = tax.complement([inner])
        assert ids(tax, comp) == {0, 1}
        tax.update(top, restrictions=[R("x", ">=", 2)])
        assert ids(tax, comp) == expected


def test_delete_cascades_and_outlived_union_keeps_rows(spark, tmp_path):
    tax = small(spark)
    a = tax.add_subconcept(tax.root_id, [R("x", ">", 1)])
    b = tax.add_subconcept(tax.root_id, [R("c", "=", "a")])
    u = tax.union([a, b])
    both = tax.intersection([a, u])
    before = ids(tax, u)
    tax.delete(a)
    assert both not in tax.concepts and a not in tax[u].child_ids
    assert ids(tax, u) == before
    tax.save(str(tmp_path / "saved"))
    again = Taxonomy.load(tax.df, str(tmp_path / "saved"))
    assert ids(again, u) == before
    held = spark.read.parquet(str(tmp_path / "saved" / "membership"))
    assert held.where(held.concept_id == u).count() == len(before)


def test_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id as row_id", "cast(id as double) as x", "id as y").write.parquet(path)
    df = spark.read.parquet(path)
    tax = Taxonomy(df, metadata_from_types(df, {"row_id": ("title_id", False)}))
    a = tax.add_subconcept(tax.root_id, [R("x", ">=", 10.0)])
    b = tax.add_subconcept(a, [R("y", "<", 20)])
    plan = tax.rows(b).select("row_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,10.0)" in plan and "LessThan(y,20)" in plan


def test_deep_graphs_stay_small(spark):
    df = spark.range(64).selectExpr("id as row_id", "cast(id as double) as x")
    tax = Taxonomy(df, metadata_from_types(df, {"row_id": ("title_id", False)}))
    a = tax.add_subconcept(tax.root_id, [R("x", ">=", 10)])
    b = tax.add_subconcept(tax.root_id, [R("x", "<", 50)])
    for _ in range(14):
        # Each level uses both concepts of the level before: 2^n terms written out.
        a, b = tax.union([a, b]), tax.intersection([a, b])
    assert ids(tax, b) == set(range(10, 50)) and ids(tax, a) == set(range(64))
    sizes = {r["concept_id"]: r["size"] for r in tax.sizes([a, b]).collect()}
    assert sizes == {a: 64, b: 40}


def test_categories_of_other_types(spark):
    df = spark.createDataFrame([(0, True, 1e7), (1, False, 2.5), (2, None, float("nan"))], "row_id long, b boolean, x double")
    meta = metadata_from_types(df, {"row_id": ("title_id", False), "b": ("categorical", True), "x": ("categorical", True)})
    tax = Taxonomy(df, meta)
    assert ids(tax, tax.add_subconcept(tax.root_id, [R("b", "=", True)])) == {0}
    assert ids(tax, tax.add_subconcept(tax.root_id, [R("x", "=", "10000000.0")])) == {0}
    assert ids(tax, tax.add_subconcept(tax.root_id, [R("x", "=", 2.5)])) == {1}
