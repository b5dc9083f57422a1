"""Hierarchical clustering: the published iris tree and a brute-force check."""

import itertools
import random
import statistics

import numpy as np
import pytest

from taxoloom.metadata import metadata_from_types
from taxoloom.operators import hac as h
from taxoloom.operators.encode import encode

from test_fca import IRIS


def test_published_iris_tree(iris):
    tree = h.hac(encode(iris, metadata_from_types(iris, IRIS)))
    assert tree.n == 150 and tree.merges.count() == 149
    concepts, member = h.cut_tree(tree, 20)
    rows = concepts.collect()
    assert len(rows) == 300
    depths = [r["depth"] for r in rows]
    assert max(depths) + 1 == 13
    assert round(statistics.mean(depths), 3) == 8.09 and round(statistics.stdev(depths), 3) == 2.108
    parents = {r["parent_id"] for r in rows}
    assert sum(r["id"] not in parents for r in rows) == 150
    assert member.count() == 150 and member.select("row_id").distinct().count() == 150
    merges = {r["node"]: r for r in tree.merges.collect()}
    assert set(merges) == set(range(150, 299)) and merges[298]["size"] == 150
    for r in merges.values():
        assert r["left"] < r["right"] < r["node"]
        size = sum(1 if c < 150 else merges[c]["size"] for c in (r["left"], r["right"]))
        assert size == r["size"]
        assert all(c < 150 or merges[c]["distance"] <= r["distance"] for c in (r["left"], r["right"]))


def brute(x, linkage, metric):
    """Heights of one-pair-at-a-time clustering, and the row sets formed."""
    clusters = [frozenset([i]) for i in range(len(x))]
    base = h._pairwise(x, x, metric)

    def distance(a, b):
        if linkage == "ward":
            ca, cb = x[list(a)].mean(axis=0), x[list(b)].mean(axis=0)
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum())
        d = base[np.ix_(sorted(a), sorted(b))]
        return {"complete": d.max, "single": d.min, "average": d.mean}[linkage]()

    out = {}
    while len(clusters) > 1:
        a, b = min(itertools.combinations(clusters, 2), key=lambda p: distance(*p))
        out[a | b] = distance(a, b)
        clusters = [c for c in clusters if c not in (a, b)] + [a | b]
    return out


@pytest.mark.parametrize(
    "linkage,metric",
    [("ward", "euclidean"), ("complete", "euclidean"), ("average", "cityblock"), ("single", "chebyshev"), ("average", "cosine")],
)
def test_equals_brute_force(spark, linkage, metric):
    rnd = random.Random(linkage + metric)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(24)]
    rows += [(24, *rows[3][1:]), (25, *rows[3][1:]), (26, *rows[7][1:])]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    enc = encode(df, metadata_from_types(df, {"row_id": ("title_id", False)}))
    tree = h.hac(enc, linkage, metric)
    x = np.array([r["features"] for r in enc.df.orderBy("row_id").collect()])
    expected = brute(x, linkage, metric)
    leaf = {r["leaf"]: r["row_id"] for r in tree.leaves.collect()}
    below = {i: frozenset([leaf[i]]) for i in range(tree.n)}
    got = {}
    for r in tree.merges.orderBy("node").collect():
        below[r["node"]] = below[r["left"]] | below[r["right"]]
        assert len(below[r["node"]]) == r["size"]
        if r["distance"] > 1e-9:
            got[below[r["node"]]] = r["distance"]
    positive = {k: v for k, v in expected.items() if v > 1e-9}
    assert got.keys() == positive.keys()
    assert all(got[k] == pytest.approx(v) for k, v in positive.items())


def test_large_groups_of_equal_rows(spark):
    df = spark.range(1003).selectExpr("id as row_id", "cast(id % 3 = 0 as double) * 10 + cast(id = 1 as int) as x")
    enc = encode(df, metadata_from_types(df, {"row_id": ("title_id", False)}))
    tree = h.hac(enc)
    merges = {r["node"]: r for r in tree.merges.collect()}
    assert set(merges) == set(range(1003, 2005))
    for r in merges.values():
        assert r["left"] < r["right"] < r["node"]
        assert r["size"] == sum(1 if c < 1003 else merges[c]["size"] for c in (r["left"], r["right"]))
    concepts, member = h.to_taxonomy(tree, 3)
    assert member.count() == 1003
    for r in concepts.where("n_rows > 0").collect():
        assert r["size"] == r["n_rows"]
    # Depth-first ids: the first child of a concept follows it.
    rows = {r["id"]: r for r in concepts.collect()}
    assert rows["c02"]["parent_id"] == "c01" and rows["c01"]["parent_id"] == "root"


def test_micro_clusters_and_limits(spark, monkeypatch):
    df = spark.range(300).selectExpr("id as row_id", "cast(id % 60 as double) + 100 * (id % 2) as x")
    enc = encode(df, metadata_from_types(df, {"row_id": ("title_id", False)}))
    small = h.micro_clusters(enc, 10)
    assert small.df.count() == 300 and small.df.select("features").distinct().count() <= 10
    monkeypatch.setattr(h, "MOST_POINTS", 20)
    with pytest.raises(ValueError):
        h.hac(enc)
    tree = h.hac(small)
    top = {r["size"] for r in h.cut_tree(tree, 2)[0].where("depth = 2").collect()}
    assert top == {150}
    for bad in (("median", "euclidean"), ("ward", "cosine"), ("single", "odd")):
        with pytest.raises(ValueError):
            h.hac(enc, *bad)


def test_single_row(spark):
    df = spark.createDataFrame([(7, 1.0)], "row_id long, x double")
    tree = h.hac(encode(df, metadata_from_types(df, {"row_id": ("title_id", False)})))
    concepts, member = h.cut_tree(tree)
    assert [r["id"] for r in concepts.collect()] == ["root"]
    assert [tuple(r) for r in member.collect()] == [("root", 7)]


@pytest.mark.parametrize(
    "linkage,metric",
    [("ward", "euclidean"), ("complete", "euclidean"), ("average", "cityblock"), ("single", "chebyshev"), ("average", "cosine")],
)
def test_rounds_over_blocks_equal_brute_force(spark, monkeypatch, linkage, metric):
    """Many blocks, clusters larger than what a task holds at once, and all merges made in rounds."""
    for name, value in (("LAST_CLUSTERS", 2), ("BLOCK_POINTS", 7), ("HELD_CELLS", 9)):
        monkeypatch.setattr(h, name, value)
    test_equals_brute_force(spark, linkage, metric)


def test_more_distinct_rows_than_one_matrix(spark):
    """20,500 distinct rows, more than were clustered before, in groups of 2,050."""
    df = spark.range(20_500).selectExpr("id as row_id", "cast(1000 * (id % 10) + 0.01 * floor(id / 10) as double) as x")
    tree = h.hac(encode(df, metadata_from_types(df, {"row_id": ("title_id", False)})))
    assert tree.merges.count() == tree.merges.select("node").distinct().count() == 20_499
    assert tree.merges.agg({"size": "max"}).first()[0] == 20_500
    tops = tree.merges.where("size % 2050 = 0").groupBy("size").count().collect()
    assert {r["size"]: r["count"] for r in tops}[2050] == 10


def test_ends_inside_and_above_points(spark):
    """A cut that ends in merges of points, at whole points and among equal rows holds every row once."""
    df = spark.range(64).selectExpr("id as row_id", "cast(case when id < 40 then 0 when id < 41 then 50 else id end as double) as x")
    tree = h.hac(encode(df, metadata_from_types(df, {"row_id": ("title_id", False)})))
    merges = {r["node"]: r for r in tree.merges.collect()}
    leaf = {r["leaf"]: r["row_id"] for r in tree.leaves.collect()}

    def under(node):
        return {leaf[node]} if node < tree.n else under(merges[node]["left"]) | under(merges[node]["right"])

    for depth in (1, 2, 3, 5, 9):
        concepts, member = h.to_taxonomy(tree, depth)
        held = {}
        for r in member.collect():
            held.setdefault(r["concept_id"], []).append(r["row_id"])
        assert sorted(i for ids in held.values() for i in ids) == list(range(64))
        assert {r["id"]: r["size"] for r in concepts.where("n_rows > 0").collect()} == {c: len(ids) for c, ids in held.items()}
        groups = {frozenset(under(n)) for n in (*merges, *leaf)}
        assert all(frozenset(ids) in groups for ids in held.values())


def test_rows_of_a_k_means_task_are_bounded(spark, monkeypatch):
    """One file split of many rows is dealt out before the rows are kept as vectors."""
    from pyspark.ml.clustering import KMeans

    df = spark.range(4000).coalesce(1).selectExpr("id as row_id", "cast(id % 50 as double) + 1000 * (id % 2) as x")
    enc = encode(df, metadata_from_types(df, {"row_id": ("title_id", False)}))
    seen, fit = [], KMeans.fit
    monkeypatch.setattr(h, "TRAINED_CELLS", 100, raising=False)
    monkeypatch.setattr(KMeans, "fit", lambda self, data: seen.append(data.rdd.getNumPartitions()) or fit(self, data))
    small = h.micro_clusters(enc, 2)
    assert seen == [40]
    assert small.df.count() == 4000 and small.df.select("features").distinct().count() == 2


def test_average_tree_of_many_points_takes_few_rounds(spark, monkeypatch):
    """What lies inside blocks is merged there: rounds over all clusters do not grow with the height of the tree."""
    for name, value in (("LAST_CLUSTERS", 32), ("BLOCK_POINTS", 256)):
        monkeypatch.setattr(h, name, value)
    added, add = [], h.Parts.add
    monkeypatch.setattr(h.Parts, "add", lambda self, df: added.append(1) or add(self, df))
    rnd = random.Random(5)
    rows = [(i, float(i % 9), rnd.gauss(0, 1)) for i in range(1200)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    enc = encode(df, metadata_from_types(df, {"row_id": ("title_id", False)}))
    tree = h.hac(enc, "average", "cityblock")
    merges, rounds = {r["node"]: r for r in tree.merges.collect()}, len(added)
    leaf = {r["leaf"]: r["row_id"] for r in tree.leaves.collect()}
    below = {i: frozenset([leaf[i]]) for i in range(tree.n)}
    for node in sorted(merges):
        below[node] = below[merges[node]["left"]] | below[merges[node]["right"]]
    got = {below[node]: r["distance"] for node, r in merges.items()}

    x = np.array([r["features"] for r in enc.df.orderBy("row_id").collect()])
    d, size, held, expected = np.abs(x[:, None] - x).sum(axis=2), np.ones(len(x)), [frozenset([i]) for i in range(len(x))], {}
    np.fill_diagonal(d, np.inf)
    for _ in range(len(x) - 1):
        a, b = np.unravel_index(d.argmin(), d.shape)
        held[a] |= held[b]
        expected[held[a]] = d[a, b]
        d[a] = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        d[a, a], d[b], d[:, b] = np.inf, np.inf, np.inf
        d[:, a] = d[a]
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())
    assert rounds <= 5


def test_running_sums_of_distances():
    """Average cityblock distances of larger clusters are the means over all pairs of members."""
    rng = np.random.default_rng(3)
    first, w, x = np.array([0, 1, 30]), rng.integers(1, 4, 90).astype(float), np.round(rng.normal(size=(90, 3)), 1)
    left, right = h.Block(np.arange(3), first, np.zeros(3), w, x), h.Block(np.arange(3), first + 1 - (first == 0), np.zeros(3), w, x)
    d, pairs = np.concatenate([d for _, d in h._linked(left, right, "average", "cityblock")]), h._pairwise(x, x, "cityblock")
    for i, p in enumerate(np.split(np.arange(90), left.first[1:])):
        for j, q in enumerate(np.split(np.arange(90), right.first[1:])):
            assert d[i, j] == pytest.approx(np.average(pairs[np.ix_(p, q)], weights=np.outer(w[p], w[q])))
