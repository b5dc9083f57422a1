"""Discovery: the F1 search against brute force, and the SOM by its properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxoloom.metadata import metadata_from_types
from taxoloom.operators import restriction_search as rs
from taxoloom.operators.discover import (
    DealtSom,
    assign_bmu,
    check_parameters,
    discover,
    fit_wsom,
    init_codebook,
    resolve,
    select_best_column,
    settle_points,
    _epoch,
    suggested_epochs,
)
from taxoloom.operators.encode import Span, encode, encode_sparse, fit_encoder
from taxoloom.operators.taxonomy import Taxonomy


def brute_numeric(values, clusters, target, thresholds):
    rows = range(len(values))
    members = {i for i in rows if clusters[i] in target}

    def score(keep):
        hit = {i for i in rows if values[i] is not None and keep(values[i])}
        both = len(hit & members)
        return 2 * both / (len(hit) + len(members)) if both else 0.0

    best, top = 0.0, None
    for t in thresholds:
        for ops, keep in (((">=", t),), lambda v: v >= t), ((("<", t),), lambda v: v < t):
            if score(keep) > best:
                best, top = score(keep), ops
    for i, lo in enumerate(thresholds):
        for hi in thresholds[i + 1 :]:
            s = score(lambda v: lo <= v < hi)
            if s > best:
                best, top = s, ((">=", lo), ("<", hi))
    return top, best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_numeric_search_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    values = [None if rnd.random() < 0.1 else round(rnd.gauss(0, 2), 1) for _ in range(120)]
    clusters = [rnd.randrange(4) if v is None else min(3, max(0, int(v + 2 + rnd.random()))) for v in values]
    df = spark.createDataFrame(
        [(i, v, c) for i, (v, c) in enumerate(zip(values, clusters))], "row_id long, x double, cluster int"
    )
    m = metadata_from_types(df, {})["x"]
    search = rs.search_for(df, "cluster", m, "row_id")
    kept = np.array([v for v in values if v is not None])
    cuts = sorted({round(float(np.quantile(kept, p / 100)), 4) for p in range(5, 100, 5)})
    assert search.cuts == cuts
    for target in ({0}, {1}, {2}, {3}, {0, 1}, {1, 2, 3}):
        found = search.best(frozenset(target))
        top, best = brute_numeric(values, clusters, target, cuts)
        assert found.f1 == pytest.approx(best)
        assert tuple((r.operator, r.value) for r in found.restrictions) == top


def test_category_search(spark):
    rows = [(0, "b", 0), (1, "a", 0), (2, "a", 1), (3, "c", 1), (4, None, 1), (5, "c", 2), (6, None, 3)]
    df = spark.createDataFrame(rows, "row_id long, c string, cluster int")
    m = metadata_from_types(df, {"c": ("categorical", True)})["c"]
    search = rs.search_for(df, "cluster", m, "row_id")
    zero = search.best(frozenset([0]))
    assert zero.restrictions[0].value == "b" and zero.f1 == pytest.approx(2 / 3)
    # a and c tie at 2 / (2 + 3): a is seen first.
    assert search.best(frozenset([1])).restrictions[0].value == "a"
    assert search.best(frozenset([3])) is None
    both = search.best(frozenset([1, 2]))
    assert both.restrictions[0].value == "c" and both.f1 == pytest.approx(4 / 6)
    table = {r["cluster"]: (r["value"], r["f1"]) for r in rs.best_values(df, "cluster", m, "row_id").collect()}
    assert table[1] == ("a", pytest.approx(0.4)) and 3 not in table


def test_date_search_uses_deciles_and_single_bounds(spark):
    df = spark.range(100).selectExpr(
        "id as row_id",
        "timestamp_ntz'2020-01-01' + make_dt_interval(cast(id as int), 6) as d",
        "cast(id >= 50 as int) as cluster",
    )
    m = metadata_from_types(df, {"d": ("date", True)})["d"]
    search = rs.search_for(df, "cluster", m, "row_id")
    assert len(search.tried) == 9
    found = search.best(frozenset([1]))
    assert [(r.operator, r.value) for r in found.restrictions] == [(">=", "2020-02-19 18:00:00")]
    assert found.f1 == 1.0


def planted(spark, n=400):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        g = i % 4
        rows.append((i, 10.0 * g + rnd.gauss(0, 0.3), rnd.gauss(0, 1), rnd.gauss(0, 1), "k", g))
    df = spark.createDataFrame(rows, "row_id long, x1 double, x2 double, x3 double, c string, truth int")
    meta = metadata_from_types(
        df, {"row_id": ("title_id", False), "c": ("categorical", False), "truth": ("numeric", False)}
    )
    return df, meta


def test_planted_column_is_found(spark):
    df, meta = planted(spark)
    tax = Taxonomy(df, meta)
    got = discover(tax, tax.root_id, map_size=4, epochs=30, seed=3)
    assert got.column == "x1"
    assert got.som.history[-1][1] < got.som.history[0][1]
    assert got.proposed and all(tax[i].origin == "wsom" and tax[i].proposed for i in got.proposed)
    sizes = {r["concept_id"]: r["size"] for r in tax.sizes(got.proposed).collect()}
    assert all(0 < n < 400 for n in sizes.values())
    resolve(tax, "validate")
    assert not any(c.proposed for c in tax.concepts.values())
    again = discover(tax, tax.root_id, map_size=4, epochs=30, seed=3)
    assert [tax[i].restrictions for i in again.proposed] == [tax[i].restrictions for i in got.proposed]
    resolve(tax, "cancel")
    assert set(again.proposed).isdisjoint(tax.concepts) and set(got.proposed) <= set(tax.concepts)


def test_training_does_not_depend_on_partitioning(spark):
    df, meta = planted(spark)
    one = fit_wsom(encode(df.repartition(1), meta), 3, epochs=6, seed=1)
    many = fit_wsom(encode(df.repartition(7), meta), 3, epochs=6, seed=1)
    assert np.allclose(one.prototypes, many.prototypes) and np.allclose(one.weights, many.weights)


def test_equal_rows_are_one_weighted_point(spark):
    rnd = random.Random(3)
    kinds = [(rnd.gauss(0, 1), rnd.choice("abc"), rnd.choice(["x", "y", None])) for _ in range(12)]
    rows = [(i, *kinds[i % 12 if i % 3 else 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, x double, c string, d string")
    meta = metadata_from_types(df, {"row_id": ("title_id", False), "c": ("categorical", True), "d": ("categorical", True)})
    sparse = encode_sparse(df, meta)
    blocks = settle_points(sparse).collect()
    weights = np.concatenate([np.frombuffer(r["w"], np.int64) for r in blocks])
    assert len(weights) == 9 and weights.sum() == 300 and weights.max() >= 100
    # The dense rows, one point each, train the same map.
    a, b = fit_wsom(sparse, 3, epochs=40, seed=2), fit_wsom(sparse.dense(), 3, epochs=40, seed=2)
    assert np.allclose(a.prototypes, b.prototypes) and np.allclose(a.weights, b.weights)
    found = {r["row_id"]: r["cluster"] for r in assign_bmu(sparse, a).collect()}
    assert found == {r["row_id"]: r["cluster"] for r in assign_bmu(sparse.dense(), b).collect()}


def reference_epoch(x, prototypes, gate):
    """One pass over dense rows, row by row."""
    total, count, slope, away = np.zeros_like(prototypes), np.zeros(len(prototypes), int), np.zeros(x.shape[1]), 0.0
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)
    for row in x:
        y = row * gate
        n = np.linalg.norm(y)
        y = y / n if n > 0 else y
        cos = unit @ y
        u = int(cos.argmax())
        total[u] += y
        count[u] += 1
        away += 1 - cos[u]
        if n > 0:
            slope += row * (unit[u] - cos[u] * y) / n
    return total, count, slope, away


def test_epoch_equals_a_pass_over_dense_rows(spark):
    df, meta = planted(spark, 90)
    meta.set("c", include=True)
    enc = encode_sparse(df, meta)
    x = np.array([r["features"] for r in enc.dense().df.orderBy("row_id").collect()])
    book, gate = init_codebook(enc, 3, 5), np.linspace(0.2, 0.9, enc.width)
    total, count, slope, away, rows = _epoch(settle_points(enc), book, gate)
    t, c, s, w = reference_epoch(x, book, gate)
    assert np.allclose(total, t) and (count == c).all() and np.allclose(slope, s) and away == pytest.approx(w) and rows == 90


def test_discovery_with_a_feature_per_row(spark):
    df, meta = planted(spark)
    df = df.withColumn("name", F.concat(F.lit("n"), "row_id"))
    meta = metadata_from_types(df, {"row_id": ("title_id", False), "c": ("categorical", False), "truth": ("numeric", False), "name": ("categorical", True)})
    tax = Taxonomy(df, meta)
    got = discover(tax, tax.root_id, map_size=3, epochs=10, seed=1)
    assert len(got.som.weights) == 403 and got.proposed


def test_codebook_repeats_rows(spark):
    df, meta = planted(spark, 5)
    book = init_codebook(encode(df, meta), 3, 0)
    assert book.shape == (9, 3) and len(np.unique(book, axis=0)) == 5


def test_bmu_is_the_nearest_prototype(spark):
    df, meta = planted(spark, 60)
    enc = encode(df, meta)
    som = fit_wsom(enc, 2, epochs=5, seed=0)
    x = {r["row_id"]: np.array(r["features"]) * som.gate for r in enc.df.collect()}
    for r in assign_bmu(enc, som).collect():
        v = x[r["row_id"]]
        cos = som.prototypes @ v / (np.linalg.norm(som.prototypes, axis=1) * np.linalg.norm(v))
        assert r["cluster"] == int(cos.argmax())


def test_discovery_within_a_concept(iris):
    meta = metadata_from_types(iris, {"row_id": ("title_id", False), "Id": ("title_id", False), "Species": ("categorical", True)})
    tax = Taxonomy(iris, meta)
    from taxoloom.operators.predicate import Restriction

    part = tax.add_subconcept(tax.root_id, [Restriction("PetalLengthCm", ">=", 2)])
    got = discover(tax, part, map_size=2, epochs=8, ignore=["PetalLengthCm"])
    assert got.column != "PetalLengthCm" and "PetalLengthCm" not in got.column_weights
    assert all(tax[i].parent_ids == [part] for i in got.proposed)


def test_limits(spark):
    for bad in ((1, 20), (21, 20), (5, 4), (5, 5001)):
        with pytest.raises(ValueError):
            check_parameters(*bad)
    df, meta = planted(spark, 3)
    tax = Taxonomy(df, meta)
    with pytest.raises(ValueError):
        discover(tax, tax.root_id)
    assert suggested_epochs(10_000_000) == 5 and suggested_epochs(10) == 5000 and suggested_epochs(2500) == 100
    with pytest.raises(ValueError):
        resolve(tax, "maybe")


def test_best_column_ties_and_categories():
    spans = [Span("a", "numeric", 0, 1), Span("c", "categorical", 1, 2), Span("none", "categorical", 3, 0)]
    assert select_best_column(spans, [0.5, 0.1, 0.5])[0] == "a"
    assert select_best_column(spans, [0.5, 0.1, 0.6])[0] == "c"
    assert select_best_column([], [])[0] is None


class Fixed:
    """A search whose answers are given."""

    def __init__(self, scores):
        self.scores = scores

    def best(self, clusters):
        s = self.scores.get(clusters)
        return None if s is None else rs.Found((str(sorted(clusters)),), s, 1, (0, 1))

    def best_of(self, unions):
        return [self.best(u) for u in unions]


def test_merging():
    one, two, three = (frozenset([i]) for i in (1, 2, 3))
    search = Fixed({one: 0.5, two: 0.5, three: 0.4, one | two: 0.6, one | three: 0.9, one | two | three: 0.7})
    centroids = {1: [1, 0], 2: [1, 0.1], 3: [0, 1]}
    found = rs.characterise(search, [1, 2, 3])
    out = rs.merge_clusters(search, found, centroids, 0.05)
    # 1 and 2 are most alike and merge first; the result then takes 3.
    assert [f.f1 for f in out] == [0.7]
    assert len(rs.merge_clusters(search, found, centroids, 0.6)) == 3


def test_an_epoch_holds_a_few_blocks_at_a_time(spark, monkeypatch):
    """The batches of an epoch do not grow with the points of a task, and the setting is put back."""
    from taxoloom.operators import discover as module

    df = spark.range(4000).selectExpr("id as row_id", "sin(id) as x", "cos(id * 3) as y", "cast(id % 3 as string) as c")
    enc = encode_sparse(df, metadata_from_types(df, {"row_id": ("title_id", False), "c": ("categorical", True)}))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual, seen, epoch = spark.conf.get(name), [], module._epoch
    monkeypatch.setattr(module, "_epoch", lambda *a: seen.append(int(spark.conf.get(name))) or epoch(*a))
    whole = fit_wsom(enc, 3, 0.01, 6, 5)
    assert seen == [module.BATCH_BLOCKS] * 6 and spark.conf.get(name) == usual
    for run, short in ((50, 1), (64, 10**9)):
        monkeypatch.setattr(module, "RUN_POINTS", run)
        monkeypatch.setattr(module, "SHORT_RUN", short)
        again = fit_wsom(enc, 3, 0.01, 6, 5)
        assert np.allclose(again.prototypes, whole.prototypes) and np.allclose(again.weights, whole.weights)
        assert [h[2] for h in again.history] == [h[2] for h in whole.history]


def named(spark, n=300):
    """Points with a wide column of names: most occur once, one often, some not at all, and every seventh is missing."""
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        name = None if i % 7 == 0 else "often" if i % 3 == 0 else f"n{i // 2 * 2 if i % 5 == 0 else i}"
        rows.append((i, 10.0 * (i % 3) + rnd.gauss(0, 0.3), rnd.gauss(0, 1), rnd.choice(["x", "y", None]), name))
    df = spark.createDataFrame(rows, "row_id long, x double, z double, c string, name string")
    return df, metadata_from_types(df, {"row_id": ("title_id", False), "c": ("categorical", True), "name": ("categorical", True)})


@pytest.fixture
def dealt(monkeypatch):
    """Every map is dealt out, and a feature of more than ten points stays with the driver."""
    from taxoloom.operators import discover as module

    def on():
        monkeypatch.setattr(module, "MAP_CELLS", 1)
        monkeypatch.setattr(module, "HEAVY_PARTS", 100)

    return on


@pytest.mark.parametrize("map_size, epochs, part", [(3, 12, False), (2, 8, True), (7, 25, False)])
def test_a_dealt_map_equals_one_on_the_driver(spark, dealt, map_size, epochs, part):
    df, meta = named(spark)
    encoder = fit_encoder(df, meta)
    # Of a part of the rows, most names are held by no point.
    enc = encoder.transform(df.where("row_id % 4 = 1") if part else df)
    whole = fit_wsom(enc, map_size, 0.01, epochs, 3)
    clusters = {r["row_id"]: r["cluster"] for r in assign_bmu(encoder.transform(df), whole).collect()}
    columns = whole.best_column(encoder.spans)
    dealt()
    som = fit_wsom(enc, map_size, 0.01, epochs, 3)
    assert isinstance(som, DealtSom) and np.allclose(som.history, whole.history)
    held = som.held
    assert len(held) == 5
    assert np.allclose(som.weights, whole.weights[held]) and np.allclose(som.prototypes, whole.prototypes[:, held])
    rest = {r["feature_idx"]: r for r in som.features().collect()}
    assert set(rest).isdisjoint(held.tolist()) and (part or len(rest) + len(held) == encoder.spans[-1].start + encoder.spans[-1].size)
    for j, r in rest.items():
        assert r["gate"] == pytest.approx(whole.gate[j]) and np.allclose(r["row"], whole.prototypes[:, j], rtol=1e-7, atol=1e-12)
    assert np.allclose(som.centroids @ som.centroids.T, whole.prototypes @ whole.prototypes.T)
    best, weight = som.best_column(encoder.spans)
    assert best == columns[0] and weight == pytest.approx(columns[1])
    assert {r["row_id"]: r["cluster"] for r in assign_bmu(encoder.transform(df), som).collect()} == clusters


def test_discovery_with_a_dealt_map(spark, dealt):
    df, meta = named(spark)

    def run():
        tax = Taxonomy(df, meta)
        got = discover(tax, tax.root_id, map_size=3, epochs=8, seed=2)
        return got, [tax[i].restrictions for i in got.proposed]

    one, proposed = run()
    dealt()
    other, again = run()
    assert proposed and again == proposed and other.column == one.column
    assert isinstance(other.som, DealtSom) and other.column_weights == pytest.approx(one.column_weights)


def test_the_driver_and_the_tasks_are_sent_no_part_of_a_wide_map(spark, dealt, monkeypatch):
    """What an epoch sends and returns has the width of the held features, whatever the number of names."""
    from taxoloom.operators import discover as module

    widths, epoch = [], module._dealt_epoch
    monkeypatch.setattr(module, "_dealt_epoch", lambda e, prototypes, weights, lengths, mix, *a: widths.append((prototypes.shape, len(mix))) or epoch(e, prototypes, weights, lengths, mix, *a))
    dealt()
    for n in (100, 400):
        df, meta = named(spark, n)
        fit_wsom(encode_sparse(df, meta), 2, 0.01, 5, 1)
    assert widths == [((4, 5), 1)] * 10
