"""Types, summaries, quantiles and encodings on the edge tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxoloom.functions import quantiles as q
from taxoloom.metadata import metadata_from_types
from taxoloom.operators.encode import encode, encode_long
from taxoloom.operators.predicate import Restriction as R
from taxoloom.operators.profile import available_restrictions, concept_stats, concept_stats_all, detect_types, summarise
from taxoloom.operators.taxonomy import Taxonomy


def types(df):
    return {m.name: m.detected_type for m in detect_types(df)}


def test_types_of_typed_columns(spark):
    df = spark.sql(
        "select id, cast(id as double) x, id % 2 = 0 b, cast(id as decimal(10,2)) d, date'2020-01-01' + cast(id as int) day, "
        "timestamp_ntz'2020-01-01' t, cast(null as string) nothing, cast('nan' as double) nan from range(5)"
    )
    assert types(df) == {
        "id": "numeric", "x": "numeric", "b": "numeric", "d": "numeric", "day": "date", "t": "date",
        "nothing": "categorical", "nan": "categorical",
    }
    with pytest.raises(ValueError):
        detect_types(spark.sql("select array(1) a"))


@pytest.mark.parametrize("good,number,date", [(79, "categorical", "categorical"), (80, "categorical", "categorical"), (81, "numeric", "date")])
def test_share_of_parseable_text(spark, good, number, date):
    rows = [(i, str(i % 7) if i < good else "x", "2020-01-05" if i < good else "soon") for i in range(100)]
    df = spark.createDataFrame(rows, "k long, n string, d string").drop("k")
    assert types(df) == {"n": number, "d": date}


def test_identifier_rules(spark):
    n = 1000
    rows = [
        (
            f"v{i if i <= 950 else 0}",  # 951 / 1000: unique enough
            f"v{i if i < 950 else 0}",  # 950 / 1000: more than 100 values, over half
            f"v{i % 500}",  # half: not an identifier
            f"v{i % 100}",
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert types(df) == {"a": "title_id", "b": "title_id", "c": "categorical", "d": "categorical"}
    few = [(f"v{min(i, 8)}", f"v{min(i, 8)}", f"v{min(i, 7)}") for i in range(10)]
    df = spark.createDataFrame(few, "width string, plain string, code string")
    assert types(df) == {"width": "title_id", "plain": "categorical", "code": "categorical"}


def test_number_and_date_texts(spark):
    texts = {" 2 ": 2.0, "1e3": 1000.0, "+5": 5.0, ".5": 0.5, "5.": 5.0, "inf": float("inf"), "-Infinity": float("-inf"),
             "1d": None, "2f": None, "0x10": None, "1,000": None, "1_0": None, "nan": None, "": None, "True": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    m = metadata_from_types(df, {})["t"]
    assert {r["t"]: r["x"] for r in df.select("t", m.number.alias("x")).collect()} == texts
    dates = {"2020-01-02": "2020-01-02 00:00:00", "2020-01-02 03:04": "2020-01-02 03:04:00", "2020-01-02T03:04:05": "2020-01-02 03:04:05",
             "2020-01-02 03:04:05.123": "2020-01-02 03:04:05.123", "2020/3/4": "2020-03-04 00:00:00", "01/02/2020": "2020-01-02 00:00:00",
             "13/02/2020": "2020-02-13 00:00:00", "Jan 5 2020": "2020-01-05 00:00:00", "2020": "2020-01-01 00:00:00",
             "2020-13-01": None, "12:30": None, "later": None}
    df = spark.createDataFrame([(t,) for t in dates], "t string")
    m = metadata_from_types(df, {"t": ("date", True)})["t"]
    assert {r["t"]: r["x"] for r in df.select("t", m.time.cast("string").alias("x")).collect()} == dates


def test_overrides(spark):
    meta = metadata_from_types(spark.sql("select 1 a, 'x' b"), {"b": ("title_id", True)})
    assert [m.name for m in meta.usable()] == ["a"]
    meta.set("b", user_type="categorical").set("a", include=False)
    assert [m.name for m in meta.usable()] == ["b"]
    with pytest.raises(ValueError):
        meta.set("a", user_type="odd")
    with pytest.raises(KeyError):
        meta.set("zz", include=True)


def test_iris_summary(iris):
    rows = {r["column"]: r for r in summarise(iris, metadata_from_types(iris, {"Species": ("categorical", True)}), "row_id").collect()}
    s, p = rows["SepalLengthCm"], rows["PetalLengthCm"]
    assert (s["min"], s["max"], s["mean"], s["median"], s["std"]) == (4.3, 7.9, 5.8433, 5.8, 0.8281)
    assert (p["min"], p["max"], p["mean"], p["median"], p["std"]) == (1.0, 6.9, 3.7587, 4.35, 1.7644)
    assert [tuple(t) for t in rows["Species"]["top_values"]] == [("Iris-setosa", 50), ("Iris-versicolor", 50), ("Iris-virginica", 50)]


def test_summaries_with_missing_values(spark):
    df = spark.createDataFrame(
        [(0, 1.0, "a", "2020-01-01", "x"), (1, float("nan"), None, "2020-01-03 12:00", "7"), (2, None, "a", "?", None), (3, 4.0, "b", None, "8")],
        "id long, x double, c string, d string, n string",
    )
    meta = metadata_from_types(df, {"id": ("title_id", False), "c": ("categorical", True), "d": ("date", True)})
    rows = {r["column"]: r for r in summarise(df, meta, "id").collect()}
    assert (rows["x"]["count"], rows["x"]["missing"], rows["x"]["mean"], rows["x"]["max"]) == (2, 2, 2.5, 4.0)
    # Unparseable text counts as present.
    assert (rows["n"]["count"], rows["n"]["missing"], rows["n"]["mean"]) == (3, 1, 7.5)
    assert (rows["d"]["count"], rows["d"]["min_date"], rows["d"]["max_date"], rows["d"]["range_days"]) == (3, "2020-01-01", "2020-01-03", 2)
    assert rows["c"]["n_unique"] == 2 and rows["c"]["missing"] == 1
    assert rows["id"]["sample_values"] == ["0", "1", "2", "3"]


def test_concept_statistics(iris):
    meta = metadata_from_types(iris, {"row_id": ("title_id", False), "Id": ("title_id", False), "Species": ("categorical", True)})
    tax = Taxonomy(iris, meta)
    big = tax.add_subconcept(tax.root_id, [R("PetalLengthCm", ">=", 4.1)])
    none = tax.add_subconcept(tax.root_id, [R("PetalLengthCm", ">", 99)])
    single = tax.add_subconcept(tax.root_id, [R("Id", "=", 1)])
    one = tax.add_subconcept(tax.root_id, [R("SepalLengthCm", "=", 7.9)])
    assert concept_stats(tax, none).count() == 0 and available_restrictions(tax, none).count() == 0
    rows = {r["column"]: r for r in concept_stats(tax, big).collect()}
    assert len(rows) == 5 and rows["PetalLengthCm"]["min"] == 4.1
    assert sum(t["count"] for t in rows["Species"]["top_values"]) == 84
    every = {(r["concept_id"], r["column"]): r for r in concept_stats_all(tax).collect()}
    assert every[big, "PetalLengthCm"]["mean"] == rows["PetalLengthCm"]["mean"]
    assert every[one, "SepalLengthCm"]["std"] is None and (none, "Species") not in every
    assert single in {c for c, _ in every}
    left = available_restrictions(tax, one).count()
    assert left == 0
    offered = available_restrictions(tax, big).where("column = 'Species'").select("value").collect()
    assert sorted(r[0] for r in offered) == ["Iris-versicolor", "Iris-virginica"]


@pytest.mark.parametrize("kind", ["normal", "heavy", "spread", "few"])
def test_bracketed_quantiles_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(q, "SORTED_ROWS", 20)
    monkeypatch.setattr(q, "ACCURACY", 50)
    rnd = random.Random(kind)
    make = {
        "normal": lambda: rnd.gauss(0, 1),
        "heavy": lambda: 3.0 if rnd.random() < 0.4 else rnd.gauss(3, 1),
        "spread": lambda: 10.0 ** rnd.uniform(-200, 200),
        "few": lambda: float(rnd.randrange(3)),
    }[kind]
    values = [make() for _ in range(4000)]
    df = spark.createDataFrame([(v if i % 50 else None, float(i)) for i, v in enumerate(values)], "x double, y double")
    ps = [0.0, 0.05, 1 / 3, 0.5, 0.77, 0.95, 1.0]
    shares = "array({})".format(", ".join(f"{p!r}d" for p in ps))
    direct = df.selectExpr(f"percentile(x, {shares}) as x", "percentile(y, array(0.5d)) as y").first()
    assert q.exact_quantiles(df, {"x": ps, "y": [0.5]}) == {"x": list(direct["x"]), "y": list(direct["y"])}
    empty = df.where("x > 1e308")
    assert q.exact_quantiles(empty, {"x": [0.5]}) == {"x": [None]}


def test_encoding(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 5.0, "b", "2020-01-01"), (1, 3.0, 5.0, "a", "2020-01-02"), (2, None, 5.0, None, None)],
        "row_id long, x double, k double, a string, a_b string",
    )
    meta = metadata_from_types(df, {"row_id": ("title_id", False), "a": ("categorical", True), "a_b": ("date", True)})
    enc = encode(df, meta)
    known = enc.features.orderBy("feature_idx").collect()
    assert [f["feature_name"] for f in known] == ["x", "k", "a_a", "a_b", "a_b"]
    assert [f["column"] for f in known] == ["x", "k", "a", "a", "a_b"]
    rows = {r["row_id"]: r["features"] for r in enc.df.collect()}
    h = 0.5**0.5
    assert np.allclose(rows[0], [-h, 0, 0, 1, -h]) and np.allclose(rows[1], [h, 0, 1, 0, h]) and rows[2] == [0.0] * 5
    # A column whose name starts another's is ignored alone.
    assert [s.column for s in encode(df, meta, ignore=["a"]).spans] == ["x", "k", "a_b"]
    long, features = encode_long(df, meta)
    names = {r["feature_idx"]: r["feature_name"] for r in features.collect()}
    assert names == {0: "x", 1: "k", 2: "a_a", 3: "a_b", 4: "a_b"}
    cells = {(r["row_id"], r["feature_idx"]): r["value"] for r in long.collect()}
    dense = {(i, j): v for i, fs in rows.items() for j, v in enumerate(fs) if v}
    assert cells.keys() == dense.keys() and all(cells[k] == pytest.approx(dense[k]) for k in cells)
    none = encode(df, metadata_from_types(df, {c: ("title_id", False) for c in df.columns}))
    assert none.width == 0 and none.features.count() == 0 and all(r["features"] == [] for r in none.df.collect())


def test_wide_categories(spark):
    df = spark.range(6000).selectExpr("id as row_id", "format_string('%05d \"é\\\\', id) as c", "id % 2 as x")
    meta = metadata_from_types(df, {"row_id": ("title_id", False), "c": ("categorical", True)})
    enc = encode(df, meta)
    assert enc.width == 6001
    hot = enc.df.selectExpr("row_id", "array_position(slice(features, 1, 6000), 1d) as at", "aggregate(slice(features, 1, 6000), 0d, (a, b) -> a + b) as n")
    assert hot.where("at <> row_id + 1 or n <> 1").count() == 0
    assert encode_long(df, meta)[0].where("value = 1").count() == 6000


def test_z_scores_of_iris(iris):
    meta = metadata_from_types(iris, {"row_id": ("title_id", False), "Species": ("title_id", False)})
    x = np.array([r["features"] for r in encode(iris, meta).df.collect()])
    assert np.allclose(x.mean(axis=0), 0) and np.allclose(x.std(axis=0, ddof=1), 1)
    assert iris.select(F.max("row_id")).first()[0] == 149
