"""Formal concept analysis: the published iris lattice and a brute-force check."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from taxoloom.metadata import metadata_from_types
from taxoloom.operators import fca as f

IRIS = {
    "row_id": ("title_id", False),
    "Id": ("title_id", False),
    "Species": ("categorical", False),
}


def test_published_iris_lattice(iris):
    ctx = f.formal_context(iris, metadata_from_types(iris, IRIS), 3, "quantile")
    assert ctx.attributes.count() == 12 and ctx.objects.count() == 24
    lat = f.fca(ctx, 20)
    rows = lat.concepts.collect()
    levels = [sum(r["depth"] == d for r in rows) for d in range(5)]
    assert len(rows) == 95 and levels == [1, 11, 40, 39, 4] and not lat.cut
    assert sum(sum(c != f.NONE for c in r["intent"]) for r in rows) == 256
    rel = f.hasse(lat)
    parents = rel.groupBy("child").count().collect()
    assert sum(r["count"] > 1 for r in parents) == 83
    children = [r["count"] for r in rel.groupBy("parent").count().collect()]
    assert round(sum(children) / len(children), 3) == 3.155
    assert f.leaves(lat, rel).count() == 24
    typed = f.most_specific(lat)
    assert typed.count() == 150
    numbered = f.number_concepts(lat).orderBy("seq").collect()
    assert numbered[0]["id"] == "root" and numbered[1]["id"] == "c01" and numbered[-1]["id"] == "c94"


def brute(objects, max_depth):
    """Objects as tuples of codes; concepts as intents by breadth-first growth."""
    attrs = {(j, c) for o in objects for j, c in enumerate(o) if c != f.NONE}

    def intent(ext):
        out = []
        for j in range(len(objects[0])):
            seen = {objects[i][j] for i in ext}
            out.append(seen.pop() if len(seen) == 1 else f.NONE)
        return tuple(out)

    everything = frozenset(range(len(objects)))
    seen = {everything: 0}
    queue = [everything]
    while queue:
        ext = queue.pop(0)
        if seen[ext] >= max_depth:
            continue
        for j, c in attrs:
            got = frozenset(i for i in ext if objects[i][j] == c)
            if got and got not in seen:
                seen[got] = seen[ext] + 1
                queue.append(got)
    edges = set()
    for p, c in itertools.permutations(seen, 2):
        if p > c and not any(p > m > c for m in seen):
            edges.add((intent(p), intent(c)))
    minimal = set()
    for i in range(len(objects)):
        own = [e for e in seen if i in e]
        minimal |= {(i, intent(e)) for e in own if not any(o < e for o in own)}
    return {intent(e): d for e, d in seen.items()}, edges, minimal


@pytest.mark.parametrize("seed,depth", [(1, 1), (2, 2), (3, 3), (4, 10)])
def test_lattice_equals_brute_force(spark, seed, depth):
    rnd = random.Random(seed)
    rows = [
        tuple(None if rnd.random() < 0.15 else "xyz"[rnd.randrange(3)] for _ in range(4)) for _ in range(14)
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, a string, b string, c string, d string")
    meta = metadata_from_types(df, {"row_id": ("title_id", False), **{c: ("categorical", True) for c in "abcd"}})
    ctx = f.formal_context(df, meta)
    code = {(r["j"], r["value"]): r["code"] for r in ctx.attributes.collect()}
    objects = [tuple(f.NONE if v is None else code[j, v] for j, v in enumerate(r)) for r in rows]
    concepts, edges, minimal = brute(objects, depth)
    lat = f.fca(ctx, depth)
    assert {tuple(r["intent"]): r["depth"] for r in lat.concepts.collect()} == concepts
    assert {(tuple(r["parent"]), tuple(r["child"])) for r in f.hasse(lat).collect()} == edges
    assert {(r["row_id"], tuple(r["intent"])) for r in f.most_specific(lat).collect()} == minimal
    # Every concept but the top comes from one parent only.
    assert lat.tree.count() == lat.tree.select("child").distinct().count() == len(concepts) - 1
    sizes = {tuple(r["intent"]): r["size"] for r in lat.concepts.collect()}
    for share in (50_000, 2):
        cand = lat.concepts.select(F.col("intent").alias("cand"))
        for r in f.close(cand, ctx, share).collect():
            assert list(r["cand"]) == list(r["intent"]) and r["size"] == sizes[tuple(r["cand"])]


def test_closure_of_any_codes(spark):
    """Candidates that no concept fixes, with unknown codes, and with one code that most objects have."""
    rnd = random.Random(8)
    rows = [("k" if rnd.random() < 0.9 else "l", "xyz"[rnd.randrange(3)], "uvw"[rnd.randrange(3)]) for _ in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, a string, b string, c string")
    ctx = f.formal_context(df, metadata_from_types(df, {"row_id": ("title_id", False), **{c: ("categorical", True) for c in "abc"}}))
    code = {(r["j"], r["value"]): r["code"] for r in ctx.attributes.collect()}
    objects = [tuple(code[j, v] for j, v in enumerate(r)) for r in rows]
    cands = list(itertools.product([f.NONE, code[0, "k"], 99], [f.NONE, code[1, "x"]], [f.NONE, code[2, "u"], code[2, "v"]]))
    expected = {}
    for c in cands:
        inside = [o for o in objects if all(x in (f.NONE, y) for x, y in zip(c, o))]
        if inside:
            expected[c] = (tuple(o.pop() if len(o) == 1 else f.NONE for o in map(set, zip(*inside))), len(inside))
    given = spark.createDataFrame([(list(c),) for c in cands * 2], "cand array<int>")
    found = {tuple(r["cand"]): (tuple(r["intent"]), r["size"]) for r in f.close(given, ctx, share=4).collect()}
    assert found == expected


def test_bins(spark):
    df = spark.createDataFrame(
        [(i, float(i), 1.0, f"2020-01-{i + 1:02d}" if i != 3 else None) for i in range(9)],
        "row_id long, x double, k double, d string",
    )
    meta = metadata_from_types(df, {"row_id": ("title_id", False), "d": ("date", True)})
    quant = f.context_columns(df, meta, 2, "quantile")
    assert [c.name for c in quant] == ["x", "d"] and quant[0].edges == [0.0, 4.0, 8.0]
    codes = {r["row_id"]: (r["v0"], r["v1"]) for r in f.context_rows(df, quant).collect()}
    assert codes[3] == (0, None) and codes[4][0] == 1 and codes[8][0] == 1
    even = f.context_columns(df, meta, 4, "uniform")
    assert even[0].edges == [-0.008, 2.0, 4.0, 6.0, 8.0]
    assert even[1].bins()[-1][1].endswith("2020-01-09]")
    with pytest.raises(ValueError):
        f.context_columns(df, meta, 2, "other")
