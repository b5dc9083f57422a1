"""Readers, row ids and reliable intermediate tables."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from taxoloom.functions.names import RDF_TYPE
from taxoloom.operators.rdf import TRIPLE, entity
from taxoloom.operators.stats import BadOntology, stats_of_many
from taxoloom.plans.numbering import contiguous_ids
from taxoloom.plans.scratch import checkpoint_root, settle
from taxoloom.sources import meta_from_config, read_ntriples, read_table, with_row_id, write_ntriples, write_turtle
from taxoloom.sources.delimited import file_lines, joined_records, parse_records


def test_delimited(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('n,s,w,b,q\n1, x ,1.5,True,"a,""b"""\nNA,nan,2,False,\n 3 ,None,inf,,z\n')
    df = read_table(spark, str(p))
    assert dict(df.dtypes) == {"n": "bigint", "s": "string", "w": "double", "b": "boolean", "q": "string"}
    assert [tuple(r) for r in df.collect()] == [
        (1, " x ", 1.5, True, 'a,"b"'), (None, None, 2.0, False, None), (3, None, float("inf"), None, "z")]
    t = tmp_path / "t.tsv"
    t.write_text("a\tb\n1\tx,y\n")
    assert [tuple(r) for r in read_table(spark, str(t)).collect()] == [(1, "x,y")]


def test_json_and_rejections(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert read_table(spark, str(p)).count() == 2
    nested = tmp_path / "n.json"
    nested.write_text('{"a": {"0": 1, "1": 2}}')
    with pytest.raises(ValueError):
        read_table(spark, str(nested))
    with pytest.raises(ValueError):
        read_table(spark, "t.xlsx")
    empty = tmp_path / "e.csv"
    empty.write_text("a,b\n")
    with pytest.raises(ValueError):
        read_table(spark, str(empty))


def test_config(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"columns": {"b": {"type": "categorical", "include": False}, "c": {"include": False}, "d": {"type": "date"}}}))
    meta = meta_from_config(spark.sql("select 1 a, 'x' b, 2 c, 'y' d"), str(p))
    assert [(m.name, m.user_type, m.include) for m in meta] == [
        ("a", "numeric", True), ("b", "categorical", False), ("c", "numeric", False), ("d", "date", True)]
    p.write_text(json.dumps({"columns": {"a": {"type": "odd"}}}))
    with pytest.raises(ValueError):
        meta_from_config(spark.sql("select 1 a"), str(p))


def test_row_ids_are_contiguous(spark):
    df = spark.range(1000).repartition(7)
    ids = with_row_id(df)
    assert sorted(r["row_id"] for r in ids.collect()) == list(range(1000))
    assert ids.exceptAll(ids).isEmpty()
    ordered = contiguous_ids(df, "n", [F.desc("id")], start=5)
    assert ordered.where("n <> 1004 - id").isEmpty()
    assert with_row_id(df, "id").where("row_id <> id").isEmpty()
    assert contiguous_ids(df.where("id < 0"), "n").count() == 0


def test_equal_keys_do_not_break_numbering(spark):
    df = spark.range(900).selectExpr("id", "cast(id > 300 as int) as hot")
    got = contiguous_ids(df, "n", ["hot", "id"])
    assert got.where("n <> id").isEmpty()


def test_settled_tables_live_in_the_shared_folder(spark):
    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    out = settle(spark.range(3))
    assert out.count() == 3 and out.inputFiles()[0].startswith(("file:" + root, "file://" + root))


def test_quoted_line_breaks_and_blank_cells(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_text('k,v\n1,"a\nb"\n2," "\n3," NA "\n4,NA\n')
    got = read_table(spark, str(path)).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a\nb"), (2, " "), (3, " NA "), (4, None)]
    path.write_text('k,v\n1,"a\nb"\n2,"open\n3,x\n')
    with pytest.raises(ValueError, match="not closed"):
        read_table(spark, str(path))


def breaking_csv(seed, n):
    """Records and their text: breaks, doubled quotes, separators, blank lines and quotes inside plain cells."""
    r = random.Random(seed)
    cells = ["x", "5\" pipe", "a,b", 'say ""hi""'.replace('""', '"'), "two\nlines", "three\n\nlines\n", '"', "\n", ",\n\"q\",", "é" * 9, "c\r\nd"]
    rows, out = [], []
    for k in range(n):
        row = [str(k), r.choice(cells), r.choice(cells), r.choice(["end", "end", 'q"\n"', "z"])]
        rows.append(tuple(row))
        text = [c if c in ("x", "5\" pipe") or (c in ("end", "z") and r.random() < 0.5) else '"' + c.replace('"', '""') + '"' for c in row]
        out.append(",".join(text) + r.choice(["\n", "\n", "\r\n", "\n\n"]))
    return rows, "k,a,b,c\n" + "".join(out)


@pytest.mark.parametrize("seed, split", [(1, 1 << 20), (2, 97), (3, 400), (4, 33)])
def test_breaks_in_cells_are_read_by_many_tasks(spark, tmp_path, seed, split):
    rows, text = breaking_csv(seed, 200)
    other, more = breaking_csv(seed + 50, 3)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.csv").write_bytes(text.encode())
    (tmp_path / "t" / "a.csv").write_bytes(more.encode())
    assert [tuple(x) for x in csv.reader(io.StringIO(text, newline="")) if x][1:] == rows
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        path = str(tmp_path / "t")
        lines = file_lines(spark, path)
        assert split > 1000 or lines.rdd.getNumPartitions() > 8
        records = joined_records(lines, ",")
        got = with_row_id(parse_records(records, ["k", "a", "b", "c"], ",")).orderBy("row_id").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [r["row_id"] for r in got] == list(range(203))
    assert [(r["k"], r["a"], r["b"], r["c"]) for r in got] == other + rows
    assert read_table(spark, path, "csv").count() == 203


def test_ids_follow_file_names(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("k\n" + "".join(f"a{i}\n" for i in range(3)))
    (tmp_path / "t" / "b.csv").write_text("k\n" + "".join(f"b{i}\n" for i in range(497)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        df = read_table(spark, str(tmp_path / "t"), "csv")
        for table in (df, df.where("k <> 'a1'"), df.repartition(5)):
            got = with_row_id(table).orderBy("row_id").collect()
            names = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(497)]
            names = [k for k in names if k != "a1" or len(got) == 500]
            # Rows that were dealt out again keep the order of their files, not that inside a block.
            order = (lambda x: x[0]) if table.rdd.getNumPartitions() == 5 else (lambda x: names.index(x))
            assert sorted(r["k"] for r in got) == sorted(names) and [r["k"] for r in got] == sorted((r["k"] for r in got), key=order)
            assert [r["row_id"] for r in got] == list(range(len(got)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_every_form_of_triple_is_read(spark, tmp_path):
    path = tmp_path / "t.nt"
    path.write_text(
        "# comment\n\n<a><p><b>.\n<a> <p> \"x\"@en-GB . # end\n_:n <p> \"caf\\u00e9 \\U0001F600 \\\\u0041 \\' \\b\" .\n"
        '<a> <p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .\n',
        encoding="utf-8",
    )
    got = {tuple(r) for r in read_ntriples(spark, str(path)).collect()}
    assert got == {
        ("a", "p", "b", "uri", None, None),
        ("a", "p", "x", "literal", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en-GB"),
        ("_:n", "p", "café 😀 \\u0041 ' \b", "literal", None, None),
        ("a", "p", "1", "literal", "http://www.w3.org/2001/XMLSchema#integer", None),
    }


def test_malformed_triples_raise_and_statistics_skip_them(spark, tmp_path):
    bad, good = tmp_path / "bad.nt", tmp_path / "good.nt"
    bad.write_text("<a> <p> <b> .\nnot a triple\n")
    good.write_text("<a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#Class> .\n")
    with pytest.raises(Exception, match="malformed triple"):
        read_ntriples(spark, str(bad)).count()
    table = stats_of_many(spark, {"bad": str(bad), "good": str(good), "gone": str(tmp_path / "no")})
    assert [r["file"] for r in table.collect()] == ["good"]

    def lost():
        raise MemoryError("executor lost")

    with pytest.raises(MemoryError):
        stats_of_many(spark, {"lost": lost})

    def broken():
        # A fault of the batch is not a bad input.
        return read_ntriples(spark, str(good)).withColumn("p", F.raise_error(F.lit("malformed triple of another kind")).cast("string"))

    with pytest.raises(Exception, match="another kind"):
        stats_of_many(spark, {"broken": broken, "good": str(good)})
    with pytest.raises(BadOntology):
        stats_of_many(spark, {"bad": str(bad)})


TAGGED = [
    '<http://e/a> <http://e/p> "caf\\u0000b \\\\u0041 \\"q\\" \\n\\r\\t\\b\\f \\u007F"@en-GB .',
    '<http://e/a> <http://e/p> "back\\\\slash"^^<http://e/type> .',
    '<http://e/a\\u0020b> <http://e/p> <http://e/\\u003Cx\\u003E> .',
    '_:n1 <http://e/p> "plain é 😀" .',
    '_:n1 <http://e/p> _:n2 .',
    '_:n1 <http://e/p> ""@de .',
]


def test_a_tagged_and_escaped_file_comes_back_as_it_was(spark, tmp_path):
    (tmp_path / "one.nt").write_text("\n".join(TAGGED) + "\n", encoding="utf-8")
    first = read_ntriples(spark, str(tmp_path / "one.nt"))
    write_ntriples(first, str(tmp_path / "two"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "two")).collect()) == sorted(TAGGED)
    again = read_ntriples(spark, str(tmp_path / "two"))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, first.collect()), key=repr)
    texts = {(r["o"], r["o_lang"]) for r in first.collect()}
    assert ('caf\0b \\u0041 "q" \n\r\t\b\f \x7f', "en-GB") in texts and ("back\\slash", None) in texts and ("", "de") in texts


def turtle_triples(text):
    """The statements of Turtle text as this library writes it."""
    out, prefixes = [], 0
    for block in text.split(" .\n\n"):
        lines = [x for x in block.split("\n") if not x.startswith("@prefix") and x]
        prefixes += block.count("@prefix")
        if lines:
            subject, rest = "\n".join(lines).split(" ", 1)
            out += [(subject, *po.split(" ", 1)) for po in rest.split(" ;\n    ")]
    return out, prefixes


@pytest.mark.parametrize("parts", [1, 5])
def test_turtle_streams_a_large_subject(spark, tmp_path, parts):
    rows = [("http://e/hub", "http://e/p", f"v{i % 700}", "literal", None, "en" if i % 3 else None) for i in range(1500)]
    rows += [("http://e/hub", RDF_TYPE, "http://e/Hub", "uri", None, None)] * 2
    rows += [(f"http://e/s{i}", "http://e/p", "http://e/hub", "uri", None, None) for i in range(40)]
    df = spark.createDataFrame(rows, TRIPLE).repartition(3)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_turtle(df, str(tmp_path / "ttl"), {"e": "http://e/"})
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    files = [p.read_text() for p in sorted((tmp_path / "ttl").glob("part-*")) if p.read_text()]
    assert len(files) == parts
    found = []
    for text in files:
        assert text.startswith("@prefix e: <http://e/> .\n\ne:") and text.endswith(" .\n\n")
        got, prefixes = turtle_triples(text)
        assert prefixes == 1
        found += got
    expected = {("e:" + s[9:], "a" if p == RDF_TYPE else "e:p", f"e:{o[9:]}" if k == "uri" else f'"{o}"' + ("@en" if lang else "")) for s, p, o, k, _, lang in rows}
    assert len(found) == len(expected) and set(found) == expected


def test_text_keys_make_valid_iris(spark, tmp_path):
    rows = spark.createDataFrame([("a b>c", 1)], "k string, n long").select(
        entity("http://e/", F.col("k")).alias("s"), F.lit("http://e/p").alias("p"), F.lit("x").alias("o"),
        F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"),
    )
    write_ntriples(rows, str(tmp_path / "iris"))
    assert [r["s"] for r in read_ntriples(spark, str(tmp_path / "iris")).collect()] == ["http://e/entity_a%20b%3Ec"]
