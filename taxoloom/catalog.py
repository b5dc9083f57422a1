"""The registered queries: every operator on the relational test tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.names import OWL, RDF_TYPE, RDFS, XSD, decimal_text, safe_name
from .metadata import Metadata, metadata_from_types
from .operators import discover as som
from .operators import fca, hac, rdf, stats
from .operators import restriction_search as search
from .operators.encode import Encoded, SparseEncoded, encode, encode_long, encode_sparse
from .operators.predicate import Restriction as R, interval, restriction_to_column, restrictions_to_column
from .operators.profile import (
    available_restrictions,
    concept_stats,
    concept_stats_all,
    detect_types,
    summarise,
)
from .operators.taxonomy import Taxonomy
from .plans.local import local_frame
from .plans.scratch import scratch_path, settle
from .plans.session import configure
from .sources import meta_from_config, read_ntriples, read_table, with_row_id, write_ntriples, write_stats, write_turtle

CONCEPT_NS = "http://example.org/orders/schema#"
ENTITY_NS = "http://example.org/orders/data/"
PREFIXES = {"": CONCEPT_NS, "ent": ENTITY_NS, "owl": OWL, "rdfs": RDFS, "xsd": XSD}
#: All tables but ``embeddings``, whose vectors are no cells of a flat table.
PROFILED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "pages", "benchmark", "labels", "conversations",
)

ORDERS = {
    "o_orderkey": ("title_id", False),
    "o_custkey": ("numeric", False),
    "o_orderstatus": ("categorical", True),
    "o_totalprice": ("numeric", True),
    "o_orderdate": ("date", True),
    "o_orderpriority": ("categorical", True),
}
LINEITEM = {
    "l_orderkey": ("title_id", False),
    "l_partkey": ("title_id", False),
    "l_suppkey": ("title_id", False),
    "l_returnflag": ("categorical", True),
    "l_linestatus": ("categorical", True),
    "l_shipdate": ("date", True),
}
CUSTOMER = {
    "c_custkey": ("title_id", False),
    "c_name": ("title_id", False),
    "c_nationkey": ("numeric", True),
    "c_mktsegment": ("categorical", True),
}
SUPPLIER = {"s_suppkey": ("title_id", False), "s_name": ("title_id", False)}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark, sf_dir) -> tuple[DataFrame, Metadata]:
    df = table(spark, sf_dir, "orders")
    return df, metadata_from_types(df, ORDERS)


def lineitem(spark, sf_dir) -> tuple[DataFrame, Metadata]:
    df = table(spark, sf_dir, "lineitem")
    return df, metadata_from_types(df, LINEITEM)


def customers(spark, sf_dir) -> tuple[DataFrame, Metadata]:
    df = table(spark, sf_dir, "customer")
    return df, metadata_from_types(df, CUSTOMER)


EXPENSIVE = [R("o_totalprice", ">=", 300000)]
URGENT = [R("o_orderpriority", "=", "1-URGENT")]


def orders_taxonomy(spark, sf_dir, recompute: str = "derived") -> Taxonomy:
    """Eight concepts over orders that use every kind of definition but merge."""
    df, meta = orders(spark, sf_dir)
    tax = Taxonomy(df, meta, "o_orderkey", recompute)
    c1 = tax.add_subconcept(tax.root_id, EXPENSIVE, "Expensive")
    c2 = tax.add_subconcept(tax.root_id, URGENT, "Urgent")
    tax.complement([c1, c2])
    tax.union([c1, c2])
    tax.intersection([c1, c2], "Urgent Expensive")
    c6 = tax.add_subconcept(c1, [R("o_orderdate", ">=", "1997-01-01"), R("o_orderstatus", "=", "F")], "Late")
    tax.complement([c6])
    return tax


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# -- sources and sinks --------------------------------------------------------


def _json_arrays(lines: DataFrame, path: str) -> None:
    """One JSON array of records per part file."""

    def wrap(batches):
        mark = "["
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(value=[mark + pdf["value"].iloc[0], *("," + pdf["value"].iloc[1:])])
                mark = ","
        if mark == ",":
            yield pd.DataFrame({"value": ["]"]})

    lines.mapInPandas(wrap, "value string").write.text(path)


@query("src_1")
def src_1(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    df = read_table(spark, path, "csv")
    meta = metadata_from_types(df, ORDERS)
    return df.withColumn("o_orderdate", F.date_format(meta["o_orderdate"].time, "yyyy-MM-dd"))


@query("src_2")
def src_2(spark, sf_dir):
    path = scratch_path(spark, "customer-tsv")
    table(spark, sf_dir, "customer").write.option("header", True).option("sep", "\t").csv(path)
    return read_table(spark, path, "tsv")


@query("src_3")
def src_3(spark, sf_dir):
    path = scratch_path(spark, "part-json")
    df = table(spark, sf_dir, "part")
    _json_arrays(df.select(F.to_json(F.struct("*")).alias("value")), path)
    return read_table(spark, path, "json").select(*df.columns)


@query("src_4")
def src_4(spark, sf_dir):
    """Readable or not, per table and format name."""
    rows = []
    for name in PROFILED:
        for fmt in ("parquet", "xlsx"):
            try:
                read_table(spark, f"{sf_dir}/{name}.parquet", fmt)
                rows.append((name, fmt, True))
            except ValueError:
                rows.append((name, fmt, False))
    return local_frame(spark, rows, "table_name string, format string, readable boolean")


@query("src_5")
def src_5(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/supplier.parquet")


@query("src_6")
def src_6(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    numbered = with_row_id(df).select("row_id", "c_custkey")
    keyed = with_row_id(df, "c_custkey").select(F.col("row_id").alias("key_id"), "c_custkey")
    return numbered.join(keyed, "c_custkey")


@query("src_7")
def src_7(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    found = detect_types(df)
    setting = {m.name: {"type": m.user_type, "include": m.include} for m in found if m.name != "o_custkey"}
    path = scratch_path(spark, "config")
    local_frame(spark, [(json.dumps({"columns": setting}),)], "value string").coalesce(1).write.text(path)
    return meta_from_config(df, path).to_df(spark).select(
        F.col("column").alias("column_name"), "ordinal", "user_type", "include"
    )


@query("src_8")
def src_8(spark, sf_dir):
    df, meta = customers(spark, sf_dir)
    path = scratch_path(spark, "customer-nt")
    write_ntriples(rdf.row_triples(df, meta, CONCEPT_NS, ENTITY_NS, "c_custkey"), path)
    return read_ntriples(spark, path)


@query("snk_1")
def snk_1(spark, sf_dir):
    df, meta = customers(spark, sf_dir)
    path = scratch_path(spark, "customer-nt")
    write_ntriples(rdf.row_triples(df, meta, CONCEPT_NS, ENTITY_NS, "c_custkey"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("snk_2")
def snk_2(spark, sf_dir):
    df, meta = customers(spark, sf_dir)
    triples = rdf.row_triples(df, meta, CONCEPT_NS, ENTITY_NS, "c_custkey")
    path = scratch_path(spark, "customer-ttl")
    write_turtle(triples, path, PREFIXES)
    # A block ends with a full stop and an empty line, as the prefixes before the first one do.
    records = spark.read.option("lineSep", " .\n\n").text(path).where(~F.col("value").startswith("@prefix"))
    name = F.regexp_extract("value", "^ent:(\\S+)", 1)
    # A subject that met a file border has several blocks.
    statement = F.explode(F.split(F.regexp_replace("value", "^ent:\\S+ ", ""), " ;\n    ")).alias("po")
    parts = records.select(name.alias("name"), statement).groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct((~F.startswith("po", F.lit("a "))).alias("later"), "po"))).alias("parts")
    )
    text = F.concat(F.lit("ent:"), "name", F.lit(" "), F.array_join(F.transform("parts", lambda x: x["po"]), " ;\n    "), F.lit(" .\n"))
    return parts.select(F.concat(F.lit(ENTITY_NS), "name").alias("s"), text.alias("block_text"))


@query("snk_3")
def snk_3(spark, sf_dir):
    path = scratch_path(spark, "stats-csv")
    write_stats(stats.taxonomy_stats(orders_triples(spark, sf_dir), "orders"), path)
    return spark.read.option("header", True).csv(path).select(
        "file",
        F.col("n_classes").cast("long"),
        F.col("n_individuals").cast("long"),
        F.col("n_leaves").cast("long"),
        F.col("coverage").cast("double"),
    )


@query("snk_4")
def snk_4(spark, sf_dir):
    path = scratch_path(spark, "taxonomy")
    tax = orders_taxonomy(spark, sf_dir)
    tax.save(path)
    again = Taxonomy.load(tax.df, path, "o_orderkey")
    held = spark.read.parquet(f"{path}/membership").groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return again.sizes().join(held, "concept_id")


# -- types and summaries ------------------------------------------------------


@query("typ_1")
def typ_1(spark, sf_dir):
    parts = []
    for name in PROFILED:
        meta = detect_types(table(spark, sf_dir, name)).to_df(spark)
        parts.append(
            meta.select(
                F.lit(name).alias("table_name"),
                F.col("column").alias("column_name"),
                "ordinal",
                "detected_type",
                "include",
            )
        )
    return _all(parts)


@query("typ_2")
def typ_2(spark, sf_dir):
    meta = detect_types(table(spark, sf_dir, "part"))
    meta.set("p_size", user_type="categorical").set("p_retailprice", include=False)
    return meta.to_df(spark).select(
        F.col("column").alias("column_name"), "detected_type", "user_type", "include"
    )


@query("typ_3")
def typ_3(spark, sf_dir):
    meta = detect_types(table(spark, sf_dir, "customer")).set("c_custkey", include=False)
    return local_frame(spark, [(m.name, m.user_type) for m in meta.usable()], "column_name string, user_type string")


def _numbers(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("type") == "numeric").select(
        F.col("column").alias("column_name"),
        F.col("count").alias("n"),
        "missing",
        "mean",
        "median",
        "std",
        F.col("min").alias("lo"),
        F.col("max").alias("hi"),
    )


@query("sum_1")
def sum_1(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    return _numbers(summarise(df, metadata_from_types(df, {})))


@query("sum_2")
def sum_2(spark, sf_dir):
    parts = []
    for name, column in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
        df = table(spark, sf_dir, name).select(column)
        summary = summarise(df, metadata_from_types(df, {column: ("date", True)}))
        parts.append(
            summary.select(
                F.col("column").alias("column_name"), F.col("count").alias("n"), "missing", "min_date", "max_date", "range_days"
            )
        )
    return _all(parts)


@query("sum_3")
def sum_3(spark, sf_dir):
    df, meta = customers(spark, sf_dir)
    return summarise(df.select("c_custkey", "c_name"), _only(meta, "c_name"), "c_custkey").select(
        F.col("column").alias("column_name"),
        F.col("count").alias("n"),
        "missing",
        "n_unique",
        F.array_join("sample_values", "|").alias("samples"),
    )


def _only(meta: Metadata, *names: str) -> Metadata:
    return Metadata({n: meta[n] for n in names})


def _top_rows(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.col("column").alias("column_name"), "n_unique", F.inline("top_values")
    ).select("column_name", "n_unique", "value", F.col("count").alias("n"))


@query("sum_4")
def sum_4(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name")
    return _top_rows(summarise(df, metadata_from_types(df, {c: ("categorical", True) for c in df.columns})))


@query("sum_5")
def sum_5(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    top = F.transform("top_values", lambda x: F.concat_ws(":", x["value"], x["count"].cast("string")))
    return summarise(df, meta, "o_orderkey").select(
        F.col("column").alias("column_name"),
        "ordinal",
        F.col("type").alias("kind"),
        F.col("count").alias("n"),
        "missing",
        "mean",
        "median",
        "std",
        F.col("min").alias("lo"),
        F.col("max").alias("hi"),
        "min_date",
        "max_date",
        "range_days",
        "n_unique",
        F.array_join(top, "|").alias("top_text"),
        F.array_join("sample_values", "|").alias("samples"),
    )


def _stats_rows(df: DataFrame, *extra: str) -> DataFrame:
    top = F.transform("top_values", lambda x: F.concat_ws(":", x["value"], x["count"].cast("string")))
    return df.select(
        *extra,
        F.col("column").alias("column_name"),
        F.col("type").alias("kind"),
        "mean",
        "std",
        F.col("min").alias("lo"),
        F.col("max").alias("hi"),
        "mean_date",
        "min_date",
        "max_date",
        F.array_join(top, "|").alias("top_text"),
    )


@query("sum_7")
def sum_7(spark, sf_dir):
    df, meta = lineitem(spark, sf_dir)
    tax = Taxonomy(df, meta, "l_orderkey")
    return _stats_rows(concept_stats(tax, tax.add_subconcept(tax.root_id, [R("l_quantity", ">=", 25)])))


@query("sum_7_all")
def sum_7_all(spark, sf_dir):
    return _stats_rows(concept_stats_all(orders_taxonomy(spark, sf_dir)), "concept_id")


@query("sum_8")
def sum_8(spark, sf_dir):
    tax = orders_taxonomy(spark, sf_dir)
    return available_restrictions(tax, "c1").select(
        F.col("column").alias("column_name"),
        F.col("type").alias("kind"),
        F.array_join("operators", " ").alias("operators"),
        "value",
        F.col("min").alias("lo"),
        F.col("max").alias("hi"),
        "mean",
        "median",
        "min_date",
        "max_date",
    )


# -- encoding -----------------------------------------------------------------


def _cells(enc: Encoded) -> DataFrame:
    # Adding zero turns -0.0 into 0.0.
    cells = enc.df.select(enc.key, F.posexplode("features").alias("feature_idx", "x"))
    names = enc.features.select(F.col("feature_idx").cast("int").alias("feature_idx"), "feature_name")
    return cells.join(names, "feature_idx").select(enc.key, "feature_idx", "feature_name", (F.round("x", 4) + F.lit(0.0)).alias("x"))


@query("enc_1")
def enc_1(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    return _cells(encode(df, _only(meta, "o_totalprice"), "o_orderkey"))


@query("enc_2")
def enc_2(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    return _cells(encode(df, _only(meta, "o_orderdate"), "o_orderkey"))


@query("enc_3")
def enc_3(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    return _cells(encode(df, _only(meta, "o_orderpriority"), "o_orderkey"))


@query("enc_3_long")
def enc_3_long(spark, sf_dir):
    df, meta = customers(spark, sf_dir)
    meta.set("c_name", user_type="categorical", include=True)
    cells, features = encode_long(df, meta, "c_custkey")
    return cells.withColumnRenamed("value", "x").join(features, "feature_idx").select(
        "c_custkey", "feature_idx", "feature_name", (F.round("x", 4) + F.lit(0.0)).alias("x")
    )


@query("enc_4")
def enc_4(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    return _cells(encode(df, meta, "o_orderkey"))


@query("enc_5")
def enc_5(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    return _cells(encode(df, meta, "o_orderkey", ignore=["o_orderdate", "o_orderpriority"]))


# -- predicates ---------------------------------------------------------------


@query("prd_1")
def prd_1(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    return df.where(restriction_to_column(URGENT[0], meta)).select("o_orderkey", "o_orderpriority")


@query("prd_2")
def prd_2(spark, sf_dir):
    df, meta = lineitem(spark, sf_dir)
    parts = []
    for op in ("=", ">", ">=", "<", "<="):
        hit = restriction_to_column(R("l_quantity", op, 25), meta)
        parts.append(F.count_if(hit).alias(op))
    wide = df.agg(*parts)
    return wide.select(
        F.inline(
            F.array(*[F.struct(F.lit(o).alias("operator"), F.col(f"`{o}`").alias("n")) for o in ("=", ">", ">=", "<", "<=")])
        )
    )


@query("prd_3")
def prd_3(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    return df.where(restriction_to_column(R("o_orderdate", "<=", "1996-06-30"), meta)).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@query("prd_4")
def prd_4(spark, sf_dir):
    df, meta = lineitem(spark, sf_dir)
    rs = [
        R("l_quantity", ">", 10),
        R("l_discount", "<=", 0.05),
        R("l_returnflag", "=", "A"),
        R("l_shipdate", ">=", "1998-01-01"),
    ]
    return df.where(restrictions_to_column(rs, meta)).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("prd_5")
def prd_5(spark, sf_dir):
    df, meta = lineitem(spark, sf_dir)
    return df.where(restrictions_to_column(interval("l_extendedprice", 20000, 30000), meta)).select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )


# -- concepts -----------------------------------------------------------------


@query("con_1")
def con_1(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    tax = Taxonomy(df, meta, "o_orderkey")
    return tax.rows(tax.root_id).select("o_orderkey")


def _rows(tax: Taxonomy, concept: str) -> DataFrame:
    return tax.rows(concept).select(tax.key)


@query("con_2")
def con_2(spark, sf_dir):
    return _rows(orders_taxonomy(spark, sf_dir), "c6")


@query("con_3")
def con_3(spark, sf_dir):
    return _rows(orders_taxonomy(spark, sf_dir), "c3")


@query("con_4")
def con_4(spark, sf_dir):
    return _rows(orders_taxonomy(spark, sf_dir), "c4")


@query("con_5")
def con_5(spark, sf_dir):
    return _rows(orders_taxonomy(spark, sf_dir), "c5")


@query("con_6")
def con_6(spark, sf_dir):
    df, meta = lineitem(spark, sf_dir)
    tax = Taxonomy(df, meta, "l_orderkey")
    parts = [
        tax.add_subconcept(tax.root_id, interval("l_quantity", 1, 20), "a"),
        tax.add_subconcept(tax.root_id, interval("l_quantity", 10, 30), "b"),
        tax.add_subconcept(tax.root_id, interval("l_quantity", 30, 60), "c"),
        tax.add_subconcept(tax.root_id, [R("l_returnflag", "=", "R")], "d"),
    ]
    made = tax.find_intersections(parts)
    names = local_frame(
        spark,
        [(i, "".join(tax[s].name for s in tax[i].source_ids)) for i in made], "concept_id string, pair string"
    )
    return tax.sizes(made).join(names, "concept_id").select("pair", "size")


@query("con_7")
def con_7(spark, sf_dir):
    df, meta = lineitem(spark, sf_dir)
    tax = Taxonomy(df, meta, "l_orderkey")
    a = tax.add_subconcept(tax.root_id, interval("l_quantity", 5, 15))
    b = tax.add_subconcept(tax.root_id, interval("l_quantity", 20, 30))
    return tax.rows(tax.merge([a, b])).select("l_orderkey", "l_linenumber", "l_quantity")


@query("con_8")
def con_8(spark, sf_dir):
    tax = orders_taxonomy(spark, sf_dir)
    tax.update("c1", restrictions=[R("o_totalprice", ">=", 250000)], name="Pricey")
    return tax.nodes().select("id", "name", "size", "coverage")


@query("con_8_snapshot")
def con_8_snapshot(spark, sf_dir):
    tax = orders_taxonomy(spark, sf_dir, "snapshot")
    tax.update("c1", restrictions=[R("o_totalprice", ">=", 250000)], name="Pricey")
    return tax.nodes().select("id", "name", "size", "coverage")


@query("con_9")
def con_9(spark, sf_dir):
    tax = orders_taxonomy(spark, sf_dir)
    tax.delete("c1")
    return tax.nodes().select("id", "size", "coverage")


@query("con_10")
def con_10(spark, sf_dir):
    tax = orders_taxonomy(spark, sf_dir)
    tax.reset()
    return tax.nodes().select("id", "name", "size", "coverage")


@query("con_11")
def con_11(spark, sf_dir):
    return orders_taxonomy(spark, sf_dir).membership()


@query("con_12")
def con_12(spark, sf_dir):
    return orders_taxonomy(spark, sf_dir).sizes()


@query("con_13")
def con_13(spark, sf_dir):
    return orders_taxonomy(spark, sf_dir).coverage()


@query("con_14")
def con_14(spark, sf_dir):
    return orders_taxonomy(spark, sf_dir).nodes().select(
        "id",
        "name",
        "origin",
        "size",
        "coverage",
        F.array_join("parent_ids", ",").alias("parents"),
        F.array_join("child_ids", ",").alias("children"),
    )


@query("con_14_edges")
def con_14_edges(spark, sf_dir):
    """The edges of the graph with the rows that pass along each."""
    tax = orders_taxonomy(spark, sf_dir)
    return tax.edges().join(tax.sizes(), F.col("child_id") == F.col("concept_id")).select(
        "parent_id", "child_id", "ord", "size"
    )


@query("con_17")
def con_17(spark, sf_dir):
    tax = orders_taxonomy(spark, sf_dir)
    return tax.nodes().select("id", "seq", "size")


# -- discovery ----------------------------------------------------------------


def _som_input(spark, sf_dir) -> SparseEncoded:
    df, meta = orders(spark, sf_dir)
    return encode_sparse(df, meta, "o_orderkey")


def _fit(spark, sf_dir):
    enc = _som_input(spark, sf_dir)
    return enc, som.fit_wsom(enc, seed=7)


@query("som_1")
def som_1(spark, sf_dir):
    """Which settings are accepted, with the suggested epochs for the table."""
    n = table(spark, sf_dir, "orders").count()
    rows = []
    for size, epochs in ((1, 20), (2, 5), (20, 5000), (21, 20), (5, 4), (5, 5001)):
        try:
            som.check_parameters(size, epochs)
            ok = True
        except ValueError:
            ok = False
        rows.append((size, epochs, ok, som.suggested_epochs(n)))
    return local_frame(spark, rows, "map_size int, epochs int, accepted boolean, suggested int")


@query("som_2")
def som_2(spark, sf_dir):
    book = som.init_codebook(_som_input(spark, sf_dir), 5, 7)
    start = local_frame(spark, [(i, [float(x) for x in b]) for i, b in enumerate(book)], "unit int, row array<double>")
    return start.select("unit", F.posexplode("row").alias("feature_idx", "x")).withColumn(
        "x", F.round("x", 4) + F.lit(0.0)
    )


@query("som_3")
def som_3(spark, sf_dir):
    _, model = _fit(spark, sf_dir)
    cells = [(u, j, round(float(x), 6) + 0.0) for u, row in enumerate(model.prototypes) for j, x in enumerate(row)]
    return local_frame(spark, cells, "unit int, feature_idx int, x double")


@query("som_4")
def som_4(spark, sf_dir):
    _, model = _fit(spark, sf_dir)
    return local_frame(
        spark,
        [(e, round(d, 6), c, round(x, 6)) for e, d, c, x in model.history], "epoch int, dist double, units int, loss double"
    )


@query("som_5")
def som_5(spark, sf_dir):
    enc, model = _fit(spark, sf_dir)
    return som.assign_bmu(enc, model)


@query("som_6")
def som_6(spark, sf_dir):
    enc, model = _fit(spark, sf_dir)
    best, weight = som.select_best_column(enc.spans, model.gate)
    return local_frame(
        spark,
        [(c, round(w, 6), c == best) for c, w in weight.items()], "column_name string, weight double, best boolean"
    )


@query("som_7")
def som_7(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    clustered = df.withColumn("cluster", (F.col("o_orderkey") % 5).cast("int"))
    best = search.best_values(clustered, "cluster", meta["o_orderpriority"], "o_orderkey")
    return best.select("cluster", "value", F.round("f1", 6).alias("f1"), "support", "hits")


def _ranges(spark, found: dict) -> DataFrame:
    rows = []
    for c, f in found.items():
        low = next((float(r.value) for r in f.restrictions if r.operator == ">="), None)
        high = next((float(r.value) for r in f.restrictions if r.operator == "<"), None)
        rows.append((c, low, high, round(f.f1, 6), f.support))
    return local_frame(spark, rows, "cluster int, low double, high double, f1 double, support long")


@query("som_8")
def som_8(spark, sf_dir):
    df, meta = lineitem(spark, sf_dir)
    s = search.search_for(df, "l_linenumber", meta["l_quantity"], "l_orderkey")
    return _ranges(spark, search.characterise(s, sorted(s.sizes)))


@query("som_9")
def som_9(spark, sf_dir):
    df, meta = lineitem(spark, sf_dir)
    s = search.search_for(df, "l_linenumber", meta["l_shipdate"], "l_orderkey")
    rows = [
        (c, f.restrictions[0].operator, f.restrictions[0].value[:10], round(f.f1, 6), f.support)
        for c, f in search.characterise(s, sorted(s.sizes)).items()
    ]
    return local_frame(spark, rows, "cluster int, operator string, day string, f1 double, support long")


@query("som_10")
def som_10(spark, sf_dir):
    """F1 of one restriction against every order status."""
    df, meta = orders(spark, sf_dir)
    hit = restriction_to_column(EXPENSIVE[0], meta)
    marked = df.select("o_orderstatus", F.coalesce(hit, F.lit(False)).alias("hit"))
    per = marked.groupBy("o_orderstatus").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("size"))
    total = marked.agg(F.count_if("hit").alias("n")).first()["n"]
    score = search.f1_column(F.col("hits"), F.lit(total), F.col("size"))
    return per.select("o_orderstatus", F.round(score, 6).alias("f1"))


def _merged(spark, sf_dir):
    """Clusters of line items by price band and line, characterised by price."""
    df, meta = lineitem(spark, sf_dir)
    band = F.least(F.floor(F.col("l_extendedprice") / 12000), F.lit(7)) * 2 + F.col("l_linenumber") % 2
    df = df.withColumn("cluster", band.cast("int"))
    s = search.search_for(df, "cluster", meta["l_extendedprice"], "l_orderkey")
    found = search.characterise(s, sorted(s.sizes))
    centres = {c: [1.0, c / 4.0] for c in s.sizes}
    return s, found, centres


@query("som_11")
def som_11(spark, sf_dir):
    s, found, centres = _merged(spark, sf_dir)
    return _ranges(spark, dict(enumerate(search.merge_clusters(s, found, centres, 0.05))))


@query("som_12")
def som_12(spark, sf_dir):
    s, found, _ = _merged(spark, sf_dir)
    return _ranges(spark, dict(enumerate(search.dedupe([f for f in found.values() if f]))))


@query("som_13")
def som_13(spark, sf_dir):
    s, found, _ = _merged(spark, sf_dir)
    kept = search.drop_subsets(s, search.dedupe([f for f in found.values() if f]))
    return _ranges(spark, dict(enumerate(kept)))


def _discovered(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    tax = Taxonomy(df, meta, "o_orderkey")
    return tax, som.discover(tax, tax.root_id, seed=7)


@query("som_14")
def som_14(spark, sf_dir):
    tax, _ = _discovered(spark, sf_dir)
    return tax.nodes().select("id", "origin", "proposed", "size", "coverage")


@query("som_14_wide")
def som_14_wide(spark, sf_dir):
    """Discovery over customers with a feature for every name."""
    df, meta = customers(spark, sf_dir)
    meta.set("c_name", user_type="categorical", include=True)
    tax = Taxonomy(df, meta, "c_custkey")
    som.discover(tax, tax.root_id, seed=7)
    return tax.nodes().select("id", "origin", "proposed", "size", "coverage")


@query("som_15")
def som_15(spark, sf_dir):
    tax, got = _discovered(spark, sf_dir)
    tax.add_subconcept(tax.root_id, EXPENSIVE, "Expensive")
    som.resolve(tax, "cancel")
    return tax.nodes().select("name", "size", "coverage", "proposed")


# -- formal concepts ----------------------------------------------------------


def _context(spark, sf_dir, *names: str, strategy: str = "quantile") -> fca.FormalContext:
    df, meta = orders(spark, sf_dir)
    for m in meta:
        m.include = m.name in names
    return fca.formal_context(df, meta, 3, strategy, "o_orderkey")


CONTEXT = ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _attribute_rows(ctx: fca.FormalContext) -> DataFrame:
    """The attributes that occur, with their number of rows."""
    held = (
        ctx.objects.select("n", F.posexplode("obj").alias("j", "code"))
        .groupBy("j", "code")
        .agg(F.sum("n").alias("n_rows"))
    )
    return ctx.attributes.join(held, ["j", "code"])


@query("fca_1")
def fca_1(spark, sf_dir):
    ctx = _context(spark, sf_dir, "o_orderstatus", "o_orderpriority")
    return _attribute_rows(ctx).select(F.col("name").alias("attribute"), "n_rows")


def _bins(ctx: fca.FormalContext) -> DataFrame:
    return _attribute_rows(ctx).select(
        F.col("code").alias("bin"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n_rows"
    )


@query("fca_2")
def fca_2(spark, sf_dir):
    return _bins(_context(spark, sf_dir, "o_totalprice"))


@query("fca_3")
def fca_3(spark, sf_dir):
    return _bins(_context(spark, sf_dir, "o_totalprice", strategy="uniform"))


@query("fca_4")
def fca_4(spark, sf_dir):
    return _bins(_context(spark, sf_dir, "o_orderdate"))


@query("fca_5")
def fca_5(spark, sf_dir):
    ctx = _context(spark, sf_dir, *CONTEXT)
    return ctx.rows.select("o_orderkey", *[F.col(f"v{j}").cast("string").alias(c.name) for j, c in enumerate(ctx.columns)])


@query("fca_6")
def fca_6(spark, sf_dir):
    ctx = _context(spark, sf_dir, *CONTEXT)
    return ctx.objects.select(*[F.col(f"v{j}").cast("string").alias(c.name) for j, c in enumerate(ctx.columns)], "n")


@query("fca_7")
def fca_7(spark, sf_dir):
    """Closures of all single attributes."""
    ctx = _context(spark, sf_dir, *CONTEXT)
    single = F.array(*[F.when(F.col("j") == j, F.col("code")).otherwise(F.lit(fca.NONE)) for j in range(len(ctx.columns))])
    closed = fca.close(ctx.attributes.select(single.alias("cand")), ctx)
    return fca.describe(closed, ctx).select(*[c.name for c in ctx.columns], "size")


@query("fca_8")
def fca_8(spark, sf_dir):
    ctx = _context(spark, sf_dir, *CONTEXT)
    found = fca.fca(ctx).concepts
    return fca.describe(found, ctx).select(*[c.name for c in ctx.columns], "size", "depth")


def _named_intent(ctx: fca.FormalContext, concepts: DataFrame, name: str) -> DataFrame:
    texts = [F.coalesce(F.col(c.name), F.lit("*")) for c in ctx.columns]
    return fca.describe(concepts, ctx).select(F.col("intent"), F.concat_ws("/", *texts).alias(name))


@query("fca_9")
def fca_9(spark, sf_dir):
    ctx = _context(spark, sf_dir, *CONTEXT)
    lat = fca.fca(ctx)
    pairs, found = fca.hasse(lat), lat.concepts.select("intent")
    up = _named_intent(ctx, found, "parent_name").withColumnRenamed("intent", "parent")
    down = _named_intent(ctx, found, "child_name").withColumnRenamed("intent", "child")
    return pairs.join(up, "parent").join(down, "child").select("parent_name", "child_name")


@query("fca_10")
def fca_10(spark, sf_dir):
    ctx = _context(spark, sf_dir, *CONTEXT)
    lat = fca.fca(ctx)
    names = _named_intent(ctx, lat.concepts.select("intent"), "concept")
    return fca.most_specific(lat).join(names, "intent").select("o_orderkey", "concept")


@query("fca_11")
def fca_11(spark, sf_dir):
    ctx = _context(spark, sf_dir, *CONTEXT)
    lat = fca.fca(ctx)
    return fca.describe(fca.leaves(lat, fca.hasse(lat)), ctx).select(*[c.name for c in ctx.columns], "size")


@query("fca_12")
def fca_12(spark, sf_dir):
    """Axiom triples of the lattice."""
    df, meta = orders(spark, sf_dir)
    ctx = _context(spark, sf_dir, *CONTEXT)
    lat = fca.fca(ctx)
    named = fca.number_concepts(lat).withColumn("uri", F.concat(F.lit(CONCEPT_NS), F.col("id")))
    return rdf.intent_axioms(named, lat, meta, CONCEPT_NS)


# -- hierarchical clustering --------------------------------------------------


def _suppliers(spark, sf_dir) -> Encoded:
    df = table(spark, sf_dir, "supplier")
    return encode(df, metadata_from_types(df, SUPPLIER), "s_suppkey")


@query("hac_1")
def hac_1(spark, sf_dir):
    return hac.hac(_suppliers(spark, sf_dir)).merges.withColumn("distance", F.round("distance", 6))


@query("hac_1_totals")
def hac_1_totals(spark, sf_dir):
    merges = hac.hac(_suppliers(spark, sf_dir), "complete").merges
    return merges.agg(F.count(F.lit(1)).alias("n_merges"), F.max("size").alias("root_size"))


@query("hac_1_average")
def hac_1_average(spark, sf_dir):
    return hac.hac(_suppliers(spark, sf_dir), "average", "cityblock").merges.withColumn("distance", F.round("distance", 6))


@query("hac_2")
def hac_2(spark, sf_dir):
    df, meta = customers(spark, sf_dir)
    small = hac.micro_clusters(encode(df, meta, "c_custkey"), 40, seed=1)
    return hac.cut_tree(hac.hac(small), 3)[1]


@query("hac_3")
def hac_3(spark, sf_dir):
    return hac.cut_tree(hac.hac(_suppliers(spark, sf_dir)), 3)[0]


@query("hac_4")
def hac_4(spark, sf_dir):
    """A table of one row (the totals of all suppliers) is the root alone."""
    df = table(spark, sf_dir, "supplier").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s_nationkey").alias("k")
    )
    meta = metadata_from_types(df, {"n": ("title_id", False)})
    return hac.cut_tree(hac.hac(encode(df, meta, "n")), 3)[1].select("concept_id", "n")


@query("hac_5")
def hac_5(spark, sf_dir):
    return hac.to_taxonomy(hac.hac(_suppliers(spark, sf_dir)), 4)[0]


@query("hac_5_rows")
def hac_5_rows(spark, sf_dir):
    """Every row is held by exactly one leaf of the cut."""
    member = hac.to_taxonomy(hac.hac(_suppliers(spark, sf_dir)), 4)[1]
    return member.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n_leaves"))


# -- OWL export ---------------------------------------------------------------


def orders_triples(spark, sf_dir) -> DataFrame:
    """The whole orders taxonomy, row properties included."""
    return rdf.export_triples(orders_taxonomy(spark, sf_dir), CONCEPT_NS, ENTITY_NS)


@query("rdf_1")
def rdf_1(spark, sf_dir):
    """Namespaces without an ending get one."""
    df, meta = customers(spark, sf_dir)
    tax = Taxonomy(df, meta, "c_custkey")
    t = rdf.export_triples(tax, CONCEPT_NS.rstrip("#"), ENTITY_NS.rstrip("/"))
    return t.where((F.col("p") == RDF_TYPE) & F.col("o").startswith(CONCEPT_NS)).select("s", "o")


@query("rdf_2")
def rdf_2(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    texts = _all([part.select(F.col(c).alias("text")) for c in ("p_name", "p_brand", "p_type")]).distinct()
    return texts.select("text", safe_name(F.col("text")).alias("local"))


@query("rdf_3")
def rdf_3(spark, sf_dir):
    tax = orders_taxonomy(spark, sf_dir)
    names = local_frame(spark, list(rdf.name_map(tax).items()), "concept_id string, name string")
    return names.join(tax.sizes(), "concept_id")


@query("rdf_4")
def rdf_4(spark, sf_dir):
    meta = detect_types(table(spark, sf_dir, "customer"))
    return rdf.property_triples(spark, meta, CONCEPT_NS).select("s", "p", "o")


@query("rdf_5")
def rdf_5(spark, sf_dir):
    """Class triples, each with the rows of its class."""
    tax = orders_taxonomy(spark, sf_dir)
    uris = local_frame(spark, list(rdf.class_uris(tax, CONCEPT_NS).items()), "concept_id string, s string")
    return rdf.class_triples(tax, CONCEPT_NS).join(uris.join(tax.sizes(), "concept_id"), "s").select("s", "p", "o", "size")


@query("rdf_6")
def rdf_6(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    return rdf.value_triples(df, meta, CONCEPT_NS).select("s", "p", "o", "o_kind")


def _axioms(spark, sf_dir, *concepts: str) -> DataFrame:
    tax = orders_taxonomy(spark, sf_dir)
    heads = [rdf.class_uris(tax, CONCEPT_NS)[c] for c in concepts]
    of = F.regexp_extract("s", "^_:(c[0-9]+)_", 1).isin(*concepts) | F.col("s").isin(*heads)
    return rdf.axiom_triples(tax, CONCEPT_NS).where(of).select("s", "p", "o", "o_datatype")


@query("rdf_7")
def rdf_7(spark, sf_dir):
    return _axioms(spark, sf_dir, "c1")


@query("rdf_8")
def rdf_8(spark, sf_dir):
    return _axioms(spark, sf_dir, "c3", "c7")


@query("rdf_9")
def rdf_9(spark, sf_dir):
    return _axioms(spark, sf_dir, "c4", "c5")


@query("rdf_10")
def rdf_10(spark, sf_dir):
    return _axioms(spark, sf_dir, "c2", "c6")


@query("rdf_11")
def rdf_11(spark, sf_dir):
    tax = orders_taxonomy(spark, sf_dir)
    types = rdf.type_triples(rdf.concept_types(tax, CONCEPT_NS), ENTITY_NS, "o_orderkey")
    declared = rdf.row_triples(tax.df, tax.meta, CONCEPT_NS, ENTITY_NS, "o_orderkey").where(F.col("p") == RDF_TYPE)
    return types.unionByName(declared).select("s", "o")


@query("rdf_11_specific")
def rdf_11_specific(spark, sf_dir):
    tax = orders_taxonomy(spark, sf_dir)
    return rdf.concept_types(tax, CONCEPT_NS, "most_specific")


@query("rdf_12")
def rdf_12(spark, sf_dir):
    df, meta = orders(spark, sf_dir)
    return rdf.row_triples(df, meta, CONCEPT_NS, ENTITY_NS, "o_orderkey").where(F.col("p") != RDF_TYPE).select(
        "s", "p", "o", "o_kind", "o_datatype", "o_lang"
    )


@query("rdf_13")
def rdf_13(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_extendedprice", decimal_text(F.col("l_extendedprice")).alias("lexical")).distinct()


@query("rdf_collisions")
def rdf_collisions(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", "url")
    meta = metadata_from_types(df, {"page_id": ("title_id", False), "url": ("categorical", True)})
    return rdf.uri_collisions(df, meta, CONCEPT_NS)


# -- statistics ---------------------------------------------------------------


def _classes(spark, sf_dir):
    t = stats.structure(orders_triples(spark, sf_dir))
    # Settled, so that the planner knows how small they are beside the triples.
    return t, settle(stats.named_classes(t), "classes"), settle(stats.subclass_edges(t), "edges")


@query("sta_1")
def sta_1(spark, sf_dir):
    return _classes(spark, sf_dir)[1]


@query("sta_2")
def sta_2(spark, sf_dir):
    return _classes(spark, sf_dir)[2]


@query("sta_3")
def sta_3(spark, sf_dir):
    t, classes, _ = _classes(spark, sf_dir)
    return stats.individuals(t, classes)


@query("sta_4")
def sta_4(spark, sf_dir):
    _, classes, edges = _classes(spark, sf_dir)
    parts = [
        stats.roots(classes, edges).withColumn("role", F.lit("root")),
        stats.leaf_classes(classes, edges).withColumn("role", F.lit("leaf")),
        stats.multi_parent(edges).select("class", F.lit("multi_parent").alias("role")),
    ]
    return _all(parts)


@query("sta_5")
def sta_5(spark, sf_dir):
    _, classes, edges = _classes(spark, sf_dir)
    return stats.class_depths(classes, edges)


def _stat_columns(spark, sf_dir, *names: str) -> DataFrame:
    return stats.taxonomy_stats(orders_triples(spark, sf_dir), "orders").select(*names)


@query("sta_6")
def sta_6(spark, sf_dir):
    return _stat_columns(spark, sf_dir, "n_levels", "avg_depth", "std_depth")


@query("sta_7")
def sta_7(spark, sf_dir):
    _, _, edges = _classes(spark, sf_dir)
    return stats.branching(edges)


@query("sta_8")
def sta_8(spark, sf_dir):
    t, classes, _ = _classes(spark, sf_dir)
    return stats.instance_counts(t, classes)


@query("sta_9")
def sta_9(spark, sf_dir):
    t, classes, _ = _classes(spark, sf_dir)
    return stats.instance_counts(t, classes).agg(F.count_if(F.col("n") == 0).alias("n_empty_classes"))


@query("sta_10")
def sta_10(spark, sf_dir):
    t, classes, edges = _classes(spark, sf_dir)
    return stats.coverage(t, classes, edges)


@query("sta_11")
def sta_11(spark, sf_dir):
    t, classes, _ = _classes(spark, sf_dir)
    return stats.axiom_counts(t, classes)


@query("sta_12")
def sta_12(spark, sf_dir):
    df, meta = customers(spark, sf_dir)
    plain = rdf.export_triples(Taxonomy(df, meta, "c_custkey"), CONCEPT_NS, ENTITY_NS)

    path = scratch_path(spark, "malformed")
    table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).write.text(path)
    return stats.stats_of_many(spark, {"orders": orders_triples(spark, sf_dir), "bad": path, "customers": plain})
