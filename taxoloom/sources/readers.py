"""Table, configuration and triple sources."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import parsing
from ..metadata import Metadata, metadata_from_types
from .delimited import file_lines, joined_records, parse_records, spans_lines

# Texts read as a missing value in delimited files.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
FORMATS = ("csv", "tsv", "json", "parquet")

MALFORMED = "malformed triple"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
_IRI = r"^<([^>]*)>"
_NODE = r"<[^>\s]*>|_:[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-:\u00B7]*[\p{L}\p{N}_\-:\u00B7])?"
_QUOTED = r'"(?:[^"\\]|\\.)*"(?:\^\^<[^>\s]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?'
_TRIPLE = rf"^\s*({_NODE})\s*<([^>\s]*)>\s*({_NODE}|{_QUOTED})\s*\.\s*(?:#.*)?$"


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read a table; the format defaults to the file extension.

    Quoted cells of delimited files may hold line breaks, and large files are still split over tasks;
    a quoted cell that is not closed at the end of its file raises.
    """
    fmt = fmt or os.path.splitext(path)[1].lower().lstrip(".")
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported file format: .{fmt}")
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        df = _read_json(spark, path)
    else:
        df = _read_delimited(spark, path, "," if fmt == "csv" else "\t")
    if not df.columns or df.isEmpty():
        raise ValueError(f"nothing to read in {path}: it needs at least one row and one column")
    return df


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, parsing.NESTED_TYPES)]
    if nested:
        raise ValueError(f"only arrays of flat records are read; nested: {', '.join(nested)}")
    return df


def _read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Header row, NA texts as NULL, and a numeric type where every value is a number."""
    given = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("inferSchema", False)
    lines = file_lines(spark, path)
    if spans_lines(lines, sep):
        # The header, too, may hold a break.
        names = given.option("multiLine", True).csv(path).columns
        raw = parse_records(joined_records(lines, sep), names, sep)
    else:
        raw = given.option("multiLine", False).csv(path)
    if not raw.columns:
        return raw
    text = raw.select(
        *[
            F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c)
            for c in raw.columns
        ]
    )
    aggs = []
    for i, c in enumerate(raw.columns):
        ref = F.col(f"`{c}`")
        whole = F.trim(ref).rlike(r"^[+-]?\d+$")
        aggs += [
            F.count(ref).alias(f"n{i}"),
            F.count(parsing.as_number(ref, T.StringType())).alias(f"num{i}"),
            F.count(F.when(whole, F.trim(ref).try_cast("long"))).alias(f"int{i}"),
            F.count_if(F.trim(ref).isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"bool{i}"),
        ]
    got = text.agg(*aggs).first()
    out = []
    for i, c in enumerate(raw.columns):
        ref, n = F.col(f"`{c}`"), got[f"n{i}"]
        if n and got[f"int{i}"] == n:
            ref = F.trim(ref).cast("long")
        elif n and got[f"num{i}"] == n:
            ref = parsing.as_number(ref, T.StringType())
        elif n and got[f"bool{i}"] == n:
            ref = F.lower(F.trim(ref)).cast("boolean")
        out.append(ref.alias(c))
    return text.select(*out)


def meta_from_config(df: DataFrame, path: str) -> Metadata:
    """Column metadata from a JSON file ``{"columns": {name: {type, include}}}``."""
    setting = T.StructType(
        [T.StructField("type", T.StringType()), T.StructField("include", T.BooleanType())]
    )
    schema = T.StructType([T.StructField("columns", T.MapType(T.StringType(), setting))])
    row = df.sparkSession.read.schema(schema).option("multiLine", True).json(path).first()
    given = (row["columns"] if row else None) or {}
    types = {
        name: (s["type"] or "numeric", True if s["include"] is None else s["include"])
        for name, s in given.items()
    }
    return metadata_from_types(df, types)


def _statements(spark: SparkSession, path: str) -> DataFrame:
    """The lines of N-Triples files that are neither blank nor comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def malformed_lines(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """The sources that cannot be read or hold a line that is no triple, with the reason; one job for all."""
    bad: dict[str, str] = {}
    checked = None
    for name, path in paths.items():
        try:
            lines = _statements(spark, path).where(~F.col("line").rlike(_TRIPLE)).select(F.lit(name).alias("name"), "line")
        except AnalysisException as problem:
            bad[name] = str(problem)
            continue
        checked = lines if checked is None else checked.unionByName(lines)
    if checked is not None:
        for r in checked.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).collect():
            bad[r["name"]] = f"{r['n']} times {MALFORMED}: {r['line']}"
    return bad


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples from N-Triples files: one triple per line, so the input splits.

    ``o_datatype`` and ``o_lang`` are those of a literal; one with a language has the datatype
    ``rdf:langString``. A line that is neither a triple, a comment nor blank raises when it is read.
    """
    lines = _statements(spark, path)
    lines = lines.where(
        F.when(F.col("line").rlike(_TRIPLE), True).otherwise(F.raise_error(F.concat(F.lit(MALFORMED + ": "), "line")))
    )
    parts = lines.select(
        F.regexp_extract("line", _TRIPLE, 1).alias("subject"),
        F.regexp_extract("line", _TRIPLE, 2).alias("p"),
        F.regexp_extract("line", _TRIPLE, 3).alias("object"),
    )
    kind = (
        F.when(F.col("object").startswith("<"), "uri")
        .when(F.col("object").startswith("_:"), "blank")
        .otherwise("literal")
    )
    parts = parts.withColumn("o_kind", kind)
    lexical = F.regexp_extract("object", r'^"((?:[^"\\]|\\.)*)"', 1)
    datatype = F.regexp_extract("object", r'"\^\^<([^>]*)>$', 1)
    lang = F.regexp_extract("object", r'"@([A-Za-z0-9-]+)$', 1)
    literal = F.col("o_kind") == "literal"
    return parts.select(
        F.when(F.col("subject").startswith("<"), unescape(F.regexp_extract("subject", _IRI, 1)))
        .otherwise(F.col("subject"))
        .alias("s"),
        unescape(F.col("p")).alias("p"),
        F.when(F.col("o_kind") == "uri", unescape(F.regexp_extract("object", _IRI, 1)))
        .when(F.col("o_kind") == "blank", F.col("object"))
        .otherwise(unescape(lexical))
        .alias("o"),
        "o_kind",
        F.when(literal & (lang != ""), LANG_STRING).when(literal & (datatype != ""), datatype).alias("o_datatype"),
        F.when(literal & (lang != ""), lang).alias("o_lang"),
    )


# The escapes of one letter.
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_TOKEN = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|(?s)\\.|[^\\]+"


def unescape(c: Column) -> Column:
    """Undo N-Triples escapes, in one pass from left to right."""

    def plain(token: Column) -> Column:
        second = F.substring(token, 2, 1)
        out = F.when(~F.startswith(token, F.lit("\\")), token)
        for letter, char in _LETTERS.items():
            out = out.when(second == letter, F.lit(char))
        code = F.lpad(F.substring(token, 3, 8), 8, "0")
        return out.when(F.length(token) > 2, F.decode(F.unhex(code), "UTF-32")).otherwise(token)

    tokens = F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(tokens, plain), "")).otherwise(c)
