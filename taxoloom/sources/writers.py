"""Triple and statistics sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import RDF_TYPE

# Column order of the statistics file.
STATS_COLUMNS = [
    "file", "n_classes", "n_individuals", "n_object_properties", "n_datatype_properties",
    "n_restrictions", "n_equiv_class", "n_levels", "n_roots", "n_leaves", "n_multi_parent",
    "avg_depth", "std_depth", "avg_branching", "std_branching", "avg_inst", "med_inst",
    "std_inst", "avg_leaf_inst", "med_leaf_inst", "std_leaf_inst", "n_empty_classes", "coverage",
]


# Characters that literals escape by a letter; other controls are written by their number.
_LETTERS = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def _numbered(c: Column, pattern: str) -> Column:
    """Characters of ``pattern`` as ``\\uXXXX``."""
    pieces = F.regexp_extract_all(c, F.lit(f"[{pattern}]|[^{pattern}]+"), F.lit(0))
    code = F.transform(
        pieces, lambda x: F.when(x.rlike(f"^[{pattern}]$"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(x)), 4, "0"))).otherwise(x)
    )
    return F.when(c.rlike(f"[{pattern}]"), F.array_join(code, "")).otherwise(c)


def escape(c: Column) -> Column:
    for char, text in _LETTERS:
        c = F.replace(c, F.lit(char), F.lit(text))
    return _numbered(c, r"\x00-\x07\x0B\x0E-\x1F\x7F")


def _iri(c: Column) -> Column:
    """An IRI in angle brackets; characters that cannot stand there are written by their number."""
    return F.concat(F.lit("<"), _numbered(c, r"\x00-\x20<>\"{}|^`\\\\"), F.lit(">"))


def _node(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(_iri(c))


def _lang(triples: DataFrame) -> Column:
    return F.col("o_lang") if "o_lang" in triples.columns else F.lit(None).cast("string")


def _literal(lang: Column, datatype: Column) -> Column:
    """The quoted ``o`` with its language or its written datatype."""
    quoted = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'))
    return (
        F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang))
        .when(F.col("o_datatype").isNotNull(), F.concat(quoted, F.lit("^^"), datatype))
        .otherwise(quoted)
    )


def ntriple_lines(triples: DataFrame) -> DataFrame:
    """One line per triple; a literal has its language (``o_lang``), else its datatype, else neither."""
    obj = (
        F.when(F.col("o_kind") == "uri", _iri(F.col("o")))
        .when(F.col("o_kind") == "blank", F.col("o"))
        .otherwise(_literal(_lang(triples), _iri(F.col("o_datatype"))))
    )
    return triples.select(F.concat_ws(" ", _node(F.col("s")), _iri(F.col("p")), obj, F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriple_lines(triples).write.text(path)


def turtle_statements(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``(s, subject, later, p, o)``: the texts of each triple, with prefixed names where they are plain."""

    def short(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for prefix, ns in prefixes.items():
            local = F.substr(c, F.lit(len(ns) + 1))
            fits = c.startswith(ns) & local.rlike(r"^[A-Za-z][A-Za-z0-9_-]*$")
            out = F.coalesce(out, F.when(fits, F.concat(F.lit(f"{prefix}:"), local)))
        return F.coalesce(out, _iri(c))

    obj = (
        F.when(F.col("o_kind") == "uri", short(F.col("o")))
        .when(F.col("o_kind") == "blank", F.col("o"))
        .otherwise(_literal(_lang(triples), short(F.col("o_datatype"))))
    )
    pred = F.when(F.col("p") == RDF_TYPE, F.lit("a")).otherwise(short(F.col("p")))
    subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(short(F.col("s")))
    return triples.select("s", subject.alias("subject"), (pred != "a").alias("later"), pred.alias("p"), obj.alias("o"))


def _streamed(head: str):
    """Rows in order to Turtle text: each depends on the row before it and the one after it."""

    def lines(rows: pa.Table, before: tuple | None, last: bool, mark: str) -> pa.Array:
        s, subject, p, o = (rows.column(c).combine_chunks() for c in ("s", "subject", "p", "o"))
        texts, n = [], len(s) if last else len(s) - 1
        keys = list(zip(s.to_pylist(), p.to_pylist(), o.to_pylist()))
        names = subject.to_pylist()
        for k in range(n):
            if keys[k] == (keys[k - 1] if k else before):
                texts.append(None)
                continue
            begins = (keys[k - 1] if k else before or (None,))[0] != keys[k][0]
            # Equal triples follow one another, so the next different one ends the subject or goes on.
            after = k + 1
            while after < len(keys) and keys[after] == keys[k]:
                after += 1
            ends = after == len(keys) or keys[after][0] != keys[k][0]
            text = f"{names[k] if begins else '   '} {keys[k][1]} {keys[k][2]}{' .' + chr(10) if ends else ' ;'}"
            texts.append(mark + text)
            mark = ""
        return pc.drop_null(pa.array(texts, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of the last triple are held until it is known what follows.
        held, before, mark = None, None, head

        def keep(rows: pa.Table) -> int:
            at = rows.num_rows - 1
            key = [rows.column(c)[at] for c in ("s", "p", "o")]
            while at and all(rows.column(c)[at - 1] == x for c, x in zip(("s", "p", "o"), key)):
                at -= 1
            return at

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            at = keep(rows)
            if at:
                out = lines(rows.slice(0, at + 1), before, False, mark)
                before = tuple(rows.column(c)[at - 1].as_py() for c in ("s", "p", "o"))
                mark = ""
                yield pa.RecordBatch.from_arrays([out], names=["value"])
            # One row stands for all that are equal.
            held = rows.slice(at, 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays([lines(held, before, True, mark)], names=["value"])

    return run


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """Write Turtle text; equal triples are written once.

    Triples are range-partitioned and sorted by subject and statement, and each becomes a line of its own, so
    nothing is gathered: a subject of any size streams through, and one that meets a file border begins
    again in the next file. Every part file starts with the prefixes.
    """
    head = "\n".join(f"@prefix {p}: <{ns}> ." for p, ns in prefixes.items()) + "\n\n"
    ordered = turtle_statements(triples, prefixes).orderBy("s", "later", "p", "o")
    ordered.select("s", "subject", "p", "o").mapInArrow(_streamed(head), "value string").write.text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.select(*STATS_COLUMNS).write.option("header", True).csv(path)
