"""Semantic types, column summaries, concept statistics and restriction domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import parsing
from ..functions.quantiles import exact_quantiles
from ..metadata import ColumnMeta, Metadata

# Thresholds and words of type detection and summaries.
PARSE_SHARE = 0.8
ID_UNIQUENESS = 0.95
ID_CATEGORIES = 100
ID_CATEGORIES_UNIQUENESS = 0.5
ID_NAME_UNIQUENESS = 0.8
ID_NAME_WORDS = ("id", "name", "title", "key", "code", "identifier", "uuid")
TOP_VALUES = 10
TOP_CONCEPT_VALUES = 5
SAMPLE_VALUES = 5


def value_counts(df: DataFrame, columns: list[ColumnMeta], keys: list[str] | None = None) -> DataFrame:
    """``(keys…, column, value, n)`` over the non-missing values of ``columns``.

    Counts are combined inside each task before the one shuffle, so a value
    that fills a third of the rows moves once per task.
    """
    keys = keys or []
    cells = F.array(*[F.struct(F.lit(m.name).alias("column"), m.text.alias("value")) for m in columns])
    return (
        df.select(*[F.col(k) for k in keys], F.inline(cells))
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(counts: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """The ``k`` most frequent values per column; ties go to the smaller value."""
    keys = keys or []
    order = Window.partitionBy(*keys, "column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# -- types --------------------------------------------------------------------


def detect_types(df: DataFrame) -> Metadata:
    """Infer the semantic type of every column.

    One aggregate over all columns settles everything except identifiers;
    exact distinct counts follow only for the text columns left undecided, over
    128-bit digests, so that long texts are not shuffled.
    """
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, parsing.NESTED_TYPES)]
    if nested:
        raise ValueError(f"flatten nested columns first: {', '.join(nested)}")
    fields = df.schema.fields
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(parsing.present(c, f.dataType)).alias(f"n{i}"))
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.count(parsing.as_number(c, f.dataType)).alias(f"num{i}"))
            aggs.append(F.count(parsing.as_time(c, f.dataType)).alias(f"date{i}"))
    got = df.agg(*aggs).first()

    found: dict[str, str] = {}
    undecided: dict[str, int] = {}
    for i, f in enumerate(fields):
        n = got[f"n{i}"]
        if n == 0:
            found[f.name] = "categorical"
        elif parsing.is_numeric(f.dataType):
            found[f.name] = "numeric"
        elif parsing.is_date(f.dataType):
            found[f.name] = "date"
        elif not isinstance(f.dataType, T.StringType):
            found[f.name] = "categorical"
        elif got[f"num{i}"] / n > PARSE_SHARE:
            found[f.name] = "numeric"
        elif got[f"date{i}"] / n > PARSE_SHARE:
            found[f.name] = "date"
        else:
            undecided[f.name] = n

    if undecided:
        cells = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.unhex(F.md5(F.col(f"`{c}`"))).alias("value"))
                for c in undecided
            ]
        )
        distinct = (
            df.select(F.inline(cells))
            .where(F.col("value").isNotNull())
            .distinct()
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        for row in distinct:
            found[row["column"]] = _text_type(row["column"], row["n"], undecided[row["column"]])

    meta = Metadata()
    for i, f in enumerate(fields):
        kind = found[f.name]
        meta.columns[f.name] = ColumnMeta(f.name, i, f.dataType, kind, kind, kind != "title_id")
    return meta


def _text_type(name: str, n_unique: int, n: int) -> str:
    share = n_unique / n
    named_like_id = any(word in name.lower() for word in ID_NAME_WORDS)
    if (
        share > ID_UNIQUENESS
        or (n_unique > ID_CATEGORIES and share > ID_CATEGORIES_UNIQUENESS)
        or (named_like_id and share > ID_NAME_UNIQUENESS)
    ):
        return "title_id"
    return "categorical"


# -- summaries ----------------------------------------------------------------

SUMMARY_SCHEMA = (
    "column string, ordinal int, type string, count bigint, missing bigint, "
    "mean double, median double, std double, min double, max double, "
    "min_date string, max_date string, range_days bigint, n_unique bigint, "
    "top_values array<struct<value:string,count:bigint>>, sample_values array<string>"
)


def _medians(df: DataFrame, columns: list[ColumnMeta]) -> dict[str, Column]:
    """The median of every column as a literal, usable inside ``df.agg``."""
    if not columns:
        return {}
    numbers = df.select(*[m.number.alias(m.name) for m in columns])
    got = exact_quantiles(numbers, {m.name: [0.5] for m in columns})
    return {c: F.lit(v[0]).cast("double") for c, v in got.items()}


def _blank(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _summary_row(m: ColumnMeta, prefix: str, agg: list[Column], median: Column | None) -> Column:
    """Add the aggregates of one column to ``agg`` and return its summary struct."""
    agg.append(F.count_if(m.present).alias(prefix + "n"))
    agg.append(F.count_if(~m.present).alias(prefix + "miss"))
    number = {k: _blank("double") for k in ("mean", "median", "std", "min", "max")}
    date = {"min_date": _blank("string"), "max_date": _blank("string"), "range_days": _blank("bigint")}
    if m.user_type == "numeric":
        agg += [
            F.avg(m.number).alias(prefix + "mean"),
            median.alias(prefix + "median"),
            F.stddev_samp(m.number).alias(prefix + "std"),
            F.min(m.number).alias(prefix + "min"),
            F.max(m.number).alias(prefix + "max"),
        ]
        number = {k: F.round(parsing.no_nan(F.col(prefix + k)), 4) for k in number}
    elif m.user_type == "date":
        agg += [F.min(m.time).alias(prefix + "min"), F.max(m.time).alias(prefix + "max")]
        lo, hi = F.col(prefix + "min"), F.col(prefix + "max")
        span = F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp"))
        date = {
            "min_date": F.date_format(lo, "yyyy-MM-dd"),
            "max_date": F.date_format(hi, "yyyy-MM-dd"),
            "range_days": F.floor(span / 86_400_000_000).cast("bigint"),
        }
    return F.struct(
        F.lit(m.name).alias("column"),
        F.lit(m.ordinal).alias("ordinal"),
        F.lit(m.user_type).alias("type"),
        F.col(prefix + "n").alias("count"),
        F.col(prefix + "miss").alias("missing"),
        *[v.alias(k) for k, v in {**number, **date}.items()],
    )


def summarise(df: DataFrame, meta: Metadata, key: str | None = None) -> DataFrame:
    """One summary row per column.

    Numeric and date columns come from one wide aggregate. Text columns share
    one value count, from which both the number of distinct values and the most
    frequent ones are taken. ``key`` gives the row order of the sample values.
    """
    columns = list(meta)
    medians = _medians(df, [m for m in columns if m.user_type == "numeric"])
    agg: list[Column] = []
    rows = [_summary_row(m, f"c{m.ordinal}_", agg, medians.get(m.name)) for m in columns]
    out = df.agg(*agg).select(F.inline(F.array(*rows)))

    texts = [m for m in columns if m.user_type in ("categorical", "title_id")]
    if not texts:
        return out.select(
            "*",
            _blank("bigint").alias("n_unique"),
            _blank("array<struct<value:string,count:bigint>>").alias("top_values"),
            _blank("array<string>").alias("sample_values"),
        )
    counts = value_counts(df, texts)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    titles = [m.name for m in texts if m.user_type == "title_id"]
    best = (
        top_values(counts.where(~F.col("column").isin(titles)), TOP_VALUES)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", F.col("n").alias("count")))).alias("t"))
        .select(
            "column",
            F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias(
                "top_values"
            ),
        )
    )
    out = out.join(distinct, "column", "left").join(best, "column", "left")
    samples = [sample_values(df, m, key) for m in texts if m.user_type == "title_id"]
    if samples:
        union = samples[0]
        for s in samples[1:]:
            union = union.unionByName(s)
        out = out.join(union, "column", "left")
    else:
        out = out.withColumn("sample_values", _blank("array<string>"))
    zero = F.when(F.col("type").isin("categorical", "title_id"), F.coalesce("n_unique", F.lit(0)))
    return out.withColumn("n_unique", zero.cast("bigint"))


def sample_values(df: DataFrame, m: ColumnMeta, key: str | None = None) -> DataFrame:
    """The first few non-missing values of a column in key order (a bounded top-k)."""
    order = F.col(f"`{key}`") if key else F.monotonically_increasing_id()
    first = (
        df.where(m.present)
        .select(order.alias("k"), m.text.alias("v"))
        .orderBy("k")
        .limit(SAMPLE_VALUES)
    )
    return first.agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s")).select(
        F.lit(m.name).alias("column"), F.col("s.v").alias("sample_values")
    )


# -- statistics of concepts ---------------------------------------------------


def concept_stats(tax, concept: str) -> DataFrame:
    """Statistics of one concept over the usable columns; no rows if it is empty."""
    return concept_stats_all(tax, [concept]).drop("concept_id")


def concept_stats_all(tax, concepts: list[str] | None = None) -> DataFrame:
    """Statistics of several concepts from one scan.

    Each row is routed to the concepts it belongs to and aggregated per concept
    with map-side combine.
    """
    ids = list(concepts) if concepts is not None else list(tax.concepts)
    columns = tax.meta.usable()
    if len(ids) == 1:
        member = tax.rows(ids[0]).select(F.lit(ids[0]).alias("concept_id"), *[m.ref for m in columns])
    else:
        member = tax.membership(ids, keep=[m.name for m in columns])
    wide = [m for m in columns if m.user_type in ("numeric", "date")]
    parts = []
    if wide:
        agg, rows = [F.count(F.lit(1)).alias("size")], []
        for m in wide:
            p = f"c{m.ordinal}_"
            if m.user_type == "numeric":
                agg += [
                    F.avg(m.number).alias(p + "mean"),
                    F.stddev_samp(m.number).alias(p + "std"),
                    F.min(m.number).alias(p + "min"),
                    F.max(m.number).alias(p + "max"),
                ]
                number = [F.round(F.col(p + k), 4).alias(k) for k in ("mean", "std", "min", "max")]
                date = [_blank("string").alias(k) for k in ("mean_date", "min_date", "max_date")]
            else:
                agg += [
                    F.avg(m.micros).alias(p + "mean"),
                    F.min(m.time).alias(p + "min"),
                    F.max(m.time).alias(p + "max"),
                ]
                number = [_blank("double").alias(k) for k in ("mean", "std", "min", "max")]
                mean = parsing.micros_to_time(F.floor(p + "mean"))
                date = [
                    F.date_format(mean, "yyyy-MM-dd").alias("mean_date"),
                    F.date_format(p + "min", "yyyy-MM-dd").alias("min_date"),
                    F.date_format(p + "max", "yyyy-MM-dd").alias("max_date"),
                ]
            rows.append(
                F.struct(
                    F.lit(m.name).alias("column"), F.lit(m.user_type).alias("type"), *number, *date
                )
            )
        stats = member.groupBy("concept_id").agg(*agg).where(F.col("size") > 0)
        parts.append(
            stats.select("concept_id", F.inline(F.array(*rows))).withColumn(
                "top_values", _blank("array<struct<value:string,count:bigint>>")
            )
        )
    texts = [m for m in columns if m.user_type == "categorical"]
    if texts:
        counts = value_counts(member, texts, ["concept_id"])
        best = top_values(counts, TOP_CONCEPT_VALUES, ["concept_id"])
        parts.append(
            best.groupBy("concept_id", "column")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "value", F.col("n").alias("count")))).alias("t"))
            .select(
                "concept_id",
                "column",
                F.lit("categorical").alias("type"),
                *[_blank("double").alias(k) for k in ("mean", "std", "min", "max")],
                *[_blank("string").alias(k) for k in ("mean_date", "min_date", "max_date")],
                F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias(
                    "top_values"
                ),
            )
        )
    if not parts:
        raise ValueError("no usable columns")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def available_restrictions(tax, concept: str) -> DataFrame:
    """What the concept's rows can still be restricted by.

    One row per numeric or date column with its range, and one row per value of
    a categorical column, so that a wide domain stays distributed. Columns with
    at most one distinct value are left out.
    """
    rows = tax.rows(concept)
    columns = tax.meta.usable()
    wide = [m for m in columns if m.user_type in ("numeric", "date")]
    texts = [m for m in columns if m.user_type == "categorical"]
    ops = F.array(*[F.lit(o) for o in ("=", ">", ">=", "<", "<=")])
    parts = []
    if wide:
        medians = _medians(rows, [m for m in wide if m.user_type == "numeric"])
        agg, out = [], []
        for m in wide:
            p = f"c{m.ordinal}_"
            if m.user_type == "numeric":
                agg += [
                    F.min(m.number).alias(p + "min"),
                    F.max(m.number).alias(p + "max"),
                    F.avg(m.number).alias(p + "mean"),
                    medians[m.name].alias(p + "median"),
                ]
                number = [F.round(F.col(p + k), 4).alias(k) for k in ("min", "max", "mean", "median")]
                date = [_blank("string").alias(k) for k in ("min_date", "max_date")]
            else:
                agg += [F.min(m.time).alias(p + "min"), F.max(m.time).alias(p + "max")]
                number = [_blank("double").alias(k) for k in ("min", "max", "mean", "median")]
                date = [
                    F.date_format(p + "min", "yyyy-MM-dd").alias("min_date"),
                    F.date_format(p + "max", "yyyy-MM-dd").alias("max_date"),
                ]
            # More than one distinct value is the same as min < max.
            out.append(
                F.struct(
                    (F.col(p + "min") < F.col(p + "max")).alias("varies"),
                    F.lit(m.name).alias("column"),
                    F.lit(m.user_type).alias("type"),
                    ops.alias("operators"),
                    _blank("string").alias("value"),
                    *number,
                    *date,
                )
            )
        parts.append(rows.agg(*agg).select(F.inline(F.array(*out))).where("varies").drop("varies"))
    if texts:
        counts = value_counts(rows, texts)
        varied = counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
        parts.append(
            counts.join(varied, "column", "left_semi").select(
                "column",
                F.lit("categorical").alias("type"),
                F.array(F.lit("=")).alias("operators"),
                "value",
                *[_blank("double").alias(k) for k in ("min", "max", "mean", "median")],
                *[_blank("string").alias(k) for k in ("min_date", "max_date")],
            )
        )
    if not parts:
        raise ValueError("no usable columns")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
