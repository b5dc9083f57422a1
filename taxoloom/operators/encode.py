"""Numeric encoding of a table: z-scores and one-hot columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..metadata import ColumnMeta, Metadata
from ..plans.local import local_frame
from ..plans.numbering import contiguous_ids
from ..plans.scratch import settle
from ..sources.rowid import ROW_ID


#: Values of a column that may be sent whole to every task; compressed, many more look small to the planner.
SENT_VALUES = 1 << 16
FEATURES = "feature_idx long, feature_name string, column string, kind string, value string"


@dataclass(frozen=True)
class Span:
    """The features of one source column: ``size`` of them from index ``start``."""

    column: str
    kind: str
    start: int
    size: int


@dataclass
class Encoded:
    """Dense rows ``(key, …, features array<double>)``; ``features`` is the table of what each cell means."""

    df: DataFrame
    features: DataFrame
    spans: list[Span]
    key: str

    @property
    def width(self) -> int:
        return sum(s.size for s in self.spans)


@dataclass
class SparseEncoded(Encoded):
    """Rows ``(key, …, indices array<int>, cells array<double>)`` with one place per source column.

    A missing category has index -1 and cell 0. ``features`` and ``spans`` are those of the dense form.
    """

    def long(self) -> DataFrame:
        """``(key, feature_idx, value)`` of the non-zero cells."""
        cell = F.inline(F.arrays_zip(F.col("indices").alias("feature_idx"), F.col("cells").alias("value")))
        rows = self.df.select(F.col(f"`{self.key}`"), cell).where("value <> 0")
        return rows.withColumn("feature_idx", F.col("feature_idx").cast("long"))

    def dense(self) -> Encoded:
        """One cell per feature: what the places hold, and zeros."""
        blocks = [_block(k, s) for k, s in enumerate(self.spans)]
        array = F.concat(*blocks) if blocks else F.array().cast("array<double>")
        others = [F.col(f"`{c}`") for c in self.df.columns if c not in ("indices", "cells")]
        return Encoded(self.df.select(*others, array.alias("features")), self.features, self.spans, self.key)


def _block(place: int, span: Span) -> Column:
    cell, index = F.get("cells", F.lit(place)), F.get("indices", F.lit(place))
    if span.kind != "categorical":
        return F.array(cell)
    if not span.size:
        return F.array().cast("array<double>")
    own = F.sequence(F.lit(span.start), F.lit(span.start + span.size - 1))
    return F.transform(own, lambda j: F.when(j == index, cell).otherwise(F.lit(0.0)))


def _scaled_columns(meta: Metadata, ignore: list[str]) -> tuple[list[ColumnMeta], list[ColumnMeta]]:
    used = [m for m in meta.usable() if m.name not in set(ignore)]
    return used, [m for m in used if m.user_type in ("numeric", "date")]


def scale_source(m: ColumnMeta) -> Column:
    """The number a z-score is taken of; dates count in whole seconds."""
    if m.user_type == "date":
        return F.floor(m.micros / 1_000_000).cast("double")
    return m.number


def _scales(df: DataFrame, scaled: list[ColumnMeta]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of every scaled column, from one aggregate."""
    if not scaled:
        return {}
    aggs = []
    for i, m in enumerate(scaled):
        aggs += [F.avg(scale_source(m)).alias(f"m{i}"), F.stddev_samp(scale_source(m)).alias(f"s{i}")]
    got = df.agg(*aggs).first()
    return {m.name: (got[f"m{i}"], got[f"s{i}"]) for i, m in enumerate(scaled)}


def _z_score(m: ColumnMeta, scale: tuple[float, float]) -> Column:
    mean, std = scale
    if std is None or std != std or std == 0.0:
        return F.lit(0.0)
    return F.coalesce((scale_source(m) - F.lit(mean)) / F.lit(std), F.lit(0.0))


def _dictionary(df: DataFrame, m: ColumnMeta, start: int) -> DataFrame:
    """``(feature_idx, value)``: the distinct values of a column, numbered in the order of its own type."""
    values = df.where(m.present).select(m.ref.alias("v"), m.text.alias("value")).distinct()
    return settle(contiguous_ids(values, "feature_idx", ["v"], start).select("feature_idx", "value"), "dictionary")


@dataclass
class Encoder:
    """Scales and value dictionaries of a whole table.

    The dictionaries are settled tables, and each row meets its own values by one equi-join per categorical
    column; only the number of values of each column is known to the driver.
    """

    columns: list[ColumnMeta]
    scales: dict[str, tuple[float, float]]
    dictionaries: dict[str, DataFrame]
    spans: list[Span]
    features: DataFrame
    key: str

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> SparseEncoded:
        """Encode ``df``, or any part of the fitted table, next to its ``keep`` columns."""
        names = list(dict.fromkeys([self.key, *(keep or [])]))
        rows = df.select(
            *[F.col(f"`{c}`") for c in names],
            *[
                (m.text if m.name in self.dictionaries else _z_score(m, self.scales[m.name])).alias(f"_cell_{i}")
                for i, m in enumerate(self.columns)
            ],
        )
        indices, cells = [], []
        for i, (m, span) in enumerate(zip(self.columns, self.spans)):
            if m.name not in self.dictionaries:
                indices.append(F.lit(span.start))
                cells.append(F.col(f"_cell_{i}"))
                continue
            own = self.dictionaries[m.name].select(F.col("value").alias(f"_value_{i}"), F.col("feature_idx").cast("int").alias(f"_index_{i}"))
            if span.size > SENT_VALUES:
                own = own.hint("merge")
            rows = rows.join(own, F.col(f"_cell_{i}") == F.col(f"_value_{i}"), "left")
            indices.append(F.coalesce(F.col(f"_index_{i}"), F.lit(-1)))
            cells.append(F.col(f"_index_{i}").isNotNull().cast("double"))
        found = rows.select(
            *[F.col(f"`{c}`") for c in names],
            F.array(*indices).cast("array<int>").alias("indices"),
            F.array(*cells).cast("array<double>").alias("cells"),
        )
        return SparseEncoded(found, self.features, self.spans, self.key)


def fit_encoder(df: DataFrame, meta: Metadata, key: str = ROW_ID, ignore: list[str] | None = None) -> Encoder:
    """One feature per number or date column and per distinct value of a categorical one, in metadata order."""
    used, scaled = _scaled_columns(meta, ignore or [])
    spark, width = df.sparkSession, 0
    spans: list[Span] = []
    dictionaries: dict[str, DataFrame] = {}
    plain = []
    for m in used:
        if m.user_type in ("numeric", "date"):
            plain.append((width, m.name, m.name, m.user_type, None))
            spans.append(Span(m.name, m.user_type, width, 1))
        else:
            dictionaries[m.name] = _dictionary(df, m, width)
            spans.append(Span(m.name, "categorical", width, dictionaries[m.name].count()))
        width += spans[-1].size
    features = local_frame(spark, plain, FEATURES)
    for name, values in dictionaries.items():
        features = features.unionByName(
            values.select(
                "feature_idx", F.concat_ws("_", F.lit(name), "value").alias("feature_name"), F.lit(name).alias("column"),
                F.lit("categorical").alias("kind"), "value",
            )
        )
    return Encoder(used, _scales(df, scaled), dictionaries, spans, features, key)


def encode_sparse(df: DataFrame, meta: Metadata, key: str = ROW_ID, ignore: list[str] | None = None) -> SparseEncoded:
    """One index and one cell per source column of each row; the form for columns of any width."""
    return fit_encoder(df, meta, key, ignore).transform(df)


def encode(df: DataFrame, meta: Metadata, key: str = ROW_ID, ignore: list[str] | None = None) -> Encoded:
    """``(key, features array<double>)`` plus the feature table, in metadata order."""
    return encode_sparse(df, meta, key, ignore).dense()


def encode_long(
    df: DataFrame, meta: Metadata, key: str = ROW_ID, ignore: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(key, feature_idx, value)`` of the non-zero cells, and the feature table."""
    sparse = encode_sparse(df, meta, key, ignore)
    return sparse.long(), sparse.features
