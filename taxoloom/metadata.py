"""Column metadata: what each column means and whether it takes part."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .functions import parsing
from .plans.local import local_frame

SEMANTIC_TYPES = ("numeric", "categorical", "date", "title_id")


@dataclass
class ColumnMeta:
    name: str
    ordinal: int
    dtype: T.DataType
    detected_type: str
    user_type: str
    include: bool

    @property
    def ref(self) -> Column:
        return F.col(f"`{self.name}`")

    @property
    def number(self) -> Column:
        return parsing.as_number(self.ref, self.dtype)

    @property
    def time(self) -> Column:
        return parsing.as_time(self.ref, self.dtype)

    @property
    def micros(self) -> Column:
        return parsing.epoch_micros(self.ref, self.dtype)

    @property
    def text(self) -> Column:
        return parsing.as_text(self.ref, self.dtype)

    @property
    def present(self) -> Column:
        return parsing.present(self.ref, self.dtype)


@dataclass
class Metadata:
    columns: dict[str, ColumnMeta] = field(default_factory=dict)

    def __iter__(self):
        return iter(self.columns.values())

    def __getitem__(self, name: str) -> ColumnMeta:
        if name not in self.columns:
            raise KeyError(f"unknown column {name!r}")
        return self.columns[name]

    def __contains__(self, name: str) -> bool:
        return name in self.columns

    def set(self, column: str, user_type: str | None = None, include: bool | None = None) -> "Metadata":
        """Override the type or the include flag of one column."""
        meta = self[column]
        if user_type is not None:
            if user_type not in SEMANTIC_TYPES:
                raise ValueError(f"type must be one of {', '.join(SEMANTIC_TYPES)}")
            meta.user_type = user_type
        if include is not None:
            meta.include = bool(include)
        return self

    def usable(self) -> list[ColumnMeta]:
        """Included columns that are not identifiers."""
        return [m for m in self if m.include and m.user_type != "title_id"]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return local_frame(
            spark,
            [(m.name, m.ordinal, m.detected_type, m.user_type, m.include) for m in self],
            "column string, ordinal int, detected_type string, user_type string, include boolean",
        )


def metadata_from_types(df: DataFrame, types: dict[str, tuple[str, bool]]) -> Metadata:
    """Metadata from given (type, include) pairs; absent columns are numeric and included."""
    meta = Metadata()
    for ordinal, f in enumerate(df.schema.fields):
        kind, include = types.get(f.name, ("numeric", True))
        if kind not in SEMANTIC_TYPES:
            raise ValueError(f"column {f.name!r}: type must be one of {', '.join(SEMANTIC_TYPES)}")
        meta.columns[f.name] = ColumnMeta(f.name, ordinal, f.dataType, kind, kind, include)
    return meta
