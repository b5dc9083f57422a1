"""Restrictions compiled to Catalyst predicates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
import logging
import operator as op

from pyspark.sql import Column, functions as F, types as T

from ..functions import parsing
from ..metadata import ColumnMeta, Metadata

logger = logging.getLogger(__name__)

COMPARE = {"=": op.eq, ">": op.gt, ">=": op.ge, "<": op.lt, "<=": op.le}


@dataclass(frozen=True)
class Restriction:
    column: str
    operator: str
    value: object


def value_text(value: object) -> str:
    return str(value)


def parse_time(value: object) -> dt.datetime:
    """A restriction value as a wall-clock time; a bare date is its midnight."""
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    text = str(value).strip()
    try:
        return dt.datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        pass
    for layout in ("%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%b %d %Y", "%Y"):
        try:
            return dt.datetime.strptime(text, layout)
        except ValueError:
            continue
    raise ValueError(f"not a date: {value!r}")


def time_literal(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _numeric(m: ColumnMeta, operator: str, value: float) -> Column:
    compare = COMPARE[operator]
    whole = isinstance(m.dtype, T.IntegralType) and value.is_integer() and abs(value) < 2**31
    if isinstance(m.dtype, T.NumericType):
        # Bare comparison on the stored column, so that the scan can use it.
        hit = compare(m.ref, F.lit(int(value) if whole else value))
        if parsing.is_float(m.dtype) and operator in (">", ">="):
            hit = hit & ~F.isnan(m.ref)
        return hit
    return compare(m.number, F.lit(value))


def _date(m: ColumnMeta, operator: str, value: dt.datetime) -> Column:
    return COMPARE[operator](m.time, time_literal(value))


def restriction_to_column(r: Restriction, meta: Metadata) -> Column:
    """Predicate of one restriction; NULL where the value is missing."""
    m = meta[r.column]
    if m.user_type == "categorical":
        # Any operator on a category means equality of texts.
        return m.text == F.lit(value_text(r.value))
    if m.user_type == "title_id":
        logger.warning("restriction on identifier column %s has no effect", r.column)
        return F.lit(True)
    if r.operator not in COMPARE:
        raise ValueError(f"unknown operator {r.operator!r}")
    if m.user_type == "numeric":
        return _numeric(m, r.operator, float(r.value))
    return _date(m, r.operator, parse_time(r.value))


def restrictions_to_column(restrictions: list[Restriction], meta: Metadata) -> Column:
    """All restrictions together; no restriction keeps every row."""
    parts = [restriction_to_column(r, meta) for r in restrictions]
    return reduce(op.and_, parts) if parts else F.lit(True)


def interval(column: str, low: object, high: object) -> list[Restriction]:
    """The half-open interval [low, high)."""
    return [Restriction(column, ">=", low), Restriction(column, "<", high)]
