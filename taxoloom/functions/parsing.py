"""Semantic readings of a column: as a number, as a wall-clock time, as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .names import decimal_text

NUMERIC_TYPES = (T.NumericType, T.BooleanType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)

# What counts as the text of a number, and the date layouts that
# are read, each as (shape, formats tried in order).
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY_TEXT = r"^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"
DATE_LAYOUTS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", ["yyyy-M-d H:mm"]),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", ["yyyy-M-d H:mm:ss"]),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d+$", ["yyyy-M-d H:mm:ss.[SSSSSSSSS][SSSSSS][SSS]"]),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", ["yyyy-MM-dd'T'HH:mm:ss"]),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+$", ["yyyy-MM-dd'T'HH:mm:ss.[SSSSSSSSS][SSSSSS][SSS]"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/yyyy", "d/M/yyyy"]),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", ["MMM d yyyy"]),
    (r"^\d{4}$", ["yyyy"]),
]


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATE_TYPES)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOAT_TYPES)


def no_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def as_number(c: Column, dtype: T.DataType) -> Column:
    """DOUBLE reading; NaN and text that is not a number become NULL."""
    if is_float(dtype):
        return no_nan(c.cast("double"))
    if is_numeric(dtype):
        return c.cast("double")
    if is_date(dtype):
        return epoch_micros(c, dtype).cast("double") * 1000.0
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(f"{NUMBER_TEXT}|{INFINITY_TEXT}"), text.try_cast("double"))


def as_time(c: Column, dtype: T.DataType) -> Column:
    """TIMESTAMP_NTZ reading; text in no known layout becomes NULL."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if is_date(dtype):
        return c.cast("timestamp_ntz")
    if is_numeric(dtype):
        micros = F.floor(c.cast("double") / 1000.0).cast("long")
        return F.timestamp_micros(micros).cast("timestamp_ntz")
    text = F.trim(c.cast("string"))
    reading = None
    for shape, formats in DATE_LAYOUTS:
        tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
        value = F.coalesce(*tries) if len(tries) > 1 else tries[0]
        hit = text.rlike(shape)
        reading = F.when(hit, value) if reading is None else reading.when(hit, value)
    # Text in none of the layouts is settled by one match.
    known = text.rlike("|".join(shape for shape, _ in DATE_LAYOUTS))
    return F.when(known, reading).cast("timestamp_ntz")


def as_text(c: Column, dtype: T.DataType) -> Column:
    """STRING reading; NaN becomes NULL, booleans are True and False, floats have no exponent."""
    if isinstance(dtype, T.StringType):
        return c
    if is_float(dtype):
        endless = F.when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
        return F.coalesce(decimal_text(c.cast("double")), endless)
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast("string")


def present(c: Column, dtype: T.DataType) -> Column:
    """True where the raw value is not missing."""
    if is_float(dtype):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def epoch_micros(c: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970-01-01 of the wall-clock value (UTC session)."""
    return F.unix_micros(as_time(c, dtype).cast("timestamp"))


def micros_to_time(c: Column) -> Column:
    return F.timestamp_micros(c.cast("long")).cast("timestamp_ntz")
