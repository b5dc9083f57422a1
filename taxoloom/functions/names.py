"""RDF names and literal texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Vocabulary namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = RDF + "type"


def namespace(uri: str, ending: str) -> str:
    if not uri:
        raise ValueError("a namespace is required")
    return uri if uri[-1] in "#/" else uri + ending


def safe_name(c: Column) -> Column:
    """Local name of a value: word characters and hyphens, starting with a letter."""
    squeezed = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w-]", "_"), "_+", "_")
    trimmed = F.regexp_replace(squeezed, "^_|_$", "")
    named = F.when(trimmed.rlike(r"^\p{L}"), trimmed).otherwise(F.concat(F.lit("x_"), trimmed))
    # Most values are safe as they are, which one match settles.
    return F.when(c.rlike("^[A-Za-z](_?[A-Za-z0-9-])*$"), c).otherwise(named)


def safe_name_text(text: str) -> str:
    """``safe_name`` for one driver-side text, such as a column or concept name."""
    trimmed = re.sub("_+", "_", re.sub(r"[^\w-]", "_", text)).strip("_")
    return trimmed if trimmed[:1].isalpha() else "x_" + trimmed


def decimal_text(c: Column) -> Column:
    """Plain decimal text of a DOUBLE: no exponent, at least one decimal; NULL if not finite."""
    text = c.cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(text, "^-", "")
    whole = F.regexp_extract(body, r"^(\d+)\.", 1)
    frac = F.regexp_replace(F.regexp_extract(body, r"^\d+\.(\d+)E", 1), "^0$", "")
    power = F.regexp_extract(body, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.concat(whole, frac)
    padded = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
    rest = F.substr(padded, power + 2, F.length(padded))
    large = F.concat(
        F.substr(padded, F.lit(1), power + 1), F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest)
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return (
        F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("string"))
        .when(~text.contains("E"), text)
        .when(power >= 0, F.concat(sign, large))
        .otherwise(F.concat(sign, small))
    )


def decimal_text_of(value: float) -> str:
    """``decimal_text`` for one driver-side number."""
    from decimal import Decimal

    text = format(Decimal(repr(float(value))), "f")
    return text if "." in text else text + ".0"
