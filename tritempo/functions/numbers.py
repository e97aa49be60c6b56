"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tritempo.functions.timecols import as_column


def adaptive_round(column: Column | str, *, null_as_zero: bool = False) -> Column:
    """Round half away from zero at ten decimal places."""
    value = as_column(column).cast("double")
    if null_as_zero:
        value = F.coalesce(value, F.lit(0.0))
    return F.round(value * 1e10, 0) / F.lit(1e10)


def _trimmed(text: Column, scale: int) -> Column:
    """Decimal text of a number text in exponent form, without trailing zeros."""
    plain = text.cast(f"decimal(38,{scale})").cast("string")
    return F.rtrim(F.rtrim(plain, F.lit("0")), F.lit("."))


def _integer(size: Column) -> Column:
    """Text of a double from 2^53 up to 2^63: the most zeros at the end that still give the double back."""
    exact = size.cast("bigint")
    text = exact.cast("string")
    for zeros in (1, 2, 3):
        rounded = F.round(exact, -zeros)
        text = F.when(rounded.cast("double") == size, rounded.cast("string")).otherwise(text)
    return text


def _expanded(size: Column) -> Column:
    """Text of a double too large or too small for a decimal: its digits and zeros."""
    text = size.cast("string")
    digits = F.replace(F.substring_index(text, "E", 1), F.lit("."), F.lit(""))
    exponent = F.substring_index(text, "E", -1).cast("int")
    after = exponent - F.length(digits) + 1
    tiny = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), F.rtrim(digits, F.lit("0")))
    huge = F.concat(F.substring(digits, F.lit(1), F.length(digits) + after), F.repeat(F.lit("0"), after))
    return F.when(size < 1, tiny).otherwise(huge)


def _rare(size: Column) -> Column:
    """Sizes few data have. The lambda keeps their code out of the generated method, which must stay small."""
    texts = F.transform(
        F.array(size), lambda one: F.when(one.between(2.0**53, 2.0**63), _integer(one)).otherwise(_expanded(one))
    )
    return F.element_at(texts, 1)


def format_number(column: Column | str) -> Column:
    """Shortest decimal text of a double, never in exponent form.

    From 2^63 on the digits are the JVM's: they give the double back but may not be the fewest.
    """
    value = as_column(column).cast("double")
    text = value.cast("string")
    size = F.abs(value)
    exponent = (
        F.when(size.between(1.0, 2.0**53), _trimmed(text, 16))
        .when(size.between(1e-20, 1.0), _trimmed(text, 37))
        .otherwise(F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), _rare(size)))
    )
    plain = (
        F.when(F.endswith(text, F.lit(".0")), F.substring(text, F.lit(1), F.length(text) - 2))
        .when(text == "Infinity", F.lit("+Inf"))
        .when(text == "-Infinity", F.lit("-Inf"))
        .otherwise(text)
    )
    return F.when(F.contains(text, F.lit("E")), exponent).otherwise(plain)
