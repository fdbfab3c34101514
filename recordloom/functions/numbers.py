"""Number parsing and null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import fixed_values as V
from recordloom.functions.text import strip

_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = (
    rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
    r"|^(?i)[+-]?(?:inf|infinity)$"
)
_NAN = r"^(?i)[+-]?nan$"


def to_number(text: Column, otherwise: Column) -> Column:
    """Text as a double: underscores between digits pass, type suffixes such as ``1d`` do not.

    Not-a-number texts become NULL, because a stored figure cannot hold them; text that is no
    number at all becomes ``otherwise``.
    """
    bare = strip(text)
    plain = F.replace(bare, F.lit("_"), F.lit(""))
    return (
        F.when(bare.rlike(_NUMBER), plain.try_cast("double"))
        .when(bare.rlike(_NAN), F.lit(None).cast("double"))
        .otherwise(otherwise)
    )


def _without(text: Column, *marks: str) -> Column:
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def parse_amount(text: Column) -> Column:
    """Signed amount with thousands commas; a currency sign is not accepted. Failure gives 0."""
    return to_number(_without(text, ","), F.lit(0.0))


def parse_dollar(text: Column) -> Column:
    """Amount such as ``$1,600.00``. Failure gives 0; parentheses count as failure."""
    return to_number(_without(strip(text), "$", ","), F.lit(0.0))


def parse_value(text: Column) -> Column:
    """Sheet cell: ``$`` and commas dropped, ``(x)`` negative, null words and failures NULL."""
    cleaned = _without(strip(text), "$", ",")
    negative = r"^\((.+)\)$"
    signed = F.when(
        cleaned.startswith("(") & cleaned.rlike(negative), F.concat(F.lit("-"), F.regexp_extract(cleaned, negative, 1))
    ).otherwise(cleaned)
    none = F.lit(None).cast("double")
    return F.when(F.lower(cleaned).isin(V.NULL_WORDS), none).otherwise(to_number(signed, none))


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent of the absolute previous value; NULL without a non-zero previous value."""
    return F.try_divide(current - previous, F.abs(previous)) * 100


def ratio_pct(numerator: Column, denominator: Column) -> Column:
    """Ratio in percent; NULL without a non-zero denominator."""
    return F.try_divide(numerator, denominator) * 100


def exact_sum(amount: Column, exact: Column) -> Column:
    """Sum that does not depend on the order of the rows.

    ``exact`` is the amount as a decimal, NULL where it does not fit. The decimals are summed; if any
    amount did not fit, the sum of the doubles is taken instead so that no row is left out.
    """
    fits = F.count(exact) == F.count(amount)
    return F.when(fits, F.sum(exact).cast("double")).otherwise(F.sum(amount))


def as_decimal(amount: Column) -> Column:
    return amount.try_cast("decimal(28,10)")


def days_between(first: Column, last: Column) -> Column:
    """Whole days of elapsed time, rounded down (not the number of midnights)."""
    return F.floor((F.unix_seconds(last) - F.unix_seconds(first)) / 86400)


def size_mb(size_kb: Column) -> Column:
    return size_kb / 1024
