"""Exact decimals: parsing, changes and their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions.text import MISSING, strip
from tickerloom.schema import CHANGE, PERCENT, PRICE

# A number as text: what is accepted, and at most six places behind the point (more would be rounded on the way in).
NUMBER = r"\A[+-]?([0-9]+([.][0-9]{0,6}0*)?|[.][0-9]{1,6}0*)([eE][+-]?[0-9]+)?\z"
WHOLE = r"\A[+-]?[0-9]+\z"


def decimal(text: Column) -> Column:
    """A required number: null where the text is none."""
    return clean_decimal(strip(text))


def missing(text: Column) -> Column:
    """Blank or N/D, or no text at all."""
    return clean_missing(strip(text))


def optional_decimal(text: Column) -> Column:
    return F.when(~missing(text), decimal(text))


def optional_whole(text: Column) -> Column:
    return F.when(~missing(text), clean_whole(strip(text)))


# The same of text that is stripped already; what is missing is no number either.


def clean_decimal(clean: Column) -> Column:
    return F.when(clean.rlike(NUMBER), clean.try_cast(PRICE))


def clean_missing(clean: Column) -> Column:
    return F.coalesce(clean.isin(*MISSING), F.lit(True))


def clean_whole(clean: Column) -> Column:
    return F.when(clean.rlike(WHOLE), clean.try_cast("bigint"))


def change(price: Column, previous: Column) -> Column:
    """price - previous; null without a previous price."""
    return (price - previous).cast(CHANGE)


def percent(price: Column, previous: Column) -> Column:
    """The change in percent, two places, ties to even; null without a previous price or where it is zero.

    Multiplied by 100 before the division, which keeps the quotient's scale.
    """
    return F.when(previous != 0, F.bround((price - previous) * 100 / previous, 2).cast(PERCENT))


def plain(number: Column) -> Column:
    """A decimal as text without trailing zeros; empty for null."""
    text = number.cast("string")
    text = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"[.]?0+\z", "")).otherwise(text)
    return F.coalesce(text, F.lit(""))


def fixed(number: Column) -> Column:
    """A decimal as text with all its places; empty for null."""
    return F.coalesce(number.cast("string"), F.lit(""))
