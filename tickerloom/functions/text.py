"""Text expressions with the white-space rules of Python's str methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space that str.strip takes off.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Fixed patterns: every line break str.splitlines knows, and tickers.
LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TICKER = r"\A[A-Z][A-Z0-9-]{0,5}\z"
MISSING = ("", "N/D")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def folded(text: Column) -> Column:
    """Stripped and upper-cased: how symbols are compared."""
    return F.upper(strip(text))


def lines(text: Column) -> Column:
    """The lines of a text, blank ones left out (a CSV reader skips them)."""
    return F.filter(F.split(text, LINES), lambda line: line != "")


def market_symbol(symbol: Column) -> Column:
    """The exchange form of a requested symbol: `.US` is added where there is no dot; null for a blank symbol."""
    name = folded(symbol)
    return F.when(name == "", F.lit(None)).when(F.contains(name, F.lit(".")), name).otherwise(F.concat(name, F.lit(".US")))


def without_us(market: Column) -> Column:
    """A market symbol less one trailing `.US`."""
    return F.regexp_replace(market, r"[.]US\z", "")


def plan_symbol(symbol: Column) -> Column:
    """A ticker as a language model may give it: text ahead of the first dot, or null where that is no ticker."""
    name = F.split_part(folded(symbol), F.lit("."), F.lit(1))
    return F.when(name.rlike(TICKER), name)


def or_na(text: Column) -> Column:
    """`n/a` for null or empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("n/a"))


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 with offset; microseconds only where there are any."""
    micros = F.date_format(ts, "SSSSSS")
    head, zone = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, "xxx")
    return F.concat(head, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), zone)
