"""Types of quotes and observations, and the layout of the exported table."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 6)
CHANGE = T.DecimalType(19, 6)
PERCENT = T.DecimalType(18, 2)

# The exported columns, in order, and the columns of a feed without header.
EXPORT_COLUMNS = (
    "fetched_at_utc", "symbol", "market_symbol", "price", "currency", "quote_date", "quote_time", "open", "high", "low", "volume",
    "previous_price", "price_change", "percent_change", "run_summary", "source", "source_url",
)
FEED_COLUMNS = ("Symbol", "Date", "Time", "Open", "High", "Low", "Close", "Volume")
CURRENCY, SOURCE = "USD", "Stooq"
DEFAULT_SYMBOLS = ("IBM", "KO", "JPM", "WMT", "XOM")
MAX_PLAN_SYMBOLS = 15
# Tickers that the feed is known to have, of a sector whose names are often guessed wrong.
SUPPORTED = {"uranium": ("CCJ", "UEC", "UUUU", "NXE", "URA")}

QUOTE = T.StructType([
    T.StructField("fetched_at_utc", T.TimestampType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("market_symbol", T.StringType()),
    T.StructField("price", PRICE),
    T.StructField("currency", T.StringType()),
    T.StructField("quote_date", T.StringType()),
    T.StructField("quote_time", T.StringType()),
    T.StructField("open", PRICE),
    T.StructField("high", PRICE),
    T.StructField("low", PRICE),
    T.StructField("volume", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_url", T.StringType()),
])

#: What the store keeps: the exported columns, plus the identity of a row.
STORED = T.StructType([
    *QUOTE.fields,
    T.StructField("previous_price", PRICE),
    T.StructField("price_change", CHANGE),
    T.StructField("percent_change", PERCENT),
    T.StructField("run_summary", T.StringType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("batch_id", T.LongType()),
])
