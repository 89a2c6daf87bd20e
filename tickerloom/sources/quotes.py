"""Quote feeds: responses in CSV text become typed quotes, in one plan without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import numbers, text
from tickerloom.schema import CURRENCY, FEED_COLUMNS, QUOTE, SOURCE

# One field of a CSV line and what ends it: quoted, with quotes doubled inside, or plain.
FIELD = r'("(?:[^"]++|"")*+"|[^,]*+)(?:,|\z)'


class NoQuotesError(ValueError):
    """A feed had no usable quote."""


def fields(line: Column) -> Column:
    """The fields of one CSV line, quotes undone (and an empty one more at its end)."""

    def unquoted(field: Column) -> Column:
        inner = F.substring(field, F.lit(2), F.length(field) - 2)
        return F.when(field.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)

    return F.transform(F.regexp_extract_all(line, F.lit(FIELD), F.lit(1)), unquoted)


def alias(market: Column, requested: Column) -> Column:
    """The last requested symbol whose market symbol is `market`, folded; else market less `.US`."""
    asked = F.filter(requested, lambda symbol: text.market_symbol(symbol) == market)
    found = F.when(F.size(asked) > 0, text.folded(F.try_element_at(asked, F.lit(-1))))
    return F.coalesce(found, text.without_us(market))


def parse(responses: DataFrame) -> DataFrame:
    """Quotes of responses (response_id, body, requested array<string>, fetched_at_utc, source_url), with response_id, line and status.

    status: ok; no_data (a close of N/D; such rows are no quotes); bad_price or bad_number (no number where one belongs).
    A first line with a field `Symbol` is a header and binds columns by name; without one all lines are data in the usual order.
    Lines are cut into fields, the fields' places found and their text stripped inside what is exploded: once each, and plain columns afterwards, which a
    filter on the status can repeat at no cost.
    """

    def places(head: Column) -> Column:
        """Where the fields are, 0 where not at all, and last whether there is a header."""
        named = F.coalesce(F.array_contains(head, "Symbol"), F.lit(False))
        usual = F.array(*[F.lit(k + 1) for k in range(len(FEED_COLUMNS))], F.lit(0))
        return F.when(named, F.array(*[F.array_position(head, name).cast("int") for name in FEED_COLUMNS], F.lit(1))).otherwise(usual)

    def record(row: Column, at: Column, k: Column) -> Column:
        picked = [text.strip(F.get(row, F.get(at, F.lit(n)) - 1)).alias(name) for n, name in enumerate(FEED_COLUMNS)]
        return F.struct((k - F.get(at, F.lit(len(FEED_COLUMNS)))).alias("line"), *picked)

    # A lambda over an array of one binds its value, so that lines are not cut again for the header, nor places found for each line.
    def records(lines: Column) -> Column:
        return F.transform(F.array(places(F.try_element_at(lines, F.lit(1)))), lambda at: F.transform(lines, lambda row, k: record(row, at, k)))

    cut = F.array(F.transform(text.lines(F.col("body")), fields))
    found = F.explode(F.flatten(F.flatten(F.transform(cut, records)))).alias("_f")
    rows = responses.select("response_id", "requested", "fetched_at_utc", "source_url", found)
    rows = rows.filter("_f.line >= 0").select("response_id", "requested", "fetched_at_utc", "source_url", "_f.*")
    close, numeric = F.coalesce("Close", F.lit("")), ("Open", "High", "Low")
    rows = rows.withColumns({
        "market_symbol": F.upper(F.coalesce("Symbol", F.lit(""))), "price": numbers.clean_decimal(close),
        **{f"_{name}": numbers.clean_decimal(F.col(name)) for name in numeric}, "_Volume": numbers.clean_whole(F.col("Volume")),
    })
    bad = [~numbers.clean_missing(F.col(name)) & F.col(f"_{name}").isNull() for name in (*numeric, "Volume")]
    status = F.when(close == "N/D", "no_data").when(F.col("price").isNull(), "bad_price").when(bad[0] | bad[1] | bad[2] | bad[3], "bad_number").otherwise("ok")
    return rows.select(
        "response_id", "line", status.alias("status"), "fetched_at_utc",
        alias(F.col("market_symbol"), F.col("requested")).alias("symbol"), "market_symbol", "price", F.lit(CURRENCY).alias("currency"),
        F.coalesce("Date", F.lit("")).alias("quote_date"), F.coalesce("Time", F.lit("")).alias("quote_time"),
        *[F.col(f"_{name}").alias(name.lower()) for name in (*numeric, "Volume")], F.lit(SOURCE).alias("source"), "source_url",
    )


def usable(parsed: DataFrame) -> DataFrame:
    """The quotes among parsed rows, in the columns of a quote."""
    return parsed.filter("status = 'ok'").select(*QUOTE.names)


def strict(parsed: DataFrame) -> DataFrame:
    """Like usable, but a bad row fails the query and no quote at all raises NoQuotesError."""
    checked = parsed.withColumn("price", F.when(F.col("status").startswith("bad"), F.raise_error(F.concat_ws(" ", F.col("status"), F.lit("for"), "market_symbol")).cast("decimal(18,6)")).otherwise(F.col("price")))
    quotes = checked.filter("status != 'no_data'").select(*QUOTE.names)
    if quotes.isEmpty():
        raise NoQuotesError("no usable quotes in the feed")
    return quotes


def emptiness(parsed: DataFrame, responses: DataFrame) -> DataFrame:
    """response_id, quotes, is_empty for every response, those without any line included."""
    counts = parsed.groupBy("response_id").agg(F.count_if(F.col("status") == "ok").alias("quotes"))
    joined = responses.select("response_id").join(counts, "response_id", "left")
    quotes = F.coalesce("quotes", F.lit(0))
    return joined.select("response_id", quotes.alias("quotes"), (quotes == 0).alias("is_empty"))
