"""Comparing quotes with the last price saved before their batch.

Order is `batch_id`, then `ordinal`; time stamps order nothing.  Quotes of one batch all see the price from before it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.functions import numbers, text


def in_order(first: Column, then: Column) -> Column:
    """One number that orders by two whole ones (the first below 10**18): unlike a struct, it lets a hash aggregate find the last row."""
    return first.cast("decimal(18,0)") * F.lit(Decimal(10**19)) + then.cast("decimal(19,0)")


def latest(history: DataFrame) -> DataFrame:
    """symbol_key, price: the last saved price of each folded symbol; rows without symbol or price do not count."""
    rows = history.select(text.folded(F.col("symbol")).alias("symbol_key"), "price", "batch_id", "ordinal")
    rows = rows.filter("symbol_key != '' AND price IS NOT NULL")
    return rows.groupBy("symbol_key").agg(F.max_by("price", in_order(F.col("batch_id"), F.col("ordinal"))).alias("price"))


def compared(quotes: DataFrame) -> DataFrame:
    """quotes with previous_price: adds price_change and percent_change."""
    price, previous = F.col("price"), F.col("previous_price")
    return quotes.withColumns({"price_change": numbers.change(price, previous), "percent_change": numbers.percent(price, previous)})


def observe(quotes: DataFrame, last: DataFrame) -> DataFrame:
    """A batch's quotes against the latest prices; the quote's symbol is looked up as it stands, the saved one folded."""
    found = last.select("symbol_key", F.col("price").alias("previous_price"))
    return compared(quotes.join(found, quotes["symbol"] == found["symbol_key"], "left").drop("symbol_key"))


def replay(quotes: DataFrame) -> DataFrame:
    """Observations of a whole history (symbol, batch_id, ordinal, price, ...) as its batches made them one by one.

    Each batch is first reduced to a symbol's last price, with partial aggregation ahead of the shuffle; the price before a batch is then the
    one of the batch ahead in that small table.  So a symbol with very many quotes never has to be sorted in one task, and the join
    back can be split where a key is hot.
    """
    keyed = quotes.withColumn("_key", text.folded(F.col("symbol")))
    priced = F.when(F.col("price").isNotNull(), F.col("ordinal"))
    closing = keyed.filter("_key != ''").groupBy("_key", "batch_id").agg(F.max_by("price", priced).alias("_last"))
    # A batch in which a symbol has no price is passed over.
    before = Window.partitionBy("_key").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    closing = closing.select("_key", "batch_id", F.last("_last", ignorenulls=True).over(before).alias("previous_price"))
    # The quote's own symbol is not folded: only one that already is can have a previous price.
    closing = closing.withColumnsRenamed({"_key": "_k", "batch_id": "_b"})
    same = (keyed["symbol"] == closing["_k"]) & (keyed["batch_id"] == closing["_b"])
    return compared(keyed.join(closing, same, "left").drop("_key", "_k", "_b"))


def skipped(requested: DataFrame, quotes: DataFrame) -> DataFrame:
    """pos, symbol of requested symbols without a quote, both sides folded; order and repeats of the request stay."""
    asked = requested.select("pos", text.folded(F.col("symbol")).alias("symbol")).filter("symbol != ''")
    got = quotes.select(text.folded(F.col("symbol")).alias("symbol")).distinct()
    return asked.join(got, "symbol", "left_anti").select("pos", "symbol")


def first_seen(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """key, pos: distinct keys with their first place."""
    return rows.groupBy(key).agg(F.min(pos).alias(pos))


def largest_moves(observations: DataFrame) -> DataFrame:
    """batch_id, symbol, percent_change with the largest move of each batch; ties to the smallest ordinal."""
    size = F.abs("percent_change") * 100
    moved = observations.filter("percent_change IS NOT NULL").withColumn("_place", in_order(size, -F.col("ordinal")))
    best = moved.groupBy("batch_id").agg(F.max("_place").alias("_place"))
    return moved.join(best, ["batch_id", "_place"]).select("batch_id", "symbol", "percent_change")
