"""Continuous collection: each micro-batch of a quote stream is one batch of the store, replaced as a whole if it is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom.operators import store
from tickerloom.operators.observe import in_order


def _first_batch(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The store's batch of a stream's epoch 0: above all that were there when the stream first started, and kept beside its checkpoint."""
    kept = store.kept_number(spark, f"{checkpoint}/first_batch")
    if kept is None:
        kept = store.keep_number(spark, f"{checkpoint}/first_batch", max([0, *store.batches(spark, path)]) + 1)
    return kept


def collect_stream(quotes: DataFrame, path: str, checkpoint: str, order: str = "ordinal", **trigger) -> StreamingQuery:
    """Observe and store every micro-batch of quotes (a streaming DataFrame in quote columns, with ordinal or another order column).

    A retried epoch replaces its own batch; a new stream, or one whose checkpoint is lost, goes on above what the store holds.
    """
    first = _first_batch(quotes.sparkSession, path, checkpoint)

    def one(batch: DataFrame, epoch: int) -> None:
        rows = batch if order == "ordinal" else batch.withColumn("ordinal", F.col(order).cast("long"))
        store.append_quotes(batch.sparkSession, path, rows, first + epoch)

    return quotes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(quotes: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """symbol, start, quotes, low, high, last of tumbling windows; quotes later than `late` are left out."""
    stamped = quotes.withColumn("fetched_at_utc", F.col("fetched_at_utc").cast("timestamp")).withWatermark("fetched_at_utc", late)
    rows = stamped.groupBy("symbol", F.window("fetched_at_utc", size).alias("w")).agg(
        F.count("*").alias("quotes"), F.min("price").alias("low"), F.max("price").alias("high"), F.max_by("price", in_order(F.unix_micros("fetched_at_utc"), F.col("ordinal"))).alias("last")
    )
    return rows.select("symbol", F.col("w.start").alias("start"), "quotes", "low", "high", "last")
