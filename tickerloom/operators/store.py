"""The store of observations: Parquet in one directory a batch, CSV only at the edges.

Every `append` without a batch_id adds a batch of its own, whose number is reserved by a file that only one writer can create; with one, it replaces that
batch as a whole (by nothing, if there are no rows), so a retry leaves no repeats.  Layouts evolve by name on reading: missing columns are null, unknown
ones are dropped, and no file is rewritten.  `_latest` keeps the last prices as of some batches, so a run reads those and the batches since, not all history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tickerloom.functions import numbers, text
from tickerloom.operators.observe import latest, observe
from tickerloom.schema import CHANGE, EXPORT_COLUMNS, PERCENT, PRICE, STORED


def aligned(df: DataFrame, schema: T.StructType = STORED) -> DataFrame:
    """df in the columns and types of schema, by name."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def migrated(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Rows of two layouts in the layout of newer."""
    return newer.unionByName(aligned(older, newer.schema))


def same_layout(df: DataFrame, columns=EXPORT_COLUMNS) -> bool:
    """Whether df has exactly these columns in this order."""
    return tuple(df.columns) == tuple(columns)


def _files(spark: SparkSession, path: str):
    """(file system, path) of a name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def _numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """The numbers that name the files and folders in path, after a prefix."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def batches(spark: SparkSession, path: str) -> list[int]:
    """The batches that are stored."""
    return _numbers(spark, path, "batch_id=")


def reserve(spark: SparkSession, path: str) -> int:
    """A batch number that nobody else gets: one above all that are stored or reserved."""
    files, _ = _files(spark, path)
    while True:
        number = max([0, *batches(spark, path), *_numbers(spark, f"{path}/_reserved")]) + 1
        _, mark = _files(spark, f"{path}/_reserved/{number}")
        if files.createNewFile(mark):
            return number


def kept_number(spark: SparkSession, folder: str) -> int | None:
    """The number that a folder keeps, if any."""
    return next(iter(_numbers(spark, folder)), None)


def keep_number(spark: SparkSession, folder: str, number: int) -> int:
    """Let a folder keep a number, by a file of that name."""
    files, mark = _files(spark, f"{folder}/{number}")
    files.createNewFile(mark)
    return number


def history(spark: SparkSession, path: str) -> DataFrame:
    """All stored observations; no rows where nothing was stored yet."""
    if not batches(spark, path):
        return spark.createDataFrame([], STORED)
    return aligned(spark.read.schema(STORED).option("basePath", path).parquet(path))


def _last(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """symbol, price, batch_id, ordinal: rows among which are the last prices before batch_id, from a snapshot and the batches since."""
    columns = ["symbol", "price", "batch_id", "ordinal"]
    rows = history(spark, path).filter(F.col("batch_id") < batch_id).select(*columns)
    known = [n for n in _numbers(spark, f"{path}/_latest") if n < batch_id]
    if not known:
        return rows
    kinds = ", ".join(f"{c} {STORED[c].dataType.simpleString()}" for c in columns)
    return rows.filter(F.col("batch_id") > known[-1]).unionByName(spark.read.schema(kinds).parquet(f"{path}/_latest/{known[-1]}"))


def latest_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """symbol_key, price: the last prices of all batches before batch_id."""
    return latest(_last(spark, path, batch_id))


def snapshot(spark: SparkSession, path: str, batch_id: int) -> None:
    """Keep the last prices as of batch_id, itself included."""
    last = latest(_last(spark, path, batch_id + 1)).select(F.col("symbol_key").alias("symbol"), "price", F.lit(batch_id).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("ordinal"))
    last.write.mode("overwrite").parquet(f"{path}/_latest/{batch_id}")


def _forget(spark: SparkSession, path: str, since: int) -> None:
    """Drop the snapshots that a batch `since` has made stale."""
    for number in _numbers(spark, f"{path}/_latest"):
        if number >= since:
            _delete(spark, f"{path}/_latest/{number}")


def backfill(spark: SparkSession, path: str, observations: DataFrame) -> None:
    """Store many batches at once: observations with batch_id and ordinal; batches already there are replaced as wholes.

    Rows are dealt by batch and a part of it, so that a batch makes a few files and a large one is not written by one task.
    """
    rows = aligned(observations)
    dealt = rows.repartition("batch_id", F.pmod(F.xxhash64("symbol", "ordinal"), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    _forget(spark, path, 0)


def append(spark: SparkSession, path: str, observations: DataFrame, batch_id: int | None = None, summary: str = "") -> int:
    """Store observations (with an `ordinal`, the order of their quotes) as a new batch, or in place of batch_id; the batch's number."""
    number = reserve(spark, path) if batch_id is None else batch_id
    rows = aligned(observations.withColumns({"batch_id": F.lit(number), "run_summary": F.lit(summary)}))
    if rows.isEmpty():
        _delete(spark, f"{path}/batch_id={number}")
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    _forget(spark, path, number)
    return number


def append_quotes(spark: SparkSession, path: str, quotes: DataFrame, batch_id: int | None = None) -> int:
    """Observe quotes against the store as it was before this batch, and store them without a summary; the batch's number."""
    number = reserve(spark, path) if batch_id is None else batch_id
    return append(spark, path, observe(quotes, latest_before(spark, path, number)), number)


def text_rows(observations: DataFrame, summary: str | None = None) -> DataFrame:
    """The export columns as text: null is empty, decimals without trailing zeros, percents with two places."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in STORED.fields if f.name not in observations.columns}
    observations = observations.withColumns(missing)  # a plain quote is an observation that nothing is known of
    own = F.coalesce("run_summary", F.lit("")) if "run_summary" in observations.columns else F.lit("")
    shown = {name: numbers.plain(F.col(name)) for name in ("price", "open", "high", "low", "previous_price", "price_change")}
    shown |= {
        "fetched_at_utc": text.iso_timestamp(F.col("fetched_at_utc")),
        "percent_change": numbers.fixed(F.col("percent_change")),
        "run_summary": own if summary is None else F.lit(summary),
    }
    for name in EXPORT_COLUMNS:
        if name not in shown:
            shown[name] = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return observations.select(*[shown[name].alias(name) for name in EXPORT_COLUMNS])


def export_csv(observations: DataFrame, path: str) -> None:
    """The export layout as CSV: header, minimal quoting, CRLF; rows in order of batch and ordinal."""
    # Sorted by range: the files, by name, hold the rows in order.
    ordered = observations.orderBy("batch_id", "ordinal") if {"batch_id", "ordinal"} <= set(observations.columns) else observations
    rows = text_rows(ordered)
    rows.write.mode("overwrite").option("header", "true").option("emptyValue", "").option("escape", '"').option("lineSep", "\r\n").csv(path)


def import_csv(spark: SparkSession, path: str, batch_id: int = 0) -> DataFrame:
    """A history file of the current or an older layout, columns bound by its header, ordinals in file order."""
    if not _exists(spark, path):
        return spark.createDataFrame([], STORED)
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("enforceSchema", "false").csv(path)
    if not raw.columns:
        return spark.createDataFrame([], STORED)
    have = set(raw.columns)
    # A file is read by one task, in order; Spark deals files by size, so their own order is that of their names.
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    files = raw.groupBy("_file").agg(F.min("_at").alias("_begin"), F.count("*").alias("_rows"))
    ahead = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("_file").alias("_name"), "_begin", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    raw = raw.join(files, F.col("_file") == F.col("_name")).withColumn("ordinal", F.col("_ahead") + F.col("_at") - F.col("_begin"))
    kinds = {"open": PRICE, "high": PRICE, "low": PRICE, "previous_price": PRICE, "price_change": CHANGE, "percent_change": PERCENT}

    def column(name: str):
        if name not in have:
            return F.lit("" if name == "run_summary" else None)
        if name == "price":
            clean = text.strip(F.coalesce(name, F.lit("")))
            bad = F.raise_error(F.concat(F.lit("no price: "), clean)).cast(PRICE)
            keyed = text.strip(F.coalesce("symbol", F.lit(""))) != ""
            return F.when((clean == "") | ~keyed, F.lit(None)).otherwise(F.coalesce(numbers.decimal(clean), bad))
        if name in kinds:
            return numbers.optional_decimal(F.col(name)).cast(kinds[name])
        if name == "volume":
            return numbers.optional_whole(F.col(name))
        if name == "fetched_at_utc":
            return F.col(name).try_cast("timestamp")
        return F.col(name)

    rows = raw.select(*[column(c).alias(c) for c in EXPORT_COLUMNS], "ordinal", F.lit(batch_id).alias("batch_id"))
    return aligned(rows)


def numbered(quotes: DataFrame, *order: str) -> DataFrame:
    """quotes (one batch, as many as symbols were asked for) with `ordinal` by the given order."""
    return quotes.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)).cast("long"))
