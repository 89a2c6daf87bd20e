"""One run: choose symbols, read quotes, observe them, summarise, store.  Everything that can fail comes before the only write.

    python -m tickerloom.collect IBM KO --table /data/quotes
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import text
from tickerloom.operators import observe, report, store
from tickerloom.plans import symbols as plans
from tickerloom.schema import DEFAULT_SYMBOLS
from tickerloom.session import fixed
from tickerloom.sources import feed, quotes

#: symbols -> responses, as `tickerloom.sources.quotes.parse` reads them.
Source = Callable[[SparkSession, Sequence[str]], DataFrame]


def network_source(spark: SparkSession, symbols: Sequence[str]) -> DataFrame:
    spark.dataSource.register(feed.QuoteFeed)
    return spark.read.format("quote_feed").option("symbols", ",".join(symbols)).load()


@dataclass
class Run:
    batch_id: int
    observations: DataFrame
    skipped: list[str]
    plan: tuple[list[str], str] | None
    summary: str


def run(
    spark: SparkSession,
    symbols: Sequence[str] | None,
    path: str,
    *,
    source: Source = network_source,
    request: str | None = None,
    planner: Callable[[str], str] | None = None,
    summarizer: Callable[[str], str] | None = None,
    batch_id: int | None = None,
    defaults: Sequence[str] = DEFAULT_SYMBOLS,
) -> Run:
    """A request in words needs a planner, whose symbols replace those given; a batch_id makes the run repeatable."""
    plan = None
    if request is not None:
        if planner is None:
            raise ValueError("a request in words needs a planner")
        if not request.strip():
            raise ValueError("the request is blank")
        plan = plans.one(spark, planner(report.planning_prompt(request.strip())))
        symbols = plan[0]
    symbols = list(symbols or defaults)
    if not symbols:
        raise ValueError("at least one symbol is required")
    for symbol in symbols:
        feed.market_symbol(symbol)
    # Requested once: every later step sees the same responses.
    responses = fixed(source(spark, symbols))
    found = store.numbered(quotes.strict(quotes.parse(responses)).join(_order(spark, symbols), "symbol", "left"), F.col("_pos").asc_nulls_last(), "symbol").drop("_pos")
    batch = store.reserve(spark, path) if batch_id is None else batch_id
    # What is stored must not be computed from the directory it goes to.
    seen = fixed(observe.observe(found, store.latest_before(spark, path, batch)))
    requested = spark.createDataFrame(list(enumerate(symbols)), "pos long, symbol string")
    missing = [row["symbol"] for row in observe.skipped(requested, found).orderBy("pos").collect()]
    summary = ""
    if summarizer is not None and not seen.isEmpty():
        lines = seen.agg(report.joined(report.summary_line(), F.col("ordinal")).alias("lines")).first()["lines"]
        summary = summarizer(report.summary_prompt(lines, request, plan))
    store.append(spark, path, seen, batch, summary)
    store.snapshot(spark, path, batch)
    return Run(batch, seen, missing, plan, summary)


def _order(spark: SparkSession, symbols: Sequence[str]) -> DataFrame:
    """symbol, _pos: the first place of each requested symbol, folded as quotes name it."""
    asked = spark.createDataFrame(list(enumerate(symbols)), "_pos long, symbol string")
    return asked.withColumn("symbol", text.folded(F.col("symbol"))).groupBy("symbol").agg(F.min("_pos").alias("_pos"))


def collected(runs: Sequence[Run]) -> DataFrame:
    """The observations of several runs."""
    return reduce(DataFrame.unionByName, [r.observations for r in runs])


def reason(error: Exception) -> str:
    """What went wrong, in a line: of an error inside Spark, its own message without the stack."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip() and not line.lstrip().startswith(("at ", "File ", "Traceback", "=="))]
    if isinstance(error, PythonException):
        return next((line for line in reversed(lines) if "Error" in line or "Exception" in line), lines[0])
    return lines[0] if lines else type(error).__name__


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, source: Source = network_source, analyst=None) -> int:
    parser = argparse.ArgumentParser(description="Collect delayed stock quotes and store them.")
    parser.add_argument("symbols", nargs="*")
    parser.add_argument("--table", "--store", "-t", dest="store", default="data/quotes")
    parser.add_argument("--request", "-r")
    parser.add_argument("--model", "-m")
    parser.add_argument("--ollama-url", "--base-url", dest="base_url")
    given = parser.parse_args(argv)
    from tickerloom.session import session

    spark = spark or session()
    if given.request and analyst is None:
        from tickerloom.analysts import BASE_URL, MODEL, LocalAnalyst

        analyst = LocalAnalyst(given.model or MODEL, given.base_url or BASE_URL)
    planner, summarizer = (analyst.plan, analyst.summarize) if given.request else (None, None)
    try:
        done = run(spark, given.symbols, given.store, source=source, request=given.request, planner=planner, summarizer=summarizer)
    except (OSError, ValueError, SparkRuntimeException, PythonException) as error:
        # A row that cannot be read and a request that fails are raised inside Spark.
        print(f"Stock price collection failed: {reason(error)}", file=sys.stderr)
        return 1
    if done.plan:
        print(f"Plan: {', '.join(done.plan[0])}")
        if done.plan[1]:
            print(done.plan[1])
    if done.skipped:
        print(f"Skipped unsupported symbols: {', '.join(done.skipped)}")
    count = done.observations.count()
    print(f"Added {count} quote rows to {given.store}")
    report.table(done.observations).orderBy("ordinal").drop("ordinal").show(count, truncate=False)
    if done.summary:
        print(f"Summary: {done.summary}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
