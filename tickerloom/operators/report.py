"""Reports of a run: the console table, summary lines and the prompts that a language model gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import numbers, text
from tickerloom.schema import MAX_PLAN_SYMBOLS, SUPPORTED

# What the plan parser and the reader of a report need is said here; the JSON keys and the lines of rows are fixed.
PLANNING = """Task: turn a request into the tickers whose delayed prices will be looked up.

Reply: one JSON object, nothing around it
{"symbols":["TICKER"],"rationale":"short reason"}
where "symbols" lists between 1 and %d strings, most important first, each a ticker of a US exchange as it is traded (letters in capitals, no ".US" or other
ending), and "rationale" is a phrase. A string that is not a real ticker is thrown away. If the request names an industry instead of companies, answer with
its best-known, most traded ones.%s

Request: %s
"""
KNOWN = " For %s the feed has %s."
SUMMARY = """These lines are the outcome of one look-up of stock prices, a line for each stock. Tell a reader in at most two sentences what stands out,
starting with the stock that moved most if any line has a previous price. State facts from the lines; advise nothing.

Asked for: %s
Chosen: %s
Lines:
%s
"""
NO_REQUEST, NO_PLAN = "the stocks below, by name", "by the user"


def planning_prompt(request: str) -> str:
    known = "".join(KNOWN % (sector, ", ".join(tickers)) for sector, tickers in SUPPORTED.items())
    return PLANNING % (MAX_PLAN_SYMBOLS, known, request)


def summary_line() -> Column:
    """One observation in words."""
    na = text.or_na
    return F.concat(
        F.lit("- "), F.col("symbol"), F.lit(": price "), numbers.plain(F.col("price")), F.lit(" "), F.col("currency"),
        F.lit("; previous "), na(numbers.plain(F.col("previous_price"))), F.lit("; change "), na(numbers.plain(F.col("price_change"))),
        F.lit("; percent "), na(numbers.fixed(F.col("percent_change"))), F.lit("%"),
    )


def joined(lines: Column, pos: Column, separator: str = "\n") -> Column:
    """An aggregate: lines in the order of pos, joined."""
    ordered = F.array_sort(F.collect_list(F.struct(pos.alias("pos"), lines.alias("line"))))
    return F.array_join(F.transform(ordered, lambda x: x["line"]), separator)


def summary_lines(observations: DataFrame, *by: str) -> DataFrame:
    """by, lines: the summary lines of each group in order of ordinal, as one text.

    A group is a report that a reader or a model gets, so it has to fit one row; `report_lines` has the same lines as rows, for groups of any size.
    """
    return observations.groupBy(*by).agg(joined(summary_line(), F.col("ordinal")).alias("lines"))


def report_lines(observations: DataFrame, *by: str) -> DataFrame:
    """by, ordinal, line: the summary lines as rows."""
    return observations.select(*by, "ordinal", summary_line().alias("line"))


def summary_prompt(lines: str, request: str | None, plan: tuple[list[str], str] | None) -> str:
    shown = f"Symbols: {', '.join(plan[0])}. Rationale: {plan[1]}" if plan else NO_PLAN
    return SUMMARY % (request or NO_REQUEST, shown, lines)


def table(observations: DataFrame) -> DataFrame:
    """The eight columns of the console table, as text, with ordinal."""
    percent = F.when(F.col("percent_change").isNotNull(), F.concat(F.col("percent_change").cast("string"), F.lit("%"))).otherwise(F.lit(""))
    return observations.select(
        "ordinal", F.col("symbol").alias("Symbol"), F.concat_ws(" ", numbers.plain(F.col("price")), "currency").alias("Price"),
        numbers.plain(F.col("previous_price")).alias("Previous"), numbers.plain(F.col("price_change")).alias("Change"), percent.alias("%"),
        F.col("quote_date").alias("Quote date"), F.col("quote_time").alias("Quote time"), F.col("source").alias("Source"),
    )


def run_counts(observations: DataFrame) -> DataFrame:
    """batch_id, quotes, last_price: how many rows a batch added and its last price as text."""
    last = F.max_by("price", "ordinal")
    return observations.groupBy("batch_id").agg(F.count("*").alias("quotes"), numbers.plain(last).alias("last_price"))
