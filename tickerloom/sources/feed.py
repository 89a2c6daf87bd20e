"""A Python data source that requests one quote response a symbol, each in a partition of its own.

    spark.dataSource.register(QuoteFeed)
    spark.read.format("quote_feed").option("symbols", "IBM,KO").load()

The rows are responses, for `tickerloom.sources.quotes.parse`.  `opener` names a function `module:function` of (url, timeout) that
returns the response body, in place of the network.
"""

from __future__ import annotations

import importlib
from datetime import UTC, datetime
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the feed's interface.
URL = "https://stooq.com/q/l/"
PARAMETERS = {"f": "sd2t2ohlcv", "e": "csv"}
TIMEOUT = 15.0


def market_symbol(symbol: str) -> str:
    """The exchange form of a symbol; a blank one raises ValueError."""
    name = symbol.strip().upper()
    if not name:
        raise ValueError("a stock symbol cannot be blank")
    return name if "." in name else f"{name}.US"


def open_url(url: str, timeout: float) -> str:
    with urlopen(Request(url, headers={"User-Agent": "tickerloom"}), timeout=timeout) as response:  # noqa: S310
        return response.read().decode("utf-8")


class QuoteFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quote_feed"

    def schema(self) -> str:
        return "response_id long, body string, requested array<string>, fetched_at_utc timestamp, source_url string"

    def reader(self, schema) -> DataSourceReader:
        return QuoteReader(dict(self.options))


class SymbolPartition(InputPartition):
    def __init__(self, place: int, symbol: str, market: str):
        super().__init__(place)
        self.place, self.symbol, self.market = place, symbol, market


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = options.get("symbols", "")
        symbols = given.split(",") if given else []
        # Every symbol is checked before anything is requested.
        self.asked = [(s.strip().upper(), market_symbol(s)) for s in symbols]
        if not self.asked:
            raise ValueError("at least one symbol is required")
        self.timeout = float(options.get("timeout", TIMEOUT))
        self.url = options.get("url", URL)
        self.opener = options.get("opener", "")

    def partitions(self):
        return [SymbolPartition(k, s, m) for k, (s, m) in enumerate(self.asked)]

    def read(self, partition: SymbolPartition):
        fetch = open_url
        if self.opener:
            module, _, function = self.opener.partition(":")
            fetch = getattr(importlib.import_module(module), function)
        url = f"{self.url}?{urlencode({'s': partition.market, **PARAMETERS})}"
        at = datetime.now(UTC)
        yield partition.place, fetch(url, self.timeout), [partition.symbol], at, url
