"""Feed parsing, symbols, numbers and the data source."""

from datetime import UTC, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import numbers, text
from tickerloom.sources import feed, quotes

AT = datetime(2031, 2, 6, 21, 30, tzinfo=UTC)
HEADER = "Symbol,Date,Time,Open,High,Low,Close,Volume\n"


def parsed(spark, body, requested=("IBM",)):
    rows = [(1, body, list(requested), AT, "https://example.test")]
    return quotes.parse(spark.createDataFrame(rows, "response_id int, body string, requested array<string>, fetched_at_utc timestamp, source_url string"))


def test_header_binds_by_name(spark):
    row = parsed(spark, HEADER + "IBM.US,2031-02-06,21:30:05,41.07,43.5,40.9,42.25,730011\n").first()
    assert (row.status, row.symbol, row.market_symbol, row.price, row.currency, row.volume) == ("ok", "IBM", "IBM.US", Decimal("42.250000"), "USD", 730011)
    row = parsed(spark, "Close,Symbol,Date\r\n5,ibm.us ,d\r\n").first()
    assert (row.price, row.symbol, row.quote_date, row.quote_time, row.open, row.volume) == (Decimal("5.000000"), "IBM", "d", "", None, None)


def test_headerless(spark):
    row = parsed(spark, "IBM.US,2031-02-07,09:01:02,8.5,8.75,8.25,8.625,99").first()
    assert (row.symbol, row.price, row.quote_time, row.high) == ("IBM", Decimal("8.625000"), "09:01:02", Decimal("8.750000"))


def test_a_lower_case_header_is_data_with_a_bad_price(spark):
    rows = parsed(spark, "symbol,date,time,open,high,low,close,volume\nIBM.US,d,t,,,,1,\n").orderBy("line").collect()
    assert [r.status for r in rows] == ["bad_price", "ok"]


def test_dates_and_times_are_stripped(spark):
    row = parsed(spark, "IBM.US, 2031-02-06 ,\t21:30:05 ,1,1,1, 1 ,1").first()
    assert (row.quote_date, row.quote_time, row.price) == ("2031-02-06", "21:30:05", 1)


def test_lines_are_cut_into_fields_once(spark):
    """In the plan, as in the code: the lines of a body once, no regular expression a field."""
    plan = parsed(spark, HEADER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("split(") == 1 and plan.count("regexp_replace") <= 2


def test_no_data_is_no_quote(spark):
    found = parsed(spark, "UALF.US,N/D,N/D,N/D,N/D,N/D,N/D,N/D", ["UALF"])
    assert quotes.usable(found).count() == 0
    with pytest.raises(quotes.NoQuotesError):
        quotes.strict(found)


@pytest.mark.parametrize(
    ("line", "status"),
    [
        ("A.US,d,t,1,1,1,,1", "bad_price"), ("A.US,d,t,1,1,1,n/d,1", "bad_price"), ("A.US,d,t,1,1,1,NaN,1", "bad_price"), ("A.US,d,t,1,1,1,1_000,1", "bad_price"),
        ("A.US,d,t,x,1,1,1,1", "bad_number"), ("A.US,d,t,1,1,1,1,4100000.0", "bad_number"), ("A.US,d,t,N/D,,1,1,", "ok"), ("A.US,d,t", "bad_price"),
        ("A.US,d,t,1,1,1,1.0000001,1", "bad_price"), ("A.US,d,t,1,1,1,1E+3,1", "ok"),
    ],
)
def test_statuses(spark, line, status):
    found = parsed(spark, line)
    assert found.first().status == status
    if status.startswith("bad"):
        with pytest.raises(Exception, match="bad_"):
            quotes.strict(found).collect()


def test_aliases(spark):
    body = "ibm.us,d,t,1,1,1,1,1\nKO.US,d,t,1,1,1,2,1\nBRK.B,d,t,1,1,1,3,1"
    rows = parsed(spark, body, [" ibm.us ", "brk.b", "x"]).orderBy("line").collect()
    assert [r.symbol for r in rows] == ["IBM.US", "KO", "BRK.B"]


def test_lines_split_at_every_break_and_quotes_are_undone(spark):
    body = 'A.US,"d,1",t,1,1,1,1,1 B.US,"say ""x""",t,1,1,1,2,1\x1c\x85C.US,d,t,1,1,1,3,1'
    rows = parsed(spark, body).orderBy("line").collect()
    assert [(r.symbol, r.quote_date) for r in rows] == [("A", "d,1"), ("B", 'say "x"'), ("C", "d")]


def test_emptiness(spark):
    rows = [(1, "A.US,d,t,1,1,1,N/D,1", [], AT, ""), (2, "A.US,d,t,1,1,1,1,1", [], AT, ""), (3, "", [], AT, ""), (4, None, None, None, None)]
    responses = spark.createDataFrame(rows, "response_id int, body string, requested array<string>, fetched_at_utc timestamp, source_url string")
    found = quotes.emptiness(quotes.parse(responses), responses).orderBy("response_id").collect()
    assert [(r.quotes, r.is_empty) for r in found] == [(0, True), (1, False), (0, True), (0, True)]


SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


def test_strip_is_that_of_str(spark):
    rows = spark.createDataFrame([(f"{c}a{c}b{c}{c}",) for c in SPACES], "s string")
    assert len(SPACES) == 29
    assert [r[0] for r in rows.select(text.strip(F.col("s"))).collect()] == [f"a{c}b" for c in SPACES]


def test_symbols(spark):
    given = ["ibm", " brk.b.us", "brk.b", " ", "", "bac.us", "big banks", "A1-B", "TOOLONG7", "ko\n", "1A", "straß"]
    row = spark.createDataFrame([(k, s) for k, s in enumerate(given)], "k int, s string").select("k", text.market_symbol(F.col("s")), text.plan_symbol(F.col("s"))).orderBy("k").collect()
    assert [r[1] for r in row[:5]] == ["IBM.US", "BRK.B.US", "BRK.B", None, None]
    assert [r[2] for r in row] == ["IBM", "BRK", "BRK", None, None, "BAC", None, "A1-B", None, "KO", None, "STRASS"]


def test_percent_rounds_half_to_even(spark):
    pairs = [("100.005", "100"), ("1.00015", "1"), ("5", "0"), ("5", None), ("105", "100"), ("99.995", "100")]
    rows = spark.createDataFrame([(Decimal(a), Decimal(b) if b else None) for a, b in pairs], "p decimal(18,6), q decimal(18,6)")
    got = [tuple(r) for r in rows.select(numbers.change(F.col("p"), F.col("q")), numbers.percent(F.col("p"), F.col("q"))).collect()]
    assert [g[1] for g in got] == [Decimal("0.00"), Decimal("0.02"), None, None, Decimal("5.00"), Decimal("0.00")]
    assert got[2][0] == 5 and got[3][0] is None


def test_plain_text_of_decimals(spark):
    rows = spark.createDataFrame([(Decimal(x),) for x in ("100", "283.04", "0", "0.5", "-10.10")] + [(None,)], "p decimal(18,6)")
    assert [r[0] for r in rows.select(numbers.plain(F.col("p"))).collect()] == ["100", "283.04", "0", "0.5", "-10.1", ""]


def test_iso_timestamps(spark):
    rows = spark.createDataFrame([(datetime(2026, 5, 13, 10, 15, tzinfo=UTC),), (datetime(2026, 5, 13, 10, 15, 0, 120, tzinfo=UTC),)], "t timestamp")
    assert [r[0] for r in rows.select(text.iso_timestamp(F.col("t"))).collect()] == ["2026-05-13T10:15:00+00:00", "2026-05-13T10:15:00.000120+00:00"]


def opened(url, timeout):
    symbol = url.split("s=")[1].split("&")[0]
    return f"{symbol},2026-01-02,10:00:00,1,2,0.5,{'N/D' if symbol == 'UALF.US' else '1.5'},7"


def test_data_source_has_a_partition_a_symbol(spark):
    spark.dataSource.register(feed.QuoteFeed)
    rows = spark.read.format("quote_feed").option("symbols", "ibm,UALF").option("opener", "tests.test_quotes:opened").load()
    assert rows.rdd.getNumPartitions() == 2
    found = {r.symbol: r.price for r in quotes.usable(quotes.parse(rows)).collect()}
    assert found == {"IBM": Decimal("1.500000")}


def test_a_blank_symbol_fails_before_any_request():
    with pytest.raises(ValueError, match="blank"):
        feed.QuoteReader({"symbols": "IBM, "})
