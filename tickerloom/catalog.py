"""Registered queries over the driver tables, and the SQL that DuckDB answers them with.

`events` is the quote feed: a user is a symbol, a day a batch, the event's number the order within it, and an event of type `error` a
row without data.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import numbers, text
from tickerloom.operators import observe, report, store
from tickerloom.plans import symbols as plans
from tickerloom.schema import CURRENCY, SOURCE
from tickerloom.session import scratch
from tickerloom.sources import quotes as feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FIRST_DAY = "2024-01-01"
MONEY = "decimal(18,2)"


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ordinal, batch_id, price, fetched_at_utc, event_type of every event."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("symbol"),
        F.col("event_id").alias("ordinal"),
        F.datediff("ts", F.lit(FIRST_DAY).cast("date")).alias("batch_id"),
        F.col("value").cast(MONEY).alias("price"),
        F.col("ts").cast("timestamp").alias("fetched_at_utc"),
        "event_type",
    )


#: Events as quotes, in DuckDB.
FEED = f"""
feed AS (
  SELECT user_id::VARCHAR AS symbol, event_id AS ordinal, CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) AS INTEGER) AS batch_id,
         CAST(value AS DECIMAL(18,2)) AS price, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS HUGEINT) AS cents, ts, event_type
  FROM events
)"""

#: Half-even percent of integer cents: pc and vc are price and previous price, null-safe and zero-safe.
PERCENT = """
CASE WHEN vc IS NOT NULL AND vc <> 0 THEN CAST(CAST(
  CASE WHEN 2 * abs((pc - vc) * 10000 - ((pc - vc) * 10000 // vc) * vc) < abs(vc)
         OR (2 * abs((pc - vc) * 10000 - ((pc - vc) * 10000 // vc) * vc) = abs(vc) AND ((pc - vc) * 10000 // vc) % 2 = 0)
       THEN (pc - vc) * 10000 // vc ELSE (pc - vc) * 10000 // vc + sign(pc - vc) * sign(vc) END
  AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) END"""

#: Every event with the last price its symbol had before its day.
REPLAY = f"""{FEED},
closing AS (SELECT symbol, batch_id, arg_max(price, ordinal) AS last_price FROM feed GROUP BY ALL),
before AS (SELECT symbol, batch_id, lag(last_price) OVER (PARTITION BY symbol ORDER BY batch_id) AS previous_price FROM closing),
seen AS (
  SELECT f.*, b.previous_price, f.cents AS pc, CAST(b.previous_price * 100 AS HUGEINT) AS vc
  FROM feed f JOIN before b USING (symbol, batch_id)
),
observed AS (
  SELECT ordinal, symbol, batch_id, price, ts, previous_price, CAST(price - previous_price AS DECIMAL(19,6)) AS price_change, {PERCENT} AS percent_change
  FROM seen
)"""


def plain_sql(number: str) -> str:
    return f"coalesce(regexp_replace(CAST({number} AS VARCHAR), '[.]?0+$', ''), '')"


@query(f"WITH {REPLAY} SELECT ordinal, symbol, batch_id, price, previous_price, price_change, percent_change FROM observed")
def price_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote with the last price before its batch, the change and the half-even percentage."""
    seen = observe.replay(event_quotes(spark, sf_dir))
    return seen.select("ordinal", "symbol", "batch_id", "price", "previous_price", "price_change", "percent_change")


@query(f"WITH {FEED} SELECT symbol AS symbol_key, arg_max(price, ordinal) AS price FROM feed WHERE event_type <> 'error' GROUP BY symbol")
def latest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last saved price of each symbol."""
    return observe.latest(event_quotes(spark, sf_dir).filter("event_type <> 'error'"))


@query(f"""WITH {FEED}, last_day AS (SELECT max(batch_id) AS d FROM feed),
saved AS (SELECT symbol, arg_max(price, ordinal) AS previous_price FROM feed, last_day WHERE batch_id < d GROUP BY symbol),
seen AS (SELECT f.*, s.previous_price, f.cents AS pc, CAST(s.previous_price * 100 AS HUGEINT) AS vc
         FROM feed f JOIN last_day ON batch_id = d LEFT JOIN saved s USING (symbol))
SELECT ordinal, symbol, price, previous_price, CAST(price - previous_price AS DECIMAL(19,6)) AS price_change, {PERCENT} AS percent_change FROM seen""")
def incremental_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last batch against the store as it was before: what a run does."""
    rows = event_quotes(spark, sf_dir)
    # A run knows its batch; here it is the last one.
    last = rows.agg(F.max("batch_id")).first()[0]
    seen = observe.observe(rows.filter(F.col("batch_id") == last), observe.latest(rows.filter(F.col("batch_id") < last)))
    return seen.select("ordinal", "symbol", "price", "previous_price", "price_change", "percent_change")


def feed_responses(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """A response an event: every other one with a header, some fields missing; `broken` spoils some prices and volumes."""
    rows = event_quotes(spark, sf_dir)
    n, price = F.col("ordinal"), F.col("price").cast("string")
    close = F.when(F.col("event_type") == "error", "N/D").when(F.lit(broken) & (n % 7 == 0), "").otherwise(price)
    first = F.when(n % 3 == 0, F.lit("N/D")).otherwise(price)
    volume = F.when(F.lit(broken) & (n % 11 == 0), "4100000.0").when(n % 5 == 0, "").otherwise(n.cast("string"))
    market = F.concat(F.lit(" u"), F.col("symbol"), F.lit(".us"))
    day, hour = F.date_format("fetched_at_utc", "yyyy-MM-dd"), F.date_format("fetched_at_utc", "HH:mm:ss")
    usual = F.concat_ws(",", market, day, hour, first, F.lit(""), price, F.concat(close, F.lit(" ")), volume)
    named = F.concat_ws(",", close, volume, market, day, hour, price, F.lit(""), first, F.lit('"a, ""b"""'))
    named = F.concat(F.lit("Close,Volume,Symbol,Date,Time,Low,High,Open,Note\r\n"), named)
    asked = F.when(n % 4 < 2, F.array(F.lower(F.concat(F.lit("u"), "symbol")))).otherwise(F.array(F.concat(F.lit("U"), "symbol", F.lit(".US"))))
    body = F.when(n % 2 == 0, named).otherwise(usual)
    return rows.select(n.alias("response_id"), body.alias("body"), asked.alias("requested"), "fetched_at_utc", F.lit("https://example.test/q").alias("source_url"))


@query(f"""WITH {FEED}
SELECT ordinal AS response_id, CASE WHEN ordinal % 4 < 2 THEN 'U' || symbol ELSE 'U' || symbol || '.US' END AS symbol, 'U' || symbol || '.US' AS market_symbol,
  CAST(price AS DECIMAL(18,6)) AS price, strftime(ts, '%Y-%m-%d') AS quote_date, strftime(ts, '%H:%M:%S') AS quote_time,
  CASE WHEN ordinal % 3 <> 0 THEN CAST(price AS DECIMAL(18,6)) END AS open, CAST(NULL AS DECIMAL(18,6)) AS high, CAST(price AS DECIMAL(18,6)) AS low,
  CASE WHEN ordinal % 5 <> 0 THEN ordinal END AS volume, '{CURRENCY}' AS currency, '{SOURCE}' AS source
FROM feed WHERE event_type <> 'error'""")
def parse_quote_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote responses in CSV, with header and without, as typed quotes."""
    parsed = feed.parse(feed_responses(spark, sf_dir)).filter("status = 'ok'")
    return parsed.select("response_id", "symbol", "market_symbol", "price", "quote_date", "quote_time", "open", "high", "low", "volume", "currency", "source")


@query("""SELECT event_id AS response_id, CASE WHEN event_type = 'error' THEN 'no_data' WHEN event_id % 7 = 0 THEN 'bad_price' WHEN event_id % 11 = 0 THEN 'bad_number'
  ELSE 'ok' END AS status FROM events""")
def quote_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each feed row: no data, no price, no number, or fine."""
    return feed.parse(feed_responses(spark, sf_dir, broken=True)).select("response_id", "status")


@query("""WITH used AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS VARCHAR) || ' ' || user_id AS response, event_type <> 'error' AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS ok FROM events)
SELECT response, count(*) FILTER (WHERE ok) AS quotes, count(*) FILTER (WHERE ok) = 0 AS is_empty FROM used GROUP BY response""")
def batch_emptiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which responses, a day and symbol each, have no usable quote: by the status of every one of their rows."""
    rows = event_quotes(spark, sf_dir).select("ordinal", F.concat_ws(" ", F.col("batch_id").cast("string"), "symbol").alias("response"))
    statuses = feed.parse(feed_responses(spark, sf_dir, broken=True)).select(F.col("response_id").alias("ordinal"), "status")
    parsed = rows.join(statuses, "ordinal").select(F.col("response").alias("response_id"), "status")
    asked = rows.select(F.col("response").alias("response_id")).distinct()
    return feed.emptiness(parsed, asked).withColumnRenamed("response_id", "response")


@query("""SELECT c_custkey AS pos, 'C' || c_custkey AS symbol FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def skipped_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested symbols that got no quote: customers without an urgent order."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit(" c"), F.col("c_custkey").cast("string")).alias("symbol"))
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    got = urgent.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("symbol"))
    return observe.skipped(asked, got)


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey and a symbol made of the part's brand and size, a third of them dotted."""
    rows = table(spark, sf_dir, "part")
    name = F.concat(F.lit(" "), F.substring(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", ""), 5, 4), F.lit("x"), F.col("p_size").cast("string"))
    return rows.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit(".b"))).otherwise(name).alias("symbol"))


PART_SYMBOLS = """
named AS (SELECT p_partkey, upper(substr(regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'), 5, 4) || 'x' || p_size) || CASE WHEN p_partkey % 3 = 0 THEN '.B' ELSE '' END AS name
          FROM part)"""


@query(f"WITH {PART_SYMBOLS} SELECT p_partkey, CASE WHEN contains(name, '.') THEN name ELSE name || '.US' END AS market_symbol FROM named")
def market_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange symbols: `.US` is added unless there is a dot."""
    return part_symbols(spark, sf_dir).select("p_partkey", text.market_symbol(F.col("symbol")).alias("market_symbol"))


@query(f"""WITH {PART_SYMBOLS}, cut AS (SELECT p_partkey, split_part(name, '.', 1) AS name FROM named)
SELECT p_partkey, CASE WHEN regexp_full_match(name, '[A-Z][A-Z0-9-]{{0,5}}') THEN name END AS ticker, regexp_full_match(name, '[A-Z][A-Z0-9-]{{0,5}}') AS is_valid FROM cut""")
def llm_symbol_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which proposed symbols are tickers."""
    ticker = text.plan_symbol(F.col("symbol"))
    return part_symbols(spark, sf_dir).select("p_partkey", ticker.alias("ticker"), ticker.isNotNull().alias("is_valid"))


@query("""SELECT o_custkey || ' ' || o_orderpriority AS value, min(o_orderkey) AS first_order FROM orders GROUP BY ALL""")
def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values with their first place: each customer's priorities and the order that brought them."""
    rows = table(spark, sf_dir, "orders").select(F.concat_ws(" ", F.col("o_custkey").cast("string"), "o_orderpriority").alias("value"), F.col("o_orderkey").alias("first_order"))
    return observe.first_seen(rows, "value", "first_order")


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'N/D' WHEN 2 THEN '4100000.0' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS raw FROM events)
SELECT event_id, CASE WHEN raw NOT IN ('', 'N/D') THEN CAST(raw AS DECIMAL(18,6)) END AS amount, CASE WHEN event_id % 6 IN (3, 4, 5) THEN event_id END AS volume, raw IN ('', 'N/D') AS is_missing FROM t""")
def optional_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that may be blank or N/D; a whole number does not accept a point."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").cast(MONEY).cast("string").alias("shown"))
    n = F.col("event_id") % 6
    raw = F.when(n == 0, " ").when(n == 1, " N/D").when(n == 2, "4100000.0").otherwise(F.col("shown"))
    whole = F.when(n < 3, raw).otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string")))
    return rows.select("event_id", numbers.optional_decimal(raw).alias("amount"), numbers.optional_whole(whole).alias("volume"), numbers.missing(raw).alias("is_missing"))


@query("""SELECT event_id, props AS object, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object in a fenced reply with prose around it."""
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nAnything else?"))
    found = plans.json_object(reply)
    return table(spark, sf_dir, "events").select("event_id", found.alias("object"), F.try_variant_get(F.try_parse_json(found), "$.k", "bigint").alias("k"))


def part_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each brand of part: the types' first letters and sizes as symbols, among things that are no symbols."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat(F.substring("p_type", 1, 1), (F.col("p_size") % 9).cast("string")).alias("s"))
    listed = report.joined(F.concat(F.lit('"'), F.lower("s"), F.lit('.us"')), F.col("p_partkey"), ", ")
    return rows.groupBy("p_brand").agg(listed.alias("_listed")).select("p_brand", reply_of("_listed").alias("reply"))


def reply_of(listed: str) -> Column:
    head = F.lit('```json\n{"symbols": [true, 12, null, "big banks", ')
    return F.concat(head, F.col(listed), F.lit('], "rationale": " parts of '), F.col("p_brand"), F.lit(' "}\n```'))


PART_PLANS = """
listed AS (SELECT p_brand, upper(substr(p_type, 1, 1)) || (p_size % 9) AS s, min(p_partkey) AS pos FROM part GROUP BY ALL),
planned AS (SELECT p_brand, count(*) AS n FROM listed GROUP BY p_brand)"""


@query(f"""WITH {PART_PLANS} SELECT p_brand, CASE WHEN n > 15 THEN 'too_many' ELSE 'ok' END AS status, 'parts of ' || p_brand AS rationale FROM planned""")
def plan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a model's reply is a plan, and its rationale."""
    return plans.parse(part_replies(spark, sf_dir)).select("p_brand", "status", "rationale")


@query(f"""WITH {PART_PLANS}
SELECT l.p_brand, CASE WHEN n <= 15 THEN string_agg(s, ',' ORDER BY pos) END AS symbols FROM listed l JOIN planned USING (p_brand) GROUP BY l.p_brand, n
UNION ALL SELECT 'of ' || p_partkey, CASE WHEN p_size % 9 = 0 THEN 'KO' ELSE 'KO,' || upper(substr(p_type, 1, 1)) || (p_size % 9) END FROM part""")
def plan_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tickers of each reply, first seen first, as the plan parser gives them: none of a brand with too many, and of one part each."""
    first = F.concat(F.lit('"ko", "'), F.substring("p_type", 1, 1), (F.col("p_size") % 9).cast("string"), F.lit('.us", "KO"'))
    listed = F.when(F.col("p_size") % 9 == 0, F.lit('"KO.US", " ko", "1X"')).otherwise(first)
    one = table(spark, sf_dir, "part").select(F.concat(F.lit("of "), F.col("p_partkey").cast("string")).alias("p_brand"), listed.alias("_listed"))
    replies = part_replies(spark, sf_dir).unionByName(one.select("p_brand", reply_of("_listed").alias("reply")))
    return plans.parse(replies).select("p_brand", F.array_join("symbols", ",").alias("symbols"))


REPLIES = [
    (1, "no plan here", "no_object", ""),
    (2, '{"symbols": ["KO",}', "bad_json", ""),
    (3, '{"symbols": "JPM", "rationale": " one "}', "no_list", "one"),
    (4, '{"symbols": [], "rationale": 7}', "empty", ""),
    (5, "{" + f'"symbols": [{", ".join(f'"A{k}"' for k in range(16))}]' + "}", "too_many", ""),
    (6, '```json\n{"symbols": ["ko", "KO", true], "rationale": null}\n```', "ok", ""),
    (7, 'So: {"symbols": ["BRK.B"], "rationale": "\\tvalue\\n"} done', "ok", "value"),
]


@query("WITH replies(reply_id, status, rationale) AS (VALUES " + ", ".join(f"({n}, '{status}', '{why}')" for n, _, status, why in REPLIES) + f""")
SELECT p_partkey, status, rationale || CASE WHEN rationale = '' THEN '' ELSE ' of ' || p_partkey END AS rationale FROM part JOIN replies ON reply_id = 1 + p_partkey % {len(REPLIES)}""")
def plan_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statuses of replies, and rationales of every kind: each part is answered with one of them."""
    reply = F.element_at(F.array(*[F.lit(text) for _, text, _, _ in REPLIES]), (1 + F.col("p_partkey") % len(REPLIES)).cast("int"))
    tail = F.concat(F.lit(" of "), F.col("p_partkey").cast("string"))
    # The rationales of the stock, each followed by the part's number.
    for why in sorted({why for _, _, _, why in REPLIES if why}):
        reply = F.replace(reply, F.lit(why), F.concat(F.lit(why), tail))
    rows = table(spark, sf_dir, "part").select("p_partkey", reply.alias("reply"))
    return plans.parse(rows).select("p_partkey", "status", "rationale")


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id || '.US' ELSE CAST(user_id AS VARCHAR) END AS symbol FROM events""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market symbols under the names they were asked for, the last one that fits, where they were."""
    user = F.col("user_id").cast("string")
    asked = F.when(F.col("user_id") % 2 == 0, F.array(user, F.lit("x"), F.concat(F.lit(" "), user, F.lit(".us")))).otherwise(F.array(F.lit("y"), F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", feed.alias(F.concat(user, F.lit(".US")), asked).alias("symbol"))


@query(f"""WITH {FEED}
SELECT ordinal, symbol, price, CASE WHEN ordinal % 2 = 0 THEN event_type END AS kind, CAST(NULL AS DECIMAL(18,2)) AS previous_price FROM feed""")
def schema_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older layout (other order, a column less, one more) beside rows of the current one, by name."""
    rows = event_quotes(spark, sf_dir)
    newer = rows.filter("ordinal % 2 = 0").select("ordinal", "symbol", "price", F.col("event_type").alias("kind"), F.lit(None).cast(MONEY).alias("previous_price"))
    older = rows.filter("ordinal % 2 = 1").select("price", "batch_id", "symbol", "ordinal")
    return store.migrated(older, newer)


@query(f"""WITH {REPLAY}
SELECT ordinal, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS fetched_at_utc, symbol, symbol || '.US' AS market_symbol,
  {plain_sql('price')} AS price, 'USD' AS currency, '' AS quote_date, '' AS quote_time, '' AS open, '' AS high, '' AS low, CAST(ordinal AS VARCHAR) AS volume,
  {plain_sql('previous_price')} AS previous_price, {plain_sql('price_change')} AS price_change, coalesce(CAST(percent_change AS VARCHAR), '') AS percent_change,
  'day ' || batch_id AS run_summary, 'Stooq' AS source, '' AS source_url
FROM observed""")
def observation_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as the seventeen exported text columns."""
    seen = observe.replay(event_quotes(spark, sf_dir))
    none = F.lit(None)
    rows = seen.withColumns({
        "market_symbol": F.concat("symbol", F.lit(".US")), "currency": F.lit(CURRENCY), "quote_date": none.cast("string"), "quote_time": none.cast("string"),
        "open": none.cast("decimal(18,6)"), "high": none.cast("decimal(18,6)"), "low": none.cast("decimal(18,6)"), "volume": F.col("ordinal"),
        "run_summary": F.concat(F.lit("day "), F.col("batch_id").cast("string")), "source": F.lit(SOURCE), "source_url": none.cast("string"),
    })
    shown = store.text_rows(rows.withColumn("source_url", F.col("ordinal").cast("string")))
    return shown.withColumnRenamed("source_url", "_n").select(F.col("_n").cast("long").alias("ordinal"), *[c for c in shown.columns if c != "source_url"], F.lit("").alias("source_url"))


@query(f"""WITH {REPLAY} SELECT CAST(batch_id AS BIGINT) AS batch_id, ordinal, symbol, CAST(price AS DECIMAL(18,6)) AS price,
  CAST(previous_price AS DECIMAL(18,6)) AS previous_price, price_change, percent_change FROM observed""")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations stored by batch, and read back."""
    path = scratch(spark)
    store.backfill(spark, path, observe.replay(event_quotes(spark, sf_dir)))
    return store.history(spark, path).select("batch_id", "ordinal", "symbol", "price", "previous_price", "price_change", "percent_change")


@query(f"""WITH {FEED}, halves AS (SELECT *, CASE WHEN batch_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM feed),
saved AS (SELECT symbol, arg_max(price, ordinal) AS previous_price FROM halves WHERE run = 1 GROUP BY symbol),
seen AS (SELECT h.*, CASE WHEN run = 2 THEN s.previous_price END AS previous_price, h.cents AS pc, CAST(CASE WHEN run = 2 THEN s.previous_price END * 100 AS HUGEINT) AS vc FROM halves h LEFT JOIN saved s USING (symbol))
SELECT CAST(run AS BIGINT) AS batch_id, ordinal, symbol, CAST(price AS DECIMAL(18,6)) AS price, CAST(previous_price AS DECIMAL(18,6)) AS previous_price,
  CAST(price - previous_price AS DECIMAL(19,6)) AS price_change, {PERCENT} AS percent_change FROM seen""")
def append_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of raw quotes appended to a store, days of even number first: the second sees the first's prices."""
    path = scratch(spark)
    rows = event_quotes(spark, sf_dir)
    for odd in (0, 1):
        number = store.append_quotes(spark, path, rows.filter(F.col("batch_id") % 2 == odd).drop("batch_id"))
        store.snapshot(spark, path, number)
    return store.history(spark, path).select("batch_id", "ordinal", "symbol", "price", "previous_price", "price_change", "percent_change")


@query(f"""WITH {FEED} SELECT symbol AS symbol_key, arg_max(price, ordinal) AS price FROM feed WHERE ordinal % 5 <> 0 AND ordinal % 7 <> 0 GROUP BY symbol""")
def history_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last saved price of each symbol in a history with blank symbols, blank prices and symbols in other letters."""
    n = F.col("ordinal")
    symbol = F.when(n % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.lower("symbol")))
    rows = event_quotes(spark, sf_dir).withColumns({"symbol": symbol, "price": F.when(n % 7 != 0, F.col("price"))})
    return observe.latest(rows)


@query(f"""WITH {FEED}, given AS (SELECT ordinal, price, CASE ordinal % 3 WHEN 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN 1 THEN CAST(2.50 AS DECIMAL(18,2)) END AS previous_price,
  cents AS pc, CAST(CASE ordinal % 3 WHEN 0 THEN 0 WHEN 1 THEN 250 END AS HUGEINT) AS vc FROM feed)
SELECT ordinal, CAST(price - previous_price AS DECIMAL(19,6)) AS price_change, {PERCENT} AS percent_change FROM given""")
def zero_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from a previous price of zero (no percentage), of something, and from none."""
    previous = F.when(F.col("ordinal") % 3 == 0, F.lit("0")).when(F.col("ordinal") % 3 == 1, F.lit("2.5")).cast(MONEY)
    return observe.compared(event_quotes(spark, sf_dir).withColumn("previous_price", previous)).select("ordinal", "price_change", "percent_change")


@query(f"""WITH {FEED}
SELECT ordinal, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS fetched_at_utc, symbol, {plain_sql('price')} AS price,
  '' AS previous_price, '' AS price_change, '' AS percent_change, '' AS run_summary FROM feed""")
def quote_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw quotes, which no one has observed, as text rows."""
    rows = event_quotes(spark, sf_dir).select("symbol", "price", "fetched_at_utc", F.col("ordinal").alias("volume"))
    shown = store.text_rows(rows)
    return shown.select(F.col("volume").cast("long").alias("ordinal"), "fetched_at_utc", "symbol", "price", "previous_price", "price_change", "percent_change", "run_summary")


@query(f"""WITH {REPLAY} SELECT ordinal AS volume, row_number() OVER (ORDER BY batch_id, ordinal) - 1 AS ordinal, symbol, CAST(price AS DECIMAL(18,6)) AS price,
  CAST(previous_price AS DECIMAL(18,6)) AS previous_price, price_change, percent_change, 'day "' || batch_id || '",' || chr(10) || 'closed' AS run_summary FROM observed""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations exported as CSV, quotes and line breaks in their summaries, and read back by name, in their order."""
    path = scratch(spark)
    seen = observe.replay(event_quotes(spark, sf_dir)).withColumns({
        "volume": F.col("ordinal"), "run_summary": F.concat(F.lit('day "'), F.col("batch_id").cast("string"), F.lit('",\nclosed')),
    })
    store.export_csv(store.aligned(seen), path)
    return store.import_csv(spark, path).select("volume", "ordinal", "symbol", "price", "previous_price", "price_change", "percent_change", "run_summary")


@query(f"""WITH {REPLAY}, lined AS (
  SELECT batch_id, ordinal, '- ' || symbol || ': price ' || {plain_sql('price')} || ' USD; previous ' || coalesce(nullif({plain_sql('previous_price')}, ''), 'n/a') ||
    '; change ' || coalesce(nullif({plain_sql('price_change')}, ''), 'n/a') || '; percent ' || coalesce(CAST(percent_change AS VARCHAR), 'n/a') || '%' AS line FROM observed)
SELECT batch_id, string_agg(line, chr(10) ORDER BY ordinal) AS lines FROM lined GROUP BY batch_id""")
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines a summariser reads about each batch."""
    seen = observe.replay(event_quotes(spark, sf_dir)).withColumn("currency", F.lit(CURRENCY))
    return report.summary_lines(seen, "batch_id")


@query(f"WITH {FEED} SELECT batch_id, count(*) AS quotes, {plain_sql('arg_max(price, ordinal)')} AS last_price FROM feed GROUP BY batch_id")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added by each batch, and its last price."""
    return report.run_counts(event_quotes(spark, sf_dir))


@query(f"""WITH {REPLAY}
SELECT ordinal, symbol AS "Symbol", {plain_sql('price')} || ' USD' AS "Price", {plain_sql('previous_price')} AS "Previous", {plain_sql('price_change')} AS "Change",
  coalesce(CAST(percent_change AS VARCHAR) || '%', '') AS "%", strftime(ts, '%Y-%m-%d') AS "Quote date", strftime(ts, '%H:%M:%S') AS "Quote time", 'Stooq' AS "Source" FROM observed""")
def console_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight columns a run shows."""
    seen = observe.replay(event_quotes(spark, sf_dir)).withColumns({
        "currency": F.lit(CURRENCY), "source": F.lit(SOURCE),
        "quote_date": F.date_format("fetched_at_utc", "yyyy-MM-dd"), "quote_time": F.date_format("fetched_at_utc", "HH:mm:ss"),
    })
    return report.table(seen)


@query(f"""WITH {REPLAY}, best AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY abs(percent_change) DESC, ordinal) AS r FROM observed WHERE percent_change IS NOT NULL)
SELECT batch_id, symbol, percent_change FROM best WHERE r = 1""")
def largest_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest move of each batch; ties to the first quote."""
    return observe.largest_moves(observe.replay(event_quotes(spark, sf_dir)))


@query(f"""WITH {FEED}
SELECT symbol, date_trunc('hour', ts) AS start, count(*) AS quotes, min(price) AS low, max(price) AS high, arg_max(price, ordinal) AS last FROM feed GROUP BY ALL""")
def windowed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours of each symbol, by the same expressions a stream uses."""
    from tickerloom.streaming.batches import windowed

    return windowed(event_quotes(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))
