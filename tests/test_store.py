"""The store, CSV at its edges, whole runs, the command line and streams."""

import re
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickerloom import collect
from tickerloom.analysts import LocalAnalyst
from tickerloom.operators import observe, store
from tickerloom.schema import EXPORT_COLUMNS, QUOTE, STORED
from tickerloom.sources import feed
from tickerloom.streaming.batches import collect_stream, windowed

AT = datetime(2031, 2, 7, 8, 45, tzinfo=UTC)


def quote(symbol, price, ordinal=1):
    return (AT, symbol, f"{symbol}.US", Decimal(price), "USD", "2031-02-07", "16:00:00", None, None, None, None, "Fake", "https://example.test", ordinal)


def quotes_of(spark, *rows):
    return spark.createDataFrame([quote(*r) for r in rows], f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in QUOTE.fields)}, ordinal long")


def test_batches_append_and_a_retried_batch_is_replaced(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.history(spark, path).schema == STORED and store.history(spark, path).count() == 0
    store.append_quotes(spark, path, quotes_of(spark, ("IBM", "100")), 1)
    for _ in range(2):
        assert store.append_quotes(spark, path, quotes_of(spark, ("IBM", "110", 1), ("IBM", "120", 2)), 2) == 2
    store.append_quotes(spark, path, quotes_of(spark, ("IBM", "60")), 3)
    rows = store.history(spark, path).orderBy("batch_id", "ordinal").collect()
    assert [(r.batch_id, r.price, r.previous_price, r.percent_change) for r in rows] == [
        (1, 100, None, None), (2, 110, 100, Decimal("10.00")), (2, 120, 100, Decimal("20.00")), (3, 60, 120, Decimal("-50.00")),
    ]
    replayed = observe.replay(store.history(spark, path).select("symbol", "batch_id", "ordinal", "price"))
    assert {(r.batch_id, r.ordinal, r.previous_price) for r in replayed.collect()} == {(r.batch_id, r.ordinal, r.previous_price) for r in rows}


def test_appends_add_up_and_reserve_their_numbers(spark, tmp_path):
    path = str(tmp_path / "store")
    assert [store.append(spark, path, observe.compared(quotes_of(spark, ("KO", p)).withColumn("previous_price", F.lit(None).cast("decimal(18,6)")))) for p in ("1", "2")] == [1, 2]
    # Two runs that start before either has stored anything get different numbers.
    first, second = store.reserve(spark, path), store.reserve(spark, path)
    assert (first, second) == (3, 4)
    store.append_quotes(spark, path, quotes_of(spark, ("KO", "4")), second)
    store.append_quotes(spark, path, quotes_of(spark, ("KO", "3")), first)
    assert [(r.batch_id, r.price) for r in store.history(spark, path).orderBy("batch_id").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    store.append_quotes(spark, path, quotes_of(spark).limit(0), 4)  # a retry without quotes leaves none
    assert store.batches(spark, path) == [1, 2, 3]


def test_last_prices_come_from_a_snapshot_and_the_batches_since(spark, tmp_path):
    path = str(tmp_path / "store")
    for k, (symbol, price) in enumerate((("IBM", "1"), ("KO", "2"), (" ibm ", "3"), ("KO", "4"))):
        store.append_quotes(spark, path, quotes_of(spark, (symbol, price)), k + 1)
        if k < 3:
            store.snapshot(spark, path, k + 1)

    def last(batch):
        return {r.symbol_key: int(r.price) for r in store.latest_before(spark, path, batch).collect()}

    assert [last(b) for b in (1, 2, 3, 4, 5)] == [{}, {"IBM": 1}, {"IBM": 1, "KO": 2}, {"IBM": 3, "KO": 2}, {"IBM": 3, "KO": 4}]
    # Before batch 4 nothing but the snapshot of batch 3 is read: no partition of the history is left.
    read = store.latest_before(spark, path, 4).inputFiles()
    assert all("_latest/3" in f for f in read if "batch_id=" not in f) and not spark.read.parquet(path).filter("batch_id > 3 AND batch_id < 4").count()
    plan = store.latest_before(spark, path, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "batch_id" in plan and "mergeSchema" not in plan
    store.append_quotes(spark, path, quotes_of(spark, ("KO", "9")), 2)  # written anew: later snapshots are stale
    assert last(4) == {"IBM": 3, "KO": 9}


def test_csv_history_keeps_the_order_of_many_files(spark, tmp_path):
    rows = quotes_of(spark, *[("IBM", str(k + 1), k) for k in range(2000)]).withColumn("batch_id", F.lit(1))
    store.export_csv(rows.repartition(5), str(tmp_path / "out"))
    back = store.import_csv(spark, str(tmp_path / "out"))
    assert [int(r.price) for r in back.orderBy("ordinal").collect()] == list(range(1, 2001)) and observe.latest(back).first().price == 2000
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("symbol,price\nIBM,1\n")
    (folder / "b.csv").write_text("symbol,price\n" + "IBM,2\n" * 500 + "IBM,3\n")  # larger, so read first
    assert observe.latest(store.import_csv(spark, str(folder))).first().price == 3


def test_a_plain_quote_as_text(spark):
    row = store.text_rows(quotes_of(spark, ("IBM", "105"))).first()
    assert (row.symbol, row.price, row.previous_price, row.percent_change, row.run_summary) == ("IBM", "105", "", "", "")


def test_text_rows(spark):
    seen = observe.compared(quotes_of(spark, ("IBM", "105")).withColumn("previous_price", F.lit(Decimal("100")).cast("decimal(18,6)")))
    rows = store.text_rows(seen, "all, \"well\"")
    assert tuple(rows.columns) == EXPORT_COLUMNS and store.same_layout(rows) and not store.same_layout(rows.select(*EXPORT_COLUMNS[::-1]))
    assert list(rows.first()) == ["2031-02-07T08:45:00+00:00", "IBM", "IBM.US", "105", "USD", "2031-02-07", "16:00:00", "", "", "", "", "100", "5", "5.00", 'all, "well"', "Fake", "https://example.test"]


def test_csv_round_trip_keeps_quoted_text(spark, tmp_path):
    seen = observe.observe(quotes_of(spark, ("IBM", "105", 1), ("KO", "7", 2)), observe.latest(store.history(spark, str(tmp_path / "none"))))
    rows = seen.withColumns({"run_summary": F.lit('a "b",\nc'), "batch_id": F.lit(1)})
    store.export_csv(rows, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert text.startswith(",".join(EXPORT_COLUMNS).encode() + b"\r\n") and b"105,USD,2031-02-07,16:00:00,,,,,,,," in text
    back = store.import_csv(spark, str(tmp_path / "out")).orderBy("ordinal").collect()
    assert [(r.symbol, r.price, r.run_summary, r.open) for r in back] == [("IBM", 105, 'a "b",\nc', None), ("KO", 7, 'a "b",\nc', None)]


def test_an_older_layout_is_read_by_name(spark, tmp_path):
    older = [c for c in EXPORT_COLUMNS if c not in ("previous_price", "price_change", "percent_change", "run_summary")]
    (tmp_path / "old.csv").write_text(",".join(older) + "\n2031-02-07T08:45:00+00:00, ibm ,IBM.US,100,USD,2031-02-07,16:00:00,,,,,Fake,https://example.test")
    rows = store.import_csv(spark, str(tmp_path / "old.csv"))
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in STORED]
    seen = observe.observe(quotes_of(spark, ("IBM", "105")), observe.latest(rows)).first()
    assert (seen.previous_price, seen.price_change, seen.percent_change) == (100, 5, Decimal("5.00"))
    (tmp_path / "bad.csv").write_text("symbol,price\nIBM,abc\n")
    with pytest.raises(Exception, match="no price"):
        store.import_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_migrated_rows_go_by_name(spark):
    newer = spark.createDataFrame([(1, "a", None)], "k int, s string, more int")
    older = spark.createDataFrame([("b", 2, True)], "s string, k int, gone boolean")
    assert sorted(map(tuple, store.migrated(older, newer).collect())) == [(1, "a", None), (2, "b", None)]


def fake_source(spark, symbols):
    rows = [(k, f"{s.strip().upper()}.US,2031-02-07,16:00:00,1,2,3,{'N/D' if s == 'UALF' else 10 + k},5", [s], AT, "https://example.test") for k, s in enumerate(symbols)]
    return spark.createDataFrame(rows, "response_id int, body string, requested array<string>, fetched_at_utc timestamp, source_url string")


def test_run_with_plan_and_summary(spark, tmp_path):
    asked = []
    done = collect.run(
        spark, ["IGNORED"], str(tmp_path / "s"), source=fake_source, request="two lenders, please",
        planner=lambda p: asked.append(p) or '{"symbols": ["JPM", "UALF", "KO"], "rationale": "lenders"}', summarizer=lambda p: asked.append(p) or "One lender is in.",
    )
    assert (done.skipped, done.plan, done.summary, done.batch_id) == (["UALF"], (["JPM", "UALF", "KO"], "lenders"), "One lender is in.", 1)
    assert "two lenders, please" in asked[0] and "- JPM: price 10 USD; previous n/a" in asked[1]
    assert [r.run_summary for r in store.history(spark, str(tmp_path / "s")).collect()] == ["One lender is in."] * 2
    again = collect.run(spark, ["KO"], str(tmp_path / "s"), source=fake_source)
    assert again.batch_id == 2 and again.observations.first().previous_price == 12
    assert collect.collected([done, again]).count() == 3


def test_nothing_is_written_when_a_run_fails(spark, tmp_path):
    path = str(tmp_path / "s")
    for arguments in ({"symbols": ["UALF"]}, {"symbols": [" "]}, {"symbols": None, "request": "x"}, {"symbols": [], "defaults": ()}):
        with pytest.raises(ValueError):
            collect.run(spark, arguments.pop("symbols"), path, source=fake_source, **arguments)
    assert not (tmp_path / "s").exists()


def test_command_line(spark, tmp_path, capsys):
    assert collect.main(["IBM", "UALF", "--table", str(tmp_path / "s"), "--ollama-url", "http://host"], spark, fake_source) == 0
    shown = capsys.readouterr().out
    assert "Added 1 quote rows" in shown and "Skipped unsupported symbols: UALF" in shown and "10 USD" in shown
    assert collect.main(["UALF", "--store", str(tmp_path / "s")], spark, fake_source) == 1
    assert "failed" in capsys.readouterr().err
    many = [f"S{k}" for k in range(1100)]
    assert collect.main([*many, "-t", str(tmp_path / "m")], spark, fake_source) == 0
    shown = capsys.readouterr().out
    assert all(re.search(rf"^\|{s} *\|", shown, re.MULTILINE) for s in many)


def broken_source(spark, symbols):
    return fake_source(spark, symbols).withColumn("body", F.lit("IBM.US,d,t,1,1,1,abc,1"))


def refused(url, timeout):
    raise OSError("connection refused")


def test_bad_data_and_a_failing_network_end_in_one_line(spark, tmp_path, capsys):
    assert collect.main(["IBM", "-t", str(tmp_path / "s")], spark, broken_source) == 1
    err = capsys.readouterr().err
    assert "failed: " in err and "bad_price" in err and len(err.strip().splitlines()) == 1

    def network(session, symbols):
        session.dataSource.register(feed.QuoteFeed)
        return session.read.format("quote_feed").option("symbols", ",".join(symbols)).option("opener", "tests.test_store:refused").load()

    assert collect.main(["IBM", "-t", str(tmp_path / "s")], spark, network) == 1
    err = capsys.readouterr().err
    assert "connection refused" in err and len(err.strip().splitlines()) == 1
    assert store.batches(spark, str(tmp_path / "s")) == []


def test_local_analyst():
    sent = []
    analyst = LocalAnalyst("m", "http://host//", post=lambda *a: sent.append(a) or {"response": " hi "})
    assert analyst.plan("p") == " hi " and analyst.summarize("q") == "hi"
    assert sent[0][0] == "http://host/api/generate" and sent[0][1]["format"] == "json" and sent[0][1]["options"] == {"temperature": 0} and sent[1][1]["options"] == {"temperature": 0.2}
    assert LocalAnalyst(post=lambda *a: {}).plan("p") == ""


def test_stream_stores_each_batch_once(spark, tmp_path):
    quotes_of(spark, ("IBM", "100", 1)).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        if k:
            quotes_of(spark, ("IBM", "110", 1)).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(quotes_of(spark, ("IBM", "1", 1)).schema).parquet(str(tmp_path / "in"))
        collect_stream(stream, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    rows = store.history(spark, str(tmp_path / "store")).orderBy("batch_id").collect()
    assert [(r.price, r.previous_price) for r in rows] == [(100, None), (110, 100)]


def test_a_stream_goes_on_above_what_the_store_holds(spark, tmp_path):
    path = str(tmp_path / "store")
    for k in range(2):
        store.append_quotes(spark, path, quotes_of(spark, ("IBM", str(k + 1))))
    quotes_of(spark, ("IBM", "5")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(quotes_of(spark, ("IBM", "1", 1)).schema).parquet(str(tmp_path / "in"))
    for state in ("state", "state", "lost"):  # the second start finds nothing new; without its checkpoint all comes again, as a new batch
        collect_stream(stream, path, str(tmp_path / state)).awaitTermination()
    rows = store.history(spark, path).orderBy("batch_id").collect()
    assert [(r.batch_id, int(r.price), r.previous_price) for r in rows] == [(1, 1, None), (2, 2, 1), (3, 5, 2), (4, 5, 5)]


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows = quotes_of(spark, ("IBM", "100", 1), ("IBM", "110", 2), ("KO", "5", 3))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windowed_out").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("windowed_out").collect())) == sorted(map(tuple, windowed(rows).collect()))
