"""Observations, latest prices and skipped symbols."""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickerloom.operators import observe, report

SCHEMA = "symbol string, batch_id int, ordinal int, price decimal(18,6)"


def frame(spark, rows):
    return spark.createDataFrame([(s, b, o, None if p is None else Decimal(p)) for s, b, o, p in rows], SCHEMA)


def folded(rows):
    """What batches in order see, one by one."""
    latest, out, batches = {}, {}, sorted({r[1] for r in rows})
    for batch in batches:
        mine = sorted((r for r in rows if r[1] == batch), key=lambda r: r[2])
        for s, _, o, _ in mine:
            out[o] = latest.get(s)
        for s, _, _, p in mine:
            if s.strip() and p is not None:
                latest[s.strip().upper()] = Decimal(p)
    return out


def test_a_batch_sees_the_price_from_before_it(spark):
    rows = [("IBM", 1, 1, "100"), ("IBM", 2, 2, "110"), ("IBM", 2, 3, "120"), ("IBM", 3, 4, "60")]
    got = {r.ordinal: (r.previous_price, r.price_change, r.percent_change) for r in observe.replay(frame(spark, rows)).collect()}
    assert got == {1: (None, None, None), 2: (100, 10, Decimal("10.00")), 3: (100, 20, Decimal("20.00")), 4: (120, -60, Decimal("-50.00"))}


def test_the_saved_symbol_is_folded_and_the_quoted_one_is_not(spark):
    rows = [(" ibm ", 1, 1, "100"), ("ibm", 2, 2, "110"), ("IBM", 2, 3, "110"), (" ", 2, 4, "1"), ("IBM", 3, 5, None), ("IBM", 4, 6, "2")]
    got = {r.ordinal: r.previous_price for r in observe.replay(frame(spark, rows)).collect()}
    assert got == {1: None, 2: None, 3: 100, 4: None, 5: 110, 6: 110}


def test_a_batch_without_a_price_still_sees_the_last_one(spark):
    rows = [("KO", 1, 1, "4"), ("KO", 2, 2, None)]
    got = {r.ordinal: r.previous_price for r in observe.replay(frame(spark, rows)).collect()}
    assert got[1] is None and got[2] == 4


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["A", "B", " a", "b "]), st.integers(1, 4), st.integers(0, 9)), min_size=1, max_size=20))
def test_replay_equals_batches_one_by_one(spark, given_rows):
    rows = [(s, b, k, str(p)) for k, (s, b, p) in enumerate(given_rows)]
    quotes = frame(spark, rows)
    got = {r.ordinal: r.previous_price for r in observe.replay(quotes).collect()}
    assert got == folded(rows)
    last = max(r[1] for r in rows)
    saved = observe.latest(quotes.filter(f"batch_id < {last}"))
    one = {r.ordinal: r.previous_price for r in observe.observe(quotes.filter(f"batch_id = {last}"), saved).collect()}
    assert one == {k: v for k, v in folded(rows).items() if rows[k][1] == last}


def test_latest_goes_by_batch_and_ordinal(spark):
    rows = [("IBM", 2, 1, "5"), ("IBM", 1, 9, "7"), ("IBM", 2, 2, "6"), ("", 3, 1, "1"), ("KO", 3, 1, None)]
    assert [tuple(r) for r in observe.latest(frame(spark, rows)).collect()] == [("IBM", Decimal("6.000000"))]


def test_skipped_keeps_order_and_repeats(spark):
    asked = spark.createDataFrame([(0, "JPM"), (1, " ualf"), (2, "UALF"), (3, " "), (4, None)], "pos int, symbol string")
    got = spark.createDataFrame([(" jpm ",), (None,)], "symbol string")
    assert [tuple(r) for r in observe.skipped(asked, got).orderBy("pos").collect()] == [(1, "UALF"), (2, "UALF")]


def test_largest_move_ties_go_to_the_first(spark):
    rows = [("A", 1, 1, "10"), ("B", 1, 2, "10"), ("A", 2, 3, "11"), ("B", 2, 4, "9")]
    assert [tuple(r) for r in observe.largest_moves(observe.replay(frame(spark, rows))).collect()] == [(2, "A", Decimal("10.00"))]


def test_summary_lines(spark):
    rows = [("A", 1, 1, "10"), ("A", 2, 2, "10.5"), ("B", 2, 3, "0")]
    seen = observe.replay(frame(spark, rows)).selectExpr("*", "'USD' AS currency")
    lines = {r.batch_id: r.lines for r in report.summary_lines(seen, "batch_id").collect()}
    assert [r.line for r in report.report_lines(seen, "batch_id").filter("batch_id = 2").orderBy("ordinal").collect()] == lines[2].split("\n")
    assert lines[2] == "- A: price 10.5 USD; previous 10; change 0.5; percent 5.00%\n- B: price 0 USD; previous n/a; change n/a; percent n/a%"
    prompt = report.summary_prompt(lines[2], None, (["A", "B"], "why"))
    assert "Symbols: A, B. Rationale: why" in prompt and lines[2] in prompt and report.NO_REQUEST in prompt
    assert "Request: banks" in report.planning_prompt("banks") and "uranium the feed has CCJ" in report.planning_prompt("banks")


def test_replay_plan_shuffles_a_symbol_in_parts(spark):
    plan = observe.replay(frame(spark, [("A", 1, 1, "1")]))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    plan = observe.latest(frame(spark, [("A", 1, 1, "1")]))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
