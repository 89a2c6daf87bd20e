"""Plans in JSON."""

import pytest

from tickerloom.catalog import REPLIES
from tickerloom.plans import symbols as plans


def test_mixed_list(spark):
    got = plans.one(spark, '{"symbols":["deere","de.us","AGCO","two makers of tractors","DEERE"],"rationale":" farm machines "}')
    assert got == (["DEERE", "DE", "AGCO"], "farm machines")


def test_fenced_and_indented(spark):
    assert plans.one(spark, '  ```json\n  {"symbols": ["AAPL", "MSFT"]}\n  ```  ') == (["AAPL", "MSFT"], "")


def test_only_strings_are_symbols(spark):
    assert plans.one(spark, '{"symbols":["KO", true, 12, null, ["T"], {"a": "F"}]}')[0] == ["KO"]


@pytest.mark.parametrize("reply", REPLIES, ids=lambda r: r[2])
def test_statuses(spark, reply):
    _, text, status, rationale = reply
    row = plans.parse(spark.createDataFrame([(text,)], "reply string")).first()
    assert (row.status, row.rationale) == (status, rationale)
    if status != "ok":
        with pytest.raises(plans.PlanError, match=plans.PROBLEMS[status][:10]):
            plans.one(spark, text)


def test_fifteen_is_the_most_after_repeats(spark):
    names = [f'"A{k}"' for k in range(15)]
    assert len(plans.one(spark, f'{{"symbols": [{", ".join(names + names)}]}}')[0]) == 15


def test_null_reply(spark):
    assert plans.parse(spark.createDataFrame([(None,)], "reply string")).first().status == "no_object"
