"""Plans that a language model writes as JSON: symbols and a rationale, with a status instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.text import plan_symbol, strip
from tickerloom.schema import MAX_PLAN_SYMBOLS

#: What each status but ok means, in the order of the checks.
PROBLEMS = {
    "no_object": "the reply holds no JSON object",
    "bad_json": "the reply's JSON cannot be read",
    "no_list": "the plan has no list of symbols",
    "empty": "the plan names no ticker symbol",
    "too_many": f"the plan names more than {MAX_PLAN_SYMBOLS} ticker symbols",
}


class PlanError(ValueError):
    """A reply that is no plan."""


def json_object(reply: Column) -> Column:
    """From the first `{` to the last `}` of a reply, fences and prose around it left out; empty if there is none."""
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)


def is_text(value: Column) -> Column:
    """Whether a variant is a string; numbers, booleans and null are not read as symbols."""
    return F.schema_of_variant(value) == "STRING"


def first_seen(values: Column) -> Column:
    """Distinct values in the order of their first places."""
    return F.array_distinct(values)


def parse(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with status, symbols array<string> (null unless ok) and rationale."""
    found = json_object(F.col(reply))
    rows = replies.withColumn("_object", found).withColumn("_plan", F.try_parse_json(F.col("_object")))
    raw = F.try_variant_get("_plan", "$.symbols", "array<variant>")
    rows = rows.withColumn("_raw", raw)
    texts = F.transform(F.filter("_raw", is_text), lambda v: F.try_variant_get(v, "$", "string"))
    rows = rows.withColumn("_symbols", first_seen(F.filter(F.transform(texts, plan_symbol), lambda s: s.isNotNull())))
    why = F.try_variant_get("_plan", "$.rationale", "variant")
    rationale = F.when(is_text(why), strip(F.try_variant_get("_plan", "$.rationale", "string")))
    status = (
        F.when(F.coalesce(F.col("_object") == "", F.lit(True)), "no_object")
        .when(F.col("_plan").isNull(), "bad_json")
        .when(F.col("_raw").isNull(), "no_list")
        .when(F.size("_symbols") == 0, "empty")
        .when(F.size("_symbols") > MAX_PLAN_SYMBOLS, "too_many")
        .otherwise("ok")
    )
    return rows.select(
        *replies.columns,
        status.alias("status"),
        F.when(status == "ok", F.col("_symbols")).alias("symbols"),
        F.coalesce(rationale, F.lit("")).alias("rationale"),
    )


def one(spark, reply: str) -> tuple[list[str], str]:
    """(symbols, rationale) of one reply; PlanError with the reason where it is no plan."""
    row = parse(spark.createDataFrame([(reply,)], "reply string")).first()
    if row["status"] != "ok":
        raise PlanError(PROBLEMS[row["status"]])
    return list(row["symbols"]), row["rationale"]
