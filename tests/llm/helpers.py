"""Small tables with the odd cases every operator must take."""

from __future__ import annotations

import re
import zlib

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def crc_fold(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3


def words(text) -> list[str]:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def documents(spark, rows):
    full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def odd(spark):
    """Nulls everywhere, empty and blank texts, a very long text, repeated rows and a clashing column."""
    long = "word another thing here. " * 12_000
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "plain words of a usual text here", "en", "a"),
        (4, "plain words of a usual text here", "en", "a"), (None, "plain words of a usual text here", None, None), (5, long, "en", "b"),
        (6, "ÄÖ ñandú 北京 \U0001f600  x", "de", "b"), (7, "...!!!", "de", None), (8, "x", "fr", "c"),
    ]
    clash = ("_row", "_gone", "_size", "_id", "_copies", "_n", "_chosen", "_text", "c0", "row", "class", "place")
    return documents(spark, rows).selectExpr("*", "'clash' AS score", "1 AS size", "2L AS begin", "map('k', 1) AS tags", *[f"'{c}' AS `{c}`" for c in clash])


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
