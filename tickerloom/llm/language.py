"""Language identification by compression: the language whose zstandard raw-content dictionary makes a text smallest.

A dictionary per language holds pieces of a bounded sample of its training texts (`TEXTS` of them, the least by hash of id and text, of a long one `PIECE`
letters from its middle); every language is learned, and where there are many, dictionaries are tried in groups of `GROUP`.  A text is folded (lower case, runs of anything but
letters as one space), cut into blocks of `BLOCK` bytes, every block is compressed with every dictionary, and the sizes of all blocks add up,
so the whole text counts however long it is.  Short texts, where single bytes decide, add up the sizes of two levels.

`lang_pred` is the smallest (ties to the language with more training rows, then by code point); `rejected` marks margins below
`MIN_MARGIN`.  A null text, or one without a letter, is `und` with score 0.  Where nothing was learned, every row is `und`.  Null doc_ids and repeated rows
are kept as rows; rows without lang are never learned from; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm.common import held_out, read, staged

#: Bounds of the training sample: texts a language, letters of a text, bytes of a dictionary.
TEXTS, PIECE, DICTIONARY = 400, 1000, 110_000
#: Languages that a worker holds the dictionaries of at once.
GROUP = 64
#: Parts of a language's rows that are ranked apart.
PARTS = 64
BLOCK = 4096
#: Levels of zstandard, of texts up to SHORT bytes in the second place.
LEVELS, SHORT_LEVELS, SHORT = (6,), (3, 12), 160
#: Share of the smallest size by which the next language must be larger.
MIN_MARGIN = 0.01

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    """Lower-cased letters, with one space for each run of anything else; empty if there is no letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} ".encode() if any(map(str.isalpha, words)) else b""


def learned(docs: DataFrame) -> DataFrame:
    """number, lang, dictionary of every lang of the training rows, most frequent languages first."""
    rows = docs.filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit(17))
    # Of a long text, a piece from its middle as good as any.
    piece = F.substring("text", F.greatest(F.lit(1), (F.length("text") / 2 - PIECE / 2).cast("int")), F.lit(PIECE))
    rows = rows.select("lang", draw.alias("draw"), piece.alias("piece"))
    # The least TEXTS draws of a language, without the texts: first in each of PARTS, so that a language with most rows is no task's alone.
    draws = rows.groupBy("lang", "draw").agg(F.lit(1).alias("one")).withColumn("part", F.pmod(F.xxhash64("draw"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        draws = draws.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("draw"))).filter(F.col("rank") <= TEXTS)
    chosen = staged(draws.select(F.col("lang").alias("_lang"), F.col("draw").alias("_draw")))
    # Written, so that Spark knows its size; equal rows count once.
    rows = rows.join(chosen, (F.col("lang") == F.col("_lang")) & (F.col("draw") == F.col("_draw"))).groupBy("lang", "draw").agg(F.min("piece").alias("piece"))

    @F.pandas_udf("binary")
    def joined(pieces):
        return pieces.map(lambda found: b"".join(map(folded, found))[:DICTIONARY])

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("draw", "piece"))), lambda x: x["piece"])
    made = rows.groupBy("lang").agg(ordered.alias("pieces")).select("lang", joined("pieces").alias("dictionary")).filter("length(dictionary) > 0")
    number = F.row_number().over(Window.orderBy(F.desc("n"), "lang")).cast("long") - 1
    return staged(made.join(counts, "lang").select(number.alias("number"), "lang", "dictionary"))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """The dictionaries of `learned` in hand: for tables of few languages."""
    return {row["lang"]: bytes(row["dictionary"]) for row in learned(docs).orderBy("number").collect()}


class Compressors:
    """Compressors of some levels, a language each."""

    def __init__(self, dictionaries: dict[str, bytes], levels: tuple[int, ...]):
        import zstandard as zstd

        self.all = []
        for content in dictionaries.values():
            # Raw content: 8 bytes at least, and no magic number of a trained dictionary in front.
            raw = b" " * 8 + content
            own = []
            for level in levels:
                given = zstd.ZstdCompressionParameters.from_level(
                    level, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0
                )
                digested = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                digested.precompute_compress(compression_params=given)
                own.append(zstd.ZstdCompressor(dict_data=digested, compression_params=given))
            self.all.append(own)

    def sizes(self, data: bytes) -> list[int]:
        parts = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(part)) for c in own for part in parts) for own in self.all]


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], levels: tuple[int, ...]) -> Compressors:
    return Compressors(dict(dictionaries), levels)


#: What a group of dictionaries leaves for the next: the least size, its language, the next least size, and the odds of all against the least.
RUNNING = "best double, lang_pred string, next double, odds double"


def step(data: bytes, langs: list[str], usual: Compressors, short: Compressors, before: tuple) -> tuple:
    """(best, language, next, odds) after the sizes of one more group of languages."""
    best, lang, following, odds = before
    for name, size in zip(langs, (short if len(data) <= SHORT else usual).sizes(data), strict=True):
        # Each byte saved doubles the odds, up to the precision of a size.
        if best is None or size < best:
            odds = 1.0 if best is None else 1 + odds * 2.0 ** -min(best - size, 60)
            best, lang, following = float(size), name, best
        else:
            odds += 2.0 ** -min(size - best, 60)
            following = float(size) if following is None else min(following, float(size))
    return best, lang, following, odds


def identify(data: bytes, langs: list[str], usual: Compressors, short: Compressors) -> tuple[str, float, bool]:
    """(language, score, rejected) of a folded text, all languages at once."""
    if not data or not langs:
        return "und", 0.0, True
    best, lang, following, odds = step(data, langs, usual, short, (None, None, None, 0.0))
    return lang, 1 / odds, following is not None and (following - best) / best < MIN_MARGIN


def predict(docs: DataFrame, dictionaries: DataFrame | dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; dictionaries as of `learned` or `learn`."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in RUNNING.split(", ")])
    if isinstance(dictionaries, dict):
        groups = [list(dictionaries.items())[k : k + GROUP] for k in range(0, len(dictionaries), GROUP)]
    else:
        n = dictionaries.count()
        groups = (
            [(row["lang"], bytes(row["dictionary"])) for row in dictionaries.filter(F.col("number").between(k, k + GROUP - 1)).orderBy("number").collect()]
            for k in range(0, n, GROUP)
        )
    for at, group in enumerate(groups):
        if at:  # one group's compressors at a time
            rows = staged(rows)
        rows = rows.mapInArrow(_tried(spark, group), f"doc_id {kind}, held_out boolean, text string, {RUNNING}")
    known = F.col("best").isNotNull()
    rejected = ~known | F.coalesce((F.col("next") - F.col("best")) / F.col("best") < MIN_MARGIN, F.lit(False))
    return rows.select(
        "doc_id", "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.when(known, 1 / F.col("odds")).otherwise(0.0).alias("score"), rejected.alias("rejected")
    )


def _tried(spark: SparkSession, group: list[tuple[str, bytes]]):
    shared = spark.sparkContext.broadcast(tuple(group))  # GROUP times DICTIONARY bytes at most

    def rows(batches):
        learned = shared.value
        langs = [lang for lang, _ in learned]
        usual, short = _compressors(learned, LEVELS), _compressors(learned, SHORT_LEVELS)
        for batch in batches:
            found = []
            for text, *before in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
                data = folded(text) if text else b""
                found.append(step(data, langs, usual, short, (*before[:3], before[3] or 0.0)) if data else (None, None, None, None))
            columns = zip(*found, strict=True) if found else [()] * 4
            types = [pa.float64(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2).cast(pa.string()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "held_out", "text", "best", "lang_pred", "next", "odds"],
            )

    return rows


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, learned(docs))
