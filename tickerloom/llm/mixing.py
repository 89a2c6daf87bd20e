"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame expressions only.

Each source gets a target number of words: the sources, ordered by code point with null last, weigh 3, 1, 2,
repeating, and share `share` of all words by weight; a target stops at `most` times its source's words and the
excess is shared anew by weight until no source is above.  Targets become whole blocks of equally many words
by the highest quotients v / (2i + 1), first across sources, then across the shards of each source, and a seeded
order picks the blocks of a shard.  A block is a range of the words of its shard, laid end to end in a seeded order
of documents, so a document takes the words its blocks cover, at most `most` times.

Edge cases: a null or blank text has size 0 and takes nothing; an empty table gives no rows; repeated rows are rows of their own, and share a
seeded place until they hold more than `CROWD` words; a null doc_id is placed as the empty text; columns other than doc_id, text and source are ignored by
`mix` and kept by `apply_mix`.  The table of sources, a row each, is ordered and summed in one task, as weights go by rank; everything else is dealt by shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm.common import free_name, read, staged

WEIGHTS = (3, 1, 2)
SHARE_NUM, SHARE_DEN = 3, 2
MOST = 2
#: Words in a block, and about how many words a shard of a source holds.
BLOCK_WORDS = 128
SHARD_WORDS = 1 << 20
#: Words of rows with one id and text from which they are dealt to several places.
CROWD = 1 << 18
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, number: str | None = None) -> DataFrame:
    """row (`number`, or one of its own), doc_id, source, size (the words of its text) and seeded place of every document."""
    row = F.monotonically_increasing_id() if number is None else F.col(number)
    words = F.regexp_count(F.col("text"), F.lit(WORD))
    # Rows of one id (or none) lie apart where their texts differ.
    name = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return docs.select(row.alias("row"), "doc_id", "source", F.coalesce(words, F.lit(0)).cast("long").alias("size"), F.md5(name).alias("place"))


def spread(sizes: DataFrame) -> DataFrame:
    """sizes, where rows that share a place and hold more than CROWD words are dealt to places of their own, so that no shard has to take them all."""
    crowd = sizes.groupBy("place").agg(F.count("*").alias("n"), F.sum("size").alias("words")).filter(F.expr(f"n > 1 AND words > {CROWD}"))
    crowd = staged(crowd.select(F.col("place").alias("_place"), F.ceil(F.col("words") / CROWD).cast("long").alias("_parts")))
    salted = F.md5(F.concat_ws(":", "place", F.pmod(F.xxhash64("row"), F.col("_parts"))))
    rows = sizes.join(crowd, F.col("place") == F.col("_place"), "left")
    return rows.withColumn("place", F.when(F.col("_parts").isNull(), F.col("place")).otherwise(salted)).drop("_place", "_parts")


def sharded(n_shards: Column) -> Column:
    """The shard of a document of its source, by place."""
    return F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % n_shards


def targets(sizes: DataFrame) -> DataFrame:
    """One row a source: source, source_size, target (words, double)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("long")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = by.withColumn("weight", weight).withColumn("whole", F.sum("source_size").over(every))
    rows = rows.withColumn("cap", F.col("source_size") * MOST)
    # Sources reach their caps in order of cap / weight; ahead of each, what is left is shared by what is left of the weights.
    rise = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    ahead = rise.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cap_ahead", F.coalesce(F.sum("cap").over(ahead), F.lit(0)))
    rows = rows.withColumn("weight_ahead", F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    rows = rows.withColumn("weights", F.sum("weight").over(every))
    left = F.col("whole") * (SHARE_NUM / SHARE_DEN) - F.col("cap_ahead")
    share = left / (F.col("weights") - F.col("weight_ahead"))
    rows = rows.withColumn("share", share).withColumn("full", F.col("cap") <= F.col("share") * F.col("weight"))
    # The first source that stays below its cap fixes the level for all after it.
    level = F.min(F.when(~F.col("full"), F.struct("weight_ahead", "share"))).over(every)["share"]
    target = F.when(F.col("full") | level.isNull(), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def apportion(rows: DataFrame, seats: str, votes: str, group: list[str], key: str, out: str) -> DataFrame:
    """Sainte-Lague: deals `seats` (equal in a group) to the rows of each group by highest votes / (2i + 1).

    Rounding votes / divisor for the divisor votes / seats gives a count that misses `seats` by a few; the seats
    with the lowest (or the next highest) quotients then go (or come).  Ties fall to the smaller key.
    """
    inside = Window.partitionBy(*group)
    rows = rows.withColumn("_v", F.sum(votes).over(inside)).withColumn(
        "_n", F.when(F.col("_v") > 0, F.floor(F.col(votes) * F.col(seats) / F.col("_v") + 0.5)).otherwise(F.lit(0)).cast("long")
    )
    rows = rows.withColumn("_off", F.when(F.col("_v") > 0, F.col(seats) - F.sum("_n").over(inside)).otherwise(F.lit(0)).cast("long"))
    # Candidate seats: the next _off ones where some are missing, the last -_off ones where there are too many.
    seat = F.when(F.col("_off") > 0, F.sequence(F.col("_n"), F.col("_n") + F.col("_off") - 1)).when(
        (F.col("_off") < 0) & (F.col("_n") > 0), F.sequence(F.greatest(F.col("_n") + F.col("_off"), F.lit(0)), F.col("_n") - 1)
    )
    asked = rows.filter(F.col("_off") != 0).select(*group, key, "_off", F.col(votes).alias("_votes"), F.explode(seat).alias("_i"))
    quotient = F.col("_votes") / (2 * F.col("_i") + 1)
    up = F.when(F.col("_off") > 0, -quotient).otherwise(quotient)
    by = Window.partitionBy(*group).orderBy(up, F.when(F.col("_off") > 0, F.col(key)).otherwise(-F.col(key)), "_i")
    change = (
        asked.withColumn("_r", F.row_number().over(by))
        .filter(F.col("_r") <= F.abs("_off"))
        .groupBy(*group, key)
        .agg(F.sum(F.signum("_off")).cast("long").alias("_change"))
    )
    change = change.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, key])], "_change")
    same = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate([*group, key])]
    kept = [c for c in rows.columns if c not in ("_v", "_n", "_off")]
    count = F.col("_n") + F.coalesce(F.col("_change"), F.lit(0))
    return rows.join(change, same, "left").select(*kept, count.alias(out))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    return dealt(sized(docs)).select("doc_id", "source", "size", "source_size", "target", "taken")


def dealt(sizes: DataFrame) -> DataFrame:
    """row, doc_id, source, size, source_size, target, place, shard, taken of every row of `sized`."""
    sizes = staged(spread(staged(sizes)))
    want = targets(sizes)
    ids = Window.orderBy(F.col("source").asc_nulls_last())
    blocks = F.floor(F.col("target") / BLOCK_WORDS + 0.5).cast("long")
    want = want.withColumn("source_no", (F.row_number().over(ids) - 1).cast("long")).withColumn("one", F.lit(1))
    want = want.withColumn("seats", F.sum(blocks).over(Window.partitionBy("one")))
    want = apportion(want, "seats", "target", ["one"], "source_no", "quota")
    want = want.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long"))
    want = staged(want.select("source", "source_no", "source_size", "target", "quota", "n_shards"))

    # One row a source: Spark sends it everywhere where it is small, and can split a hot source where it is not.
    rows = sizes.join(want, sizes["source"].eqNullSafe(want["source"])).select(
        "row", "doc_id", sizes["source"], "size", "place", "source_no", "source_size", "target", "quota", "n_shards"
    )
    rows = rows.withColumn("shard", sharded(F.col("n_shards")))
    # Where each document begins in its shard: a shard holds about SHARD_WORDS words, so its rows fit one task.
    line = Window.partitionBy("source_no", "shard").orderBy("place", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum("size").over(line), F.lit(0)))
    shards = rows.groupBy("source_no", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards, "quota", "shard_size", ["source_no"], "shard", "shard_quota")
    n_blocks = F.ceil(F.col("shard_size") / BLOCK_WORDS).cast("long")
    shards = shards.withColumn("n_blocks", n_blocks).withColumn("shard_quota", F.least("shard_quota", F.col("n_blocks") * MOST))
    # Every block is taken `whole` times, and `extra` of them, in a seeded order, once more.
    shards = shards.withColumn("whole", F.when(F.col("n_blocks") > 0, F.floor(F.col("shard_quota") / F.col("n_blocks"))).otherwise(F.lit(0)).cast("long"))
    shards = shards.withColumn("extra", F.col("shard_quota") - F.col("whole") * F.col("n_blocks"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block")
    block = shards.filter("n_blocks > 0").select("source_no", "shard", "whole", "extra", numbers)
    draw = F.md5(F.concat_ws(":", F.lit(SEED), "source_no", "shard", "block"))
    seeded = Window.partitionBy("source_no", "shard").orderBy(draw, "block")
    block = block.withColumn("more", (F.row_number().over(seeded) <= F.col("extra")).cast("long"))
    ahead = Window.partitionBy("source_no", "shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn("ahead", F.coalesce(F.sum("more").over(ahead), F.lit(0)))
    block = staged(block.select("source_no", "shard", "block", "whole", "more", "ahead"))

    # Words of the extra blocks ahead of a place of the shard, read where a document begins and at its last word.
    def extra_words(ahead, more, place):
        return ahead * BLOCK_WORDS + more * (place % BLOCK_WORDS)

    first = block.select("source_no", "shard", F.col("block").alias("b0"), F.col("ahead").alias("a0"), F.col("more").alias("m0"), "whole")
    last = block.select("source_no", "shard", F.col("block").alias("b1"), F.col("ahead").alias("a1"), F.col("more").alias("m1"))
    rows = rows.withColumn("b0", F.floor(F.col("begin") / BLOCK_WORDS)).withColumn("tail", F.col("begin") + F.col("size") - 1)
    rows = rows.withColumn("b1", F.floor(F.col("tail") / BLOCK_WORDS))
    full = rows.filter("size > 0").join(first, ["source_no", "shard", "b0"]).join(last, ["source_no", "shard", "b1"])
    got = extra_words(F.col("a1"), F.col("m1"), F.col("tail")) + F.col("m1") - extra_words(F.col("a0"), F.col("m0"), F.col("begin"))
    full = full.withColumn("taken", F.col("whole") * F.col("size") + got)
    empty = rows.filter("size = 0").withColumn("taken", F.lit(0))
    out = ["row", "doc_id", "source", "size", "source_size", "target", "place", "shard", F.col("taken").cast("long").alias("taken")]
    return full.select(*out).unionByName(empty.select(*out))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus in the columns of docs: each row taken / size times, rounded up or down.

    Along a shard, shortest documents first, a seeded running remainder decides, so the words a shard delivers miss those taken by less than two of its
    longest documents.  Rows are told apart by a number of their own; columns may have any name and type.
    """
    number, times, one = (free_name(docs, stem) for stem in ("row", "times", "copy"))
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()))
    mixed = dealt(sized(rows, number)).filter("size > 0")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.lit("start"), "source", "shard")), 1, 8), 16, 10).cast("double") / (1 << 32)
    line = Window.partitionBy("source", "shard").orderBy("size", "place", "row")
    rest = (F.col("taken") % F.col("size")) / F.col("size")
    upto = F.sum(rest).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.coalesce(F.sum(rest).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    count = F.floor(F.col("taken") / F.col("size")) + F.floor(start + upto) - F.floor(start + ahead)
    chosen = mixed.select(F.col("row").alias("_chosen"), count.cast("int").alias(times)).filter(F.col(times) > 0)
    chosen = chosen.withColumnRenamed("_chosen", free_name(docs, "chosen"))
    taken = rows.join(chosen, F.col(number) == F.col(free_name(docs, "chosen")))
    return taken.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("source")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS source_no,
         sum(source_size) OVER () AS whole_size, source_size * {MOST} AS cap
  FROM by_source
), risen AS (
  SELECT *, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER r, 0) AS cap_ahead, coalesce(sum(weight) OVER r, 0) AS weight_ahead
  FROM weighed
  WINDOW r AS (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
  SELECT *, (whole_size * {SHARE_NUM / SHARE_DEN}::DOUBLE - cap_ahead) / (weights - weight_ahead) AS share FROM risen
), levelled AS (
  SELECT *, cap <= share * weight AS is_full,
         first_value(CASE WHEN cap > share * weight THEN share END) OVER (ORDER BY CASE WHEN cap > share * weight THEN 0 ELSE 1 END, weight_ahead
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level
  FROM shared
), wanted AS (
  SELECT source, source_no, source_size, CASE WHEN is_full OR level IS NULL THEN cap::DOUBLE ELSE level * weight END AS target,
         greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS n_shards
  FROM levelled
), seats AS (SELECT sum(floor(target / {BLOCK_WORDS} + 0.5))::BIGINT AS seats FROM wanted),
source_quotients AS (
  SELECT source_no, target / (2 * i + 1) AS quotient, i
  FROM wanted, LATERAL (SELECT unnest(range(0, floor(target / {BLOCK_WORDS})::BIGINT + 1000)) AS i)
), source_won AS (
  SELECT source_no, row_number() OVER (ORDER BY quotient DESC, source_no, i) AS r FROM source_quotients
), source_quota AS (
  SELECT source_no, count(*) AS quota FROM source_won, seats WHERE r <= seats GROUP BY source_no
), rows AS (
  SELECT s.*, w.source_no, w.source_size, w.target, coalesce(q.quota, 0) AS quota,
         ('0x' || substr(place, 1, 8))::BIGINT % w.n_shards AS shard
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source LEFT JOIN source_quota q USING (source_no)
), laid AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source_no, shard ORDER BY place, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at
  FROM rows
), shards AS (SELECT source_no, shard, any_value(quota) AS quota, sum(size)::BIGINT AS shard_size FROM rows GROUP BY ALL),
shard_quotients AS (
  SELECT source_no, shard, quota, shard_size / (2 * i + 1) AS quotient, i
  FROM shards, LATERAL (SELECT unnest(range(0, quota + 1)) AS i)
), shard_won AS (
  SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY quotient DESC, shard, i) AS r FROM shard_quotients WHERE quotient > 0
), shard_quota AS (
  SELECT source_no, shard, count(*) FILTER (WHERE r <= quota) AS won FROM shard_won GROUP BY ALL
), planned AS (
  SELECT s.source_no, s.shard, ceil(s.shard_size / {BLOCK_WORDS})::BIGINT AS n_blocks,
         least(coalesce(q.won, 0), ceil(s.shard_size / {BLOCK_WORDS})::BIGINT * {MOST}) AS won
  FROM shards s LEFT JOIN shard_quota q USING (source_no, shard)
), drawn AS (
  SELECT source_no, shard, block, won // n_blocks AS whole,
         row_number() OVER (PARTITION BY source_no, shard
           ORDER BY md5('{SEED}:' || source_no || ':' || shard || ':' || block), block) <= won % n_blocks AS more
  FROM planned, LATERAL (SELECT unnest(range(0, n_blocks)) AS block) WHERE n_blocks > 0
), covered AS (
  SELECT l.source_no, l.shard, l.place, l.size, l.begin_at, any_value(d.whole) AS whole,
         coalesce(sum(least(l.begin_at + l.size, (d.block + 1) * {BLOCK_WORDS}) - greatest(l.begin_at, d.block * {BLOCK_WORDS}))
                  FILTER (WHERE d.more), 0) AS extra
  FROM laid l JOIN drawn d ON l.source_no = d.source_no AND l.shard = d.shard
    AND d.block BETWEEN l.begin_at // {BLOCK_WORDS} AND (l.begin_at + l.size - 1) // {BLOCK_WORDS}
  WHERE l.size > 0 GROUP BY ALL
)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(c.whole * c.size + c.extra, 0)::BIGINT AS taken
FROM laid l LEFT JOIN covered c
  ON l.source_no = c.source_no AND l.shard = c.shard AND l.place = c.place AND l.size = c.size AND l.begin_at = c.begin_at
"""
