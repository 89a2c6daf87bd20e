"""Toxicity by class-conditional Kneser-Ney models of expressions.

An expression is a run of letters or digits, lower-cased by Unicode's rules, read byte by byte from its start to its end, the end included.  Each class,
toxic and ordinary, has such a model with absolute discounting, whose history h of a byte b is the whole expression before it:

    P_c(b | h) = (n_c(hb) - D(n_c(hb)) + d_c(h) * P(b | h)) / n_c(h)

with n_c the texts of the class (an expression counts once a text, so a text that repeats itself does not weigh more), D the discount of a count
(`DISCOUNTS`) and d_c(h) the sum of the discounts of what the class has seen after h.  The backoff P(b | h) is shared by both classes and smooths rare
expressions.  It is an interpolated Kneser-Ney model itself, over the last `ORDER` bytes and, step by step, over one byte less down to none, counted
on the different expressions of the whole corpus (every document, no labels): places at the highest order, below it the different bytes that stand
ahead of a window.  Only the shared backoff looks back no further than ORDER bytes; the classes' histories have no bound.

A toxic text is ordinary text with a share of toxic expressions, so its likelihood of an expression w is (1 - s) P_ordinary(w) + s P_toxic(w).
The evidence of a text is the difference of the two log-likelihoods, toxic text and ordinary text, divided by the number of expressions.  A logistic
curve of two parameters over that one number, fitted on labelled rows kept apart from the counts, turns it into a probability; s is the one of `SHARES`
with which these rows' labels are most likely.

Bounds of the fit: at most `TOXIC` and `ORDINARY` labelled ids, one text an id (the least by hash); every `APART`-th of a class, the first
included, is kept apart.  What the corpus gives (`windows`) has no bound.  Edge cases: a null or empty text, or one without an expression, has evidence
0 and the score the curve gives to that; where a class has fewer than two labelled texts, every score is the share of toxic labels known (0 if none);
repeated rows and null doc_ids stay rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm.common import _P, _P_INV, Words, _pow, blocks, buffers, held_out, mix, read, staged, sums

#: Bounds of the labelled sample: texts of a class, the least by hash.
TOXIC, ORDINARY = 12_000, 16_000
CLASSES = ("toxic", "ordinary")
#: Bytes of history of the shared backoff; a window holds one more, and fits a long.
ORDER = 5
#: Of the labelled sample, one in APART calibrates instead of counting.
APART = 8
#: Discounts of counts of one, two, and three or more.  Larger than counts of counts suggest, as the bytes of one expression are no independent draws.
DISCOUNTS = (0.95, 1.5, 2.0)
THRESHOLD = 0.7
#: Shares of toxic expressions in toxic texts that are tried.
SHARES = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)

#: Expressions are ASCII letters and digits and everything beyond ASCII.
_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[128:] = False
#: What stands ahead of an expression, and its end: bytes that are never in one.
START, END = 1, 2


def lowered(column: pa.Array) -> pa.Array:
    """Texts in lower case, by Unicode's rules."""
    return pc.utf8_lower(column.cast(pa.large_string()))


def text_blocks(column: pa.Array):
    """(first row, last row, bytes, expressions) of each block of lower-cased texts."""
    data, offsets = buffers(lowered(column))
    for a, b in blocks(offsets):
        part = data[offsets[a] : offsets[b]]
        yield a, b, part, Words(part, offsets[a : b + 1], _BREAKS)


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given expressions one after the other, each followed by END, and where each begins (one place more than expressions)."""
    size = end - start + 1
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(start, size)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    out = np.full(first[-1], END, np.uint8)
    out[~last] = data[place[~last]]
    return out, first


def windows_of(line: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each byte of spelled expressions: it and the ORDER bytes ahead of it in its expression (START before its first), in one number."""
    at = np.arange(len(line)) - np.repeat(first[:-1], np.diff(first))
    out = np.zeros(len(line), np.int64)
    for back in range(ORDER + 1):
        byte = np.full(len(line), START, np.int64)
        inside = at >= back
        byte[inside] = line[np.flatnonzero(inside) - back]
        out |= byte << (8 * back)
    return out


def prefixes(line: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of spelled expressions, 64-bit hashes of its expression up to and including it, and of what is ahead of it."""
    back = _pow(_P_INV, len(line) + 1, "i")
    total = np.zeros(len(line) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((line.astype(np.uint64) + np.uint64(1)) * _pow(_P, len(line), "p")[: len(line)], out=total[1:])
        begin = np.repeat(first[:-1], np.diff(first))
        at = np.arange(len(line))

        def hashed(end: np.ndarray) -> np.ndarray:
            return mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))

        return hashed(at + 1), hashed(at)


# The shared backoff ----------------------------------------------------------------------------------------


def windows(docs: DataFrame) -> DataFrame:
    """gram long, n: the windows of all different expressions of the corpus and the places where they stand.  Grows with the corpus."""

    def found(batches):
        for batch in batches:
            seen: dict[bytes, None] = {}
            for _, _, data, words in text_blocks(batch.column(0)):
                raw = data.tobytes()
                _, place = np.unique(words.hash, return_index=True)
                seen.update(dict.fromkeys(raw[s:e] for s, e in zip(words.start[place].tolist(), words.end[place].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary())], ["word"])

    def cut(batches):
        for batch in batches:
            data, offsets = buffers_of_binary(batch.column(0))
            for a, b in blocks(offsets):
                grams, n = np.unique(windows_of(*spelled(data, offsets[a:b], offsets[a + 1 : b + 1])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], ["gram", "n"])

    words = docs.select("text").mapInArrow(found, "word binary").distinct()
    return words.mapInArrow(cut, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def buffers_of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def tail(gram: Column, size: int) -> Column:
    """The last `size` bytes of a window."""
    return gram.bitwiseAND(F.lit((1 << 8 * size) - 1))


def backoff(top: DataFrame) -> DataFrame:
    """gram, shared: P(b | h) of every window (gram, n), recursively interpolated with one byte of history less."""
    levels = {ORDER + 1: top}
    for size in range(ORDER, 0, -1):
        # A window's continuation count: the different bytes that stand ahead of it.
        shorter = levels[size + 1].select(tail(F.col("gram"), size).alias("gram"))
        levels[size] = staged(shorter.groupBy("gram").agg(F.count("*").alias("n")))
    every = levels[1].select(F.lit(1).alias("size"), "n")
    for size in range(2, ORDER + 2):
        every = every.unionByName(levels[size].select(F.lit(size).alias("size"), "n"))
    few = every.groupBy("size").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()
    discount = {row["size"]: min(0.95, max(0.1, row["once"] / max(1, row["once"] + 2 * row["twice"]))) for row in few}
    # A history has at most 257 rows, one a byte.
    after = Window.partitionBy(F.shiftright("gram", 8))
    lower = None
    for size in range(1, ORDER + 2):
        d = F.lit(discount.get(size, 0.5))
        rows = levels[size].select("gram", "n", F.sum("n").over(after).alias("total"), F.count("*").over(after).alias("seen"))
        if lower is None:
            rows = rows.withColumn("less", F.lit(1 / 256))
        else:
            rows = rows.withColumn("short", tail(F.col("gram"), size - 1)).join(lower.select(F.col("gram").alias("short"), F.col("shared").alias("less")), "short")
        shared = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("seen") * F.col("less")) / F.col("total")
        lower = rows.select("gram", shared.alias("shared"))
    return lower


# The labelled sample ---------------------------------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, apart, text of the sample: at most TOXIC and ORDINARY ids, one text each."""
    spark = docs.sparkSession
    known = labels.filter(~held_out("doc_id") & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("draw", F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)))
    chosen = []
    for toxic, most in ((1, TOXIC), (0, ORDINARY)):
        rows = known.filter(F.col("toxic") == toxic).orderBy("draw", "doc_id").limit(most).collect()
        chosen += [(row["doc_id"], toxic, k % APART == 0) for k, row in enumerate(rows)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = spark.createDataFrame(chosen, f"_id {labels.schema['doc_id'].dataType.simpleString()}, toxic int, apart boolean")
    # At most TOXIC + ORDINARY ids: small enough to send everywhere.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    # Of an id that has many texts, one.
    first = F.min(F.struct(F.xxhash64("text").alias("draw"), F.col("text").alias("text")))
    rows = rows.groupBy("doc_id", "toxic", "apart").agg(first.alias("first"))
    return rows.select(F.col("doc_id").cast(kind).alias("doc_id"), "toxic", "apart", F.col("first.text").alias("text"))


def class_counts(sample: DataFrame) -> DataFrame:
    """own, history (hashes of a gram and of what is ahead of its last byte), gram (its window), toxic and ordinary texts with an expression that begins so, each as often as it has such expressions."""

    def rows(batches):
        for batch in batches:
            toxic = np.array(batch.column(0).to_pylist(), bool)
            for a, b, data, words in text_blocks(batch.column(1)):
                _, place, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
                # An expression counts once a text.
                doc, which = np.divmod(np.unique(words.doc * max(1, len(place)) + inverse), max(1, len(place)))
                by = np.bincount(which, toxic[a:b][doc], len(place)).astype(np.int64)
                every = np.bincount(which, minlength=len(place))
                line, first = spelled(data, words.start[place], words.end[place])
                own, history = prefixes(line, first)
                times = np.diff(first)
                columns = [own.view(np.int64), history.view(np.int64), windows_of(line, first), np.repeat(by, times), np.repeat(every - by, times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["own", "history", "gram", "toxic", "ordinary"])

    found = sample.select("toxic", "text").mapInArrow(rows, "own long, history long, gram long, toxic long, ordinary long")
    return found.groupBy("own", "history", "gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def discount_of(count: Column) -> Column:
    one, two, more = map(F.lit, DISCOUNTS)
    return F.when(count == 0, 0.0).when(count == 1, one).when(count == 2, two).otherwise(more)


def steps(counts: DataFrame, shared: DataFrame) -> DataFrame:
    """own, ratio, history, rest: log P_toxic / P_ordinary of the last byte of each gram, and of any byte that no class has seen after its history.

    There P(b | h) is a factor of both classes and cancels; after a history that no class has seen the ratio is 0.
    """
    # A history has at most 257 rows, one a byte.
    after = Window.partitionBy("history")
    rows = counts.join(shared, "gram")
    p, left = {}, {}
    for c in CLASSES:
        discount = discount_of(F.col(c))
        rows = rows.withColumn(f"n_{c}", F.sum(c).over(after)).withColumn(f"d_{c}", F.sum(discount).over(after))
        seen = F.col(f"n_{c}") > 0
        left[c] = F.when(seen, F.col(f"d_{c}") / F.col(f"n_{c}")).otherwise(1.0)
        p[c] = F.when(seen, (F.col(c) - discount) / F.col(f"n_{c}")).otherwise(0.0) + left[c] * F.col("shared")
    ratio, rest = F.log(p["toxic"]) - F.log(p["ordinary"]), F.log(left["toxic"]) - F.log(left["ordinary"])
    return rows.select("own", ratio.cast("float").alias("ratio"), "history", rest.cast("float").alias("rest"))


# Scoring ---------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Steps by the sorted hashes of grams, and of histories; the share of toxic expressions and the curve (None: every score is `known`)."""

    grams: np.ndarray
    ratio: np.ndarray
    histories: np.ndarray
    rest: np.ndarray
    shares: tuple[float, ...] = SHARES
    curve: tuple[float, float] | None = None
    known: float = 0.0

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Of each text, a column a share: the difference of its log-likelihoods as toxic and as ordinary text, divided by its expressions."""
        out = np.zeros((len(column), len(self.shares)))
        for a, b, data, words in text_blocks(column):
            _, place, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
            found = self.words(data, words.start[place], words.end[place])
            n = np.maximum(np.diff(words.first), 1)
            for k, share in enumerate(self.shares):
                out[a:b, k] = sums(np.logaddexp(np.log1p(-share), np.log(share) + found)[inverse], words.first) / n
        return out

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each expression, over all of its bytes and its end."""
        line, first = spelled(data, start, end)
        own, history = prefixes(line, first)
        found, there = looked_up(own, self.grams, self.ratio)
        unseen = np.flatnonzero(~there)
        found[unseen] = looked_up(history[unseen], self.histories, self.rest)[0]
        return sums(found, first)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """Scores from evidence of the one share that was chosen."""
        if self.curve is None:
            return np.full(len(evidence), self.known)
        shift, slope = self.curve
        return 1 / (1 + np.exp(-np.clip(shift + slope * evidence / self.shares[0], -40, 40)))


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key in sorted `known` (0 where it is not there), and whether it is there."""
    if not len(known):
        return np.zeros(len(keys), values.dtype), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    there = known[at] == keys
    return np.where(there, values[at], 0), there


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys of two columns, as they sort, and their values."""
    found = rows.toArrow()
    keys, values = (found.column(k).to_numpy() for k in (0, 1))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], values[order]


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Shift and slope (never negative) of a logistic curve, by Newton steps with a slight ridge."""
    inputs, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -30, 30)))
        slope = inputs.T @ (weight * (p - y)) + 0.05 * w
        curve = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    if w[1] < 0:  # evidence that points the wrong way says nothing
        share = float((weight * y).sum() / weight.sum())
        return float(np.log(share / (1 - share))), 0.0
    return float(w[0]), float(w[1])


def _empty() -> list[np.ndarray]:
    return [np.zeros(0, np.uint64), np.zeros(0, np.float32)] * 2


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.filter(~held_out("doc_id") & F.col("toxic").isNotNull())
    totals = known.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")).first()
    n, toxic = totals["n"] or 0, totals["toxic"] or 0
    share = toxic / n if n else 0.0
    if not toxic or toxic == n:
        return Model(*_empty(), known=share)
    sample = staged(labelled(docs, labels))
    both = {tuple(row) for row in sample.select("toxic", "apart").distinct().collect()}
    if len(both) < 4:
        return Model(*_empty(), known=share)
    counts = staged(class_counts(sample.filter(~F.col("apart"))))
    # Of the whole corpus: grows with it, and is only ever read by joins.
    shared = backoff(staged(windows(docs)))
    grams = staged(steps(counts, shared))
    # 12 bytes a gram of the sample, and a history.
    model = Model(*_sorted(grams.select("own", "ratio")), *_sorted(grams.groupBy("history").agg(F.first("rest"))), known=share)
    apart = _measured(sample.filter("apart"), model, ["doc_id", "toxic"]).orderBy("doc_id", "toxic").toPandas()
    y, found = apart["toxic"].to_numpy(float), np.array(apart["evidence"].tolist())
    # The sample has other shares of the classes than the labels; weights restore them.
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    fitted = []
    for k, s in enumerate(SHARES):
        x = found[:, k] / s
        curve = calibrate(x, y, weight)
        fitted.append((float((weight * np.logaddexp(0, (1 - 2 * y) * (curve[0] + curve[1] * x))).sum()), s, curve))
    _, s, model.curve = min(fitted)
    model.shares = (s,)
    return model


#: The model a worker used last, by the name its broadcast was given.
_loaded: dict[str, Model] = {}


def _load(name: str, shipped) -> Model:
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = shipped.value
    return _loaded[name]


def _measured(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and evidence as an array, a value a share."""
    # The grams of the sample of labelled texts, 12 bytes each, and their histories.
    shipped, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def rows(batches):
        for batch in batches:
            found = _load(name, shipped).evidence(batch.column(batch.num_columns - 1))
            values = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*keep, "evidence"])

    given = docs.select(*keep, "text")
    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(rows, f"{kinds}, evidence array<double>")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, evidence, score of every document."""
    shipped, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def rows(batches):
        for batch in batches:
            local = _load(name, shipped)
            found = local.evidence(batch.column(1))[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(local.score(found))], ["doc_id", "evidence", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, evidence double, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scored(docs, learn(docs, read(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted, "evidence")
