"""Quality classification by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are training rows marked quality 1; unlabelled web text is a sample of all training rows, whatever their
labels.  Both are bounded (`POSITIVES`, `UNLABELLED`), whatever the rows an id has.  The class prior is estimated from the same two samples: the share of
unlabelled text that a score threshold lets through, over the share of positives it lets through, is an upper bound of the prior, and the smallest such
bound with its sampling error is taken.  A small network on features of the text then minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

and where the inner term turns negative the step goes against it, as in the published non-negative estimator.

The features describe the form of a text, not its subject: symbol, capital and digit shares, repetition of words and lines, word and
line lengths.  Edge cases: a null or empty text has features of its own (all zero but the flag for emptiness) and is scored like any other; without
trusted positives every text scores 0.5; repeated rows and null doc_ids stay rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import held_out, read, sums, words_of

#: Bounds of the fit: ids of trusted positives, and unlabelled rows.
POSITIVES, UNLABELLED = 12_000, 12_000
THRESHOLD = 0.5
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 512, 4e-3, 1e-4
#: Steps at least, for samples of a few batches.
STEPS = 1400
NAMES = (
    "empty", "log_words", "log_line_words", "word_length", "long_words", "symbols", "triples", "bars", "bangs", "capitals", "digits", "stops",
    "alphabetic_words", "next_same", "distinct", "distinct_pairs", "repeated_pairs", "top_word", "lines_distinct", "high_bytes", "capital_words",
)

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in b".,;:'\"()?-":
    _KIND[_c] = 3
for _c in b"*%$#&@^~<>{}[]\\/_=+`":
    _KIND[_c] = 4
_KIND[ord("|")] = 5
_KIND[ord("!")] = 6
_KIND[97:123] = 7
_KIND[128:] = 8
_KIND[10] = 9


def features(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    out = np.zeros((len(column), len(NAMES)))
    for a, b, data, offsets, words in words_of(column):
        n = np.diff(words.first).astype(float)
        size = np.maximum(np.diff(offsets), 1).astype(float)
        kind = _KIND[data]

        def share(mask, offsets=offsets, size=size):
            return sums(mask, offsets) / size

        one = np.maximum(n, 1)
        length = words.end - words.start
        first_kind = kind[words.start] if len(data) else np.zeros(0, np.uint8)
        same_doc = words.doc[1:] == words.doc[:-1]
        pair_first = np.minimum(words.first, len(same_doc))
        again = (words.hash[1:] == words.hash[:-1]) & same_doc
        # Distinct words, pairs and lines of a text, and its most frequent word.
        order = np.lexsort((words.hash, words.doc))
        h, d = words.hash[order], words.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        runs = np.flatnonzero(new)
        run_length = np.diff(np.append(runs, len(h)))
        top = np.zeros(b - a)
        np.maximum.at(top, d[runs], run_length)
        with np.errstate(over="ignore"):
            pairs = (words.hash[1:] * np.uint64(3) + words.hash[:-1])[same_doc]
        pair_doc = words.doc[1:][same_doc]
        order = np.lexsort((pairs, pair_doc))
        ph, pd = pairs[order], pair_doc[order]
        new_pair = np.ones(len(ph), bool)
        new_pair[1:] = (ph[1:] != ph[:-1]) | (pd[1:] != pd[:-1])
        n_pairs = np.maximum(np.bincount(pair_doc, minlength=b - a), 1)
        distinct_pairs = np.bincount(pd[new_pair], minlength=b - a) / n_pairs
        triple = np.zeros(len(data), bool)
        if len(data) > 2:
            triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (kind[2:] >= 3) & (kind[2:] <= 6)
        lines = sums(kind == 9, offsets) + 1
        out[a:b] = np.column_stack([
            n == 0, np.log1p(n), np.log1p(n / lines), sums(length, words.first) / one, sums(length > 20, words.first) / one,
            share(kind == 4), share(triple), share(kind == 5), share(kind == 6), share(kind == 1), share(kind == 2), share(kind == 3),
            sums((first_kind == 1) | (first_kind >= 7) & (first_kind < 9), words.first) / one,
            sums(again, pair_first) / one,
            # A longer text repeats more words: compared with what its length leads one to expect.
            np.bincount(d[runs], minlength=b - a) / np.maximum(n, 1) ** 0.85,
            distinct_pairs, 1 - distinct_pairs ** 4, top / one, lines / one, share(kind == 8), sums(first_kind == 1, words.first) / one,
        ])
    return out


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and its features, as an array."""

    def rows(batches):
        for batch in batches:
            f = features(batch.column(batch.num_columns - 1)).astype(np.float32)
            values = pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*keep, "features"])

    given = docs.select(*keep, "text")
    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(rows, f"{kinds}, features array<float>")


def _draw(seed: int):
    """A seeded number of a row, by id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.lit(seed))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the trusted positives and of the unlabelled text, in an order that reruns keep.

    At most POSITIVES ids, one text each, and at most UNLABELLED rows, repeated rows once: the least by hash.
    """
    spark, nothing = docs.sparkSession, np.zeros((0, len(NAMES)))
    known = labels.filter(~held_out("doc_id") & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = known.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), "doc_id").limit(POSITIVES).collect()
    given = docs.filter(~held_out("doc_id")).select("doc_id", "text")
    draws = given.select(_draw(5).alias("draw")).distinct().orderBy("draw").limit(UNLABELLED).collect()
    if not ids or not draws:
        return nothing, nothing
    # Both are of bounded size: small enough to send everywhere.
    positive = F.broadcast(spark.createDataFrame(ids, f"_known {labels.schema['doc_id'].dataType.simpleString()}"))
    drawn = F.broadcast(spark.createDataFrame(draws, "_drawn long"))
    text = F.min(F.struct(_draw(5).alias("draw"), F.col("text").alias("text"))).alias("first")
    p = given.join(positive, F.col("doc_id") == F.col("_known")).groupBy("doc_id").agg(text)
    u = given.withColumn("draw", _draw(5)).join(drawn, F.col("draw") == F.col("_drawn")).groupBy("draw").agg(F.min("text").alias("text"))
    both = p.select(F.lit(True).alias("is_p"), "first.draw", "first.text").unionByName(u.select(F.lit(False).alias("is_p"), "draw", "text"))
    got = featured(both, ["is_p", "draw"]).toPandas()
    x, is_p = np.array(got["features"].tolist(), float).reshape(len(got), len(NAMES)), got["is_p"].to_numpy(bool)
    order = np.lexsort((*x.T, got["draw"].to_numpy()))
    x, is_p = x[order], is_p[order]
    return x[is_p], x[~is_p]


class Network:
    """A scaled input, one hidden layer and a logit."""

    def __init__(self, size: int, rng: np.random.Generator):
        self.mean, self.scale = np.zeros(size), np.ones(size)
        self.w = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[0] + self.w[1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))

    def gradient(self, x: np.ndarray, by_logit: np.ndarray) -> list[np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.w[0] + self.w[1])
        back = by_logit[:, None] * self.w[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ by_logit, by_logit.sum(keepdims=True)]


def _train(p: np.ndarray, u: np.ndarray, prior: float, epochs: int, seed: int) -> Network:
    """Adam steps on the non-negative risk with the sigmoid loss."""
    rng = np.random.default_rng(seed)
    net = Network(p.shape[1], rng)
    both = np.vstack([p, u])
    net.mean, net.scale = both.mean(0), both.std(0) + 1e-6
    first = [np.zeros_like(w) for w in net.w]
    second = [np.zeros_like(w) for w in net.w]
    step = 0
    n = max(1, max(len(p), len(u)) // BATCH)
    for _ in range(max(epochs, STEPS // n)):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for ps, us in zip(np.array_split(pi, n), np.array_split(ui, n), strict=True):
            if not len(ps) or not len(us):
                continue
            sp, su = net.score(p[ps]), net.score(u[us])
            # Sigmoid loss: l(+) = 1 - s, l(-) = s.
            slope_p, slope_u = sp * (1 - sp) / len(ps), su * (1 - su) / len(us)
            if su.mean() - prior * sp.mean() >= 0:
                parts = (p[ps], -2 * prior * slope_p), (u[us], slope_u)
            else:
                parts = (p[ps], prior * slope_p), (u[us], -slope_u)
            grads = [a + b for a, b in zip(*(net.gradient(*part) for part in parts), strict=True)]
            step += 1
            for k, g in enumerate(grads):
                g = g + DECAY * net.w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.w[k] = net.w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in u: the least upper bound that a ranking of held-apart rows gives."""
    net = _train(p[::2], u[::2], 0.5, 20, 11)
    sp, su = np.sort(net.score(p[1::2])), np.sort(net.score(u[1::2]))
    if not len(sp) or not len(su):
        return 0.5
    # Let through: scores of at least t, for the t at which 5 % to 100 % of the positives pass.
    t = sp[np.linspace(0, 0.95 * (len(sp) - 1), 200).astype(int)]
    through_p = 1 - np.searchsorted(sp, t) / len(sp)
    through_u = 1 - np.searchsorted(su, t) / len(su)
    error = np.sqrt(through_u * (1 - through_u) / len(su) + through_p * (1 - through_p) / len(sp))
    bound = (through_u + 0.5 * error) / np.maximum(through_p - 0.5 * error, 1e-3)
    return float(np.clip(bound[through_p > 0.2].min(), 0.02, 0.98))


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    p, u = sample(docs, labels)
    if not len(p) or not len(u):
        return None
    return _train(p, u, estimate_prior(p, u), EPOCHS, 7)


def _scored(docs: DataFrame, model: Network | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs as c0, c1, ... (docs may have columns of any name), score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def rows(batches):
        for batch in batches:
            f = features(batch.column(batch.num_columns - 1))
            s = shared.value.score(f) if shared.value else np.full(len(f), 0.5)
            predicted = pa.array((s >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), predicted], [*(f"c{i}" for i in range(len(keep))), "score", "predicted"])

    given = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return given.mapInArrow(rows, f"{kinds}, score double, predicted int")


def score(docs: DataFrame, model: Network | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, score and predicted."""
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    return _scored(docs, model, keep).select(*names, "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, in the columns of docs."""
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return _scored(docs, learn(docs, labels), docs.columns).filter("predicted = 1").select(*names)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, read(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
