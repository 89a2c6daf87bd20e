"""Approximate nearest neighbours along shifted Hilbert curves.

Equal vectors are one point, which carries its smallest vec_ids: as many as any query could want of it, so ties among copies are exact.
Every curve projects the points to `DIMS` dimensions by part of a random rotation, evens each coordinate out by its quantiles, shifts the grid, and
orders the points by Hilbert key (those of one cell by a hash of the curve's own) in a range partitioning.  A query's candidates on a curve are the points
within a window of places to either side; windows of all curves merge, and candidates are ranked by their exact Euclidean distance in double precision.

Quantiles are fitted on at most `SAMPLE` points of a length, those with the least hash; every point is indexed.  Cells are thus as fine as the data
are dense: neither a cluster with a third of all rows nor a vector far off leaves most points in few cells.

Windows are a share of the points (`SHARE`, `LEAST` places at least): vectors without low-dimensional structure, whose tenth neighbour is hardly
nearer than a random one, need a constant share of all rows for a given recall.  Places are cut into blocks of
`BLOCK`; a block meets the points that ask and whose windows reach it, at most (BLOCK + 2 windows) of them.

Edge cases: vectors that are null, zero or hold a null or non-finite component, and rows without vec_id, take no part, neither as
queries nor as candidates; vectors are compared with those of their own length; rows that share a vec_id count once, at their least distance; ties go to
the smaller vec_id; a query with fewer candidates than asked gets them all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm.common import read, staged
from tickerloom.llm.curve import hilbert, laid_out

CURVES, DIMS, BITS = 16, 8, 7
SHARE, LEAST = 0.032, 256
BLOCK = 4096
#: Points of a length that quantiles are fitted on, and how many quantiles.
SAMPLE, QUANTILES = 4096, 512
NEIGHBOURS = 10
QUERY_EVERY = 100


def packing_of(vectors: DataFrame) -> str:
    """How components are packed: as they are stored, 32-bit or 64-bit."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, size, vector (packed components) of the vectors that take part."""
    kind = packing_of(vectors)

    def rows(batches):
        for batch in batches:
            keep, packed, sizes = [], [], []
            column = batch.column(1)
            for k in range(batch.num_rows):
                value = column[k].values if column[k].is_valid else None
                if value is None or not len(value) or value.null_count:
                    continue
                # Negative zeros are zeros, so that equal vectors are equal bytes.
                v = value.to_numpy(zero_copy_only=False).astype(kind) + 0
                if np.isfinite(v).all() and v.any():
                    keep.append(k)
                    packed.append(v.astype(kind).tobytes())
                    sizes.append(len(v))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "size", "vector"])

    given = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding")
    return given.mapInArrow(rows, "vec_id long, size int, vector binary")


def points(rows: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """point (a number), size, vector, vec_ids (its k + 1 smallest: one may be the query's own) and asks (a query has it), one row a vector."""
    inside = Window.partitionBy("vector").orderBy("vec_id")
    # Each partition passes on its own k + 1 smallest, so copies of a vector never meet in one task.
    least = rows.withColumn("rank", F.row_number().over(inside)).filter(F.col("rank") <= k + 1)
    found = least.groupBy("vector").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("vec_id")).alias("vec_ids"))
    found = found.join(asking.select(F.col("vector").alias("asked")).distinct(), F.col("vector") == F.col("asked"), "left")
    return staged(found.select(F.monotonically_increasing_id().alias("point"), "size", "vector", "vec_ids", F.col("asked").isNotNull().alias("asks")))


def _matrix(packed: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype("<f8")


def samples(found: DataFrame, kind: str) -> dict[int, tuple[int, np.ndarray]]:
    """For each vector length: points, and at most SAMPLE of them as a matrix, those with the least hash."""
    out: dict[int, tuple[int, np.ndarray]] = {}
    draw = F.xxhash64("vector")
    for size, n in sorted(map(tuple, found.groupBy("size").count().collect())):
        # Twice as many as wanted pass, whatever n is; the least of them are taken.
        bound = min((1 << 64) * 2 * SAMPLE // n, (1 << 64) - 1) - (1 << 63)
        drawn = found.filter((F.col("size") == size) & (draw <= bound)).select("vector", draw.alias("draw")).orderBy("draw", "vector").limit(SAMPLE)
        out[size] = n, _matrix([bytes(row["vector"]) for row in drawn.collect()], kind)
    return out


def _curve(size: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection (size x dims) and shift (dims) of a curve: parts of a random rotation, then of the next."""
    dims = min(DIMS, size)
    each = max(1, size // dims)
    rng = np.random.default_rng((size, curve // each))
    rotation, _ = np.linalg.qr(rng.normal(size=(size, size)))
    at = curve % each * dims
    return rotation[:, at : at + dims], np.random.default_rng((size, curve, 1)).random(dims)


class Grid:
    """Cells of the vectors of one length on one curve."""

    def __init__(self, sample: np.ndarray, curve: int):
        self.project, self.shift = _curve(sample.shape[1], curve)
        self.centre = np.median(sample, axis=0)
        at = (np.arange(QUANTILES) + 0.5) / QUANTILES
        self.knots = np.quantile(self._projected(sample), at, axis=0)
        self.levels = np.array([NormalDist().inv_cdf(p) for p in at])

    def _projected(self, m: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num((m - self.centre) @ self.project)

    def keys(self, m: np.ndarray) -> np.ndarray:
        """Hilbert keys: coordinates laid out as those of a normal distribution, three deviations to either side and up to one more of shift."""
        x = self._projected(m)
        even = np.stack([np.interp(x[:, d], self.knots[:, d], self.levels) for d in range(x.shape[1])], axis=1)
        cells = (even + 3 + self.shift) / 7 * (1 << BITS)
        return hilbert(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def keyed(found: DataFrame, shape: dict[int, tuple[int, np.ndarray]], kind: str) -> DataFrame:
    """line (of one curve and vector length), key, tie, point: a row for each curve, without the vector."""
    sizes = sorted(shape)
    grids = {(size, c): Grid(shape[size][1], c) for size in sizes for c in range(CURVES)}

    def rows(batches):
        for batch in batches:
            all_sizes = np.array(batch.column(1).to_pylist(), np.int32)
            for at, size in enumerate(sizes):
                part = batch.filter(pa.array(all_sizes == size))
                if not part.num_rows:
                    continue
                m = _matrix(part.column(2).to_pylist(), kind)
                for c in range(CURVES):
                    line = pa.array(np.full(part.num_rows, at * CURVES + c, np.int32))
                    yield pa.RecordBatch.from_arrays([line, pa.array(grids[size, c].keys(m)), part.column(3), part.column(0)], ["line", "key", "name", "point"])

    named = found.select("point", "size", "vector", F.xxhash64("vector").alias("name"))
    out = named.mapInArrow(rows, "line int, key long, name long, point long")
    return out.select("line", "key", F.xxhash64("line", "name").alias("tie"), "point")


def measured(q: np.ndarray, m: np.ndarray, vec_ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The vec_ids of the vectors of m, nearest first, each once at its least distance from q, and the distances."""
    d = m - q
    # Squares add up in the order of the components, as written down; sum() would pair them.
    d = np.sqrt(np.cumsum(d * d, axis=1)[:, -1])
    score, names = np.repeat(d, [len(v) for v in vec_ids]), np.concatenate(vec_ids).astype(np.int64)
    order = np.lexsort((names, score))
    names, score = names[order], score[order]
    first = np.sort(np.unique(names, return_index=True)[1])
    return names[first], score[first]


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (over vec_id) holds."""
    spark = vectors.sparkSession
    kind = packing_of(vectors)
    rows = staged(usable(vectors).groupBy("vec_id", "size", "vector").agg(F.lit(1).alias("one")).drop("one"))
    asking = rows.filter(is_query)
    found = points(rows, asking, k)
    shape = samples(found, kind)
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Places are found without the vectors, which then move once, to their blocks.
    placed = laid_out(keyed(found, shape, kind), ["line", "key", "tie", "point"], F.lit(1), "place")
    placed = placed.select("point", "line", "place").join(found.drop("size"), "point")
    # All vectors of a length lie on each of its lines, and lines lie one after the other.
    count = {at * CURVES + c: shape[size][0] for at, size in enumerate(sorted(shape)) for c in range(CURVES)}
    begin = dict(zip(count, np.cumsum([0, *list(count.values())[:-1]]).tolist(), strict=True))
    reach = {line: max(LEAST, int(np.ceil(SHARE * n))) for line, n in count.items()}

    def looked_up(values: dict[int, int]) -> Column:
        return F.element_at(F.array(*[F.lit(int(values[line])) for line in sorted(values)]), F.col("line") + 1).cast("long")

    low = F.greatest(F.col("place") - looked_up(reach), looked_up(begin))
    high = F.least(F.col("place") + looked_up(reach), looked_up(begin) + looked_up(count) - 1)
    block = F.floor(F.col("place") / BLOCK).alias("block")
    asked = placed.filter("asks").select(F.col("point").alias("asker"), F.col("vector").alias("query"), low.alias("low"), high.alias("high"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))))
    members = placed.select(block, "place", "vec_ids", "vector")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"asker": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        place, ids = left["place"].to_numpy(), left["vec_ids"].to_pylist()
        # A block at the seam of two vector lengths holds both.
        packed = left["vector"].to_pylist()
        widths = np.array([len(v) for v in packed])
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        stacked = {w: _matrix([v for v in packed if len(v) == w], kind) for w in np.unique(widths).tolist()}
        rows_of = {w: np.flatnonzero(widths == w) for w in stacked}
        with np.errstate(over="ignore", invalid="ignore"):
            norms = {w: (m * m).sum(1) for w, m in stacked.items()}
            for asker, raw, first, last in zip(*(right[c].to_pylist() for c in ("asker", "query", "low", "high")), strict=True):
                w = len(raw)
                if w not in stacked:
                    continue
                at = rows_of[w]
                near = np.flatnonzero((place[at] >= first) & (place[at] <= last))
                if not len(near):
                    continue
                q = np.frombuffer(raw, kind).astype("<f8")
                m = stacked[w]
                few = near
                if len(near) > k + 1:
                    rough = norms[w][near] - 2 * (m[near] @ q) + q @ q
                    # Whatever rounding could bring among the nearest is measured exactly.
                    limit = np.partition(rough, k)[k]
                    few = near[~(rough > limit + 1e-9 * (1 + abs(limit) + norms[w][near].max() + q @ q))]
                names, score = measured(q, m[few], [ids[row] for row in at[few].tolist()])
                if len(names) <= k and len(few) < len(near):
                    # Vectors that share a vec_id filled the places.
                    names, score = measured(q, m[near], [ids[row] for row in at[near].tolist()])
                out.append((asker, names[: k + 1], score[: k + 1]))
        if not out:
            return empty
        return pa.table({
            "asker": pa.array(np.repeat([q for q, _, _ in out], [len(v) for _, v, _ in out]).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([v for _, v, _ in out])),
            "score": pa.array(np.concatenate([d for _, _, d in out])),
        })

    near = members.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(nearest, "asker long, vec_id long, score double")
    near = near.groupBy("asker", "vec_id").agg(F.min("score").alias("score"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("asker").orderBy("score", "vec_id"))).filter(F.col("rank") <= k + 1)
    lists = near.groupBy("asker").agg(F.collect_list(F.struct("score", "vec_id")).alias("nearest"))
    # Every query takes the list of its vector, without itself; k + 1 are as many as that needs.
    answers = found.filter("asks").select(F.col("vector").alias("asked"), "point").join(lists, F.col("point") == F.col("asker"))
    every = asking.select(F.col("vec_id").alias("query_id"), "vector").join(answers, F.col("vector") == F.col("asked"))
    every = every.select("query_id", F.explode("nearest").alias("hit")).filter(F.col("hit.vec_id") != F.col("query_id"))
    every = every.groupBy("query_id", F.col("hit.vec_id").alias("vec_id")).agg(F.min("hit.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


#: Every pair, compared: what the search finds where its windows meet all rows.
SQL = f"""
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), measured AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    min(sqrt(list_reduce(list_transform(list_zip(c.v, q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, x: a + x))) AS score
  FROM valid q JOIN valid c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v) GROUP BY ALL
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM measured)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {NEIGHBOURS}
"""
