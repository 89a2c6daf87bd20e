"""Hilbert keys of points on a grid, and running places in a key order that no single task has to see."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm.common import staged


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys (below 2**63) along the Hilbert curve of integer points, one a row, each coordinate in [0, 2**bits).

    Skilling's method: undo the rotations from the highest bit down, Gray-encode, and interleave the bits.
    """
    n, dims = cells.shape
    assert bits * dims <= 63, "a key holds 63 bits"
    x = [cells[:, d].astype(np.int64) for d in range(dims)]
    for bit in range(bits - 1, 0, -1):
        q = np.int64(1 << bit)
        low = q - 1
        for d in range(dims):
            flip = (x[d] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros(n, np.int64)
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & (1 << bit)) != 0, turn ^ ((1 << bit) - 1), turn)
    key = np.zeros(n, np.int64)
    x = [v ^ turn for v in x]
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> bit) & 1)
    return key


def laid_out(df: DataFrame, order: list[str], size: Column, name: str) -> DataFrame:
    """df with `name`, the sum of `size` over all rows ahead in `order` (which must tell rows apart).

    Rows are range-partitioned and sorted; each range sums its own rows and the few totals of ranges are summed over.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumn("_size", size.cast("long"))
    ranged = staged(ranged)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_size").alias("_total"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    placed = ranged.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    # One row a range: as many as shuffle partitions.
    placed = placed.join(F.broadcast(totals), F.col("_range") == F.col("_r"))
    return placed.select(*df.columns, (F.col("_in") + F.col("_ahead")).alias(name))
