"""Shared helpers: folds, staged tables and word hashes over Arrow text buffers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vector code; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def fold(doc_id: Column | str) -> Column:
    """crc32 of doc_id as text, modulo 3 (a null id counts as the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % 3


def held_out(doc_id: Column | str) -> Column:
    """True for rows whose labels are never learned from."""
    return fold(doc_id) == 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where unset, a local one of our own, which a cluster refuses."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
            own = tempfile.mkdtemp(prefix="tickerloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            context.setCheckpointDir(own)
            found = context.getCheckpointDir()
    return found.rstrip("/")


#: Paths that staged has written for this driver.
_stages: list[str] = []


def begun() -> int:
    """How many tables are staged by now: what `sweep` takes as `since`."""
    return len(_stages)


def sweep(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the staged tables of this driver from the `since`-th on, but the last `keep`; results that still read them are lost."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _stages[since : len(_stages) - keep]
    del _stages[since : len(_stages) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """Write df to a Parquet table in the shared folder and read it back: lineage ends here.

    A lost executor then costs a reread, never a recomputation, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    _stages.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Words ---------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _pow(base: np.uint64, n: int, name: str) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            known = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))
        if size <= 4 * BLOCK_BYTES:  # a very long text does not leave its tables behind
            _powers[name] = known
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most `most` bytes together (or one row)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a block of texts, A-Z lower-cased, each with a 64-bit hash.

    `breaks` marks other bytes that end words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE):
        offsets = offsets - offsets[0]
        n = len(data)
        self.n_docs = len(offsets) - 1
        inside = ~breaks[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edges - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _pow(_P, n, "p")[:n], out=total[1:])
            h = (total[self.end] - total[self.start]) * _pow(_P_INV, n + 1, "i")[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64))
        #: Words first[d]:first[d + 1] belong to text d.
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))


def words_of(batch_text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """(first row, last row, bytes, offsets, words) of each block of a column of texts."""
    data, offsets = buffers(batch_text)
    for a, b in blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, part, at, Words(part, at)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d + 1]] for every d."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
