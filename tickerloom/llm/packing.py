"""Packing documents into training sequences along a Hilbert curve.

Words of a document are hashed into a vector of `BUCKETS` signed counts, the vector is projected to `DIMS` dimensions at random, and the cell it
falls into has a Hilbert key.  Documents are range-sorted by key and their tokens laid end to end, so that a sequence
holds neighbours on the curve; sequences are consecutive stretches of `SEQUENCE` tokens.  What remains at the very end becomes sequences of
powers of two, so nothing is padded.

Token ids are those that `tokenizers` gives with the public byte-level vocabulary, the names of its special tokens in a text included, then `END`; they come
from tiktoken with the same ranks, and a test compares both.

Edge cases: a null or empty text is the one token END; a very long text spans many sequences; repeated rows and null doc_ids are packed
like any other, each row with places of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import mix, read, staged, words_of
from tickerloom.llm.curve import hilbert, laid_out
from tickerloom.llm.secrets import VOCABULARY, encoding

SEQUENCE = 2048
END = 1
#: Special tokens of the vocabulary.
SPECIAL = (("<|endoftext|>", 50256),)
BUCKETS, DIMS, BITS = 256, 6, 8
_PROJECT = np.random.default_rng(6).normal(size=(BUCKETS, DIMS))


def curve_keys(column: pa.Array) -> np.ndarray:
    """Hilbert key of each text's projected word vector; texts without words lie at the centre."""
    out = np.zeros(len(column), np.int64)
    for a, b, _, _, words in words_of(column):
        h = mix(words.hash)
        bucket = words.doc * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        sign = ((h >> np.uint64(20)) & np.uint64(1)).astype(float) * 2 - 1
        x = np.bincount(bucket, sign, (b - a) * BUCKETS).astype(float).reshape(b - a, BUCKETS)
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
        cells = ((np.tanh(x @ _PROJECT / 2) + 1) / 2 * (1 << BITS)).astype(np.int64)
        out[a:b] = hilbert(np.minimum(cells, (1 << BITS) - 1), BITS)
    return out


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """row (a number of its own), doc_id, key, n, ids (unsigned 16-bit, little-endian; END included) of every document."""

    def rows(batches):
        encode = encoding(vocabulary, SPECIAL).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [np.array([*encode(t or "", allowed_special="all"), END], "<u2") for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(curve_keys(part.column(2))), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())],
                    ["row", "doc_id", "key", "n", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return given.mapInArrow(rows, f"row long, doc_id {kind}, key long, n long, ids binary")


def tail_starts(total: int) -> np.ndarray:
    """Where the sequences after the last whole one begin, and the end."""
    starts, at = [total - total % SEQUENCE], total - total % SEQUENCE
    for bit in range(SEQUENCE.bit_length() - 2, -1, -1):
        if total % SEQUENCE >> bit & 1:
            at += 1 << bit
            starts.append(at)
    return np.array(starts, np.int64)


def pieces(begin: int, n: int, tail: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of a document laid at `begin`."""
    out, at, end = [], begin, begin + n
    whole = int(tail[0])
    while at < end:
        if at < whole:
            sequence = at // SEQUENCE
            first, last = sequence * SEQUENCE, (sequence + 1) * SEQUENCE
        else:
            k = int(np.searchsorted(tail, at, "right")) - 1
            sequence, first, last = whole // SEQUENCE + k, int(tail[k]), int(tail[k + 1])
        stop = min(end, last)
        out.append((at - begin, stop - at, sequence, at - first))
        at = stop
    return out


def pack(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    tokens = staged(tokenized(docs, vocabulary))
    total = tokens.agg(F.sum("n")).first()[0] or 0
    places = laid_out(tokens.select("key", "row", "n"), ["key", "row"], F.col("n"), "begin").select(F.col("row").alias("_row"), "begin")
    placed = tokens.join(places, tokens["row"] == places["_row"]).select("doc_id", "begin", "n", "ids")
    tail = tail_starts(int(total))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches):
        for batch in batches:
            which, rows = [], []
            begins, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k, (begin, n) in enumerate(zip(begins, counts, strict=True)):
                ids = np.frombuffer(batch.column(3)[k].as_buffer(), "<u2").astype("<u4")
                for start, length, sequence, offset in pieces(begin, n, tail):
                    which.append(k)
                    rows.append((start, length, zlib.crc32(ids[start : start + length]), n, sequence, offset))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
