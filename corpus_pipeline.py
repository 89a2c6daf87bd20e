"""From raw documents to packed training sequences, one operator a stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs.  All but the
last return the columns of documents, which may have any name and type.  Null and empty texts pass through as each operator defines; an empty table stays
empty.  Rows are told apart by themselves, never by doc_id: two texts with one id are two documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import mixing, neardup, packing, quality, secrets
from tickerloom.llm.common import begun, read, staged, sweep


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from docs and the labels of the training rows."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked on five-word shingles at a similarity of 0.8."""
    return neardup.deduplicate(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A classifier fitted by gradient steps and byte-pair tokens are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage leaves in the shared folder besides its result goes with the next one; the rest, once `common.sweep` is called."""
    docs, since = read(spark, sf_dir, "documents"), begun()
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        sweep(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
