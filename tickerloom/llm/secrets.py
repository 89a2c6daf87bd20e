"""Secret scans: fixed patterns, and strings that a tokenizer's vocabulary spells out at few characters a token.

Base kinds, leftmost non-overlapping each: `assign` (a key name, a separator and a value of 6 or more characters), `access`
(AKIA and 16 or more capitals or digits) and `hex` (24 or more lower-case hex digits).  The method adds kind `dense`:
a run of 20 or more of `[A-Za-z0-9+/_=-]` that mixes digits with letters and that a tiktoken encoding needs so many tokens for
that the characters a token stay below `MAX_RATIO`; prose stays above, random strings fall below.  Known digests
(hex of the usual digest lengths), UUIDs and runs already inside a base span are left out.

Edge cases: a null or empty text has no span (empty `spans`, the hash of the empty text); spans are code points, end exclusive, of the whole
text, however long; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import read

#: Fixed patterns and lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "dense")

DENSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
MAX_RATIO = 2.2
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")

VOCABULARY = "byte_bpe_50k.tiktoken"
MASK = "[secret]"


@lru_cache(maxsize=4)
def encoding(name: str = VOCABULARY, special: tuple[tuple[str, int], ...] = ()):
    """The tiktoken encoding of a public vocabulary file, with the given special tokens, loaded once a worker."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def is_identifier(run: str) -> bool:
    """Digests and identifiers that are known not to be secrets."""
    if len(run) in DIGEST_LENGTHS and ALL_HEX.fullmatch(run):
        return True
    return UUID.fullmatch(run) is not None


def is_dense(run: str, name: str = VOCABULARY) -> bool:
    if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run) or is_identifier(run):
        return False
    return len(run) < MAX_RATIO * len(encoding(name).encode_ordinary(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, by start and kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def all_spans(text: str, base: list[tuple[int, int, int]], name: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """The base spans and those the token-efficiency test adds."""
    found = list(base)
    # Runs come by start, and so do base spans: of those that start no later than a run, the farthest end tells whether one holds it.
    at, end = 0, -1
    for m in DENSE.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            end = max(end, base[at][2])
            at += 1
        if m.end() > end and is_dense(m[0], name):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with every union of overlapping spans replaced by MASK."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_dense of every document."""

    def rows(batches):
        for batch in batches:
            counts, hashes, spans = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                every = all_spans(text or "", base, vocabulary)
                for kind, count in enumerate(counts):
                    count.append(sum(s[1] == kind for s in every))
                hashes.append(hashlib.sha256(shown(base).encode()).hexdigest())
                spans.append(shown(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_dense"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_dense long"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def redact(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with every span replaced by MASK (and n_chars, where there, counted anew); all rows stay, null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else masked(t, all_spans(t, base_spans(t), vocabulary)))

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
