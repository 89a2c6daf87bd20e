"""Near duplicates by min-max hashing: both the least and the greatest value under each permutation enter the signature.

A text's set holds its distinct shingles of `words` words (all words as one shingle if there are fewer); sets are linked where
100 * intersection >= percent * union, and a component is what links connect.  Signatures of 2 * `PERMUTATIONS` values from `PERMUTATIONS` hash
evaluations a shingle are banded; texts that share a band are candidates and every link is confirmed on the full sets.

No group is ever paired with itself in whole.  Equal sets count once (a class).  In a band's group every class is compared with the group's
most popular class, the one whose other bands meet most company; that joins most of a large group of near copies at one comparison each.
The classes of a group that this leaves outside its largest component are then held against the group's other classes, in blocks
of `BLOCK`, on their full sets; a block gives out one link for each component that a class reaches, so no link between components is lost and no list
of pairs is made.

The values are banded so that sets linked at just the threshold J share no band with a chance of at most `MISS`: (1 - J**rows)**bands, 8 in 100,000
for 20 bands of 6 at 0.85, 7 in 100,000 for 24 bands of 5 at 0.8, and less above the threshold.

Edge cases: null, empty and blank texts have an empty set, are linked with nothing and are kept; a null doc_id takes no part, its component is
null and it is kept; repeated rows are exact copies of one another and stay rows in `components`; ties go to the smallest doc_id;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import free_name, mix, read, staged, words_of

PERMUTATIONS = 60
MISS = 1e-4
#: Classes of a group, and of those outside its largest component, that are held against one another in one block.
BLOCK = 512

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_STEPS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, words: int):
    """(first row, last row, sorted distinct shingle hashes, their places) of each block of texts."""
    for a, b, _, _, found in words_of(column):
        n = np.diff(found.first)
        count = np.where(n >= words, n - words + 1, (n > 0).astype(int))
        first = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(b - a), count)
        start = found.first[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
        width = np.minimum(n[doc], words)
        with np.errstate(over="ignore"):
            h = np.zeros(len(start), np.uint64)
            for k in range(words):
                inside = k < width
                at = start + k if inside.all() else np.where(inside, start + k, 0)
                term = mix(found.hash[at] * _STEPS[k]) if len(at) else h
                h = mix(h + (term if inside.all() else np.where(inside, term, np.uint64(0))))
            h = h + width.astype(np.uint64)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield a, b, h, np.searchsorted(doc, np.arange(b - a + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, one row a non-empty set."""
    out = np.empty((len(first) - 1, 2 * PERMUTATIONS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PERMUTATIONS):
            v = h * _MULTIPLY[k] + _ADD[k]
            v ^= v >> np.uint64(32)
            out[:, 2 * k] = np.minimum.reduceat(v, first[:-1])
            out[:, 2 * k + 1] = np.maximum.reduceat(v, first[:-1])
    return out


def class_names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for each set, equal for equal sets (zero for empty ones)."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), 2), np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            out[full, 0] = mix(np.add.reduceat(mix(h), first[:-1][full]) + n[full].astype(np.uint64))
            out[full, 1] = mix(np.add.reduceat(mix(h * _STEPS[9] + _STEPS[10]), first[:-1][full]) + n[full].astype(np.uint64))
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, values a band): as many values a band as MISS allows at the threshold."""
    for rows in range(2 * PERMUTATIONS, 1, -1):
        bands = 2 * PERMUTATIONS // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS:
            return bands, rows
    return 2 * PERMUTATIONS, 1


def signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, class binary (16 bytes that stand for the set), bands array<long> of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_bands, width = banding(percent)

    def rows(batches):
        for batch in batches:
            for a, b, h, first in shingle_sets(batch.column(1), words):
                n = np.diff(first)
                full = np.flatnonzero(n)
                classes = class_names(h, first)
                bands = np.zeros((b - a, n_bands), np.uint64)
                if len(full):
                    values = signatures(h, np.append(first[:-1][full], first[-1]))[:, : n_bands * width].reshape(len(full), n_bands, width)
                    with np.errstate(over="ignore"):
                        key = np.zeros((len(full), n_bands), np.uint64) + np.arange(n_bands, dtype=np.uint64)
                        for r in range(width):
                            # Neighbouring values are the least and the greatest of one permutation.
                            key = mix(key * _STEPS[20 + r % 40] + values[:, :, r])
                    bands[full] = key
                bands = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), n_bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array([c.tobytes() for c in classes], pa.binary()), bands],
                    ["doc_id", "n", "class", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n long, class binary, bands array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """class, shingles (sorted 64-bit hashes, packed) of the texts of docs."""

    def sets(batches):
        for batch in batches:
            for _, _, h, first in shingle_sets(batch.column(0), words):
                raw = h.tobytes()
                packed = [raw[8 * s : 8 * e] for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                names = [c.tobytes() for c in class_names(h, first)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(packed, pa.binary())], ["class", "shingles"])

    return docs.select("text").mapInArrow(sets, "class binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are linked."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(check, "a binary, b binary")


def block_links(asked: list[tuple], members: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between classes of different components, one for each asked class and component it reaches.

    Rows are (class, component, shingles); an asked class marks its shingles and all members count theirs among them at once.
    """
    sets = [np.frombuffer(m[2], np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    names = {c: k for k, c in enumerate(dict.fromkeys(m[1] for m in members))}
    component = np.array([names[m[1]] for m in members])
    out = []
    for name, own, packed in asked:
        x = np.frombuffer(packed, np.uint64)
        mark = np.zeros(len(known), np.int64)
        at = np.searchsorted(known, x)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == x[hit]
        mark[at[hit]] = 1
        common = np.add.reduceat(mark[flat], first)
        linked = (100 * common >= percent * (len(x) + sizes - common)) & (component != names.get(own, -1))
        _, places = np.unique(component[linked], return_index=True)
        out += [(name, members[k][0]) for k in np.flatnonzero(linked)[places]]
    return out


def rest_links(groups: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a band's group: classes outside the group's largest component against all its others."""
    now = groups.select("key", "class").join(labels, "class")
    sizes = now.groupBy("key", "component").agg(F.count("*").alias("size"))
    parts = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("size").alias("whole"), F.max(F.struct("size", "component")).alias("largest"))
    # Written, so that the join deals both sides anew and a hot key's rows can be split.
    parts = parts.filter("parts > 1").select("key", "whole", (F.col("whole") - F.col("largest.size")).alias("outside"), F.col("largest.component").alias("largest"))
    now, parts = groups.select("key", "class").join(labels, "class"), staged(parts)
    mixed = now.join(parts, "key").withColumn("blocks", F.ceil(F.col("whole") / BLOCK)).withColumn("chunks", F.ceil(F.col("outside") / BLOCK))
    mixed = staged(mixed.select("key", "class", "component", (F.col("component") != F.col("largest")).alias("asked"), "blocks", "chunks"))
    block, chunk = F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")), F.pmod(F.xxhash64("class", F.lit(2)), F.col("chunks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    members = mixed.select("key", "class", "component", F.lit(1).alias("side"), block.alias("block"), F.explode(every).alias("chunk"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    asked = mixed.filter("asked").select("key", "class", "component", F.lit(0).alias("side"), F.explode(every).alias("block"), chunk.alias("chunk"))
    rows = members.unionByName(asked).join(sets, "class")
    rows = rows.select("key", "block", "chunk", "side", "class", "component", "shingles")
    rows = rows.repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk", "side", "class")

    def compare(batches):
        at, two = None, ([], [])

        def done():
            found = block_links(*two, percent) if two[0] and two[1] else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

        for batch in batches:
            # A few rows at once, as sets can be long.
            for step in range(0, batch.num_rows, 512):
                columns = [c.to_pylist() for c in batch.slice(step, 512).columns]
                for row in zip(*columns, strict=True):
                    if at != row[:3]:
                        if at is not None:
                            yield done()
                        at, two = row[:3], ([], [])
                    two[row[3]].append(row[4:])
        if at is not None:
            yield done()

    return rows.mapInArrow(compare, "a binary, b binary").distinct()


def connect(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (class, component) with the components that edges (a, b) join: each takes the least class in it.

    Rounds of least neighbour and pointer jumping over component ids; every round ends in a table of the shared folder.
    """
    ids = labels.select("class", "component")
    of = labels.select(F.col("class"), "component")
    links = edges.join(of.withColumnsRenamed({"class": "a", "component": "ca"}), "a").join(of.withColumnsRenamed({"class": "b", "component": "cb"}), "b")
    links = staged(links.filter("ca != cb").select(F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")).distinct())
    moved: DataFrame | None = None
    while True:
        if links.isEmpty():
            break
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        least = staged(least)
        while True:  # pointer jumping: every node points at the root of its tree
            up = least.select(F.col("node").alias("to"), F.col("to").alias("above"))
            jumped = staged(least.join(up, "to", "left").select("node", F.coalesce("above", "to").alias("to"), (F.col("above") != F.col("to")).alias("changed")))
            done = jumped.filter("changed").isEmpty()
            least = jumped.select("node", "to")
            if done:
                break
        if moved is None:
            moved = least
        else:
            known = moved.join(least.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
            fresh = least.join(moved.select("node"), "node", "left_anti")
            moved = staged(known.unionByName(fresh))
        to_u, to_v = (least.select(F.col("node").alias(x), F.col("to").alias(f"c{x}")) for x in "uv")
        links = links.join(to_u, "u").join(to_v, "v")
        links = staged(links.filter("cu != cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
    if moved is None:
        return ids
    moved = moved.withColumnsRenamed({"node": "component", "to": "next"})
    return staged(ids.join(moved, "component", "left").select("class", F.coalesce("next", "component").alias("component")))


def classes_of(docs: DataFrame, words: int = 3, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, class) of every document, and (class, component) of every class linked with another."""
    sign = staged(signed(docs, words, percent))
    full = sign.filter("n > 0 and doc_id is not null")
    # One document stands for its class.
    chosen = full.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    reps = full.join(chosen, ["class", "doc_id"]).dropDuplicates(["class"])
    keys = reps.select("class", "n", F.explode("bands").alias("key"))
    crowd = staged(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    # Only groups of two and more go on; a class's popularity is the company that all its bands have.
    keys = staged(keys.join(crowd, "key"))
    popular = keys.groupBy("class").agg(F.sum("size").alias("popularity"))
    groups = staged(keys.join(popular, "class").select("key", "class", "n", "popularity"))
    labels = staged(popular.select("class", F.col("class").alias("component")))
    # A doc_id may come with several texts: sets are told apart by the class they make.
    wanted = reps.select("class", "doc_id").join(popular.select("class"), "class", "left_semi")
    sets = sets_of(docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), words)
    sets = staged(sets.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"]))

    lead = groups.groupBy("key").agg(F.max(F.struct("popularity", "n", "class")).alias("best"))
    # Written, so that the join deals both sides anew and a hot key's rows can be split.
    lead = staged(lead.select("key", F.col("best.class").alias("leader"), F.col("best.n").alias("ln")))
    close = F.least("n", "ln") * 100 >= F.greatest("n", "ln") * percent
    pairs = groups.join(lead, "key").filter(close & (F.col("class") != F.col("leader")))
    pairs = staged(pairs.select(F.col("class").alias("a"), F.col("leader").alias("b")).distinct())
    labels = connect(labels, confirmed(pairs, sets, percent))
    labels = connect(labels, rest_links(groups, labels, sets, percent))
    return sign.select("doc_id", "n", "class"), labels


def components(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    sign, labels = classes_of(docs, words, percent)
    classes = sign.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels, "class", "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    # Both written, so that the join deals them anew and a large component's rows can be split.
    classes = staged(classes)
    whole = staged(classes.groupBy("component").agg(F.min("least").alias("component_id")))
    classes = staged(classes.join(whole, "component").select("class", "component_id"))
    out = sign.filter("n > 0 and doc_id is not null").join(classes, "class").select("doc_id", "n", "component_id")
    alone = sign.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    rows = out.unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: a row of its least doc_id, of several the least by (hash of text, number in the input).

    Rows are told apart by a number of their own, never by doc_id: two texts with one id are two texts.  Rows without words are linked with nothing
    and all stay; rows with a null doc_id are linked like any other and come last.  Columns may have any name and type.
    """
    number = free_name(docs, "row")
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()))
    given = rows.select(F.col(number).alias("doc_id"), "text")
    sign, labels = classes_of(given, words, percent)
    found = sign.filter("n > 0").select(F.col("doc_id").alias("_n"), "class")
    ids = rows.select(F.col(number).alias("_n"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    # A class's best row first, then a component's: both aggregate ahead of the shuffle, so no group is ever gathered.
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_text").alias("text"), F.col("_n").alias("n"))
    best = found.join(ids, "_n").groupBy("class").agg(F.min(order).alias("best"))
    best = best.join(labels, "class", "left").groupBy(F.coalesce("component", "class").alias("component")).agg(F.min("best").alias("best"))
    # Written, so that its size is known: where few rows go, their numbers are sent everywhere and no text moves.
    gone = free_name(docs, "gone")
    leave = staged(found.join(best.select(F.col("best.n").alias("_n")), "_n", "left_anti").select(F.col("_n").alias(gone)))
    return rows.join(leave, F.col(number) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"))


#: Every pair that shares a shingle, compared, and what is reachable.
SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM split
), single AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM single a JOIN single b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)
), both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON r.other = b.x
), least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l USING (doc_id)
"""
