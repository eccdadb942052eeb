"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full sets.

A document's set holds its distinct word shingles (64-bit fingerprints).  Two
collections of ``SIDE`` half keys, each of ``ROWS`` minhashes, are computed; the key
of table (i, j) combines half key i of the first with half key j of the second, so
``SIDE * SIDE`` tables cost ``2 * SIDE * ROWS`` minhashes.  Half keys that only one
document has are dropped before they are combined, and buckets of equal members are
one.  Two documents share a table
exactly if they share a half key in each collection: with 10 and 2, a pair at
similarity 0.8 is missed with a probability of 7e-5, at 0.85 of 6e-6.

Documents of equal sets are one class from the start.  Work on a bucket never
emits all its pairs:

1. every member is compared with the smallest and the largest member (buckets of
   two: the one pair), and the confirmed links make a first set of components;
2. a bucket whose members lie in one component is done, and of the others only the
   members outside the main component go on;
3. larger open buckets (over ``linking.SMALL`` members) of one main component are one
   group: members that can't reach the threshold with any other (an upper bound from
   the number of shingles that no other member has) are set aside, and the rest are
   compared with the most central member;
4. what is left: a member outside the central member's component is compared with
   those members of other components that an upper bound, from what each has and
   lacks against the centre, allows.  Nothing is capped.

Candidates are dropped unconfirmed only if their sizes can't reach the threshold or
if fewer than ``AGREE`` of the 2 * SIDE half keys agree (at similarity 0.8, 13 agree on
average; fewer than 4 with a probability of 2e-6).

Defined cases: a null text counts as empty; documents without words have an empty
set and are linked with nothing; with fewer words than a shingle the whole sequence
is the one shingle; null ids sort last; rows with equal ids are separate documents of
one id; repeated rows are one class; very long texts are shingled whole; an empty
table gives an empty result; extra columns are ignored by :func:`near_groups` and
carried by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.llm import linking
from firmscope.llm.common import fresh, stored, workers

SIDE, ROWS, AGREE = 10, 2, 4


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct word shingles; A-Z count as a-z."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only [\x20\x09-\x0D] separate
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh3_64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined)], np.uint64)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    found = [digest(joined[a : b - 1]) for a, b in zip(starts, starts[words:])]
    return np.unique(np.array(found, np.uint64))


def half_keys(values: np.ndarray, seed: int) -> np.ndarray:
    """2 * SIDE half keys: minima of ROWS random hash orders each, folded to 64 bits."""
    rng = np.random.default_rng(seed)
    n = 2 * SIDE * ROWS
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, n, dtype=np.uint64)
    least = np.full(n, np.uint64(2**64 - 1))
    for at in range(0, len(values), 4096):
        block = values[at : at + 4096]
        mixed = a[:, None] * (block ^ (block >> np.uint64(29))) + b[:, None]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    least = least.reshape(-1, ROWS)
    key = least[:, 0]
    for k in range(1, ROWS):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + least[:, k]
    return key.view(np.int64)


def _sketch(df: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """id, set size, class number (node), a 128-bit check of the set, the half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, checks, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                raw = found.tobytes()
                sizes.append(len(found))
                nodes.append(np.uint64(xxhash.xxh3_64_intdigest(raw, seed)).view(np.int64))
                checks.append(xxhash.xxh3_128_digest(raw, seed + 1))
                keys.append(half_keys(found, seed) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(checks, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "n", "node", "check", "half"],
            )

    key_type = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col], df[text_col]).mapInArrow(
        run, f"id {key_type}, n long, node long, check binary, half array<long>"
    )


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) whose sizes and half keys allow the threshold."""
    sides = [classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("half").alias(f"h{s}")) for s in "ab"]
    agree = F.expr("size(filter(zip_with(ha, hb, (x, y) -> x = y), x -> x))")
    return (
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(sides[0], "a")
        .join(sides[1], "b")
        .filter(linking.reachable("na", "nb") & (agree >= AGREE))
        .select("a", "b")
    )


def _table_keys(classes: DataFrame) -> DataFrame:
    """node and key of the tables that a class may share with another.

    A table is shared only by classes that share both half keys, so half keys of one
    holder are dropped first: 20 short rows a class are counted, not 100.
    """
    half = classes.select("node", F.posexplode("half").alias("place", "value"))
    shared = half.groupBy("place", "value").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    kept = half.join(shared.select("place", "value"), ["place", "value"])
    sides = kept.groupBy("node").agg(F.collect_list(F.struct("place", "value")).alias("kept"))  # at most 2 * SIDE
    tables = F.expr(
        f"flatten(transform(filter(kept, x -> x.place < {SIDE}), x -> transform(filter(kept, y -> y.place >= {SIDE}),"
        " y -> xxhash64(x.place, x.value, y.place, y.value))))"
    )
    return sides.select("node", F.explode(tables).alias("key"))


def _links(df: DataFrame, sketch: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """Components (node, label) of the classes."""
    keys = stored(_table_keys(classes), "keys")
    every = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"),
        F.min("node").alias("lo"),
        F.max("node").alias("hi"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(seed))).alias("y"),
    )
    # Buckets of the same members (by number, ends and a 128-bit fingerprint) count once.
    buckets = stored(every.filter("c > 1").groupBy("c", "lo", "hi", "x", "y").agg(F.min("key").alias("key")).select("key", "c", "lo", "hi"), "buckets")
    members = stored(keys.join(buckets.filter("c > 2"), "key"), "members")
    first = buckets.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    for end in ("lo", "hi"):
        first = first.union(members.filter(f"node <> {end}").select(F.col("node").alias("a"), F.col(end).alias("b")))
    first = stored(_plausible(first, classes), "pairs")

    # The sets of the classes that share buckets, from the text of their first document.
    wanted = first.select(F.col("a").alias("node")).union(first.select("b")).union(members.select("node")).distinct()
    wanted = wanted.join(classes.select("node", "first"), "node").select(F.col("first").alias("wanted")).distinct()
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words).tobytes() for t in batch.column(0).to_pylist()]
            nodes = [np.uint64(xxhash.xxh3_64_intdigest(raw, seed)).view(np.int64) for raw in found]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "values"])

    sets = stored(texts.select("text").mapInArrow(to_sets, "node long, values binary").dropDuplicates(["node"]), "sets")

    links = stored(linking.confirmed(first, sets), "links")
    labels = linking.forest(links)

    # Small open buckets: the pairs across components that step 1 hasn't compared; one of a pair lies outside the main component.
    small = members.filter(f"c <= {linking.SMALL} and node <> lo and node <> hi").select("key", "node")
    left = linking.outsiders(small, labels).select("key", "node", "label")
    right = linking.labelled(small, labels).select("key", F.col("node").alias("node2"), F.col("label").alias("label2"))
    pairs = left.join(right, "key").filter("label <> label2").select(F.col("node").alias("a"), F.col("node2").alias("b"))
    new = linking.confirmed(_plausible(pairs, classes), sets)

    labels = linking.forest(stored(new, "links"), labels)
    large = members.filter(f"c > {linking.SMALL}").select("key", "node")
    return linking.close_large(large, labels, classes.select("node", "n"), sets)


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 1
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id linked with it, at
    similarity 0.8 or more and over any number of links), kept (doc_id = component_id)."""
    workers(df.sparkSession)
    while True:
        sketch = stored(_sketch(df, id_col, text_col, words, seed), "sketch")
        classes = (
            sketch.filter("n > 0")
            .groupBy("node")
            .agg(
                F.min("id").alias("first"),
                F.first("n").alias("n"),
                F.first("half").alias("half"),
                F.min("check").alias("check"),
                F.max("check").alias("check2"),
            )
        )
        classes = stored(classes, "classes")
        if classes.filter("check <> check2").isEmpty():
            break
        seed += 2  # two different sets got one number: number them anew
    classes = classes.select("node", "first", "n", "half")
    labels = stored(_links(df, sketch, classes, id_col, text_col, words, seed), "labels")
    labelled = linking.labelled(classes.select("node", "first"), labels)
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = labelled.join(least, "label").select("node", "component_id")
    filled = sketch.filter("n > 0").select("id", "n", "node").join(of_node, "node")
    empty = sketch.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return filled.select("id", "n", "component_id").union(empty).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row of each group of linked rows, with all its columns: the one of the smallest id (null ids last).

    Rows are told apart by a number of their own, so null and repeated ids are no
    exception; rows without words all stay.
    """
    row, ident = fresh(df, "row"), "id"
    rows = stored(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    place = F.struct(rows[id_col].isNull().alias("missing"), rows[id_col].alias("id"), rows[row].alias("row"))
    found = near_groups(rows.select(place.alias(ident), rows[text_col].alias("text")), ident, "text", words)
    dropped = found.filter("not kept").select(F.col("doc_id.row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*[rows[c] for c in df.columns])
