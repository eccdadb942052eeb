"""Fuzzy line deduplication by MinHash over character shingles.

A line, without white space at its ends, is the set of its distinct shingles of
``SHINGLE`` code points (a shorter line: the whole line).  Equal lines are one class.
Signatures are one-permutation MinHash: every shingle is hashed once and falls into one
of BANDS * ROWS bins, empty bins borrow from others.  Lines that agree in a band meet in
a bucket (9 bands of 3: a pair at similarity 0.8 is missed with a probability of
0.0016, at 0.85 of 2e-4).  The keys are dealt out packed, a row for each part of a block
of lines.  A part's buckets are read off its sorted keys: small ones give their
pairs, large ones are compared with their first member and passed on to
:func:`linking.close_large`.  Bucket keys that hold more than 1 / HOT of a sample of
the lines (at most HOT for each band) are dealt out over many tasks.  Every pair is
verified by exact Jaccard similarity of the full sets, at least 0.8.  Components come
from the distributed union-find in :mod:`components`; of each one the line of the smallest
(id, line number) stays.

Defined cases: a null text has no lines, an empty one a single blank line; blank lines always stay and are linked
with nothing; null ids sort last; rows with equal ids are told apart by their lines only
(equal places of equal lines stay or go together); very long lines are shingled whole;
an empty table gives an empty result; extra columns are ignored by :func:`line_groups`
and carried by :func:`deduplicate`.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import linking
from firmscope.llm.common import SPACES, discard, fresh, partitions, stored, workers

SHINGLE, BANDS, ROWS = 8, 9, 3
BITMAP = 1 << 26  # bits of the bitmap of lines whose text is wanted: 8 MB
HOT, SAMPLE = 1000, 50  # share that makes a key hot; one of so many documents is sampled for it
PIECE = 1 << 16  # code points that are hashed at a time
BLOCK = 1 << 20  # keys that are dealt out together
GROWTH = 4  # parts for the keys, for each common.PARTITION_BYTES of input
FACTOR = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint32(0xFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _shingle_hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of the windows of SHINGLE code points: the window is doubled step by step."""
    h, factor, width = points.astype(np.uint64), FACTOR, 1
    h += np.uint64(1)
    while width < SHINGLE:
        left = h[:-width] * factor
        left += h[width:]
        h = left
        factor, width = factor * factor, 2 * width
    return _mixed(h)


def shingles(line: str) -> np.ndarray:
    """Sorted distinct fingerprints of a stripped line."""
    return next(sets_of([line.encode()]))


def sets_of(raws: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct fingerprints of each stripped line, hashed a piece of the lines at a time."""
    lines = [raw.decode() for raw in raws]
    lengths = np.array([len(x) for x in lines], np.int64)
    for i, j in _pieces(lengths):
        points = np.frombuffer("".join(lines[i:j]).encode("utf-32-le"), np.uint32)
        with np.errstate(over="ignore"):
            h = _shingle_hashes(points) if len(points) >= SHINGLE else np.empty(0, np.uint64)
        start = 0
        for raw, n in zip(raws[i:j], lengths[i:j].tolist()):
            if n < SHINGLE:
                yield np.array([xxhash.xxh3_64_intdigest(raw)], np.uint64)
            else:
                own = h[start : start + n - SHINGLE + 1]
                own.sort()
                first = own[1:] != own[:-1]
                yield own if first.all() else np.concatenate([own[:1], own[1:][first]])
            start += n


def _pieces(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of lines of about PIECE code points: their arrays stay in the processor's cache."""
    piece = (np.cumsum(lengths) - lengths) // PIECE
    at = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(lengths)] if len(lengths) else []
    return list(zip(at, at[1:]))


def node_of(line: str) -> int:
    """The class of a stripped line: what Spark's ``xxhash64`` gives for it."""
    return _node(line.encode())


def _node(raw: bytes) -> int:
    h = xxhash.xxh64_intdigest(raw, 42)
    return h - 2**64 if h >= 2**63 else h


def band_keys(lines: list[str]) -> np.ndarray:
    """BANDS keys for each line; the lines have at least SHINGLE code points."""
    lengths = np.array([len(x) for x in lines])
    with np.errstate(over="ignore"):
        signature = np.concatenate([_signature(lines[i:j], lengths[i:j]) for i, j in _pieces(lengths)])
        signature = _filled(signature).astype(np.uint64).reshape(len(lines), BANDS, ROWS)
        keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(lines), BANDS)) * FACTOR
        for k in range(ROWS):
            keys = _mixed(keys ^ signature[:, :, k]) + FACTOR
    return keys.view(np.int64)


def _signature(lines: list[str], lengths: np.ndarray) -> np.ndarray:
    """The least hash in every bin of each line, EMPTY without one."""
    bins = BANDS * ROWS
    h = _shingle_hashes(np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32))
    across = (np.cumsum(lengths)[:-1, None] - np.arange(1, SHINGLE)).reshape(-1)  # windows that reach into the next line
    h[across] = EMPTY
    slot = h >> np.uint64(32)
    slot *= np.uint64(bins)
    slot >>= np.uint64(32)
    slot = slot.view(np.int64)
    slot += np.repeat(np.arange(len(lines)) * bins, lengths)[: len(h)]
    signature = np.full(len(lines) * bins, EMPTY)
    np.minimum.at(signature, slot, h.astype(np.uint32))
    return signature.reshape(len(lines), bins)


@functools.cache
def _borrowing(bins: int) -> np.ndarray:
    return np.stack([np.random.default_rng(1_000 + b).permutation(bins) for b in range(bins)])


def _filled(signature: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first filled bin of a fixed random sequence of their own."""
    bins = signature.shape[1]
    filled = signature != EMPTY
    rows = np.flatnonzero(~filled.all(axis=1))
    if not len(rows):
        return signature
    order = _borrowing(bins)
    for at in range(0, len(rows), 2_000):
        some = rows[at : at + 2_000]
        for b in range(bins):
            empty = some[~filled[some, b]]
            if len(empty):
                choice = order[b]
                first = np.argmax(filled[np.ix_(empty, choice)], axis=1)
                signature[empty, b] = signature[empty, choice[first]]
    return signature


def _lines(text: str | None) -> list[str]:
    return [] if text is None else [x.strip(SPACES) for x in text.split("\n")]


Batches = Iterator[pa.RecordBatch]


def _line_keys(batches: Batches) -> Batches:
    """(key, node) for the keys of every line of some texts that can have a partner; repeats within a batch are left out."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        at = 0
        while at < len(texts):  # about a million characters at a time
            lines: dict[str, None] = {}
            chars = 0
            while at < len(texts) and chars < 1_000_000:
                lines.update(dict.fromkeys(x for x in _lines(texts[at]) if len(x) >= SHINGLE))
                chars += len(texts[at] or "")
                at += 1
            if lines:
                found = list(lines)
                keys = band_keys(found)
                nodes = np.repeat(np.array([node_of(x) for x in found], np.int64), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes)], names=["key", "node"])


def _places(docs: DataFrame) -> DataFrame:
    """(id, line_no, node, check) of every line, with two hashes of it; both are null for blank lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [_lines(t) for t in batch.column(1).to_pylist()]
            counts = [len(some) for some in lines]
            at = {x: k for k, x in enumerate(dict.fromkeys(x for some in lines for x in some if x))}
            raws = [x.encode() for x in at]
            number = pa.array([at.get(x) for some in lines for x in some], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(lines)), counts), pa.int64())),
                    pa.array([k for n in counts for k in range(n)], pa.int32()),
                    pa.array([_node(raw) for raw in raws], pa.int64()).take(number),
                    pa.array([_check(raw) for raw in raws], pa.int32()).take(number),
                ],
                names=["id", "line_no", "node", "check"],
            )

    types = T.StructType().add("id", docs.schema["id"].dataType).add("line_no", "integer").add("node", "long").add("check", "integer")
    return docs.select("id", "text").mapInArrow(run, types)


def _check(raw: bytes) -> int:
    """A second hash, which tells lines of one class number apart."""
    return xxhash.xxh3_64_intdigest(raw) >> 33


def _pairs(rows: DataFrame, hot: list[int], keyed: Callable[[Batches], Batches] | None = None) -> DataFrame:
    """Pairs (key null, a, b) of the small buckets and with the first member of the large ones, and the members
    (key, a = node, b null) of the large buckets.  ``rows`` are key and node, or what ``keyed`` turns into these."""
    n = partitions(rows, GROWTH)
    hot_keys = np.array(sorted(hot), np.int64)

    def parts(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The part of each row: that of its key, or one of 64 of a hot key."""
        place = keys.view(np.uint64)
        if len(hot_keys):
            at = np.flatnonzero(np.isin(keys, hot_keys))
            place = place.copy()
            with np.errstate(over="ignore"):
                place[at] = _mixed(place[at] + _mixed(nodes[at].view(np.uint64)) % np.uint64(64) * FACTOR)
        return place % np.uint64(n)

    def packed(blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, nodes = (np.concatenate([block.column(k).to_numpy() for block in blocks]) for k in (0, 1))
        part = parts(keys, nodes).astype(np.uint16 if n <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        part, keys, nodes = part[order], keys[order], nodes[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(part)]))
        values = [pa.array([column[i:j].tobytes() for i, j in cuts], pa.binary()) for column in (keys, nodes)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), *values], names=["part", "keys", "nodes"])

    def deal(batches: Batches) -> Batches:
        held, count = [], 0
        for batch in keyed(batches) if keyed else batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= BLOCK:
                yield packed(held)
                held, count = [], 0
        if held:
            yield packed(held)

    def out(key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (key, a, b)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "a", "b"])

    def run(batches: Batches) -> Batches:
        held = [(k, v) for batch in batches for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        keys, nodes = (np.frombuffer(b"".join(column), np.int64) for column in (zip(*held) if held else ((), ())))
        del held
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        # Most keys come once: only the others, and the pieces of hot ones, need a look.
        again = np.isin(keys, hot_keys)
        again[1:] |= keys[1:] == keys[:-1]
        again[:-1] |= keys[1:] == keys[:-1]
        keys, nodes = keys[again], nodes[again]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        first = np.ones(len(keys), bool)  # copies of a line lie anywhere in its bucket
        first[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[first], nodes[first]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(keys)))
        large = (sizes > linking.SMALL) | np.isin(keys[starts], hot_keys)
        for size in range(2, linking.SMALL + 1):
            at = starts[~large & (sizes == size)]
            if len(at):
                i, j = np.array(list(itertools.combinations(range(size), 2))).T
                yield out(None, nodes[at[:, None] + i].reshape(-1), nodes[at[:, None] + j].reshape(-1))
        member = np.repeat(large, sizes)
        if member.any():
            yield out(keys[member], nodes[member], None)
            rest = member & ~first
            yield out(None, nodes[rest], np.repeat(nodes[starts], sizes)[rest])

    dealt = rows.mapInArrow(deal, "part int, keys binary, nodes binary").repartitionById(n, "part")
    return dealt.select("keys", "nodes").mapInArrow(run, "key long, a long, b long")


def line_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: doc_id, line_no (from 0), component (null for blank lines), kept."""
    workers(df.sparkSession)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)  # for the choice of hot keys only
    sampled = sample.select("text").mapInArrow(_line_keys, "key long, node long")
    counted = stored(sampled.groupBy("key").agg(F.countDistinct("node").alias("n")), "line-sample")
    hot = [r.key for r in _hot_keys(counted)]
    discard(counted)
    found = stored(_pairs(docs.select("text"), hot, _line_keys), "line-pairs")
    members = found.filter("b IS NULL").select("key", F.col("a").alias("node"))  # each once: its copies meet in one part
    pairs = found.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "line-pairs")

    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct(), "line-wanted")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bits.value
        for batch in batches:
            lines = list(dict.fromkeys(x for t in batch.column(0).to_pylist() for x in _lines(t) if len(x) >= SHINGLE))
            nodes = np.array([node_of(x) for x in lines], np.int64)
            place = nodes & (BITMAP - 1)
            maybe = np.flatnonzero(marks[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            some = [lines[i] for i in maybe.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes[maybe], pa.int64()),
                    pa.array([x.encode() for x in some], pa.binary()),
                ],
                names=["node", "values"],
            )

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(x) for x in sets_of(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["node", "values", "n"])

    lines = docs.select("text").mapInArrow(texts_of, "node long, values binary").join(wanted, "node", "left_semi")
    sets = stored(lines.dropDuplicates(["node"]).mapInArrow(sized, "node long, values binary, n long"), "line-sets")
    sizes = sets.select("node", "n")

    def plausible(some: DataFrame) -> DataFrame:
        sides = [sizes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}")) for s in "ab"]
        return some.join(sides[0], "a").join(sides[1], "b").filter(linking.reachable("na", "nb")).select("a", "b")

    links = stored(linking.confirmed(plausible(pairs), sets, sets_of), "line-links")
    labels = linking.forest(links)
    labels = linking.close_large(members, labels, sizes, sets, sets_of)
    discard(found, pairs, wanted, sets, links)

    every = stored(_places(docs), "line-places")
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "line_no")
    # Only lines that occur again or are linked need a look.  Lines of one number whose second hash differs
    # are different lines: those of other hashes than the first stay.
    classes = every.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("check").alias("first_check"), F.min(F.struct("check", place.alias("place"))).alias("least"), F.count(F.lit(1)).alias("n")
    )
    # The smallest node of a component has no label of its own.
    heads = labels.select(F.col("label").alias("node"), "label").distinct()
    classes = classes.select("node", "first_check", F.col("least.place").alias("place"), "n").join(labels.union(heads), "node", "left")
    classes = classes.filter("n > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "node")).drop("n")
    classes = stored(classes, "line-classes")
    least = classes.groupBy("label").agg(F.min("place").alias("keep"))
    kept = stored(classes.join(least, "label").select("node", "first_check", "label", "keep"), "line-classes")
    discard(classes)
    same = F.col("check") == F.col("first_check")
    return every.join(kept, "node", "left").select(
        F.col("id").alias("doc_id"),
        "line_no",
        F.when(same, F.col("label")).otherwise(F.col("node")).alias("component"),
        (F.col("first_check").isNull() | ~same | (place == F.col("keep"))).alias("kept"),
    )


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP bits, whatever the number of nodes: a set bit for the last bits of each node."""
    place = F.col("node").bitwiseAND(F.lit(BITMAP - 1)) + 1
    parts = nodes.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(BITMAP // 8, np.uint8)
    for row in parts.toLocalIterator():
        part = np.frombuffer(row.bits, np.uint8)
        out[(row.k - 1) * len(part) : row.k * len(part)] = part
    return out


def _hot_keys(counted: DataFrame):
    """Keys that hold more than 1 / HOT of the sampled lines: at most HOT for each band."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    if total < BANDS * HOT * 10:  # too few lines for any key to be hot
        return []
    return counted.filter(F.col("n") > total / BANDS / HOT).select("key").collect()


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the lines that stay, in order; all columns are carried.  Ids must tell the rows apart."""
    groups = line_groups(df, id_col, text_col)
    ident, numbers = fresh(df, "line_id"), fresh(df, "lines_kept")
    kept = groups.filter("kept").groupBy(F.col("doc_id").alias(ident)).agg(F.collect_list("line_no").alias(numbers))
    joined = df.join(kept, df[id_col].eqNullSafe(kept[ident]), "left")
    lines = F.split(df[text_col], "\n")
    chosen = F.transform(F.sort_array(F.col(numbers)), lambda k: F.element_at(lines, k + 1))
    text = F.when(df[text_col].isNotNull(), F.coalesce(F.concat_ws("\n", chosen), F.lit("")))
    return joined.select(*[text.alias(c) if c == text_col else df[c] for c in df.columns])
