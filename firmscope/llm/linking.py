"""Links between classes of sets that share buckets of a locality-sensitive hash.

Sets are sorted arrays of 64-bit fingerprints, kept by class (``node``) as their bytes or
as bytes that ``decode`` turns into them, many at a time.  A
bucket's pairs are never all emitted: small buckets give their few pairs, in large ones
the members are compared with a central member first, and of members that stay in
different components only pairs that an upper bound allows are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.llm.common import discard, partitions, stored
from firmscope.llm.components import components

SMALL = 8
VALUES = 1 << 15  # fingerprints of sets that leave a task together
LEFT, RIGHT = 1 << 22, 1 << 26  # fingerprints of the sets that a task of a large group holds, and compares with these


def reachable(low: str, high: str) -> Column:
    """Whether two set sizes can reach the threshold."""
    return F.expr(f"5 * least({low}, {high}) >= 4 * greatest({low}, {high})")


Decode = Callable[[list[bytes]], Iterable[np.ndarray]]


def stored_sets(raws: list[bytes]) -> Iterator[np.ndarray]:
    """Sets that are kept as the bytes of their sorted fingerprints."""
    return (np.frombuffer(raw, np.uint64) for raw in raws)


def confirmed(pairs: DataFrame, sets: DataFrame, decode: Decode = stored_sets) -> DataFrame:
    """The pairs with 100 * intersection >= 80 * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            lefts, rights = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            raws = list(dict.fromkeys(lefts + rights))  # a node mostly has several pairs
            known = dict(zip(raws, decode(raws)))
            for left, right in zip(lefts, rights):
                x, y = known[left], known[right]
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= 80 * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = [sets.select(F.col("node").alias(s), F.col("values").alias(f"v{s}")) for s in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the component of their node (the node itself where it has no links)."""
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def outsiders(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, node, ...) that lie outside their bucket's main component, with ``main``.

    The main component of a bucket is the one of most members.  Buckets whose members
    lie in one component give nothing; of the others only these rows leave the join.
    """
    rows = labelled(members, labels)
    parts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    mains = parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return rows.join(mains.select("key", F.col("main.label").alias("main")), "key").filter("label <> main")


def forest(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Components (node, label) of the links; those of earlier links (``before``) stand for them."""
    edges = links.select("a", "b")
    if before is not None:
        edges = edges.union(before.select(F.col("node").alias("a"), F.col("label").alias("b")))
    return components(edges)


def close_large(
    members: DataFrame,
    labels: DataFrame,
    sizes: DataFrame,
    sets: DataFrame,
    decode: Decode = stored_sets,
) -> DataFrame:
    """Components after all links inside the large buckets; ``labels`` are those so far.

    ``members`` has key and node, ``sizes`` node and n (set size).  Buckets of one main
    component are one group from the start: it holds that component and, once each, the
    members of these buckets that lie outside, however many buckets they share.  Three
    steps, each exact:

    * A member that shares too few shingles with all others of these groups to reach
      the threshold with any of them is set aside: of its n shingles, ``own`` are its
      own, and a partner has at least the smallest size in the group and four fifths
      of n.
    * The rest are compared with the most central member of the group, the one with
      the smallest share of own shingles, and the confirmed links join components.
    * What is still in different components is compared through the differences from
      the centre (:func:`_linked_in_groups`), which give the full intersections.
    """
    outside = stored(outsiders(members, labels).select("main", "node").distinct(), "outside")
    if outside.isEmpty():
        return labels
    mains = outside.select(F.col("main").alias("label")).distinct()
    inside = labels.join(mains, "label").select(F.col("label").alias("main"), "node").union(mains.select("label", F.col("label").alias("node")))
    large = stored(labelled(outside.union(inside).join(sizes, "node").select("main", "node", "n"), labels), "large")

    def together(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        column = np.repeat(np.array(nodes, np.int64), [len(x) for x in sets])
        return pa.RecordBatch.from_arrays([pa.array(column), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "value"])

    def values_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, some, count = [], [], 0
            for node, values in zip(batch.column(0).to_pylist(), decode(batch.column(1).to_pylist())):
                nodes.append(node)
                some.append(values)
                count += len(values)
                if count >= VALUES:
                    yield together(nodes, some)
                    nodes, some, count = [], [], 0
            if some:
                yield together(nodes, some)

    # Most sets take no part: only those that do are dealt out again below.
    sets = stored(sets.select("node", "values").join(large.select("node").distinct(), "node", "left_semi"), "large-sets")
    own = (
        sets.mapInArrow(values_of, "node long, value long")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("node"))
        .filter("holders = 1")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("own"))
    )
    least = large.groupBy("main").agg(F.min("n").alias("least"))
    able = large.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))).join(least, "main")
    able = stored(able.filter("9 * (n - own) >= 4 * (n + greatest(least, (4 * n + 4) div 5))"), "able")
    centrality = F.struct((F.col("own") / F.col("n")).alias("x"), "node")
    centre = able.groupBy("main").agg(F.min(centrality).alias("centre"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    # Groups with one centre are one group from here on.
    groups = able.join(centre, "main").select(F.col("centre.node").alias("centre"), "node", "n").distinct()
    groups = stored(groups, "groups")

    links = groups.filter("node <> centre").join(groups.filter("node = centre").select("centre", F.col("n").alias("nc")), "centre")
    links = links.filter(reachable("n", "nc")).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    labels = forest(confirmed(links, sets, decode), labels)

    members = labelled(groups, labels)
    usual = members.filter("node = centre").select("centre", F.col("label").alias("usual"), F.col("n").alias("nc"))
    members = stored(members.join(usual, "centre"), "members")
    labels = forest(_linked_in_groups(members, sets, decode), labels)
    discard(outside, large, able, groups, members)
    return labels


def _linked_in_groups(members: DataFrame, sets: DataFrame, decode: Decode) -> DataFrame:
    """Pairs (a, b) that join all labels of a group's members which a link between two members joins.

    ``members`` has centre, node, n, label, usual (the centre's label) and nc (the centre's size).  Members of
    another label than the centre's are compared with all.  A group's pairs are dealt over cells, a
    block of these members by a part of all: a task holds one block's differences from the centre.
    Two members have in common the centre's elements, less those that either misses, and
    the differences that they share.  Of the links only those are given that join two labels of a cell.
    """
    total = F.ceil(F.sum(F.col("n") + F.col("nc")) / RIGHT)
    left = F.ceil(F.sum(F.when(F.col("label") != F.col("usual"), F.col("n") + F.col("nc"))) / LEFT)
    cells = members.groupBy("centre").agg(left.alias("blocks"), total.alias("parts")).filter("blocks > 0")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))
    rows = members.join(cells, "centre").select("centre", "node", "label", "usual", "blocks", "parts", block.alias("block"), part.alias("part"))
    held = "if(label <> usual, transform(sequence(0L, parts - 1), x -> block * parts + x), array())"
    taken = f"array_union({held}, transform(sequence(0L, blocks - 1), x -> x * parts + part))"
    cell = F.explode(F.expr(f"if(node = centre, sequence(0L, blocks * parts - 1), {taken})"))
    rows = rows.withColumn("cell", cell).select(
        "centre",
        "cell",
        F.expr("CASE WHEN node = centre THEN 0 WHEN label <> usual AND cell div parts = block THEN 1 ELSE 2 END").alias("role"),
        F.expr("node <> centre AND cell % parts = part").alias("compared"),
        "node",
        "label",
    )
    rows = rows.join(sets.select("node", "values"), "node").select("centre", "cell", "role", "compared", "node", "label", "values")
    rows = rows.repartition(partitions(rows), "centre", "cell").sortWithinPartitions("centre", "cell", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None
        for batch in batches:
            centres, numbers, roles, compared, nodes, labels, raws = (column.to_pylist() for column in batch.columns)
            for k, values in enumerate(decode(raws)):
                if (centres[k], numbers[k]) != at:
                    if cell:
                        yield cell.links()
                    at, cell = (centres[k], numbers[k]), _Cell(values)
                elif roles[k] == 1:
                    cell.hold(nodes[k], labels[k], values, compared[k])
                else:
                    cell.compare(nodes[k], labels[k], values)
            if cell and len(cell.found) > VALUES:
                yield cell.links()
        if cell:
            yield cell.links()

    return rows.mapInArrow(run, "a long, b long")


class _Cell:
    """A block of members, by their differences from the centre, and the links found with others so far."""

    def __init__(self, centre: np.ndarray):
        self.centre = centre.copy()
        self.held: list[tuple[int, int, int, np.ndarray]] = []
        self.waiting: list[tuple[int, int, int, np.ndarray]] = []
        self.index = None
        self.up: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def _row(self, node: int, label: int, values: np.ndarray) -> tuple[int, int, int, np.ndarray]:
        both = np.sort(np.concatenate([self.centre, values]), kind="stable")
        again = np.append(False, both[1:] == both[:-1])
        again[:-1] |= again[1:]
        return node, label, len(values), both[~again]

    def hold(self, node: int, label: int, values: np.ndarray, compared: bool) -> None:
        """Take a member into the block, before any is compared with it."""
        self.held.append(self._row(node, label, values))
        if compared:
            self.waiting.append(self.held[-1])

    def compare(self, node: int, label: int, values: np.ndarray) -> None:
        self._settle()
        self._compare(self._row(node, label, values))

    def links(self) -> pa.RecordBatch:
        """The links found since the last call."""
        self._settle()
        a, b = zip(*self.found) if self.found else ((), ())
        self.found = []
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def _settle(self) -> None:
        if self.index is None:
            lengths = [len(row[3]) for row in self.held]
            values = np.concatenate([np.empty(0, np.uint64), *(row[3] for row in self.held)])
            owners = np.repeat(np.arange(len(self.held), dtype=np.int32), lengths)
            order = np.argsort(values, kind="stable")
            values, owners = values[order], owners[order]
            starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
            self.index = values[starts], np.append(starts, len(values)), owners
            self.nodes, self.labels, self.sizes = (np.array([row[k] for row in self.held], np.int64) for k in range(3))
            self.own = self._common(self.sizes, np.array(lengths, np.int64))
            self.held = []
            for row in self.waiting:
                self._compare(row)
            self.waiting = []

    def _common(self, size, different):
        """How many elements members of a size and number of differences share with the centre."""
        return (size + len(self.centre) - different) // 2

    def _compare(self, row: tuple[int, int, int, np.ndarray]) -> None:
        node, label, size, different = row
        values, starts, owners = self.index
        if not len(self.nodes):
            return
        shared = np.zeros(len(self.nodes), np.int64)
        if len(values):
            place = np.minimum(np.searchsorted(values, different), len(values) - 1)
            place = place[values[place] == different]
            counts = starts[place + 1] - starts[place]
            every = np.repeat(starts[place] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            shared = np.bincount(owners[every], minlength=len(self.nodes))
        both = self.own + self._common(size, len(different)) - len(self.centre) + shared
        linked = np.flatnonzero((9 * both >= 4 * (self.sizes + size)) & (self.labels != label))
        for other, first in zip(*(x.tolist() for x in np.unique(self.labels[linked], return_index=True))):
            x, y = self._find(other), self._find(label)
            if x != y:
                self.up[x] = y
                self.found.append((int(self.nodes[linked[first]]), node))

    def _find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x
