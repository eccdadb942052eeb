"""Phrase collocations by set-oriented (SETM) relational mining.

The occurrences of level k are a relation (piece, position, phrase of k words), kept
sorted by piece and position.  Each level does the same:

1. merge-join the relation with itself on the piece and the adjacent position: the
   phrases of k + 1 words, named by their first and their last k words;
2. count the groups;
3. semi-join the occurrences with the groups that are frequent, number these, and
   keep the sorted relation for the next level.

The relation is stored in blocks of some million consecutive occurrences, in which
piece and position are implied by the order (a zero stands between pieces, and for an
infrequent phrase).  A task counts the groups of its block before anything is
shuffled, so a group sends one row for each block, however hot it is; the frequent
ones go back to their blocks, and a block's size bounds what meets there.  Phrases
are numbered densely, so a group of two phrases is one 64-bit number and is exact.

Scores take exact decimals of 38 digits.

Defined cases: null and empty texts have no words; a null language is ``und``; very
long texts are read in slices and never cut between the words of a piece; ties are
broken as documented at :func:`collocations`; repeated rows count each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmscope.llm.common import partitions, stored, workers

BLOCK_WORDS = 4_000_000
SLICE = 2_000_000  # bytes of text split at a time
SALTS = 256  # parts of a language that are ranked by themselves first

# What ends a piece, and the tab that parts words as a space does.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")
BETWEEN_WORDS = re.compile(rb"[ \n]")


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed; bytes of one significance stand together."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return planes.reshape(4, -1).T.copy().view("<u4").ravel()


class _Block:
    """Words of one language in text order: numbers from 1, 0 between pieces."""

    def __init__(self):
        self.known: dict[bytes, int] = {b"\n": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[str]) -> None:
        data = "\n".join([*texts, ""]).encode().lower().translate(TABLE)
        at = 0
        while at < len(data):
            end = BETWEEN_WORDS.search(data, min(at + SLICE, len(data) - 1))
            stop = end.start() if end else len(data)
            words = [w for w in data[at:stop].replace(b"\n", b" \n ").split(b" ") if w]
            for w in set(words) - self.known.keys():
                self.known[w] = len(self.known)
            self.parts.append(np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words)))
            self.size += len(words)
            at = stop + 1 if end and data[stop : stop + 1] == b" " else max(stop, at + 1)

    def row(self) -> tuple[bytes, list[str], np.ndarray]:
        """The relation, its words and their counts; frequent words have small numbers."""
        numbers = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)
        counts = np.bincount(numbers, minlength=len(self.known))[1:]
        order = np.argsort(-counts, kind="stable")
        new = np.zeros(len(self.known), np.uint32)
        new[order + 1] = np.arange(1, len(order) + 1, dtype=np.uint32)
        words = [w.decode() for w in self.known][1:]
        return _pack(new[numbers]), [words[k] for k in order], counts[order]


def _words(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Blocks of the first relation: block, lang, relation, words, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        open_blocks: dict[str, _Block] = {}

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal count
            for lang, block in sorted(open_blocks.items()):
                relation, words, counts = block.row()
                number = TaskContext.get().partitionId() << 32 | count
                count += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([lang], pa.string()),
                        pa.array([relation], pa.binary()),
                        pa.array([words], pa.list_(pa.string())),
                        pa.array([counts], pa.list_(pa.int64())),
                    ],
                    names=["block", "lang", "relation", "words", "counts"],
                )
            open_blocks.clear()

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                block = open_blocks.setdefault(lang, _Block())
                some, size = [], 0
                for text in texts:
                    some.append(text)
                    size += len(text)
                    if size >= SLICE:
                        block.add(some)
                        some, size = [], 0
                block.add(some)
            if sum(b.size for b in open_blocks.values()) >= BLOCK_WORDS:
                yield from closed()
        yield from closed()

    lang = F.coalesce(df[lang_col].cast("string"), F.lit("und"))
    rows = df.select(lang.alias("lang"), df[text_col].alias("text")).filter("text <> ''")
    return rows.mapInArrow(run, "block long, lang string, relation binary, words array<string>, counts array<long>")


def _adjacent(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join of a sorted relation with itself: the places with a phrase here and at the next position, and both as one number."""
    at = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
    return at, numbers[at].astype(np.int64) << 32 | numbers[at + 1].astype(np.int64)


def _grouped(relation: DataFrame) -> DataFrame:
    """The groups of the next level with their counts in each block: block, key, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.unique(_adjacent(_unpack(raw))[1], return_counts=True)
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), block, np.int64)), pa.array(keys), pa.array(counts.astype(np.int64))],
                    names=["block", "key", "count"],
                )
                for at in range(0, rows.num_rows, 50_000):
                    yield rows.slice(at, 50_000)

    return relation.select("block", "relation").mapInArrow(run, "block long, key long, count long")


def _pack_keys(keys: np.ndarray | pa.Array) -> bytes:
    """Sorted 64-bit numbers as their differences, or words (which have no line ends)."""
    if isinstance(keys, np.ndarray):
        raw = np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()
    else:
        raw = "\n".join(keys.to_pylist()).encode()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack_keys(raw: bytes, words: bool) -> np.ndarray | list[str]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    if words:
        return raw.decode().split("\n")
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel())


FOUND_SCHEMA = "block long, lang string, part int, keys binary, locals binary, f array<long>"
HELD_ROWS = 2_000_000  # rows of frequent groups that a task collects before it hands them on


def _frequent(groups: DataFrame, by: list[str], least: int) -> DataFrame:
    """The groups with at least ``least`` occurrences over all blocks, numbered within their partition.

    The rows of a group, one for each block at most, stream through one task in order.
    Two kinds of rows come out, both packed: for each block its frequent groups with
    their local numbers, and (block null) the groups themselves with ``f``, the occurrences.
    """
    words = groups.schema["key"].dataType.typeName() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []  # rows of the last group so far
        kept: list[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]] = []  # rows, first of their group, number, f

        def keep(pieces: list[pa.RecordBatch], starts: np.ndarray) -> None:
            nonlocal local
            rows = pa.Table.from_batches(pieces)
            counts = rows["count"].to_numpy()
            f = np.add.reduceat(counts, starts)
            frequent = f >= least
            sizes = np.diff(np.append(starts, len(counts)))
            number = local + np.cumsum(frequent) - 1
            local += int(frequent.sum())
            first = np.zeros(len(counts), bool)
            first[starts] = True
            some = np.flatnonzero(np.repeat(frequent, sizes))
            if len(some):
                kept.append((rows.take(some), first[some], np.repeat(number, sizes)[some], np.repeat(f, sizes)[some]))

        def told() -> Iterator[pa.RecordBatch]:
            if not kept:
                return
            rows = pa.concat_tables([k[0] for k in kept]).combine_chunks()
            first, number, f = (np.concatenate([k[i] for k in kept]) for i in (1, 2, 3))
            kept.clear()
            keys = rows["key"].chunk(0) if words else rows["key"].to_numpy()
            chosen = lambda at: keys.take(pa.array(at)) if words else keys[at]
            blocks = rows["block"].to_numpy()
            order = np.argsort(blocks, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
                yield row(int(blocks[at[0]]), None, _pack_keys(chosen(at)), number[at], None)
            heads = np.flatnonzero(first)
            langs = rows["lang"].chunk(0).take(pa.array(heads)).to_pylist() if "lang" in by else [None] * len(heads)
            edges = [k for k in range(1, len(heads)) if langs[k] != langs[k - 1]]
            for at, lang in zip(np.split(heads, edges), [langs[k] for k in [0, *edges]]):
                yield row(None, lang, _pack_keys(chosen(at)), number[at], f[at])

        def row(block: int | None, lang: str | None, keys: bytes, numbers: np.ndarray, f: np.ndarray | None) -> pa.RecordBatch:
            values = [block, lang, part, keys, _pack(numbers), f]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "lang", "part", "keys", "locals", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            begins = np.zeros(batch.num_rows, bool)  # rows at which a group begins
            begins[0] = not held or any(batch.column(c)[0] != held[-1].column(c)[-1] for c in by)
            for c in by:
                values = batch.column(c)
                begins[1:] |= pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(begins)
            if not len(starts):
                held.append(batch)
                continue
            if held:
                keep([*held, batch.slice(0, starts[0])], np.array([0]))
            if len(starts) > 1:
                keep([batch.slice(starts[0], starts[-1] - starts[0])], starts[:-1] - starts[0])
            held = [batch.slice(starts[-1])]
            if sum(len(k[1]) for k in kept) >= HELD_ROWS:
                yield from told()
        if held:
            keep(held, np.array([0]))
        yield from told()

    dealt = groups.select("block", *by, "count").repartition(partitions(groups), *by).sortWithinPartitions(*by)
    return stored(dealt.mapInArrow(run, FOUND_SCHEMA), "frequent")


def _offsets(found: DataFrame) -> np.ndarray:
    """What to add to the local numbers of each partition so that the groups are numbered from 1 without gaps.

    One number for each partition comes to the driver.  Numbers stay below 2 ** 31, so that two fit a key.
    """
    sizes = {r.part: r.size for r in found.filter("block IS NULL").groupBy("part").agg(F.sum(F.size("f")).alias("size")).collect()}
    each = np.zeros(max(sizes, default=0) + 2, np.int64)
    each[[p + 1 for p in sizes]] = list(sizes.values())
    if each.sum() >= 2**31:
        raise OverflowError("more than 2 ** 31 frequent phrases of one length")
    return np.cumsum(each)[:-1] + 1


def _numbered(found: DataFrame, offsets: np.ndarray, words: bool) -> DataFrame:
    """One row for each group: lang, key, f and its number as ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part, keys, numbers, f in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "keys", "locals", "f"))):
                ids = offsets[part] + _unpack(numbers)
                rows = [pa.array([lang] * len(f), pa.string()), pa.array(_unpack_keys(keys, words)), pa.array(f, pa.int64()), pa.array(ids, pa.int64())]
                whole = pa.RecordBatch.from_arrays(rows, names=["lang", "key", "f", "id"])
                for at in range(0, whole.num_rows, 50_000):
                    yield whole.slice(at, 50_000)

    groups = found.filter("block IS NULL").select("lang", "part", "keys", "locals", "f")
    return groups.mapInArrow(run, f"lang string, key {'string' if words else 'long'}, f long, id long")


def _renumbered(relation: DataFrame, found: DataFrame, offsets: np.ndarray, words: bool) -> DataFrame:
    """Semi-join of each block with its frequent groups: the next relation, of their numbers."""

    def of_words(mine: pa.Table, known: pa.Table) -> pa.Table:
        mine = mine.combine_chunks()
        own = mine["words"].chunk(0).flatten()
        ids = np.zeros(len(own) + 1, np.uint32)
        keys, numbers = frequent(known)
        ids[pc.index_in(pa.array(keys, pa.string()), value_set=own).to_numpy().astype(np.int64) + 1] = numbers
        return out(mine, ids[_unpack(mine["relation"][0].as_py())])

    def of_pairs(mine: pa.Table, known: pa.Table) -> pa.Table:
        numbers = _unpack(mine["relation"][0].as_py())
        at, keys = _adjacent(numbers)
        wanted, ids = frequent(known)
        order = np.argsort(wanted)
        wanted, ids = wanted[order], ids[order]
        place = np.minimum(np.searchsorted(wanted, keys), max(0, len(wanted) - 1))
        hit = wanted[place] == keys if len(wanted) else np.zeros(len(keys), bool)
        new = np.zeros(len(numbers), np.uint32)
        new[at[hit]] = ids[place[hit]]
        return out(mine, new)

    def frequent(known: pa.Table) -> tuple[np.ndarray | list[str], np.ndarray]:
        parts = [(_unpack_keys(k, words), offsets[p] + _unpack(n)) for k, p, n in zip(*(known[c].to_pylist() for c in ("keys", "part", "locals")))]
        ids = np.concatenate([n for _, n in parts]).astype(np.uint32) if parts else np.empty(0, np.uint32)
        if words:
            return [w for k, _ in parts for w in k], ids
        return np.concatenate([k for k, _ in parts]) if parts else np.empty(0, np.int64), ids

    def out(mine: pa.Table, numbers: np.ndarray) -> pa.Table:
        return pa.table({"block": mine["block"], "relation": pa.array([_pack(numbers)], pa.binary())})

    columns = ["block", "relation", "words"] if words else ["block", "relation"]
    told = found.filter("block IS NOT NULL").select("block", "part", "keys", "locals").groupBy("block")
    pairs = relation.select(*columns).groupBy("block").cogroup(told)
    return pairs.applyInArrow(of_words if words else of_pairs, "block long, relation binary")


def _scored(phrases: DataFrame, words: int) -> DataFrame:
    """With score, l and r of the lowest-scoring cut, of equal ones the first."""
    cuts = [
        F.struct(
            F.expr(f"(1000000BD * cast(f as decimal(38,0)) * cast(f as decimal(38,0))) div (cast(heads[{k - 1}] as decimal(38,0)) * cast(tails[{words - k - 1}] as decimal(38,0)))").alias("score"),
            F.lit(k).alias("k"),
            F.col("heads")[k - 1].alias("l"),
            F.col("tails")[words - k - 1].alias("r"),
        )
        for k in range(1, words)
    ]
    return phrases.withColumn("cut", F.array_min(F.array(*cuts))).select("id", "lang", "words", "f", "cut.*")


def collocations(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 3,
    least: int = 10,
    absorb: int = 50,
    top: int = 2000,
) -> DataFrame:
    """Per language its ``top`` phrases of 2 to ``longest`` words that occur at least ``least`` times: lang,
    rank, phrase, a (occurrences), l, r (occurrences of the two parts), n (words of the language), score.

    The score is floor(1000000 a a / (l r)) at the cut where it is lowest, of equal ones the first.  Phrases
    inside a longer one that has ``absorb`` percent of their occurrences are left out.  Order: score and a
    descending, then the phrase's bytes."""
    workers(df.sparkSession)
    relation = stored(_words(df, text_col, lang_col), "words")
    totals = relation.select("lang", F.expr("aggregate(counts, 0L, (x, y) -> x + y)").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))

    each = relation.select("block", "lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    found = _frequent(each.select("block", "lang", F.col("x.words").alias("key"), F.col("x.counts").alias("count")), ["lang", "key"], least)
    offsets = _offsets(found)
    numbered = stored(_numbered(found, offsets, words=True), "numbered")
    phrases = numbered.select("id", "lang", F.array("key").alias("words"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    relation = stored(_renumbered(relation, found, offsets, words=True), "relation")

    kept = []
    for length in range(2, longest + 1):
        groups = _grouped(relation)
        if length < longest:
            found = _frequent(groups, ["key"], least)
            offsets = _offsets(found)
            numbered = stored(_numbered(found, offsets, words=False), "numbered")
            relation = stored(_renumbered(relation, found, offsets, words=False), "relation")
        else:
            numbered = groups.groupBy("key").agg(F.sum("count").alias("f")).filter(F.col("f") >= least).withColumn("id", F.lit(None).cast("long"))
        parts = numbered.select("id", "f", F.expr("key >> 32").alias("left"), F.expr("key & 4294967295").alias("right"))
        firsts = phrases.select(F.col("id").alias("left"), "lang", "words", "heads")
        lasts = phrases.select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"), "tails")
        longer = stored(
            parts.join(firsts, "left").join(lasts, "right").select(
                "id", "lang", F.concat("words", F.array("last")).alias("words"), "f",
                F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"), "left", "right",
            ),
            "phrases",
        )
        if kept:  # a longer candidate implies one that is a word longer and has no fewer occurrences
            around = longer.select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("around"))
            kept[-1] = kept[-1].join(around, "id", "left").filter(f"around IS NULL OR 100 * around < {absorb} * f").drop("around")
        kept.append(_scored(longer, length))
        phrases = longer

    rows = kept[0]
    for more in kept[1:]:
        rows = rows.union(more)
    rows = rows.select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
