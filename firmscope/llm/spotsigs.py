"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Every common word (an anchor) of a text starts a chain of the next ``CHAIN`` content
words, ``DISTANCE`` apart; anchor and chain make a signature, and the distinct
signatures are the fingerprint.  Two fingerprints are compared by Jaccard similarity;
sets whose lengths already rule a threshold out aren't merged, and a merge ends as
soon as the threshold is out of reach.  :func:`similar` searches a table: fingerprints
are partitioned by set length, so that sets within the threshold's length range lie in
the same or the next partition, and meet there on their rarest signatures.

:func:`with_edited` compares each document with an edited text (its last half replaced
by the beginning of the next document) and with the next document.  The table is cut
into ranges of ids at quantiles; the first document of each range is copied to the end
of the range before, so every range knows its successor, and texts are shuffled once.

Defined cases: null texts count as empty; an empty text has the empty fingerprint, whose
likeness to another empty one is 1 and to anything else 0; in a text with few anchors
(``FEW``) every content word starts a chain too; a text of anchors only, or without words, has one
signature; rows with equal ids follow each other by a hash of their text; a row without
an id has no place in the order, its next document is the empty text; very long texts
are fingerprinted whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm.common import partitions, workers

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """the of and to in is that was it for on with as are be at by this from or an a
    der die das und den von zu mit des im dem nicht ein eine für auf ist auch sich als
    de la le et les un une du dans pour que qui est au avec sur par pas
    el en y los del se las por para con una su al lo es""".split()
)
CHAIN, DISTANCE = 2, 1
FEW = 8  # with fewer anchors, or fewer than one in so many words, every content word starts a chain too
WORD = re.compile(r"\w+")
MOST_RANGES = 20_000  # quantiles of the ids that come to the driver


def signatures(text: str | None) -> np.ndarray:
    """The fingerprint as a sorted array of 48-bit signatures."""
    text = text or ""
    if not text:
        return np.empty(0, np.uint64)
    content: list[str] = []
    marks: list[tuple[str, int]] = []
    words = WORD.findall(text.lower())
    for word in words:
        if word in ANCHORS:
            marks.append((word, len(content)))
        else:
            content.append(word)
    if len(marks) < max(FEW, len(words) // FEW):
        marks += [("", i) for i in range(len(content))]
    reach = CHAIN * DISTANCE
    found = {f"{word} {' '.join(content[i : i + reach : DISTANCE])}" for word, i in marks if i < len(content)}
    if not found:
        found = {" ".join(w for w, _ in marks) or text}
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(s) for s in found], np.uint64) >> np.uint64(16))


def as_text(fingerprint: np.ndarray) -> str:
    """Twelve hexadecimal digits for each signature, in ascending order."""
    return fingerprint.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0, block: int = 1024) -> float:
    """Jaccard similarity of two sorted sets; 0 as soon as ``threshold`` is out of reach."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    shared = 0
    for at in range(0, len(a), block):
        part = a[at : at + block]
        place = np.minimum(np.searchsorted(b, part), len(b) - 1)
        shared += int((b[place] == part).sum())
        most = shared + max(0, len(a) - at - block)
        if most < threshold * (len(a) + len(b) - most):
            return 0.0
    return shared / (len(a) + len(b) - shared)


def _ordered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows dealt out by ranges of ids, sorted; kind 0: rows without id, 1: documents, 2: copies of the
    first document of the next range, which end a range."""
    if not isinstance(df.schema[id_col].dataType, T.NumericType):
        raise TypeError(f"{id_col} must be a number: documents are dealt out by quantiles of it")
    n = min(MOST_RANGES, partitions(df))
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    shares = [k / n for k in range(1, n)] or [0.5]
    least, cuts = rows.agg(F.min("id"), F.percentile_approx("id", shares, 100 * n)).first()
    cuts = sorted({c for c in cuts or [] if c > least})  # at most n - 1 ids
    if cuts:  # two steps of about the square root of their number
        width = math.isqrt(len(cuts)) + 1
        groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]
        heads = F.array(*[F.lit(g[0]) for g in groups])
        coarse = F.size(F.filter(heads, lambda c: c <= F.col("id")))
        tails = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
        fine = F.size(F.filter(F.element_at(tails, coarse), lambda c: c <= F.col("id")))
        part = F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine)
        is_cut = F.element_at(F.element_at(tails, coarse), fine) == F.col("id")
        before = F.when((coarse > 0) & is_cut, part - 1).when(F.col("id") == least, F.lit(len(cuts)))
    else:
        part = F.lit(0)
        before = F.when(F.col("id") == F.lit(least), 0)
    loose = F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    places = F.when(F.col("id").isNull(), F.array(F.struct(loose.alias("part"), F.lit(0).alias("kind")))).otherwise(
        F.filter(
            F.array(
                F.struct(part.cast("int").alias("part"), F.lit(1).alias("kind")),
                F.struct(before.cast("int").alias("part"), F.lit(2).alias("kind")),
            ),
            lambda x: x["part"].isNotNull(),
        )
    )
    spread = rows.withColumn("place", F.explode(places)).select("place.part", "place.kind", "id", "text")
    return (
        spread.withColumn("tie", F.xxhash64("text")).repartitionById(n, "part").sortWithinPartitions("part", "kind", "id", "tie")
    )


def with_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, code points, SHA-256 of the edited text, both fingerprints, likeness to the edited text
    and to the next document."""
    workers(df.sparkSession)
    key_type = df.schema[id_col].dataType.simpleString()
    ordered = _ordered(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor: (part, id, text, fingerprint)
        for batch in batches:
            out: list[tuple] = []
            for part, kind, ident, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    out.append(_compared(ident, text, signatures(text), "", signatures("")))
                    continue
                if held is not None and held[0] != part:
                    raise AssertionError("a range has no successor")
                if kind == 2 and held is None:  # a further row with the id of the successor
                    continue
                own = signatures(text)
                if held is not None:
                    out.append(_compared(held[1], held[2], held[3], text, own))
                held = (part, ident, text, own) if kind == 1 else None
            yield _batch(out, batch.schema.field(2).type)
        if held is not None:
            raise AssertionError("a range has no successor")

    return ordered.select("part", "kind", "id", "text").mapInArrow(
        run,
        f"doc_id {key_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


def _compared(ident, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = signatures(edited)
    return (
        ident,
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        as_text(own),
        as_text(changed),
        likeness(own, changed),
        likeness(own, its),
    )


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (text) and its signatures (array of longs)."""
    workers(df.sparkSession)
    key_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([as_text(f) for f in found], pa.string()),
                    pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64())),
                ],
                names=["doc_id", "fingerprint", "signatures"],
            )

    return df.select(df[id_col], df[text_col]).mapInArrow(run, f"doc_id {key_type}, fingerprint string, signatures array<long>")


def similar(queries: DataFrame, df: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of equal fingerprints in ``df`` within ``threshold`` of a class in ``queries``: query_class, class_id
    (their smallest ids) and likeness.  Empty fingerprints match nothing.

    A set of n signatures lies in partition floor(log n / log (1 / threshold)); a partner of at least its own
    length is there or in the next one.  Sets meet on the rarest of their signatures, of which similar sets
    must share one: n - ceil(threshold * n) + 1 of them.
    """
    step = math.log(1 / threshold)

    def classes(table: DataFrame) -> DataFrame:
        found = fingerprints(table, id_col, text_col).filter("size(signatures) > 0")
        return found.groupBy("signatures").agg(F.min("doc_id").alias("id"))

    every, asked = classes(df), classes(queries)
    spread = every.select(F.explode("signatures").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(table: DataFrame) -> DataFrame:
        rows = table.select("id", F.size("signatures").alias("n"), F.explode("signatures").alias("sig"))
        rows = rows.join(spread, "sig", "left").groupBy("id", "n").agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sig"))).alias("s")  # one document's
        )
        most = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int")
        level = F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + 1e-9).cast("int")
        return rows.select("id", level.alias("level"), F.explode(F.slice("s", F.lit(1), most)).alias("p")).select("id", "level", "p.sig")

    left = prefixes(asked).select(F.col("id").alias("query_class"), "sig", F.explode(F.expr("sequence(level - 1, level + 1)")).alias("level"))
    right = prefixes(every).select(F.col("id").alias("class_id"), "sig", "level")
    pairs = left.join(right, ["sig", "level"]).select("query_class", "class_id").distinct()
    pairs = pairs.join(asked.select(F.col("id").alias("query_class"), F.col("signatures").alias("a")), "query_class")
    pairs = pairs.join(every.select(F.col("id").alias("class_id"), F.col("signatures").alias("b")), "class_id")

    @F.pandas_udf("double")
    def compared(a, b):
        import pandas as pd

        return pd.Series([likeness(np.asarray(x), np.asarray(y), threshold) for x, y in zip(a, b)], dtype=float)

    return pairs.select("query_class", "class_id", compared("a", "b").alias("likeness")).filter(F.col("likeness") >= threshold)
