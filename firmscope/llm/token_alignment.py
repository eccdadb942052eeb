"""Alignment of two tokenizers over the same bytes, by an associative fragment monoid.

A text with a space before it is encoded by a byte-level BPE (A) and by a piece model
with byte fallback (B, which adds that space itself).  Byte offsets where an A and a B
token both end cut the tokens into groups; the last tokens of a group are a link.

A fragment is what a byte range of a text contributes: an open prefix (tokens up to
the first common end), closed groups (between common ends) and an open suffix (tokens
after the last one).  :func:`compose` puts neighbours together: the left suffix and
the right prefix are aligned again, whatever closes joins the closed groups.  It is
associative and the empty fragment is its unit, so the fragments of a long text are
encoded in tasks of their own and composed by a tree of Spark groups of ``FAN``.  The
two tokenizers cut a byte range at different places (A where its pre-tokenizer ends a
piece, B between characters that no vocabulary piece has side by side), so the open
ends are real: tokens of one side reach over the other's.

An id pair's count over the corpus is returned to the texts in blocks of some million
links: a task numbers the distinct pairs of its block, the pairs are counted over all
blocks, and the counts go back to each block, whose size bounds a group.  Nothing is
broadcast.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from
space and text (U+2581 in them, for instance), have no tokens and give zeros and an
empty digest; strings of special tokens are plain text; very long texts are encoded
whole, in chunks of ``CHUNK`` code points where cuts can be found (a run without any,
such as a million letters, is one chunk); repeated rows and ids count each; null ids
stay null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.llm.bpe import PATTERN, SETTLED, byte_alphabet, vocabulary
from firmscope.llm.common import stored, workers

CHUNK = 1 << 16  # code points of a text that one task encodes at a time
FAN = 16
BLOCK_LINKS = 4_000_000

# The first tokenizer's pre-tokenizer surely ends a piece here (before the second character).
PIECE_END = re.compile(r"(?<=\S)[ \t\r\n]|(?<=[^\W\d_])[,.;:!?()、。，；：！？]")
#: From this code point on, the libraries' tables of letters and numbers may differ.
UNSETTLED = re.compile(f"[{chr(SETTLED)}-{chr(0x10FFFF)}]")
LONG_RUN = 1000  # characters without a space, or spaces, that are left to the slower library


def _checked(text: str, ids: list[int], bytes_of: list[bytes]) -> np.ndarray | None:
    """The ids, None where the tokens' bytes aren't the text's."""
    return np.array(ids, np.uint32) if b"".join(map(bytes_of.__getitem__, ids)) == text.encode() else None


class ByteLevel:
    """The first tokenizer: byte-level BPE in the JSON form of the tokenizers library, special strings as plain text.

    Where the file's ids are its merge ranks, as usual, plain texts are encoded by tiktoken, which gives the same ids faster.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        usual = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.bytes_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*usual.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes_of[i] = token
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        ranked = [vocab[m] for m in merged] == list(range(256, 256 + len(merged)))
        split = spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.fast = None
        if ranked and plain and not spec["normalizer"] and not spec["model"].get("ignore_merges"):
            self.fast = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=usual, special_tokens={})

    def encode(self, text: str, begins: bool) -> np.ndarray | None:
        """Ids of a stretch at whose start a piece begins; a space is put before a whole text's start."""
        text = " " + text if begins else text
        simple = self.fast and (text.isascii() or not UNSETTLED.search(text))
        if simple and max(map(len, text.split(" "))) < LONG_RUN and " " * LONG_RUN not in text:
            return np.array(self.fast.encode_ordinary(text), np.uint32)  # every byte is some token's: nothing to check
        return _checked(text, self.tokenizer.encode(text, add_special_tokens=False).ids, self.bytes_of)

    def cut_after(self, text: str, at: int) -> int:
        found = PIECE_END.search(text, at)
        return found.start() if found else len(text)


class Pieces:
    """The second tokenizer: a sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        usual = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.adjacent = {p[k : k + 2] for p in usual for k in range(len(p) - 1)}
        if any("\n" in p for p in usual):
            raise ValueError(f"{path}: pieces with line ends, a text can't be cut")

    def encode(self, text: str, begins: bool) -> np.ndarray | None:
        """Ids of a stretch at whose start no piece can begin earlier; the model puts a space before a whole text."""
        if begins:
            return _checked(" " + text, self.model.encode(text), self.bytes_of)
        # The space and the line end never merge with what follows, and go again.
        return _checked(text, self.model.encode("\n" + text)[2:], self.bytes_of)

    def cut_after(self, text: str, at: int) -> int:
        while at < len(text):
            plain = text[at - 1 : at + 4096].replace(" ", "▁")
            for k in range(len(plain) - 1):
                if plain[k : k + 2] not in self.adjacent:
                    return at + k
            at += len(plain) - 1
        return len(text)


@dataclass
class Fragment:
    """A byte range of a text, see above.  Arrays: ids (uint32), ends (byte offsets, int64), links (A id << 32 | B id)."""

    head_a: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    head_a_ends: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    head_b: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    head_b_ends: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    tail_a: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    tail_a_ends: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    tail_b: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    tail_b_ends: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    links: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    groups: bytes = b""  # each closed group with a ; behind it
    n_groups: int = 0
    n_a: int = 0
    n_b: int = 0
    cut: bool = False  # whether there is a common end in it; if not, all tokens are in the prefix
    ok: bool = True

    def values(self) -> list:
        return [v.tobytes() if isinstance(v := getattr(self, f.name), np.ndarray) else v for f in fields(self)]

    @classmethod
    def of_values(cls, values: dict) -> Fragment:
        kinds = {"links": np.int64} | {f"{s}_{t}": np.uint32 for s in ("head", "tail") for t in "ab"}
        kinds |= {f"{s}_{t}_ends": np.int64 for s in ("head", "tail") for t in "ab"}
        return cls(**{k: np.frombuffer(v, kinds[k]) if k in kinds else v for k, v in values.items()})


FRAGMENT_SCHEMA = ", ".join(
    f"{f.name} {'binary' if f.name == 'groups' or f.type == 'np.ndarray' else 'boolean' if f.type == 'bool' else 'long'}" for f in fields(Fragment)
)
_CELLS: dict[int, np.ndarray] = {}


def _cells(size: int) -> np.ndarray:
    """Eight bytes for each number below ``size`` and what may follow it: comma, bar, semicolon; zero bytes at the end."""
    width = 1 << max(16, (size - 1).bit_length())
    if width not in _CELLS:
        if width > 10**7:
            raise ValueError("ids of more than seven digits")
        _CELLS[width] = np.array([[f"{i}{end}".encode() for i in range(width)] for end in ",|;"], "S8").view("<u8")
    return _CELLS[width]


def groups_text(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> bytes:
    """``a1,a2|b1;`` of each group; ``*_last`` are the places of the last tokens."""
    comma, bar, semicolon = _cells(int(max(a.max(initial=0), b.max(initial=0))) + 1)
    text_a, text_b = comma[a], comma[b]
    text_a[a_last], text_b[b_last] = bar[a[a_last]], semicolon[b[b_last]]
    # A group's tokens of A stand behind the tokens of B of the groups before, its tokens of B behind its own of A too.
    behind_a, behind_b = np.concatenate([[0], b_last[:-1] + 1]), a_last + 1
    out = np.empty(len(a) + len(b), "<u8")
    out[np.arange(len(a)) + np.repeat(behind_a, np.diff(a_last, prepend=-1))] = text_a
    out[np.arange(len(b)) + np.repeat(behind_b, np.diff(b_last, prepend=-1))] = text_b
    return out.tobytes().translate(None, b"\0")


def _common(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places on both sides of the tokens that end together."""
    if not len(a_ends) or not len(b_ends):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = min(a_ends[0], b_ends[0])
    flags = np.zeros((2, max(a_ends[-1], b_ends[-1]) - low + 1), bool)
    flags[0, a_ends - low] = flags[1, b_ends - low] = True
    return np.flatnonzero(flags[1, a_ends - low]), np.flatnonzero(flags[0, b_ends - low])


def scan(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of tokens that follow one another on each side."""
    at_a, at_b = _common(a_ends, b_ends)
    if not len(at_a):
        return Fragment(head_a=a, head_a_ends=a_ends, head_b=b, head_b_ends=b_ends, n_a=len(a), n_b=len(b))
    (p, q), (x, y) = (at_a[0] + 1, at_b[0] + 1), (at_a[-1] + 1, at_b[-1] + 1)
    closed = len(at_a) - 1
    return Fragment(
        a[:p], a_ends[:p], b[:q], b_ends[:q], a[x:], a_ends[x:], b[y:], b_ends[y:],
        (a[at_a[1:]].astype(np.int64) << 32) | b[at_b[1:]],
        groups_text(a[p:x], b[q:y], at_a[1:] - p, at_b[1:] - q) if closed else b"",
        closed, len(a), len(b), True,
    )


def closed_head(f: Fragment) -> tuple[bytes, np.ndarray]:
    """The prefix as a group of its own, where a common end stands before it."""
    text = groups_text(f.head_a, f.head_b, np.array([len(f.head_a) - 1]), np.array([len(f.head_b) - 1]))
    return text, (f.head_a[-1:].astype(np.int64) << 32) | f.head_b[-1:]


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring byte ranges."""
    n_a, n_b = x.n_a + y.n_a, x.n_b + y.n_b
    if not (x.ok and y.ok):
        return Fragment(ok=False)
    side = "tail" if x.cut else "head"
    left = [getattr(x, f"{side}_{name}") for name in ("a", "a_ends", "b", "b_ends")]
    right = [y.head_a, y.head_a_ends, y.head_b, y.head_b_ends]
    middle = scan(*(np.concatenate(pair) for pair in zip(left, right)))
    if not x.cut:
        if y.cut:  # the middle ends with the common end that y's prefix ends with
            middle.tail_a, middle.tail_a_ends, middle.tail_b, middle.tail_b_ends = y.tail_a, y.tail_a_ends, y.tail_b, y.tail_b_ends
            middle.links = np.concatenate([middle.links, y.links])
            middle.groups, middle.n_groups = middle.groups + y.groups, middle.n_groups + y.n_groups
        middle.n_a, middle.n_b = n_a, n_b
        return middle
    links, groups, n_groups = [x.links], [x.groups], x.n_groups
    tail = [middle.head_a, middle.head_a_ends, middle.head_b, middle.head_b_ends]
    if middle.cut:
        text, link = closed_head(middle)
        links, groups, n_groups = [*links, link, middle.links], [*groups, text, middle.groups], n_groups + 1 + middle.n_groups
        tail = [middle.tail_a, middle.tail_a_ends, middle.tail_b, middle.tail_b_ends]
    if y.cut:
        links, groups, n_groups = [*links, y.links], [*groups, y.groups], n_groups + y.n_groups
        tail = [y.tail_a, y.tail_a_ends, y.tail_b, y.tail_b_ends]
    return Fragment(
        x.head_a, x.head_a_ends, x.head_b, x.head_b_ends, *tail, np.concatenate(links), b"".join(groups), n_groups, n_a, n_b, True
    )


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, first: str, second: str):
        self.a, self.b = ByteLevel(first), Pieces(second)
        self.sizes = [np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b)]

    def fragment(self, begins: bool, a: str, at_a: int, b: str, at_b: int) -> Fragment:
        """Of A's characters and their byte offset, and B's; ``begins``: a text's start."""
        streams = []
        for text, tokenizer, sizes, at in ((a, self.a, self.sizes[0], at_a), (b, self.b, self.sizes[1], at_b)):
            ids = tokenizer.encode(text, begins)
            if ids is None:
                return Fragment(ok=False)
            streams += [ids, at + np.cumsum(sizes[ids])]
        return scan(*streams)

    def chunks(self, text: str, size: int) -> Iterator[tuple[bool, str, int, str, int]]:
        """What each byte range of a text gives to the tokenizers."""
        last, places, offsets = len(text), [0, 0], [0, 0]
        for at in range(size, last + size, size):
            stops = [last if at >= last else max(p, t.cut_after(text, at) if p < at else p) for p, t in zip(places, (self.a, self.b))]
            parts = [text[p:s] for p, s in zip(places, stops)]
            begins = at == size
            yield begins, parts[0], offsets[0], parts[1], offsets[1]
            offsets = [o + begins + len(x.encode()) for o, x in zip(offsets, parts)]
            places = stops


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(first: str | None, second: str | None) -> Aligner:
    """The tokenizers, read once per worker process."""
    paths = first or vocabulary("byte_bpe_50k.json"), second or vocabulary("piece_bpe_32k.model")
    if paths not in _LOADED:
        _LOADED[paths] = Aligner(*paths)
    return _LOADED[paths]


class _Block:
    """Documents whose links are numbered together."""

    def __init__(self):
        self.number = 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.rows, self.links, self.size = [], [], [], 0

    def add(self, id_value: pa.Array, f: Fragment) -> None:
        """One finished document: its prefix is a group, as a text begins with a common end."""
        if f.ok and f.cut:
            text, link = closed_head(f)
            groups = (text + f.groups)[:-1]
            self.rows.append((f.n_a, f.n_b, 1 + f.n_groups, hashlib.sha256(groups).hexdigest()))
            self.links.append(np.concatenate([link, f.links]))
        else:
            self.rows.append((0, 0, 0, ""))
            self.links.append(np.empty(0, np.int64))
        self.ids.append(id_value)
        self.size += len(self.links[-1])

    def batch(self) -> pa.RecordBatch:
        """The rows; the first also has the block's distinct pairs, the others only have their links' numbers."""
        codes, pairs = pd.factorize(np.concatenate(self.links))
        counts = np.bincount(codes, minlength=len(pairs))
        order = np.argsort(-counts, kind="stable")  # frequent pairs get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        numbered = np.split(rank[codes], np.cumsum([len(x) for x in self.links])[:-1])
        block = TaskContext.get().partitionId() << 24 | self.number
        n = len(self.rows)
        columns = [pa.array(np.full(n, block)), pa.concat_arrays(self.ids)]
        columns += [pa.array([r[k] for r in self.rows], pa.int64()) for k in range(3)]
        columns.append(pa.array([r[3] for r in self.rows], pa.string()))
        # Bytes of one significance together: mostly zeros, which compress.
        columns.append(pa.array([x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in numbered], pa.binary()))
        for values in (pairs[order], counts[order]):
            columns.append(pa.array([values, *[None] * (n - 1)], pa.list_(pa.int64())))
        self.number += 1
        self.clear()
        return pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "pairs", "counts"])


def _blocks(found: Iterator[tuple[pa.Array, Fragment]]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for id_value, f in found:
        block.add(id_value, f)
        if block.size >= BLOCK_LINKS or len(block.rows) >= 100_000:
            yield block.batch()
    if block.rows:
        yield block.batch()


def _aligned(df: DataFrame, id_col: str, text_col: str, first: str | None, second: str | None, chunk: int) -> DataFrame:
    """One row per document: its figures and its links, numbered within a block of documents."""
    key_type = df.schema[id_col].dataType.simpleString()
    schema = f"block long, doc_id {key_type}, n_a long, n_b long, n_groups long, groups_sha256 string, codes binary, pairs array<long>, counts array<long>"
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[pa.Array, Fragment]]:
            aligner = loaded(first, second)
            for batch in batches:
                for k, text in enumerate(batch.column(1)):
                    text = text.as_py()
                    yield batch.column(0).slice(k, 1), aligner.fragment(True, text, 0, text, 0) if text else Fragment(ok=False)

        yield from _blocks(found())

    short = texts.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(whole, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, count = loaded(first, second), 0
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                row = TaskContext.get().partitionId() << 32 | count
                count += 1
                for no, part in enumerate(aligner.chunks(text, chunk)):
                    columns = [pa.array([row]), pa.array([no], pa.int64()), batch.column(0).slice(k, 1), *(pa.array([x]) for x in part)]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "no", "id", "begins", "a", "at_a", "b", "at_b"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(first, second)
        for batch in batches:
            for k in range(batch.num_rows):
                part = tuple(batch.column(c)[k].as_py() for c in range(3, 8))
                yield _fragment_row([batch.column(c).slice(k, 1) for c in range(3)], aligner.fragment(*part))

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("no").combine_chunks()
        found = Fragment(cut=False)
        for k in range(table.num_rows):
            found = compose(found, Fragment.of_values({f.name: table[f.name][k].as_py() for f in fields(Fragment)}))
        keys = [table["row"].chunk(0).slice(0, 1), pa.array([table["no"][0].as_py() // FAN], pa.int64()), table["id"].chunk(0).slice(0, 1)]
        return pa.Table.from_batches([_fragment_row(keys, found)])

    long = stored(
        texts.filter(F.length("text") > chunk).mapInArrow(
            cut, f"row long, no long, id {key_type}, begins boolean, a string, at_a long, b string, at_b long"
        ),
        "chunks",
    )
    last = long.agg(F.max("no")).first()[0] or 0
    fragment_schema = f"row long, no long, id {key_type}, {FRAGMENT_SCHEMA}"
    fragments = stored(long.repartition("row", "no").mapInArrow(encoded, fragment_schema), "fragments")
    while last > 0:
        slots = fragments.groupBy("row", F.expr(f"no div {FAN}"))
        fragments = stored(slots.applyInArrow(composed, fragment_schema), "fragments")
        last //= FAN

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[pa.Array, Fragment]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    values = {f.name: batch.column(f.name)[k].as_py() for f in fields(Fragment)}
                    yield batch.column(2).slice(k, 1), Fragment.of_values(values)

        for batch in _blocks(found()):
            # Numbers of their own: these blocks come from other tasks than the short texts'.
            yield batch.set_column(0, "block", pa.array(-1 - batch.column(0).to_numpy()))

    return stored(short.union(fragments.mapInArrow(finished, schema)), "aligned")


def _fragment_row(keys: list[pa.Array], f: Fragment) -> pa.RecordBatch:
    kinds = [pa.binary() if x.name == "groups" or x.type == "np.ndarray" else pa.bool_() if x.type == "bool" else pa.int64() for x in fields(Fragment)]
    columns = [*keys, *(pa.array([v], kind) for v, kind in zip(f.values(), kinds))]
    return pa.RecordBatch.from_arrays(columns, names=["row", "no", "id", *(x.name for x in fields(Fragment))])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """The links between ids over the corpus: pair (A id << 32 | B id), total, best (whether it is its B id's highest)."""
    links = aligned.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    totals = links.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total"))
    totals = stored(totals.withColumn("b", F.expr("pair & 4294967295")), "pairs")
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    return totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def align(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Per row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is its B id's most
    frequent), count_sum (over links, of the pair's count in the corpus), groups_sha256.

    ``first`` and ``second`` are the vocabulary files, on the workers."""
    workers(df.sparkSession)
    key_type = df.schema[id_col].dataType.simpleString()
    documents = _aligned(df, id_col, text_col, first, second, chunk)
    of_block = documents.filter("pairs IS NOT NULL").select("block", F.explode("pairs").alias("pair"))
    told = stored(of_block.join(pair_counts(documents), "pair").select("block", "pair", "total", "best"), "told")

    def scored(mine: pa.Table, counts: pa.Table) -> pa.Table:
        mine = mine.combine_chunks()
        pairs = next(x.values.to_numpy() for x in mine["pairs"] if x.is_valid)
        known, order = counts["pair"].to_numpy(), None
        order = np.argsort(known)
        at = order[np.searchsorted(known, pairs, sorter=order)] if len(pairs) else np.empty(0, np.int64)
        total = counts["total"].to_numpy()[at] if len(pairs) else np.empty(0, np.int64)
        best = counts["best"].to_numpy(zero_copy_only=False).astype(np.int64)[at] if len(pairs) else total
        codes = [np.frombuffer(raw.as_py(), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for raw in mine["codes"]]
        columns = {c: mine[c] for c in ("doc_id", "n_a", "n_b", "n_groups")}
        columns["n_links"] = pa.array([len(c) for c in codes], pa.int64())
        columns["n_best"] = pa.array([int(best[c].sum()) for c in codes], pa.int64())
        columns["count_sum"] = pa.array([int(total[c].sum()) for c in codes], pa.int64())
        columns["groups_sha256"] = mine["groups_sha256"]
        return pa.table(columns)

    schema = f"doc_id {key_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.drop("counts").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scored, schema)
