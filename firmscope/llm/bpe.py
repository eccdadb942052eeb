"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text starts as its bytes.  Leaf ``i`` of the tree holds the merge rank
of the pair that begins at symbol ``i``; inner nodes hold the smaller child, the
left one of equals, so the root is the leftmost merge of lowest rank.  A merge
changes at most three leaves (the merged symbol, its left neighbour and the
symbol that went), each updated in logarithmic time, until no pair can merge.

Pieces of up to ``SHORT`` bytes are encoded many at a time: one tree per row of a
numpy matrix, the same updates on all rows at once.  Longer pieces get a tree of
their own.  Pieces are remembered in a table of at most ``MEMORY`` entries, so a
task's memory doesn't grow with the vocabulary of the corpus.

Defined cases: a null text counts as empty and has no tokens; the strings of
special tokens in a text become those tokens, as the tokenizers library does by
default; very long texts and pieces are encoded whole; repeated rows are encoded
one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.llm.common import workers

SHORT = 32
MEMORY = 200_000
#: Below this code point the installed regex tables and the tokenizer's agree on letters, numbers and spaces.
SETTLED = 0x530
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 40  # rank of a pair that can't merge


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_by_tree(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols after all merges; ``pairs`` has (rank, merged symbol) of each pair."""
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 1).bit_length()
    none = (1 << 40, 0)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    # A node is (rank, position): the smaller of two is the lower rank, then the left one.
    tree = [none] * (2 * width)
    for i in range(n - 1):
        if found := pairs.get((symbols[i], symbols[i + 1])):
            tree[width + i] = (found[0], i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int) -> None:
        j = after[i] if symbols[i] >= 0 else n
        found = pairs.get((symbols[i], symbols[j])) if j < n else None
        k = width + i
        tree[k] = (found[0], i) if found else none
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    while tree[1] != none:
        i = tree[1][1]
        j = after[i]
        symbols[i], symbols[j] = pairs[symbols[i], symbols[j]][1], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j)
        put(i)
        if before[i] >= 0:
            put(before[i])
    return [s for s in symbols if s >= 0]


class Bpe:
    """Encoder and decoder of one vocabulary file (the JSON form of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = ids[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.pairs.values()], np.int64)[order]
        self.merged = np.array([m for _, m in self.pairs.values()], np.int64)[np.argsort([r for r, _ in self.pairs.values()])]
        self.known: dict[str, bytes] = {}  # ids as 4 bytes each
        self.plain = regex.compile(PATTERN)
        self.differing: dict[int, str] | None = None
        self.beyond = regex.compile(f"[{chr(SETTLED)}-{chr(0x10FFFF)}]")
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def stand_ins(self) -> dict[int, str]:
        """For code points on which the installed regex tables and the tokenizer differ: a character of
        the tokenizer's class (letter, number, space or other) that the pattern treats alike."""
        if self.differing is None:
            from tokenizers import Tokenizer

            split = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
            points = [c for c in range(SETTLED, 0x40000) if not 0xD800 <= c < 0xE000]

            def joined(sign: str) -> set[int]:
                """The code points that stay in one piece with ``sign``."""
                pieces = split("\n".join(sign + chr(c) for c in points))
                long = {start for _, (start, end) in pieces if end - start == 2}
                return {c for k, c in enumerate(points) if 3 * k in long}

            classes = [(joined("a"), r"\p{L}", "\u00c0"), (joined("1"), r"\p{N}", "9"), (joined("!"), r"[^\s\p{L}\p{N}]", "!")]
            everywhere = set().union(*(x[0] for x in classes))
            classes.append((set(points) - everywhere, r"\s", "\t"))
            self.differing = {}
            for own, pattern, sign in classes:
                here = regex.compile(pattern)
                self.differing |= {c: sign for c in own if not here.match(chr(c))}
        return self.differing

    def pieces(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.plain.findall(text)
        plain = text.translate(self.stand_ins())
        if plain == text:
            return self.plain.findall(text)
        return [text[m.start() : m.end()] for m in self.plain.finditer(plain)]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Like merge_by_tree for pieces of at most SHORT bytes, one tree in each row; the ids as 4 bytes each."""
        rows, longest = len(pieces), max(map(len, pieces))
        width = 1 << max(1, (longest - 1).bit_length())
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        symbols = np.where(np.arange(width) < lengths[:, None], self.of_byte[raw], -1)
        after = np.tile(np.arange(1, width + 1), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        # A node is rank * SHORT + position, so the smallest is the leftmost of the lowest rank.
        tree = np.full((rows, 2 * width), NONE * SHORT, np.int64)
        tree[:, width : 2 * width - 1] = self.ranks_of(symbols[:, :-1], symbols[:, 1:]) * SHORT + np.arange(width - 1)
        tree[:, width:][tree[:, width:] >= NONE * SHORT] = NONE * SHORT
        k = width
        while k > 1:
            k >>= 1
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        live = np.flatnonzero(tree[:, 1] < NONE * SHORT)

        def put(at: np.ndarray, i: np.ndarray) -> None:
            j = after[at, i]
            right = np.where(j < width, symbols[at, np.minimum(j, width - 1)], -1)
            rank = self.ranks_of(symbols[at, i], right)
            tree[at, width + i] = np.where(rank < NONE, rank * SHORT + i, NONE * SHORT)
            node = width + i
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])

        while len(live):
            best = tree[live, 1]
            i = best % SHORT
            j = after[live, i]
            symbols[live, i] = self.merged[best // SHORT]
            symbols[live, j] = -1
            follower = after[live, j]
            after[live, i] = follower
            inside = follower < width
            before[live[inside], follower[inside]] = i[inside]
            put(live, j)
            put(live, i)
            left = before[live, i]
            has = left >= 0
            if has.any():
                put(live[has], left[has])
            live = live[tree[live, 1] < NONE * SHORT]
        flat = symbols[symbols >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum((symbols >= 0).sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of pieces into the table."""
        if len(self.known) > MEMORY:
            self.known = {}
        by_width: dict[int, list[str]] = {}
        for p in pieces:
            if p not in self.known:
                raw = p.encode()
                if len(raw) > SHORT:
                    ids = merge_by_tree(self.of_byte[np.frombuffer(raw, np.uint8)].tolist(), self.pairs)
                    self.known[p] = np.array(ids, "<u4").tobytes()
                else:
                    by_width.setdefault(max(2, (len(raw) - 1).bit_length()), []).append(p)
        for group in by_width.values():
            for at in range(0, len(group), 20_000):
                some = group[at : at + 20_000]
                self.known.update(zip(some, self.merge_many([p.encode() for p in some])))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):  # some millions of characters at a time
            stop, chars = at, 0
            while stop < len(texts) and (chars < 2_000_000 or stop == at):
                chars += len(texts[stop])
                stop += 1
            split = []
            for text in texts[at:stop]:
                parts = self.splitter.split(text) if self.splitter else [text]
                split.append([(p, None) if k % 2 else (None, self.pieces(p)) for k, p in enumerate(parts)])
            self.learn(set(chain.from_iterable(pieces for doc in split for _, pieces in doc if pieces)))
            known = self.known
            for doc in split:
                ids = [
                    np.array([self.special[s]], "<u4").tobytes() if s is not None else b"".join(map(known.__getitem__, pieces))
                    for s, pieces in doc
                ]
                out.append(np.frombuffer(b"".join(ids), "<u4"))
            at = stop
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The vocabulary, read once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file on the machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = True
) -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the ids (little-endian unsigned 32-bit), SHA-256 of the
    text decoded from them, and with ``keep_ids`` the ids themselves."""
    workers(df.sparkSession)
    key_type = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or vocabulary())
        for batch in batches:
            found = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            columns = [
                batch.column(0),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in found], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(df[id_col], df[text_col]).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The rows with a column ``decoded``: the text of the ids (null ids count as none)."""
    workers(df.sparkSession)

    @F.pandas_udf("string")
    def text_of(ids):
        bpe = loaded(path or vocabulary())
        return ids.map(lambda x: bpe.decode(np.asarray([] if x is None else x, np.int64)))

    return df.withColumn("decoded", text_of(df[ids_col]))
