"""Secret scan: three base patterns, and character Markov models compared by log-likelihood ratio.

Two kinds of character bigram models are trained: one of ordinary text and
identifiers, from every text of the table outside the base matches (its words as
they stand and joined to identifiers, paths, host names and slugs), and one of random strings for each alphabet
(hexadecimal, base 32, base 62 with signs, base 64, all signs), from
labelled samples: the values of the base matches, sorted by alphabet, and
``SAMPLES`` strings drawn from a seeded generator.  Candidates are the runs of the
largest alphabet and, as '/' and '.' also part paths and names, every stretch of a run
between two of these signs; a span neither starts nor ends with one.  A stretch of at
least ``min_length`` characters is a secret when the best random model beats the
ordinary one by ``threshold`` nats a character; no other rule drops one (of a run of
digits the ratio stays low where the texts have numbers).  Of the stretches of a
run the disjoint ones that are likeliest in all are taken, so a path around a key is left out and
the pieces of a key stay together.  Bigram
counts are summed in Spark; only the alphabet-sized matrices reach the driver.

Base matches are the leftmost non-overlapping ones of each kind; those that are
too short are dropped after matching.  Offsets are code points, ends exclusive; a
span of kind ``assign`` is the whole match.  A piece between '/' and '.' that touches
a base span adds nothing.

Defined cases: null texts count as empty and have no spans; repeated rows are
scanned one by one; very long texts are scanned whole; an empty table gives an
empty result (the models then rest on the generated strings and smoothing); extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.llm.common import workers

# The base patterns and the shortest values that count.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # [0-9a-f]+ without its matches of under 24 characters
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex", "markov")

RUN = r"[A-Za-z0-9+/_.=-]{%d,}"
PIECE = re.compile(r"[A-Za-z0-9+_=-]+")
SPLITS, SIGNS = "/.", "+/_.=-"
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + SIGNS
SIZE = len(SYMBOLS) + 1  # the last class stands for everything else, so also for the ends of a token
SPACE = SIZE  # in counts of ordinary text, the space has a class of its own
CLASS_OF = np.full(256, SIZE - 1, np.int64)
CLASS_OF[[ord(c) for c in SYMBOLS]] = np.arange(SIZE - 1)
SPACED_OF = CLASS_OF.copy()
SPACED_OF[ord(" ")] = SPACE
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base62": SYMBOLS[:62] + "-_",
    "base64": SYMBOLS[:62] + "+/=",
    "signs": SYMBOLS,  # all that the value of a base match may have
}
SAMPLES, SAMPLE_LENGTH, SEED = 2_000, 32, 20_240_601


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def classes(text: str) -> np.ndarray:
    return CLASS_OF[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def bigrams(text: str) -> np.ndarray:
    c = classes(f" {text} ")
    return np.bincount(c[:-1] * SIZE + c[1:], minlength=SIZE * SIZE)


def spaced_bigrams(text: str) -> np.ndarray:
    """With the space as a class of its own; the ends of the text are no spaces."""
    c = SPACED_OF[np.frombuffer(f"\n{text}\n".encode("latin-1", "replace"), np.uint8)]
    return np.bincount(c[:-1] * (SIZE + 1) + c[1:], minlength=(SIZE + 1) ** 2)


def ordinary_bigrams(spaced: np.ndarray, camel: np.ndarray) -> np.ndarray:
    """Of ordinary text and of what its words make: snake_case, paths, host names, slugs, CONSTANT_CASE, word2, camelCase.

    Every tenth character may be followed by '/' or '.', and what follows these is half the time a letter or digit
    drawn evenly (dates, numbers and short names in paths).  A sign often stands in rows of its own kind
    (rules, dots, '//'), as often as it is followed by all else.
    """
    spaced = spaced.reshape(SIZE + 1, SIZE + 1)
    counts = camel.reshape(SIZE, SIZE).astype(float)

    def add(space: int, to: np.ndarray | None = None) -> None:
        into = np.append(np.arange(SIZE) if to is None else to, space)
        np.add.at(counts, (into[:, None], into[None, :]), spaced)

    add(SIZE - 1)
    for sign in SIGNS:
        add(CLASS_OF[ord(sign)])
    upper = np.array([CLASS_OF[ord(c.upper())] for c in SYMBOLS] + [SIZE - 1])
    add(CLASS_OF[ord("_")], upper)
    two, under = CLASS_OF[ord("2")], CLASS_OF[ord("_")]
    before, after = np.append(np.arange(SIZE), under), np.append(np.arange(SIZE), two)
    np.add.at(counts, (before[:, None], after[None, :]), spaced)
    counts[two, under] += spaced[:, SPACE].sum()
    for sign in SPLITS:
        at = CLASS_OF[ord(sign)]
        counts[:, at] += counts.sum(axis=1) / 10
        counts[at, :62] += counts[at].sum() / 62 + 1
    for sign in SIGNS:
        at = CLASS_OF[ord(sign)]
        counts[at, at] += counts[at].sum()
    return counts.reshape(-1)


def alphabet_of(value: str) -> str | None:
    """The smallest alphabet that has every character of a value."""
    return next((k for k, chars in ALPHABETS.items() if set(value) <= set(chars)), None)


def base_value(text: str, kind: int, start: int, end: int) -> str:
    return ASSIGN.fullmatch(text, start, end).group(2) if kind == 0 else text[start:end]


@dataclass
class Models:
    """Log transition probabilities."""

    ordinary: np.ndarray
    random: dict[str, np.ndarray]
    threshold: float
    min_length: int

    def ratio(self, token: str) -> float:
        """Nats a character by which the best random model beats the ordinary one."""
        c = classes(token)
        step = (c[:-1], c[1:])
        best = max(float(m[step].sum()) for m in self.random.values())
        return (best - float(self.ordinary[step].sum())) / max(1, len(token) - 1)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The spans that the models find outside of the base spans; one pass over both in text order."""
        taken: list[list[int]] = []  # the base spans, joined where they overlap
        for start, end in sorted((a, b) for a, _, b in base):
            if taken and start < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], end)
            else:
                taken.append([start, end])
        out, at = [], 0
        for m in re.finditer(RUN % max(1, self.min_length), text):
            group: list[tuple[int, int]] = []
            for piece in PIECE.finditer(text, *m.span()):
                start, end = piece.span()
                while at < len(taken) and taken[at][1] <= start:
                    at += 1
                if at < len(taken) and taken[at][0] < end:
                    out += self._spans(text, group)
                    group = []
                else:
                    group.append((start, end))
            out += self._spans(text, group)
        return out

    def _spans(self, text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Secrets among the stretches of neighbouring pieces.

        First the best ones at half the threshold, so that a weak piece of a key stays with the others; those that
        pass are kept, and the rest is searched at the threshold itself, so that no stretch that passes is missed.
        """
        if not pieces or pieces[-1][1] - pieces[0][0] < self.min_length:
            return []
        at = pieces[0][0]
        bounds = np.array(pieces) - at
        c = classes(text[at : pieces[-1][1]])
        step = (c[:-1], c[1:])
        ordinary = self.ordinary[step]
        # Per model: nats by which it beats the ordinary one, from the beginning to each piece's first and last character.
        sums = [np.append(0.0, np.cumsum(m[step] - ordinary))[bounds - (0, 1)] for m in self.random.values()]

        def passes(i: int, j: int) -> bool:
            steps = max(1, pieces[j][1] - pieces[i][0] - 1)
            return max(s[j, 1] - s[i, 0] for s in sums) >= self.threshold * steps

        found = [x for x in self._stretches(bounds, sums, 0, len(pieces), self.threshold / 2) if passes(*x)]
        rest = 0
        for i, j in [*found, (len(pieces), len(pieces))]:
            found += self._stretches(bounds, sums, rest, i, self.threshold)
            rest = j + 1
        joined: list[tuple[int, int]] = []
        for i, j in sorted(found):  # halves of a base 64 key are one secret
            if joined and joined[-1][1] == i - 1 and text[pieces[i - 1][1] : pieces[i][0]] == "/" and passes(joined[-1][0], j):
                i = joined.pop()[0]
            joined.append((i, j))
        return [(pieces[i][0], 3, pieces[j][1]) for i, j in joined]

    def _stretches(self, bounds: np.ndarray, sums: list[np.ndarray], first: int, last: int, price: float) -> list[tuple[int, int]]:
        """Disjoint stretches (first and last piece) with the largest sum of nats less ``price`` a step; one pass over the pieces."""
        spans = bounds[first:last].tolist()
        nats = [(s[first:last] - price * (bounds[first:last] - (0, 1))).tolist() for s in sums]
        best, taken = [0.0], [-1]  # of the pieces before each; the first piece of the stretch that ends there
        begun = [(-np.inf, -1)] * len(nats)
        ready = 0
        for j, (_, end) in enumerate(spans):
            while ready <= j and end - spans[ready][0] >= self.min_length:
                begun = [max(b, (best[ready] - n[ready][0], ready)) for b, n in zip(begun, nats)]
                ready += 1
            most, start = max((b + n[j][1], i) for (b, i), n in zip(begun, nats))
            best.append(max(best[j], most))
            taken.append(start if most >= best[j] else -1)
        out, j = [], len(spans)
        while j > 0:
            if taken[j] >= 0:
                out.append((first + taken[j], first + j - 1))
                j = taken[j]
            else:
                j -= 1
        return out[::-1]


def _log_transitions(counts: np.ndarray) -> np.ndarray:
    counts = counts.reshape(SIZE, SIZE) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def train(
    df: DataFrame, text_col: str = "text", threshold: float = 2.0, min_length: int = 16
) -> Models:
    """Models from all texts of ``df``: ordinary text outside the base matches, base values and generated strings."""
    workers(df.sparkSession)
    sizes = {"ordinary": (SIZE + 1) ** 2, "camel": SIZE**2} | {k: SIZE**2 for k in ALPHABETS}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(n, np.int64) for k, n in sizes.items()}

        def ordinary(text: str) -> None:
            sums["ordinary"] += spaced_bigrams(text)
            sums["camel"] += bigrams(text.title().replace(" ", ""))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                at = 0
                for start, kind, end in base_spans(text):
                    if alphabet := alphabet_of(value := base_value(text, kind, start, end)):
                        sums[alphabet] += bigrams(value)
                    if start > at:
                        ordinary(text[at:start])
                    at = max(at, end)
                ordinary(text[at:])
        for k, v in sums.items():
            seen = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(v[seen])], names=["model", "cell", "n"]
            )

    cells = df.select(df[text_col]).mapInArrow(count, "model string, cell int, n long")
    sums = {k: np.zeros(n) for k, n in sizes.items()}
    for row in cells.groupBy("model", "cell").agg(F.sum("n").alias("n")).collect():  # at most 7 * (SIZE + 1) ** 2 rows
        sums[row.model][row.cell] = row.n
    rng = np.random.default_rng(SEED)
    for k, chars in ALPHABETS.items():
        drawn = rng.integers(0, len(chars), (SAMPLES, SAMPLE_LENGTH))
        for line in drawn:
            sums[k] += bigrams("".join(chars[i] for i in line))
    ordinary = ordinary_bigrams(sums["ordinary"], sums["camel"])
    return Models(_log_transitions(ordinary), {k: _log_transitions(sums[k]) for k in ALPHABETS}, threshold, min_length)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(df: DataFrame, models: Models | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the number of spans of each kind, SHA-256 of the base spans, and all spans."""
    workers(df.sparkSession)
    models = models or train(df, text_col)
    key_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                every = sorted(base + models.added(text or "", base))
                kinds = [kind for _, kind, _ in every]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in range(4)), digest, _joined(every)))
            columns = [list(x) for x in zip(*rows)] or [[] for _ in range(6)]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"],
            )

    return df.select(df[id_col], df[text_col]).mapInArrow(
        run,
        f"doc_id {key_type}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string",
    )
