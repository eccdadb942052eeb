"""Quality classifier by co-training of two views.

The content view sees the text: shares of bigrams of character classes and of
repeated words.  The metadata view sees what a crawler knows of a page: language,
source, size and line layout.  Each view has a logistic classifier (numpy).  In each of
``ROUNDS`` rounds the executors score every document whose label isn't used by both classifiers,
and each classifier hands the ``GIVEN`` of which it is most confident, of both classes
as they occur, to the other one's training set.  Each view is then calibrated by Platt scaling on labelled rows kept aside, and
the calibrated log-odds are averaged, weighted by how well each view separates them.

Bounds (documented parameters): the classifiers are fitted on at most
``max_labelled`` labelled rows, those with the smallest hash of their id, and on what
the rounds hand over; copies of one text, language and source are handed over once.
Labels of rows with crc32(id as text) mod 5 = 0 are never used.
Every document is scored.

Defined cases: null text, language or source count as empty; null ids have no label; a
null label counts as none; of several label rows of one id the smallest counts; with
labels of one class only (or none) nothing is rejected; repeated rows score alike; very
long texts are scored whole; an empty table gives an empty result; extra columns are
ignored by :func:`score` and carried by :func:`keep_good`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.llm.common import fresh, stored, workers
from firmscope.llm.toxicity import held_out

MAX_LABELLED = 4_000
ROUNDS, GIVEN, CONFIDENT = 3, 300, 0.95
BUCKETS = 64  # hashed languages and sources

#: Character classes of UTF-8 bytes: signs by themselves, then lower, upper, digit, space, line end, other, non-ASCII.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER, UPPER, DIGIT, SPACE, LINE, OTHER, WIDE = range(len(SIGNS), len(SIGNS) + 7)
CLASSES = len(SIGNS) + 7
CLASS_OF = np.full(256, OTHER, np.int64)
CLASS_OF[[ord(c) for c in SIGNS]] = np.arange(len(SIGNS))
CLASS_OF[ord("a") : ord("z") + 1] = LOWER
CLASS_OF[ord("A") : ord("Z") + 1] = UPPER
CLASS_OF[ord("0") : ord("9") + 1] = DIGIT
CLASS_OF[[ord(" "), ord("\t")]] = SPACE
CLASS_OF[ord("\n")] = LINE
CLASS_OF[128:] = WIDE
WIDE_VIEW = CLASSES * CLASSES + 3  # numbers of the content view


def content_view(text: str | None) -> np.ndarray:
    """Shares of class bigrams (square roots), share of distinct words and of words that repeat the one before."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    c = CLASS_OF[raw]
    pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES) if len(c) > 1 else np.zeros(CLASSES * CLASSES)
    words = (text or "").lower().split()
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    distinct = len(set(words))
    extra = [distinct / max(1, len(words)), repeats / max(1, len(words)), np.log1p(distinct) / 10]
    return np.concatenate([np.sqrt(pairs / max(1, len(c) - 1)), extra])


def metadata_view(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Hashed language and source, size, number and lengths of lines, word length."""
    where = np.zeros(2 * BUCKETS)
    where[zlib.crc32((lang or "").encode()) % BUCKETS] = 1
    where[BUCKETS + zlib.crc32((source or "").encode()) % BUCKETS] = 1
    text = text or ""
    lengths = np.array([len(x) for x in text.split("\n")], float)
    spaces = text.count(" ") + 1
    sizes = [
        np.log1p(len(text)) / 10,
        np.log1p(len(lengths)) / 10,
        np.log1p(lengths.mean()) / 10,
        np.log1p(lengths.max()) / 10,
        np.log1p(lengths.std()) / 10,
        float((lengths == 0).mean()),
        np.log1p(len(text) / spaces) / 3,
        len(text.encode()) / max(1, len(text)) - 1,
    ]
    return np.concatenate([where, sizes])


def views(text: str | None, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    return content_view(text), metadata_view(text, lang, source)


@dataclass
class View:
    """Standardised logistic classifier with Platt scaling."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.shift, -20, 20)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_view(x: np.ndarray, y: np.ndarray, before: View | None = None, steps: int = 100, decay: float = 1e-3) -> View:
    """Logistic regression, started from the weights of an earlier fit; the classes weigh as they occur."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    used = scale > 1e-6  # constant columns count for nothing
    z = (x[:, used] - mean[used]) / scale[used]
    w = np.zeros(z.shape[1] + 1, np.float32)
    if before is not None:
        w[:-1], w[-1] = before.weights[used], before.bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        error = (_sigmoid(z @ w[:-1] + w[-1]) - y).astype(np.float32) / len(y)
        g = np.append(error @ z + decay * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(x.shape[1], np.float32)
    weights[used] = w[:-1]
    return View(mean, np.where(used, scale, 1), weights, float(w[-1]))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling with smoothed targets, by Newton steps."""
    margin = view.margin(x)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    design = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(design @ theta)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        theta -= np.clip(np.linalg.solve(hessian, design.T @ (p - target) + 1e-3 * (theta - [1, 0])), -1, 1)
    view.slope, view.shift = float(theta[0]), float(theta[1])


@dataclass
class Model:
    content: View | None
    metadata: View | None
    weight: float = 0.5  # of the content view

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by each view and together."""
        if self.content is None or self.metadata is None:
            return (np.ones(len(content)),) * 3
        a, b = self.content.log_odds(content), self.metadata.log_odds(metadata)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.weight * a + (1 - self.weight) * b)


#: Takes the fitted views and the class shares, returns per view the rows handed over by it: (content, metadata, label).
Handover = Callable[[list[View], float], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, hand_over: Handover, rounds: int = ROUNDS) -> Model:
    """``labelled`` is a pair (content, metadata) of feature matrices."""
    if len(set(y.tolist())) < 2:
        return Model(None, None)
    aside = np.arange(len(y)) % 4 == 0  # the rows come in hash order
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    xs = [[v[~aside]] for v in labelled]
    ys = [[y[~aside]], [y[~aside]]]
    fitted = [fit_view(xs[k][0], ys[k][0]) for k in (0, 1)]
    for _ in range(rounds):
        given = hand_over(fitted, float(y.mean()))
        for k, rows in enumerate(given):  # what view k is sure of teaches the other one
            xs[1 - k].append(rows[1 - k])
            ys[1 - k].append(rows[2])
        fitted = [fit_view(np.concatenate(xs[k]), np.concatenate(ys[k]), fitted[k], 40) for k in (0, 1)]
        if not any(len(rows[2]) for rows in given):
            break
    check = aside if aside.any() else ~aside
    quality = []
    for k in (0, 1):
        calibrate(fitted[k], labelled[k][check], y[check])
        p = _sigmoid(fitted[k].log_odds(labelled[k][check]))
        loss = -np.mean(y[check] * np.log(p + 1e-9) + (1 - y[check]) * np.log(1 - p + 1e-9))
        base = np.clip(y[check].mean(), 1e-3, 1 - 1e-3)
        explained = max(0.01, 1 - loss / -(base * np.log(base) + (1 - base) * np.log(1 - base)))
        quality.append(explained / (1.02 - explained))  # a view that explains nearly all weighs most
    return Model(fitted[0], fitted[1], quality[0] / sum(quality))


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    given: int = GIVEN,
    rounds: int = ROUNDS,
) -> Model:
    workers(df.sparkSession)
    known = (
        labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y"))
        .filter("id IS NOT NULL AND y IS NOT NULL")
        .groupBy("id")
        .agg(F.min("y").alias("y"))
    )
    order = [F.xxhash64(F.col("id")), F.col("id")]
    usable = known.filter(~held_out(F.col("id"))).orderBy(*order).limit(max_labelled)
    rows = df.select(
        df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].alias("lang"), df[source_col].alias("source")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [views(*row) for row in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            packed = [np.concatenate(v).astype(np.float32).tobytes() for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["label", "x"])

    def features(some: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature matrices and labels of a bounded number of rows (place, label, text, lang, source), in the order of place."""
        found = stored(some.select("place", "text", "lang", "source").mapInArrow(extract, "label string, x binary"), "quality-rows").collect()
        found.sort()
        x = np.stack([np.frombuffer(r.x, np.float32) for r in found]) if found else np.zeros((0, WIDE_VIEW + 2 * BUCKETS + 8), np.float32)
        return x[:, :WIDE_VIEW], x[:, WIDE_VIEW:], np.array([float(r.label[-1]) for r in found])

    def place(first: Column, label: Column) -> Column:
        """Sorts by ``first`` and ends with the label, 0 or 1."""
        return F.concat(F.hex(first), F.lit(" "), label.cast("string"))

    drawn = F.broadcast(stored(usable.select("id", "y"), "quality-drawn"))  # bounded by max_labelled, so no text is shuffled for it
    once = rows.join(drawn, "id").groupBy("id", "y").agg(F.min(F.struct("text", "lang", "source")).alias("row"))  # of rows that share an id, one counts
    content, metadata, y = features(once.select(place(F.xxhash64("id"), F.col("y")).alias("place"), "row.*"))

    # Every row whose label isn't used; rows of one text, language and source are one, known by their hash.
    identity = F.xxhash64("text", "lang", "source")
    pool = rows.join(drawn.select("id"), "id", "left_anti").select(identity.alias("row"), "text", "lang", "source")
    gone: set[int] = set()  # handed over before: at most 2 * given a round

    def hand_over(fitted: list[View], share: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        edge = float(np.log(CONFIDENT / (1 - CONFIDENT)))
        quota = {1: max(1, int(given * share)), 0: max(1, int(given * (1 - share)))}

        def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The task's surest rows of each view and class: view, label, margin, row."""
            best: dict[tuple[int, int], list[tuple[float, int]]] = {(k, label): [] for k in (0, 1) for label in (0, 1)}
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = list(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))))
                for at in range(0, len(ids), 256):
                    found = [views(*row) for row in texts[at : at + 256]]
                    for k in (0, 1):
                        margins = fitted[k].margin(np.stack([f[k] for f in found])).tolist()
                        for row, margin in zip(ids[at : at + 256], margins):
                            if abs(margin) >= edge and row not in gone:
                                best[k, int(margin > 0)].append((-abs(margin), row))
                for (_, label), held in best.items():
                    if len(held) > 4 * quota[label]:
                        held[:] = sorted(set(held))[: quota[label]]
            out = [(k, label, -m, row) for (k, label), held in best.items() for m, row in sorted(set(held))[: quota[label]]]
            columns = list(zip(*out)) or [[], [], [], []]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["view", "label", "margin", "row"])

        surest = stored(pool.mapInArrow(sure, "view int, label int, margin double, row long").distinct(), "quality-sure")
        chosen = []
        for k in (0, 1):
            for label in (0, 1):
                of_class = surest.filter(f"view = {k} AND label = {label}")
                chosen += of_class.orderBy(F.desc("margin"), "row").limit(quota[label]).collect()
        gone.update(r.row for r in chosen)
        if not chosen:
            return [(content[:0], metadata[:0], y[:0])] * 2
        taken = df.sparkSession.createDataFrame([(r.view, r.label, r.row) for r in chosen], "view int, label int, row long")
        texts = pool.join(F.broadcast(taken), "row").groupBy("view", "label", "row").agg(F.min(F.struct("text", "lang", "source")).alias("x"))
        texts = stored(texts.select("view", place(F.col("row"), F.col("label")).alias("place"), "x.*"), "quality-taken")
        return [features(texts.filter(F.col("view") == k)) for k in (0, 1)]

    return co_train((content, metadata), y, hand_over, rounds)


def score(
    df: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    threshold: float = 0.5,
) -> DataFrame:
    """Per row: id, held_out, probability of good quality by content, by metadata and together, kept."""
    workers(df.sparkSession)
    key_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            rows = list(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))))
            for at in range(0, len(rows), 256):
                found = [views(*row) for row in rows[at : at + 256]]
                parts.append(model.score(np.stack([a for a, _ in found]), np.stack([b for _, b in found])))
            columns = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], names=["doc_id", "p_content", "p_metadata", "score"]
            )

    scored = df.select(df[id_col], df[text_col], df[lang_col], df[source_col]).mapInArrow(
        run, f"doc_id {key_type}, p_content double, p_metadata double, score double"
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "p_content", "p_metadata", "score",
        (F.col("score") >= threshold).alias("kept"),
    )


def keep_good(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """The rows that the classifier doesn't reject, with all their columns."""
    workers(df.sparkSession)

    @F.pandas_udf("double")
    def quality(text, lang, source):
        import pandas as pd

        parts = []
        rows = list(zip(text, lang, source))
        for at in range(0, len(rows), 256):
            found = [views(*(x if isinstance(x, str) else None for x in row)) for row in rows[at : at + 256]]
            parts.append(model.score(np.stack([a for a, _ in found]), np.stack([b for _, b in found]))[2])
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    score_col = fresh(df, "quality_score")
    scored = df.withColumn(score_col, quality(df[text_col], df[lang_col], df[source_col]))
    return scored.filter(F.col(score_col) >= threshold).drop(score_col)
