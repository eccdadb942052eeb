"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive sample; the unlabelled sample is drawn
from the labelled rows without looking at their labels.  Linear classifiers are
trained with numpy on the non-negative risk estimator

    R = prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with logistic loss: when the corrected negative risk falls below zero, the step goes
against it.  Several classifiers, each on a bootstrap of the unlabelled sample, are
averaged.  A document's features are counts, over its distinct words, of whole words
and of character 4- and 5-grams, over the whole word however long; those that are
significantly more frequent among the positives than in the sample, and three times as
frequent as the prior implies for negatives, are used.  So a text's score is a sum over its distinct words, and
scoring looks each word up once.

Bounds (documented parameters): at most ``max_positive`` and ``max_unlabelled`` rows,
those with the smallest hash of their id, are used to fit; the prior is the share of
toxic rows among all labelled training rows.  Rows with crc32(id as text) mod 5 = 0 are
held out: neither their labels nor their texts are used to fit.  Language, source,
labels and id are no inputs of a score.

Defined cases: a null or empty text scores as a text without words; null ids are not
held out and have no label; a null label counts as none; of several label rows of one
id the largest label counts; without any positive row every score is the prior;
repeated rows score alike; very long texts are scored whole; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.llm.common import stored, workers

MAX_POSITIVE, MAX_UNLABELLED = 3_000, 6_000
BAGS, STEPS, RATE, LASSO = 3, 300, 0.05, 3e-4
MIN_Z, MIN_COUNT, MAX_FEATURES = 5.0, 5, 4_000
MEMORY = 200_000  # words whose scores a task remembers

LONG = 62  # characters; words above are not remembered

WORD = re.compile(r"\w+")
#: Thai to Burmese, Khmer, kana and Chinese characters.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[int]:
    """Fingerprints of a word and its character 4- and 5-grams, with the word's ends marked.

    A run of over ``LONG`` characters is rather a text without spaces: it also has the features of its parts between
    underscores and, as words, the stretches of 2 and 3 characters in scripts that don't part words.
    """
    found = _marked(word)
    if len(word) > LONG:
        for part in set(filter(None, word.split("_"))):
            found |= _marked(part)
        for run in SPACELESS.findall(word):
            found |= {f"={run[i : i + n]}" for n in (2, 3) for i in range(len(run) - n + 1)}
    return [xxhash.xxh32_intdigest(g) for g in found]


def _marked(word: str) -> set[str]:
    marked = f"^{word}$"
    return {f"={word}", *(marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1))}


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def word_score(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features_of(word))

    def scores(self, texts: list[str | None], known: dict[str, float]) -> list[float]:
        out = []
        for text in texts:
            words = words_of(text)
            if len(known) > MEMORY:
                known.clear()
            known.update((w, self.word_score(w)) for w in words if len(w) <= LONG and w not in known)
            each = [known[w] if len(w) <= LONG else self.word_score(w) for w in words]
            z = self.bias + sum(sorted(each))  # sorted: the same sum for equal texts
            out.append(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
        return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, chosen: np.ndarray, seed: int = 7) -> Model:
    """Weights of the ``chosen`` features from those of each document (one array per document, repeats count)."""
    floor = float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999))))
    if not positive or not unlabelled:
        return Model({}, min(floor, -0.1))
    column = {f: i for i, f in enumerate(chosen.tolist())}
    xp, xu = _rows(positive, chosen), _rows(unlabelled, chosen)
    rng = np.random.default_rng(seed)
    total, bias = np.zeros(len(chosen)), 0.0
    for _ in range(BAGS):
        bag = rng.integers(0, len(unlabelled), len(unlabelled))
        weights = np.bincount(bag, minlength=len(unlabelled)) / len(unlabelled)
        w, b = _nnpu(xp, xu, weights, prior, floor, len(chosen))
        total += w / BAGS
        bias += b / BAGS
    return Model({f: float(total[i]) for f, i in column.items() if total[i]}, bias)


def significant(sample: DataFrame, prior: float) -> tuple[np.ndarray, dict[int, int]]:
    """Features that are more frequent among the positives (part 1) than in the unlabelled rows (part 0), by
    the z score of the two shares; at most ``MAX_FEATURES`` come to the driver.  Also the rows of each part.

    They must also be three times as frequent as among the negatives, whose share the prior implies.
    """
    sizes = {r.part: r["count"] for r in sample.groupBy("part").count().collect()}
    if 0 not in sizes or 1 not in sizes:
        return np.empty(0, np.uint32), sizes

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
            part = np.repeat(batch.column(0).to_numpy(), [len(d) for d in docs]).astype(np.int64)
            doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            flat = np.concatenate(docs) if docs else np.empty(0, np.uint32)
            order = np.lexsort((flat, doc))
            once = np.ones(len(flat), bool)  # a document's first of each feature
            once[1:] = (flat[order][1:] != flat[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            held, counts = np.unique(flat[order][once].astype(np.int64) * 2 + part[order][once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(held // 2), pa.array(held % 2), pa.array(counts.astype(np.int64))], names=["feature", "part", "n"])

    p, u = (F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)) for k in (1, 0))
    found = sample.mapInArrow(holders, "feature long, part long, n long").groupBy("feature").agg(p.alias("p"), u.alias("u")).filter(F.col("p") >= MIN_COUNT)
    n, m = float(sizes[1]), float(sizes[0])
    a, b, pooled = F.col("p") / n, F.col("u") / m, (F.col("p") + F.col("u")) / (n + m)
    z = (a - b) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n + 1 / m))
    negative = F.greatest(b - prior * a, F.lit(0.0)) / max(1 - prior, 1e-3)
    good = found.withColumn("z", z).filter((F.col("z") >= MIN_Z) & (a >= 3 * negative))
    rows = good.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature").collect()
    return np.sort(np.array([r.feature for r in rows], np.uint32)), sizes


def _rows(docs: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column numbers of the chosen features (repeats count)."""
    if not len(chosen):
        return np.empty(0, np.int64), np.empty(0, np.int64), len(docs)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.concatenate(docs)
    at = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
    hit = chosen[at] == flat
    return row[hit], at[hit], len(docs)


def _nnpu(xp, xu, unlabelled_weights, prior: float, floor: float, n: int) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk, with a proximal step for the absolute values of the weights."""
    w = np.zeros(n + 1)
    w[n] = floor
    m, v = np.zeros(n + 1), np.zeros(n + 1)

    def margin(x):
        return np.bincount(x[0], w[x[1]], x[2]) + w[n]

    def gradient(x, by_row):
        return np.append(np.bincount(x[1], by_row[x[0]], n), by_row.sum())

    used = np.ones(n, bool)
    for step in range(1, 2 * STEPS + 1):
        if step == STEPS + 1:  # the features that were left are fitted once more, without the pull to zero
            used = w[:n] != 0
        zp, zu = margin(xp), margin(xu)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
        negative = (unlabelled_weights * np.logaddexp(0, zu)).sum() - prior * np.logaddexp(0, zp).mean()
        g_negative = gradient(xu, unlabelled_weights * su) - prior * gradient(xp, sp / len(zp))
        if negative >= 0:
            g = prior * gradient(xp, (sp - 1) / len(zp)) + g_negative
        else:
            g = -g_negative
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        g[:n] *= used
        each = RATE / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= each * (m / (1 - 0.9**step))
        if step <= STEPS:  # chance features go to zero
            w[:n] = np.sign(w[:n]) * np.maximum(np.abs(w[:n]) - LASSO * each[:n], 0)
        else:
            w[:n] *= used
    return w[:n], float(w[n])


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    workers(df.sparkSession)
    known = (
        labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y"))
        .filter("id IS NOT NULL AND y IS NOT NULL")
        .filter(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    share = known.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    order = [F.xxhash64(F.col("id")), F.col("id")]
    drawn = (
        known.filter("y = 1").orderBy(*order).limit(max_positive).select("id", F.lit(1).alias("part"))
        .union(known.orderBy(*order).limit(max_unlabelled).select("id", F.lit(0).alias("part")))
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found: list[int] = []
                for word in words_of(text):
                    if len(word) > LONG:
                        found += features_of(word)
                        continue
                    if word not in cache:
                        if len(cache) > MEMORY // 10:
                            cache.clear()
                        cache[word] = features_of(word)
                    found += cache[word]
                rows.append(np.sort(np.array(found, np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["part", "features"])

    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    # The drawn ids are bounded by the two parameters, so they may be broadcast; of rows that share one, one counts.
    drawn_rows = texts.join(F.broadcast(drawn), "id").groupBy("part", "id").agg(F.min("text").alias("text")).select("part", "text")
    sample = stored(drawn_rows.mapInArrow(extract, "part int, features binary"), "toxicity-sample")
    chosen, _ = significant(sample, share)

    def only_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
            kept = [d[np.isin(d, chosen)].tobytes() for d in docs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["part", "features"])

    parts: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for row in sample.mapInArrow(only_chosen, "part int, features binary").collect():  # of chosen features only
        parts[row.part].append(np.frombuffer(row.features, np.uint32))
    for rows in parts.values():
        rows.sort(key=lambda x: (len(x), x.tobytes()))  # the order of arrival must not matter
    return fit(parts[1], parts[0], share, chosen)


def score(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 from 0.5)."""
    workers(df.sparkSession)
    key_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores = model.scores(batch.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = df.select(df[id_col], df[text_col]).mapInArrow(run, f"doc_id {key_type}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
