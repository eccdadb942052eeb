"""Collocations against counting in plain Python."""

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import types as T

from firmscope.llm import catalog, collocations
from tests.conftest import SF_ORACLE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=3, least=10, absorb=50, top=2000):
    """The result for [(lang, text)]."""
    by_lang = {}
    for lang, text in rows:
        f = by_lang.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in by_lang.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                gone |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= absorb * f[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in gone:
                s, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    return sorted(map(tuple, df.collect()))


def test_query_matches_plain_python(spark):
    documents = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("lang", "text").collect()
    want = plain(documents)
    assert len(want) > 1000
    assert rows_of(catalog.queries()["op13_collocations"](spark, SF_ORACLE)) == want


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "Ünder", "文字", "a b", "x'", "of", "c++", "\x1c", "–"]
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", ";", "\x0b", "!"]) for _ in range(rng.randrange(40)))
        yield rng.choice(["en", "en", "en", "de", None, "und", ""]), rng.choice([text, text, text * 3, " " + text, None, ""] if k % 9 else [None, ""])


def test_odd_texts_small_blocks_longer_phrases(spark, monkeypatch):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "text", "words", "block", "key")])
    rows = list(corpus(4))
    monkeypatch.setattr(collocations, "HELD_ROWS", 3)
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], schema).repartition(7)
    for options in ({}, {"longest": 2}, {"longest": 5, "least": 3, "absorb": 70}, {"top": 3}):
        assert rows_of(collocations.collocations(df, **options)) == plain(rows, **options), options
    assert rows_of(collocations.collocations(df.limit(0))) == []
    assert rows_of(collocations.collocations(spark.createDataFrame([(None, None, "", "", "")] * 3, schema))) == []


def test_slices_don_t_part_words(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 7)
    texts = [t for _, t in corpus(6, 60) if t] + ["", "word" * 10, "\n\n", "a b", "a\nb"]
    block = collocations._Block()
    block.add(texts)
    relation, words, counts = block.row()
    numbers = collocations._unpack(relation)
    pieces = [re.findall("[^\x20\x09]+", p) for t in texts for p in re.split("[.,;:!?\x0a-\x0d]", t.translate(LOWER))]
    got, run = [], []
    for i in [*numbers.tolist(), 0]:
        if i:
            run.append(words[i - 1])
        elif run:
            got.append(run)
            run = []
    assert got == [p for p in pieces if p]
    assert dict(zip(words, counts.tolist())) == Counter(w for p in pieces for w in p)


def test_scores_beyond_64_bits(spark):
    a, left, right = 2**52 + 1, 2**53 + 7, 2**52 + 3
    df = spark.createDataFrame([(1, "en", ["x", "y"], a, [left, a], [right, a])], "id long, lang string, words array<string>, f long, heads array<long>, tails array<long>")
    row = collocations._scored(df, 2).first()
    assert (row.score, row.l, row.r) == (1000000 * a * a // (left * right), left, right)
