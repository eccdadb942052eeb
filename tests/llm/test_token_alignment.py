"""Alignment of two tokenizers against whole-text encoding and plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import catalog, token_alignment
from firmscope.llm.bpe import vocabulary
from tests.conftest import SF_ORACLE

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner(*PATHS)


def tokens(text, libraries, aligner):
    """The ids of both sides, or none, by the libraries over the whole text."""
    if not text:
        return [], []
    a = libraries[0].encode(" " + text, add_special_tokens=False).ids
    b = libraries[1].encode(text)
    for ids, t in ((a, aligner.a), (b, aligner.b)):
        if b"".join(t.bytes_of[i] for i in ids) != (" " + text).encode():
            return [], []
    return a, b


def plain_groups(a, b, aligner):
    """[(ids of A, ids of B)] by walking both sides."""
    out, i, j, at_a, at_b, mine, its = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            mine.append(a[i])
            at_a += len(aligner.a.bytes_of[a[i]])
            i += 1
        else:
            its.append(b[j])
            at_b += len(aligner.b.bytes_of[b[j]])
            j += 1
        if at_a == at_b:
            out.append((mine, its))
            mine, its = [], []
    return out


def plain(rows, libraries, aligner):
    """The query's rows for [(id, text)]."""
    groups = [plain_groups(*tokens(t, libraries, aligner), aligner) for _, t in rows]
    count = Counter((x[-1], y[-1]) for g in groups for x, y in g)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (i, _), g in zip(rows, groups):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        of = [(count[x[-1], y[-1]], best[y[-1]]) for x, y in g]
        out.append(
            (i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(of), sum(n == m for n, m in of), sum(n for n, _ in of),
             hashlib.sha256(said.encode()).hexdigest() if g else "")
        )
    return out


def odd_texts(n, seed):
    rng = random.Random(seed)
    pools = ["ab c\n", "the of and, . 's don't", "文字。、 のa", "0123 \t\r\n", "  　é́", "(a)[b]{c}\r\n  ", "x", "naïve 👍🏽 مرحبا"]
    for _ in range(n):
        pool = rng.choice(pools) + rng.choice(pools)
        yield "".join(rng.choices(pool, k=rng.randrange(1, 120)))


def finished(f):
    text, link = token_alignment.closed_head(f)
    assert not len(f.tail_a) and not len(f.tail_b)
    return (text + f.groups)[:-1].decode(), [*link, *f.links], f.n_a, f.n_b, f.n_groups + 1


def test_chunks_give_the_libraries_tokens(libraries, aligner):
    for text in odd_texts(600, 1):
        a, b = tokens(text, libraries, aligner)
        whole = aligner.fragment(True, text, 0, text, 0)
        assert whole.ok == bool(a), text
        if not a:
            continue
        want = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in plain_groups(a, b, aligner))
        assert finished(whole)[0] == want, text
        for size in (1, 3, 10):
            parts = [aligner.fragment(*c) for c in aligner.chunks(text, size)]
            found = parts[0]
            for p in parts[1:]:
                found = token_alignment.compose(found, p)
            assert finished(found) == finished(whole), (size, text)


def test_composition_is_associative(aligner):
    rng = random.Random(2)
    same = lambda f: [x.tolist() if hasattr(x, "tolist") else x for x in (getattr(f, n.name) for n in token_alignment.fields(f))]
    opened = 0
    for text in odd_texts(300, 3):
        parts = [aligner.fragment(*c) for c in aligner.chunks(text, rng.randrange(1, 6))]
        opened += any(len(p.tail_a) != len(p.tail_b) for p in parts)
        unit = token_alignment.Fragment()
        for x, y, z in zip(parts, parts[1:], parts[2:]):
            left = token_alignment.compose(token_alignment.compose(x, y), z)
            assert same(left) == same(token_alignment.compose(x, token_alignment.compose(y, z)))
            if x.ok:
                assert same(token_alignment.compose(unit, x)) == same(x) == same(token_alignment.compose(x, unit))
    assert opened  # the byte ranges really have open ends


def test_every_character_is_cut_alike(libraries, aligner):
    """Units and library agree for every code point between letters, digits and signs."""
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        text = "".join(f"a{c}b 1{c}2 .{c}! {c}{c}" for c in points[at : at + 4000] if c != "▁")
        a = libraries[0].encode(" " + text, add_special_tokens=False).ids
        parts = list(aligner.chunks(text, 500))
        assert [i for begins, part, *_ in parts for i in aligner.a.encode(part, begins).tolist()] == a
        b = libraries[1].encode(text)
        assert [i for begins, _, _, part, _ in parts for i in aligner.b.encode(part, begins).tolist()] == b


def test_query_matches_plain_python(spark, libraries, aligner):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.queries()["op12_alignment"](spark, SF_ORACLE).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, libraries, aligner))


def test_long_texts_odd_texts_nulls_and_repeats(spark, libraries, aligner, monkeypatch):
    monkeypatch.setattr(token_alignment, "FAN", 3)
    rng = random.Random(7)
    long = " ".join("".join(rng.choices("abcdefgh文字。,'\n", k=rng.randrange(1, 12))) for _ in range(4000))
    rows = [(1, long), (2, None), (3, ""), (None, "no id"), (4, "same text"), (4, "same text"), (5, "a▁b " * 400), (6, "x" * 3000)]
    rows += [(7, "<|endoftext|></s><0x0A>"), (8, " "), (9, "\n"), (10, "文字" * 700), *((100 + k, t) for k, t in enumerate(odd_texts(60, 9)))]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("pairs", T.StringType())])
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    want = sorted(map(str, plain(rows, libraries, aligner)))
    assert sorted(str(tuple(r)) for r in token_alignment.align(df, chunk=64).collect()) == want
    assert sorted(str(tuple(r)) for r in token_alignment.align(df.repartition(5)).collect()) == want
    empty = token_alignment.align(df.limit(0))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"
    only = token_alignment.align(df.filter(F.col("text").isNull())).collect()
    assert [tuple(r) for r in only] == [(2, 0, 0, 0, 0, 0, 0, "")]
