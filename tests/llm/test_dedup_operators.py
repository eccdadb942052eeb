"""Exact, near and line deduplication and mixing against brute force and SQL."""

import hashlib
import itertools
import math
import os
import random
import re
import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import common, components, exact_dedup, line_dedup, linking, minhash_dedup, mixing
from firmscope.llm.common import table
from firmscope.session import shared_dir
from tests.conftest import SF_SMALL

#: Extra columns carry the names that the operators use inside.
NAMES = ["node", "label", "h", "norm", "copies", "gone", "kept", "a"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(n, T.StringType()) for n in NAMES]
)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *NAMES) for r in rows], SCHEMA)


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


# ---- exact -------------------------------------------------------------------

EXACT = [
    (5, "a b"), (3, "ab"), (9, "a  b"), (8, "a  b"), (1, None), (2, ""), (4, " \n"), (None, "ab"), (None, None),
    (7, "c"), (7, "c"), (6, "z" * 50_000), (10, "a\u00a0b"), (11, "A B"),
]


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        first = True
        for m in sorted(members):
            out.append((m[3], best[3], len(members), first, hashlib.sha256(norm.encode()).hexdigest()))
            first = False
    return sorted(map(repr, out))


@pytest.mark.parametrize("bits", [None, 1])
def test_exact_groups(spark, bits):
    """With a hash of one hexadecimal digit different texts collide, and must stay apart."""
    hash_of = exact_dedup.content_hash if bits is None else (lambda c: F.substring(F.md5(c), 1, bits))
    df = frame(spark, EXACT)
    assert sorted(repr(tuple(r)) for r in exact_dedup.exact_groups(df, hash_of=hash_of).collect()) == exact_by_hand(EXACT)
    stay = exact_dedup.deduplicate(df, hash_of=hash_of)
    assert stay.columns == df.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in stay.collect()]
    assert len(texts) == len(set(texts)) == 6 and all(list(r)[2:] == NAMES for r in stay.collect())
    assert sorted(r.doc_id for r in stay.collect()) == [4, 6, 7, 8, 10, 11]


def test_exact_on_an_empty_table(spark):
    df = frame(spark, [])
    assert exact_dedup.exact_groups(df).count() == 0 and exact_dedup.deduplicate(df).count() == 0


# ---- components --------------------------------------------------------------


def test_components_on_paths_stars_and_random_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 40)]
    edges += [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(150)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    u = Union(600)
    for a, b in edges:
        u.join(a, b)
    least = {}
    for x in {x for e in edges for x in e}:
        least[u.find(x)] = min(least.get(u.find(x), x), x)
    for x in {x for e in edges for x in e}:
        assert got.get(x, x) == least[u.find(x)]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- near --------------------------------------------------------------------


def word_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def near_by_hand(rows, k):
    sets = [word_set(t, k) for _, t in rows]
    u = Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                u.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        least[u.find(i)] = min(least.get(u.find(i), key), key)
    return sorted(repr((d, len(sets[i]), None if least[u.find(i)][0] else least[u.find(i)][1])) for i, (d, _) in enumerate(rows))


def cloud(n, seed, length=150, most=14):
    """Copies of one text with up to ``most`` words changed: many pairs lie just above and below the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(length)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_near_groups_in_a_cloud_of_near_copies(spark):
    rows = cloud(300, 2) + [(1000 + i, t) for i, t in cloud(60, 3, length=40, most=6)]
    got = minhash_dedup.near_groups(frame(spark, rows), words=4).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == near_by_hand(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


NEAR = [
    (5, "one two three four five six"), (3, "One TWO three four\tfive six"), (7, None), (8, ""), (6, "  \n"), (9, "only three words"),
    (2, "only three words"), (None, "only three words"), (None, "nothing like it anywhere else at all"), (4, "é É same"), (10, "É é same"),
    (11, "w " * 30_000), (12, "w " * 30_000 + "v"), (13, "one two"), (13, "one two"),
]


def test_near_groups_cases(spark):
    got = minhash_dedup.near_groups(frame(spark, NEAR), words=4).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == near_by_hand(NEAR, 4)
    stay = minhash_dedup.deduplicate(frame(spark, NEAR), words=4)
    assert stay.columns == ["doc_id", "text", *NAMES]
    assert sorted(r.doc_id or -1 for r in stay.collect()) == [-1, 2, 3, 4, 6, 7, 8, 10, 11, 12, 13]
    assert minhash_dedup.near_groups(frame(spark, [])).count() == 0
    assert minhash_dedup.deduplicate(frame(spark, [])).count() == 0


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    """Null ids, one id for many rows, whole rows repeated: against union-find over all pairs."""
    rng = random.Random(12)
    texts = [t for _, t in cloud(40, 21) + cloud(30, 22, length=60, most=9)] + ["", None, "two words"]
    rows = [(rng.choice([None, None, 1, 2, 3, k]), t) for k, t in enumerate(texts) for _ in range(rng.choice([1, 1, 2]))]
    df = frame(spark, rows).repartition(5)
    stay = [tuple(r) for r in minhash_dedup.deduplicate(df, words=4).select("doc_id", "text").collect()]
    sets = [set(minhash_dedup.shingles(t, 4).tolist()) for _, t in rows]
    u = Union(len(rows))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            u.join(i, j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(u.find(i), []).append(i)
    assert len(stay) == len(groups) < len(rows) - 10
    left = list(stay)
    for members in groups.values():
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in members)
        fitting = [rows[i] for i in members if (rows[i][0] is None, rows[i][0] or 0) == least and rows[i] in left]
        assert fitting, members
        left.remove(fitting[0])
    assert not left


def test_half_keys_of_one_holder_drop_no_shared_table(spark):
    rng = random.Random(3)
    half = [[rng.randrange(40) for _ in range(2 * minhash_dedup.SIDE)] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(half)), "node long, half array<long>")
    keys = {}
    for r in minhash_dedup._table_keys(df).collect():
        keys.setdefault(r.node, set()).add(r.key)
    for i, j in itertools.combinations(range(60), 2):
        a, b = (sum(x == y for x, y in zip(half[i][s], half[j][s])) for s in (slice(0, 10), slice(10, 20)))
        assert len(keys.get(i, set()) & keys.get(j, set())) == a * b


# ---- lines -------------------------------------------------------------------


def line_set(line, k=line_dedup.SHINGLE):
    return frozenset(line[i : i + k] for i in range(len(line) - k + 1)) if len(line) >= k else frozenset([line])


def lines_by_hand(rows):
    """The places of the lines that stay."""
    places = defaultdict(list)
    for d, t in rows:
        for k, line in enumerate([] if t is None else t.split("\n")):
            places[line.strip(" \t\n\x0b\x0c\r")].append((d is None, d or 0, k))
    stay = set(places.pop("", []))
    lines = list(places)
    sets = [line_set(x) for x in lines]
    u = Union(len(lines))
    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                u.join(i, j)
    groups = defaultdict(list)
    for i, x in enumerate(lines):
        groups[u.find(i)] += places[x]
    return stay | {min(v) for v in groups.values()}


def line_rows():
    rng = random.Random(7)
    alphabet = "abcdefghijklmnop "
    base = ["".join(rng.choices(alphabet, k=90)) for _ in range(12)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1])):
                line[rng.randrange(90)] = "é"
            lines.append("".join(line))
        rows.append((d, "\n".join(lines)))
    return rows + [(500, None), (501, "\n\n"), (None, "short"), (502, "short \r"), (503, "q" * 20_000 + "\n" + "q" * 20_000)]


@pytest.mark.parametrize("hot", [False, True])
def test_lines_that_stay(spark, monkeypatch, hot):
    if hot:  # every key counts as hot: salted, and all members go to the search of large buckets
        monkeypatch.setattr(line_dedup, "_hot_keys", lambda counted: counted.limit(2000).collect())
        monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    rows = line_rows()
    got = line_dedup.line_groups(frame(spark, rows)).collect()
    assert len(got) == sum(len(t.split("\n")) for _, t in rows if t is not None)
    assert {(r.doc_id is None, r.doc_id or 0, r.line_no) for r in got if r.kept} == lines_by_hand(rows)


def test_lines_of_documents(spark):
    rows = [(1, "a line to be kept here\nsecond"), (2, "second\n\na line to be kept here!"), (3, None), (4, "second")]
    got = line_dedup.deduplicate(frame(spark, rows))
    assert got.columns == ["doc_id", "text", *NAMES]
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 2: "", 3: None, 4: ""}
    assert line_dedup.line_groups(frame(spark, [])).count() == 0


def test_sets_of_many_lines_are_hashed_together(monkeypatch):
    lines = [line for _, t in line_rows() if t for line in map(str.strip, t.split("\n"))]
    lines += ["", "short", "eight ch", "é" * 70_000, "tail 12345"]
    hashed, calls = line_dedup._shingle_hashes, []
    monkeypatch.setattr(line_dedup, "_shingle_hashes", lambda points: calls.append(len(points)) or hashed(points))
    sets = list(line_dedup.sets_of([x.encode() for x in lines]))
    assert len(calls) <= 3 < len(lines)
    assert list(line_dedup.sets_of([])) == []
    assert [len(x) for x in sets] == [len(line_set(x)) for x in lines]
    for x, y in itertools.islice(itertools.combinations(range(len(lines)), 2), 2000):
        assert len(np.intersect1d(sets[x], sets[y])) == len(line_set(lines[x]) & line_set(lines[y]))


def test_band_keys_do_not_depend_on_the_lines_beside(monkeypatch):
    lines = [x for _, t in line_rows() if t for x in map(str.strip, t.split("\n")) if len(x) >= line_dedup.SHINGLE]
    alone = np.concatenate([line_dedup.band_keys([x]) for x in lines])
    assert (line_dedup.band_keys(lines) == alone).all()
    monkeypatch.setattr(line_dedup, "PIECE", 200)
    assert (line_dedup.band_keys(lines) == alone).all()


def test_copies_lie_anywhere_in_a_bucket(spark):
    rows = [(1, n) for n in (6, 5) * 40] + [(2, 7)] * 50 + [(3, n) for n in list(range(20)) * 3] + [(4, 9)]
    keys = spark.createDataFrame(rows, "key long, node long").repartition(7)
    got = line_dedup._pairs(keys, []).distinct().collect()
    assert {frozenset((r.a, r.b)) for r in got if r.b is not None and not {r.a, r.b} <= set(range(5))} >= {frozenset((5, 6))}
    assert sorted((r.key, r.a) for r in got if r.b is None) == [(3, n) for n in range(20)]
    large = [{r.a, r.b} for r in got if r.b is not None and {r.a, r.b} != {5, 6}]
    assert len(set.intersection(*large)) == 1 and set.union(*large) == set(range(20))  # all with one member


def test_keys_are_dealt_out_packed(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([-(2**63), -5, 0, 7, 2**63 - 1, *range(100, 500)]), rng.randrange(-30, 30)) for _ in range(3000)]
    keys, dealt, by_id = spark.createDataFrame(rows, "key long, node long").repartition(3), [], type(spark.range(0)).repartitionById
    monkeypatch.setattr(type(keys), "repartitionById", lambda df, n, part: dealt.append((n, df.count())) or by_id(df, n, part))
    got = line_dedup._pairs(keys, [7, -5]).collect()
    assert len(dealt) == 1 and dealt[0][1] <= 3 * dealt[0][0] < len(rows)  # a row for each block and part
    buckets = defaultdict(set)
    for key, node in rows:
        buckets[key].add(node)
    large = {k for k, b in buckets.items() if len(b) > linking.SMALL or k in (7, -5)}
    assert large > {7, -5} and len(large) < len(buckets)
    assert sorted((r.key, r.a) for r in got if r.b is None) == sorted((k, node) for k in large for node in buckets[k])
    want = {frozenset(p) for k, b in buckets.items() if k not in large for p in itertools.combinations(b, 2)}
    pairs = {frozenset((r.a, r.b)) for r in got if r.b is not None}
    want |= {frozenset((min(buckets[k]), x)) for k in large - {7, -5} for x in buckets[k] - {min(buckets[k])}}
    assert all(r.key is None and r.a != r.b for r in got if r.b is not None) and pairs >= want
    assert all(p <= buckets[7] or p <= buckets[-5] for p in pairs - want)


def test_texts_give_their_keys_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 50)
    rows = line_rows()
    keys = defaultdict(set)
    for line in {x for _, t in rows if t for x in map(str.strip, t.split("\n")) if len(x) >= line_dedup.SHINGLE}:
        for key in line_dedup.band_keys([line])[0].tolist():
            keys[key].add(line_dedup.node_of(line))
    got = line_dedup._pairs(frame(spark, rows).select("text"), [], line_dedup._line_keys).collect()
    pairs = {frozenset((r.a, r.b)) for r in got if r.b is not None}
    assert {frozenset(p) for b in keys.values() if len(b) <= linking.SMALL for p in itertools.combinations(b, 2)} <= pairs
    assert {(r.key, r.a) for r in got if r.b is None} == {(k, x) for k, b in keys.items() if len(b) > linking.SMALL for x in b}


def test_only_sets_of_large_buckets_are_dealt_out(spark, monkeypatch):
    base = np.arange(100, dtype=np.uint64)
    sets = {n: np.append(base[: 95 - n % 3], 1000 + n).astype(np.uint64) for n in range(12)}
    sets |= {n: np.arange(1000 * n, 1000 * n + 100, dtype=np.uint64) for n in range(20, 120)}
    frame_of = spark.createDataFrame([(n, x.tobytes(), len(x)) for n, x in sets.items()], "node long, values binary, n long")
    members = spark.createDataFrame([(1, n) for n in range(12)], "key long, node long")
    labels = spark.createDataFrame([(1, 0)], "node long, label long")
    kept, keep = {}, linking.stored
    monkeypatch.setattr(linking, "stored", lambda df, name: kept.setdefault(name, keep(df, name)))
    got = linking.close_large(members, labels, frame_of.select("node", "n"), frame_of)
    assert {(r.node, r.label) for r in got.collect()} == {(n, 0) for n in range(1, 12)}
    assert {r.node for r in kept["large-sets"].collect()} == set(range(12))


@pytest.mark.parametrize("values", [1, 150, 1 << 15])
def test_sets_leave_a_task_together(spark, monkeypatch, values):
    monkeypatch.setattr(linking, "VALUES", values)
    # 0 and 1 are linked to the centre, 8 only to 7, which nobody else reaches; 9 is on its own.
    sets = {n: np.append(np.arange(95), 1000 + n).astype(np.uint64) for n in range(3)}
    sets |= {n: np.append(np.arange(500, 595), 1000 + n).astype(np.uint64) for n in (7, 8)}
    sets |= {9: np.arange(2000, 2096, dtype=np.uint64)}
    frame_of = spark.createDataFrame([(n, x.tobytes(), len(x)) for n, x in sets.items()], "node long, values binary, n long").coalesce(1)
    members = spark.createDataFrame([(1, n) for n in sets], "key long, node long")
    got = linking.close_large(members, spark.createDataFrame([(1, 0)], "node long, label long"), frame_of.select("node", "n"), frame_of)
    assert {(r.node, r.label) for r in got.collect()} == {(1, 0), (2, 0), (8, 7)}


@pytest.mark.parametrize("edges", [[(2, 1)], [(2, 1), (3, 1), (9, 8)], [(5, 4), (3, 4), (3, 2), (2, 1), (9, 8), (8, 9)], []])
def test_no_round_confirms_that_stars_are_done(spark, monkeypatch, edges):
    rounds, star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda some: rounds.append(1) or star(some))
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in got) == sorted({n: 8 if n > 7 else 1 for e in edges for n in e if n not in (1, 8)}.items())
    assert len(rounds) == (2 if edges else 0)  # the chain of five took a third one that changed nothing


def scratch_tables(spark):
    root = f"{shared_dir(spark)}/llm".removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_") and name.endswith(".data")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    dealt = spark.range(1000).select((F.col("id") % 50).alias("k")).repartition(7, "k").mapInArrow(lambda batches: batches, "k long")
    kept = common.stored(dealt, "dealt")
    for _ in range(100):  # the files go a moment after the query
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and kept.count() == 1000
    tables = scratch_tables(spark)
    common.discard(kept)
    assert len(tables - scratch_tables(spark)) == 1


def test_rounds_and_steps_leave_no_tables(spark):
    before = scratch_tables(spark)
    edges = spark.createDataFrame([(k + 1, k) for k in range(20)], "a long, b long")
    assert components.components(edges).count() == 20
    assert len(scratch_tables(spark) - before) == 1
    before = scratch_tables(spark)
    assert line_dedup.line_groups(frame(spark, line_rows())).count()
    left = {name.rsplit("-", 1)[0] for name in scratch_tables(spark) - before}
    assert not left & {"line-sample", "line-pairs", "line-wanted", "line-sets", "line-links", "groups", "members"}


@pytest.mark.parametrize("left, right", [(1 << 22, 1 << 26), (1500, 4000), (200, 900)])
def test_members_of_large_groups_are_compared_in_cells(spark, monkeypatch, left, right):
    """No member but 0 is linked with the centre, 0; the others are linked with each other by their differences."""
    monkeypatch.setattr(linking, "LEFT", left)
    monkeypatch.setattr(linking, "RIGHT", right)
    rng = np.random.default_rng(3)
    sets = {0: np.arange(100, dtype=np.uint64)}
    families = [np.concatenate([rng.permutation(100)[:65], np.arange(1000 * f, 1000 * f + 30)]) for f in range(1, 9)]
    for n in range(1, 41):
        some = rng.permutation(families[n % 8])[4 if n % 3 else 17 :]
        sets[n] = np.sort(np.append(some, 100_000 + n)).astype(np.uint64)
    up = Union(41)
    for x, y in itertools.combinations(sets, 2):
        both = len(np.intersect1d(sets[x], sets[y]))
        if 9 * both >= 4 * (len(sets[x]) + len(sets[y])):
            up.join(x, y)
    members = spark.createDataFrame([(0, n, len(x), n, 0, 100) for n, x in sets.items()], "centre long, node long, n long, label long, usual long, nc long")
    frame_of = spark.createDataFrame([(n, x.tobytes()) for n, x in sets.items()], "node long, values binary")
    got = linking._linked_in_groups(members, frame_of, linking.stored_sets).collect()
    found = Union(41)
    for r in got:
        assert up.find(r.a) == up.find(r.b)
        found.join(r.a, r.b)
    assert {frozenset(p) for p in itertools.combinations(sets, 2) if up.find(p[0]) == up.find(p[1])} == {
        frozenset(p) for p in itertools.combinations(sets, 2) if found.find(p[0]) == found.find(p[1])
    }
    assert 8 < len({up.find(n) for n in sets}) < 30
    if left > 10_000:
        assert len(got) == 41 - len({up.find(n) for n in sets})  # no link that joins nothing leaves the task


# ---- mixing ------------------------------------------------------------------


def mixed_by_hand(rows, weights, epochs=1.0, seed=17):
    counts = defaultdict(int)
    for _, s in rows:
        counts[s] += 1
    out = []
    for d, s in rows:
        rate = weights.get(s, 0.0) / sum(weights.values()) * epochs * len(rows) / counts[s]
        parts = max(1, math.ceil(rate / mixing.STEP))
        mean, n = rate / parts, 0
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{seed}:{part}:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
            p = cdf = math.exp(-mean)
            k = 0
            while cdf <= u and k < 200:
                k += 1
                p *= mean / k
                cdf += p
                n += 1
        out += [(d, s, c, n) for c in range(1, n + 1)]
    return sorted(map(repr, out))


def test_mixing(spark):
    rows = [(i, ["a", "a", "a", "b", None][i % 5]) for i in range(400)] + [(None, "a"), (3, "b"), (3, "b"), (900, "c")]
    df = spark.createDataFrame([(d, s, None, "x", "y", "z") for d, s in rows], "doc_id long, source string, text string, copy string, n string, rate string")
    weights = {"a": 1.0, "b": 30.0, None: 2.0}
    given = spark.createDataFrame(list(weights.items()) + [("missing", None)], "source string, weight double")
    got = mixing.poisson_mix(df.select("doc_id", "source", "text"), given, epochs=2.0, keep_details=True)
    rows_got = [repr((r.doc_id, r.source, r.copy, r.copies)) for r in got.collect()]
    assert sorted(rows_got) == mixed_by_hand(rows, weights, 2.0)
    assert rows_got != sorted(rows_got)
    plain = mixing.poisson_mix(df, given)
    assert plain.columns == df.columns
    assert abs(plain.count() - 404) < 5 * math.sqrt(404)
    assert mixing.poisson_mix(df.limit(0), given).count() == 0
    assert mixing.poisson_mix(df, given.limit(0)).count() == 0


# ---- SQL ---------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op1_warc_zip", "op2_exact_dedup", "op3_mixing"])
def test_queries_match_their_sql(spark, name):
    from firmscope.llm import catalog

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF_SMALL)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))
    assert table(spark, SF_SMALL, "documents").count() > 0 and linking.SMALL > 1


def test_mixing_keeps_clashing_columns_and_refuses_negative_weights(spark):
    df = spark.createDataFrame([(k, "s", "a", "b", "c") for k in range(50)], "doc_id long, source string, copy string, copies string, Shuffle_Key string")
    out = mixing.poisson_mix(df, mixing.temperature_weights(df), keep_details=True)
    assert out.columns == [*df.columns, "copy_", "copies_", "shuffle_key_"]
    assert {(r.copy, r.copies) for r in out.collect()} == {("a", "b")}
    with pytest.raises(Exception, match="negative weight"):
        mixing.poisson_mix(df, spark.createDataFrame([("s", -1.0), ("t", 2.0)], "source string, weight double")).collect()


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    from firmscope.llm import common

    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.partitions(df) == least
    monkeypatch.setattr(common, "PARTITION_BYTES", 10_000)
    assert common.partitions(df) > least and common.partitions(df, 2.0) >= 2 * common.partitions(df) - 2
    assert common.partitions(spark.createDataFrame([(1,)], "a int")) == least
