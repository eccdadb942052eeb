"""WARC packages, toxicity, quality and the pipeline."""

import hashlib
import io
import random
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import quality, toxicity, warc_zip
from firmscope.llm.common import table
from tests.conftest import SF_SMALL

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("key", "first", "payload", "id")]
)
ROWS = [
    (4, "http://a/1", "<p>same</p>"), (2, "http://a/2\r\nX: y", "<p>same</p>"), (9, None, None), (3, "http://é/", ""), (None, "u", "<p>same</p>"),
    (5, "u", "é" * 200_000), (6, "u", "only once\r\n\r\n"), (7, "u", "<b>"), (7, "u", "<b>"), (8, "u", "<b>"), (None, None, "lost"), (None, None, "lost"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "1", "2", "3", "4") for r in rows], PAGES)


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [x for x, _, h in rows if (h or "").encode() == raw and x is not None]
        first = min(ids) if ids and len(raw) >= least and sum((h or "") == (html or "") for _, _, h in rows) > 1 else None
        revisit = first is not None and first != i
        out.append(repr((i, len(raw), warc_zip.sha1_base32(raw), "revisit" if revisit else "response", first if revisit else None)))
    return sorted(out)


COLUMNS = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least,size", [(0, 20_000), (0, 2), (5, 3)])
def test_packages_round_trip(spark, least, size):
    manifest = warc_zip.write_packages(pages(spark).coalesce(2), min_revisit_bytes=least, records_per_package=size)
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS)
    got = warc_zip.read_packages(manifest).collect()
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in got) == expected(ROWS, least)
    payloads = {(r.record_id, r.payload_digest): r.payload for r in got if r.record_type == "response"}
    assert payloads[5, warc_zip.sha1_base32(("é" * 200_000).encode())] == "é" * 200_000
    assert {r.url for r in got if r.record_id == 2} <= {"http://a/2%0D%0AX: y"}


def test_no_rows_no_package(spark):
    manifest = warc_zip.write_packages(pages(spark, []))
    assert manifest.count() == 0 and warc_zip.read_packages(manifest).count() == 0


def archive(zip64, comment=b""):
    buffer = io.BytesIO()
    limits = zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT
    try:
        if zip64:
            zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT = 10, 1
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("archive/a.warc.gz", b"A" * 100)
            z.writestr(zipfile.ZipInfo("indexes/é.cdxj"), b'x {"offset": "1"}\ny {"offset": "2"}')
            z.writestr("packed", b"B" * 1000, compress_type=zipfile.ZIP_DEFLATED)
            z.comment = comment
    finally:
        zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT = limits
    return buffer


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"a comment PK\x05\x06 with a signature"])
def test_directories_are_parsed(zip64, comment):
    buffer = archive(zip64, comment)
    data = buffer.getvalue()
    assert (b"PK\x06\x07" in data) == zip64
    listed = {m.name: m for m in warc_zip.members(buffer, len(data))}
    assert {name: m.method for name, m in listed.items()} == {"archive/a.warc.gz": 0, "indexes/é.cdxj": 0, "packed": 8}
    found = {name: data[m.start : m.start + m.size] for name, m in listed.items()}
    assert found["archive/a.warc.gz"] == b"A" * 100
    index = next(m for m in warc_zip.members(buffer, len(data)) if m.name.startswith("indexes"))
    assert [e["offset"] for e in warc_zip.index_entries(buffer, index)] == ["1", "2"]


def test_zip64_fields_beyond_four_gigabytes():
    """A directory entry whose sizes and offset stand in the ZIP64 field, in a sparse file."""

    class Sparse(io.RawIOBase):
        def __init__(self, parts):
            self.parts, self.at = parts, 0

        def seek(self, at, whence=0):
            self.at = at

        def read(self, n=-1):
            base, data = next((b, d) for b, d in self.parts if b <= self.at < b + len(d))
            out = data[self.at - base : self.at - base + n]
            self.at += len(out)
            return out

    big = 6 << 32
    local = b"PK\x03\x04" + b"\0" * 22 + struct.pack("<HH", 1, 0) + b"n"
    extra = struct.pack("<HHQQQ", 1, 24, 5 << 32, 5 << 32, big)
    entry = b"PK\x01\x02" + struct.pack("<HHHH", 45, 45, 0, 0) + b"\0" * 8 + struct.pack("<IIHHH", 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0)
    entry += b"\0" * 8 + struct.pack("<I", 0xFFFFFFFF) + b"n" + extra
    at = big + (5 << 32) + 31
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    tail = b"\0" * 66_000 + entry + end64 + locator + end
    f = Sparse([(big, local), (at - 66_000, tail)])
    (m,) = warc_zip.members(f, at - 66_000 + len(tail))
    assert (m.name, m.start, m.size) == ("n", big + 31, 5 << 32)


def test_damage_is_noticed(spark, tmp_path):
    raw = warc_zip.record(1, "u", b"abc", warc_zip.sha1_base32(b"abd"), None)
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        packed = warc_zip._gzip(raw)
        z.writestr("archive/data.warc.gz", packed)
        z.writestr("indexes/index.cdxj", '{"filename": "data.warc.gz", "offset": "0", "length": "%d"}' % len(packed))
    with pytest.raises(Exception, match="damaged record"):
        warc_zip.read_packages(spark.createDataFrame([(str(tmp_path / "x.wacz"),)], "path string")).collect()
    with pytest.raises(ValueError):
        warc_zip.members(io.BytesIO(b"no archive"), 10)


def test_packages_with_compressed_or_missing_members(spark, tmp_path):
    packed = warc_zip._gzip(warc_zip.record(1, "u", b"abc", warc_zip.sha1_base32(b"abc"), None))
    lines = [('{"filename": "data.warc.gz", "offset": "0", "length": "%d"}\n' % len(packed)).encode()] * 30_000

    def read(name, index, raw, index_method=zipfile.ZIP_STORED, data_method=zipfile.ZIP_STORED, data="archive/data.warc.gz"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(data, packed, data_method)
            if index:
                z.writestr(index, raw, index_method)
        return warc_zip.read_packages(spark.createDataFrame([(str(tmp_path / name),)], "path string")).count()

    plain = b"".join(lines)
    gz = warc_zip._gzip(b"".join(lines[:20_000])) + warc_zip._gzip(b"".join(lines[20_000:]))
    assert read("a.wacz", "indexes/index.cdxj", plain, zipfile.ZIP_DEFLATED) == 30_000
    assert read("b.wacz", "indexes/index.cdx.gz", gz) == 30_000
    assert read("c.wacz", "indexes/index.cdx.gz", gz, zipfile.ZIP_DEFLATED) == 30_000
    for name, args in {
        "no_index.wacz": (None, b""),
        "deflated.wacz": ("indexes/index.cdxj", plain, zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED),
        "missing.wacz": ("indexes/index.cdxj", plain, zipfile.ZIP_STORED, zipfile.ZIP_STORED, "other/data.warc.gz"),
        "bzip2.wacz": ("indexes/index.cdxj", plain, zipfile.ZIP_BZIP2),
    }.items():
        with pytest.raises(Exception, match=name):
            read(name, *args)


# ---- classifiers -------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, part string"


def foreign_package(path):
    """A package as others make them: UUID ids, a two-level index, records of all kinds, a plain and a binary payload."""

    def rec(kind, ident, block, content_type, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{ident}>", "Content-Type": content_type, "Content-Length": len(block), **more}
        return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"

    http = "application/http; msgtype=response"
    records = [
        rec("warcinfo", "i", b"software: other\r\n", "application/warc-fields"),
        rec("request", "q", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request", **{"WARC-Target-URI": "http://a/"}),
        rec("response", "r", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>no length</p>", http, **{"WARC-Target-URI": "http://a/"}),
        rec("response", "b", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n\xff\xfe\x00\x01", http, **{"WARC-Target-URI": "http://a/b"}),
        rec("response", "c", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n", http,
            **{"WARC-Payload-Digest": "sha1:" + warc_zip.sha1_base32(b"abc")}),
        rec("revisit", "v", b"HTTP/1.1 200 OK\r\nContent-Length: 16\r\n\r\n", http, **{"WARC-Refers-To": "<urn:uuid:r>"}),
    ]
    data, lines = b"", []
    for k, r in enumerate(records):
        packed = r if k == 1 else warc_zip._gzip(r)
        lines.append(f'com,a)/{k} 20240101 ' + '{"filename": "x.warc.gz", "offset": "%d", "length": "%d"}' % (len(data), len(packed)))
        data += packed
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/x.warc.gz", data)
        z.writestr("indexes/index.cdx.gz", warc_zip._gzip("\n".join(lines).encode()))
        z.writestr("indexes/index.idx", "com,a)/0 20240101\tindex.cdx.gz\t0\t99\t1\n")


def test_packages_of_others_are_read(spark, tmp_path):
    foreign_package(tmp_path / "other.wacz")
    got = {r.record_urn: r for r in warc_zip.read_packages(spark.createDataFrame([(str(tmp_path / "other.wacz"),)], "path string")).collect()}
    one = {k.removeprefix("<urn:uuid:").rstrip(">"): r for k, r in got.items()}
    assert {k: r.record_type for k, r in one.items()} == {"i": "warcinfo", "q": "request", "r": "response", "b": "response", "c": "response", "v": "revisit"}
    assert all(r.record_id is None and r.refers_to is None for r in one.values())
    assert one["i"].payload == "software: other\r\n" and one["i"].url is None
    assert one["r"].payload == "<p>no length</p>" and one["r"].payload_bytes == 16
    assert one["r"].payload_digest == warc_zip.sha1_base32(b"<p>no length</p>")
    assert one["b"].payload is None and bytes(one["b"].binary) == b"\xff\xfe\x00\x01" and one["r"].binary is None
    assert one["c"].payload.startswith("3\r\nabc")
    assert (one["v"].refers_to_urn, one["v"].payload, one["v"].payload_digest, one["v"].payload_bytes) == ("<urn:uuid:r>", None, None, 16)


@pytest.mark.parametrize(
    "name,line,message",
    [("indexes/index.cdx", "com,a)/ 20240101 x.warc.gz 0 9", "without a JSON entry"), ("indexes/a.cdxj", '{"url": "x"}', "without file name"), ("indexes/index.idx", "x", "no index in")],
)
def test_packages_that_can_t_be_read_are_named(spark, tmp_path, name, line, message):
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        z.writestr("archive/x.warc.gz", b"")
        z.writestr(name, line)
    with pytest.raises(Exception, match=message):
        warc_zip.read_packages(spark.createDataFrame([(str(tmp_path / "x.wacz"),)], "path string")).collect()


def test_ids_that_are_no_numbers_are_refused(spark):
    rows = spark.createDataFrame([("a", "u", "x")], "page_id string, url string, html string")
    with pytest.raises(TypeError, match="page_id"):
        warc_zip.write_packages(rows)


def labelled(spark, n=600, seed=3):
    """Prose of invented words; a fifth carries a word of a toxic family, another fifth shouts."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 120))
        toxic, bad = i % 5 == 0, i % 5 == 1
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["gruxle", "gruxlen", "zwopf"])
        joined = " ".join(text)
        if bad:
            joined = joined.upper().replace(" ", "!! ")
        docs.append((i, joined, rng.choice(["en", "de"]), rng.choice(["s1", "s2"]), len(joined), "x", "y", "z"))
        if i % 2 == 0 or rng.random() < 0.5:
            labels.append((i, int(not bad), int(toxic)))
    odd = [(n, "", None, None, 0), (n + 1, None, "en", None, None), (None, "gruxle zwopf", "en", "s1", 3), (n + 2, "w" * 100_000, "en", "s1", 5)]
    docs += [(*r, "x", "y", "z") for r in odd] + docs[:2]
    labels += [(n, None, None), (None, 0, 1), (2, 1, 0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_documents(spark):
    df, labels, docs = labelled(spark)
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    tested = [(by_id[i].predicted, int(i % 5 == 0)) for i in range(600) if held(i)]
    assert sum(a == b for a, b in tested) / len(tested) > 0.97
    assert by_id[None].predicted == 1 and by_id[600].predicted == 0 and by_id[601].score == by_id[600].score


def test_toxicity_ignores_labels_of_held_out_rows(spark):
    df, labels, _ = labelled(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(df, labels), toxicity.train(df, turned)
    assert a.weights == b.weights and a.bias == b.bias


def significant_by_hand(positive, unlabelled, prior):
    holders = [Counter(f for d in docs for f in set(d.tolist())) for docs in (positive, unlabelled)]
    n, m = len(positive), len(unlabelled)
    found = []
    for f, k in holders[0].items():
        a, b = k / n, holders[1][f] / m
        pooled = (k + holders[1][f]) / (n + m)
        z = (a - b) / (max(pooled * (1 - pooled), 1e-12) * (1 / n + 1 / m)) ** 0.5
        if k >= toxicity.MIN_COUNT and z >= toxicity.MIN_Z and a >= 3 * max(b - prior * a, 0) / max(1 - prior, 1e-3):
            found.append((-z, f))
    return sorted(f for _, f in sorted(found)[: toxicity.MAX_FEATURES])


@pytest.mark.parametrize("share", [0.02, 0.2, 0.4, 0.6])
def test_toxicity_at_any_share_of_toxic_rows(spark, share):
    rng = random.Random(5)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(400)]
    texts, toxic = [], []
    for _ in range(2000):
        text = rng.choices(words, k=rng.randint(20, 120))
        toxic.append(rng.random() < share)
        if toxic[-1]:
            text[rng.randrange(len(text))] = rng.choice(["gruxle", "gruxlen", "zwopf"])
        texts.append(" ".join(text))
    rows = [np.sort(np.array([x for w in toxicity.words_of(t) for x in toxicity.features_of(w)], np.uint32)) for t in texts[:1600]]
    positive, prior = [x for x, y in zip(rows, toxic) if y], sum(toxic[:1600]) / 1600
    sample = [(1, bytearray(x.tobytes())) for x in positive] + [(0, bytearray(x.tobytes())) for x in rows]
    chosen, sizes = toxicity.significant(spark.createDataFrame(sample, "part int, features binary").repartition(3), prior)
    assert sizes == {0: len(rows), 1: len(positive)}
    assert chosen.tolist() == significant_by_hand(positive, rows, prior)
    model = toxicity.fit(positive, rows, prior, chosen)
    predicted = [x >= 0.5 for x in model.scores(texts[1600:], {})]
    assert sum(a == b for a, b in zip(predicted, toxic[1600:])) > 0.97 * 400


def test_toxic_term_at_the_end_of_a_long_run(spark):
    df, labels, _ = labelled(spark)
    model = toxicity.train(df, labels)
    rng = random.Random(8)
    runs = ["".join(rng.choices("aeioulmnrst", k=994)), "_".join("".join(rng.choices("aeioulmnrst", k=6)) for _ in range(142)) + "_"]
    for run in runs:
        clean, joined = model.scores([run, run + "gruxle"], {})
        assert joined > 0.5 > clean
    everywhere = {xxhash.xxh32_intdigest(x) for x in ("grux", "gruxl", "uxle$", "uxle")}
    assert everywhere <= set(toxicity.features_of("n" * 5000 + "gruxle"))
    assert xxhash.xxh32_intdigest("=gruxle") in toxicity.features_of("n" * 5000 + "_gruxle")
    assert xxhash.xxh32_intdigest("=毒物") in toxicity.features_of("一" * 70 + "毒物" + "七" * 900)


def test_toxicity_without_labels_or_rows(spark):
    df, labels, docs = labelled(spark, 50)
    none = toxicity.train(df, labels.limit(0))
    assert {r.predicted for r in toxicity.score(df, none).collect()} == {0}
    assert toxicity.score(df.limit(0), none).count() == 0
    toxicity.train(df.limit(0), labels)


def test_nonnegative_risk_steps_back_from_overfitting():
    """With as many features as rows the corrected risk would go below zero; the margin of positives stays finite."""
    rng = np.random.default_rng(1)
    positive = [np.array([i, 10_000], np.uint32) for i in range(200)]
    unlabelled = [np.array([rng.integers(200, 5000)], np.uint32) for _ in range(900)] + [np.array([i, 10_000], np.uint32) for i in range(100)]
    model = toxicity.fit(positive, unlabelled, 0.1, np.unique(np.concatenate(positive)))
    shared = model.weights[10_000] + model.bias
    assert shared > 0 > model.bias and abs(shared) < 20


def test_quality_on_held_out_documents(spark):
    df, labels, docs = labelled(spark)
    model = quality.train(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    tested = [(by_id[i].kept, i % 5 != 1) for i in range(600) if held(i)]
    assert sum(a == b for a, b in tested) / len(tested) > 0.97
    stay = quality.keep_good(df, model)
    assert stay.columns == df.columns
    assert sorted(repr(r.doc_id) for r in stay.collect()) == sorted(repr(r.doc_id) for r in got if r.kept)


def test_quality_with_one_class_or_no_rows_rejects_nothing(spark):
    df, labels, docs = labelled(spark, 50)
    for some in (labels.limit(0), labels.filter("quality = 1")):
        model = quality.train(df, some)
        assert quality.keep_good(df, model).count() == len(docs)
    model = quality.train(df, labels)
    assert quality.score(df.limit(0), model).count() == 0 and quality.keep_good(df.limit(0), model).count() == 0


def test_co_training_learns_a_view_from_the_other():
    """The metadata view alone is weak on few labels; pseudo-labels of the content view make it good."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 2400).astype(float)
    content = np.stack([y + rng.normal(0, 0.15, 2400), rng.normal(0, 1, 2400)], 1).astype(np.float32)
    noise = rng.normal(0, 1, (2400, 60))
    metadata = np.concatenate([y[:, None] + rng.normal(0, 0.5, (2400, 1)), noise], 1).astype(np.float32)
    few = slice(0, 60)
    left = np.arange(60, 1600)

    def hand_over(fitted, share):
        nonlocal left
        out, gone = [], []
        for k, x in enumerate((content, metadata)):
            margin = fitted[k].margin(x[left])
            sure = left[np.argsort(-np.abs(margin), kind="stable")[:100]]
            sure = sure[np.abs(fitted[k].margin(x[sure])) >= 3]
            out.append((content[sure], metadata[sure], (fitted[k].margin(x[sure]) > 0).astype(float)))
            gone += sure.tolist()
        left = np.setdiff1d(left, gone)
        return out

    model = quality.co_train((content[few], metadata[few]), y[few], hand_over)
    alone = quality.fit_view(metadata[few], y[few])

    def right(margin):
        return ((margin >= 0) == y[1600:]).mean()

    assert right(model.metadata.margin(metadata[1600:])) > right(alone.margin(metadata[1600:])) + 0.02
    assert right(model.score(content[1600:], metadata[1600:])[2] - 0.5) > 0.97


def test_training_takes_a_fixed_number_of_jobs(spark):
    df, labels, _ = labelled(spark)
    tracker, many = spark.sparkContext.statusTracker(), df.repartition(400)
    counts = {}
    for name, train in (("toxicity", toxicity.train), ("quality", quality.train)):
        for size, rows in (("few", df.coalesce(2)), ("many", many)):
            group = f"training {name} {size}"
            spark.sparkContext.setJobGroup(group, group)
            train(rows, labels)
            counts[name, size] = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    for name in ("toxicity", "quality"):
        assert counts[name, "many"] <= counts[name, "few"] + 10 < 120, counts


def test_co_training_draws_from_every_unlabelled_row(spark, monkeypatch):
    """A source that only unlabelled, late rows have reaches the metadata view; copies are handed over once."""
    df, labels, docs = labelled(spark)
    late = [(10_000 + k, docs[k % len(docs)][1], "en", "rare.example") for k in range(400)]
    rows = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source) for r in df.collect()] + late, "doc_id long, text string, lang string, source string")
    taken = []
    original = quality.co_train

    def watched(given, y, hand_over, rounds):
        return original(given, y, lambda *a: taken.append(hand_over(*a)) or taken[-1], rounds)

    monkeypatch.setattr(quality, "co_train", watched)
    model = quality.train(rows, labels)
    column = quality.BUCKETS + zlib.crc32(b"rare.example") % quality.BUCKETS
    handed = np.concatenate([m for views in taken for _, m, _ in views])
    assert len(handed) and handed[:, column].any()
    assert all(len(label) <= quality.GIVEN + 1 for views in taken for _, _, label in views)
    assert model.metadata.scale[column] != 1 or model.metadata.weights[column] != 0
    # The same model, however the rows are dealt out.
    again = quality.train(rows.repartition(9), labels)
    assert np.array_equal(again.metadata.weights, model.metadata.weights) and again.weight == model.weight


# ---- pipeline ----------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from firmscope.llm import bpe

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = table(spark, SF_SMALL, "documents").cache()
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF_SMALL)
        seen.append(spark.createDataFrame(out.collect(), out.schema))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == columns
    ids = [[r[0] for r in d.collect()] for d in seen]
    raw = {r.doc_id: r for r in docs.collect()}
    scored = quality.score(docs, quality.train(docs, table(spark, SF_SMALL, "labels"))).filter("kept")
    assert sorted(ids[1]) == sorted(r.doc_id for r in scored.collect())
    strip = lambda i: "".join(c for c in raw[i].text if c not in " \t\n\x0b\x0c\r")
    assert len(ids[2]) == len({strip(i) for i in ids[1]}) and {strip(i) for i in ids[2]} == {strip(i) for i in ids[1]}
    from tests.llm.test_dedup_operators import near_by_hand

    groups = near_by_hand([(i, raw[i].text) for i in ids[2]], 5)
    assert sorted(ids[3]) == sorted(i for i, _, c in map(eval, groups) if i == c)
    assert set(ids[4]) <= set(ids[3]) and len(ids[4]) == len(ids[5])
    final = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in final) == sorted(ids[5])
    model = bpe.Bpe(bpe.vocabulary())
    for r in final:
        assert r.decoded_sha256 == hashlib.sha256(raw[r.doc_id].text.encode()).hexdigest()
        assert list(r.ids) == model.encode_batch([raw[r.doc_id].text])[0].tolist()


def test_pipeline_on_odd_rows_and_an_empty_table(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows: each stage keeps one of what it should, and all columns."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(60)]
    base = " ".join(words)
    rows = [
        (1, base, "en", "a"), (1, base + " tail", "en", "a"), (None, base.upper(), None, None), (None, "another text of few words", "en", None),
        (None, "another text of few words", "en", None), (2, None, "de", "b"), (2, "", "de", "b"), (3, "  another  text of few words", "de", "b"), (4, "x", None, "a"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, docs, folder).count() == len(rows)  # labels of one class
    exact = stages["exact_dedup"](spark, docs, folder).collect()
    strip = lambda t: "".join((t or "").split())
    assert sorted(strip(r.text) for r in exact) == sorted({strip(r[1]) for r in rows})
    near = stages["near_dedup"](spark, spark.createDataFrame(exact, schema), folder)
    kept = near.collect()
    # base, its copy with a tail and its upper-case copy are one group: the smallest id stays
    assert sorted((r.doc_id is None, r.doc_id, strip(r.text)[:6]) for r in kept if r.text and r.text.lower().startswith("w0")) in (
        [(False, 1, "w0w1w2")],
    )
    assert len(kept) == len(exact) - 2 and near.columns == docs.columns
    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}
    tokens = stages["bpe"](spark, docs, folder).collect()
    assert len(tokens) == len(rows) and sorted(r.n_tokens == 0 for r in tokens) == sorted(not r[1] for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns), name
