"""Operators 11 to 13 against plain versions, on edge cases, on the method's own promises and on damage."""

import hashlib
import io
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import brute
from gradeframe.llm import centroids, resample, warc
from gradeframe.llm.text import stored

# ---- 11


@pytest.fixture(scope="module")
def pages_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, record_type string, path long").repartition(4)

    return make


def page_rows():
    same, other = "<p>same</p>" * 12, "<p>öther</p>" * 30
    rows = [(5, "http://a.example/", same), (3, "http://b.example/x y\r\nz", same), (9, None, same), (1, "http://c.example/", "<p>short</p>"),
            (2, "http://c.example/", "<p>short</p>"), (4, "u", None), (6, "u", ""), (7, "http://d.example/", other), (-8, "http://d.example/é", other),
            (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100), (14, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (15, "u", "漢" * 400_000)]
    return rows + [(100 + i, "http://e.example/", f"<html><body>page {i} of many pages</body></html>" * 8) for i in range(200)]


def wanted_pages(rows):
    firsts, out = {}, {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100:
            firsts[raw] = min(firsts.get(raw, i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        first = firsts.get(raw, i)
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
    return out


def digest_columns(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_op11_round_trip(pages_of):
    rows = page_rows()
    assert digest_columns(warc.round_trip(pages_of(rows))) == wanted_pages(rows)


@pytest.mark.parametrize("hot_rows", [1, 100_000])
def test_op11_digests_beyond_the_broadcast(pages_of, spark, tmp_path, hot_rows):
    rows = page_rows() + [(1000 + i, "u", "hot " * 50) for i in range(150)]
    folder = f"file://{tmp_path}"
    manifest = warc.write_archives(pages_of(rows), folder, broadcast_bytes=warc.DIGEST_ROW * 2, hot_rows=hot_rows, file_bytes=4000)
    assert manifest.count() > 8 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    records = warc.read_archives(manifest, folder, with_payload=True).collect()
    want = wanted_pages(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    for r in records:
        page = warc.page_of(r["record_id"])
        assert (r["record_type"], None if r["refers_to_id"] is None else warc.page_of(r["refers_to_id"])) == want[page][2:]
        assert bytes(r["payload"]) == (texts[page] if r["record_type"] == "response" else b"")
        assert r["payload_bytes"] == len(texts[page])
    assert len(records) == len(rows)


def test_op11_null_and_repeated_ids(pages_of):
    long_text = "<p>long enough</p>" * 10
    rows = [(None, "u", long_text), (4, "u", long_text), (4, "u", long_text), (7, "u", long_text), (None, "u", "z" * 200), (None, "u", "z" * 200)]
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages_of(rows)).collect())
    assert got == sorted([(-1, "revisit", 4, 180), (4, "response", None, 180), (4, "response", None, 180), (7, "revisit", 4, 180),
                          (-1, "response", None, 200), (-1, "response", None, 200)])


def archive(payloads, **changes):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    for i, p in enumerate(payloads):
        writer.add(warc.record_bytes(i, "http://x.example/", p, hashlib.sha256(p).hexdigest(), None, False))
    writer.close()
    return out.getvalue()


def test_op11_dictionary_is_loaded_and_any_chunk_size_reads(monkeypatch):
    rnd = random.Random(1)
    payloads = [b"<html><head><title>t</title></head><body>" + rnd.randbytes(20).hex().encode() * 3 + b"</body></html>" for _ in range(400)]
    with_dictionary = archive(payloads)
    magic, size = struct.unpack_from("<II", with_dictionary)
    assert magic == warc.DICTIONARY_MAGIC
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda *a, **k: (_ for _ in ()).throw(zstandard.ZstdError("none")))
    assert len(with_dictionary) - size < len(archive(payloads))
    for chunk in (1, 7, 1000, 1 << 20):
        if chunk > 1 or len(payloads) < 500:
            assert [r.payload for r in warc.ArchiveReader(io.BytesIO(with_dictionary), chunk)] == payloads
    # The frames can't be read without the dictionary, and a plain one is as good as a packed one.
    with pytest.raises(warc.DamagedArchive):
        list(warc.ArchiveReader(io.BytesIO(with_dictionary[8 + size :])))
    plain = zstandard.ZstdDecompressor().decompress(with_dictionary[8 : 8 + size])
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(plain)) + plain + with_dictionary[8 + size :]
    assert [r.payload for r in warc.ArchiveReader(io.BytesIO(again))] == payloads


def test_op11_other_writers_frames():
    """Frames without a content size, with long RLE blocks, and skippable frames between records."""
    record = warc.record_bytes(1, None, b"a" * 500_000, hashlib.sha256(b"a" * 500_000).hexdigest(), None, False)
    packer = zstandard.ZstdCompressor(write_content_size=False, write_checksum=False).compressobj()
    frame = packer.compress(record) + packer.flush()
    raw = frame + struct.pack("<II", 0x184D2A51, 3) + b"abc" + frame
    records = list(warc.ArchiveReader(io.BytesIO(raw), 100))
    assert [len(r.payload) for r in records] == [500_000] * 2
    assert [(r.offset, r.length) for r in records] == [(0, len(frame)), (len(frame) + 11, len(frame))]


GOOD = warc.record_bytes(1, "http://x.example/", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)


@pytest.mark.parametrize("damage, told", [
    (lambda r: r.replace(b"WARC/1.1", b"WARX/1.1"), "version"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), "warc-date"),
    (lambda r: r[:-1], "end told"),
    (lambda r: r + b"more", "end told"),
    (lambda r: r + r, "end told"),
    (lambda r: r.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"), "digest"),
    (lambda r: r.replace(b"Content-Length: ", b"Content-Length: -"), "length"),
    (lambda r: r.replace(b"WARC-Type: ", b"WARC-Type "), "named field"),
    (lambda r: r.replace(b"WARC-Type: response\r\n", b"WARC-Type: response\r\nWARC-Type: x\r\n"), "twice"),
    (lambda r: b"nothing", "no end"),
])
def test_op11_damaged_records_are_refused(damage, told):
    assert warc.parse_record(GOOD).payload == b"payload"
    with pytest.raises(warc.DamagedArchive, match=told):
        warc.parse_record(damage(GOOD))


def test_op11_damaged_files_are_told(spark, tmp_path):
    raw = archive([b"payload %d" % i for i in range(3)])
    (tmp_path / "good.zst").write_bytes(raw)
    (tmp_path / "short.zst").write_bytes(raw[:-5])
    (tmp_path / "flipped.zst").write_bytes(raw[:-30] + bytes([raw[-30] ^ 0xFF]) + raw[-29:])
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("good.zst", "short.zst", "flipped.zst")], "path string")
    rows = warc.read_archives(files, f"file://{tmp_path}", errors="list").collect()
    by_file = {n: [r["error"] is None for r in rows if r["path"].endswith(n)] for n in ("good.zst", "short.zst", "flipped.zst")}
    assert by_file == {"good.zst": [True] * 3, "short.zst": [True, True, False], "flipped.zst": [True, True, False]}
    with pytest.raises(Exception, match="DamagedArchive"):
        warc.read_archives(files, f"file://{tmp_path}").collect()


# ---- 12


def plain_clusters(rows, k, rounds, dims, seed):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, members in groups.items():
            centres[n] = [sum(col) // len(members) for col in zip(*members)]
    told = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in told)
    inertia = {}
    for _, d, n in told:
        inertia[n] = inertia.get(n, 0) + d
    return sorted(((i is None, i or 0, n, d, inertia[n], total, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in told))


def cluster_rows(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def vectors_of(spark):
    def make(rows, kind="float"):
        return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance double").repartition(3)

    return make


def vector_rows(dims=6):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.5, 2.25]) + rnd.randrange(8) / 64 for _ in range(dims)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * dims) for i in range(100)]  # a third of all rows alike
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [1.0] * dims), (400, None), (401, []), (402, [1.0] * (dims + 1)), (403, [None] * dims),
             (404, [float("nan")] * dims), (405, [1.0] * (dims - 1) + [float("inf")]), (406, [1e6] * dims), (407, [-1e6] + [0.0] * (dims - 1))]
    return rows


def test_op12_as_plain_k_means(vectors_of):
    rows = vector_rows()
    assert cluster_rows(centroids.cluster_vectors(vectors_of(rows), k=9, rounds=4, dims=6, seed=2)) == plain_clusters(rows, 9, 4, 6, 2)


def test_op12_ties_and_few_vectors(vectors_of):
    rows = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 1.0])]
    for k in (1, 2, 4, 6, 20):
        assert cluster_rows(centroids.cluster_vectors(vectors_of(rows), k=k, rounds=3, dims=2, seed=1)) == plain_clusters(rows, k, 3, 2, 1)


def test_op12_components_beyond_64_bit_squares(vectors_of):
    rows = [(i, [s * 3.0e8 * (i + 1), 1e9, -2.5e9]) for i, s in enumerate([1, -1] * 10)]
    got = cluster_rows(centroids.cluster_vectors(vectors_of(rows, "double"), k=3, rounds=3, dims=3, seed=2))
    want = plain_clusters(rows, 3, 3, 3, 2)
    most = (1 << 63) - 1
    assert got == [tuple(min(x, most) if type(x) is int else x for x in row) for row in want]


def test_op12_empty(vectors_of):
    for rows in ([], [(1, None)], [(1, [1.0])]):
        assert centroids.cluster_vectors(vectors_of(rows), k=3, rounds=2, dims=2).collect() == []


def test_op12_search_takes_few_exact_distances():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(-300, 300, (40, 64)) + 120 * rnd.integers(-4, 5, (40, 1))
    rows = centres[rnd.integers(0, 40, 3000)] + rnd.integers(-20, 21, (3000, 64))
    search = centroids.Search(centres.tolist())
    number, distance = search.nearest(rows)
    every = ((rows[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert search.exact < 0.3 * every.size


# ---- 13


def plain_draw(rows, items, percent, longest, buckets, least, seed):
    def runs(text):
        w = brute.ALNUM.findall(brute.lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for table, texts in ((s, [x for _, x in rows]), (t, items)):
        for text in texts:
            for b in runs(text)[1]:
                table[b] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        n, found = runs(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def draw_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def document_rows():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "漢字", "x" * 70, "y" * 5000]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, " .,; "), (203, "ONE one.One"), (None, "w1 " * 25), (None, "w2 " * 30), (7, "w3 w4 " * 40), (7, rows[7][1]),
                   (300, "z" * 100_000)] + [(500, "hot words here " * 10)] * 70


ITEMS = ["w1 w2 w3 w1 w2 w3", "w50 W51 w50", None, "漢字 " * 9]


@pytest.mark.parametrize("percent, longest", [(10, 1), (50, 3), (100, 2), (0, 1)])
def test_op13_as_plain_draw(spark, docs_of, percent, longest):
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ITEMS)], "item_id long, text string, doc_id int")
    got = resample.resample(docs_of(document_rows()), items, percent=percent, longest=longest, buckets=1000, seed=11)
    assert draw_rows(got) == plain_draw(document_rows(), ITEMS, percent, longest, 1000, 20, 11)


def test_op13_empty_tables(spark, docs_of):
    items = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs_of([]), items).collect() == []
    rows = document_rows()[:50]
    assert draw_rows(resample.resample(docs_of(rows), items, seed=3)) == plain_draw(rows, [], 10, 1, 10_000, 20, 3)


def test_op13_crc_of_spans():
    rnd = random.Random(7)
    raw = rnd.randbytes(3000)
    spans = [(a, a + n) for n in (1, 2, 63, 64, 65, 500) for a in (0, 17, 2000)]
    got = resample.span_crcs(np.frombuffer(raw, np.uint8), *map(np.array, zip(*spans)))
    assert got.tolist() == [zlib.crc32(raw[a:b]) for a, b in spans]


@pytest.mark.parametrize("rank", [1, 500, 5_000, 12_345, 20_000])
def test_op13_selection_is_exact_and_discards_quarters(spark, monkeypatch, rank):
    monkeypatch.setattr(resample, "FEW", 16)
    keys = spark.range(20_000, numPartitions=6).select(
        F.when(F.col("id") % 997 != 0, F.col("id") % 15_000).alias("doc_id"), (F.pmod(F.hash("id"), F.lit(300)) - 100).cast("long").alias("score"))
    keys = stored(keys.filter("doc_id % 3 != 0 or score > -90"), "test-keys")
    rows = sorted((-r["score"], r["doc_id"] is not None, r["doc_id"] or 0) for r in keys.collect())
    rank = min(rank, len(rows))
    cutoff, sizes = resample.select_cutoff(keys, rank)
    assert (cutoff.lost, bool(cutoff.known), cutoff.doc_id) == rows[rank - 1]
    assert all(b <= 0.76 * a + 2 for a, b in zip(sizes, sizes[1:]))
