import base64
import gzip
import hashlib
import io

import numpy as np
import pytest

from quillmesh.llm import ann, queries, warc


def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % 50 == 0:
            s = [(-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), i) for i, w in ok if i != q]
            out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def test_index_returns_all_within_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (3000, 16), dtype=np.uint16)
    codes[1000:2000] = codes[7] ^ (1 << rng.integers(0, 16, (1000, 16))).astype(np.uint16) * (rng.random((1000, 16)) < 0.5)
    index = ann.MultiIndex(codes)
    for radius in (0, 5, 7, 17, 33, 110, 256):
        dist = np.array([sum(bin(int(x)).count("1") for x in row) for row in codes ^ codes[7]])
        assert index.within(codes[7], radius).tolist() == np.flatnonzero(dist <= radius).tolist()


def test_recall_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op4_ann(spark, sf).collect()
    true = brute(rows)
    hits = sum(r["vec_id"] in {i for i, _ in true[r["query_id"]]} for r in got)
    assert len(got) == 5 * len(true) and hits >= 0.9 * len(got)
    score = {(q, i): s for q, found in true.items() for i, s in found}
    assert all(abs(score[r["query_id"], r["vec_id"]] - r["score"]) < 1e-12 for r in got if (r["query_id"], r["vec_id"]) in score)


def test_odd_vectors_ties_and_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(200, 260)]
    rows += [(300, None), (350, [0.0] * 6), (400, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (401, [float("nan")] * 6), (402, [float("inf")] + [1.0] * 5), (403, [1.0, 2.0]), (404, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    true = brute([r for r in rows if r[1] is not None and len(r[1]) == 6])
    for options in ({}, {"shard_rows": 40}):
        got = ann.nearest(df, df.where("vec_id % 50 = 0"), 5, **options).orderBy("query_id", "rank").collect()
        assert {r["query_id"] for r in got} == set(true)
        assert all([r["rank"] for r in got if r["query_id"] == q] == [1, 2, 3, 4, 5] for q in true)
        for q in (200, 250):
            assert [r["id"] for r in got if r["query_id"] == q] == [i for i in range(200, 260) if i != q][:5]
    few = df.where("vec_id IN (0, 1, 2)")
    assert ann.nearest(few, few.where("vec_id = 0"), 5).count() == 2
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_lengths_extremes_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [(200, [1e-200, 0.0, 0.0, 0.0]), (201, [1e300, 1e300, 0.0, 0.0]), (202, [1e300, -1e300, 1e300, 0.0]), (50, rows[50][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert {q: sum(r["query_id"] == q for r in got) for q in (0, 50, 100, 150, 200)} == dict.fromkeys((0, 50, 100, 150, 200), 5)
    scaled = [(i, (np.array(v) / max(map(abs, v))).tolist()) for i, v in rows]
    for q in (0, 200):
        v = dict(scaled)[q]
        same = sorted((-float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), i) for i, w in scaled if i != q and len(w) == len(v))[:5]
        assert [(r["id"], pytest.approx(r["score"])) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, -s) for s, i in same]
    assert all((r["query_id"] >= 100 and r["query_id"] < 200) == (100 <= r["id"] < 200) for r in got)


def page_rows():
    same, long = "<p>same</p>", "é😀\r\n\r\nWARC/1.1\r\n" * 40_000
    return [(5, "http://a/\r\nX: y", same), (3, "http://b/", same), (9, None, same), (1, "u", ""), (2, "u", None), (7, "u", long), (8, "ü?", "x\r\n\r\n"), (3, "http://b/", same), (None, "n", same)]


def digest(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(3)
    index = warc.archive(pages, f"file://{tmp_path}/warc")
    got = warc.read_archives(index).collect()
    want = []
    for i, _, p in page_rows():
        ids = [j for j, _, q in page_rows() if (q or "") == (p or "") and j is not None]
        kind, to = ("response", None) if i == min(ids) else ("revisit", str(min(ids)))
        want.append((None if i is None else str(i), kind, to, len((p or "").encode()), digest(p)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    for file in {r["file"] for r in index.collect()}:
        raw = open(file.removeprefix("file://"), "rb").read()
        rows = sorted((r["offset"], r["length"]) for r in index.collect() if r["file"] == file)
        assert rows[0][0] == 0 and sum(n for _, n in rows) == len(raw)
        assert all(gzip.decompress(raw[o : o + n]).startswith(b"WARC/1.1\r\n") for o, n in rows)
        side = open(file.removeprefix("file://") + ".idx").read().splitlines()
        assert [tuple(map(int, line.split("\t")[:2])) for line in side] == rows


FOREIGN = (
    b"WARC/1.0\r\nWARC-Type:warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\ncontent-length:   7\r\n\r\nsoft: x\r\n\r\n"
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nX-Long: a\r\n  folded\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 41\r\n\r\n"
    b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npage \xff\r\n\r\nmore!\n\r\n\r\n\r\n\r\n"
    b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:3>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
)


def test_foreign_archives_keep_their_names(spark, tmp_path):
    for name in ("crawl.2024.01.warc.gz", "crawl.2024.02.warc.gz", "sub/crawl.2024.01.warc.gz", "plain.gz"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        half = FOREIGN.index(b"WARC/1.0", 5)
        (tmp_path / "in" / name).write_bytes(gzip.compress(FOREIGN) if "01" in name else gzip.compress(FOREIGN[:half]) + gzip.compress(FOREIGN[half:]))
    index = warc.normalise(spark, f"{tmp_path}/in", f"file://{tmp_path}/out")
    rows = index.collect()
    names = {"crawl.2024.01.warc.gz", "crawl.2024.02.warc.gz", "sub/crawl.2024.01.warc.gz", "plain.warc.gz"}
    assert {r["file"].split("/out/")[1] for r in rows} == names == {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.warc.gz")}
    body = b"page \xff\r\n\r\nmore!\n"
    want = {("<urn:uuid:1", "warcinfo", 7), ("<urn:uuid:2", "response", len(body)), ("<urn:uuid:3", "resource", 0)}
    got = warc.read_archives(index).collect()
    assert len(got) == 12 and {(r["record_id"], r["record_type"], r["payload_bytes"]) for r in got} == want
    assert base64.b32encode(hashlib.sha1(body).digest()).decode() in {r["payload_digest"] for r in got}
    with pytest.raises(ValueError, match="has archives"):
        warc.normalise(spark, f"{tmp_path}/in", f"file://{tmp_path}/out")
    (tmp_path / "in" / "plain.warc.gz").write_bytes(gzip.compress(FOREIGN))
    with pytest.raises(ValueError, match="several files"):
        warc.normalise(spark, f"{tmp_path}/in", f"file://{tmp_path}/out2")


def test_a_task_that_runs_again_changes_nothing(tmp_path):
    store, _ = warc._file_system(f"file://{tmp_path}")
    for text in (b"one", b"two"):
        (tmp_path / "attempt").write_bytes(text)
        warc._settle(store, f"{tmp_path}/attempt", f"{tmp_path}/name")
    assert (tmp_path / "name").read_bytes() == b"one" and not (tmp_path / "attempt").exists()


def test_damage_is_named(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.warc.gz").write_bytes(gzip.compress(FOREIGN[:-60]))
    with pytest.raises(Exception, match="bad.warc.gz: a record is cut off"):
        warc.normalise(spark, f"{tmp_path}/in", f"file://{tmp_path}/out")


def test_minimum_size_and_empty_table(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    kinds = {(r["id"], r["record_type"]) for r in warc.records(pages, revisit_from_bytes=5).collect()}
    assert ("1", "response") in kinds and ("2", "response") in kinds and ("5", "revisit") in kinds
    assert warc.read_archives(warc.archive(pages.limit(0))).count() == 0


def test_inflate_many_members_and_cut_records():
    data = gzip.compress(b"abc" * 100_000) + gzip.compress(b"") + gzip.compress(b"xyz")
    assert b"".join(warc.inflate(io.BytesIO(data))) == b"abc" * 100_000 + b"xyz"
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"])))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"GET /\r\nContent-Length: 5\r\n\r\nabcde"])))
