import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


ROWS = [(1, "http://a/1", "<p>x</p>"), (2, "http://b/2", "<p>x</p>"), (3, None, None), (4, "http://c/\r\n4", ""), (5, "http://d", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n é 漢"), (None, "http://e", "<p>x</p>"), (6, "http://f", "z" * 300_000), (7, "u", "only"), (7, "u", "only")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "page_id long, url string, html string, id string, payload string, winner int")


def written(spark, tmp_path, **how):
    path = str(tmp_path / "w")
    warc.write(warc.records(pages(spark)), path, **how)
    return path


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    path = written(spark, tmp_path, compression=compression)
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.record_id, []).append(r)
    for i, url, html in ROWS:
        data = (html or "").encode()
        r = by[f"<urn:x-page:{'null' if i is None else i}>"][0]
        winner = max(k for k, _, h in ROWS if (h or "") == (html or "") and k is not None)
        assert r.payload_digest == f"sha1:{digest(data)}" and r.declared_length == len(data) and r.payload_length == (len(data) if i == winner else 0)
        assert r.target_uri == (url.replace("\r", " ").replace("\n", " ") if url else None)
        assert (r.warc_type, r.refers_to) == (("response", None) if i == winner else ("revisit", f"<urn:x-page:{winner}>"))
        assert r.payload == (data if i == winner else None)
    assert len(by["<urn:x-page:7>"]) == 2 and {r.warc_type for r in by["<urn:x-page:7>"]} == {"response"}


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    path = written(spark, tmp_path)
    back = warc.read(spark, path)
    some = back.where((F.col("warc_type") == "response") & F.col("target_uri").startswith("http://"))
    assert sorted(r.target_uri for r in some.collect()) == ["http://b/2", "http://c/  4", "http://d", "http://f"]
    assert back.where(F.col("warc_type").isin("revisit")).count() == 3
    assert back.where(F.col("target_uri").isNotNull()).count() == 8
    bare = {r.record_id: r for r in warc.read(spark, path, payload=False).collect()}
    assert all(r.payload is None for r in bare.values()) and bare["<urn:x-page:6>"].payload_length == 300_000


def test_filters_that_the_reader_takes():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = warc.WarcReader({"path": "/nowhere"})
    left = list(reader.pushFilters([EqualTo(("warc_type",), "response"), GreaterThan(("payload_length",), 3), StringStartsWith(("target_uri",), "http")]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    assert reader.wanted({"warc-type": "response", "warc-target-uri": "http://x"}) and not reader.wanted({"warc-type": "revisit", "warc-target-uri": "http://x"}) and not reader.wanted({"warc-type": "response"})


def test_foreign_archive(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nhello"
    record = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI: http://x\r\n /y\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record))
    (tmp_path / "b.warc").write_bytes(record + info)
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.warc_type, bytes(r.payload)) for r in rows) == [("response", b"hello")] * 2 + [("warcinfo", b"abcd")] * 2
    assert {r.target_uri for r in rows if r.warc_type == "response"} == {"http://x /y"}
    plan = [p.pieces for p in warc.WarcReader({"path": str(tmp_path), "partition_bytes": "100"}).partitions()]
    assert [len(x) for x in plan] == [1] * 4 and sum(sorted(b - a for ((_, a, b),) in plan)[:3]) == len(record + info)  # the plain file in three ranges, the other whole


def http(payload, length=None, more=b"", kind=b"response", block=None):
    """One record; `length` is what the HTTP head says, `block` what the record itself says."""
    body = b"HTTP/1.1 200 OK\r\n%s%s\r\n%s" % (more, b"" if length is None else b"Content-Length: %s\r\n" % length, payload)
    return b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Type: application/http\r\nContent-Length: %s\r\n\r\n%s\r\n\r\n" % (kind, str(len(body)).encode() if block is None else block, body)


def listed(spark, path, **options):
    return [(r.payload_length, r.declared_length, None if r.payload is None else bytes(r.payload)) for r in warc.read(spark, str(path), **options).collect()]


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_lengths_come_from_the_block(spark, tmp_path, name):
    long_head = b"".join(b"X-%d: %s\r\n" % (i, b"v" * 90) for i in range(220)) + b"X-Long: " + b"w" * 200_000 + b"\r\n"
    data = [http(b"hello", b"5", long_head), http(b"hello", b"99"), http(b"hello", b"5, 5"), http(b"hello", b"-1"), http(b"hello", b"9" * 40), http(b"hello"), http(b"", b"0"), http(b"", b"7", kind=b"revisit")]
    want = [(5, 5, b"hello"), (5, 99, b"hello"), *[(5, None, b"hello")] * 4, (0, 0, b""), (0, 7, None)]
    headless = b"HTTP/1.1 200 OK\r\nno empty line"
    data.append(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(headless), headless))
    want.append((0, None, b""))
    whole = b"".join(data)
    (tmp_path / name).write_bytes(gzip.compress(whole) if name.endswith("gz") else whole)
    assert listed(spark, tmp_path / name) == want
    assert listed(spark, tmp_path / name, payload=False) == [(a, b, None) for a, b, _ in want]


def test_bad_record_lengths(spark, tmp_path):
    whole = http(b"one", b"3", block=b"x") + http(b"two", b"3", block=b"") + http(b"three", b"5", block=b"20") + http(b"four", b"4") + http(b"last", b"4", block=b"5000")
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole))
    for name in ("a.warc", "b.warc.gz"):
        got = listed(spark, tmp_path / name)
        assert got[:2] == [(None, None, None)] * 2 and got[3] == (4, 4, b"four") and len(got) == 5
        assert got[2][2] == b"" and got[4] == (8, 4, b"last\r\n\r\n")
        assert [x[0] for x in listed(spark, tmp_path / name, payload=False)] == [x[0] for x in got]


def test_a_large_file_is_read_in_ranges(spark, tmp_path):
    nested = b"\r\n\r\n" + http(b"inner", b"5")  # a payload that holds what looks like a record
    payloads = [b"p%d " % i * (i % 40) + (nested if i % 3 == 0 else b"") for i in range(200)]
    (tmp_path / "a.warc").write_bytes(b"".join(http(p, b"%d" % len(p)) for p in payloads))
    for size in ("1000", "7000", "100000000"):
        frame = warc.read(spark, str(tmp_path / "a.warc"), partition_bytes=size)
        assert (frame.rdd.getNumPartitions() > 1) == (size != "100000000")
        assert [bytes(r.payload) for r in frame.collect()] == payloads
        assert sum(r.payload_length for r in warc.read(spark, str(tmp_path / "a.warc"), payload=False, partition_bytes=size).collect()) == sum(map(len, payloads))


def test_verdicts_joined_by_id_are_those_of_the_broadcast(spark, monkeypatch):
    few = {tuple(r) for r in warc.records(pages(spark)).collect()}
    monkeypatch.setattr(warc, "fits", lambda df: False)
    assert {tuple(r) for r in warc.records(pages(spark)).collect()} == few and warc.records(pages(spark)).count() == len(ROWS)


def test_empty_tables_and_query(spark, sf_dir, tmp_path):
    path = str(tmp_path / "none")
    warc.write(warc.records(pages(spark).limit(0)), path)
    assert warc.read(spark, path).count() == 0
    rows = queries.op8_warc(spark, sf_dir).collect()
    html = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(html) and all((r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), digest(html[r.page_id])) for r in rows)


def test_paths_of_other_schemes_are_never_local():
    assert warc._uri("s3a://bucket/a/b") == "s3://bucket/a/b" and warc._uri("s3n://b/x") == "s3://b/x" and warc._uri("hdfs://host/a") == "hdfs://host/a"
    assert warc._uri("/tmp/x") is None and warc._uri("file:/tmp/x") is None and warc._uri("file:///tmp/x") is None
    assert warc._open("file:/tmp/x")[1] == warc._open("file:///tmp/x")[1] == warc._open("/tmp/x")[1] == "/tmp/x"
    with pytest.raises(Exception):
        warc._open("dbfs:/x")
