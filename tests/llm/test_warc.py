"""Operator 9: exact round trip, pushed filters, lost tasks."""
import gzip
import hashlib
import os

import pyarrow as pa

from codeaudit.llm.warc import SCHEMA, WarcDataSource, WarcReader, WarcWriter, archive, records
from pyspark.sql.datasource import EqualTo, StringStartsWith
from pyspark.sql.types import StringType, StructField, StructType

FIELDS = StructType([StructField(x.split()[0], StringType()) for x in SCHEMA.split(", ")])
PAGES = "page_id long, url string, html string"


def build(spark, rows):
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_round_trip(spark):
    big = "é<p>" * 400
    rows = [(1, "http://a.example/x y\n", big), (2, None, big), (3, "http://a.example/3", "small"), (4, "u", "small"),
            (5, "u", None), (6, "u", ""), (7, "http://b.example/", "\r\n\r\n" + "z" * 200_000), (None, "n", big),
            (8, "u", "q" * 999), (9, "u", "q" * 999), (10, "u", "q" * 1000), (11, "u", "q" * 1000), (11, "u", "q" * 1000)]
    path = archive(build(spark, rows))
    got = records(spark, path).collect()
    want = []
    for i, _, t in rows:
        p = (t or "").encode()
        last = max(j for j, _, u in rows if j is not None and u == t) if len(p) >= 1000 else i
        again = len(p) >= 1000 and i != last
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last if again else None))
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=str) == sorted(want, key=str)
    texts = {i: (t or "").encode() for i, _, t in rows}
    assert all((bytes(x.payload) == texts[x.page_id]) if x.record_type == "response" else x.payload is None for x in got)
    assert {x.target_uri for x in got if x.page_id in (1, 2)} == {"http://a.example/x%20y%0A", None}


def test_all_ids_null_and_empty(spark):
    path = archive(build(spark, [(None, "u", "k" * 2000), (None, "v", "k" * 2000)]))
    assert [x.record_type for x in records(spark, path).collect()] == ["response", "response"]
    assert records(spark, archive(build(spark, []))).count() == 0
    extra = build(spark, [(1, "u", "t")]).selectExpr("*", "1 as digest", "2 as n", "3 as payload", "4 as kept")
    assert [bytes(x.payload) for x in records(spark, archive(extra)).collect()] == [b"t"]


def test_pushdown(spark):
    path = archive(build(spark, [(i, f"http://{'ab'[i % 2]}.example/{i}", "p" * (1500 if i % 3 else 40)) for i in range(60)]))
    df = spark.read.format("warc").load(path).filter("record_type = 'response' and target_uri like 'http://a.%'")
    assert sorted(x.record_id for x in df.collect()) == sorted(
        f"urn:page:{i}" for i in range(60) if i % 2 == 0 and i % 3 == 0)
    few = spark.read.format("warc").option("record_types", "revisit").option("uri_prefix", "http://b").load(path)
    assert {x.record_type for x in few.collect()} == {"revisit"} and few.filter("target_uri like 'http://a%'").count() == 0
    narrow = spark.read.format("warc").schema("record_id string, payload_length long").load(path)
    assert narrow.count() == 60 and narrow.columns == ["record_id", "payload_length"]


def batch(rows):
    names = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_length", "payload"]
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])


def read(path, **options):
    r = WarcReader(FIELDS, {"path": path} | options)
    return r, [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]


def test_only_committed_files_count(tmp_path):
    w = WarcWriter({"path": str(tmp_path), "file_bytes": "2000"})
    lost = w.write(iter([batch([("response", "urn:lost", None, None, None, 3, b"abc")])]))
    kept = w.write(iter([batch([("response", f"urn:{i}", "u", None, None, 3, os.urandom(600)) for i in range(20)])]))
    w.commit([kept])
    assert len(kept.files) > 3 and lost.files[0] not in kept.files
    r, rows = read(str(tmp_path), split_bytes="4000")
    assert len(r.partitions()) > 1 and {x["record_id"] for x in rows} == {f"urn:{i}" for i in range(20)}


def test_unwanted_payloads_are_not_inflated(tmp_path):
    """With skip lengths a broken payload does no harm unless it is wanted."""
    w = WarcWriter({"path": str(tmp_path)})
    f = w.write(iter([batch([("response", "urn:1", "u", None, None, 9, os.urandom(50_000)),
                             ("response", "urn:2", "v", None, None, 3, b"abc")])])).files[0]
    data = bytearray((tmp_path / f).read_bytes())
    data[20_000:30_000] = b"\xff" * 10_000
    (tmp_path / f).write_bytes(data)
    r = WarcReader(FIELDS, {"path": str(tmp_path)})
    assert list(r.pushFilters([EqualTo(("target_uri",), "v")])) == []
    assert [x["payload"] for p in r.partitions() for b in r.read(p) for x in b.to_pylist()] == [b"abc"]


def test_other_writers(tmp_path):
    rec = lambda t, body: (f"WARC/1.0\r\nWARC-Type: {t}\r\nwarc-target-uri: http://x/{t}\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    data = [rec("warcinfo", b"software: x"), rec("response", b"y" * 100_000), rec("metadata", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    _, rows = read(str(tmp_path))
    assert sorted((x["record_type"], len(x["payload"])) for x in rows) == sorted(
        [("warcinfo", 11), ("response", 100_000), ("metadata", 0)] * 2)
    r = WarcReader(FIELDS, {"path": str(tmp_path)})
    rest = list(r.pushFilters([EqualTo(("record_type",), "response"), StringStartsWith(("target_uri",), "http://x/r"), EqualTo(("payload_length",), 3)]))
    assert len(rest) == 1 and len([x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]) == 2
    assert WarcDataSource.name() == "warc"
