import gzip

import pytest
from pyspark.sql import functions as F

from verbatim.llm import warc

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3\r\nX: y", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (4, None, None), (5, "u", ""), (6, "%0A", "é" * 100_000), (2, "http://a/2", "<p>one</p>"), (None, "n", "<p>one</p>"), (7, "z", "x\0y"),
]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    df = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/{compression}"
    warc.write_warc(warc.records_of(df.repartition(3)), path, compression=compression, file_bytes="1000")
    rows = warc.read_warc(spark, path).withColumn("page_id", warc.key_of(F.col("record_id"))).collect()
    assert len(rows) == len(PAGES)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows if r.payload_bytes == 10)
    assert kinds == [("1", "response", None), *[(k, "revisit", "<urn:page:1>") for k in ("2", "2", "None")]]
    for r in rows:
        want = next((u, (h or "").encode()) for i, u, h in PAGES if i == r.page_id)
        assert (r.target_uri, r.payload_bytes) == (want[0], len(want[1]))
        assert bytes(r.payload) == (want[1] if r.record_type == "response" else b"")
    assert sorted((str(r.page_id), r.record_type) for r in rows if r.payload_bytes == 0) == [("4", "response"), ("5", "revisit")]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_unwanted_payloads_are_skipped(tmp_path, compression):
    row = dict.fromkeys([c for c, _ in warc.HEADERS]) | {"payload": b"p" * 500_000}
    records = [warc.record_bytes(row | {"record_type": t, "record_id": str(i), "payload_bytes": 500_000}) for i, t in enumerate(["response", "revisit"] * 3)]
    name = "a.warc" + ".gz" * (compression == "gzip")
    pack = warc.member if compression == "gzip" else bytes
    (tmp_path / name).write_bytes(b"".join(map(pack, records)))

    def read(**kind):
        from pyspark.sql.datasource import EqualTo
        from pyspark.sql.types import _parse_datatype_string

        reader = warc.WarcReader({"path": str(tmp_path)}, _parse_datatype_string(warc.SCHEMA))
        left = list(reader.pushFilters([EqualTo((k,), v) for k, v in kind.items()]))
        return left, [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]

    left, rows = read(record_type="revisit")
    assert not left and [r["record_id"] for r in rows] == ["1", "3", "5"] and all(len(r["payload"]) == 500_000 for r in rows)
    left, rows = read(payload_bytes=1)
    assert len(left) == 1 and len(rows) == 6


def test_archives_of_other_writers(tmp_path, spark):
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nX-Other: 1\r\nContent-Length: 3\r\n\r\n"
    (tmp_path / "o.warc.gz").write_bytes(gzip.compress(head + b"abc\r\n\r\n") + gzip.compress(head + b"def\r\n\r\n"))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [bytes(r.payload) for r in rows] == [b"abc", b"def"]
    (tmp_path / "bad.warc").write_bytes(b"nonsense\r\n\r\n")
    with pytest.raises(Exception, match="no record where one should begin"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_small_payloads_are_not_revisited_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "bbb"), (4, "u", "bbb")], "page_id long, url string, html string")
    kinds = {r.record_id: r.record_type for r in warc.records_of(df, least_bytes=2).collect()}
    assert [kinds[f"<urn:page:{i}>"] for i in (1, 2, 3, 4)] == ["response", "response", "response", "revisit"]
    path = f"file://{tmp_path}/none"
    warc.write_warc(warc.records_of(df.limit(0)), path)
    assert warc.read_warc(spark, path).count() == 0


def test_all_records_of_a_member_without_lengths(tmp_path):
    head = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\n"
    record = lambda i, kind, n: head.format(kind, i, n).encode() + bytes([97 + i % 26]) * n + b"\r\n\r\n"
    records = [record(i, ("response", "revisit")[i % 2], 200_000 * (i % 4) + i) for i in range(20)]
    row = dict.fromkeys([c for c, _ in warc.HEADERS]) | {"record_type": "response", "record_id": "own", "payload": b"own"}
    own = warc.member(warc.record_bytes(row | {"payload_bytes": 3}))
    one = gzip.compress(b"".join(records))
    # One stream; members of this package before and behind it; records that go on in the next member.
    whole = b"".join(records)
    parts = b"".join(gzip.compress(whole[i : i + 70_001]) for i in range(0, len(whole), 70_001))

    def read(data, payload=True):
        from pyspark.sql.types import _parse_datatype_string

        (tmp_path / "a.warc.gz").write_bytes(data)
        reader = warc.WarcReader({"path": str(tmp_path)} | ({} if payload else {"payload": "false"}), _parse_datatype_string(warc.SCHEMA))
        return [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]

    for data, extra in ((one, 0), (own + one + own, 2), (parts + own, 1)):
        rows = [r for r in read(data) if r["record_id"] != "own"]
        assert [r["record_id"] for r in rows] == [f"<urn:page:{i}>" for i in range(20)]
        assert [r["payload"] for r in rows] == [bytes([97 + i % 26]) * (200_000 * (i % 4) + i) for i in range(20)]
        assert len(read(data, payload=False)) == 20 + extra
    with pytest.raises(ValueError, match="without an end"):
        read(one[:-20])
