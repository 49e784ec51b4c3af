"""Web archives: round trip against plain Python, and what the reader finds wrong."""

import base64
import hashlib
import os
import struct

import pytest
import zstandard

from maskwerk.llm import archives as A

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (5, "http://a/ü?q=1 2", "<p>one</p>" * 50), (2, "http://b", "<p>one</p>" * 50), (9, None, "<p>one</p>" * 50), (9, None, "<p>one</p>" * 50),
    (1, "http://c", None), (3, "http://d", ""), (None, "http://e", ""), (4, "x\r\nWARC-Type: y", "WARC/1.1\r\n\r\n\r\n\r\n"), (4, "http://g", "WARC/1.1\r\n\r\n\r\n\r\n"), (4, "http://g", "other"),
    (7, "", "ü梦😀" * 3000), (8, "http://h", "\0" * 10), (10, "http://i", "long " * 400_000),
]


def plain(rows, least=0):
    """Rows of the contract: the first of the smallest id is the response."""
    out, seen = [], set()
    body = [(None if i is None else i, (h or "").encode()) for i, _, h in rows]
    least_id = {}
    for i, b in body:
        least_id[b] = min(least_id.get(b, (1, 0)), (i is None, i or 0))
    for i, b in body:
        first = (i is None, i or 0) == least_id[b] and b not in seen
        head = None if least_id[b][0] else least_id[b][1]
        if first:
            seen.add(b)
        kind = "response" if first or len(b) < least else "revisit"
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, head if kind == "revisit" else None))
    return sorted(out, key=str)


def folder(tmp_path, name="w"):
    (tmp_path / name).mkdir()
    return str(tmp_path / name)


def result(spark, where):
    rows = A.checked(A.read(spark, where)).collect()
    for r in rows:
        if r["record_type"] == "response":
            assert len(r["payload"]) == r["payload_bytes"] and A.digest(bytes(r["payload"])) == r["payload_digest"]
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


@pytest.mark.parametrize("least", [0, 1, 20, 1 << 40])
@pytest.mark.parametrize("size", [300_000, 1 << 30])
def test_round_trip(spark, tmp_path, least, size):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4).withColumns({c: F.lit(1) for c in ("sha1", "mark", "head", "bytes", "payload")})
    where = folder(tmp_path)
    manifest = A.write(df, where, least=least, archive_bytes=size).collect()
    assert result(spark, where) == plain(ROWS, least)
    assert sorted(os.listdir(where)) == sorted(r["archive"] for r in manifest) and sum(r["records"] for r in manifest) == len(ROWS)
    assert {r["archive"]: r["archive_bytes"] for r in manifest} == {f: os.path.getsize(f"{where}/{f}") for f in os.listdir(where)}


def test_nothing(spark, tmp_path):
    where = folder(tmp_path)
    assert A.write(spark.createDataFrame([], SCHEMA), where).collect() == [] and A.read(spark, where).collect() == []


def test_the_same_files_again(spark, tmp_path):
    """A task that runs again, or a job, leaves the same files."""
    both = [folder(tmp_path, n) for n in "ab"]
    for n, where in enumerate(both):
        A.write(spark.createDataFrame(ROWS[:-1], SCHEMA).repartition(n + 2), where, archive_bytes=5000)
    a, b = ({f: open(f"{w}/{f}", "rb").read() for f in os.listdir(w)} for w in both)
    assert a == b


def test_given_pages(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    where = folder(tmp_path)
    (manifest,) = A.write(df, where).collect()
    assert result(spark, where) == plain(rows)
    data = open(f"{where}/{manifest['archive']}", "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and data[8:12] == struct.pack("<I", 0xEC30A437)
    # The library itself finds one frame for each record, with the dictionary of the first frame.
    part, at, count = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size, 0
    while at < len(data):
        one = zstandard.ZstdDecompressor(dict_data=part).decompressobj()
        assert one.decompress(data[at:]).startswith(b"WARC/1.1\r\n") and one.eof
        at, count = len(data) - len(one.unused_data), count + 1
    assert count == len(rows) and {r["url"] for r in A.read(spark, where).collect()} == {u for _, u, _ in rows}


def archive(*records, dictionary=b"", packed=False):
    head = b""
    if dictionary:
        inner = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
        head = struct.pack("<II", 0x184D2A5D, len(inner)) + inner
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    return head + b"".join(coder.compress(r) for r in records)


def said(spark, tmp_path, data):
    where = folder(tmp_path)
    with open(f"{where}/x.warc.zst", "wb") as f:
        f.write(data)
    return [(r["page_id"], r["error"]) for r in A.read(spark, where).orderBy("at").collect()]


GOOD = A.record(1, "http://a", b"body", "2020-01-01T00:00:00Z", False)


@pytest.mark.parametrize(
    ("record", "error"),
    [
        (GOOD, None),
        (GOOD.replace(b"WARC/1.1", b"WARC/9.1"), "no WARC header"),
        (GOOD.replace(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b""), "without warc-date"),
        (GOOD[:-1], "length of the block"),
        (GOOD + b"x", "length of the block"),
        (GOOD[:-4] + b"\r\n\r\r", "end of the record"),
        (GOOD.replace(b"body", b"bode"), "digest of the block"),
        (GOOD.replace(b"WARC-Type: response", b"nothing here"), "a header without a name"),
        (GOOD.replace(b"WARC-Type: response", b"WARC-Type: revisit"), "revisit"),
        (GOOD.replace(b"<urn:page:1>", b"<urn:page:one>"), "record id"),
        (GOOD.replace(b"http://a", b"http://\xff"), "a header in another encoding"),
    ],
)
def test_records_that_are_wrong(spark, tmp_path, record, error):
    got = said(spark, tmp_path, archive(GOOD, record, GOOD))
    assert got == [(1, None), (1 if error is None else None, error), (1, None)]


def test_digest_of_the_payload(spark, tmp_path):
    wrong = GOOD.replace(A.digest(b"body").encode(), A.digest(b"else").encode())
    assert said(spark, tmp_path, archive(wrong)) == [(None, "digest of the payload")]


def test_other_records_and_headers_over_lines(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nwarc-date: 2020-01-01T00:00:00Z\r\nX: a\r\n b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert said(spark, tmp_path, archive(info, GOOD)) == [(None, None), (1, None)]


@pytest.mark.parametrize("packed", [False, True])
def test_dictionaries(spark, tmp_path, packed):
    many = [A.record(i, f"http://a/{i}", b"<p>body %d</p>" % i * 20, "2020-01-01T00:00:00Z", False) for i in range(400)]
    dictionary = zstandard.train_dictionary(4096, many).as_bytes()
    assert said(spark, tmp_path, archive(*many, dictionary=dictionary, packed=packed)) == [(i, None) for i in range(400)]


def test_broken_archives(spark, tmp_path):
    whole = archive(GOOD, GOOD, GOOD)
    one = len(archive(GOOD))
    cases = [whole[:-3], whole[: 2 * one + 2], whole[: 2 * one] + b"nonsense", whole[: 2 * one] + struct.pack("<II", 0x184D2A50, 99) + b"x"]
    for n, data in enumerate(cases):
        (tmp_path / str(n)).mkdir()
        assert said(spark, tmp_path / str(n), data) == [(1, None), (1, None), (None, "a broken frame")], n
    # A skippable frame between records is passed over; a first one that holds no dictionary is an error.
    (tmp_path / "s").mkdir()
    assert said(spark, tmp_path / "s", whole[:one] + struct.pack("<II", 0x184D2A5E, 1) + b"x" + whole[one:]) == [(1, None)] * 3
    (tmp_path / "d").mkdir()
    assert said(spark, tmp_path / "d", struct.pack("<II", 0x184D2A5D, 4) + b"none" + whole) == [(None, "a broken frame")]


def test_an_error_ends_the_query(spark, tmp_path):
    where = folder(tmp_path)
    with open(f"{where}/x.warc.zst", "wb") as f:
        f.write(archive(GOOD[:-1]))
    with pytest.raises(Exception, match="length of the block"):
        A.checked(A.read(spark, where)).collect()
