r"""Web archives (WARC 1.1) of Zstandard frames, written and read back.

An archive begins with a skippable frame that holds a dictionary, plain or as a Zstandard frame itself; then
each record is a frame of its own. Archives are files of a folder that driver and executors share, written
by tasks under a passing name and renamed when whole, so that a task that runs again leaves the same files;
Spark reads them back with its binaryFile source. A writer holds one record at a time and begins a new archive
after `archive_bytes` of payload; a reader holds one archive.

Of records with equal payloads of `least` bytes or more, that with the smallest page_id is a response, and
the others are revisits that name it and carry headers only. Equal payloads are found by digests, 32
characters each: no page is shuffled for that but once, to its archive, by page_id and digest.

The reader checks each frame (its blocks, its end), the record's version, the headers that must be there,
Content-Length, the line ends behind the block, the digests of block and payload, the length of the HTTP
body, and what a revisit refers to. What fails is a row with `error`; behind a broken frame an archive cannot
be read on, and its last row says so.

Defined results: a null html is an empty payload; a null url is no target; a null page_id is an id of its
own, larger than others, and a revisit of such a page refers to null; of equal rows the first is the
response; an empty table makes no archive, and an empty folder no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.llm.common import shared_dir, written

#: Payload in one archive, about.
ARCHIVE_BYTES = 64 << 20
#: Payloads of this length or more are compared.
LEAST = 0
#: A dictionary is made of so many pages, the first that a scan gives, and so many bytes of each. It changes sizes, never results.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8 << 10, 64 << 10
LEVEL = 3

#: Fixed values of the formats.
SKIPPABLE, FRAME, TRAINED = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MUST = ("warc-type", "warc-record-id", "warc-date", "content-length")
END = b"\r\n\r\n"

MANIFEST = "archive string, records long, payload_bytes long, archive_bytes long"
RECORDS = (
    "archive string, at long, frame_bytes long, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_date string, error string"
)
RECORD_TYPES = pa.schema([
    ("archive", pa.string()), ("at", pa.int64()), ("frame_bytes", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("warc_date", pa.string()), ("error", pa.string()),
])
ID = re.compile(r"<urn:page:(-?[0-9]+|none)(?:#[0-9]+)?>")


def digest(data: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, date: str, revisits: bool, refers_to: int | None = None, nth: int = 0) -> bytes:
    """A response, or a revisit of another page. nth: how many records of this page_id and payload came before."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    headers = {"WARC-Type": "revisit" if revisits else "response", "WARC-Record-ID": f"{name(page_id)[:-1]}#{nth}>" if nth else name(page_id), "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")
    if revisits:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to)}
    headers |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers.items())]) + END + block + END


def headed(lines: bytes) -> dict[str, str]:
    """Headers by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in lines.split(b"\r\n"):
        text = line.decode()
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
            continue
        key, colon, value = text.partition(":")
        if not colon or not key or key != key.strip():
            raise ValueError("a header without a name")
        last = key.lower()
        out[last] = value.strip()
    return out


def parsed(data: bytes) -> dict:
    """The fields of RECORDS that a record gives; ValueError for what is not right in it."""
    head, end, rest = data.partition(END)
    version, line, fields = head.partition(b"\r\n")
    if not end or not line or version not in (VERSION, b"WARC/1.0"):
        raise ValueError("no WARC header")
    h = headed(fields)
    if missing := [m for m in MUST if m not in h]:
        raise ValueError(f"without {', '.join(missing)}")
    if not h["content-length"].isdecimal() or len(rest) != int(h["content-length"]) + len(END):
        raise ValueError("length of the block")
    block = rest[: -len(END)]
    if rest[-len(END) :] != END:
        raise ValueError("end of the record")
    kind = h["warc-type"]
    out = {"record_type": kind, "warc_date": h["warc-date"], "url": h.get("warc-target-uri")}
    if own := ID.fullmatch(h["warc-record-id"]):
        out["page_id"] = None if own[1] == "none" else int(own[1])
    if (given := h.get("warc-block-digest")) and given != f"sha1:{digest(block)}":
        raise ValueError("digest of the block")
    if kind not in ("response", "revisit"):
        return out | {"payload": block, "payload_bytes": len(block), "payload_digest": digest(block)}
    if not own:
        raise ValueError("record id")
    http, end, payload = block.partition(END)
    status, _, fields = http.partition(b"\r\n")
    size = headed(fields).get("content-length", "")
    if not end or not status.startswith(b"HTTP/") or not size.isdecimal():
        raise ValueError("no HTTP header")
    given = h.get("warc-payload-digest", "")
    if kind == "response":
        if len(payload) != int(size):
            raise ValueError("length of the payload")
        if given != f"sha1:{digest(payload)}":
            raise ValueError("digest of the payload")
        out["payload"] = payload
    else:
        refers = ID.fullmatch(h.get("warc-refers-to", ""))
        if payload or not refers or h.get("warc-profile") != PROFILE or not re.fullmatch("sha1:[A-Z2-7]{32}", given):
            raise ValueError("revisit")
        out["refers_to"] = None if refers[1] == "none" else int(refers[1])
    return out | {"payload_bytes": int(size), "payload_digest": given.removeprefix("sha1:")}


def frame_length(data: memoryview) -> int:
    """Bytes of the frame that data begins with, from the headers of its blocks; ValueError where it is cut off."""
    try:
        flags, at = data[4], zstandard.frame_header_size(bytes(data[:18]))
        last = False
        while not last:
            bits = int.from_bytes(data[at : at + 3], "little")
            if at + 3 > len(data) or (kind := bits >> 1 & 3) == 3:
                raise ValueError("a broken frame")
            last, at = bool(bits & 1), at + 3 + (1 if kind == 1 else bits >> 3)
    except (IndexError, zstandard.ZstdError):
        raise ValueError("a broken frame") from None
    at += 4 * bool(flags & 4)
    if at > len(data):
        raise ValueError("a frame that is cut off")
    return at


def frames(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(place, length, content) of an archive's records; content None where a frame cannot be read, which ends it."""
    view, at = memoryview(data), 0
    decoder = zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
        if magic >> 4 == SKIPPABLE >> 4:
            end = at + 8 + size
            if end > len(view):
                yield at, len(view) - at, None
                return
            if at == 0 and magic == SKIPPABLE:
                content = bytes(view[8:end])
                try:
                    if content[:4] == struct.pack("<I", FRAME):
                        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                    if content[:4] != struct.pack("<I", TRAINED):
                        raise ValueError("no dictionary")
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
                except (ValueError, zstandard.ZstdError):
                    yield at, size + 8, None
                    return
            at = end
            continue
        try:
            size = frame_length(view[at:]) if magic == FRAME else 0
            part = decoder.decompressobj()
            content = part.decompress(bytes(view[at : at + size])) if size else None
            content = content if part.eof else None
        except (ValueError, zstandard.ZstdError):
            content = None
        yield at, size or len(view) - at, content
        if content is None:
            return
        at += size


class Archive:
    """An archive that is being written: a passing name first, the real one at the end."""

    def __init__(self, folder: str, file: str, dictionary: bytes):
        from pyarrow import fs

        self.system, base = fs.FileSystem.from_uri(folder)
        self.file, self.path = file, posixpath.join(base, file)
        self.passing = posixpath.join(base, f"_{file}.{uuid.uuid4().hex}")
        self.out = self.system.open_output_stream(self.passing, compression=None)
        self.records = self.payload = self.size = 0
        self.coder = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
        if dictionary:
            self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record_: bytes, payload: int) -> None:
        self._put(self.coder.compress(record_))
        self.records += 1
        self.payload += payload

    def close(self) -> dict:
        self.out.close()
        self.system.move(self.passing, self.path)
        return {"archive": self.file, "records": self.records, "payload_bytes": self.payload, "archive_bytes": self.size}


def trained(pages: DataFrame) -> bytes:
    """A dictionary of a bounded sample of pages; none where there are too few."""
    head = F.substring(F.coalesce(F.col("html").cast("string"), F.lit("")), 1, SAMPLE_BYTES)
    some = sorted(r["head"].encode()[:SAMPLE_BYTES] for r in pages.select(head.alias("head")).limit(SAMPLE_PAGES).collect())
    size = min(DICTIONARY_BYTES, sum(map(len, some)) // 8)
    try:
        return zstandard.train_dictionary(size, [s for s in some if s]).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in a folder; MANIFEST, a row for each.

    folder is a URI of a file system that pyarrow knows (or an absolute path), and must exist for a local one.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    pages = pages.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    keys = written(pages.select("page_id", "sha1", F.octet_length("html").cast("long").alias("bytes")), "payloads")
    heads = keys.filter(F.col("bytes") >= least).groupBy(F.col("sha1").alias("s_")).agg(F.min("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    marks = keys.join(heads, F.col("sha1") == F.col("s_")).filter(~F.col("page_id").eqNullSafe(F.col("head"))).select("page_id", "sha1", "head").distinct()
    # Marks and pages of one page_id and payload meet in one task's sort, marks first; a key with very many rows is a stream.
    both = pages.withColumns({"mark": F.lit(1), "head": F.lit(None).cast("long")}).unionByName(marks.withColumn("mark", F.lit(0)), allowMissingColumns=True)
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-total // archive_bytes))
    dictionary = trained(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, done, count, last, head, nth = TaskContext.get().partitionId(), None, [], 0, None, None, 0
        for batch in batches:
            for page_id, url, text, sha1, mark, other in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "sha1", "mark", "head")), strict=True):
                if (page_id, sha1) != last:
                    last, head, nth = (page_id, sha1), None, 0
                if not mark:
                    head = (other,)
                    continue
                payload = text.encode()
                again = nth > 0 and len(payload) >= least
                if archive is None:
                    archive = Archive(folder, f"pages-{task:06d}-{count:04d}.warc.zst", dictionary)
                archive.add(record(page_id, url, payload, date, bool(head) or again, head[0] if head else page_id, nth), len(payload))
                nth += 1
                if archive.payload >= archive_bytes:
                    done, archive, count = [*done, archive.close()], None, count + 1
        done += [archive.close()] if archive else []
        yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64()), ("archive_bytes", pa.int64())]))

    rows = both.repartition(parts, "page_id", "sha1").sortWithinPartitions("page_id", "sha1", "mark", "url").select("page_id", "url", "html", "sha1", "mark", "head")
    return written(rows.mapInArrow(run, MANIFEST), "archives")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """RECORDS: a row for each record of a folder's archives, with `error` for what is not right. payloads: whether rows carry them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, data = batch["path"][k].as_py(), batch["content"][k].as_py()
                rows, held = [], 0
                for at, size, content in frames(data):
                    row = {"archive": posixpath.basename(path), "at": at, "frame_bytes": size}
                    try:
                        row |= parsed(content) if content is not None else {"error": "a broken frame"}
                    except ValueError as e:
                        row["error"] = str(e) if type(e) is ValueError else "a header in another encoding"
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, RECORD_TYPES)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD_TYPES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def checked(records: DataFrame) -> DataFrame:
    """records; one with an error ends the job."""
    said = F.concat_ws(" ", F.lit("archive"), "archive", F.lit("at"), F.col("at").cast("string"), F.lit(":"), "error")
    return records.withColumn("record_type", F.when(F.col("error").isNotNull(), F.raise_error(said)).otherwise(F.col("record_type")))


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    from pyarrow import fs

    base = shared_dir(spark).rstrip("/")
    folder = f"{base}/warc-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return folder


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return checked(read(spark, folder, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in hex, five digits at a time, gives four characters of base32.
ORACLE_SQL = """with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
heads as (select x, min(page_id) as head from p group by x),
parts as (select p.*, head, list_transform(range(8), lambda j: cast('0x' || substr(p.x, 5 * j + 1, 5) as int)) as v from p join heads on heads.x = p.x)
select page_id, octet_length(encode(h))::bigint as payload_bytes,
array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> s) % 32 + 1, 1)), '')), '') as payload_digest,
case when page_id = head then 'response' else 'revisit' end as record_type, case when page_id <> head then head end as refers_to from parts"""
