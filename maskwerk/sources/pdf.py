"""Text of PDF pages, and plain text PDFs, by the standard library alone.

The reader takes the text layer: objects (also those in compressed object streams), the page tree, contents
in Flate or without a filter, and fonts with a ToUnicode map or a Latin encoding. Pictures of text have no
text layer. The writer sets pages of one font with greedy word wrap. Layout is not kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a line, and lines of a page, that the writer sets.
WIDTH, LINES = 92, 58
OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
REF = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.0-9]+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class DamagedPdf(ValueError):
    pass


def _objects(data: bytes) -> dict[int, bytes]:
    """Objects by number; the last one of a number counts."""
    out: dict[int, bytes] = {}
    marks = list(OBJECT.finditer(data))
    for m, after in zip(marks, [*(x.start() for x in marks[1:]), len(data)], strict=False):  # without marks, none
        out[int(m[1])] = data[m.end() : after]
    for body in list(out.values()):
        if b"/ObjStm" in body[:400] and (raw := _stream(body)):
            first, count = (int(m[1]) if (m := re.search(rb"/%s\s+(\d+)" % k, body)) else 0 for k in (b"First", b"N"))
            numbers = [int(x) for x in raw[:first].split()[: 2 * count]]
            for k in range(0, len(numbers) - 1, 2):
                end = first + numbers[k + 3] if k + 3 < len(numbers) else len(raw)
                out.setdefault(numbers[k], raw[first + numbers[k + 1] : end])
    return out


def _stream(body: bytes) -> bytes:
    """The decoded stream of an object; empty for filters that are not read."""
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return b""
    raw = body[m.end() : body.rfind(b"endstream")]
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(raw)
        except zlib.error:
            return b""
    return raw if b"/Filter" not in body[: m.start()] else b""


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and what codes mean."""
    out, width = {}, 1
    text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)], width = text(b), len(a) // 2
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width = len(a) // 2
            for k in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                out[int(a, 16) + k] = chr(int(c, 16) + k) if len(c) <= 4 else text(c)
    return width, out


def _fonts(page: bytes, objects: dict[int, bytes]) -> dict[bytes, tuple[int, dict[int, str]]]:
    out = {}
    for scope in (page, *(objects.get(int(m[1]), b"") for m in re.finditer(rb"/Resources\s+(\d+)", page))):
        for m in re.finditer(rb"/Font\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", scope, re.S):
            for name, number in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", m[1] or objects.get(int(m[2] or 0), b"")):
                to = re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(number), b""))
                if to:
                    out[b"/" + name] = _unicode_map(_stream(objects.get(int(to[1]), b"")))
    return out


def _shown(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """The text that a content stream shows; a new line where it moves to one."""
    out: list[str] = []
    font, stack, row = (1, {}), [], None

    def said(raw: bytes) -> str:
        width, table = font
        if not table:
            return raw.decode("cp1252", "replace")
        return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

    def new_line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for m in TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[/]" or t[:1] in b"+-.0123456789":
            stack.append(t)
            continue
        if t == b"Tf":
            font = fonts.get(next((x for x in reversed(stack) if x[:1] == b"/"), b""), (1, {}))
        elif t in (b"Td", b"TD", b"Tm") and stack:
            if row is not None and stack[-1] != row if t == b"Tm" else stack[-1] not in (b"0", b"0.0"):
                new_line()
            row = stack[-1] if t == b"Tm" else row
        elif t in (b"T*", b"'", b'"'):
            new_line()
        if t in (b"Tj", b"'", b'"') and stack:
            out.append(said(_literal(stack[-1])))
        elif t == b"TJ":
            for x in stack:
                if x[:1] in b"(<":
                    out.append(said(_literal(x)))
                elif x[:1] in b"-" and float(x) < -180:  # a gap as wide as a space
                    out.append(" ")
        elif t == b"ET":
            new_line()
        stack = []
    return "".join(out).strip("\n")


def pages_of(content: bytes) -> list[str]:
    """The text of each page."""
    if content[:5] != b"%PDF-":
        raise DamagedPdf("no PDF header")
    objects = _objects(content)
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    order: list[int] = []

    def walk(number: int, depth: int = 0) -> None:
        body = objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids and depth < 64:
            for k in REF.findall(kids[1]):
                walk(int(k), depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            order.append(number)

    if top := re.search(rb"/Pages\s+(\d+)", root):
        walk(int(top[1]))
    order = order or [n for n, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]
    if not order:
        raise DamagedPdf("no pages")
    out = []
    for number in order:
        page = objects[number]
        m = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+)\s+\d+\s+R)", page, re.S)
        parts = [int(x) for x in (REF.findall(m[1]) if m and m[1] else [m[2]] if m else [])]
        out.append(_shown(b"\n".join(_stream(objects.get(p, b"")) for p in parts), _fonts(page, objects)))
    return out


def _wrapped(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        row = ""
        for word in line.split(" "):
            while len(word) > WIDTH:
                if row:
                    yield row
                    row = ""
                yield word[:WIDTH]
                word = word[WIDTH:]
            if row and len(row) + 1 + len(word) > WIDTH:
                yield row
                row = word
            else:
                row = f"{row} {word}" if row else word
        yield row


def written_pdf(pages: Iterable[str]) -> bytes:
    """A PDF of these texts, each from a new page on; what does not fit goes on overleaf. No metadata."""
    sheets: list[list[str]] = []
    for text in pages:
        rows = list(_wrapped(text))
        sheets += [rows[i : i + LINES] for i in range(0, max(1, len(rows)), LINES)]
    sheets = sheets or [[]]
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    kids = []
    for rows in sheets:
        quoted = lambda r: re.sub(rb"([\\()])", rb"\\\1", r.encode("cp1252", "replace"))
        content = zlib.compress(b"BT /F1 9 Tf 12 TL 50 790 Td\n" + b"".join(b"(%s) Tj T*\n" % quoted(r) for r in rows) + b"ET")
        bodies.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(content), content))
        bodies.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(bodies))
        kids.append(len(bodies))
    bodies[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start))


def rewritten_pdf(content: bytes, change: Callable[[str], str]) -> bytes:
    """A plain text PDF of the pages of one, with change applied to each page's text."""
    return written_pdf(change(t) for t in pages_of(content))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """A segment for each page that has text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, k, t) for p, c in zip(batch["path"], batch["content"], strict=True) for k, t in enumerate(pages_of(c)) if t]
            yield pd.DataFrame(found, columns=["doc_id", "seg_no", "text"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc_id string, seg_no long, text string")
    return out.select("doc_id", F.lit("page").alias("part"), "seg_no", F.col("seg_no").alias("row"), F.lit(0).cast("long").alias("col"), "text")
