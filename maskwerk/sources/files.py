"""Files as text segments, and back: text, CSV, HTML, Word, Excel and PDF files.

A segment is doc_id (a path), seg_no, part, row, col and text. Readers are Spark sources; the zipped XML of
office files is read with the standard library, file by file, in Arrow batches.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.sources import csv_splits
from maskwerk.sources.pdf import pages_of, read_pdf, rewritten_pdf

TEXT, TABLE, PAGE, WORD, EXCEL, PDF = (".txt", ".text", ".log", ".md"), (".csv", ".tsv"), (".html", ".htm"), (".docx",), (".xlsx",), (".pdf",)
SUPPORTED = (*TEXT, *TABLE, *PAGE, *WORD, *EXCEL, *PDF)
SEGMENT = "doc_id string, part string, seg_no long, row long, col long, text string"
DELIMITERS = ",;\t|"
#: Segment numbers of a CSV file are row * CSV_COLUMNS + column.
CSV_COLUMNS = 1 << 24
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DATA_URI = r"""data:[A-Za-z0-9.+/-]+;base64,[A-Za-z0-9+/=\s]+"""


class UnsupportedFormat(ValueError):
    pass


def reader_for(path: str) -> Callable[[SparkSession, str], DataFrame]:
    """The reader for a path's suffix."""
    suffix = re.search(r"\.[a-z0-9]+$", path.lower())
    for suffixes, reader in ((TEXT, read_text), (TABLE, read_csv), (PAGE, read_html), (WORD, read_word), (EXCEL, read_excel), (PDF, read_pdf)):
        if suffix and suffix[0] in suffixes:
            return reader
    raise UnsupportedFormat(path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def _segment(frame: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return frame.select("doc_id", F.lit("body").alias("part"), zero.alias("seg_no"), zero.alias("row"), zero.alias("col"), "text")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return _segment(_whole(spark, path))


def without_data_uris(html: Column) -> Column:
    return F.regexp_replace(html, DATA_URI, "data:removed")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return _segment(_whole(spark, path)).withColumn("text", without_data_uris(F.col("text")))


def sniffed(sample: str) -> str:
    """The delimiter that splits the sample's lines most evenly; a comma if none does."""
    lines = [x for x in sample.splitlines() if x][:50]
    best, top = ",", 0.0
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        if counts and min(counts) and (score := min(counts) / max(counts) * (1 + min(counts) / 100)) > top:
            best, top = d, score
    return best


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty cells, with the row in their file; quoted cells may hold line feeds, and a file is read by many tasks. The delimiter is sniffed from the first 4096 characters."""
    head = "\n".join(r[0] for r in spark.read.text(path).select(F.substring("value", 1, 4096)).limit(50).collect())[:4096]
    sep = sniffed(head)
    out = csv_splits.cells(csv_splits.records(spark, path, sep), sep)
    return out.select(F.col("path").alias("doc_id"), F.lit("cell").alias("part"), (F.col("row") * CSV_COLUMNS + F.col("col")).alias("seg_no"), "row", "col", "text")


EXPECTED = "description string, seed long, spans array<struct<start:int,end:int,category:string,text:string>>"


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text, description, seed, spans and error of fixtures: folders with input.txt and expected.json (EXPECTED).

    A file without its partner, JSON that cannot be read, and a span whose place does not hold its text are rows with
    an error; none are dropped.
    """
    named = lambda pattern: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("doc_id"), "value")
    texts = named("input.txt").withColumnRenamed("value", "text")
    given = named("expected.json").select(F.col("doc_id").alias("d_"), F.from_json("value", EXPECTED).alias("x"))
    both = texts.join(given, F.col("doc_id") == F.col("d_"), "full")
    wrong = F.exists("x.spans", lambda s: ~F.coalesce(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == s["text"], F.lit(False)))
    error = F.when(F.col("doc_id").isNull(), "input.txt is missing").when(F.col("d_").isNull(), "expected.json is missing").when(F.col("x.spans").isNull(), "expected.json cannot be read").when(wrong, "a span is not where its text is")
    return both.select(F.coalesce("doc_id", "d_").alias("doc_id"), "text", "x.description", "x.seed", "x.spans", error.alias("error"))


def write_csv(cells: DataFrame, path: str, width: int, sep: str = ",") -> None:
    """Cells (row, col, text) as CSV rows of the given width."""
    wide = cells.groupBy("row").pivot("col", list(range(width))).agg(F.first("text"))
    wide.orderBy("row").select(*[F.coalesce(F.col(str(i)), F.lit("")).alias(f"c{i}") for i in range(width)]).write.csv(path, sep=sep, header=False, escape='"')


def word_parts(content: bytes) -> Iterator[tuple[str, str]]:
    """(part, paragraph) of a Word file: body with tables, headers, footers, notes and comments."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", name):
                for p in ElementTree.fromstring(z.read(name)).iter(f"{W}p"):
                    if text := "".join(t.text or "" for t in p.iter() if t.tag in (f"{W}t", f"{W}delText")):
                        yield name, text


def rewritten_word(content: bytes, change: Callable[[str], str]) -> bytes:
    """A Word file with change applied to each paragraph; the text goes to its first run. Properties are emptied."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for name in z.namelist():
            data = z.read(name)
            if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", name):
                tree = ElementTree.fromstring(data)
                for p in tree.iter(f"{W}p"):
                    runs = [t for t in p.iter() if t.tag in (f"{W}t", f"{W}delText")]
                    text = "".join(t.text or "" for t in runs)
                    if text and (new := change(text)) != text:
                        for k, t in enumerate(runs):
                            t.text = new if k == 0 else ""
                data = ElementTree.tostring(tree, xml_declaration=True, encoding="UTF-8")
            to.writestr(name, neutral(name, data))
    return out.getvalue()


def neutral(name: str, data: bytes) -> bytes:
    """Document properties without values; other parts as they are."""
    if not re.match(r"(docProps/(core|app|custom)\.xml|customXml/item\d+\.xml)$", name):
        return data
    tree = ElementTree.fromstring(data)
    for node in tree.iter():
        node.text = None
    return ElementTree.tostring(tree, xml_declaration=True, encoding="UTF-8")


def excel_cells(content: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, col, kind, text) of an Excel file: strings (s), formulas (f), numbers (n), comments (c); from 1."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{M}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{M}si")]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for c in ElementTree.fromstring(z.read(name)).iter(f"{M}c"):
                place = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", "A1"))
                col = 0
                for letter in place[1]:
                    col = col * 26 + ord(letter) - 64
                formula, value, kind = c.find(f"{M}f"), c.findtext(f"{M}v"), c.get("t", "n")
                text = "".join(t.text or "" for t in c.iter(f"{M}t")) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value
                if formula is not None and formula.text:
                    yield name, int(place[2]), col, "f", formula.text
                elif text:
                    yield name, int(place[2]), col, "n" if kind == "n" else "s", text
        for name in sorted(n for n in names if re.fullmatch(r"xl/comments\d*\.xml", n)):
            for k, c in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{M}comment")):
                yield name, k, 0, "c", "".join(t.text or "" for t in c.iter(f"{M}t"))


def _unzipped(spark: SparkSession, path: str, rows: Callable[[bytes], Iterator[tuple]], schema: str, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                found = [(where, i, *r) for i, r in enumerate(rows(content))]
                yield pd.DataFrame(found, columns=["doc_id", "seg_no", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_word(spark: SparkSession, path: str) -> DataFrame:
    out = _unzipped(spark, path, word_parts, "doc_id string, seg_no long, part string, text string", ["part", "text"])
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "part", "seg_no", F.col("seg_no").alias("row"), zero.alias("col"), "text")


def read_excel(spark: SparkSession, path: str, kinds: str = "sfc") -> DataFrame:
    """Cells of the given kinds; numbers are left alone."""
    out = _unzipped(spark, path, excel_cells, "doc_id string, seg_no long, part string, row long, col long, kind string, text string", ["part", "row", "col", "kind", "text"])
    return out.filter(F.instr(F.lit(kinds), F.col("kind")) > 0).select("doc_id", "part", "seg_no", "row", "col", "text")


def read_terms(spark: SparkSession, path: str, most: int = 10_000) -> list[str]:
    """Custom terms: one a line, # begins a comment, two characters at least. A user's list of `most` at most, held by the driver."""
    lines = spark.read.text(path).select(F.trim(F.col("value")).alias("t")).filter("t not like '#%' and length(t) >= 2").distinct()
    found = sorted(r["t"] for r in lines.limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"over {most} terms in {path}")
    return found


def output_name(path: str, mode: str, taken: set[str] = frozenset()) -> str:
    """name.anon.ext or name.deanon.ext; with ' (2)' and so on where that is taken."""
    stem, dot, ext = path.rpartition(".")
    name = f"{stem or ext}.{mode}{dot}{ext if stem else ''}"
    k = 2
    while name in taken:
        name = f"{stem or ext}.{mode} ({k}){dot}{ext if stem else ''}"
        k += 1
    return name


def manifest(files: DataFrame) -> DataFrame:
    """One digest of all files (path, sha256): of their sorted 'path NUL digest' lines. A release's list of files, not a corpus."""
    line = F.concat("path", F.lit("\0"), "sha256", F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    return files.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), ""), 256).alias("manifest"))


def rewritten_excel(content: bytes, change: Callable[[str], str]) -> bytes:
    """An Excel file with change applied to strings, comments, headers, footers, names and the quoted operands of formulas. Numbers stay."""
    quoted = re.compile(r'"((?:[^"]|"")*)"')

    def formula(text: str) -> str:
        return quoted.sub(lambda m: '"' + change(m[1].replace('""', '"')).replace('"', '""') + '"', text)

    def whole(node) -> None:
        """The texts of a rich string as one, in its first run."""
        parts = list(node.iter(f"{M}t"))
        text = "".join(t.text or "" for t in parts)
        if text and (new := change(text)) != text:
            for k, t in enumerate(parts):
                t.text = new if k == 0 else ""

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for name in z.namelist():
            data = z.read(name)
            if re.fullmatch(r"xl/(sharedStrings|workbook|comments\d*|worksheets/sheet\d+)\.xml", name):
                tree = ElementTree.fromstring(data)
                for node in tree.iter():
                    tag = node.tag.removeprefix(M)
                    if tag in ("si", "is", "comment"):
                        whole(node)
                    elif tag in ("f", "definedName") and node.text:
                        node.text = formula(node.text)
                    elif re.fullmatch(r"(odd|even|first)(Header|Footer)", tag) and node.text:
                        node.text = change(node.text)
                    elif tag == "c" and node.get("t") == "str" and node.find(f"{M}v") is not None:
                        node.find(f"{M}v").text = change(node.findtext(f"{M}v") or "")
                data = ElementTree.tostring(tree, xml_declaration=True, encoding="UTF-8")
            to.writestr(name, neutral(name, data))
    return out.getvalue()


def gate_text(path: str, content: bytes) -> str:
    """All text of a file that a residual check has to see: every XML part of an office file, or the file itself."""
    if path.lower().endswith((*WORD, *EXCEL)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return "\n".join(re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.endswith((".xml", ".rels")))
    return "\n".join(pages_of(content)) if path.lower().endswith(PDF) else decoded(content)


def decoded(content: bytes) -> str:
    """A text file's text: UTF-8, or else Windows-1252."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def rewritten(path: str, content: bytes, change: Callable[[str], str]) -> bytes:
    """A file of any supported format with change applied to each of its segments; a changed table keeps its delimiter."""
    name = path.lower()
    if name.endswith(WORD):
        return rewritten_word(content, change)
    if name.endswith(EXCEL):
        return rewritten_excel(content, change)
    if name.endswith(PDF):
        return rewritten_pdf(content, change)
    text = decoded(content)
    if name.endswith(TABLE):
        sep, out = sniffed(text[:4096]), io.StringIO()
        rows = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
        csv.writer(out, delimiter=sep, lineterminator="\n").writerows([change(c) if c else c for c in row] for row in rows)
        return out.getvalue().encode()
    if name.endswith(PAGE):
        text = re.sub(DATA_URI, "data:removed", text)
    if not name.endswith((*TEXT, *PAGE)):
        raise UnsupportedFormat(path)
    return change(text).encode()


def segments_of(path: str, content: bytes) -> list[str]:
    """The texts that `rewritten` hands to its change, once each."""
    found: dict[str, None] = {}

    def seen(text: str) -> str:
        if text:
            found[text] = None
        return text

    rewritten(path, content, seen)
    return list(found)


def gate_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and gate_text of the files of a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["path"], "text": [gate_text(p, c) for p, c in zip(b["path"], b["content"], strict=True)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc_id string, text string")
