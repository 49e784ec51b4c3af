"""Sources and the folder stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwerk.operators import mapping
from maskwerk.sources import files
from maskwerk.streaming import folder


def word_file():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Herr </w:t></w:r><w:r><w:t>Max Muster</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Zelle</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>Kopf</w:t></w:r></w:p></w:hdr>")
        z.writestr("docProps/core.xml", "<a><creator>Eva Klein</creator></a>")
    return out.getvalue()


def excel_file():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>a@x.at</t></si><si><r><t>zwei </t></r><r><t>Teile</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>12.5</v></c><c r="AA2" t="s"><v>1</v></c><c r="C3"><f>SUMIF(A1,"x",B1)</f><v>1</v></c><c r="D4" t="inlineStr"><is><t>direkt</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/comments1.xml", f'<comments {m}><commentList><comment ref="A1"><text><t>Notiz</t></text></comment></commentList></comments>')
    return out.getvalue()


def test_text_csv_html(spark, tmp_path):
    (tmp_path / "a.txt").write_text("eine Datei\nzwei Zeilen")
    (tmp_path / "b.csv").write_text('x;"a;\nb";\n1;;ü\n')
    (tmp_path / "c.html").write_text('<img src="data:image/png;base64,AAAA+/=="><p>x</p>')
    assert [r["text"] for r in files.reader_for("a.txt")(spark, str(tmp_path / "a.txt")).collect()] == ["eine Datei\nzwei Zeilen"]
    cells = files.reader_for("b.CSV")(spark, str(tmp_path / "b.csv")).orderBy("seg_no").collect()
    assert [(r["col"], r["text"]) for r in cells] == [(0, "x"), (1, "a;\nb"), (0, "1"), (2, "ü")]
    files.write_csv(spark.createDataFrame([(r["row"], r["col"], r["text"]) for r in cells], "row long, col long, text string"), str(tmp_path / "out"), 3, ";")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*"))) == 'x;"a;\nb";""\n1;"";ü\n'
    assert files.read_html(spark, str(tmp_path / "c.html")).first()["text"] == '<img src="data:removed"><p>x</p>'
    with pytest.raises(files.UnsupportedFormat):
        files.reader_for("x.exe")
    assert [files.sniffed(x) for x in ("a,b\n1,2", "a;b\n1,5;2", "a\tb", "ab", "")] == [",", ";", "\t", ",", ","]


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file())
    (tmp_path / "b.xlsx").write_bytes(excel_file())
    got = files.read_word(spark, str(tmp_path / "a.docx")).orderBy("seg_no").collect()
    assert [r["text"] for r in got] == ["Herr Max Muster", "Zelle", "Kopf"]
    cells = {(r["part"].split("/")[-1], r["row"], r["col"]): r["text"] for r in files.read_excel(spark, str(tmp_path / "b.xlsx")).collect()}
    assert cells == {("sheet1.xml", 1, 1): "a@x.at", ("sheet1.xml", 2, 27): "zwei Teile", ("sheet1.xml", 3, 3): 'SUMIF(A1,"x",B1)', ("sheet1.xml", 4, 4): "direkt", ("comments1.xml", 0, 0): "Notiz"}
    new = files.rewritten_word(word_file(), lambda t: t.replace("Max Muster", "<PERSON_001>"))
    assert [t for _, t in files.word_parts(new)] == ["Herr <PERSON_001>", "Zelle", "Kopf"]
    assert b"Eva" not in zipfile.ZipFile(io.BytesIO(new)).read("docProps/core.xml")


def test_names_terms_manifest(spark, tmp_path):
    assert files.output_name("/a/b.txt", "anon") == "/a/b.anon.txt" and files.output_name("b.txt", "anon", {"b.anon.txt"}) == "b.anon (2).txt"
    (tmp_path / "terms.txt").write_text("# Liste\nProjekt X\n\nx\nProjekt X\n")
    assert files.read_terms(spark, str(tmp_path / "terms.txt")) == ["Projekt X"]
    assert len(files.manifest(spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")).first()[0]) == 64


def test_folder_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("Schreiben an a@x.at")
    (inbox / "_skip.txt").write_text("b@x.at")
    store = mapping.Store(spark, str(tmp_path / "map"), b"k" * 32, b"d")

    def run():
        folder.watch(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "bad"), store, str(tmp_path / "state")).awaitTermination()
        return sorted(r["anonymized"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["Schreiben an <EMAIL_001>"]
    (inbox / "b.txt").write_text("c@x.at und a@x.at")
    assert run() == ["<EMAIL_002> und <EMAIL_001>", "Schreiben an <EMAIL_001>"]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 0 and store.load().filter(F.col("category") == "EMAIL").count() == 2


def test_excel_is_rewritten(spark, tmp_path):
    new = files.rewritten_excel(excel_file(), lambda t: t.replace("a@x.at", "<EMAIL_001>").replace("x", "X").replace("zwei", "drei"))
    cells = {(r[1], r[2]): r[4] for r in files.excel_cells(new)}
    assert cells[1, 1] == "<EMAIL_001>" and cells[2, 27] == "drei Teile" and cells[3, 3] == 'SUMIF(A1,"X",B1)' and cells[1, 2] == "12.5"
    (tmp_path / "n.xlsx").write_bytes(new)
    (tmp_path / "n.txt").write_bytes("süß".encode("cp1252"))
    got = {r["doc_id"].rsplit(".", 1)[1]: r["text"] for r in files.gate_texts(spark, str(tmp_path)).collect()}
    assert "EMAIL_001" in got["xlsx"] and got["txt"] == "süß"


def test_fixture_pairs(spark, tmp_path):
    """Pairs are scored; files without a partner, broken JSON and spans in wrong places are reported."""
    import json

    from maskwerk.operators import recognizers, scoring

    def pair(name, text=None, spans=None, raw=None):
        (tmp_path / name).mkdir()
        if text is not None:
            (tmp_path / name / "input.txt").write_text(text)
        if spans is not None or raw is not None:
            (tmp_path / name / "expected.json").write_text(raw if raw is not None else json.dumps({"description": name, "seed": 1, "spans": [{"start": s, "end": s + len(x), "category": c, "text": x} for s, c, x in spans]}, indent=2))

    pair("good", "Mail an ü@x.at, post@beispiel.at\nund mehr", [(16, "EMAIL", "post@beispiel.at")])
    pair("missed", "nichts hier", [(0, "EMAIL", "nichts")])
    pair("alone", "nur Text")
    pair("orphan", None, [])
    pair("broken", "Text", raw="{")
    pair("moved", "Text", [(1, "EMAIL", "Text")])
    rows = files.read_fixtures(spark, str(tmp_path))
    assert {r["doc_id"]: r["error"] for r in rows.collect()} == {
        "good": None, "missed": None, "alone": "expected.json is missing", "orphan": "input.txt is missing", "broken": "expected.json cannot be read", "moved": "a span is not where its text is"
    }
    pairs = rows.filter("error is null")
    spans = lambda column: pairs.select("doc_id", F.explode(column).alias("s")).select("doc_id", "s.category", "s.start", "s.end")
    found = spans(recognizers.detect(F.col("text"), [r for r in recognizers.bundle() if r.name == "email"]))
    report = {(r["level"], r["doc_id"] or r["category"]): (r["tp"], r["fp"], r["fn"]) for r in scoring.detailed_report(scoring.matched(spans("spans"), found)).collect()}
    assert report["fixture", "good"] == (1, 0, 0) and report["fixture", "missed"] == (0, 0, 1) and report["total", None] == (1, 0, 1)
