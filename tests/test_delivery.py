"""Files of all kinds through the stream, PDF pages, HTTP, logs, reports and the arena."""

import io
import json
import threading
import time
import urllib.error
import urllib.request
import zlib

import pytest
from pyspark.sql import functions as F
from test_files import excel_file, word_file

from maskwerk import logs, server
from maskwerk.functions import arrays as A
from maskwerk.functions import text as X
from maskwerk.operators import audit, mapping, recognizers, scoring
from maskwerk.operators import spans as S
from maskwerk.plans import arena
from maskwerk.profiles import Profile
from maskwerk.sources import files, pdf
from maskwerk.streaming import delivery

EMAILS = [r for r in recognizers.bundle() if r.name in ("email", "person", "person_gazetteer")]


def test_every_kind_of_file_is_delivered(spark, tmp_path):
    inbox, out, report = tmp_path / "in", tmp_path / "out", str(tmp_path / "report")
    inbox.mkdir()
    (inbox / "a.txt").write_text("an a@x.at")
    (inbox / "b.csv").write_text('Name;Mail\nx;"a@x.at;b"\n')
    (inbox / "c.html").write_text('<img src="data:image/png;base64,AA=="><p>a@x.at</p>')
    (inbox / "d.docx").write_bytes(word_file())
    (inbox / "e.xlsx").write_bytes(excel_file())
    (inbox / "f.pdf").write_bytes(pdf.written_pdf(["Schreiben an b@x.at", "zwei"]))
    (inbox / "g.exe").write_bytes(b"MZ")
    (inbox / "h.docx").write_bytes(b"no zip")
    (inbox / "i.html").write_text('<p title="a@x.at">x</p><!-- Bearbeitet -->')
    (inbox / "_j.txt").write_text("c@x.at")
    store = mapping.Store(spark, str(tmp_path / "map"), b"k" * 32, b"d")

    def run():
        delivery.watch_files(spark, str(inbox), str(out), report, store, str(tmp_path / "state"), recognizers=EMAILS, settle=0.2).awaitTermination()
        return {r["path"].rsplit("/", 1)[1]: r for r in spark.read.parquet(report).orderBy("batch").collect()}

    told = run()
    assert {k: r["error"] for k, r in told.items() if r["error"]} == {"g.exe": "unsupported", "h.docx": "damaged"} and told["g.exe"]["message"] == delivery.MESSAGES["unsupported"]
    assert sorted(p.name for p in out.iterdir()) == ["a.anon.txt", "b.anon.csv", "c.anon.html", "d.anon.docx", "e.anon.xlsx", "f.anon.pdf", "i.anon.html"]
    code = (out / "a.anon.txt").read_text().removeprefix("an ")
    assert code.startswith("<EMAIL_") and (out / "b.anon.csv").read_text() == f'Name;Mail\nx;"{code};b"\n'
    assert (out / "c.anon.html").read_text() == f'<img src="data:removed"><p>{code}</p>'
    assert [t for _, t in files.word_parts((out / "d.anon.docx").read_bytes())][0] == "Herr <PERSON_001>"
    assert {(r[1], r[2]): r[4] for r in files.excel_cells((out / "e.anon.xlsx").read_bytes())}[1, 1] == code
    assert pdf.pages_of((out / "f.anon.pdf").read_bytes())[0].startswith("Schreiben an <EMAIL_") and "a@x.at" not in (out / "i.anon.html").read_text()
    # The same name again is another delivery; the folder of results can be restored.
    (inbox / "k.txt").write_text("neu a@x.at")
    assert run()["k.txt"]["output"] == "k.anon.txt"
    back = tmp_path / "back"
    delivery.watch_files(spark, str(out), str(back), str(tmp_path / "report2"), store, str(tmp_path / "state2"), reverse=True, settle=0).awaitTermination()
    assert (back / "a.anon.deanon.txt").read_text() == "an a@x.at" and (back / "b.anon.deanon.csv").read_text() == 'Name;Mail\nx;"a@x.at;b"\n'


def test_what_is_left_is_not_delivered(spark, tmp_path):
    """A recogniser that finds nothing: the gate stops the file."""
    store = mapping.Store(spark, str(tmp_path / "map"), b"k" * 32, b"d")
    given = spark.createDataFrame([("x/a.txt", b"an a@x.at"), ("x/b.txt", b"nichts")], "path string, content binary")
    nothing = [r for r in recognizers.bundle() if r.name == "iban"]
    times = spark.createDataFrame([("x/b.txt", 2)], "path string, earlier long")
    got = {r["path"]: (r["output"], r["error"]) for r in delivery.process(given, store, recognizers=nothing, times=times).collect()}
    assert got == {"x/a.txt": (None, "residual"), "x/b.txt": ("b.anon (3).txt", None)}


def test_pdf_text():
    text = "Herr Müller (Wien) \\ zahlt 5 €\n" + "wort " * 400
    assert " ".join(" ".join(pdf.pages_of(pdf.written_pdf([text]))).split()) == " ".join(text.split())
    assert pdf.pages_of(pdf.rewritten_pdf(pdf.written_pdf(["eins", "", "drei"]), str.upper)) == ["EINS", "", "DREI"]
    cmap = zlib.compress(b"1 beginbfchar <0003> <0041> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange")
    content = b"BT /F1 12 Tf 10 20 Td [<0003> -300 <0010>] TJ 0 -14 Td <00110012> Tj ET"
    made = b"%%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >> endobj\n4 0 obj << /Length %d >>\nstream\n%s\nendstream endobj 5 0 obj << /Type /Font /ToUnicode 6 0 R >> endobj 6 0 obj << /Filter /FlateDecode >>\nstream\n%s\nendstream endobj" % (len(content), content, cmap)
    assert pdf.pages_of(made) == ["A a\nbc"]
    for bad in (b"", b"hello", b"%PDF-1.4\nnothing"):
        with pytest.raises(pdf.DamagedPdf):
            pdf.pages_of(bad)


def test_pdf_pages_are_segments(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.written_pdf(["eins", "zwei"]))
    assert [(r["seg_no"], r["text"]) for r in files.reader_for("a.pdf")(spark, str(tmp_path / "a.pdf")).orderBy("seg_no").collect()] == [(0, "eins"), (1, "zwei")]


def test_server(spark, tmp_path):
    profile = Profile(spark, str(tmp_path), "Kanzlei", "geheim", iterations=10)
    http = server.server(profile, "secret", bucket=server.Bucket(burst=5, rate=0.001))
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def ask(path, body=None, token="secret"):
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", data, {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(request, timeout=300) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers)

    try:
        assert ask("/health")[1]["status"] == "ok"
        texts = ["b@x.at", "", "an a@x.at"]
        done = ask("/v1/anonymize", {"texts": texts})[1]["results"]
        assert [r["input"] for r in done] == texts and done[1]["output"] == "" and done[2]["output"].startswith("an <EMAIL_")
        assert [r["output"] for r in ask("/v1/deanonymize", {"texts": [r["output"] for r in done]})[1]["results"]] == texts
        assert ask("/v1/anonymize", {"texts": texts}, token="x")[0] == 401 and ask("/v1/anonymize", {"texts": [1]})[0] == 400 and ask("/nothing", {})[0] == 404
        assert ask("/v1/anonymize", {"texts": []})[1] == {"results": []}
        code, headers = ask("/v1/anonymize", {"texts": []})
        assert code == 429 and int(headers["Retry-After"]) > 0
    finally:
        http.shutdown()


def test_details_and_reset(spark, tmp_path):
    profile = Profile(spark, str(tmp_path), "A", "geheim", iterations=10)
    store = profile.store
    table = spark.createDataFrame([("<EMAIL_001>", "EMAIL", "a x.at", "a@x.at", 1), ("<EMAIL_002>", "EMAIL", "b x.at", "b@x.at", 1)], mapping.MAPPING)
    store.save(table)
    first = {r["placeholder"]: r for r in store.dated().collect()}
    time.sleep(1.1)
    store.save(table.withColumn("use_count", F.when(F.col("placeholder") == "<EMAIL_001>", 2).otherwise(1).cast("long")))
    second = {r["placeholder"]: r for r in store.dated().collect()}
    assert second["<EMAIL_002>"] == first["<EMAIL_002>"] and second["<EMAIL_001>"]["first_seen"] == first["<EMAIL_001>"]["first_seen"] and second["<EMAIL_001>"]["last_used"] > first["<EMAIL_001>"]["last_used"]
    assert profile.details()["mappings"] == 2 and profile.details()["last_used"] == second["<EMAIL_001>"]["last_used"] and profile.details()["created"]
    profile.reset()
    assert store.load() is None and profile.summary() == {"mappings": 0, "log_entries": 1} and profile.log().first()["operation"] == "reset"


def test_no_key_is_in_a_plan(spark, tmp_path, capsys):
    key, digest = b"0123456789abcdef0123456789abcdef", b"digestkeydigestkey"
    store = mapping.Store(spark, str(tmp_path / "m"), key, digest)
    store.save(spark.createDataFrame([("<EMAIL_001>", "EMAIL", "a x.at", "a@x.at", 1)], mapping.MAPPING))
    store.load().explain(True)
    mapping.lookup(store.stored(), "A@x.at", "EMAIL", digest).explain(True)
    shown = capsys.readouterr().out.lower()
    assert "aes_decrypt" in shown and not any(x in shown for k in (key, digest) for x in (k.decode(), k.hex()))


def test_audit_pdf(spark):
    rows = [(i, f"2026-01-01T00:00:{i:02d}", "anonymize", '{"A":1}', "0" * 64, "n/a", "1") for i in range(3)]
    log = audit.append(spark.createDataFrame(rows, "seq long, " + ", ".join(f"{c} string" for c in audit.FIELDS[:-1])))
    assert "The chain is whole." in pdf.pages_of(audit.export_pdf(log))[0] and "BROKEN" in pdf.pages_of(audit.export_pdf(log.filter("id != 2")))[0]


def test_logs():
    out = io.StringIO()
    logs.to_json_lines("maskwerk.test", stream=out).info("done %s", 3, extra={"file": "a"})
    assert json.loads(out.getvalue()).items() >= {"level": "INFO", "message": "done 3", "file": "a"}.items()


def test_reports(spark):
    by = spark.createDataFrame([(1, "A", 1, 0, 1), (2, "A", 1, 0, 0), (2, "B", 0, 1, 0)], "doc_id long, category string, tp long, fp long, fn long")
    got = {(r["level"], r["doc_id"], r["category"]): (r["tp"], r["precision"], r["recall"]) for r in scoring.detailed_report(by).collect()}
    assert got == {("fixture", 1, None): (1, 1.0, 0.5), ("fixture", 2, None): (1, 0.5, 1.0), ("category", None, "A"): (2, 1.0, 0.6667), ("category", None, "B"): (0, 0.0, 1.0), ("total", None, None): (2, 0.6667, 0.6667)}
    assert scoring.as_markdown(by.limit(1)).split("\n")[0] == "| doc_id | category | tp | fp | fn |"
    lines = spark.createDataFrame([(1, "| ORG | >= 0.95 |"), (2, "| COMPANY | 0.10 |"), (3, "| IBAN | 1,00 |"), (4, "| DATE | 0.5 |")], "n long, value string")
    least = {r["category"]: r["least"] for r in scoring.gate_rows(lines).collect()}
    assert least == {"COMPANY": 0.95, "IBAN": 1.0, "DATE": 0.5}
    scores = spark.createDataFrame([("COMPANY", 0.9), ("DATE", 0.9)], "category string, f1 double")
    rates = spark.createDataFrame([("DATE", 0.5), ("IBAN", None)], "category string, fp_rate double")
    assert [(r["severity"], r["category"]) for r in scoring.gap_list(scoring.gate_rows(lines), scores, rates).collect()] == [(0, "IBAN"), (1, "DATE"), (2, "COMPANY")]
    checks = spark.createDataFrame([("a", "pass"), ("b", "skip")], "name string, status string")
    assert tuple(scoring.check_bundle(checks).first()) == (1, 0, 1, True)


def test_arena_values_are_found_as_their_categories(spark):
    docs = arena.corpus(spark, 72).filter("mode = 'clean'")
    found = docs.withColumn("spans", recognizers.detect(F.col("original"))).collect()
    for r in found:
        spans = {(s["start"], s["end"]): s["category"] for s in r["spans"]}
        for s in r["slots"]:
            assert spans.get((s["start"], s["end"])) == s["category"], (r["original"], s, spans)


def test_given_names(spark):
    texts = {"Christian Huber und Heinz Maier, Susanne Bauer": ["Christian Huber", "Heinz Maier", "Susanne Bauer"], "Juergen Wolf": ["Juergen Wolf"], "Ansprechpartner Günther Auer": ["Günther Auer"], "Wolke Sieben": []}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", recognizers.detect(F.col("text")).alias("s")).collect()
    assert {r["text"]: [s["text"] for s in r["s"] if s["category"] == "PERSON"] for r in rows} == texts


def test_listed_values_may_hold_anything(spark):
    given = spark.createDataFrame([("siehe x\\E( und Max (jun.) hier", [("x\\E(", "company"), ("Max (jun.)", "person"), ("[a-z]+", "person")])], "t string, v array<struct<text:string,type:string>>")
    got = given.select(recognizers.listed_values(F.col("v"), F.col("t"), 0)).first()[0]
    assert [(s["category"], s["text"], s["start"]) for s in got] == [("COMPANY", "x\\E(", 6), ("PERSON", "Max (jun.)", 15)]


def test_spans_by_brute_force(spark):
    import random

    rng, rows = random.Random(9), []
    for i in range(200):
        make = lambda: [(s := rng.randrange(60), s + rng.randint(1, 9), "A", "t", 0.5, k) for k in range(rng.randint(0, 7))]  # noqa: E731, B023
        rows.append((i, make(), make()))
    got = spark.createDataFrame(rows, f"i int, a array<{S.SPAN}>, b array<{S.SPAN}>").select("i", S.apart(F.col("a"), F.col("b")).alias("free"), S.covered(F.array_sort("a")).alias("c"), A.running(F.transform("a", lambda x: x["start"]), F.greatest).alias("r")).collect()
    for r in got:
        _, a, b = rows[r["i"]]
        assert sorted((s["start"], s["end"], s["ord"]) for s in r["free"]) == sorted((x[0], x[1], x[5]) for x in a if not any(x[0] < y[1] and x[1] > y[0] for y in b))
        assert r["r"] == [max(x[0] for x in a[: k + 1]) for k in range(len(a))]
        want = []
        for x in sorted(a):
            if want and x[0] < want[-1][1]:
                want[-1][1] = max(want[-1][1], x[1])
            else:
                want.append([x[0], x[1]])
        assert [[c["start"], c["end"]] for c in r["c"]] == want


def test_splicing_long_texts(spark):
    import random

    rng = random.Random(2)
    text = "".join(rng.choice("aé😀 \n") for _ in range(40_000))
    cuts = sorted(rng.sample(range(40_000), 400))
    spans = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    want, at = "", 0
    for a, b in spans:
        want, at = want + text[at:a] + "#", b
    given = spark.createDataFrame([(text, spans), ("", []), (None, [])], "t string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in given.select(S.splice(F.col("t"), F.col("s"), lambda s: F.lit("#"))).collect()] == [want + text[at:], "", None]


def test_many_spans_take_time_in_proportion(spark):
    """100,000 VAT ids in one text against 10,000."""
    one = [r for r in recognizers.bundle() if r.name == "at_uid"]

    def uid(i):
        digits = f"{(i * 4999 + 1_000_000) % 10_000_000:07d}"
        total = sum(int(c) if k % 2 == 0 else sum(divmod(int(c) * 2, 10)) for k, c in enumerate(digits))
        return f"ATU{digits}{(10 - (total + 4) % 10) % 10}"

    took = []
    for n in (100, 10_000, 100_000):
        given = spark.createDataFrame([("\n".join(f"x {uid(i)}" for i in range(n)),)], "t string").withColumn("s", recognizers.detect(F.col("t"), one))
        started = time.monotonic()
        assert tuple(given.select(F.size("s"), F.length(S.splice(F.col("t"), F.col("s"), lambda s: F.lit("<U>")))).first()) == (n, n * 6 - 1)
        took.append(time.monotonic() - started)
    assert took[2] - took[0] < 20 * (took[1] - took[0] + 1), took


def test_matches_are_those_of_the_pattern(spark):
    r = spark.createDataFrame([("a1 a1a1", ), (None,)], "t string").select(X.matches(F.col("t"), "a1")).collect()
    assert [m["start"] for m in r[0][0]] == [0, 3, 5]
