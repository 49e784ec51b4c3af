"""Profiles, keys and the command line."""

import json

import pytest

from maskwerk import cli
from maskwerk.functions.keys import Keys
from maskwerk.operators import audit
from maskwerk.profiles import Profile, WrongPassword, anonymize_texts, listed


def test_keys():
    a, b = Keys.from_password("x", b"s" * 16, 10), Keys.from_password("y", b"s" * 16, 10)
    assert a.opens(a.token()) and not b.opens(a.token()) and len({a.cipher, a.digest, a.permute}) == 3
    assert Keys.from_secret(b"z") == Keys.from_secret(b"z") != Keys.from_secret(b"q")


def test_profile(spark, tmp_path):
    root = str(tmp_path)
    p = Profile(spark, root, "Kanzlei A", "geheim", iterations=10)
    p.set("terms", json.dumps(["Projekt X"]))
    p.set("pattern", r"M-\d+")
    texts = ["an a@x.at zu projekt x", "M-77 und a@x.at", "nichts"]
    out = anonymize_texts(p, texts)
    assert [r["output"] for r in out] == ["an <EMAIL_001> zu <BEGRIFF_001>", "<MANDANT_NR_001> und <EMAIL_001>", "nichts"]
    again = Profile(spark, root, "Kanzlei A", "geheim")
    assert [r["output"] for r in anonymize_texts(again, [r["output"] for r in out], reverse=True)] == texts
    assert again.summary() == {"mappings": 3, "log_entries": 6} and audit.verify(again.log())
    before = again.summary()
    assert [len(r["spans"]) for r in again.preview(spark.createDataFrame([(1, 0, "neu@x.at")], "doc_id long, seg_no long, text string")).collect()] == [1] and again.summary() == before
    with pytest.raises(WrongPassword):
        Profile(spark, root, "Kanzlei A", "falsch")
    with pytest.raises(ValueError):
        Profile(spark, root, "a/b", "x")
    assert listed(spark, root) == ["Kanzlei_A"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("MASKWERK_PASSWORD", "geheim")
    run = lambda *a: cli.main(["--root", str(tmp_path / "p"), *a], spark)
    (tmp_path / "brief.txt").write_text("Schreiben an a@x.at")
    assert run("anonymize", str(tmp_path / "brief.txt")) == 0
    assert json.loads(capsys.readouterr().out)["output"] == "Schreiben an <EMAIL_001>"
    assert run("deanonymize", "--text", "<EMAIL_001> <EMAIL_009>") == cli.MISSING
    assert json.loads(capsys.readouterr().out)["output"] == "a@x.at <EMAIL_009>"
    assert run("audit", "verify") == 0 and run("doctor") == 0 and run("profiles") == 0 and "default" in capsys.readouterr().out
