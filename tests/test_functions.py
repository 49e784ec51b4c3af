"""Checksums and string functions against plain Python."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from maskwerk.functions import checksums as C
from maskwerk.functions import text as X


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def iban(x):
    x = x.replace(" ", "")
    return C.IBAN_LENGTHS.get(x[:2]) == len(x) and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def iso(d):
    p = 10
    for c in d:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10


RULES = {
    "valid_card": (lambda r: "".join(r.choices("0123456789", k=r.randint(13, 19))), luhn),
    "valid_ahv": (lambda r: "756" + "".join(r.choices("0123456789", k=10)), lambda d: (10 - sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(d[:12])) % 10) % 10 == int(d[12])),
    "valid_de_uid": (lambda r: "DE" + "".join(r.choices("0123456789", k=9)), lambda d: iso(d[2:10]) == int(d[10])),
    "valid_at_uid": (lambda r: "ATU" + "".join(r.choices("0123456789", k=8)), lambda d: (10 - (sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[3:10])) + 4) % 10) % 10 == int(d[10])),
    "valid_svnr": (
        lambda r: f"{r.randrange(10000):04d}{r.randint(0, 33):02d}{r.randint(0, 14):02d}{r.randrange(100):02d}",
        lambda d: 1 <= int(d[4:6]) <= 31 and 1 <= int(d[6:8]) <= 12 and sum(int(c) * w for c, w in zip(d, C.SVNR_WEIGHTS, strict=True)) % 11 == int(d[3]),
    ),
    "valid_de_tax_id": (
        lambda r: (lambda d: "".join(d) + str(iso(d) if r.random() < 0.6 else r.randrange(10)))(r.sample("0123456789", 9) + [r.choice("0123456789")]),
        lambda d: iso(d[:10]) == int(d[10]) and (lambda n: (max(n) == 2 and len(n) == 9) or (max(n) == 3 and len(n) == 8))([d[:10].count(c) for c in set(d[:10])]),
    ),
    "valid_iban": (
        lambda r: (lambda cc, b: f"{cc}{98 - int(''.join(str(int(c, 36)) for c in b + cc + '00')) % 97 if r.random() < 0.6 else 11:02d}{b}")(cc := r.choice(list(C.IBAN_LENGTHS)), "".join(r.choices("0123456789ABZ", k=C.IBAN_LENGTHS[cc] - 4))),
        iban,
    ),
}


@pytest.mark.parametrize("name", RULES)
def test_checksums(spark, name):
    rng, (make, rule) = random.Random(name), RULES[name]
    values = [make(rng) for _ in range(600)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", getattr(C, name)(F.col("v")).alias("ok")).collect()
    assert {r["v"]: r["ok"] for r in got} == {v: rule(v) for v in values}
    assert 20 < sum(map(rule, values)) < 580
    odd = spark.createDataFrame([(v,) for v in ("", "x", "ATU", "DE12", "äöü" * 7, "1" * 40, None)], "v string")
    assert not any(r[0] for r in odd.select(getattr(C, name)(F.col("v"))).collect())


def test_bic(spark):
    got = spark.createDataFrame([(v,) for v in ("DEUTDEFF", "DEUTDEFFXXX", "DEUTXXFF", "DEUTDEF", "deutdeff")], "v string").select(C.valid_bic(F.col("v"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]


def test_matches_have_code_point_places(spark):
    texts = ["😀 a1 ü b22", "a1", "", "x", "a1a1", "a1 a1"]
    for pattern in ("[a-z][0-9]+", "a(1)"):
        for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.matches(F.col("t"), pattern).alias("m")).collect():
            import re

            assert [(m["start"], m["end"], m["text"]) for m in r["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r["t"])]


def test_normal_forms(spark):
    cases = {"  Müller & Söhne   GmbH ": "mueller & soehne gmbh", "Café-Straße": "cafe strasse", "A.B. (x)": "a.b. x", "": "", "ﬁrma ½": "firma 1 2"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.normalize(F.col("t"), full=True).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases


@pytest.mark.parametrize(
    ("a", "b", "category", "want"),
    [
        ("hofer bau gmbh", "hofer bau gmbh", "UID", True), ("hofer bau gmbh", "hofer-bau gmbh", "COMPANY", True), ("hofer bau gmbh", "hofer bau ag", "COMPANY", False),
        ("musterhandel wien gmbh", "musterhandel wein gmbh", "COMPANY", False), ("musterhandel wien gmbh", "musterhandel wienn gmbh", "COMPANY", True), ("abc gmbh", "abd gmbh", "COMPANY", False),
        ("max muster", "max mustre", "PERSON", False), ("gmbh", "gmbh & co. kg", "COMPANY", False),
    ],
)
def test_merge_predicate(spark, a, b, category, want):
    assert spark.range(1).select(X.should_merge(F.lit(a), F.lit(b), F.lit(category))).first()[0] is want


def test_small_formats(spark):
    key = b"secret key"
    r = spark.range(1).select(
        X.hmac_sha256(F.lit("wörd"), key), X.counts_json(F.create_map(F.lit("B"), F.lit(2), F.lit("A"), F.lit(1))), X.counts_told(F.create_map(F.lit("B"), F.lit(2), F.lit("A"), F.lit(2), F.lit("C"), F.lit(9))),
        X.formula_texts(F.lit('=A1&"x""y"&B2&"z"'), F.upper), X.file_stem(F.lit('a/b: "c"*')), X.slug(F.lit("Kanzlei Müller & Co")),
    ).first()
    assert tuple(r) == (hmac.new(key, "wörd".encode(), hashlib.sha256).hexdigest(), '{"A":1,"B":2}', "9x C, 2x A, 2x B", '=A1&"X""Y"&B2&"Z"', "a b c", "Kanzlei_M_ller_Co")


def test_words_and_variants(spark):
    r = spark.range(1).select(
        X.word_sequences(F.split(F.lit("a b a b c"), " "), F.split(F.lit("a b"), " ")), X.word_sequences(F.split(F.lit("a"), " "), F.split(F.lit("a b"), " ")),
        X.reading_variants(F.lit("HauptstraBe12 HuberGmbH")), X.keywords(F.lit("Die Bewertung der Bewertungen von Netz und Netzwerk"), ["netz"]),
    ).first()
    assert r[0] == [0, 2] and r[1] == [] and r[3] == ["bewer", "netzw"]
    assert {"Hauptstraße12 HuberGmbH", "HauptstraBe 12 HuberGmbH", "HauptstraBe12 Huber GmbH"} <= set(r[2])
